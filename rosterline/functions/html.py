"""HTML expressions that need no tree: text, language, company name, links."""

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions.text import alternation, let, one_of, strip_ws
from rosterline.functions.urls import is_static_asset, normalize_url, resolve_url, same_domain, url_host

# fixed values: elements whose content is no text, and named entities
HIDDEN_ELEMENTS = ["script", "style", "noscript", "head"]
# Named character references of HTML 5, from the standard library.
NAMED_ENTITIES = {name: char for name, char in html5.items() if name.endswith(";")}


def _code_points(text: Column, pattern: str, base: int) -> Column:
    """Replace the numeric character references found by `pattern`."""
    def one(acc: Column, ref: Column) -> Column:
        number = F.conv(F.regexp_extract(ref, r"([0-9A-Fa-f]+);$", 1), base, 16)
        known = F.length(number).between(1, 6)
        char = F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")
        return F.when(known, F.replace(acc, ref, char)).otherwise(acc)

    return F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), text, one)


def _numeric(text: Column) -> Column:
    decimal = _code_points(text, r"&#[0-9]{1,7};", 10)
    both = let(decimal, lambda t: _code_points(t, r"&#[xX][0-9A-Fa-f]{1,6};", 16))
    return F.when(text.contains("&#"), both).otherwise(text)


def _named(text: Column) -> Column:
    """Each different reference of a text is looked up once; `&amp;` comes last,
    so that the text it makes is not read again."""
    names = F.lit(",".join(NAMED_ENTITIES))
    chars = F.split(F.lit("\u0001".join(NAMED_ENTITIES.values())), "\u0001")

    def one(acc: Column, ref: Column) -> Column:
        place = F.find_in_set(F.substring(ref, 2, 64), names)
        return F.when(place > 0, F.replace(acc, ref, F.try_element_at(chars, place))).otherwise(acc)

    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&[A-Za-z][A-Za-z0-9]*;"), F.lit(0)))
    plain = F.array_remove(F.array_remove(found, "&amp;"), "&AMP;")
    out = F.replace(F.replace(F.aggregate(plain, _numeric(text), one), F.lit("&AMP;"), F.lit("&")), F.lit("&amp;"), F.lit("&"))
    return F.when(text.contains("&"), out).otherwise(text)


def unescape_entities(text: Column) -> Column:
    return let(text, _named)


def drop_hidden(html: Column) -> Column:
    """Without comments, declarations and elements that show no text."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in HIDDEN_ELEMENTS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\u0001")
    return out


def html_to_text(html: Column, separator: str = " ") -> Column:
    """Visible text: pieces between tags, stripped, joined by the separator."""
    marked = F.regexp_replace(drop_hidden(html), r"<[a-zA-Z/!?][^>]*>", "\u0001")
    clean = unescape_entities(marked)
    # a run of blanks that holds a mark; tried only where a run starts
    joined = F.regexp_replace(clean, r"(?U)(?<![\s\u0001])(?=\s*+\u0001)[\s\u0001]++", "\u0001")
    joined = F.regexp_replace(joined, r"(?U)^[\s\u0001]++|(?<![\s\u0001])[\s\u0001]++$", "")
    return F.replace(joined, F.lit("\u0001"), F.lit(separator))


def page_language(html: Column) -> Column:
    """Two letters from html lang, else the meta tags, else `unknown`."""
    def attr(tag: Column, name: str) -> Column:
        return F.nullif(F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1), F.lit(""))

    root = F.regexp_extract(html, r"(?i)<html\b[^>]*>", 0)
    http_equiv = F.regexp_extract(html, r"(?i)<meta\b[^>]*http-equiv\s*=\s*[\"']?Content-Language\b[^>]*>", 0)
    named = F.regexp_extract(html, r"(?i)<meta\b[^>]*name\s*=\s*[\"']?language\b[^>]*>", 0)
    found = F.coalesce(attr(root, "lang"), attr(http_equiv, "content"), attr(named, "content"))
    return F.coalesce(F.substring(F.lower(found), 1, 2), F.lit("unknown"))


def has_captcha(html: Column, head_chars: int = 5000) -> Column:
    """A challenge marker in the head of the page.

    The window is part of the rule: the same words far down a page are prose.
    """
    return F.substring(html, 1, head_chars).rlike("(?id)(?:" + "|".join(vocab.CAPTCHA_MARKERS) + ")")


def company_name_from_page(html: Column) -> Column:
    """og:site_name, else the last title part after a separator."""
    meta = F.regexp_extract(html, r"(?i)<meta\b[^>]*property\s*=\s*[\"']og:site_name[\"'][^>]*>", 0)
    content = F.regexp_extract(meta, r"(?i)\scontent\s*=\s*(?:\"([^\"]*)\"|'[^']*')", 1)
    single = F.regexp_extract(meta, r"(?i)\scontent\s*=\s*'([^']*)'", 1)
    site_name = let(
        strip_ws(unescape_entities(F.concat(content, single))), lambda n: F.when(F.length(n) > 2, n)
    )
    title = strip_ws(unescape_entities(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))

    def last_part(text: Column, separator: str) -> Column:
        parts = F.filter(
            F.transform(F.split(text, rf"\Q{separator}\E"), strip_ws), lambda p: F.length(p) > 0
        )
        last = F.try_element_at(parts, F.lit(-1))
        good = (F.size(parts) >= 2) & (F.length(last) > 3) & ~one_of(F.lower(last), vocab.GARBAGE_TITLE_PARTS)
        return F.when(text.contains(separator) & good, last)

    from_title = let(title, lambda t: F.coalesce(*[last_part(t, s) for s in vocab.TITLE_SEPARATORS]))
    return F.coalesce(site_name, from_title)


def page_links(html: Column, page_url: Column) -> Column:
    """Array of links of a page: order, normalised URL, text and title.

    Kept as an array on the page row, so finding links needs no shuffle.  Each
    step names its result as a struct field: inside a lambda nothing is shared.
    """
    return let(normalize_url(page_url), _links_of, html)


def _links_of(base: Column, html: Column) -> Column:
    host = url_host(base)
    anchors = F.regexp_extract_all(
        html, F.lit(r"(?is)<a\s[^>]*>(?:.*?(?=</a>|<a\s)|.*)"), F.lit(0)
    )
    parsed = F.transform(
        anchors,
        lambda a, i: F.struct(
            i.cast("long").alias("link_ord"),
            F.regexp_extract(a, r"(?is)^<a\s[^>]*>", 0).alias("tag"),
            F.lower(html_piece_text(F.regexp_replace(a, r"(?is)^<a\s[^>]*>", ""))).alias("text"),
        ),
    )
    with_href = F.transform(
        parsed,
        lambda s: F.struct(
            s.link_ord.alias("link_ord"), s.text.alias("text"),
            strip_ws(_attribute(s.tag, "href")).alias("href"),
            F.lower(_attribute(s.tag, "title")).alias("title"),
        ),
    )
    followed = F.filter(
        with_href,
        lambda s: (F.length(s.href) > 0) & ~s.href.rlike(r"^(?:#|mailto:|tel:|javascript:)"),
    )
    absolute = F.transform(followed, lambda s: _relink(s, resolve_url(base, s.href)))
    normalised = F.transform(absolute, lambda s: _relink(s, normalize_url(s.url)))
    return F.filter(normalised, lambda s: same_domain(host, url_host(s.url)))


def _relink(s: Column, url: Column) -> Column:
    return F.struct(
        s.link_ord.alias("link_ord"), url.alias("url"), s.text.alias("text"), s.title.alias("title"),
        s.href.alias("href"),
    )


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return unescape_entities(F.regexp_replace(value, r"^[\"']|[\"']$", ""))


def html_piece_text(html: Column) -> Column:
    """Text of a small fragment, tags as blanks."""
    return unescape_entities(F.regexp_replace(html, r"<[^>]*>", " "))


def is_contact_link(link: Column) -> Column:
    """A keyword in the link text, in its URL or in its title."""
    words = vocab.CONTACT_PAGE_KEYWORDS
    in_url = {w.replace(" ", "-") for w in words} | {w.replace(" ", "_") for w in words}
    return (
        link.text.rlike(alternation(words))
        | F.lower(link.url).rlike(alternation(in_url))
        | F.coalesce(link.title, F.lit("")).rlike(alternation(words))
    )


def contact_links(links: Column) -> Column:
    """Distinct URLs of relevant, non-static links, shortest first."""
    hits = F.filter(links, lambda s: ~is_static_asset(s.url) & is_contact_link(s))
    urls = F.array_distinct(F.transform(hits, lambda s: s.url))
    ranked = F.array_sort(F.transform(urls, lambda u, i: F.struct(F.length(u).alias("len"), i.alias("i"), u.alias("url"))))
    return F.transform(ranked, lambda s: s.url)
