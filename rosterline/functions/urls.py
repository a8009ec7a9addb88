"""URL expressions.  Written with regular expressions because parse_url raises
on bad input and keeps the case of the host."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions.text import let, strip_ws

_SCHEME = r"(?i)^https?://"


def with_scheme(url: Column) -> Column:
    return let(
        strip_ws(url),
        lambda u: F.when(u.rlike(_SCHEME), u).otherwise(F.concat(F.lit("https://"), u)),
    )


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_host(url: Column) -> Column:
    """Host part (with port) of a URL that has a scheme, lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def normalize_url(url: Column) -> Column:
    """Scheme and host lower case, no fragment, no trailing slash but the root."""
    return let(with_scheme(url), _normalize)


def _normalize(full: Column) -> Column:
    raw_path = url_path(full)
    params = F.regexp_extract(raw_path, r"(;[^/]*)$", 1)
    path = F.regexp_replace(raw_path, r";[^/]*$", "")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/+$", ""))
    query = F.regexp_extract(full, r"^[^?#]*(\?[^#]+)", 1)
    return F.concat(
        url_scheme(full), F.lit("://"), url_host(full), path,
        F.when(F.length(params) > 1, params).otherwise(F.lit("")), query,
    )


def bare_domain(raw: Column) -> Column:
    """Cut at slash and colon, drop `www.`; null without a dot or below 4 chars."""
    host = F.regexp_extract(F.lower(strip_ws(raw)), r"^([^/:]*)", 1)
    return let(
        F.regexp_replace(host, r"^www\.", ""),
        lambda h: F.when(h.contains(".") & (F.length(h) >= 4), h),
    )


def site_domain(url_or_domain: Column) -> Column:
    return bare_domain(
        let(strip_ws(url_or_domain), lambda v: F.when(v.rlike(_SCHEME), url_host(v)).otherwise(v))
    )


def domain_suffixes(domain: Column) -> Column:
    """The domain and all its parents that still hold a dot."""
    def tails(parts: Column) -> Column:
        return F.when(
            F.size(parts) >= 2,
            F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return let(F.split(domain, r"\."), tails)


def same_domain(base: Column, target: Column) -> Column:
    """Equal, or target is a subdomain of base; `www.` does not count."""
    b = F.regexp_replace(F.lower(base), r"^www\.", "")
    t = F.regexp_replace(F.lower(target), r"^www\.", "")
    hit = (t == b) | F.endswith(t, F.concat(F.lit("."), b))
    return F.coalesce((F.length(base) > 0) & (F.length(target) > 0) & hit, F.lit(False))


def is_static_asset(url: Column) -> Column:
    return url_path(url).rlike(r"(?i)\.(?:" + "|".join(vocab.STATIC_EXTENSIONS) + r")$")


def _remove_dot_segments(path: Column) -> Column:
    """Fold `.` and `..` segments of an absolute path."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        empty,
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc)
        .otherwise(F.array_append(acc, p)),
    )
    return let(F.array_join(folded, "/"), lambda joined: _rooted(path, joined))


def _rooted(path: Column, joined: Column) -> Column:
    ends_open = path.rlike(r"/\.\.?$") & ~F.endswith(joined, F.lit("/"))
    rooted = F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(ends_open, F.concat(rooted, F.lit("/"))).otherwise(rooted)


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve a link against the URL of its page."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_path = url_path(base)
    folder = F.when(base_path.contains("/"), F.regexp_extract(base_path, r"^(.*/)", 1)).otherwise("/")
    rel_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rel_tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    target = F.when(F.startswith(href, F.lit("/")), rel_path).otherwise(F.concat(folder, rel_path))
    target = let(target, lambda t: F.when(t.contains("/."), _remove_dot_segments(t)).otherwise(t))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(url_scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, base_path, href))
        .otherwise(F.concat(origin, target, rel_tail))
    )
