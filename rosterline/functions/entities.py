"""Entities in text: emails, phones, tax identifiers, names, social links."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions.names import name_quick_valid
from rosterline.functions.text import collapse_ws, empty_to_null, let, one_of
from rosterline.functions.urls import url_host

# fixed values: what counts as an email, a phone, a tax number, a full name
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = (
    r"(?:(?:\+7|8|7)[\s\-\(\.]*(?:\d{3}|\(\d{3}\))[\s\-\)\.]*\d{3}[\s\-\.]*\d{2}[\s\-\.]*\d{2})"
    r"|(?:\+\d{1,3}[\s\-\(\.]*\d{2,4}[\s\-\)\.]*\d{3,4}[\s\-\.]*\d{3,4})"
)
CYRILLIC_NAME = r"[А-ЯЁ][а-яё]+"
FULL_NAME = (
    rf"\b{CYRILLIC_NAME}(?:-{CYRILLIC_NAME})?\s+{CYRILLIC_NAME}\s+[А-ЯЁ][а-яё]*(?:ич|на)\b"
)
INITIALS_NAME = rf"\b[А-ЯЁ]\.[А-ЯЁ]\.\s*{CYRILLIC_NAME}\b"

# The same matches as EMAIL in linear time: a match may start only where a run
# of mailbox characters starts or where the last match ended.
_EMAIL_SCAN = r"(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_NO_STRINGS = "array<string>"


def _no_strings() -> Column:
    return F.array().cast(_NO_STRINGS)


def all_emails(text: Column) -> Column:
    """Every email in text order, repeats kept."""
    return F.when(
        text.contains("@"), F.regexp_extract_all(text, F.lit(_EMAIL_SCAN), F.lit(0))
    ).otherwise(_no_strings())


def extract_emails(text: Column) -> Column:
    return F.array_distinct(all_emails(text))


def extract_phones(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + PHONE), F.lit(0))
    return F.transform(found, collapse_ws)


# fixed values: labels of the identifiers, in running text and in a page's own details
INN_LABEL, KPP_LABEL = r"(?:ИНН|INN)[\s:№\-]*", r"(?:КПП|KPP)[\s:№\-]*"
INN_DETAIL, KPP_DETAIL = r"(?:ИНН|INN)[:\s]*(\d{12}|\d{10})(?!\d)", r"(?:КПП|KPP)[:\s]*(\d{9})"


def extract_inn(text: Column, require_label: bool = False) -> Column:
    """First labelled or isolated 10 or 12 digit number; 12 digits win."""
    start = INN_LABEL if require_label else rf"(?:{INN_LABEL}|(?<!\d))"
    return empty_to_null(F.regexp_extract(text, rf"(?iU){start}(\d{{12}}|\d{{10}})(?!\d)", 1))


def extract_kpp(text: Column, require_label: bool = False) -> Column:
    """First labelled or isolated 9 digit number."""
    labelled = KPP_LABEL + r"(\d{9})"
    pattern = labelled if require_label else labelled + r"|(?<!\d)(\d{9})(?!\d)"
    first = F.regexp_extract(text, rf"(?iU){pattern}", 1)
    if require_label:
        return empty_to_null(first)
    return empty_to_null(F.concat(first, F.regexp_extract(text, rf"(?iU){pattern}", 2)))


def labelled_inn(text: Column) -> Column:
    return empty_to_null(F.regexp_extract(text, "(?iU)" + INN_DETAIL, 1))


def labelled_kpp(text: Column) -> Column:
    return empty_to_null(F.regexp_extract(text, "(?iU)" + KPP_DETAIL, 1))


def _initials_form(match: Column) -> Column:
    return F.regexp_replace(match, r"(?U)^(..)(..)\s*", "$1$2 ")


def extract_fio_first(text: Column) -> Column:
    """First full name if it looks like a person, else the first initials form."""
    full = let(
        collapse_ws(F.regexp_extract(text, "(?U)" + FULL_NAME, 0)),
        lambda name: F.when(name_quick_valid(name), name),
    )
    initials = _initials_form(F.regexp_extract(text, "(?U)" + INITIALS_NAME, 0))
    return F.coalesce(full, empty_to_null(initials))


def extract_fio_all(text: Column) -> Column:
    """All full forms, then all initials forms; distinct and quick-checked."""
    full = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + FULL_NAME), F.lit(0)), collapse_ws)
    initials = F.transform(
        F.regexp_extract_all(text, F.lit("(?U)" + INITIALS_NAME), F.lit(0)), _initials_form
    )
    return F.array_distinct(F.filter(F.concat(full, initials), name_quick_valid))


def has_full_name(text: Column) -> Column:
    return text.rlike("(?U)" + FULL_NAME)


def extract_social_links(html: Column) -> Column:
    """First link of each network, with a scheme."""
    fields = []
    for network, pattern in vocab.SOCIAL_PATTERNS.items():
        link = F.regexp_extract(html, "(?i)" + pattern, 0)
        fields.append(let(link, _with_scheme).alias(network))
    return F.struct(*fields)


def _with_scheme(link: Column) -> Column:
    return (
        F.when(link == "", F.lit(None))
        .when(link.rlike("(?i)^https?:"), link)
        .otherwise(F.concat(F.lit("https://"), link))
    )


def empty_social_links() -> Column:
    return F.struct(*[F.lit(None).cast("string").alias(n) for n in vocab.SOCIAL_PATTERNS])


def mailbox(email: Column) -> Column:
    return F.lower(F.trim(F.split_part(email, F.lit("@"), F.lit(1))))


def company_email(emails: Column, site_url: Column) -> Column:
    """First generic mailbox on the site's own domain, else any generic one."""
    generic = F.filter(emails, lambda e: one_of(mailbox(e), vocab.GENERIC_PREFIXES))
    domain = F.regexp_replace(url_host(site_url), r"^www\.", "")

    def best(found: Column, host: Column) -> Column:
        own = F.filter(found, lambda e: (F.length(host) > 0) & F.contains(F.lower(e), host))
        return F.lower(F.coalesce(F.get(own, F.lit(0)), F.get(found, F.lit(0))))

    return let(generic, best, domain)


def position_near_name(text: Column, name: Column, reach: int = 200) -> Column:
    """A title within `reach` characters around the first place of the name."""
    def window(at: Column, whole: Column, width: Column) -> Column:
        start = F.greatest(at - reach, F.lit(1))
        return F.when(at > 0, F.substr(whole, start, at + width + reach - start))

    return let(let(F.instr(text, name), window, text, F.length(name)), _title_in)


def _title_in(around: Column) -> Column:
    titles = "|".join(vocab.NEAR_POSITION_TITLES)
    nouns = "|".join(rf"{CYRILLIC_NAME} {noun}" for noun in vocab.NEAR_POSITION_NOUNS)
    return F.coalesce(
        empty_to_null(F.regexp_extract(around, f"(?iU)({titles})", 1)),
        empty_to_null(F.regexp_extract(around, f"(?iU)({nouns})", 1)),
    )


def extract_names_latin(text: Column) -> Column:
    """Title Case names of two or three words, without stock phrases."""
    found = F.regexp_extract_all(
        text, F.lit(r"(?U)\b[A-Z][a-z]{1,20}\s+[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20})?\b"), F.lit(0)
    )
    return F.array_except(F.array_distinct(found), F.split(F.lit(",".join(vocab.LATIN_NAME_STOP)), ","))
