"""Phones, mailboxes, tax identifiers and company names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions.entities import mailbox
from rosterline.functions.text import alternation, collapse_ws, empty_to_null, let, one_of, strip_ws


def phone_e164(raw: Column) -> Column:
    """E.164 if the number is plausible, else the raw text without letters.

    Plausible is a rule, not a numbering-plan database: `+7` with a Russian or
    Kazakh area code, or another country code with 8 to 15 digits in all.
    """
    full = let(F.regexp_replace(raw, r"[^\d+]", ""), _with_country)
    plausible = r"^\+7[34789]\d{9}$|^\+(?!7)[1-9]\d{7,14}$"
    rest = strip_ws(F.regexp_replace(raw, r"(?U)[^\d+\-()\s]", ""))
    return let(full, lambda f, r: F.when(f.rlike(plausible), f).otherwise(empty_to_null(r)), rest)


def _with_country(kept: Column) -> Column:
    return (
        F.when(kept.rlike(r"^8\d{10}$"), F.concat(F.lit("+7"), F.substr(kept, F.lit(2))))
        .when(kept.rlike(r"^7\d{10}$"), F.concat(F.lit("+"), kept))
        .when(kept.rlike(r"^[3489]\d{9}$"), F.concat(F.lit("+7"), kept))
        .otherwise(kept)
    )


def phone_digits(phone: Column) -> Column:
    """Digits only, Russian numbers with a leading 7; empty for null."""
    return let(F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", ""), _russian_digits)


def _russian_digits(digits: Column) -> Column:
    return (
        F.when(digits.rlike(r"^8\d{10}$"), F.concat(F.lit("7"), F.substr(digits, F.lit(2))))
        .when(F.length(digits) == 10, F.concat(F.lit("7"), digits))
        .otherwise(digits)
    )


def is_mobile(digits: Column) -> Column:
    return (F.length(digits) >= 11) & (F.substring(digits, 2, 1) == "9")


def phone_mobile(phone: Column) -> Column:
    return let(phone_digits(phone), lambda d: F.when(is_mobile(d), d).otherwise(""))


def phone_city(phone: Column) -> Column:
    return let(phone_digits(phone), lambda d: F.when(is_mobile(d), "").otherwise(d))


def _bare_prefixes(prefixes: list[str]) -> list[str]:
    return list(dict.fromkeys(p.translate(str.maketrans("", "", "-._")) for p in prefixes))


def is_generic_email(email: Column) -> Column:
    """A company mailbox.  Separators inside the prefix do not count, which
    covers the exact match as well."""
    bare = F.translate(mailbox(email), "-._", "")
    generic = one_of(bare, _bare_prefixes(vocab.GENERIC_PREFIXES))
    return F.coalesce((email != "") & generic, F.lit(False))


def is_generic_email_final(email: Column) -> Column:
    """Wider list, plus short prefixes and department markers."""
    return F.coalesce((email != "") & let(mailbox(email), _generic_box), F.lit(False))


def _generic_box(box: Column) -> Column:
    return (
        one_of(F.translate(box, "-._", ""), _bare_prefixes(vocab.GENERIC_PREFIXES_FINAL))
        | (F.length(box) <= 3)
        | box.rlike(alternation(vocab.DEPARTMENT_MARKERS))
    )


def relocate_generic_email(personal: Column, company: Column, generic: Column) -> tuple[Column, Column]:
    """New (personal, company) pair: a generic mailbox moves to an empty company
    field.  Both are computed from the old values."""
    clean_personal = F.lower(strip_ws(personal))
    clean_company = F.lower(strip_ws(company))
    new_personal = F.when(~generic, clean_personal)
    new_company = F.when(generic & F.coalesce(company == "", F.lit(True)), clean_personal).otherwise(clean_company)
    return new_personal, new_company


def validate_inn(inn: Column) -> Column:
    """Digits of an identifier with 10 or 12 of them, else null."""
    return let(F.regexp_replace(inn, r"\D", ""), lambda d: F.when(F.length(d).isin(10, 12), d))


def validate_kpp(kpp: Column) -> Column:
    return let(F.regexp_replace(kpp, r"\D", ""), lambda d: F.when(F.length(d) == 9, d))


def strict_inn(inn: Column) -> Column:
    """The value itself if, stripped, it is nothing but 10 or 12 digits."""
    return F.when(strip_ws(inn).rlike(r"^(?:\d{10}|\d{12})$"), inn)


def strict_kpp(kpp: Column) -> Column:
    return F.when(strip_ws(kpp).rlike(r"^\d{9}$"), kpp)


def _control_digit(digits: Column, weights: list[int]) -> Column:
    total = sum(
        (F.substring(digits, i, 1).cast("int") * w for i, w in enumerate(weights, start=1)), F.lit(0)
    )
    return total % 11 % 10


def inn_checksum(inn: Column) -> Column:
    """True if the control digits fit; null for anything but 10 or 12 digits."""
    # fixed values: weights of the 12-digit form; the shorter forms are its tails
    weights = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]

    def digit(i: int) -> Column:
        return F.substring(inn, i, 1).cast("int")

    return F.when(inn.rlike(r"^\d{10}$"), _control_digit(inn, weights[2:]) == digit(10)).when(
        inn.rlike(r"^\d{12}$"),
        (_control_digit(inn, weights[1:]) == digit(11)) & (_control_digit(inn, weights) == digit(12)),
    )


def company_name_first_part(name: Column) -> Column:
    return F.when(name.contains(";"), strip_ws(F.split_part(name, F.lit(";"), F.lit(1)))).otherwise(name)


def company_name_clean(name: Column) -> Column:
    """Drop page-title junk, prefer the text in quotes; short results fall back."""
    return let(strip_ws(F.coalesce(name, F.lit(""))), _clean_company)


def _clean_company(original: Column) -> Column:
    prefixes, tails = "|".join(vocab.COMPANY_JUNK_PREFIXES), "|".join(vocab.COMPANY_JUNK_TAILS)
    out = strip_ws(F.regexp_replace(original, rf"(?iU)^(?:{prefixes})\s*[-—:«»]?\s*", ""))
    out = strip_ws(F.regexp_replace(out, rf"(?iU)\s*[-—:]+\s*(?:{tails}).*$", ""))
    out = strip_ws(F.regexp_replace(out, r"(?U)\s*[-—]\s*$", ""))
    out = strip_ws(F.regexp_replace(out, r"(?U)^.*?[«»](.+?)[«»].*$", "$1"))
    out = F.regexp_replace(collapse_ws(out), r"[.\-:;,]+$", "")
    return let(out, lambda o: F.when(F.length(o) > 2, o).otherwise(original))


def has_useful_field(*fields: Column) -> Column:
    return F.coalesce(*[empty_to_null(f) for f in fields]).isNotNull()
