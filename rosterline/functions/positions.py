"""Positions: three levels of checks, dictionary lookup, target match."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions.text import contains_any, has_word, let, strip_ws, word_count

# fixed values: what no position may hold
_PHONE_LIKE = r"(?U)(?:\+7|8[\s\-]?\(?\d{3})\)?[\s\-]?\d{3}"
_WEB_ADDRESS = r"(?i)https?://|www\."
_WHOLE_DATE = r"(?U)\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2}"
_LEADING_DAY = r"(?U)^\d{1,2}(?:\s|\.\d{1,2}\.\d{2,4})"
_NUMBERS_ONLY = r"(?U)^[\d\s.,\-]+$"
_DOMAIN_END = r"(?U)\.\w{2,3}$"
_YEAR = r"(?U)\b20[1-3]\d\b"


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def position_quick_valid(position: Column) -> Column:
    """Cheap check of text that stands where a position is expected.

    Months count as substrings, as in the results to match.
    """
    return let(position, lambda p: let(F.lower(p), lambda lowered: _quick(p, lowered)))


def _quick(position: Column, lowered: Column) -> Column:
    return _yes(
        F.length(position).between(3, 100)
        & ~contains_any(lowered, vocab.MONTHS_RU)
        & ~position.rlike(r"(?U)^\d")
        & ~has_word(lowered, vocab.QUICK_POSITION_GARBAGE, ".,;:-")
        & ~position.contains("@")
        & ~lowered.contains("http")
        & ~lowered.contains("www.")
        & ~position.endswith(":")
        & ~position.rlike(r"(?U)\b20[12]\d\b")
    )


def position_valid_strict(position: Column) -> Column:
    """The stripped position, or null for contacts, dates and addresses."""
    return let(strip_ws(position), lambda v: let(F.lower(v), lambda lowered: _strict(v, lowered)))


def _strict(value: Column, lowered: Column) -> Column:
    marks = [F.contains(lowered, F.lit(m)).cast("int") for m in vocab.ADDRESS_MARKERS]
    address_hits = reduce(lambda a, b: a + b, marks)
    good = (
        F.length(value).between(3, 150)
        & ~value.contains("@")
        & ~value.rlike(_WEB_ADDRESS)
        & ~value.rlike(_PHONE_LIKE)
        & ~value.rlike(_WHOLE_DATE)
        & (F.regexp_count(value, F.lit(r"(?U)\d")) <= 4)
        & (address_hits < 2)
        & (word_count(value) <= 8)
    )
    return F.when(good, value)


def position_valid_final(position: Column) -> Column:
    """The stripped position, or null for anything that is no job title."""
    return let(strip_ws(position), lambda v: let(F.lower(v), lambda lowered: _final(v, lowered)))


def _final(value: Column, lowered: Column) -> Column:
    prose = (word_count(value) > 5) & ~has_word(lowered, vocab.POSITION_MARKERS, ".,;:-")
    good = (
        F.length(value).between(3, 100)
        & ~contains_any(lowered, vocab.MONTHS_RU + vocab.MONTHS_EN)
        & ~value.rlike(_LEADING_DAY)
        & ~value.rlike(_NUMBERS_ONLY)
        & ~value.contains("@")
        & ~lowered.contains("http")
        & ~lowered.contains("www.")
        & ~value.rlike(_DOMAIN_END)
        & ~value.rlike(_PHONE_LIKE)
        & ~value.endswith(":")
        & ~has_word(lowered, vocab.POSITION_GARBAGE, ".,;:-()\"'")
        & ~value.rlike(_YEAR)
        & ~prose
        & ~has_word(lowered, vocab.NEWS_WORDS, ".,;:-")
    )
    return F.when(good, value)


def contains_target(raw: Column, normalized: Column, targets: list[str]) -> Column:
    """A target is a substring of the raw and normalised position together."""
    text = F.lower(F.concat(F.coalesce(raw, F.lit("")), F.lit(" "), F.coalesce(normalized, F.lit(""))))
    hits = [F.contains(text, F.lit(t.lower())) for t in targets]
    return reduce(lambda a, b: a | b, hits, F.lit(False)) if targets else F.lit(True)
