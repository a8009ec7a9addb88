"""Small string expressions shared by all column functions.

White space and word characters are Unicode everywhere, hence the (?U) flag.
"""

import re
from typing import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[..., Column], *more: Column) -> Column:
    """Evaluate `value` (and `more`) once and use them many times in `body`.

    Columns are trees: a value named in Python is repeated at every use, which
    multiplies regular expressions and can push generated code over the size
    limit of a method.

    A body must get every column it needs as an argument.  A column captured
    from outside is resolved late, and then an output column of the same
    projection with the same name wins over the input column.
    """
    if not more:
        return F.get(F.transform(F.array(value), body), F.lit(0))
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate((value, *more))])
    unpacked = lambda s: body(*[s[f"v{i}"] for i in range(len(more) + 1)])
    return F.get(F.transform(F.array(packed), unpacked), F.lit(0))


def one_of(c: Column, words: Iterable[str]) -> Column:
    """Membership in a fixed list without commas; one literal, compiled code."""
    return F.find_in_set(c, F.lit(",".join(words))) > 0


def lookup(c: Column, mapping: dict[str, str]) -> Column:
    """Value of a fixed mapping (keys without commas), null for other text."""
    place = F.find_in_set(c, F.lit(",".join(mapping)))
    values = F.split(F.lit("\n".join(mapping.values())), "\n")
    return let(place, lambda i: F.when(i > 0, F.try_element_at(values, i)))


def strip_ws(c: Column) -> Column:
    """No white space at the ends.  A run inside the text is looked at once, at
    its start, so long runs do not take quadratic time."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def collapse_ws(c: Column) -> Column:
    """One plain space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c.rlike(r"(?U)\S"), c)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def alternation(words: Iterable[str]) -> str:
    """Literal alternation, longest first so no word hides a longer one."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def has_word(lowered: Column, words: Iterable[str], strip: str) -> Column:
    """True if a blank-separated word, stripped of `strip`, is in `words`.

    One regular expression instead of split + higher-order functions keeps the
    test inside generated code.
    """
    edge = f"[{re.escape(strip)}]*"
    return lowered.rlike(rf"(?U)(?<!\S){edge}(?:{alternation(words)}){edge}(?!\S)")


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    return lowered.rlike(alternation(words))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def capitalize_first(c: Column) -> Column:
    """First letter upper, the rest unchanged."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def truncate_text(c: Column, max_chars: int = 3 * 4096, marker: str = "\n[текст обрезан]") -> Column:
    return F.when(
        F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit(marker))
    ).otherwise(c)


def safe_partition_name(c: Column) -> Column:
    """A name usable as a sheet or folder: no special characters, 31 at most."""
    return F.substring(F.regexp_replace(c, r"[/\\?*\[\]:]", "_"), 1, 31)


def scan_date_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd.MM.yyyy HH:mm"), F.lit(""))


def role_comment(c: Column) -> Column:
    return F.concat(F.lit("Роль: "), F.nullif(c, F.lit("")))


def set_is_subset(words: Column, allowed: Iterable[str]) -> Column:
    """Word array is not empty and lies inside a fixed set."""
    allowed_array = F.split(F.lit(",".join(allowed)), ",")
    return (F.size(words) > 0) & (F.size(F.array_except(words, allowed_array)) == 0)


def sets_overlap(words: Column, other: Iterable[str]) -> Column:
    return F.arrays_overlap(words, F.split(F.lit(",".join(other)), ","))
