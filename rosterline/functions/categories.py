"""Position -> category."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions.text import collapse_ws, empty_to_null, let, lookup


def contact_position(normalized: Column, raw: Column) -> Column:
    return F.coalesce(empty_to_null(normalized), raw)


def crm_category(position: Column) -> Column:
    """Exact variant first, then the first rule that matches, else the default."""
    return let(F.coalesce(collapse_ws(F.lower(position)), F.lit("")), _category)


def _category(text: Column) -> Column:
    exact = {v: category for category, variants in vocab.CATEGORY_VARIANTS.items() for v in variants}
    by_rule = F.when(text == "", vocab.DEFAULT_CATEGORY)
    for category, pattern in vocab.CATEGORY_RULES:
        by_rule = by_rule.when(text.rlike("(?U)" + pattern), category)
    return F.coalesce(lookup(text, exact), by_rule.otherwise(vocab.DEFAULT_CATEGORY))


def ui_category(normalized: Column, raw: Column) -> Column:
    """Five coarse groups."""
    return let(F.lower(F.coalesce(normalized, raw, F.lit(""))), _ui_category)


def _ui_category(text: Column) -> Column:
    return (
        F.when(text.contains("директор") & ~text.rlike("финанс|hr|кадр"), "director")
        .when(text.rlike("юрист|юридич|правов"), "lawyer")
        .when(text.rlike("финанс|бухгалт|cfo"), "cfo")
        .when(text.rlike("hr|кадр|персонал|рекрут"), "hr")
        .otherwise("other")
    )
