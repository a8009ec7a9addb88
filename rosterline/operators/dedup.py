"""The three dedups, and the last validation before the merge.

All are aggregates with map-side combine, so a person copied over a third of
all rows is reduced before the shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.fields import (
    company_name_first_part, has_useful_field, is_generic_email_final, relocate_generic_email, validate_inn,
    validate_kpp,
)
from rosterline.functions.names import name_blocked, name_collapse_ws, name_valid_final
from rosterline.functions.positions import position_valid_final
from rosterline.functions.text import empty_to_null, strip_ws
from rosterline.operators.skew import computed_once, earliest, first_by
from rosterline.schemas import CONTACT_ORDER

MERGED_FIELDS = [
    "personal_email", "company_email", "phone", "inn", "kpp", "position_raw", "position_normalized",
]


def _text_key(column: str) -> Column:
    return F.lower(strip_ws(F.coalesce(F.col(column), F.lit(""))))


def _exact_key(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def dedup_name_company(contacts: DataFrame) -> DataFrame:
    """First contact per page, name and company, ignoring case."""
    keys = [F.col("site_url"), F.col("page_ord"), _text_key("full_name"), _text_key("company_name")]
    return first_by(contacts, keys, CONTACT_ORDER)


def dedup_name_email_phone(contacts: DataFrame) -> DataFrame:
    """First contact per site and exact name, email and phone."""
    keys = [F.col("site_url")] + [_exact_key(c) for c in ("full_name", "personal_email", "phone")]
    return first_by(contacts, keys, CONTACT_ORDER)


def final_reason(contacts: DataFrame) -> DataFrame:
    """Clean every field and say why a row has to go; null reason means keep."""
    name = F.col("full_name")
    raw = position_valid_final(F.col("position_raw"))
    normalized = F.when(
        raw.isNotNull(),
        F.when(position_valid_final(F.col("position_normalized")).isNotNull(), F.col("position_normalized")).otherwise(raw),
    )
    personal, company = relocate_generic_email(
        F.col("personal_email"), F.col("company_email"), is_generic_email_final(F.col("personal_email"))
    )
    cleaned = computed_once(contacts, {
        "_valid": name_valid_final(name),
        "_blocked": name_blocked(name),
        "full_name": name_collapse_ws(name),
        "company_name": company_name_first_part(F.col("company_name")),
        "position_raw": raw,
        "position_normalized": normalized,
        "personal_email": empty_to_null(personal),
        "company_email": empty_to_null(company),
        "inn": validate_inn(F.col("inn")),
        "kpp": validate_kpp(F.col("kpp")),
    })
    useful = has_useful_field(*[F.col(c) for c in ("personal_email", "phone", "position_raw", "position_normalized", "inn")])
    reason = (
        F.when(~F.col("_valid"), "name")
        .when(F.col("_blocked"), "blocked_name")
        .when(~useful, "no_field")
    )
    return cleaned.withColumn("reason", reason).select(*contacts.columns, "reason")


def normalize_final(contacts: DataFrame) -> DataFrame:
    """Rows that pass the last check, with their fields cleaned."""
    return final_reason(contacts).filter(F.col("reason").isNull()).drop("reason")


def dedup_merge(contacts: DataFrame) -> DataFrame:
    """One row per site, name and company: the first row, with each empty field
    filled on its own from the earliest later row that has it.

    Social links are not merged.
    """
    keep = [c for c in contacts.columns if c not in MERGED_FIELDS]
    ready = contacts.withColumns({c: empty_to_null(F.col(c)) for c in MERGED_FIELDS})
    merged = ready.groupBy(
        F.col("site_url").alias("_site"), _text_key("full_name").alias("_name"), _text_key("company_name").alias("_company")
    ).agg(
        F.min_by(F.struct(*keep), F.struct(*CONTACT_ORDER)).alias("_row"),
        *[earliest(c, CONTACT_ORDER).alias(c) for c in MERGED_FIELDS],
    )
    return merged.select("_row.*", *MERGED_FIELDS).select(*contacts.columns)


def normalization_report(contacts: DataFrame) -> DataFrame:
    """Rows by fate: kept, merged into another row, or removed and why."""
    checked = final_reason(contacts)
    groups = checked.groupBy(
        "reason", F.col("site_url").alias("_site"), _text_key("full_name").alias("_name"), _text_key("company_name").alias("_company")
    ).agg(F.count("*").alias("_rows"))
    fate = groups.groupBy("reason").agg(F.sum("_rows").alias("_rows"), F.count("*").alias("_groups"))
    out = F.explode(
        F.when(F.col("reason").isNotNull(), F.array(F.struct(F.col("reason").alias("outcome"), F.col("_rows").alias("n_rows"))))
        .otherwise(
            F.array(
                F.struct(F.lit("kept").alias("outcome"), F.col("_groups").alias("n_rows")),
                F.struct(F.lit("merged").alias("outcome"), (F.col("_rows") - F.col("_groups")).alias("n_rows")),
            )
        )
    )
    return fate.select(out.alias("o")).select("o.outcome", "o.n_rows").filter(F.col("n_rows") > 0)
