"""Site level joins: defaults from the site list, propagation, page texts,
correction tables, and the comparison with a gold table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.entities import labelled_inn, labelled_kpp
from rosterline.functions.fields import strict_inn
from rosterline.functions.text import empty_to_null, strip_ws
from rosterline.operators.site_keys import join_sites
from rosterline.operators.skew import earliest, running_before, spread_join
from rosterline.schemas import CONTACT_ORDER


def _fill(column: str, source: Column) -> Column:
    """The column, or `source` where it is empty; an empty text without a
    source stays as it is."""
    return F.coalesce(empty_to_null(F.col(column)), source, F.col(column))


def site_defaults(contacts: DataFrame, sites: DataFrame) -> DataFrame:
    """Left join with the site list, by the longest listed host and path that the
    contact's page lies under: adds site_company and site_inn."""
    return join_sites(contacts, sites, "left", "source_url", "site_url", CONTACT_ORDER).drop("listed_url", "listed_ord")


def input_company_wins(joined: DataFrame) -> DataFrame:
    """The site list wins over the page: company always, INN where given.  A
    company found on the page with less than three letters becomes empty."""
    found = F.coalesce(F.col("company_name"), F.lit(""))
    company = F.coalesce(F.col("site_company"), F.when(F.length(found) >= 3, found).otherwise(""))
    return joined.withColumns({
        "company_name": company,
        "inn": strict_inn(F.coalesce(F.col("site_inn"), F.col("inn"))),
    })


def apply_input_company(contacts: DataFrame, sites: DataFrame) -> DataFrame:
    """Company and INN of the listed site on every contact; contacts of unlisted sites stay as found."""
    return input_company_wins(site_defaults(contacts, sites)).select(contacts.columns)


def _propagate(contacts: DataFrame, fields: list[str]) -> DataFrame:
    ready = contacts.withColumns({c: empty_to_null(F.col(c)) for c in fields})
    per_site = ready.groupBy("site_url").agg(
        *[earliest(c, CONTACT_ORDER).alias(f"_site_{c}") for c in fields]
    )
    joined = spread_join(ready, per_site, ["site_url"], "left", CONTACT_ORDER)
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_site_{c}")) for c in fields}).select(contacts.columns)


def propagate_inn_kpp(contacts: DataFrame) -> DataFrame:
    """The first identifier known on a site fills the empty ones."""
    return _propagate(contacts, ["inn", "kpp"])


def propagate_company_email(contacts: DataFrame) -> DataFrame:
    return _propagate(contacts, ["company_email"])


def propagate_site_fields(contacts: DataFrame) -> DataFrame:
    """Both propagations over one aggregate and one join."""
    return _propagate(contacts, ["inn", "kpp", "company_email"])


def _host_of_site(site_url: Column) -> Column:
    """What stands between the scheme and the first slash."""
    return F.regexp_extract(site_url, r"^(?:.*//)?([^/]*)", 1)


def fill_from_page_text(contacts: DataFrame, page_texts: DataFrame) -> DataFrame:
    """Labelled identifiers in the texts of a site's pages (first in page order)
    fill contacts of sites where no contact has one.

    The reading "page URL contains the host" is an equi join on the host.
    """
    found = page_texts.select(
        _host_of_site(F.col("page_url")).alias("_host"), "page_ord",
        labelled_inn(F.col("text")).alias("_inn"), labelled_kpp(F.col("text")).alias("_kpp"),
    ).filter("_inn is not null or _kpp is not null")
    by_host = found.groupBy("_host").agg(
        earliest("_inn", ["page_ord"]).alias("_inn"), earliest("_kpp", ["page_ord"]).alias("_kpp")
    )
    own = contacts.groupBy("site_url").agg(
        F.max(empty_to_null(F.col("inn")).isNotNull()).alias("_has_inn"),
        F.max(empty_to_null(F.col("kpp")).isNotNull()).alias("_has_kpp"),
    )
    per_site = (
        own.withColumn("_host", _host_of_site(F.col("site_url")))
        .join(by_host, "_host")
        .select(
            "site_url",
            F.when(~F.col("_has_inn"), F.col("_inn")).alias("_inn"),
            F.when(~F.col("_has_kpp"), F.col("_kpp")).alias("_kpp"),
        )
    )
    joined = spread_join(contacts, per_site, ["site_url"], "left", CONTACT_ORDER)
    return joined.withColumns(
        {"inn": _fill("inn", F.col("_inn")), "kpp": _fill("kpp", F.col("_kpp"))}
    ).select(contacts.columns)


def contact_index(contacts: DataFrame, pages_per_block: int = 1000) -> DataFrame:
    """1-based number of a contact within its site, in contact order."""
    block = F.floor(F.col("page_ord") / pages_per_block)
    numbered = running_before(contacts, ["site_url"], CONTACT_ORDER, F.lit(1), block, "_before")
    return numbered.withColumn("idx", (F.col("_before") + 1).cast("long")).drop("_before")


def apply_corrections(contacts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Apply a table of corrections keyed by site and contact number.

    No correction: the contact stays.  A correction without a name removes it.
    Other fields overwrite, except company_email and position_raw, which only
    fill empty ones.
    """
    fixes = corrections.select(
        "site_url", "idx", F.lit(True).alias("_fixed"),
        *[F.col(c).alias(f"_{c}") for c in ("company_name", "full_name", "position", "personal_email", "company_email", "phone")],
    )
    joined = contact_index(contacts).join(fixes, ["site_url", "idx"], "left")
    kept = joined.filter(F.col("_fixed").isNull() | F.col("_full_name").isNotNull())

    def overwrite(column: str, source: str) -> Column:
        return F.coalesce(empty_to_null(F.col(source)), F.col(column))

    return kept.withColumns({
        "company_name": overwrite("company_name", "_company_name"),
        "full_name": overwrite("full_name", "_full_name"),
        "position_normalized": overwrite("position_normalized", "_position"),
        "position_raw": _fill("position_raw", empty_to_null(F.col("_position"))),
        "personal_email": overwrite("personal_email", "_personal_email"),
        "company_email": _fill("company_email", empty_to_null(F.col("_company_email"))),
        "phone": overwrite("phone", "_phone"),
    }).select(contacts.columns)


def contacts_vs_gold(contacts: DataFrame, gold: DataFrame) -> DataFrame:
    """Full join on site and name: which contacts are right, spurious, missed."""
    def keyed(df: DataFrame, flag: str) -> DataFrame:
        return df.select("site_url", F.lower(strip_ws(F.col("full_name"))).alias("name")).distinct().withColumn(flag, F.lit(True))

    both = keyed(contacts, "_found").join(keyed(gold, "_true"), ["site_url", "name"], "full")
    return both.select(
        "site_url", "name",
        F.coalesce("_found", F.lit(False)).alias("found"), F.coalesce("_true", F.lit(False)).alias("in_gold"),
    )


def precision_recall(contacts: DataFrame, gold: DataFrame) -> DataFrame:
    compared = contacts_vs_gold(contacts, gold)
    totals = compared.agg(
        F.count_if(F.col("found") & F.col("in_gold")).alias("n_right"),
        F.count_if("found").alias("n_found"),
        F.count_if("in_gold").alias("n_gold"),
    )
    return totals.select(
        "n_right", "n_found", "n_gold",
        F.round(F.try_divide("n_right", "n_found"), 6).alias("precision"),
        F.round(F.try_divide("n_right", "n_gold"), 6).alias("recall"),
    )
