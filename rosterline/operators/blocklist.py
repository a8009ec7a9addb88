"""Opt-out lists: classify entries, maintain the list, block by it."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions.text import strip_ws
from rosterline.functions.urls import bare_domain, domain_suffixes, site_domain, url_host
from rosterline.operators.skew import spread_join


def classify_entry(value: Column) -> Column:
    """Struct (kind, value) of an entry, or null if it is no valid entry."""
    web = value.rlike(r"(?i)^https?://")
    email = value.rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$")
    inn = value.rlike(r"^(?:\d{10}|\d{12})$")
    kind = F.when(web, "domain").when(email, "email").when(inn, "inn").otherwise("domain")
    cleaned = (
        F.when(web, bare_domain(url_host(value)))
        .when(email, F.lower(value))
        .when(inn, value)
        .otherwise(bare_domain(value))
    )
    return F.when(cleaned.isNotNull(), F.struct(kind.alias("kind"), cleaned.alias("value")))


def blocklist_from_entries(entries: DataFrame) -> DataFrame:
    """Distinct (kind, value) of raw text entries; blanks and # lines dropped."""
    value = strip_ws(F.col("entry"))
    rows = entries.filter((value != "") & ~F.startswith(value, F.lit("#")))
    # inline: a filter after it is not pushed into the classification
    kinds = rows.select(F.inline_outer(F.array(classify_entry(value))))
    return kinds.filter(F.col("kind").isNotNull()).distinct()


def blocklist_add(blocklist: DataFrame, entries: DataFrame) -> DataFrame:
    return blocklist.unionByName(blocklist_from_entries(entries)).distinct()


def blocklist_remove(blocklist: DataFrame, entries: DataFrame) -> DataFrame:
    return blocklist.join(blocklist_from_entries(entries), ["kind", "value"], "left_anti")


def new_blocklist_entries(blocklist: DataFrame, entries: DataFrame) -> DataFrame:
    """How many distinct entries were not yet present."""
    fresh = blocklist_from_entries(entries).join(blocklist, ["kind", "value"], "left_anti")
    return fresh.agg(F.count("*").alias("added"))


def blocklist_stats(blocklist: DataFrame) -> DataFrame:
    """Distinct values per kind, and the total."""
    counted = blocklist.distinct().rollup("kind").agg(F.count("*").alias("n"))
    return counted.select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


def stoplist(spark: SparkSession) -> DataFrame:
    """The fixed list of portals and social sites as a blocklist."""
    rows = [("domain", d) for d in vocab.STOPLIST_DOMAINS]
    return spark.createDataFrame(rows, "kind string, value string")


def blocked_domains(domains: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Those distinct domains that are listed, or have a listed parent.

    Works on distinct domains only: exploding parents never touches wide rows.
    """
    listed = blocklist.filter("kind = 'domain'").select(F.col("value").alias("_suffix")).distinct()
    distinct = domains.select(F.col("domain")).filter("domain is not null").distinct()
    exploded = distinct.select("domain", F.explode(domain_suffixes(F.col("domain"))).alias("_suffix"))
    # one parent may have countless subdomains, hence the spread
    return spread_join(exploded, listed, ["_suffix"], "left_semi", ["domain"]).select("domain").distinct()


def _split_by_domain(rows: DataFrame, url: str, blocklist: DataFrame, how: str, spread: list[str]) -> DataFrame:
    with_domain = rows.withColumn("domain", site_domain(F.col(url)))
    blocked = blocked_domains(with_domain, blocklist)
    return spread_join(with_domain, blocked, ["domain"], how, spread).drop("domain")


def block_domains(rows: DataFrame, url: str, blocklist: DataFrame, spread: list[str]) -> DataFrame:
    """Rows whose URL is not on a listed domain."""
    return _split_by_domain(rows, url, blocklist, "left_anti", spread)


def blocked_by_domain(rows: DataFrame, url: str, blocklist: DataFrame, spread: list[str]) -> DataFrame:
    """The reject side of block_domains."""
    return _split_by_domain(rows, url, blocklist, "left_semi", spread)


def _flag_domain(rows: DataFrame, domain: Column, blocklist: DataFrame, spread: list[str], flag: str) -> DataFrame:
    with_domain = rows.withColumn("domain", domain)
    hits = blocked_domains(with_domain, blocklist).withColumn(flag, F.lit(True))
    return spread_join(with_domain, hits, ["domain"], "left", spread).drop("domain")


def _flag_value(rows: DataFrame, value: Column, kind: str, blocklist: DataFrame, spread: list[str], flag: str) -> DataFrame:
    listed = blocklist.filter(F.col("kind") == kind).select(F.col("value").alias("_value")).distinct()
    return spread_join(
        rows.withColumn("_value", value), listed.withColumn(flag, F.lit(True)), ["_value"], "left", spread
    ).drop("_value")


def flag_blocked(
    rows: DataFrame, blocklist: DataFrame, spread: list[str],
    url: str | None = None, email: str | None = None, inn: str | None = None,
) -> DataFrame:
    """Adds a boolean `blocked`: by domain, by email (or its domain), by INN.
    Columns that are null or not given do not count."""
    flags = []
    out = rows
    if url:
        out = _flag_domain(out, site_domain(F.col(url)), blocklist, spread, "_by_url")
        flags.append("_by_url")
    if email:
        address = F.lower(strip_ws(F.col(email)))
        out = _flag_value(out, address, "email", blocklist, spread, "_by_email")
        # everything after the first at sign
        host = bare_domain(F.nullif(F.regexp_extract(address, r"^[^@]*@(.*)$", 1), F.lit("")))
        out = _flag_domain(out, host, blocklist, spread, "_by_mail_host")
        flags += ["_by_email", "_by_mail_host"]
    if inn:
        out = _flag_value(out, strip_ws(F.col(inn)), "inn", blocklist, spread, "_by_inn")
        flags.append("_by_inn")
    blocked = F.coalesce(*flags, F.lit(False)) if flags else F.lit(False)
    return out.withColumn("blocked", blocked).drop(*flags)


def block_emails(rows: DataFrame, email: str, blocklist: DataFrame, spread: list[str]) -> DataFrame:
    return flag_blocked(rows, blocklist, spread, email=email).filter(~F.col("blocked")).drop("blocked")


def block_inns(rows: DataFrame, inn: str, blocklist: DataFrame, spread: list[str]) -> DataFrame:
    return flag_blocked(rows, blocklist, spread, inn=inn).filter(~F.col("blocked")).drop("blocked")


def block_any(rows: DataFrame, blocklist: DataFrame, spread: list[str], url: str, email: str, inn: str) -> DataFrame:
    out = flag_blocked(rows, blocklist, spread, url=url, email=email, inn=inn)
    return out.filter(~F.col("blocked")).drop("blocked")
