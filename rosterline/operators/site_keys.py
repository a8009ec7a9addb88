"""Which site of a list a page belongs to: longest-prefix join on host and path."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.text import empty_to_null, let
from rosterline.functions.urls import normalize_url, url_host, url_path
from rosterline.operators.skew import computed_once, exploded, first_by, spread_join


def site_key(url: Column) -> Column:
    """host/path of a URL: lower-case host without user, `www.`, the usual ports
    and a closing dot; path without its closing slashes; no query or fragment."""

    def key(full: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(url_host(full), r"^[^@]*@", ""), r"\.?(?::(?:80|443)?)?$", "")
        return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(url_path(full), r"/+$", ""))

    return let(normalize_url(url), key)


def key_prefixes(key: Column, depth: int) -> Column:
    """The host, and host with path, cut behind each of its first parts: at most `depth` of them."""
    return let(
        F.split(key, "/"),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.array_join(F.slice(parts, 1, i), "/")
        ),
    )


def match_sites(rows: DataFrame, sites: DataFrame, page: str, site: str) -> DataFrame:
    """(page, site) pairs of `rows` with their listed site: listed_url, listed_ord, site_company, site_inn.

    The listed site is the one whose host and path are the longest prefix of the
    page's URL, by whole path parts; if none is, of the URL the page was reached
    from.  Of equal sites in the list the first counts.  Pairs without a listed
    site are left out.

    Only distinct pairs are looked up.  Each gives one key per path part, never
    more than the deepest listed site has, and meets the list in an equi join with
    the hot hosts spread.
    """
    keyed = sites.withColumn("_key", site_key(F.col("url"))).filter("_key is not null and _key <> ''")
    listed = first_by(keyed, [F.col("_key")], ["site_ord"]).select(
        "_key", F.col("url").alias("listed_url"), F.col("site_ord").alias("listed_ord"),
        empty_to_null(F.col("company_name")).alias("site_company"), empty_to_null(F.col("inn")).alias("site_inn"),
    )
    depth = listed.agg(F.max(F.size(F.split("_key", "/")))).first()[0] or 1
    pairs = rows.select(F.col(page).alias("_page"), F.col(site).alias("_site")).distinct()

    keyed_pairs = computed_once(pairs, {"_keys": F.array(site_key(F.col("_site")), site_key(F.col("_page")))})
    ranked = exploded(keyed_pairs, ["_page", "_site"], F.col("_keys"), "_rank", "_whole").filter("_whole is not null")
    asked = exploded(ranked, ["_page", "_site", "_rank"], key_prefixes(F.col("_whole"), depth), "_depth", "_key").drop("_depth")
    hits = spread_join(asked, listed, ["_key"], "inner", ["_page", "_site"])
    entry = F.struct("listed_url", "listed_ord", "site_company", "site_inn")
    best = hits.groupBy("_page", "_site").agg(F.max_by(entry, F.struct("_rank", F.length("_key"))).alias("_entry"))
    return best.select(F.col("_page").alias(page), F.col("_site").alias(site), "_entry.*")


def join_sites(rows: DataFrame, sites: DataFrame, how: str, page: str, site: str, spread: list[str]) -> DataFrame:
    """`rows` with the columns of their listed site; `how` is left or inner."""
    found = match_sites(rows, sites, page, site).withColumnsRenamed({page: "_page", site: "_site"})
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    keyed = found.select(
        empty("_page").alias("_p"), empty("_site").alias("_s"), "listed_url", "listed_ord", "site_company", "site_inn"
    ).dropDuplicates(["_p", "_s"])
    joined = spread_join(rows.withColumns({"_p": empty(page), "_s": empty(site)}), keyed, ["_p", "_s"], how, spread)
    return joined.drop("_p", "_s")
