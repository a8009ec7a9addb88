"""The whole way from pages to the clean contact table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.functions.urls import normalize_url
from rosterline.operators.blocklist import block_domains
from rosterline.operators.dedup import dedup_merge, dedup_name_email_phone, normalize_final
from rosterline.operators.enrich import (
    apply_corrections, fill_from_page_text, input_company_wins, propagate_site_fields,
)
from rosterline.operators.extraction import extract_contacts
from rosterline.operators.pages import cap_pages_per_site, drop_captcha_pages, drop_failed_fetches, robots_filter
from rosterline.operators.site_keys import join_sites
from rosterline.operators.skew import first_by
from rosterline.session import cut_lineage

#: Page keys that are broadcast at most, about 200 bytes each.
FEW_PAGES = 100_000


def pages_to_read(
    pages: DataFrame, sites: DataFrame, blocklist: DataFrame | None = None, robots: DataFrame | None = None, page_limit: int | None = None
) -> DataFrame:
    """Keys of the pages that count, with their listed site; reads no html.

    Pages of unlisted or blocked sites go, then failed fetches (if `pages` has a
    status), pages that robots rules forbid, all but the first page of a URL, and
    pages over `page_limit` of a site, in the order of the crawl.
    """
    status = ["status"] if "status" in pages.columns else []
    keys = pages.select("site_url", "page_ord", "page_url", *status)
    keys = join_sites(keys, sites, "inner", "page_url", "site_url", ["page_ord"]).withColumnRenamed("site_url", "found_site")
    keys = keys.withColumnRenamed("listed_url", "site_url")
    if status:
        keys = drop_failed_fetches(keys)
    if blocklist is not None:
        keys = block_domains(keys, "site_url", blocklist, ["page_ord"])
    if robots is not None:
        keys = robots_filter(keys, robots)
    keys = first_by(keys.withColumn("_url", normalize_url(F.col("page_url"))), [F.col("site_url"), F.col("_url")], ["page_ord"])
    if page_limit is not None:
        keys = cap_pages_per_site(keys, ["page_ord"], page_limit)
    return keys.select(F.col("found_site").alias("site_url"), "page_ord", F.col("site_url").alias("listed_url"), "site_company", "site_inn")


def contact_table(
    pages: DataFrame,
    sites: DataFrame,
    blocklist: DataFrame | None = None,
    corrections: DataFrame | None = None,
    page_texts: DataFrame | None = None,
    targets: list[str] | None = None,
    robots: DataFrame | None = None,
    page_limit: int | None = None,
) -> DataFrame:
    """Clean contacts of all listed sites; site_url is the URL of the list.

    Which pages count is decided on their keys, a scan without html, and kept.  The
    html is read once, where contacts are extracted, and never shuffled: up to
    FEW_PAGES keys are broadcast and other pages are not parsed; beyond that pages
    are parsed first and only narrow contact rows meet the keys.  A repeated URL does
    not come in because its first page was challenged.  The merged rows are
    checkpointed: the steps after them read the contacts twice (site values and
    rows), and without the cut every page would be parsed twice.
    """
    kept = cut_lineage(pages_to_read(pages, sites, blocklist, robots, page_limit))
    if kept.limit(FEW_PAGES + 1).count() <= FEW_PAGES:
        kept = F.broadcast(kept)
        pages = pages.join(kept.select("site_url", "page_ord"), ["site_url", "page_ord"], "left_semi")
    contacts = extract_contacts(drop_captcha_pages(pages), targets)
    listed = contacts.join(kept, ["site_url", "page_ord"]).withColumn("site_url", F.col("listed_url"))
    contacts = dedup_name_email_phone(input_company_wins(listed).select(contacts.columns))
    contacts = cut_lineage(dedup_merge(normalize_final(contacts)))
    if corrections is not None:
        contacts = apply_corrections(contacts, corrections)
    if page_texts is not None:
        contacts = fill_from_page_text(contacts, page_texts)
    return propagate_site_fields(contacts)
