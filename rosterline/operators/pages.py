"""Page level operators: which pages are kept, and the links between them."""

import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.functions.html import contact_links, has_captcha, page_links
from rosterline.functions.text import strip_ws
from rosterline.functions.urls import normalize_url, url_host, url_path
from rosterline.operators.skew import exploded, first_by, running_before, spread_join
from rosterline.session import checkpoint_root, cut_lineage

#: Pages of a walk that are broadcast at most, about 200 bytes each.
FEW_PAGES = 100_000


def drop_captcha_pages(pages: DataFrame, head_chars: int = 5000) -> DataFrame:
    """Pages without a challenge marker in their first `head_chars` characters."""
    return pages.filter(~has_captcha(F.col("html"), head_chars))


def drop_failed_fetches(pages: DataFrame) -> DataFrame:
    """No page without a response, nor for 403, 404, 429 and 5xx."""
    status = F.col("status")
    return pages.filter(status.isNotNull() & ~status.isin(403, 404, 429) & (status < 500))


def first_pages(keys: DataFrame) -> DataFrame:
    """(site_url, page_ord) of the first page of every site and normalised URL; reads no html."""
    named = keys.select("site_url", "page_ord", normalize_url(F.col("page_url")).alias("_url"))
    return named.groupBy("site_url", "_url").agg(F.min("page_ord").alias("page_ord")).select("site_url", "page_ord")


def dedup_pages(pages: DataFrame) -> DataFrame:
    """Keys of one page per site and normalised URL, the first by page_ord: all columns but the html.

    The html stays where it is: a reader joins these keys, which are narrow, with
    what it made of the pages (see plans/contacts.py).
    """
    keys = pages.drop("html")
    return keys.join(first_pages(keys), ["site_url", "page_ord"], "left_semi")


def explode_links(pages: DataFrame) -> DataFrame:
    """All internal links of all pages, one row each."""
    found = page_links(F.col("html"), F.col("page_url"))
    links = exploded(pages, ["site_url", "page_ord"], found, "_place", "l")
    return links.select("site_url", "page_ord", "l.*")


def rank_contact_links(pages: DataFrame) -> DataFrame:
    """Distinct relevant links of each page, shortest URL first."""
    urls = contact_links(page_links(F.col("html"), F.col("page_url")))
    ranked = exploded(pages, ["site_url", "page_ord"], urls, "link_rank", "url")
    return ranked.withColumn("link_rank", F.col("link_rank").cast("long"))


def cap_pages_per_site(candidates: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first `limit` pages of every site.  Spark limits each task's share of a site
    before the shuffle, so a hot site stays small."""
    place = F.row_number().over(Window.partitionBy("site_url").orderBy(*order))
    return candidates.withColumn("page_rank", place.cast("long")).filter(F.col("page_rank") <= limit)


def expand_link_frontier(pages: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages reached from the start pages over contact links, breadth first:
    site_url, url, page_ord, depth and visit (from 0, the order in which a queue
    would have come to them).

    A page of the next level is placed by the visit number of the page that led to
    it and the link's place there; those pairs are ranked per site with
    running_before, so a level of any size needs no path and no single task.  A hop
    writes its new pages only, to a folder of its own beside the earlier ones.  The
    loop ends when no site gains a page.  With a limit a site keeps its first
    `limit` pages, which takes at most that many hops.

    Spark takes a stored table for as large as its files are, and would broadcast
    levels that are many times that in memory.  So rows are counted: more than
    FEW_PAGES are sorted and merged, and links are laid out for the pages of the last
    level only.  A page carries the visit number that comes next in its site.
    """
    spark = pages.sparkSession
    stored = pages.select(
        "site_url", "page_ord", normalize_url(F.col("page_url")).alias("url"),
        contact_links(page_links(F.col("html"), F.col("page_url"))).alias("links"),
    )
    stored = cut_lineage(first_by(stored, [F.col("site_url"), F.col("url")], ["page_ord"]))
    links = stored.select("site_url", "url", "links")
    known = _merged_if_many(stored.select("site_url", "url", "page_ord"), stored.count())
    root = f"{checkpoint_root(spark)}/frontier-{uuid.uuid4().hex}"
    schema = f"site_url string, url string, page_ord {dict(pages.dtypes)['page_ord']}, depth long, visit long"

    def write(found: DataFrame, depth: int) -> DataFrame:
        """The new pages of a hop, numbered behind those of their site so far."""
        placed = running_before(found, ["site_url"], ["parent", "rank"], F.lit(1), None, "place", "gained")
        placed = placed.withColumn("visit", (F.col("base") + F.col("place")).cast("long"))
        if limit is not None:
            placed = placed.filter(F.col("visit") < limit)
        rows = placed.select(
            "site_url", "url", "page_ord", F.lit(depth).cast("long").alias("depth"), "visit",
            (F.col("base") + F.col("gained")).cast("long").alias("next"),
        )
        rows.write.parquet(f"{root}/hop={depth}")
        return spark.read.schema(f"{schema}, next long").parquet(f"{root}/hop={depth}")

    first = starts.select("site_url", normalize_url(F.col("url")).alias("url")).distinct()
    zero = F.lit(0).cast("long")
    first = first.join(known, ["site_url", "url"]).withColumns({"parent": zero, "rank": F.col("page_ord"), "base": zero})
    frontier, n_visited = write(first, 0), 0
    for depth in count(1) if limit is None else range(1, limit):
        n = frontier.count()
        if n == 0:
            break
        n_visited += n
        visited = _merged_if_many(spark.read.schema(schema).parquet(root).select("site_url", "url"), n_visited)
        leading = frontier.select("site_url", "url", F.col("visit").alias("parent"), F.col("next").alias("base"))
        leading = F.broadcast(leading) if n <= FEW_PAGES else leading.hint("merge")
        reached = (
            leading.join(links, ["site_url", "url"])
            .select("site_url", "parent", "base", F.posexplode("links").alias("rank", "url"))
            .groupBy("site_url", "url")
            .agg(F.min(F.struct("parent", "rank")).alias("by"), F.min("base").alias("base"))
            .join(visited, ["site_url", "url"], "left_anti")
            .join(known, ["site_url", "url"])
            .select("site_url", "url", "page_ord", "by.parent", "by.rank", "base")
        )
        frontier = write(reached, depth)
    return spark.read.schema(schema).parquet(root)


def _merged_if_many(rows: DataFrame, n: int) -> DataFrame:
    """A side of a join that is not broadcast if it has more than FEW_PAGES rows."""
    return rows if n <= FEW_PAGES else rows.hint("merge")


def robots_rules(content: Column, agents: tuple[str, ...] = ("*", "rosterline")) -> Column:
    """Disallow prefixes of a robots file that apply to these agents.

    A fold over the lines of one file: the last user-agent line decides."""
    lines = F.transform(F.split(content, r"\r\n|\r|\n"), strip_ws)
    start = F.struct(F.lit(False).alias("applies"), F.array().cast("array<string>").alias("rules"))

    def step(acc: Column, line: Column) -> Column:
        key = F.lower(strip_ws(F.split_part(line, F.lit(":"), F.lit(1))))
        value = strip_ws(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
        parsed = F.contains(line, F.lit(":")) & ~F.startswith(line, F.lit("#"))
        applies = F.when(parsed & (key == "user-agent"), value.isin(*agents)).otherwise(acc.applies)
        adds = parsed & (key == "disallow") & acc.applies & (value != "")
        rules = F.when(adds, F.array_append(acc.rules, value)).otherwise(acc.rules)
        return F.struct(applies.alias("applies"), rules.alias("rules"))

    return F.aggregate(lines, start, step, lambda acc: acc.rules)


def robots_filter(pages: DataFrame, robots: DataFrame, agents: tuple[str, ...] = ("*", "rosterline")) -> DataFrame:
    """Keys of the pages whose path no rule of their host forbids; no rules, no limit.

    `robots` holds one file per host: columns host and content.  All columns but
    the html are kept, so no html is shuffled (see dedup_pages)."""
    rules = robots.select(F.lower("host").alias("_host"), robots_rules(F.col("content"), agents).alias("_rules"))
    hosted = pages.drop("html").withColumn("_host", url_host(F.col("page_url")))
    joined = spread_join(hosted, rules, ["_host"], "left", ["page_ord", "page_url"])
    path = F.when(url_path(F.col("page_url")) == "", F.lit("/")).otherwise(url_path(F.col("page_url")))
    forbidden = F.exists("_rules", lambda r: F.startswith(path, r))
    return joined.filter(~F.coalesce(forbidden, F.lit(False))).drop("_host", "_rules")
