"""Connected components of a link table: a distributed union-find by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every linked node with the smallest node it can reach: (node, component).

    Alternates two steps until nothing changes.  Large star: all larger
    neighbours of a node point to the smallest node near it.  Small star: the
    smaller neighbours and the node itself do.  Both are an aggregate (combined
    before the shuffle) and a join, the number of links never grows beyond the
    nodes plus the links, and a chain of n nodes takes about log(n) rounds.
    Every round is written to shared storage.  Null nodes and self links are
    ignored; no links give no rows.
    """
    two = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b")
    edges = stored(two.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select("u", "v"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).filter("u != v").distinct()
        root = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(root, "v").filter("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = stored(moved.union(root.select("v", F.col("m").alias("u"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    found = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
