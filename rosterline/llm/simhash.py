"""Op 4: SimHash fingerprints linked by vantage-point trees."""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import documents, one_key, query, stored
from rosterline.llm.components import components

RADIUS = 4
#: Fingerprints that the trees are fitted on: those with the smallest hashes.
SAMPLE = 32768
#: Fingerprints that one leaf, and one comparison task group, should hold.
LEAF = 512
BLOCK = 2048
#: Texts that a worker holds as Python strings.
AT_ONCE = 256


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included.

    A bit is set if it is set in over half of the XXH64 (seed 42) hashes of the
    space-joined shingles; fewer words than `width` make one shingle, none give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    hashes = np.fromiter(
        (digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[width - 1:].tolist())), dtype=np.uint64, count=n
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with the fingerprint `fp` of its texts as a signed long."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts), dtype=np.uint64)
        for at in range(0, len(texts), AT_ONCE):
            part = texts.slice(at, AT_ONCE).to_pylist()
            out[at:at + len(part)] = [fingerprint(t) for t in part]
        return pa.array(out.view(np.int64))

    return docs.withColumn("fp", fingerprints(F.col(text)))


def masks(radius: int = RADIUS, kept: int = 2) -> list[int]:
    """Bit masks such that two fingerprints within `radius` agree wholly on one of them.

    64 bits in radius + kept blocks: at least `kept` blocks are untouched by
    `radius` differing bits, so some union of `kept` blocks is.
    """
    edges = np.linspace(0, 64, radius + kept + 1).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:])]
    return [sum(group) for group in combinations(blocks, kept)]


class Tree:
    """A vantage-point tree over the fingerprints of a sample, under the Hamming
    distance of the bits in `mask`.  Node i has children 2i+1 (inside) and 2i+2."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int):
        self.mask, self.depth = np.uint64(mask), depth
        self.vantage = np.zeros((1 << depth) - 1, dtype=np.uint64)
        self.radius = np.full((1 << depth) - 1, -1, dtype=np.int64)
        parts = {0: sample & self.mask}
        for node in range(len(self.vantage)):
            points = parts.pop(node, sample[:0])
            if len(points) == 0:
                continue
            # the candidate whose median splits the points most evenly
            tries = points[:: max(1, len(points) // 8)][:8]
            best = None
            for v in tries:
                d = np.bitwise_count(points ^ v).astype(np.int64)
                cut = int(np.sort(d)[(len(d) - 1) // 2])
                for c in (cut, cut - 1):
                    off = abs(2 * int((d <= c).sum()) - len(d))
                    if best is None or off < best[0]:
                        best = (off, v, c, d <= c)
            _, self.vantage[node], self.radius[node], inside = best
            if 2 * node + 2 < len(self.vantage):
                parts[2 * node + 1], parts[2 * node + 2] = points[inside], points[~inside]

    def leaves(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a ball of `reach` around a row meets.

        Triangle bounds: the inside of a node can hold a point within `reach`
        only if distance - reach <= radius, the outside only if distance + reach > radius.
        """
        rows, nodes, masked = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), fps & self.mask
        for _ in range(self.depth):
            d = np.bitwise_count(masked[rows] ^ self.vantage[nodes]).astype(np.int64)
            inner, outer = d - reach <= self.radius[nodes], d + reach > self.radius[nodes]
            rows, nodes = np.concatenate((rows[inner], rows[outer])), np.concatenate((2 * nodes[inner] + 1, 2 * nodes[outer] + 2))
        return rows, nodes - ((1 << self.depth) - 1)


def forest(left: np.ndarray, right: np.ndarray, same: bool) -> list:
    """Links that connect exactly what the pairs within RADIUS of left x right
    connect, fewer than one per fingerprint.  `same`: both sides are one list."""
    pairs: list = []
    both = np.concatenate((left, right))
    label = np.tile(np.arange(len(left)), 2) if same else np.arange(len(both))
    for i, fp in enumerate(left):
        near = np.flatnonzero(np.bitwise_count(right ^ fp) <= RADIUS) + len(left)
        if len(near) == 0:
            continue
        roots, first = np.unique(label[near], return_index=True)
        fresh = roots != label[i]
        if not fresh.any():
            continue
        pairs.extend((fp, both[near[k]]) for k in first[fresh])
        label[np.isin(label, roots[fresh])] = label[i]
    return pairs


def fingerprint_links(fps: DataFrame, reach: int = 0, kept: int = 2) -> DataFrame:
    """Links (a, b) that connect all fingerprints within RADIUS of each other.

    `fps` has distinct longs `fp`.  One tree per mask is fitted on a bounded
    sample; every fingerprint goes to each leaf that its ball meets, as a pair
    within RADIUS shares a leaf of the tree whose mask it agrees on.  A leaf with
    over BLOCK fingerprints is cut by the masked bits, which lose no pair, and a
    single masked value with over BLOCK fingerprints into pairs of blocks.
    """
    spark = fps.sparkSession
    n = fps.count()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    depth = int(np.clip(np.ceil(np.log2(max(1, n / LEAF))), 0, np.log2(SAMPLE / 8)))
    trees = [Tree(sample, m, depth) for m in masks(RADIUS, kept)]

    def route(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for number, tree in enumerate(trees):
                rows, leaf = tree.leaves(fp, reach)
                got = fp[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got.view(np.int64)), pa.array((np.int64(number) << 32) + leaf), pa.array((got & tree.mask).view(np.int64))],
                    names=["fp", "leaf", "masked"],
                )

    routed = stored(fps.select("fp").mapInArrow(route, "fp long, leaf long, masked long"))
    if reach:
        routed = routed.withColumn("masked", F.lit(0).cast("long"))
    sizes = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    cut = F.pmod(F.xxhash64("masked"), F.ceil(F.col("n") / BLOCK)).cast("int")
    parts = routed.join(sizes, "leaf").select("fp", "leaf", cut.alias("part"))
    counts = parts.groupBy("leaf", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("blocks")).cast("int")
    dealt = (
        parts.join(counts.filter("blocks > 0"), ["leaf", "part"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("fp", "leaf", "part", "mine", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, mine = group["fp"].to_numpy().view(np.uint64), group["mine"].to_numpy()
        one, two = int(group["one"].iloc[0]), int(group["two"].iloc[0])
        pairs = forest(fp[mine == one], fp[mine == two], one == two)
        out = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    found = dealt.groupBy("leaf", "part", "one", "two").applyInPandas(compare, "a long, b long")
    return found.filter("a != b")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the smallest doc_id reached by links of RADIUS or fewer
    differing bits.  Equal fingerprints are folded before anything is compared,
    so exact copies cost nothing.  Null and empty texts have fingerprint zero and
    link like any other; a null doc_id is never a component's smallest unless all
    are null; repeated rows stay; other columns are ignored; an empty table gives
    an empty table.
    """
    rows = stored(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    return label_rows(rows).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def label_rows(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp, ...) with component_id."""
    first = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = stored(fingerprint_links(first.select("fp")))
    member = components(links)
    linked = first.join(member, first["fp"] == member["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("class")
    )
    smallest = linked.groupBy("class").agg(F.min("first_id").alias("component_id"))
    return rows.join(linked.join(smallest, "class").select("fp", "component_id"), "fp")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of every component (smallest doc_id, then smallest row hash), columns unchanged.

    Fingerprints are stored beside a row's id and hash only, and whole rows are
    dealt out once: rows alike in both are folded, then those to keep are picked.
    """
    whole = docs.select(
        F.struct("*").alias("row"), one_key(F.col("doc_id")).alias("__id"), F.xxhash64(F.lit(0), *docs.columns).alias("__rh")
    )
    texts = whole.select(F.col("row.doc_id").alias("doc_id"), "__rh", F.col("row.text").alias("text"))
    labelled = label_rows(stored(with_fingerprint(texts).drop("text")))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "__rh")
    best = labelled.groupBy("component_id").agg(F.min(place).alias("m"))
    best = best.select(one_key(F.col("m.doc_id")).alias("__id"), F.col("m.__rh").alias("__rh"))
    return whole.dropDuplicates(["__id", "__rh"]).join(best, ["__id", "__rh"], "left_semi").select("row.*")


@query
def op4_simhash_vantage_trees(spark, sf_dir):
    return near_components(documents(spark, sf_dir))
