"""Op 11: Merkle dataset manifest with proofs by pointer jumping."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import documents, query, stored
from rosterline.operators.skew import spread_join

FAN = 3
#: Levels that one pass builds: a group holds FAN ** LEVELS consecutive nodes of a tree.
LEVELS = 7
#: Pointer targets that are broadcast at most; a target holds 64 bytes for each level passed, a few MB in all.
FEW = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields: each `-` if null, else its number of UTF-8 bytes, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[one(c) for c in fields]), 256))


def combine(digests: list[bytes]) -> bytes:
    """H of digests as hex text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stored rows with a gapless number from 0 in the order of `order`, nulls first.

    Rows are dealt into ranges of the order and sorted there; the number is a
    row's place in its range plus the sizes of the ranges before it, one count per
    range.  Rows equal in `order` must be interchangeable.
    """
    tie = df.withColumn("__tie", F.monotonically_increasing_id())  # else equal rows would all be one range
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tie.repartitionByRange(ranges, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = stored(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    sizes = sorted(map(tuple, placed.groupBy(part.alias("p")).count().collect()))
    ahead, total = {}, 0
    for p, n in sizes:
        ahead[p] = total
        total += n
    if not ahead:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__at")
    before = F.get(F.lit(np.array([ahead.get(i, 0) for i in range(max(ahead) + 1)], dtype=np.int64)), part)
    return placed.withColumn(name, before + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """All nodes of all trees: (tree, level, idx, digest, seg).

    `leaves` has tree, idx (gapless from 0), n (leaves of the tree) and digest.
    seg holds the digests of the other nodes of the run, left to right, one behind
    the other; it is null for a tree's top.  A pass builds LEVELS levels of
    FAN ** LEVELS consecutive nodes in one group, so a tree of any size is spread
    over many groups, and the next pass works on a two-thousandth of the nodes.
    """
    schema = "tree long, level int, idx long, n long, digest binary, seg binary, top boolean"

    def build(level: int):
        def one(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values("idx")
            tree, n = int(block["tree"].iloc[0]), int(block["n"].iloc[0])
            digests, idx, out = list(block["digest"]), int(block["idx"].iloc[0]), []
            for step in range(LEVELS + 1):
                width = -(-n // FAN ** (level + step))
                if step == LEVELS or width == 1:
                    out.append((tree, level + step, idx, n, digests[0], None, width == 1))
                    break
                for i, digest in enumerate(digests):
                    run = i - i % FAN
                    seg = b"".join(d for j, d in enumerate(digests[run:run + FAN], run) if j != i)
                    out.append((tree, level + step, idx + i, n, digest, seg, False))
                digests = [combine(digests[i:i + FAN]) for i in range(0, len(digests), FAN)]
                idx //= FAN
            return pd.DataFrame(out, columns=["tree", "level", "idx", "n", "digest", "seg", "top"])

        return one

    level, made, todo = 0, [], leaves.select("tree", "idx", "n", "digest")
    while True:
        blocks = todo.groupBy("tree", F.floor(F.col("idx") / FAN**LEVELS).alias("block"))
        nodes = stored(blocks.applyInPandas(build(level), schema))
        made.append(nodes.filter("seg is not null or top").select("tree", "level", "idx", "digest", "seg"))
        todo = nodes.filter("seg is null and not top").select("tree", "idx", "n", "digest")
        level += LEVELS
        if todo.isEmpty():
            break
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out


def jumped(nodes: DataFrame) -> DataFrame:
    """Every leaf of a source tree with its path: (tree, idx, digest, path), path holding all siblings up to the root.

    nodes: (tree, level, idx, digest, seg, ptree, plevel, pidx); the root has no
    pointer.  In round k a node's pointer is 2^k levels above it and seg holds the
    siblings on the way; a self-join puts the pointer's own pointer and segment in
    its place.  At most FAN^(2^k) nodes point at one node, so no target is hot
    unless there are few targets, and those are broadcast after a count.  Nodes
    that have reached the root are set aside, as are inner nodes that no pointer
    needs any more.
    """
    done, reach = [], 1
    columns = ["tree", "level", "idx", "digest", "seg"]
    pointer = ["ptree", "plevel", "pidx"]
    going = nodes
    while True:
        # a node that is less than `reach` levels above every leaf of its tree is not pointed at any more
        targets = going.filter((F.col("tree") < 0) | (F.col("level") >= reach)).select(
            F.col("tree").alias("ptree"), F.col("level").alias("plevel"), F.col("idx").alias("pidx"),
            F.col("seg").alias("__seg"), *[F.col(c).alias(f"__{c}") for c in pointer],
        )
        leaves = (F.col("tree") >= 0) & (F.col("level") == 0)
        kept = going.filter(leaves | (F.col("tree") < 0) | (F.col("level") >= 2 * reach))
        done.append(kept.filter(F.col("ptree").isNull() & leaves).select(*columns))
        moving = kept.filter(F.col("ptree").isNotNull())
        if moving.filter(leaves).isEmpty():
            break
        targets = F.broadcast(targets) if targets.limit(FEW + 1).count() <= FEW else targets
        joined = moving.join(targets, pointer).select(
            "tree", "level", "idx", "digest", F.concat("seg", "__seg").alias("seg"), *[F.col(f"__{c}").alias(c) for c in pointer]
        )
        # targets that end at the root are still pointed at
        going = stored(joined.union(kept.filter(F.col("ptree").isNull() & ~leaves)))
        reach *= 2
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("tree", "idx", "digest", F.col("seg").alias("path"))


def folded(leaf: bytes, path: bytes, places: list[tuple[int, int]]) -> list[bytes]:
    """The digest after every level: the leaf put among its siblings at (place, size of the run)."""
    out, at, digest = [], 0, leaf
    for place, size in places:
        run = [path[at + 32 * i: at + 32 * (i + 1)] for i in range(size - 1)]
        at += 32 * (size - 1)
        run.insert(place, digest)
        digest = combine(run)
        out.append(digest)
    return out


def run_places(idx: int, n: int) -> list[tuple[int, int]]:
    """(place in its run, size of the run) of a node and its ancestors, up to the top of a tree of n leaves."""
    out = []
    while n > 1:
        first = idx - idx % FAN
        out.append((idx % FAN, min(FAN, n - first)))
        idx, n = idx // FAN, -(-n // FAN)
    return out


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple = FIELDS) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the check of a second version of its text.

    fields: id, source, language, length and text columns.  A tree per source (null
    is a source) has the leaves by ascending id, null first, ties by digest; the
    trees' tops, by source, make the tree of the root.  `tampered` is the text that
    is checked against the original proof; the text itself by default.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and
    proof (the siblings as hex text).  Repeated rows are leaves of their own, equal
    rows interchangeable; a lone leaf is its source's top; a single source's top is
    the root and has no further siblings; other columns are ignored; an empty table
    gives an empty table.
    """
    names = ("__doc", "source", "__lang", "__chars", "__text")
    rows = docs.select(*[F.col(c).alias(a) for c, a in zip(fields, names)], (F.col(fields[4]) if tampered is None else tampered).alias("__new"))
    kind = dict(docs.dtypes)[fields[0]]
    leaf = lambda text: leaf_digest([F.col(c) for c in (*names[:4], text)])
    same = F.col("__new").eqNullSafe(F.col("__text"))
    digests = stored(rows.select(
        F.col("__doc").alias("doc_id"), "source", leaf("__text").alias("digest"), F.when(~same, leaf("__new")).alias("other")
    ))
    ordered = numbered(digests, ["source", "doc_id", "digest", "other"], "rank")

    starts = stored(ordered.groupBy("source").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n")))
    trees = numbered(starts.select("source", "start", "n"), ["start"], "tree")
    n_trees = trees.count()
    with_key = lambda df: df.withColumn("__none", F.col("source").isNull()).withColumn("__key", F.coalesce("source", F.lit("")))
    known = with_key(trees).select("__none", "__key", "start", "n", "tree")
    placed = spread_join(with_key(ordered), known, ["__none", "__key"], "inner", ["rank"])
    leaves = stored(placed.select("tree", (F.col("rank") - F.col("start")).alias("idx"), "n", "doc_id", "digest", "other"))

    inner = tree_nodes(leaves)
    tops = inner.filter("seg is null")
    upper = tree_nodes(tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "digest"))
    root = upper.filter("seg is null").select(F.lower(F.hex("digest"))).first()
    up = lambda c, there: F.when(there, F.col(c))
    below, top = F.col("seg").isNotNull(), F.lit(b"")
    pointed = inner.select(
        "tree", "level", "idx", "digest", F.coalesce("seg", top).alias("seg"),
        F.when(below, F.col("tree")).otherwise(F.lit(-1).cast("long")).alias("ptree"),
        F.when(below, F.col("level") + 1).otherwise(F.lit(0)).alias("plevel"),
        F.when(below, F.floor(F.col("idx") / FAN)).otherwise(F.col("tree")).alias("pidx"),
    ).union(upper.select(
        "tree", "level", "idx", "digest", F.coalesce("seg", top).alias("seg"), up("tree", below).alias("ptree"),
        up("level", below).alias("plevel") + 1, F.when(below, F.floor(F.col("idx") / FAN)).alias("pidx"),
    ))
    paths = jumped(pointed).drop("digest")

    def check(batches):
        for batch in batches:
            tree, idx, n, _, digest, other, path = (c.to_pylist() for c in batch.columns)
            out = []
            for q, i, size, leaf, new, way in zip(tree, idx, n, digest, other, path):
                inside, above = run_places(i, size), run_places(q, n_trees)
                whole = folded(leaf, way, inside + above)
                again = whole if new is None else folded(new, way, inside + above)
                siblings = way.hex()
                out.append((
                    leaf.hex(), ([leaf] + whole)[len(inside)].hex(), hashlib.sha256(siblings.encode()).hexdigest(),
                    (again[-1] if again else new or leaf).hex(), siblings,
                ))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), *[pa.array(c, pa.string()) for c in columns]],
                names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root", "proof"],
            )

    found = leaves.join(paths, ["tree", "idx"]).select("tree", "idx", "n", "doc_id", "digest", "other", "path").mapInArrow(
        check, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string, proof string"
    )
    root = F.lit(root[0] if root else None).cast("string")
    return found.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), "proof"
    )


def without_breaks() -> Column:
    """The text without line breaks where 2 divides the id's CRC-32, else the text itself."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@query
def op11_merkle_pointer_jumping(spark, sf_dir):
    return manifest(documents(spark, sf_dir), without_breaks()).drop("proof")
