"""Shared pieces: stored intermediate tables, gapless ranks, row identity, word scanning."""

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterline.session import checkpoint_root

#: White space of the word rules: \x20 and \x09-\x0D.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Spark's setting that a finished query's shuffle files are removed at once, not when the driver collects garbage.
SWEEPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    """Register a query function of (spark, folder of tables)."""
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, swept: bool = False) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Cuts the lineage and evaluates once; the copy is whole on shared storage, so
    it outlives any executor.  A failed attempt leaves nothing readable: every
    call has its own folder.  `swept`: Spark removes the shuffle files of the
    write as it ends, nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}"
    sweeps = spark.conf.get(SWEEPS, "false")
    spark.conf.set(SWEEPS, "true" if swept else sweeps)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SWEEPS, sweeps)
    return spark.read.schema(df.schema).parquet(path)


def row_key(text: Column, doc_id: Column) -> list[Column]:
    """Identity of a document row that narrow results are joined back by.

    Rows that share doc_id and text share every per-document result, so they
    may share a key; rows that differ in either have keys of their own.
    """
    return [doc_id.alias("__id"), F.xxhash64(F.lit(0), text).alias("__th")]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys meet each other; the keys of the left side stay."""
    renamed = right.select(*[F.col(c).alias(f"__r{c}" if c in keys else c) for c in right.columns])
    on = [left[k].eqNullSafe(renamed[f"__r{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], name: str, blocks: int = 1024) -> DataFrame:
    """Gapless rank from 0 of every row among the rows of its keys.

    The order is a hash of the whole row, so it depends on nothing but the
    rows.  Equal rows are counted before the shuffle and expanded last; a key is
    cut into `blocks` ranges of the hash, totals per range are summed ahead, and
    a window runs inside single ranges.  The number of ranges does not change
    the result.  A key with a third of all rows is therefore spread over
    `blocks` tasks.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__rank_n"))
    hashed = counted.withColumn("__rank_h", F.xxhash64(F.lit(11), *columns))
    share = (F.shiftright("__rank_h", 40) + (1 << 23)) / (1 << 24)
    hashed = stored(hashed.withColumn("__rank_b", F.floor(share * blocks).cast("int")))
    totals = hashed.groupBy(*keys, "__rank_b").agg(F.sum("__rank_n").alias("__rank_t"))
    ahead = Window.partitionBy(*keys).orderBy("__rank_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__rank_b", F.coalesce(F.sum("__rank_t").over(ahead), F.lit(0)).alias("__rank_o"))
    inside = Window.partitionBy(*keys, "__rank_b").orderBy("__rank_h", *columns).rowsBetween(Window.unboundedPreceding, -1)
    before = hashed.withColumn("__rank_i", F.coalesce(F.sum("__rank_n").over(inside), F.lit(0)))
    first = null_safe(before, offsets, [*keys, "__rank_b"], "inner").withColumn("__rank_s", F.col("__rank_o") + F.col("__rank_i"))
    one_each = F.sequence("__rank_s", F.col("__rank_s") + F.col("__rank_n") - 1)
    return first.select(*columns, F.explode(one_each).alias(name))


def odd_constants(n: int, seed: int, bits: int = 64) -> np.ndarray:
    """Fixed odd multipliers of a hash family."""
    kind = np.uint64 if bits == 64 else np.uint32
    return np.random.RandomState(seed).randint(0, 2**bits, n, dtype=kind) | kind(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Invertible scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0x9FB21C651E98DF25)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class ByteWords:
    """Words of many texts at once, ASCII letters in lower case.

    `is_word` says for each byte whether it belongs to a word; a line break never
    does, so words end with their text.  Per word: its text's number (`doc`) and
    its place in the joined bytes (`starts`, `ends`); `hashes` gives a 64-bit hash
    of every word, or of its first bytes.
    """

    def __init__(self, texts: list, is_word: np.ndarray):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join([*encoded, b""]).lower(), dtype=np.uint8)
        inside = np.concatenate(([False], is_word[data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        limits = np.cumsum(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) + 1)
        self.doc = np.searchsorted(limits, self.starts, side="right")
        n = len(data)
        powers, self._back = _powers(n)
        with np.errstate(over="ignore"):
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_SCATTER[data] * powers[:n], out=self._sums[1:])

    def hashes(self, first: int | None = None) -> np.ndarray:
        """From prefix sums of code(b[i]) * base**i, divided by base**start."""
        ends = self.ends if first is None else np.minimum(self.ends, self.starts + first)
        with np.errstate(over="ignore"):
            sums = (self._sums[ends] - self._sums[self.starts]) * self._back[self.starts]
            return mix64(sums + (ends - self.starts).astype(np.uint64))


def one_key(column: Column) -> Column:
    """A column as a struct, which is never null and equals another one where null meets null.

    Joins and aggregates by it share one partitioning; `null_safe` has one of its own.
    """
    return F.struct(column.alias("value"))


def text_chunks(texts: list, size: int = 1 << 20):
    """Ranges of consecutive texts of about `size` characters, so that arrays over
    all characters stay small whatever a batch holds."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end] or "") <= size):
            total += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def _powers(n: int, kept: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i for i < n at least; a worker keeps the usual size."""
    if kept and len(kept[0][0]) >= n:
        return kept[0]
    size = max(n, 1 << 21)
    with np.errstate(over="ignore"):
        made = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)))) for b in (_BASE, _INVERSE))
    if size <= 1 << 22:
        kept[:] = [made]
    return made


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SCATTER = odd_constants(256, 5)
