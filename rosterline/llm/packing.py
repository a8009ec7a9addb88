"""Op 1: optimal length buckets and token-budget batches."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import WORD, documents, null_safe, query, ranked, stored

#: Lengths are counted on a grid: single steps up to FINE, then FINE steps per doubling.
FINE = 1024


def grid_length(length: Column) -> Column:
    """The grid length at or above a length: exact up to 1024, within 1/512 above."""
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)) / FINE) - 1e-12)).cast("int")
    step = F.pow(F.lit(2.0), doublings)
    return (F.ceil(length / step) * step).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` ranges of the sorted lengths with the least padding.

    Dynamic program over the histogram: cost(i, j) pads all of i..j to length j.
    The cost is Monge, so the best split point moves monotonically and a layer
    is solved by divide and conquer in n log n steps.
    """
    n = len(lengths)
    if n == 0:
        return []
    many = np.concatenate(([0.0], np.cumsum(counts, dtype=float)))
    total = np.concatenate(([0.0], np.cumsum(counts * lengths.astype(float))))
    best = lengths * many[1:] - total[1:]
    splits = []
    for _ in range(min(buckets, n) - 1):
        following, split = best.copy(), np.zeros(n, dtype=np.int64)
        todo = [(1, n - 1, 0, n - 2)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + lengths[j] * (many[j + 1] - many[i + 1]) - (total[j + 1] - total[i + 1])
            k = int(np.argmin(cost))
            if cost[k] < following[j]:
                following[j], split[j] = cost[k], i[k] + 1
            todo += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        splits.append(split)
        best = following
    j = n - 1
    ends = [j]
    for split in reversed(splits):
        if split[j]:
            j = int(split[j]) - 1
            ends.append(j)
    return sorted({int(lengths[e]) for e in ends})


def length_buckets(lengths: DataFrame, buckets: int, length: str = "length") -> list[int]:
    """Bucket ends for a table with a length column.

    Only the histogram over the grid reaches the driver: 1024 cells per doubling
    of the length, at most about 56,000 for any 64-bit length.
    """
    cells = lengths.groupBy(grid_length(F.col(length)).alias("cell")).count().toPandas().sort_values("cell")
    return best_boundaries(cells["cell"].to_numpy(dtype=np.int64), cells["count"].to_numpy(dtype=np.int64), buckets)


def pack(
    docs: DataFrame, buckets: int = 16, budget: int = 16384, length: Column | None = None, doc_id: str = "doc_id"
) -> DataFrame:
    """Every document with its length bucket and its place in a batch of that bucket.

    Columns: doc_id, n_tokens, bucket (from 0, by length), padded_length (the
    bucket's end), batch (gapless in the bucket), place (gapless in the batch),
    batch_rows.  Batches of a bucket hold max(1, budget // padded_length)
    documents, all full but the last one; a document longer than the budget is a
    batch of its own.  `length` defaults to the number of words.

    A null or empty text has length 0 and goes into the first bucket; repeated
    rows get places of their own; other columns are ignored; an empty table
    gives an empty table.  Texts are read once and never shuffled.
    """
    length = F.regexp_count("text", F.lit(WORD)) if length is None else length
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"))
    rows = stored(rows)
    ends = length_buckets(rows, buckets, "n_tokens")
    bucket, padded = F.lit(0), F.lit(ends[0] if ends else 0).cast("long")
    for i, end in enumerate(ends[:-1]):
        over = F.col("n_tokens") > end
        bucket, padded = F.when(over, i + 1).otherwise(bucket), F.when(over, F.lit(ends[i + 1]).cast("long")).otherwise(padded)
    placed = rows.select("doc_id", "n_tokens", bucket.cast("int").alias("bucket"), padded.alias("padded_length"))
    numbered = ranked(placed, ["bucket", "padded_length"], "rank")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1)))).cast("long")
    totals = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows_in_bucket"))
    return (
        null_safe(numbered, totals, ["bucket"], "inner")
        .withColumn("fit", fit)
        .select(
            "doc_id", "n_tokens", "bucket", "padded_length",
            F.floor(F.col("rank") / F.col("fit")).cast("long").alias("batch"),
            (F.col("rank") % F.col("fit")).cast("int").alias("place"),
            F.least(F.col("fit"), F.col("rows_in_bucket") - F.floor(F.col("rank") / F.col("fit")) * F.col("fit"))
            .cast("int").alias("batch_rows"),
        )
    )


@query
def op1_length_bucket_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
