"""Building blocks that stay balanced when one key holds a large share of rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.session import cut_lineage


def exploded(df: DataFrame, keep: list[str], array: Column, place: str, value: str) -> DataFrame:
    """One row per element of a computed array, with its place.

    A plain explode makes the optimizer add `size(array) > 0` below itself,
    which evaluates the array expression a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, value))
    return rows.filter(F.col(place).isNotNull())


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns so that a later filter on them is not pushed into
    the computation, which would evaluate every expression a second time."""
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(packed)))


def first_by(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of every key.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key with a third of all rows costs one row per task.
    """
    named = [k.alias(f"_key{i}") for i, k in enumerate(keys)]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return (
        df.groupBy(*named)
        .agg(F.min_by(whole, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def earliest(value: str, order: list[str]) -> Column:
    """Aggregate: the first value that is not null, by order."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))


def spread_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str, spread: list[str], salts: int = 16
) -> DataFrame:
    """Join a large table to a key table with its hot keys spread over tasks.

    Rows of `big` get a salt from their own identity (stable under retries) and
    `small` is repeated once per salt.  No hint is given: a small side is still
    broadcast by its measured size, a large one is shuffled without skew.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def running_before(
    df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column | None, name: str,
    total: str | None = None,
) -> DataFrame:
    """Sum of `value` over the earlier rows of the same key; with `total`, the sum over all its rows under that name.

    A plain running window puts a whole key into one task.  Here a key is cut
    into blocks that follow the order: totals per block are summed ahead, then
    the window runs inside single blocks.  `block` must not decrease along
    `order`; without one the rows are sorted into ranges of keys and order, whose
    limits Spark samples, and written once, so a key with all rows is spread over
    as many ranges as there are shuffle partitions.  Null keys are one key.
    """
    if block is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.withColumn("_value", value).repartitionByRange(ranges, *keys, *order)
        with_block = cut_lineage(dealt.withColumn("_block", F.spark_partition_id()))
    else:
        with_block = df.withColumn("_block", block).withColumn("_value", value)
    totals = with_block.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_block").alias("_of_block"),
        F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"),
        *([] if total is None else [F.sum("_total").over(Window.partitionBy(*keys)).alias(total)]),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = with_block["_block"] == offsets["_of_block"]
    for k in keys:
        same = same & with_block[k].eqNullSafe(offsets[f"_of_{k}"])
    return (
        with_block.join(offsets, same)
        .withColumn(name, F.col("_ahead") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_block", "_value", "_ahead", "_of_block", *[f"_of_{k}" for k in keys])
    )
