"""Text files as numbered lines and CSV records, however Spark splits the files."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterline.session import cut_lineage

#: Characters of a record that is spread over several lines; more means that a quote never closes.
LONGEST_RECORD = 131_072

_SPLIT = ["path", "block"]
_BEFORE = (Window.unboundedPreceding, -1)


def _split_lines(spark: SparkSession, path: str, line_sep: str | None) -> DataFrame:
    """(path, block, at, value): a line, the file split it starts in, and a number that grows along the split."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def _sum_before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(*_BEFORE)), F.lit(0))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, line_ord, value): the lines of one or many files.

    `line` counts from 0 in the file, `line_ord` from 0 over all files in the order
    of their paths.  Lines are counted per split, the counts are summed ahead (one
    row per split), and a line's number is its place in the split plus that sum;
    no line is moved.
    """
    lines = _split_lines(spark, path, None)
    splits = lines.groupBy(*_SPLIT).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = splits.select(
        *_SPLIT, "first", _sum_before("n", Window.partitionBy("path").orderBy("block")).alias("in_file"),
        _sum_before("n", Window.orderBy(*_SPLIT)).alias("ahead"),
    )
    place = F.col("at") - F.col("first")
    return lines.join(placed, _SPLIT).select(
        "path", (place + F.col("in_file")).alias("line"), (place + F.col("ahead")).alias("line_ord"), "value"
    )


def _state_before(window) -> list[Column]:
    """Whether a quoted field is open before a row: `known`, or else whether the rows before turn the state (`odd`).

    A row says what it ends in when it starts closed (f0) or open (f1).  Equal
    answers fix the state; unequal ones keep it or turn it.  So the state is the
    last fixed one, turned as often as rows since then turn it: a running count
    and a last value instead of a walk from row to row.
    """
    past = window.rowsBetween(*_BEFORE)
    fixed = F.last(F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").alias("open"), F.col("turns"))), ignorenulls=True).over(past)
    turns = F.coalesce(F.max("turns").over(past), F.lit(0))
    known = F.when(fixed.isNotNull(), fixed["open"] != ((turns - fixed["turns"]) % 2 == 1))
    return [known.alias("known"), (turns % 2 == 1).alias("odd")]


def _turns(window) -> Column:
    """Running count of rows that turn the state, the row itself included."""
    return F.sum((F.col("f0") & ~F.col("f1")).cast("long")).over(window.rowsBetween(Window.unboundedPreceding, 0))


def _ends_open(text: Column, sep: str) -> Column:
    """Whether a line that starts outside of quotes ends inside of them.

    Whole fields, then one that opens a quote (doubled quotes stay inside).  A
    quote in the middle of an unquoted field is a character like any other.
    """
    s = re.escape(sep)
    quoted = '"[^"]*+(?:""[^"]*+)*+'
    return text.rlike(rf'\A(?:(?:{quoted}"[^{s}]*+|(?!")[^{s}]*+){s})*+{quoted}\z')


def _cells(record: Column, sep: str) -> Column:
    s = re.escape(sep)
    quoted = '"[^"]*+(?:""[^"]*+)*+'
    fields = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(rf'{s}({quoted}(?:"[^{s}]*+|\z)|(?!")[^{s}]*+)'), F.lit(1))

    def plain(field: Column) -> Column:
        body = F.replace(F.regexp_extract(field, '\\A"([^"]*+(?:""[^"]*+)*+)', 1), F.lit('""'), F.lit('"'))
        tail = F.regexp_extract(field, '(?s)\\A"[^"]*+(?:""[^"]*+)*+"(.*)\\z', 1)
        return F.when(F.startswith(field, F.lit('"')), F.concat(body, tail)).otherwise(field)

    return F.transform(fields, plain)


def csv_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(path, line, line_ord, cells): the records of CSV files, `line` being a record's first line.

    A line break inside quotes belongs to its field, also where a split of the file
    begins there.  Each line is a function from the state before it (a quoted field
    open or not) to the state after it; these are composed inside a split, then
    over the splits of a file, one row each, which gives every split its state at
    the start.  Lines that are records of their own are not grouped; the others
    are, by their record's first line.  A record of over LONGEST_RECORD characters
    is refused: a quote that never closes would make one record of the rest.
    Empty files have no records.
    """
    raw = _split_lines(spark, path, "\n").withColumn("value", F.regexp_replace("value", "\\A\ufeff", ""))
    split = Window.partitionBy(*_SPLIT).orderBy("at")
    lines = raw.withColumns({"f0": _ends_open(F.col("value"), sep), "f1": _ends_open(F.concat(F.lit('"'), "value"), sep)})
    lines = lines.withColumn("turns", _turns(split)).select("*", *_state_before(split))
    lines = lines.withColumns({"open0": F.coalesce("known", "odd"), "open1": F.coalesce("known", ~F.col("odd"))})
    so_far = split.rowsBetween(Window.unboundedPreceding, 0)
    first = {f"start{s}": F.max(F.when(~F.col(f"open{s}"), F.col("at"))).over(so_far) for s in (0, 1)}
    lines = cut_lineage(lines.withColumns(first).select(*_SPLIT, "at", "value", "f0", "f1", "open0", "open1", "start0", "start1"))

    last = F.struct("at", F.when(F.col("open0"), F.col("f1")).otherwise(F.col("f0")).alias("f0"), F.when(F.col("open1"), F.col("f1")).otherwise(F.col("f0")).alias("f1"))
    splits = lines.groupBy(*_SPLIT).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.max(last).alias("last"), F.max("start0").alias("start0"), F.max("start1").alias("start1"),
    ).select(*_SPLIT, "first", "n", "last.f0", "last.f1", "start0", "start1")
    file = Window.partitionBy("path").orderBy("block")
    splits = splits.withColumn("turns", _turns(file)).select("*", *_state_before(file))
    splits = splits.select(
        *_SPLIT, "first", "n", F.coalesce("known", "odd").alias("open"), "start0", "start1",
        _sum_before("n", file).alias("in_file"), _sum_before("n", Window.orderBy(*_SPLIT)).alias("ahead"),
    )
    start = F.when(F.col("open"), F.col("start1")).otherwise(F.col("start0"))
    started = splits.withColumn("_line", start - F.col("first") + F.col("in_file"))
    splits = started.select(
        *_SPLIT, "first", "open", "in_file", "ahead", F.max("_line").over(file.rowsBetween(*_BEFORE)).alias("carried")
    )

    joined = lines.join(splits, _SPLIT)
    is_open = F.when(F.col("open"), F.col("open1")).otherwise(F.col("open0"))
    ends = F.when(is_open, F.col("f1")).otherwise(F.col("f0"))
    line = F.col("at") - F.col("first") + F.col("in_file")
    own = F.when(F.col("open"), F.col("start1")).otherwise(F.col("start0")) - F.col("first") + F.col("in_file")
    placed = joined.select(
        "path", line.alias("line"), (F.col("ahead") - F.col("in_file")).alias("_file"), F.coalesce(own, F.col("carried")).alias("record"),
        "value", (~is_open & ~ends).alias("whole"),
    )
    parts = placed.filter(~F.col("whole"))
    longest = parts.groupBy("path", "record").agg(F.sum(F.length("value") + 1).alias("n")).agg(F.max("n")).first()[0]
    if longest and longest > LONGEST_RECORD:
        raise ValueError(f"a quoted field of {path} does not close within {LONGEST_RECORD} characters")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda p: p["value"])
    folded = parts.groupBy("path", "record").agg(F.min("_file").alias("_file"), F.array_join(pieces, "\n").alias("value"))
    records = placed.filter("whole").select("path", "record", "_file", "value").union(folded)
    return records.select(
        "path", F.col("record").alias("line"), (F.col("record") + F.col("_file")).alias("line_ord"),
        _cells(F.regexp_replace("value", "\r\\z", ""), sep).alias("cells"),
    )
