"""Op 10: quality rules with thresholds learned per language and source. DataFrame functions only."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm.common import SPACE, documents, null_safe, query, stored
from rosterline.functions.text import let
from rosterline.operators.skew import computed_once

#: Relative accuracy of the sketches: neighbouring buckets differ by this factor.
GAMMA = 1.02
#: Rows at which a language and source weighs as much as its language.
EVEN_ROWS = 100
#: Spread assumed at least, per feature: it decides only where nine tenths of a group are as good as equal, as
#: where their share is 0 (then one duplicate line of six, or twelve symbols in a thousand characters, pass).
LEAST_SPREAD = {"word_length": 0.05, "symbol_share": 0.002, "dup_line_share": 0.03, "repeat_share": 0.005, "upper_share": 0.001}
#: Bits of a window key that hold its place in the text.
PLACE_BITS = 28
#: Distance from the median, in spreads (distance from median to the 90th, or 10th, percentile), that fails.
WIDTH = 6.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_counts(docs: DataFrame, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """The input as a struct `row` with the counts of the base rules as a struct `q`.

    Windows are compared by 64-bit hashes.  Short keys (36 bits of the hash, 28
    of the place) are sorted as plain numbers and equal neighbours are picked;
    only these few are compared by the whole hash, and the places that repeated
    windows cover are counted.  Time is n log n in the length of a text whatever
    it repeats.  Layers are kept apart by `computed_once`, since a lambda would
    evaluate an inlined array again for each element.  `row` holds only `columns`
    if they are given, so that the text need not be carried on.
    """
    spaces = " \t\n\x0b\f\r"
    body = F.col(text)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    full = F.filter(F.split(body, "\n"), lambda line: F.length(F.btrim(line, F.lit(spaces))) > 0)
    rows = computed_once(docs.select(
        F.struct(*(columns or ["*"])).alias("row"),
        F.array_remove(F.split(body, SPACE + "+"), "").alias("w"),
        count(F.regexp_count(body, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        let(full, lambda lines: F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("unlike"))).alias("lines"),
        count(F.regexp_count(body, F.lit("\\p{Lu}"))).alias("n_upper"),
    ), {"w": F.col("w")})
    window = lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2))
    keys = F.transform(
        F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.shiftleft(window(i), PLACE_BITS).bitwiseOR(i.cast("long"))
    )
    rows = computed_once(rows, {"k": F.when(F.size("w") >= 3, keys)})
    rows = rows.withColumn("k", F.sort_array("k"))  # apart from the lambdas: compiled, on plain numbers
    high = lambda x: F.shiftright(x, PLACE_BITS)
    alike = F.filter(
        "k", lambda x, at: (high(x) == high(F.get("k", at + 1))) | (high(x) == high(F.get("k", at - 1)))
    )
    rows = computed_once(rows, {"c": alike}).drop("k")
    whole = F.transform("c", lambda x: F.struct(
        window(x.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")).alias("h"),
        x.bitwiseAND((1 << PLACE_BITS) - 1).alias("i"),
    ))
    rows = computed_once(rows, {"s": F.sort_array(whole)}).drop("c")
    same = F.filter("s", lambda x, at: (x["h"] == F.get("s", at + 1)["h"]) | (x["h"] == F.get("s", at - 1)["h"]))
    covered = F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return rows.select("row", F.struct(
        count(F.size("w")).alias("n_words"),
        count(F.length(F.array_join("w", ""))).alias("word_chars"),
        "n_symbols",
        count(F.col("lines.n") - F.col("lines.unlike")).alias("n_dup_lines"),
        count(F.size(F.array_distinct(covered))).alias("n_repeat_words"),
        "n_upper",
        count(F.col("lines.n")).alias("n_lines"),
    ).alias("q"))


def features(q: str = "q") -> dict[str, Column]:
    words = F.greatest(F.col(f"{q}.n_words"), F.lit(1))
    return {
        "word_length": F.col(f"{q}.word_chars") / words,
        "symbol_share": F.col(f"{q}.n_symbols") / F.greatest(F.col(f"{q}.word_chars"), F.lit(1)),
        "dup_line_share": F.col(f"{q}.n_dup_lines") / F.greatest(F.col(f"{q}.n_lines"), F.lit(1)),
        "repeat_share": F.col(f"{q}.n_repeat_words") / words,
        "upper_share": F.col(f"{q}.n_upper") / F.greatest(F.col(f"{q}.word_chars"), F.lit(1)),
    }


def quantile_sketch(rows: DataFrame, keys: list[str], named: dict[str, Column]) -> DataFrame:
    """Log-bucket quantile sketches of several features per group.

    (keys, feature, bucket, n): bucket b holds values in (GAMMA^(b-1), GAMMA^b],
    null holds 0 and below.  Sketches merge by adding counts, are combined before
    the shuffle, do not depend on the order of rows, and a group has a bounded
    number of buckets however many rows it has.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), c.alias("value")) for f, c in named.items()]))
    bucket = F.when(F.col("value") > 0, F.ceil(F.ln("value") / math.log(GAMMA)).cast("int"))
    return (
        rows.select(*keys, each.alias("f")).select(*keys, "f.*").withColumn("bucket", bucket)
        .groupBy(*keys, "feature", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def sketch_quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles of every sketch: (keys, feature, rows, one column per share)."""
    group = Window.partitionBy(*keys, "feature")
    upto = F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    placed = sketch.select(*keys, "feature", value.alias("value"), upto.alias("upto"), F.sum("n").over(group).alias("rows"))
    return placed.groupBy(*keys, "feature").agg(
        F.max("rows").alias("rows"),
        *[F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * q), F.col("value"))).alias(name) for name, q in shares.items()],
    )


def adaptive_thresholds(measured: DataFrame, lang: str, source: str, width: float = WIDTH) -> DataFrame:
    """(lang, source, feature, low, high) from sketches of the documents that the base rules keep.

    The quantiles of a group are drawn towards those of its language, merged from
    the sketches of the language's sources: n documents weigh n / (n + EVEN_ROWS).
    Under ten documents of a language the outer quantiles are its extremes.
    """
    rows = measured.filter(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), "q")
    sketch = stored(quantile_sketch(rows, ["lang", "source"], features()))
    shares = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    own = sketch_quantiles(sketch, ["lang", "source"], shares)
    merged = sketch.groupBy("lang", "feature", "bucket").agg(F.sum("n").alias("n"))
    wide = sketch_quantiles(merged, ["lang"], shares).select(
        "lang", "feature", *[F.col(c).alias(f"lang_{c}") for c in shares]
    )
    joined = null_safe(own, wide, ["lang", "feature"], "inner")
    weight = F.col("rows") / (F.col("rows") + EVEN_ROWS)
    pick = lambda c: weight * F.col(c) + (1 - weight) * F.col(f"lang_{c}")
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in LEAST_SPREAD.items() for x in kv]), F.col("feature"))
    return joined.select(
        "lang", "source", "feature",
        (pick("q50") - width * F.greatest(pick("q50") - pick("q10"), floor)).alias("low"),
        (pick("q50") + width * F.greatest(pick("q90") - pick("q50"), floor)).alias("high"),
    )


def judge_quality(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Documents as a struct `row` (all columns, or only `columns`) with counts `q`, `base_failed` and `kept`.

    Counts are taken once and written to shared storage with the columns asked
    for; thresholds come from sketches of the whole table and are joined back by
    language and source (null is a language and a source of its own).  `kept` is
    false where `base_failed` holds or where a feature lies outside its limits.

    A null text counts as empty and fails (no words).  Repeated rows are judged
    each.  A group without any document that passes the base rules has nothing to
    keep.  Extra columns are carried, whatever their names; an empty table gives
    an empty table.
    """
    counted = quality_counts(docs, columns and list(dict.fromkeys([*columns, "lang", "source"])))
    failed = (F.col("q.n_words") < 50) | (100 * F.col("q.n_repeat_words") > 50 * F.col("q.n_words"))
    measured = stored(counted.withColumn("base_failed", failed))
    limits = adaptive_thresholds(measured, "row.lang", "row.source")
    wide = stored(limits.groupBy("lang", "source").pivot("feature", sorted(LEAST_SPREAD)).agg(
        F.first(F.struct("low", "high"))
    ))  # of known size: a small one is broadcast before the documents are dealt out
    keyed = measured.withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")})
    joined = null_safe(keyed, wide, ["lang", "source"], "left")
    inside = F.lit(True)
    for name, value in features().items():
        inside = inside & value.between(F.col(f"{name}.low"), F.col(f"{name}.high"))
    kept = F.coalesce(~F.col("base_failed") & inside, F.lit(False))
    return joined.select("row", "q", "base_failed", kept.alias("kept"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns unchanged."""
    return judge_quality(docs).filter("kept").select("row.*")


@query
def op10_adaptive_quality(spark, sf_dir):
    judged = judge_quality(documents(spark, sf_dir), ["doc_id"])
    return judged.select("row.doc_id", *[F.col(f"q.{c}").alias(c) for c in COUNTS], "base_failed", "kept")
