"""Op 6: mixing sources to target weights by entropy balancing."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm.common import WORD, documents, null_safe, one_key, query, ranked, stored

WEIGHTS = [5, 2, 1]
SHARE = 1.5
CAP = 2.0
#: Newton stops when every source is this near its target, relative to it.
TOLERANCE = 1e-9
ROUNDS = 60


def source_targets(cells: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): weighted shares of `share` times all sizes.

    Sources in code point order, null last, take the weights in turn.  A target
    above `cap` times its source's size stops there and the excess is shared
    again by weight, until none is above.  One row per source, not per document.
    """
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    table = stored(sizes.select("source", "source_size", weight.alias("w")).withColumn("full", F.lit(False)))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    while True:
        spent, free = table.agg(
            F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))), F.lit(0.0)),
        ).first()
        each = F.col("w") * ((total - spent) / free if free else 0.0)
        over = ~F.col("full") & (each > F.col("source_size") * cap)
        target = F.when(F.col("full"), F.col("source_size") * cap).otherwise(each)
        if table.filter(over).isEmpty():
            return table.select("source", "source_size", target.cast("double").alias("target"))
        table = stored(table.withColumn("full", F.col("full") | over))


def rate(slope: Column, size: Column, mean: Column, cap: float = CAP) -> Column:
    """Copies per document, in (0, cap): the entropy-balancing solution with the
    bound cap is an exponential tilt by size, cap * e^t / (1 + e^t), t = slope * size / mean."""
    tilt = F.greatest(F.least(slope * size / mean, F.lit(700.0)), F.lit(-700.0))
    return F.lit(cap) / (1 + F.exp(-tilt))


def exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of its rows: whole millionths are added."""
    return F.sum(F.round(value * 1e6).cast("decimal(38,0)")).cast("double") / 1e6


def balance(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, slope, mean): the dual variable of every source's token constraint.

    Minimising the entropy of the rates against one copy each, with rates between
    0 and cap and sum(size * rate) = target per source, has one dual variable per
    source and a convex dual.  Each round is one distributed aggregate over the
    (source, size) cells, giving value and slope of every source's constraint,
    and one Newton step per source, kept inside a shrinking bracket.
    """
    open_ = (F.col("target") > 0) & (F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size"))
    start = F.ln(F.col("target") / (cap * F.col("source_size") - F.col("target")))
    totals = cells.filter("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = stored(null_safe(targets, totals, ["source"], "left").select(
        "source", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"),
        F.when(open_, start).when(F.col("target") > 0, 700.0).otherwise(0.0).alias("slope"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), (~open_).alias("done"),
    ))
    for _ in range(ROUNDS):
        if state.filter("not done").isEmpty():
            break
        joined = null_safe(cells.filter("size > 0"), state.filter("not done"), ["source"], "inner")
        r = rate(F.col("slope"), F.col("size"), F.col("mean"), cap)
        sums = joined.groupBy("source").agg(
            exact_sum(F.col("n") * F.col("size") * r).alias("value"),
            exact_sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r * (1 - r / cap)).alias("steep"),
        )
        next_ = null_safe(state, sums, ["source"], "left")
        gap = F.col("value") - F.col("target")
        low = F.when(gap < 0, F.col("slope")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("slope")).otherwise(F.col("high"))
        step = F.col("slope") - gap / F.greatest(F.col("steep"), F.lit(1e-300))
        inside = (step > low) & (step < high)
        middle = F.when(low <= -1e6, high * 2 - 1).when(high >= 1e6, low * 2 + 1).otherwise((low + high) / 2)
        near = F.abs(gap) <= TOLERANCE * F.col("target")
        stay = F.col("done") | near
        state = stored(next_.select(
            "source", "target", "mean",
            F.when(stay, F.col("slope")).when(inside, step).otherwise(F.greatest(F.least(middle, F.lit(1e5)), F.lit(-1e5))).alias("slope"),
            F.when(stay, F.col("low")).otherwise(low).alias("low"),
            F.when(stay, F.col("high")).otherwise(high).alias("high"),
            F.coalesce(stay, F.lit(True)).alias("done"),
        ))
    return state.select("source", "slope", "mean")


def mix(rows: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """rows (any columns with `source` and `size`) with source_size, target, rate and copies.

    Rates are rounded by systematic sampling along the size order of a source: a
    row takes the whole numbers that its step of the running sum of rates
    passes.  Neighbours have nearly equal sizes, so the words taken differ from
    the target by about one document.  The order inside a size is a hash of the
    row: the result depends on the rows alone.  Running sums are made over the
    (source, size) cells; rows only get a rank inside their cell, split into
    ranges, so neither a hot source nor a hot size meets in one task.
    """
    cells = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = stored(source_targets(cells, weights, share, cap))
    slopes = balance(cells, targets, cap)
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = null_safe(null_safe(cells, slopes, ["source"], "inner"), targets, ["source"], "inner")
    rated = rated.withColumn("rate", rate(F.col("slope"), F.col("size"), F.col("mean"), cap))
    steps = stored(rated.select(
        "source", "size", "source_size", "target", "rate",
        F.coalesce(F.sum(F.col("n") * F.col("rate")).over(along), F.lit(0.0)).alias("base"),
    ))
    placed = null_safe(ranked(rows, ["source", "size"], "__k"), steps, ["source", "size"], "inner")
    upto = lambda k: F.floor(F.col("base") + k * F.col("rate") + 0.5)
    copies = F.least(upto(F.col("__k") + 1) - upto(F.col("__k")), F.lit(int(cap)))
    return placed.withColumn("copies", F.greatest(copies, F.lit(0)).cast("int")).drop("base", "__k")


def mixed_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, source, rate and copies of every document.

    A null text has size 0; null is a source of its own, behind all others;
    repeated rows are mixed each; other columns are ignored; an empty table gives
    an empty table.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")))
    return mix(rows).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them (none to CAP times), columns unchanged.

    Whole rows are dealt out once, by the key that the copies are counted by.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select(
        F.struct("*").alias("row"), F.xxhash64(F.lit(0), *docs.columns).alias("__h"), one_key(F.col("doc_id")).alias("__id"),
        F.col("source").alias("source"), size.alias("size"),
    )
    taken = mix(stored(keyed.select("__h", F.col("__id.value").alias("__id"), "source", "size")))
    # rows alike in every column are told apart by nothing: their copies are added and dealt to one of them
    number = taken.groupBy("__h", one_key(F.col("__id")).alias("__id")).agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    alike = keyed.select("row", "__h", "__id").dropDuplicates(["__h", "__id"])
    joined = alike.join(number, ["__h", "__id"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("__c")).select("row.*")


@query
def op6_entropy_mixing(spark, sf_dir):
    return mixed_sizes(documents(spark, sf_dir))
