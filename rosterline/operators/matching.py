"""Dictionary and similarity joins on distinct positions."""

import math
import sys

import ahocorasick
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions.positions import contains_target
from rosterline.functions.similarity import Entries, partial, position_dictionary
from rosterline.functions.text import empty_to_null, strip_ws
from rosterline.operators.skew import spread_join
from rosterline.schemas import CONTACT_ORDER
from rosterline.session import cut_lineage

# as in functions/similarity.py: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts, and dictionary entries or targets, that one group holds at most, about.
PART, BLOCK = 20_000, 20_000


def positions_table(spark: SparkSession) -> DataFrame:
    """The fixed dictionary as a table: ord, variant, canonical."""
    rows = [(i, k, v) for i, (k, v) in enumerate(position_dictionary().items())]
    return spark.createDataFrame(rows, "ord int, variant string, canonical string")


def exact_dictionary_join(contacts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds `canonical` by case-insensitive lookup, the first entry of a variant."""
    entries = dictionary.groupBy(F.lower("variant").alias("_variant")).agg(
        F.min_by("canonical", "ord").alias("canonical")
    )
    keyed = contacts.withColumn("_variant", F.lower(strip_ws(F.col("position_raw"))))
    return spread_join(keyed, entries, ["_variant"], "left", CONTACT_ORDER).drop("_variant")


def _grouped(texts: DataFrame, entries: DataFrame, keys: list[str]):
    """Both sides in groups of a key, a block of the entries and a part of the texts.

    Every text meets every block of its key, in one of the parts; a block is
    repeated once per part.  Both numbers follow from counts, so no group holds more
    than about PART texts and BLOCK entries, and pairs are never rows.
    """
    parts, blocks = (max(1, -(-side.count() // most)) for side, most in ((texts, PART), (entries, BLOCK)))
    dealt = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts.withColumn("_part", dealt(parts)).withColumn("_block", every(blocks))
    right = entries.withColumn("_block", dealt(blocks)).withColumn("_part", every(parts))
    by = [*keys, "_block", "_part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by))


def similar_entries(texts: DataFrame, dictionary: DataFrame, cutoff: float = 75.0) -> DataFrame:
    """(text, ord): the most similar dictionary variant of each distinct text, if it reaches the cutoff.

    texts: text; dictionary: ord, variant; both compared in lower case with their
    words sorted.  Of equal scores the first entry counts.

    Lengths come first: for a score of c the shorter text has at least c / (200 - c)
    of the longer one's length, so lengths fall into bands of that ratio, a variant
    stands in its own band and a text asks its own and the two beside it.  In a group
    all entries that the length allows are scored together (see Entries).
    """
    step = math.log((200 - cutoff) / cutoff) if cutoff < 100 else 1e-9
    band = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / step).cast("int")
    fold = lambda c: F.array_join(F.array_sort(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")), " ")
    entries = dictionary.select("ord", fold(F.col("variant")).alias("text"))
    entries = entries.groupBy("text").agg(F.min("ord").alias("ord")).withColumn("_band", band(F.col("text")))
    asked = cut_lineage(texts.select("text", fold(F.col("text")).alias("folded"))).withColumn("_own", band(F.col("folded")))
    near = F.explode(F.array(*[F.col("_own") + d for d in (-1, 0, 1)]))
    asked = asked.withColumn("_band", near).select("text", "folded", "_band")

    def score(texts: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(texts) and len(entries):
            entries = entries.sort_values("ord")
            known, places = Entries(entries["text"].tolist()), entries["ord"].tolist()
            for text, folded in zip(texts["text"], texts["folded"]):
                found = known.best(folded, cutoff)
                if found:
                    out.append((text, places[found[0]], found[1]))
        return pd.DataFrame(out, columns=["text", "ord", "score"]).astype({"text": object, "ord": "int64", "score": "float64"})

    scored = _grouped(asked, entries, ["_band"]).applyInPandas(score, "text string, ord long, score double")
    best = F.max_by("ord", F.struct("score", -F.col("ord"))).alias("ord")
    return scored.groupBy("text").agg(best)


def fuzzy_dictionary_join(contacts: DataFrame, dictionary: DataFrame | None = None, cutoff: float = 75.0) -> DataFrame:
    """Adds `canonical`: exact entry, else the most similar one, else the text.

    dictionary: ord, variant, canonical; the fixed one by default.  Each distinct
    position is looked up once in the whole job.
    """
    dictionary = positions_table(contacts.sparkSession) if dictionary is None else dictionary
    distinct = contacts.select("position_raw").filter(F.length(strip_ws(F.col("position_raw"))) > 0).distinct()
    distinct = distinct.withColumn("text", F.lower(strip_ws(F.col("position_raw"))))
    exact = dictionary.groupBy(F.lower("variant").alias("text")).agg(F.min_by("canonical", "ord").alias("_exact"))
    keyed = cut_lineage(distinct.join(exact, "text", "left"))
    unknown = keyed.filter("_exact is null").select("text").distinct()
    similar = similar_entries(unknown, dictionary, cutoff).join(
        dictionary.select("ord", F.col("canonical").alias("_similar")), "ord"
    ).select("text", "_similar")
    scored = keyed.join(similar, "text", "left").select(
        "position_raw", F.coalesce("_exact", "_similar", F.col("position_raw")).alias("canonical")
    )
    return spread_join(contacts, scored, ["position_raw"], "left", CONTACT_ORDER)


def matching_texts(texts: DataFrame, targets: DataFrame, cutoff: float = 70.0) -> DataFrame:
    """The distinct texts (text) that hold a target, or reach the partial ratio with one.

    texts: text; targets: target; both in lower case.  One automaton of a group's
    targets reads a text once, however many targets there are.  Texts without a hit
    are compared with the targets that share enough characters: a window of w common
    characters scores at most 200 w / (w + length of the shorter), so fewer common
    characters than that rule a target out.
    """
    wanted = targets.select(F.col("target").alias("text")).filter("text is not null").distinct()

    def match(texts: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(texts) and len(targets):
            names = targets["text"].tolist()
            automaton = ahocorasick.Automaton()
            for name in names:
                if name:
                    automaton.add_word(name, name)
            automaton.make_automaton()
            for text in texts["text"]:
                direct = "" in names or (len(automaton) > 0 and next(automaton.iter(text), None) is not None)
                if direct or any(partial_reaches(name, text, cutoff) for name in names):
                    found.append(text)
        return pd.DataFrame({"text": pd.Series(found, dtype=object)})

    return _grouped(cut_lineage(texts.select("text")), wanted, []).applyInPandas(match, "text string").distinct()


def partial_reaches(a: str, b: str, cutoff: float) -> bool:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    shared = sum(min(short.count(c), long.count(c)) for c in set(short))
    if 200.0 * shared < cutoff * (len(short) + shared):
        return False
    return partial(a, b) >= cutoff


def match_targets_join(contacts: DataFrame, targets: DataFrame | list[str], cutoff: float = 70.0) -> DataFrame:
    """Semi join with the wanted positions, decided once per distinct pair of
    raw and normalised position.  `targets` is a table (target) or a list; no targets
    keep every contact."""
    if isinstance(targets, list):
        targets = contacts.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    targets = targets.select(F.lower("target").alias("target"))
    if targets.isEmpty():
        return contacts
    text = F.lower(F.concat(F.coalesce("position_raw", F.lit("")), F.lit(" "), F.coalesce("position_normalized", F.lit(""))))
    keyed = contacts.withColumn("text", text)
    wanted = matching_texts(keyed.select("text").distinct(), targets, cutoff)
    return spread_join(keyed, wanted, ["text"], "left_semi", CONTACT_ORDER).drop("text")


def substring_targets(contacts: DataFrame, targets: list[str]) -> DataFrame:
    """Target match by substring only: a plain filter, no join needed."""
    return contacts.filter(
        contains_target(empty_to_null(F.col("position_raw")), F.col("position_normalized"), targets)
    )
