"""Op 8: toxic passages as maximum-scoring segments of token log-odds."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import ByteWords, documents, mix64, query, stored, text_chunks

#: Token scores live in a table of this many hashed buckets: the bound of the model.
BUCKETS = 1 << 20
#: Labelled rows the model is fitted on at most: those with the smallest hashes.
TRAIN_ROWS = 20_000
#: Documents that the prior weighs for each class: PRIOR dealt by corpus frequency, EACH to every bucket.
PRIOR, EACH = 20_000.0, 0.5
#: A token counts as a whole and by its first bytes, so that inflected forms share evidence.
PREFIXES = (None, 4, 5)
#: A token scores if its log-odds are this many standard deviations from 0.
LEAST_Z = 4.0
#: ... and at least this large: length and topic shift the odds of common tokens a little.
LEAST_ODDS = 2.0
#: What a token without evidence costs.
COST = 0.05

_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[ord("a"):ord("z") + 1] = _WORD_BYTES[ord("0"):ord("9") + 1] = _WORD_BYTES[128:] = True


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def token_buckets(texts: list) -> tuple[list[np.ndarray], np.ndarray]:
    """A bucket per token for each of PREFIXES, and the text of each token."""
    words = ByteWords(texts, _WORD_BYTES)
    salted = [words.hashes(p) ^ np.uint64(0x5851F42D4C957F2D * i % (1 << 64)) for i, p in enumerate(PREFIXES)]
    return [(mix64(h) >> np.uint64(44)).astype(np.int64) % BUCKETS for h in salted], words.doc


def count_tokens(docs: DataFrame) -> DataFrame:
    """(bucket, n_all, n_toxic, n_clean) over all rows of docs (text, toxic or
    null): tokens of the whole corpus, documents of either label."""

    def count(batches):
        total = np.zeros((3, BUCKETS), dtype=np.int64)
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in text_chunks(texts):
                every, doc = token_buckets(texts[start:end])
                for bucket in every:
                    total[0] += np.bincount(bucket, minlength=BUCKETS)
                    for row, label in ((1, 1), (2, 0)):
                        chosen = np.array([x == label for x in toxic[start:end]], dtype=bool)
                        if chosen.any():
                            own = chosen[doc]
                            pairs = np.unique(doc[own] * BUCKETS + bucket[own])
                            total[row] += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        used = np.flatnonzero(total[0])
        for i in range(0, len(used), 65536):
            part = used[i:i + 65536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), *(pa.array(total[r, part]) for r in range(3))], names=["bucket", "n_all", "n_toxic", "n_clean"]
            )

    counted = docs.select("text", "toxic").mapInArrow(count, "bucket long, n_all long, n_toxic long, n_clean long")
    return counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_toxic", "n_clean")])


def log_odds(counts: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """(bucket, score, n_all): log-odds of toxic against clean documents with a
    Dirichlet prior in proportion to the corpus counts, where they are significant."""
    n_all = counts.agg(F.coalesce(F.sum("n_all"), F.lit(0))).first()[0]
    prior = F.col("n_all") * (PRIOR / max(1, n_all)) + EACH
    odds = lambda c, n: F.ln((F.col(c) + prior) / (n + prior))
    spread = F.sqrt(1 / (F.col("n_toxic") + prior) + 1 / (F.col("n_clean") + prior))
    delta = odds("n_toxic", toxic_rows) - odds("n_clean", clean_rows)
    return counts.select("bucket", delta.alias("score"), (delta / spread).alias("z"), "n_all").filter(
        (F.abs("z") >= LEAST_Z) & (F.abs("score") >= LEAST_ODDS)
    )


def maximal_segments(places: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a token sequence.

    `places` and `scores` give the tokens with a score; every other token costs
    COST.  Linear in the scored tokens: candidate segments are kept with the sums
    before and after them, and a new one joins all back to the nearest that began
    lower, if it ends higher than that one does.
    """
    kept: list[list] = []  # first, last, sum before, sum after
    total, at = 0.0, 0
    for place, score in zip(places.tolist(), scores.tolist()):
        total -= COST * (place - at)
        at = place + 1
        if score <= 0:
            total += score
            continue
        new = [place, place, total, total + score]
        total += score
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                kept.append([*new, j])
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


class Scorer:
    """Scores of texts from the hashed table and the calibration of segment scores."""

    def __init__(self, bucket: np.ndarray, score: np.ndarray, decay: float = 1.0, scale: float = 1.0):
        self.bucket, self.score = bucket, score
        self.decay, self.scale = decay, scale

    def table(self) -> np.ndarray:
        dense = np.zeros(BUCKETS, dtype=np.float32)
        dense[self.bucket] = self.score
        return dense

    def segments(self, texts: list, dense: np.ndarray) -> tuple[list, np.ndarray]:
        """The maximal segments and the number of tokens of every text."""
        parts = [self._segments(texts[a:b], dense) for a, b in text_chunks(texts)]
        return [f for found, _ in parts for f in found], np.concatenate([n for _, n in parts] or [np.zeros(0, dtype=np.int64)])

    def _segments(self, texts: list, dense: np.ndarray) -> tuple[list, np.ndarray]:
        every, doc = token_buckets(texts)
        seen = np.stack([dense[bucket] for bucket in every])
        value = np.where(seen.max(axis=0) > 0, seen.max(axis=0), seen.min(axis=0))
        hit = np.flatnonzero(value)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        cut = np.searchsorted(hit, first)
        found = [
            maximal_segments(hit[a:b] - f, value[hit[a:b]].astype(float)) if b > a else []
            for a, b, f in zip(cut[:-1], cut[1:], first[:-1])
        ]
        return found, np.diff(first)

    def evidence(self, found: list, n: int) -> float:
        """Sum over segments of the positive log of 1 / E, E = scale * n * exp(-decay * score):
        the expected number of chance segments as good in a text of n tokens."""
        base = math.log(max(1e-12, self.scale * max(1, n)))
        return sum(max(0.0, self.decay * s - base) for _, _, s in found)


def fit_decay(score: np.ndarray, tokens: np.ndarray, rest: float) -> float:
    """The positive root of sum(p * exp(x * score)) = 1 over the tokens of the corpus."""
    total = tokens.sum() + rest
    value = lambda x: (tokens @ np.exp(np.minimum(x * score, 50.0)) + rest * math.exp(-x * COST)) / total - 1
    low, high = 1e-3, 1e-3
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return low


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and offset of P(y | x), Newton steps with a small ridge."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(p - y) @ x + 1e-3 * a, (p - y).sum() + 1e-3 * b])
        w = p * (1 - p) + 1e-9
        h = np.array([[w @ (x * x) + 1e-3, w @ x], [w @ x, w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train_rows(labels: DataFrame) -> DataFrame:
    """At most TRAIN_ROWS labelled ids that may be learned from, each once."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return stored(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Scorer, float, float]:
    """The scorer and its logistic weight and offset.

    Corpus counts (the prior) cover every document; labels come from at most
    TRAIN_ROWS ids, which are broadcast (under 400 kB), and one text of each (the
    least, if an id stands more than once).  What reaches the driver of them is a
    label and a number per id.
    """
    chosen = F.broadcast(train_rows(labels))
    marked = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id")
    sample = stored(marked.agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    corpus = count_tokens(docs.select("text", F.lit(None).cast("int").alias("toxic")))
    labelled = count_tokens(sample).withColumn("n_all", F.lit(0).cast("long"))
    counts = stored(corpus.unionByName(labelled).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_toxic", "n_clean")]))
    share = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    rows = log_odds(counts, share[0], share[1] - share[0]).orderBy("bucket").toPandas()
    bucket, score = rows["bucket"].to_numpy(dtype=np.int64), rows["score"].to_numpy(dtype=float)
    tokens = rows["n_all"].to_numpy(dtype=float)
    n_all = counts.agg(F.coalesce(F.sum("n_all"), F.lit(0))).first()[0]
    scorer = Scorer(bucket, score)
    if len(bucket):
        scorer.decay = fit_decay(score, tokens, max(0.0, n_all - tokens.sum()))

    def measured(measure, kind):
        """One number per text of the sample, beside its label and length."""

        def run(batches):
            dense = scorer.table()
            for batch in batches:
                found, n = scorer.segments(batch.column(0).to_pylist(), dense)
                values = [measure(f, m) for f, m in zip(found, n)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n), pa.array(values, pa.float64())], names=["toxic", "n", kind])

        return sample.select("text", "toxic").mapInArrow(run, f"toxic int, n long, {kind} double")

    # the mean of an extreme-value law with this decay: (log(scale * n) + 0.5772) / decay
    top = measured(lambda f, _: max((s for *_, s in f), default=0.0), "top").filter("toxic = 0 and n > 0")
    mean = top.agg(F.avg(scorer.decay * F.col("top") - F.ln("n"))).first()[0]
    if mean is not None:
        scorer.scale = float(np.exp(np.clip(mean - 0.5772, -30, 30)))
    seen = measured(scorer.evidence, "x").select("toxic", "x").toPandas()
    if len(seen) == 0 or seen["toxic"].nunique() < 2:
        return scorer, 0.0, float(-3.0 if len(seen) == 0 or seen["toxic"].max() == 0 else 3.0)
    return scorer, *fit_logistic(np.log1p(seen["x"].to_numpy()), seen["toxic"].to_numpy(dtype=float))


def score_documents(docs: DataFrame, model: tuple[Scorer, float, float]) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages (significant segments) and
    passages (their first and last word) of every row.

    Only the text enters the score.  Null and empty texts have no evidence and
    get the score of a text without toxic words; repeated rows get equal scores;
    an empty table gives an empty table.
    """
    scorer, weight, offset = model

    def score(batches):
        dense = scorer.table()
        span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
        for batch in batches:
            found, n = scorer.segments(batch.column(1).to_pylist(), dense)
            x = np.log1p([scorer.evidence(f, m) for f, m in zip(found, n)])
            p = 1 / (1 + np.exp(-np.clip(weight * x + offset, -30, 30)))
            good = [[{"first": a, "last": b} for a, b, s in f if scorer.evidence([(a, b, s)], m) > 0] for f, m in zip(found, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.astype(float)), pa.array(good, pa.list_(span))], names=["doc_id", "score", "passages"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, passages array<struct<first:int, last:int>>")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"), "passages",
    )


@query
def op8_toxic_segments(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
