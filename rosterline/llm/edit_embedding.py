"""Op 7: document fingerprints by randomised edit embedding."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import documents, mix64, odd_constants, query, stored
from rosterline.llm.components import components

#: Segments end where a hash of 8 characters has this many low zero bits, or after LONGEST characters.
CUT_BITS = 7
LONGEST = 512
#: Steps of a walk per band, and the steps of a band whose symbols are sampled.
STEPS = 32
SAMPLED = (1, 5, 8, 12, 17, 21, 26, 30)
#: Rows of the shared walk table, and character codes it tells apart.
TABLE, CODES = 4096, 1021
SLOTS = 64
#: Least values that make one key of the candidate join, edits allowed as a share of the longer text, texts a task holds on a side.
ROWS, EDITS, BLOCK = 1, 0.08, 256
#: Characters embedded at once.
CHUNK = 1 << 20

#: The shared randomness: for each step and character, bit 0 says whether the
#: walk moves on, bits 1-4 are the bits that sampling takes of the symbol.
_WALK = np.random.RandomState(7).randint(0, 32, (TABLE, CODES), dtype=np.uint8)
_FACTORS = odd_constants(SLOTS, 71, 32)
_SALTS = odd_constants(SLOTS, 72, 32)


def fingerprints(texts: list[str]) -> list[str]:
    """64 hex digits per text; texts within a small edit distance share most digits.

    A text is cut where its own characters say so, so an edit moves no cut but
    those beside it.  Each segment takes the same random walk: step j repeats the
    character it stands on and moves on if the shared table says so for (j,
    character); after an insertion two walks meet again after a few steps, which
    turns edits into few differing symbols.  Every STEPS steps the sampled bits
    make a band key, and digit s is the low half byte of the smallest key under
    the s-th hash: two texts agree in a digit as often as they share band keys.
    The k-th copy of a key in a text counts as a key of its own.  The order of the
    segments does not enter; `near_texts` verifies it.
    """
    digits = (mix64(least_keys(texts)) & np.uint64(15)).astype(np.uint8)
    digits[[not t for t in texts]] = 0
    return [row.tobytes().decode() for row in np.frombuffer(b"0123456789abcdef", dtype=np.uint8)[digits]]


def least_keys(texts: list[str]) -> np.ndarray:
    """The smallest band key of every text under each of SLOTS hashes; zeros for an empty text."""
    out, at = [np.zeros((0, SLOTS), dtype=np.uint64)], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        out.append(_least_keys(texts[at:end]))
        at = end
    return np.concatenate(out)


def _segments(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of every segment."""
    n = len(chars)
    with np.errstate(over="ignore"):
        h, width = np.concatenate((chars, np.zeros(8, dtype=chars.dtype))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
        while width < 8:
            h = h[: len(h) - width] * np.uint64(pow(0x9E3779B97F4A7C15, 3 * width, 1 << 64)) + h[width:]
            width *= 2
        cut = (mix64(h[:n]) & np.uint64((1 << CUT_BITS) - 1)) == 0
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - np.repeat(starts, lengths)
    cut &= place + 8 <= np.repeat(lengths, lengths)
    cut[starts[lengths > 0]] = True
    at = np.flatnonzero(cut)
    since = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    at = np.flatnonzero(since % LONGEST == 0)
    return at, np.diff(np.append(at, n)), text[at]


def _least_keys(texts: list[str]) -> np.ndarray:
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.zeros((len(texts), SLOTS), dtype=np.uint64)
    if lengths.sum():
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at, size, text = _segments(chars, np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        # segments apart from each other, with room for a band's steps behind each
        offset = np.concatenate(([0], np.cumsum(size + STEPS)[:-1]))
        codes = np.zeros(int(offset[-1] + size[-1] + STEPS), dtype=np.int16)
        codes[np.arange(len(chars)) + np.repeat(offset - at, size)] = chars % CODES
        here, ends, owner = offset.copy(), offset + size, text
        keys, owners, step = [], [], 0
        while len(here):
            key = np.zeros(len(here), dtype=np.uint64)
            for j in range(STEPS):
                drawn = _WALK[(step + j) % TABLE][codes[here]]
                if j in SAMPLED:
                    key = (key << np.uint64(4)) | (drawn >> 1)
                here += drawn & 1
            keys.append(mix64(key + np.uint64((step + 1) << 32)))
            owners.append(owner)
            step += STEPS
            going = here < ends
            here, ends, owner = here[going], ends[going], owner[going]
        key, own = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((key, own))
        key, own = key[order], own[order]
        fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
        copy = np.arange(len(key)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        key = (mix64(key + mix64(copy.astype(np.uint64))) >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        with np.errstate(over="ignore"):
            for s in range(SLOTS):
                out[own[first], s] = np.minimum.reduceat((key ^ _SALTS[s]) * _FACTORS[s], first)
    return out


def likeness(a: str, b: str) -> float:
    """Share of agreeing digits beyond chance, from 0 to 1."""
    same = sum(x == y for x, y in zip(a, b)) / SLOTS
    return max(0.0, (same - 1 / 16) / (15 / 16))


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bounded_distance(a: str, b: str, bound: int) -> int | None:
    """Exact edit distance of two texts, or None if it is over the bound (Myers' bit vectors)."""
    if abs(len(a) - len(b)) > bound:
        return None
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    places: dict = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    size = len(a) // 8 + 1
    equal = {}
    for c, at in places.items():
        bits = np.zeros(size * 8, dtype=np.uint8)
        bits[at] = 1
        equal[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for i, c in enumerate(b):
        eq = equal.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(across | up)) & full, up & across
        score += bool(plus & top) - bool(minus & top)
        if score - (len(b) - 1 - i) > bound:
            return None
        plus, minus = ((plus << 1) | 1) & full, (minus << 1) & full
        eq |= down
        up, down = (minus | ~(eq | plus)) & full, plus & eq
    return score if score <= bound else None


def verified_links(left: list[str], right: list[str], same: bool, edits: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of left x right that connect what all pairs within `edits` connect, fewer than one per text."""
    texts = left if same else left + right
    label, first, pairs = np.arange(len(texts)), 0 if same else len(left), []
    for i in range(len(left)):
        for j in range(i + 1 if same else first, len(texts)):
            if label[i] != label[j] and bounded_distance(texts[i], texts[j], int(edits * max(len(texts[i]), len(texts[j])))) is not None:
                pairs.append((i, j - first))
                label[label == label[j]] = label[i]
    return pairs


def near_texts(docs: DataFrame, edits: float = EDITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component (a text hash) of every row: texts linked by edit distances of at most `edits` of the longer one.

    Equal texts are folded first.  Candidates share ROWS neighbouring values of
    `least_keys`; all texts of a key are compared in pairs of blocks of BLOCK, so a
    group makes no rows in the square of its size, and keys of the same texts are
    compared once.  Null counts as empty; a text without links is its own component.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("id", F.xxhash64("text"))
    texts = stored(rows.groupBy("id").agg(F.min("text").alias("text")))

    def keys(batches):
        for batch in batches:
            least = least_keys(batch.column(1).to_pylist())
            band = np.zeros((len(least), SLOTS // ROWS), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for s in range(SLOTS):
                    band[:, s // ROWS] = mix64(band[:, s // ROWS] + least[:, s] + np.uint64(s + 1))
            own = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), band.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(band.reshape(-1).view(np.int64))], names=["id", "band"])

    banded = stored(texts.filter("text <> ''").mapInArrow(keys, "id long, band long").distinct())
    sets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("ids"))
    once = sets.filter("n > 1").groupBy("n", "ids").agg(F.min("band").alias("band"))
    dealt = (
        banded.join(once.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "band").join(texts, "id")
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", "text", "band", "mine", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one, two = group["one"].iloc[0], group["two"].iloc[0]
        left, right = group[group["mine"] == one], group[group["mine"] == two]
        pairs = verified_links(left["text"].tolist(), right["text"].tolist(), one == two, edits)
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        return pd.DataFrame({"a": [a[i] for i, _ in pairs], "b": [b[j] for _, j in pairs]}, dtype="int64")

    links = stored(dealt.groupBy("band", "one", "two").applyInPandas(compare, "a long, b long").distinct())
    known = components(links).select(F.col("node").alias("id"), "component")
    return rows.select("doc_id", "id").join(known, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))


def neighbour_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document's.

    Documents follow each other by descending doc_id, null last, ties by text
    hash; after the last comes the first.  Ids are cut into blocks at quantiles
    that are ids of the table, so each block's first document is known; it is
    also sent behind the block before.  Sorted blocks stream through one pass:
    a text is shuffled once, no block is held in memory, and the number of blocks
    changes nothing in the result.

    A null text counts as empty; an empty text has digits 0; repeated rows follow
    each other; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [(i + 1) / blocks for i in range(blocks)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10 * blocks).alias("q"), F.max("doc_id").alias("m")).first()
    limits = np.array(sorted({*(found["q"] or []), *([] if found["m"] is None else [found["m"]])}), dtype=np.int64)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """The block of an id, and -1 - b for each block b that it also ends."""
        known = ids.dropna().astype(np.int64)
        block = np.searchsorted(limits, known.to_numpy())
        ends = limits[np.minimum(block, len(limits) - 1)] == known.to_numpy()
        out = pd.Series([[0]] * len(ids), index=ids.index, dtype=object)
        out[known.index] = pd.Series(
            [[int(b), -1 - int((b + 1) % len(limits))] if e else [int(b)] for b, e in zip(block, ends)], index=known.index, dtype=object
        )
        return out

    if len(limits) == 0:  # no id at all: one block that its own first row ends
        dealt = rows.withColumn("p", F.explode(F.array(F.lit(0), F.lit(-1))))
    else:
        dealt = rows.withColumn("p", F.explode(places("doc_id")))
    dealt = dealt.select(
        F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("block"), (F.col("p") < 0).alias("behind"),
        "doc_id", F.xxhash64("text").alias("th"), "text",
    )
    ordered = dealt.repartition("block").sortWithinPartitions("block", "behind", F.col("doc_id").desc_nulls_last(), "th")

    def follow(batches):
        waiting: tuple | None = None
        for batch in batches:
            ids, texts = batch.column(2), batch.column(4).to_pylist()
            block, behind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = list(zip(block, behind, ids.to_pylist(), texts, fingerprints(texts)))
            if waiting is not None:
                rows.insert(0, waiting)
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
            waiting = rows[-1] if rows else waiting
            changed = [edited(a[3], b[3]) for a, b in pairs]
            prints = fingerprints(changed)
            yield pa.RecordBatch.from_arrays([
                pa.array([a[2] for a, _ in pairs], ids.type), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array([a[4] for a, _ in pairs], pa.string()), pa.array(prints, pa.string()),
                pa.array([likeness(a[4], p) for (a, _), p in zip(pairs, prints)], pa.float64()),
                pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(
        follow,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


@query
def op7_edit_embedding(spark, sf_dir):
    return neighbour_fingerprints(documents(spark, sf_dir))
