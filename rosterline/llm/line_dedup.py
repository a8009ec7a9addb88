"""Op 3: fuzzy line dedup by MinHash, exact verification and distributed union-find."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm.common import documents, mix64, null_safe, odd_constants, query, row_key, stored
from rosterline.llm.components import components

SHINGLE = 8
BANDS = 10
ROWS = 4
SIMILARITY = 0.8
#: Similarity that makes two lines one family, inside which all pairs are looked at.
KIN = 0.5
#: A line SIMILARITY alike to one under KIN to a pick is under this to it (1 - Jaccard keeps the triangle rule).
REST = KIN + 1 - SIMILARITY + 1e-9
#: Lines of a group that one task holds on either side, and bits of a line's shingle map.
BLOCK, MAP_BITS = 1024, 1024
#: Characters that the lines of one side should have in all.
BLOCK_CHARS = 1 << 20
#: Characters hashed at once: their hashes should stay in a core's cache.
CHUNK = 1 << 16
#: White space around a line.
BLANK = " \t\n\x0b\f\r"

_SALTS = odd_constants(BANDS * ROWS, 31, 32)
_FACTORS = odd_constants(BANDS * ROWS, 32, 32)


def band_keys(lines: list[str]) -> np.ndarray:
    """BANDS 64-bit keys per line, from a MinHash of ROWS values each.

    A line shorter than SHINGLE characters is one shingle.  Lines of similarity s
    share a key with probability 1 - (1 - s^4)^10: 0.995 at 0.8, 0.9998 at 0.9.
    """
    least, at = np.empty((BANDS * ROWS, len(lines)), dtype=np.uint32), 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= CHUNK):
            size += len(lines[end])
            end += 1
        _least_hashes(lines[at:end], least[:, at:end])
        at = end
    keys = np.zeros((len(lines), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BANDS * ROWS):
            keys[:, i // ROWS] = mix64(keys[:, i // ROWS] + least[i] + np.uint64(i + 1))
    return keys


def _least_hashes(lines: list[str], out: np.ndarray) -> None:
    """The least of the hashes of every line's shingles, for each of the hash functions."""
    chars, places, offsets = _shingle_places(lines)
    with np.errstate(over="ignore"):
        h, width = chars.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
        while width < SHINGLE:
            factor = np.uint64(pow(0x9E3779B97F4A7C15, 3 * width, 1 << 64))
            h = h[: len(h) - width] * factor + h[width:]
            width *= 2
        h = (mix64(h[places]) >> np.uint64(32)).astype(np.uint32)
        salted = np.empty_like(h)
        for i in range(BANDS * ROWS):
            np.bitwise_xor(h, _SALTS[i], out=salted)
            np.multiply(salted, _FACTORS[i], out=salted)
            np.minimum.reduceat(salted, offsets[:-1], out=out[i])


def _shingle_places(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all lines, SHINGLE zeros behind each, the places there at which
    shingles start, and the numbers of the lines' first shingles (and of all shingles)."""
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    pad = "\0" * SHINGLE
    chars = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = np.maximum(1, lengths - SHINGLE + 1)
    starts = np.concatenate(([0], np.cumsum(lengths + SHINGLE)[:-1]))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], counts)
    return chars, places, offsets


def shingle_codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): the different shingles of each line as ascending numbers, one line behind the other.

    Equal numbers are equal shingles, no hashes: a character is its rank in the
    alphabet of these lines, and SHINGLE ranks under 256 make a 64-bit number, made
    of a few lines at once.  A larger alphabet is ranked by pairs, pairs of pairs
    and so on, over all lines.
    """
    there, parts, at = np.ones(1, dtype=bool), [], 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= CHUNK):
            size += len(lines[end])
            end += 1
        parts.append(lines[at:end])
        here = np.bincount(np.frombuffer(("".join(parts[-1]) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")) > 0
        there, here = sorted((there, here), key=len, reverse=True)
        there[:len(here)] |= here
        at = end
    ranks = np.cumsum(there).astype(np.uint64)
    if ranks[-1] > 255 or len(parts) < 2:
        return _codes(lines, ranks)
    codes, offsets = zip(*(_codes(part, ranks) for part in parts))
    counts = np.concatenate([np.diff(x) for x in offsets])
    return np.concatenate(codes), np.concatenate(([0], np.cumsum(counts)))


def _codes(lines: list[str], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chars, places, offsets = _shingle_places(lines)
    h, width = ranks[chars], 1
    ends = np.concatenate((places[offsets[1:-1]], [len(chars)])) - SHINGLE
    h[(ends[:, None] + np.arange(SHINGLE)).reshape(-1)] = 0  # what stands behind a line is no character
    wide = ranks[-1] > 255
    while width < SHINGLE:
        h = (h[: len(h) - width] << np.uint64(32 if wide else 8 * width)) | h[width:]
        if wide:
            h = np.unique(h, return_inverse=True)[1].astype(np.uint64)
        width *= 2
    return _different(h[places], offsets)


def _different(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every range sorted, in place, without repeats."""
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        codes[start:end].sort()
    fresh = np.concatenate(([True], codes[1:] != codes[:-1]))
    fresh[offsets[:-1]] = True
    return codes[fresh], np.concatenate(([0], np.cumsum(np.add.reduceat(fresh, offsets[:-1], dtype=np.int64))))


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Exact similarity of left[i] and right[i], for every i."""
    out, at = np.empty(len(left)), 0
    while at < len(left):
        end, size = at, 0
        while end < len(left) and (end == at or size <= CHUNK):
            size += len(left[end]) + len(right[end])
            end += 1
        codes, offsets = shingle_codes([x for pair in zip(left[at:end], right[at:end]) for x in pair])
        either = np.diff(_different(codes, offsets[::2])[1])
        both = np.diff(offsets[::2]) - either
        out[at:end] = both / either
        at = end
    return out


def shingles(line: str) -> set:
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: set, b: set) -> float:
    """Exact similarity of two shingle sets."""
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def alike_links(left: list[str], right: list[str], same: bool, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of left x right that connect exactly what all pairs of
    SIMILARITY connect, fewer than one per line.  `same`: both sides are one list.
    `apart`: a number per line of left (and right, if not `same`); lines of equal
    number are not compared.

    A bit map of hashed shingles bounds the overlap from above (a bit that only
    one side has is a shingle that only this side has), so only pairs that can be
    alike, and are not yet connected, are compared as sets.
    """
    lines = left if same else left + right
    if not lines:
        return []
    codes, offsets = shingle_codes(lines)
    sizes = np.diff(offsets)
    sets = [codes[start:end] for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    bits = np.zeros((len(lines), MAP_BITS), dtype=np.uint8)
    bits[np.repeat(np.arange(len(lines)), sizes), mix64(codes) % np.uint64(MAP_BITS)] = 1
    maps = np.packbits(bits, axis=1).view(np.uint64)
    first = 0 if same else len(left)
    label = np.arange(len(lines))
    pairs = []

    def alike(a, b):
        two = np.concatenate((a, b))
        two.sort()
        both = int(np.count_nonzero(two[1:] == two[:-1]))
        return both / (len(two) - both) >= SIMILARITY

    for i in range(len(left)):
        start = i + 1 if same else first
        if start >= len(lines):
            break
        need = SIMILARITY / (1 + SIMILARITY) * (sizes[i] + sizes[start:])
        mine = sizes[i] - np.bitwise_count(maps[i] & ~maps[start:]).sum(axis=1, dtype=np.int64)
        other = sizes[start:] - np.bitwise_count(maps[start:] & ~maps[i]).sum(axis=1, dtype=np.int64)
        fit = (np.minimum(mine, other) >= need - 1e-9) & (label[start:] != label[i])
        if apart is not None:
            fit &= apart[start:] != apart[i]
        for j in np.flatnonzero(fit) + start:
            if label[j] != label[i] and alike(sets[i], sets[j]):
                pairs.append((i, int(j) - first))
                label[label == label[j]] = label[i]
    return pairs


def document_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(__id, __th, n_lines, line, id, norm, keys) of every line with a word.

    `norm` is what is compared, `id` its `line_id` and `keys` its band keys; norm
    and keys are given once per task, null and empty where the task has given them
    already.  `n_lines`, the number of such lines, stands in one row of every
    document; that row has a null line and id if there are none.
    """

    def split(batches):
        given: set = set()
        for batch in batches:
            if len(given) > 1_000_000:  # repeats only cost time
                given.clear()
            for low, high in _text_ranges(batch.column(2)):
                rows, totals, places, ids, norms, fresh = [], [], [], [], [], []
                for i, text in enumerate(batch.column(2).slice(low, high - low).to_pylist(), low):
                    before = len(rows)
                    for place, raw in enumerate((text or "").split("\n")):
                        norm = raw.strip(BLANK).lower()
                        if not norm:
                            continue
                        x = xxhash.xxh64_intdigest(norm.encode("utf-8", "surrogatepass"), _ID_SEED)
                        known = x in given
                        if not known:
                            given.add(x)
                            fresh.append(norm)
                        rows.append(i)
                        totals.append(None)
                        places.append(place)
                        ids.append(x - (x >> 63 << 64))
                        norms.append(None if known else norm)
                    if len(rows) == before:
                        for some, x in zip((rows, totals, places, ids, norms), (i, 0, None, None, None)):
                            some.append(x)
                    else:
                        totals[before] = len(rows) - before
                each = np.fromiter((0 if x is None else BANDS for x in norms), dtype=np.int32, count=len(norms))
                ends = np.concatenate(([0], np.cumsum(each))).astype(np.int32)
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(totals, pa.int64()),
                    pa.array(places, pa.int32()), pa.array(ids, pa.int64()), pa.array(norms, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(fresh).reshape(-1).view(np.int64))),
                ], names=["__id", "__th", "n_lines", "line", "id", "norm", "keys"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(*row_key(F.col(text), F.col(doc_id)), F.col(text).alias("__text"))
    return rows.mapInArrow(
        split, f"__id {kind}, __th long, n_lines long, line int, id long, norm string, keys array<long>"
    )


def _text_ranges(texts: pa.Array, size: int = 1 << 20):
    """Ranges of consecutive texts of about `size` bytes: only these stand as Python strings at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, end
        at, before = end, ends[end - 1]


#: What `line_id` hashes a line with: the hash of its leading zero.
_ID_SEED = xxhash.xxh64_intdigest(bytes(4), 42)


def line_id() -> Column:
    return F.xxhash64(F.lit(0), F.col("norm")).alias("id")


def buckets(lines: DataFrame) -> DataFrame:
    """(band, rep, id): the lines of every band key that different lines share,
    beside one of them, picked by a hash that differs from band to band."""

    rows = lines.select("id", F.explode("keys").alias("band")).repartition("band")
    ends = rows.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    many = ends.filter("least < most").select("band")
    shared = rows.join(many.hint("shuffle_hash"), "band")
    pick = F.min(F.struct(F.xxhash64("band", "id"), "id")).over(Window.partitionBy("band"))
    return shared.select("band", pick["id"].alias("rep"), "id").distinct()


def similar_links(lines: DataFrame) -> DataFrame:
    """(a, b) line ids that connect all lines that share a band key and are SIMILARITY alike.

    Every line of a bucket is compared with the bucket's pick.  Lines at least KIN
    alike form families; where all edges of a family are links, it is connected
    already, the others are compared inside the family.  If a line is under KIN to
    its pick, all lines of the bucket under REST to the pick are compared with each
    other, except inside one family: two alike lines are both at least KIN alike
    to the pick, or both under REST.  Either group is compared in pairs of blocks
    of up to BLOCK lines: each line's text is sent once per pair, pairs live and
    die in the task, and no more links leave it than it has lines.  So a group
    makes no rows in the square of its size.  The rest of one bucket that is also
    the rest of another is compared once.
    """
    members = stored(buckets(lines), swept=True)
    wanted = members.select("id").union(members.select("rep")).distinct()
    shown = lines.filter("norm is not null").select(line_id(), "norm")
    texts = stored(shown.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("norm").alias("norm")), swept=True)

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(similarities(a.tolist(), b.tolist()))

    def measured(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("id").alias("a"), F.col("norm").alias("text_a"))
        right = texts.select(F.col("id").alias("b"), F.col("norm").alias("text_b"))
        return stored(pairs.join(left, "a").join(right, "b").select("a", "b", similarity("text_a", "text_b").alias("s")))

    def star(picked: DataFrame) -> DataFrame:
        ends = [F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")]
        return picked.filter("id <> rep").select(*ends).distinct()

    near = measured(star(members))
    kin = stored(components(near.filter(F.col("s") >= KIN)).select(F.col("node").alias("id"), F.col("component").alias("family")))
    loose = near.filter((F.col("s") >= KIN) & (F.col("s") < SIMILARITY)).select(F.col("a").alias("id")).distinct()
    open_families = kin.join(loose, "id").select("family").distinct()
    inside = kin.join(open_families, "family").select(F.lit(False).alias("rest"), F.col("family").alias("group"), "id", "family")

    ends = {"a": F.least("id", "rep"), "b": F.greatest("id", "rep")}
    far = members.filter("id <> rep").withColumns(ends).join(near.filter(F.col("s") < REST), ["a", "b"])
    far = stored(far.join(kin, "id", "left").select("band", "id", "s", F.coalesce("family", "id").alias("family")))
    rests = far.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("least"), (F.min("family") < F.max("family")).alias("mixed"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("lines"),
    )
    rests = rests.filter(F.col("mixed") & (F.col("least") < KIN)).groupBy("lines", "n").agg(F.min("band").alias("band"))
    others = far.join(rests, "band").select(F.lit(True).alias("rest"), F.col("band").alias("group"), "id", "family")

    groups = stored(inside.union(others))
    lengths = texts.select("id", F.length("norm").alias("length"))
    sizes = groups.join(lengths, "id").groupBy("rest", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.least(F.col("n"), F.col("chars") / BLOCK_CHARS))).cast("int")
    wide = groups.join(sizes.filter("rest or n > 2"), ["rest", "group"]).withColumn("blocks", blocks)
    dealt = (
        wide.join(texts, "id").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", "norm", "rest", "group", "family", "mine", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
    )

    def compare(group: pa.Table) -> pa.Table:
        id_, rest, family, mine, one, two = (
            group[c].to_numpy() for c in ("id", "rest", "family", "mine", "one", "two")
        )
        left, right = np.flatnonzero(mine == one), np.flatnonzero(mine == two)
        same, norms = bool(one[0] == two[0]), group["norm"].to_pylist()
        apart = family[left if same else np.concatenate((left, right))] if rest[0] else None
        pairs = alike_links([norms[i] for i in left], [norms[i] for i in right], same, apart)
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": id_[left[a]], "b": id_[right[b]]})

    found = dealt.groupBy("rest", "group", "one", "two").applyInArrow(compare, "a long, b long")
    return near.filter(F.col("s") >= SIMILARITY).select("a", "b").union(found)


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(__id, __th, dropped): the line numbers of every document that go, by the stored `document_lines`.

    Of each component of alike lines the first stays, by doc_id (null last), text
    hash and line number.  Lines are compared in lower case without blanks around
    them; lines without a word are never compared and stay.  Rows that share
    doc_id and text count as one document.
    """
    place = F.struct(F.col("__id").isNull().alias("none"), "__id", "__th", "line")
    seen = lines.filter("id is not null").select("id", place.alias("place"))
    first = seen.groupBy("id").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    label = components(similar_links(lines)).select(F.col("node").alias("id"), "component")
    classed = first.join(label, "id", "left").filter("first < last or component is not null")
    classed = stored(classed.select("id", "first", F.coalesce("component", "id").alias("class")), swept=True)
    keep = classed.groupBy("class").agg(F.min("first").alias("keep"))
    doomed = seen.join(classed.join(keep, "class").select("id", "keep"), "id").filter("place <> keep")
    return (
        doomed.groupBy(F.col("place.__id").alias("__id"), F.col("place.__th").alias("__th"))
        .agg(F.sort_array(F.collect_set("place.line")).alias("dropped"))
    )


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines (with a word), n_dropped and the numbers (from 0) of the dropped lines.

    Null and empty texts have no lines.  Repeated rows share their result; other
    columns are ignored; an empty table gives an empty table.
    """
    lines = stored(document_lines(docs, doc_id, text))
    rows = lines.filter("n_lines is not null").select("__id", "__th", "n_lines")
    joined = null_safe(rows, repeated_lines(lines), ["__id", "__th"], "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select(
        F.col("__id").alias("doc_id"), "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped_lines")
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines, all columns kept, n_chars brought up to date.

    No document goes: one whose lines all repeat keeps an empty text.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        def one(t, d):
            gone = set(d)
            return t and "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)

        return pd.Series([one(t, d) for t, d in zip(texts, dropped)], dtype=object)

    rows = docs.select(F.struct("*").alias("row"), *row_key(F.col("text"), F.col("doc_id")))
    joined = null_safe(rows, repeated_lines(stored(document_lines(docs, "doc_id", "text"))), ["__id", "__th"], "left")
    joined = joined.withColumn("__new", F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(
        cut(F.when(F.col("dropped").isNotNull(), F.coalesce("row.text", F.lit(""))), F.coalesce("dropped", F.array().cast("array<int>")))
    ))
    kinds = dict(docs.dtypes)
    changed = {"text": F.col("__new"), "n_chars": F.length("__new").cast(kinds.get("n_chars", "long"))}
    return joined.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


@query
def op3_minhash_lines(spark, sf_dir):
    return line_report(documents(spark, sf_dir))
