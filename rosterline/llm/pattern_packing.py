"""Op 12: best-fit packing by length patterns, fitted to the histogram with non-negative least squares."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import documents, query, ranked, stored
from rosterline.llm.tokens import bpe, memory, remembered

CAPACITY = 4096
#: Id behind every document.
END = 1
#: A pattern fills a sequence, a quarter of one or a sixteenth; the smaller ones stand as often in a sequence.
SHARES = (1, 4, 16)
#: ASCII signs that end a word, without the apostrophe.
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'"))
#: Words encoded in one call: what it returns takes about a kilobyte a word.
ENCODED = 1 << 13
#: Rounds of the least-squares fit; a fit ends earlier when no pattern lowers the error by much.
ROUNDS = 30


def parts(word: bytes) -> tuple[bytes, bytes]:
    """A run without white space as (body, closing signs), in lower case: encoded apart they give the ids of the run.

    The tokenizer lowers letters and starts anew between a letter or digit and a
    sign.  Apostrophes, which may begin a contraction, and runs that may hold the
    name of a special token are left as they are.
    """
    if b"<|" in word:
        return word, b""
    word = word.lower()
    body = word.rstrip(_SIGNS)
    letter = body[-1:].isalnum() or (body[-2:-1] == b"\xc3" and body[-1:] not in (b"\x97", b"\xb7"))
    return (body, word[len(body):]) if letter else (word, b"")


def size_chunks(sizes: np.ndarray, most: int = 1 << 21):
    """Ranges of consecutive texts of at most about `most` bytes, or one text."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, end
        at = end


def word_runs(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(runs, first): the runs without white space of all texts, each different one once in the
    dictionary, and the number of every text's first run.  Null texts have no runs; an empty run
    stands where white space begins or ends a text, and for an empty text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    runs = split.flatten().cast(pa.large_binary()).dictionary_encode()
    return runs, np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))).astype(np.int64)


def gathered(found: list[bytes], runs: np.ndarray, first: np.ndarray, last: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, limits): the ids of all texts, `last` behind each, and where every text starts.

    `found` holds the ids of each different run, `runs` the numbers of the texts'
    runs in order, `first` the place there of each text's first one.
    """
    pool = np.frombuffer(b"".join([*found, last]), dtype="<u4")
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    starts = np.cumsum(sizes) - sizes
    order = np.insert(runs.astype(np.int64), first[1:], len(found))
    sizes, starts = np.append(sizes, 1)[order], np.append(starts, len(pool) - 1)[order]
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    limits = np.concatenate(([0], ends[first[1:] + np.arange(len(first) - 1)]))
    return pool[places], limits


def word_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of every whole text and `end`, cut only where over `capacity`.

    The tokenizer drops white space and never joins what it separates, so ids are
    found per distinct run of other characters and kept by the worker; a run is
    taken apart once more (see `parts`), as words come with many endings.
    """

    def encoded(words: list) -> list:
        out = []
        for at in range(0, len(words), ENCODED):
            some = [w.decode("utf-8", "surrogatepass") for w in words[at:at + ENCODED]]
            found = bpe(tokenizer).encode_batch_fast(some, add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in found]
        return out

    def joined(words: list) -> list:
        cut = [parts(w) for w in words]
        known = remembered(memory("parts", tokenizer), [p for pair in cut for p in pair], encoded)
        return [known[body] + known[tail] for body, tail in cut]

    def cut(batches):
        known, last = memory("ids", tokenizer), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high in size_chunks(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                some = texts.slice(low, high - low)
                if not pc.any(pc.match_substring(some, "<|")).as_py():  # as in `parts`
                    some = pc.ascii_lower(some)
                runs, first = word_runs(some)
                words = [w or b"" for w in runs.dictionary.to_pylist()]
                remembered(known, words, joined)
                found = [known[w] for w in words]
                data, limits = gathered(found, runs.indices.to_numpy(), first, last)
                lengths = np.diff(limits)
                pieces = -(-lengths // capacity)
                rows = np.repeat(np.arange(low, high), pieces)
                numbers = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                starts = numbers * capacity
                sizes = np.minimum(lengths[rows - low] - starts, capacity)
                at = limits[rows - low] + starts
                view = memoryview(data.view(np.uint8))
                sums = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + sizes).tolist())]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fitted_patterns(counts: np.ndarray, capacity: int) -> list[tuple[float, tuple]]:
    """(repeats, lengths) of patterns of at most three lengths that fill `capacity` exactly.

    Non-negative least squares of (patterns x repeats - histogram): coordinate
    descent with an active set.  Every round walks the lengths from the longest
    down and takes, of all patterns through a length, the one along which the
    error falls fastest; then the repeats of all patterns taken so far are solved
    again one by one, never below zero.  `counts` is indexed by length and its
    size is bounded by the capacity, whatever the number of documents.
    """
    rest = np.zeros(capacity + 1)
    some = min(len(counts), capacity + 1)
    rest[:some] = counts[:some]
    rest[0] = 0
    there = rest > 0
    there[0] = True  # no third, or no second, part
    repeats: dict[tuple, float] = {}
    longest = [int(i) for i in np.flatnonzero(there)[::-1] if 3 * i >= capacity]
    others = {}
    for i in longest:
        j = np.arange((capacity - i + 1) // 2, min(i, capacity - i) + 1)
        others[i] = j[there[j] & there[capacity - i - j]]
    many = float(counts.sum())
    for _ in range(ROUNDS):
        gained = 0.0
        for i in longest:
            j = others[i]
            if len(j) == 0:
                continue
            slope = rest[j] + rest[capacity - i - j]
            parts_of = 1 + (j > 0) + (capacity - i - j > 0)
            best = int(np.argmax((slope + rest[i]) / np.sqrt(parts_of)))
            parts = tuple(int(x) for x in (i, j[best], capacity - i - j[best]) if x)
            gained += _step(parts, repeats, rest)
        for _ in range(2):
            for parts in repeats:
                gained += _step(parts, repeats, rest)
        if gained < 1e-4 * many:
            break
    return [(n, parts) for parts, n in repeats.items() if n > 0]


def _step(parts: tuple, repeats: dict, rest: np.ndarray) -> float:
    """Solve for the repeats of one pattern, all others fixed; gives the size of the change."""
    size = sum(parts.count(p) for p in parts)  # the squared norm of its column
    old = repeats.get(parts, 0.0)
    new = max(0.0, old + sum(rest[p] for p in parts) / size)
    if new == old:
        return 0.0
    for p in parts:
        rest[p] -= new - old
    repeats[parts] = new
    return abs(new - old)


def rounded(fit: list[tuple[float, tuple]], counts: np.ndarray, copies: int) -> list[tuple[int, dict]]:
    """Whole repeats of patterns, largest first, each bounded by what is left; lowers `counts` by what they take.

    A sequence holds `copies` of its pattern.
    """
    out = []
    for n, parts in sorted(fit, key=lambda x: (-x[0], x[1])):
        taken = {p: copies * parts.count(p) for p in parts}
        whole = min(int((n + 0.5) // copies), *(int(counts[p] // m) for p, m in taken.items()))
        if whole > 0:
            for p, m in taken.items():
                counts[p] -= whole * m
            out.append((whole, taken))
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, dict]]:
    """Best-fit decreasing of a histogram: the longest first, each into the fullest sequence that has room.

    Sequences of equal content are one entry with a number, so the work depends
    on how many lengths there are and not on how many documents.
    """
    open_, closed = {}, []
    room = np.zeros(capacity + 1, dtype=bool)

    def put(n, space, content):
        if n and space:
            open_.setdefault(space, []).append((n, content))
            room[space] = True
        elif n:
            closed.append((n, content))

    for length in [int(x) for x in np.flatnonzero(counts)[::-1]]:
        left = int(counts[length])
        while left:
            fit = length + int(np.argmax(room[length:])) if room[length:].any() else 0
            if fit:
                n, content = open_[fit].pop()
                if not open_[fit]:
                    room[fit] = False
                space = fit
            else:
                n, content, space = -(-left // (capacity // length)), {}, capacity
            each = space // length
            full = min(n, left // each)
            put(full, space - each * length, {**content, length: each})
            left, n = left - full * each, n - full
            if left and n:  # fewer than one more sequence takes
                put(1, space - left * length, {**content, length: left})
                left, n = 0, n - 1
            put(n, space, content)
    return closed + [x for some in open_.values() for x in some]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict]]:
    """(number of sequences, {length: times}) for all lengths of a histogram indexed by length.

    Patterns over the whole capacity come first, then those over its parts; what
    rounding leaves is packed by best fit.  The depth that needs the fewest
    sequences in all is taken.
    """
    left, taken, best = counts.astype(np.int64).copy(), [], None
    for copies in SHARES:
        if capacity % copies:
            break
        part = capacity // copies
        taken = taken + rounded(fitted_patterns(left[: part + 1], part), left, copies)
        found = taken + best_fit(left, capacity)
        total = sum(n for n, _ in found)
        if best is None or total < best[0]:
            best = (total, found)
    return best[1]


def slots(sequences: list[tuple[int, dict]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), sorted by length and rank.

    Documents of a length are numbered from 0; `times` of them in a row stand in
    one sequence, the next ones in the next sequence of the same content.
    """
    used: dict[int, int] = {}
    rows, at = [], 0
    for n, content in sequences:
        offset = 0
        for length, times in sorted(content.items(), reverse=True):
            rows.append((length, used.get(length, 0), times, at, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * times
        at += n
    found = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def pack_sequences(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of every document with its place in a sequence of at most `capacity` ids.

    Columns: doc_id, piece (from 0), start (ids of the document before it),
    length, ids_crc32, sequence_id (gapless from 0), offset (gapless in the
    sequence).  Only the histogram of piece lengths (at most `capacity` cells)
    reaches the driver; the plan made of it has a size bounded by the capacity,
    and every piece finds its place by its rank among pieces of its length.

    A null or empty text is the id `end` alone; repeated rows get places of their
    own; a null doc_id stays null; other columns are ignored; an empty table
    gives an empty table.
    """
    cut = stored(word_pieces(docs, tokenizer, capacity, end, doc_id, text))
    cells = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[cells["length"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy(dtype=np.int64)
    table = slots(plan(counts, capacity))
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            row = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            since = rank - row[:, 1]
            sequence, offset = row[:, 3] + since // row[:, 2], row[:, 4] + since % row[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = dict(cut.dtypes)["doc_id"]
    return ranked(cut, ["length"], "rank").mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


@query
def op12_pattern_packing(spark, sf_dir):
    import public_tokenizers

    return pack_sequences(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
