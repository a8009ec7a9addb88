"""Op 13: alignment of two tokenizers by galloping intersection of their token ends."""

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import documents, query, stored, text_chunks
from rosterline.llm.tokens import bpe, memory, pieces, remembered

#: White space beside a blank, or a blank at either end: such texts are cut with the slower pattern.
_CROWDED = re.compile(r"\s | \s|^\s|\s$")
#: A single blank between two other characters, where both tokenizers always end a token.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Ids of the second vocabulary stay below this in the code of a pair.
_SPAN = 1 << 20


def gallop(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(i, j) of all common values of two increasing lists.

    The shorter list drives: for each of its values the longer one is searched
    from the last place on, in steps that double until the value is passed, then by
    halving inside the last step.
    """
    if len(a) > len(b):
        return [(i, j) for j, i in gallop(b, a)]
    out, at, n = [], 0, len(b)
    for i, x in enumerate(a):
        low, step = at, 1
        while low + step < n and b[low + step] < x:
            low += step
            step *= 2
        at = bisect_left(b, x, low, min(low + step + 1, n))
        if at == n:
            break
        if b[at] == x:
            out.append((i, at))
    return out


def ends(parts: list[bytes]) -> list[int]:
    return list(accumulate(map(len, parts)))


def groups(a: list[bytes], b: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(a from, a to, b from, b to) of the smallest runs of tokens that cover the same bytes, in order.

    Common ends slice both lists; what lies between two common ends overlaps.
    """
    out, i, j = [], 0, 0
    for x, y in gallop(ends(a), ends(b)):
        out.append((i, x + 1, j, y + 1))
        i, j = x + 1, y + 1
    return out


def byte_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary file."""
    # the printable bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown}
    back.update({chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(shown))})
    tokenizer = bpe(path, True)
    special = set(tokenizer.get_added_tokens_decoder())
    out = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i) or ""
        out.append(b"" if i in special else bytes(back[c] for c in token))
    return out


def piece_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a piece model: U+2581 is a blank, <0xHH> a byte; control ids have none."""
    model = pieces(path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace("▁", " ").encode())
    return out


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes of all id pairs that can end together.

    Tokens that end at one byte end alike, so the shorter is a suffix of the
    longer: the vocabularies alone bound the number of pairs, whatever the corpus.
    """
    by_a, by_b = {}, {}
    for tokens, known in ((a, by_a), (b, by_b)):
        for i, t in enumerate(tokens):
            if t:
                known.setdefault(t, []).append(i)
    codes = {i * _SPAN + j for t, ids in by_a.items() for k in range(len(t)) for i in ids for j in by_b.get(t[k:], ())}
    codes |= {i * _SPAN + j for t, ids in by_b.items() for k in range(len(t)) for j in ids for i in by_a.get(t[k:], ())}
    return np.array(sorted(codes), dtype=np.int64)


def chunks(text: str) -> list[str]:
    """A blank and the text, cut where both tokenizers always end a token.

    The first one starts a word with the blank before it, the second one has no
    piece with a blank behind another character; so no token crosses a cut, and
    the intersection of a text is that of its chunks one behind the other.
    """
    if _CROWDED.search(text):
        return _CUT.split(" " + text)
    return [" " + word for word in text.split(" ")]


class Aligner:
    """Both tokenizers in a worker, with the aligned chunks it remembers."""

    def __init__(self, first: str, second: str):
        self.first, self.second = bpe(first, True), pieces(second)
        self.a, self.b = byte_tokens(first), piece_tokens(second)
        self.pairs = possible_pairs(self.a, self.b)
        if any(b" " in t.lstrip(b" ") for t in self.b):
            raise ValueError("a piece of the second vocabulary has a blank behind another character")
        self.known: dict = {}

    @staticmethod
    def here(first: str, second: str) -> "Aligner":
        kept = memory("aligner", first, second)
        if not kept:
            kept[0] = Aligner(first, second)
        return kept[0]

    def aligned(self, wanted: list[str]) -> list:
        """(groups as text, pair numbers, tokens of the first, of the second) of chunks; None where the bytes differ."""
        a = [e.ids for e in self.first.encode_batch_fast(wanted, add_special_tokens=False)]
        b = self.second.encode([w[1:] for w in wanted], num_threads=1)
        out, links, sizes = [], [], []
        for chunk, x, y in zip(wanted, a, b):
            left, right, whole = [self.a[i] for i in x], [self.b[i] for i in y], chunk.encode("utf-8", "surrogatepass")
            if b"".join(left) != whole or b"".join(right) != whole:
                out.append(None)
                sizes.append(0)
                continue
            found = groups(left, right)
            p, q = [str(i) for i in x], [str(i) for i in y]
            shown = ";".join([",".join(p[s:t]) + "|" + ",".join(q[u:v]) for s, t, u, v in found])
            links += [x[t - 1] * _SPAN + y[v - 1] for _, t, _, v in found]
            sizes.append(len(found))
            out.append((shown.encode(), None, len(x), len(y)))
        numbers = np.searchsorted(self.pairs, np.array(links, dtype=np.int64)).astype("<u4").tobytes()
        at = 0
        for i, n in enumerate(sizes):
            if n:
                out[i] = (out[i][0], numbers[at:at + 4 * n], *out[i][2:])
                at += 4 * n
        return out

    def texts(self, texts: list) -> list[tuple | None]:
        """Per text the list of its aligned chunks, or None where it has no tokens."""
        cut = [chunks(t) if t else [] for t in texts]
        known = remembered(self.known, [c for some in cut for c in some], self.aligned)
        out = []
        for some in cut:
            parts = [known[c] for c in some]
            out.append(None if not parts or None in parts else parts)
        return out


def token_groups(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, group (from 0) and the ids of both tokenizers that cover the same bytes of blank + text.

    A row per group and document row; texts that are null, empty or changed by a
    tokenizer have none.
    """

    def run(batches):
        aligner = Aligner.here(first, second)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in text_chunks(texts):
                rows, numbers, a, b = [], [], [], []
                for i, parts in enumerate(aligner.texts(texts[low:high]), low):
                    shown = b";".join([p[0] for p in parts]).decode().split(";") if parts else []
                    for number, group in enumerate(shown):
                        x, y = group.split("|")
                        rows.append(i)
                        numbers.append(number)
                        a.append([int(v) for v in x.split(",")])
                        b.append([int(v) for v in y.split(",")])
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int64()), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())),
                ], names=["doc_id", "group", "a", "b"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, group long, a array<int>, b array<int>")


def alignment_report(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token, group and link counts of every row, and how common its links are in the corpus.

    `first` is the file of a byte-level vocabulary, `second` that of a piece model.
    A link is a pair of tokens that end at the same byte.  Columns: doc_id, n_a,
    n_b, n_groups, n_links, n_best (links whose pair no other pair of their second
    id exceeds), count_sum (corpus counts over the links), groups_sha256.

    Links are kept per row as numbers into the table of possible pairs, whose size
    the vocabularies bound; only counts per pair are shuffled and sent back.  A null
    or empty text, or one that a tokenizer changes, has zeros and an empty digest;
    repeated rows count each; other columns are ignored; an empty table gives an
    empty table.
    """

    def align(batches):
        aligner = Aligner.here(first, second)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in text_chunks(texts):
                found = aligner.texts(texts[low:high])
                digest = [hashlib.sha256(b";".join([p[0] for p in f])).hexdigest() if f else "" for f in found]
                links = [b"".join([p[1] for p in f]) if f else b"" for f in found]
                size = lambda k: pa.array([sum([p[k] for p in f]) if f else 0 for f in found], pa.int64())  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), size(2), size(3), pa.array(digest, pa.string()), pa.array(links, pa.binary())],
                    names=["doc_id", "n_a", "n_b", "groups_sha256", "links"],
                )

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(rows.mapInArrow(align, f"doc_id {kind}, n_a long, n_b long, groups_sha256 string, links binary"))
    pairs = possible_pairs(byte_tokens(first), piece_tokens(second))

    def count(batches):
        total = np.zeros(len(pairs), dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4"), minlength=len(pairs))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["pair", "n"])

    counted = rows.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(pairs), dtype=np.int64)
    counts[counted["pair"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    most = np.zeros(_SPAN, dtype=np.int64)
    np.maximum.at(most, pairs % _SPAN, counts)
    best = counts == most[pairs % _SPAN]

    def look_up(batches):
        for batch in batches:
            links = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in batch.column(4)]
            n = pa.array([len(x) for x in links], pa.int64())
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], n, n, pa.array([int(best[x].sum()) for x in links], pa.int64()),
                pa.array([int(counts[x].sum()) for x in links], pa.int64()), batch.column(3),
            ], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(
        look_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


@query
def op13_galloping_alignment(spark, sf_dir):
    import public_tokenizers as public

    return alignment_report(documents(spark, sf_dir), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
