"""Merkle manifest, pattern packing and tokenizer alignment against brute force, on the given tables and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as public
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rosterline.llm import alignment, merkle, pattern_packing as packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, level int, `length` long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
PARTS = ["a", "b", "The", " ", "  ", "\n", "\t", ".", "'s", "é", "ΑΣ", "́", "▁", "中文", " ", " ", "\x1c", "\x85",
         "<|endoftext|>", "<s>", "<0x41>", "12", "２", "😀", "ſ", "İ", "\x00"]
A, B, W = (public.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(3)
    texts = {i: "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for i in range(300)}
    texts.update({300: None, 301: "", 302: LONG, 303: "x" * 5000, 304: "one\ntwo\nthree", 305: " two  blanks ", 306: "one\ntwo\nthree"})
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else [None, "é", "s2"][i % 9 // 3], len(t or ""), "r", 1, i) for i, t in texts.items()]
    rows += [rows[0], rows[4], rows[304], rows[304], (None, "no\nid", None, "lone", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The top and, for each leaf, the (place, siblings) of every level."""
    ways, own, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        above, owned = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for j in range(len(run)):
                for i in own[at + j]:
                    ways[i].append((j, run[:j] + run[j + 1:]))
            above.append(sha("".join(run)))
            owned.append(sum(own[at:at + 3], []))
        nodes, own = above, owned
    return nodes[0], ways


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_manifest(table, request):
    df = request.getfixturevalue(table)
    rows, by, want = df.collect(), {}, []
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, found = [], []
    for q, source in enumerate(sources):
        ordered = sorted(by[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        top, ways = tree([leaf(r, r["text"]) for r in ordered])
        tops.append(top)
        found += [(r, q, way) for r, way in zip(ordered, ways)]
    root, above = tree(tops) if tops else (None, [])
    for r, q, way in found:
        text, way = r["text"], way + above[q]
        if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        digest = leaf(r, text)
        for place, run in way:
            digest = sha("".join(run[:place] + [digest] + run[place:]))
        siblings = "".join(x for _, run in way for x in run)
        want.append((r["doc_id"], leaf(r, r["text"]), tops[q], root, sha(siblings), digest, digest == root, siblings))
    got = merkle.manifest(df, merkle.without_breaks())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_paths_over_several_passes(spark, monkeypatch):
    """Groups of nine nodes and shuffled self-joins give the tree that one group gives."""
    df = spark.range(700).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', concat('s', id % 31)) as source", "'x' as lang", "1 as n_chars", "cast(id as string) as text")
    one = sorted(map(tuple, merkle.manifest(df).collect()))
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "FEW", 3)
    two = sorted(map(tuple, merkle.manifest(df).collect()))
    assert one == two and all(r[6] for r in one) and len({r[3] for r in one}) == 1
    single = merkle.manifest(df.filter("doc_id = 5")).first()
    assert single["leaf"] == single["subroot"] == single["root"] == single["folded_root"]
    assert single["proof"] == "" and single["proof_sha256"] == sha("")


def test_a_changed_field_does_not_verify(spark):
    df = spark.range(50).selectExpr("id as doc_id", "'a' as source", "'x' as lang", "1 as n_chars", "'text' as text")
    from pyspark.sql import functions as F

    got = merkle.manifest(df, F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text"))).collect()
    assert [r["doc_id"] for r in got if not r["verified"]] == [7]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_plan_packs_every_document(lengths):
    counts = np.bincount(np.array(lengths, dtype=np.int64), minlength=65)
    total = np.zeros(65, dtype=np.int64)
    for n, content in packing.plan(counts, 64):
        assert n > 0 and 0 < sum(x * m for x, m in content.items()) <= 64
        for x, m in content.items():
            total[x] += n * m
    assert (total == counts).all()


def test_plan_is_near_the_lower_bound():
    rnd = np.random.RandomState(5)
    for many in (100, 3000, 1_000_000):
        lengths = np.minimum(4096, rnd.lognormal(6.3, 1.0, 3000).astype(np.int64) + 1)
        counts = np.bincount(lengths, minlength=4097) * (many // 100)
        need = -(-int((counts * np.arange(4097)).sum()) // 4096)
        assert sum(n for n, _ in packing.plan(counts)) <= need * 1.002 + 2


def test_fit_is_least_squares():
    """No pattern can lower the error, and none that is used can by standing less often."""
    counts = np.zeros(25, dtype=np.int64)
    counts[[3, 5, 7, 8, 9, 10, 12, 14, 16, 17, 19, 21]] = [40, 30, 20, 55, 9, 31, 12, 10, 25, 8, 30, 13]
    fit = packing.fitted_patterns(counts, 24)
    rest = counts.astype(float)
    for n, parts in fit:
        assert n > 0 and sum(parts) == 24
        for p in parts:
            rest[p] -= n
    slopes = {parts: sum(rest[p] for p in parts) for parts in {
        tuple(sorted(x for x in (i, j, 24 - i - j) if x)) for i in range(1, 25) for j in range(0, 25 - i)
        if all(counts[x] > 0 for x in (i, j, 24 - i - j) if x)
    }}
    assert max(slopes.values()) < 1 and all(abs(slopes[tuple(sorted(p))]) < 1 for _, p in fit)


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_pattern_packing(table, request):
    df = request.getfixturevalue(table)
    own, want = Tokenizer.from_file(W), Counter()
    for r in df.collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 4096):
            part = ids[at:at + 4096]
            want[r["doc_id"], at // 4096, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack_sequences(df, W)
    assert dict(got.dtypes)["piece"] == "int"
    rows, placed = got.collect(), {}
    assert Counter(tuple(r)[:5] for r in rows) == want
    for r in rows:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    need = -(-sum(r["length"] for r in rows) // 4096)
    assert len(placed) <= need * 1.02 + 1 and sorted(placed) == list(range(len(placed)))


@pytest.mark.parametrize("table", [[], [None], ["", None, ""], [" a\tb\x0bc\x0c d\r\n", None, "a\x1cb\x1fc\x85d", "", "a  é a", "\n", "中 x y"]])
def test_runs_of_many_texts_are_looked_up_once(table):
    runs, first = packing.word_runs(pa.array(["out", *table, "out"], pa.string()).slice(1, len(table)))
    known = runs.dictionary.to_pylist()
    assert len(known) == len(set(known)) and set(known) - {b""} == {w for t in table for w in (t or "").encode().split()}
    ids = [b"".join(np.uint32(10 * i + k).tobytes() for k in range(i % 3 if w else 0)) for i, w in enumerate(known)]
    data, limits = packing.gathered(ids, runs.indices.to_numpy(), first, np.uint32(1).tobytes())
    of = dict(zip(known, ids))
    want = [b"".join(of[w] for w in (t or "").encode().split()) + np.uint32(1).tobytes() for t in table]
    assert [data[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:])] == want
    sizes = np.array([len(t or "") for t in table], dtype=np.int64)
    for most in (1, 5, 100):
        ranges = list(packing.size_chunks(sizes, most))
        assert [i for a, b in ranges for i in range(a, b)] == list(range(len(table)))
        assert all(b == a + 1 or sizes[a:b].sum() <= most for a, b in ranges)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_gallop(a, b):
    x, y = sorted(a), sorted(b)
    assert alignment.gallop(x, y) == [(x.index(v), y.index(v)) for v in sorted(a & b)]


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_alignment(table, request):
    df = request.getfixturevalue(table)
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    bytes_a, bytes_b = alignment.byte_tokens(A), alignment.piece_tokens(B)
    found, counts = [], Counter()
    for r in df.collect():
        text = r["text"]
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            found.append((r["doc_id"], 0, 0, [], []))
            continue
        ends, at = {}, 0
        for k, i in enumerate(a):
            at += len(bytes_a[i])
            ends[at] = k
        at, s, u, shown, links = 0, 0, 0, [], []
        for k, i in enumerate(b):
            at += len(bytes_b[i])
            if at in ends:
                shown.append(",".join(map(str, a[s:ends[at] + 1])) + "|" + ",".join(map(str, b[u:k + 1])))
                links.append((a[ends[at]], i))
                s, u = ends[at] + 1, k + 1
        counts.update(links)
        found.append((r["doc_id"], len(a), len(b), shown, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    want = [
        (d, a, b, len(shown), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(";".join(shown)) if shown else "")
        for d, a, b, shown, links in found
    ]
    got = alignment.alignment_report(df, A, B)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    per = Counter(r["doc_id"] for r in alignment.token_groups(df, A, B).collect())
    assert per == Counter({d: 0 for d in ()}) + Counter(d for d, *_, shown, _ in found for _ in shown)
