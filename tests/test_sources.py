"""Site files, site keys and dictionaries against plain Python, over splits and odd input."""

import csv
import io
import random

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from rosterline.functions import similarity as S
from rosterline.operators import matching as M, pages as PG, site_keys as SK, skew
from rosterline.plans import derived as D
from rosterline.sources import lines as L, sinks, sites as SR


@pytest.fixture
def small_splits(spark):
    """Files are cut every 64 bytes, so that quotes and line breaks stand on both sides of a cut."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_csv(seed, sep, rows):
    rnd = random.Random(seed)
    words = ["a", "Ромашка", 'x "y" z', 'a""b', "", " ", "1\n2", "\n", "b\r\nc", sep, f'q{sep}"', "é", "end\n\n"]
    out = ["Название компании" + sep + "Сайт" + sep + "ИНН"]
    for _ in range(rows):
        cells = []
        for _ in range(rnd.randint(1, 4)):
            word = rnd.choice(words) + rnd.choice(words)
            if "\n" in word or sep in word or word.startswith('"') or rnd.random() < 0.3:
                word = '"' + word.replace('"', '""') + '"' + (rnd.choice(["", "", "tail", 'q"']) if rnd.random() < 0.2 else "")
            cells.append(word)
        out.append(sep.join(cells))
    return rnd.choice(["\n", "\r\n"]).join(out) + rnd.choice(["", "\n"])


@pytest.mark.parametrize("seed", range(6))
def test_csv_records_are_those_of_the_csv_module(spark, tmp_path, small_splits, seed):
    sep = ",;\t"[seed % 3]
    want, ahead = [], 0
    for name, rows in (("a.csv", 5), ("b.csv", 60), ("c.csv", 1)):
        text = odd_csv(seed * 7 + rows, sep, rows)
        (tmp_path / name).write_text(("﻿" if name == "b.csv" else "") + text, encoding="utf-8", newline="")
        reader, line = csv.reader(io.StringIO(text, newline=""), delimiter=sep), 0
        for cells in reader:
            want.append((name, line, ahead + line, cells or [""]))
            line = reader.line_num
        ahead += line
    got = [(r.path.rsplit("/", 1)[1], r.line, r.line_ord, r.cells) for r in L.csv_records(spark, str(tmp_path), sep).collect()]
    assert sorted(got) == want


def test_a_quote_that_never_closes_is_refused(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Сайт\n"a.ru\n' + "b.ru\n" * 40_000, encoding="utf-8")
    with pytest.raises(ValueError, match="does not close"):
        L.csv_records(spark, str(tmp_path), ",")
    (tmp_path / "e.csv").write_text("", encoding="utf-8")
    assert L.csv_records(spark, str(tmp_path / "e.csv"), ",").count() == 0


def test_lines_are_numbered_over_files(spark, tmp_path, small_splits):
    want = []
    for name, n in (("a.txt", 3), ("b.txt", 200), ("c.txt", 40)):
        rows = [f"{name}-{i}" + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_text("\n".join(rows) + "\n", encoding="utf-8")
        want += [(name, i, len(want) + i, row) for i, row in enumerate(rows)] if not want else [
            (name, i, want[-1][2] + 1 + i, row) for i, row in enumerate(rows)
        ]
    got = [(r.path.rsplit("/", 1)[1], r.line, r.line_ord, r.value) for r in L.numbered_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == want
    (tmp_path / "a.txt").write_text("one.ru\n\n# x\ntwo.ru, three.ru\n", encoding="utf-8")
    rows = SR.read_sites_txt(spark, str(tmp_path / "a.txt")).orderBy("line_ord", "part_ord").collect()
    assert [(r.line_ord, r.url) for r in rows] == [(0, "https://one.ru"), (3, "https://two.ru"), (3, "https://three.ru")]


def test_quoted_line_breaks_make_no_site(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Компания;Сайт\n"ООО\nРога";a.ru\nБ;b.ru\n', encoding="utf-8")
    rows = SR.read_sites_csv(spark, str(tmp_path / "s.csv")).orderBy("site_ord").collect()
    assert [(r.site_ord, r.url, r.company_name) for r in rows] == [(1, "https://a.ru", "ООО\nРога"), (3, "https://b.ru", "Б")]


SITE_KEYS = {
    "https://a.ru": "a.ru", "http://WWW.A.ru:80/": "a.ru", "a.ru/x/": "a.ru/x", "https://u:p@a.ru:443/X?q=1#f": "a.ru/X",
    "https://a.ru:8080/x//": "a.ru:8080/x", "HTTPS://A.RU./y": "a.ru/y", "": "", None: None,
}


def test_site_keys(spark):
    df = spark.createDataFrame([(u,) for u in SITE_KEYS], "url string")
    assert {r.url: r.k for r in df.select("url", SK.site_key(F.col("url")).alias("k")).collect()} == SITE_KEYS


def test_longest_listed_prefix_wins(spark):
    sites = [
        (2, "https://a.ru/", "A"), (1, "http://www.A.ru:80", "first"), (3, "https://a.ru/shop", "S"), (4, "https://a.ru/shop/x/", "X"),
        (5, "https://b.ru/p", "B"), (6, None, "none"), (7, "", "empty"),
    ]
    listed = spark.createDataFrame([(*s, None) for s in sites], "site_ord long, url string, company_name string, inn string")
    pages = {
        "https://a.ru/about": 1, "https://www.a.ru/shop": 3, "http://a.ru/shop/x/y/z?q": 4, "https://a.ru/shopping": 1, "https://b.ru/": None,
        "https://b.ru/p/1": 5, "https://c.ru": None, "https://a.ru:8080/shop": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(p, "https://c.ru") for p in pages], "page string, site string")
    got = {r.page: r.listed_ord for r in SK.join_sites(rows, listed, "left", "page", "site", ["page"]).collect()}
    assert got == pages
    # a page that lies under no listed site belongs to the one it was reached from
    other = spark.createDataFrame([("https://cdn.x/1", "https://a.ru/shop/"), (None, "https://b.ru/p")], "page string, site string")
    assert {r.listed_ord for r in SK.match_sites(other, listed, "page", "site").collect()} == {3, 5}


def test_similar_entries_against_all_pairs(spark, monkeypatch):
    """Several parts and blocks, long texts, ties and folded words."""
    rnd = random.Random(4)
    letters = "абвгде "
    make = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, n)))
    entries = [make(25) for _ in range(150)] + ["Главный инженер", "инженер главный", "ж" * 90 + "я" * 20]
    texts = list(dict.fromkeys([make(25) for _ in range(60)] + ["инженер  ГЛАВНЫЙ", "ж" * 80 + "я" * 20, "x" * 70, "глав инженер"]))
    dictionary = spark.createDataFrame(list(enumerate(entries)), "ord int, variant string")
    want = {}
    for text in texts:
        folded = S.sorted_tokens(text.lower())
        scores = [S.ratio(folded, S.sorted_tokens(e.lower())) for e in entries]
        if max(scores) >= 75:
            want[text] = scores.index(max(scores))
    asked = spark.createDataFrame([(t,) for t in texts], "text string")
    for part, block in ((20_000, 20_000), (9, 20)):
        monkeypatch.setattr(M, "PART", part)
        monkeypatch.setattr(M, "BLOCK", block)
        assert {r.text: r.ord for r in M.similar_entries(asked, dictionary).collect()} == want
    assert M.similar_entries(asked.limit(0), dictionary).count() == M.similar_entries(asked, dictionary.limit(0)).count() == 0


def test_own_dictionary_is_used(spark):
    contacts = spark.createDataFrame(
        [(1, 0, "Старший маг"), (1, 1, "стар маг"), (1, 2, "повар"), (1, 3, None)], "page_ord long, contact_ord long, position_raw string"
    )
    own = spark.createDataFrame([(0, "старший маг", "Маг"), (1, "младший маг", "Ученик")], "ord int, variant string, canonical string")
    got = {r.contact_ord: r.canonical for r in M.fuzzy_dictionary_join(contacts, own).collect()}
    assert got == {0: "Маг", 1: "Маг", 2: "повар", 3: None}


def test_matching_texts_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("абвг ") for _ in range(rnd.randint(0, n)))
    texts, targets = list({make(14) for _ in range(80)}), list({make(7) + "д" for _ in range(12)})
    want = {t for t in texts if any(g in t or S.partial(g, t) >= 70 for g in targets)}
    monkeypatch.setattr(M, "PART", 13)
    monkeypatch.setattr(M, "BLOCK", 5)
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    assert {r.text for r in M.matching_texts(df(texts, "text"), df(targets, "target")).collect()} == want
    assert 0 < len(want) < len(texts)


def test_running_sums_over_sampled_ranges(spark):
    """One key with all rows, null keys, ties in the order of another key."""
    df = spark.range(3000).selectExpr("id", "if(id % 50 = 0, null, if(id % 7 = 0, 1, 0)) as k", "id % 11 as v")
    out = skew.running_before(df, ["k"], ["id"], F.col("v"), None, "before")
    totals = {}
    rows = sorted(out.collect(), key=lambda r: r.id)
    assert len(rows) == 3000
    for row in rows:
        assert row.before == totals.get(row.k, 0)
        totals[row.k] = totals.get(row.k, 0) + row.v


def test_a_chain_of_pages_writes_each_page_once(spark):
    n = 12
    rows = [("https://s.ru", i, f"https://s.ru/p{i}", f'<a href="/p{i + 1}">команда</a><a href="/p{max(i - 1, 0)}">команда</a>') for i in range(n)]
    pages = spark.createDataFrame(rows, "site_url string, page_ord long, page_url string, html string")
    starts = spark.createDataFrame([("https://s.ru", "https://s.ru/p0")], "site_url string, url string")
    out = PG.expand_link_frontier(pages, starts)
    assert sorted((r.page_ord, r.depth, r.visit) for r in out.collect()) == [(i, i, i) for i in range(n)]
    assert sum(spark.read.parquet(f.rsplit("/", 1)[0]).count() for f in {x.rsplit("/", 1)[0] + "/x" for x in out.inputFiles()}) == n


def test_many_pages_of_a_walk_are_never_broadcast(spark, monkeypatch):
    """Stored levels look small by their files; the walk goes by their rows: beyond FEW_PAGES nothing is broadcast."""
    plans, number, save = [], PG.running_before, DataFrameWriter.parquet
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(PG, "FEW_PAGES", 0, raising=False)
    monkeypatch.setattr(PG, "running_before", lambda found, *args: (plan(found), number(found, *args))[1])
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (plan(self._df), save(self, path))[1])
    n = 18
    rows = [(f"https://s{s}.ru", 100 * s + i, f"https://s{s}.ru/p{i}", "".join(f'<a href="/p{i + (1 << b)}">команда</a>' for b in range(4)))
            for s in range(3) for i in range(n - 5 * s)]
    pages = spark.createDataFrame(rows, "site_url string, page_ord long, page_url string, html string")
    starts = spark.createDataFrame([(f"https://s{s}.ru", f"https://s{s}.ru/p0") for s in range(3)], "site_url string, url string")
    got = sorted((r.site_url, r.page_ord, r.depth, r.visit) for r in PG.expand_link_frontier(pages, starts).collect())
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]

    want = []
    for s in range(3):
        queue, seen = [(0, 0)], {}
        for page, depth in queue:
            if page < n - 5 * s and page not in seen:
                seen[page] = (f"https://s{s}.ru", 100 * s + page, depth, len(seen))
                # links in the order of their length, then their place
                queue += sorted(((page + (1 << b), depth + 1) for b in range(4)), key=lambda x: len(str(x[0])))
        want += seen.values()
    assert got == sorted(want)


def test_running_sums_give_the_sum_of_a_key(spark):
    df = spark.range(500).selectExpr("id", "if(id % 50 = 0, null, id % 3) as k", "id % 11 as v")
    for block in (None, F.floor(F.col("id") / 30)):
        rows = skew.running_before(df, ["k"], ["id"], F.col("v"), block, "before", "whole").collect()
        totals = {k: sum(r.v for r in rows if r.k == k) for k in {r.k for r in rows}}
        assert len(rows) == 500 and all(r.whole == totals[r.k] for r in rows)


def test_categories_are_written_by_size(spark, sf_dir, tmp_path):
    """Many tasks make no more files than categories have bytes; a rerun replaces them; a row bound splits."""
    contacts = D.contacts(spark, sf_dir).repartition(40)
    for _ in range(2):
        sinks.write_contacts_by_category(contacts, str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("*.parquet"))
    assert len(files) == len(list((tmp_path / "out").glob("category=*")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == contacts.count()
    sinks.write_contacts_by_category(contacts, str(tmp_path / "cut"), rows_per_file=10)
    assert len(list((tmp_path / "cut").rglob("*.parquet"))) > len(files)
