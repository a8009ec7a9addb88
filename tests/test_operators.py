"""Operators against brute force on small inputs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions import similarity as S
from rosterline.operators import blocklist as B, dedup, enrich, extraction as X, matching as M, pages as PG, prompts, skew
from rosterline.operators import tasks as TK
from rosterline.plans import derived as D
from rosterline.sources import sinks, sites as SR, tables as TR
from rosterline.streaming import jobs as J


def brute_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_ratio_and_partial_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("абв г") for _ in range(rng.randint(0, 9))) for _ in range(2))
        expected = 100.0 if not a and not b else 200 * brute_lcs(a, b) / (len(a) + len(b))
        assert S.ratio(a, b) == pytest.approx(expected)
        if a and b:
            short, long = sorted((a, b), key=len)
            pairs = [(short, long)] + ([(long, short)] if len(a) == len(b) else [])
            windows = [
                200 * brute_lcs(s, w) / (len(s) + len(w))
                for s, l in pairs for i, j in itertools.combinations(range(len(l) + 1), 2)
                for w in [l[i:j]] if j - i == len(s) or (j - i < len(s) and (i == 0 or j == len(l)))
            ]
            assert S.partial(a, b) == pytest.approx(max(windows))


def test_fuzzy_join_against_all_pairs(spark, sf_dir):
    contacts = D.contacts(spark, sf_dir)
    rows = M.fuzzy_dictionary_join(contacts).select("position_raw", "canonical").distinct().collect()
    entries = [*vocab.POSITIONS_RU.items(), *vocab.POSITIONS_EN.items()]

    def expected(text):
        if not text or not text.strip():
            return None
        low = text.strip().lower()
        for key, value in entries:
            if key.lower() == low:
                return value
        scored = [(S.token_sort(low, key.lower()), -i, value) for i, (key, value) in enumerate(entries)]
        best = max(scored)
        return best[2] if best[0] >= 75 else text

    assert {r.position_raw: r.canonical for r in rows} == {r.position_raw: expected(r.position_raw) for r in rows}


def test_target_join_against_all_pairs(spark, sf_dir):
    contacts, targets = D.contacts(spark, sf_dir), ["ген директор", "аналитик данных"]
    kept = {(r.page_ord, r.contact_ord) for r in M.match_targets_join(contacts, targets).collect()}

    def wanted(r):
        text = f"{r.position_raw or ''} {r.position_normalized or ''}".lower()
        return any(t in text or S.partial(t, text) >= 70 for t in targets)

    assert kept == {(r.page_ord, r.contact_ord) for r in contacts.collect() if wanted(r)}


def test_frontier_against_a_queue(spark):
    rng = random.Random(3)
    rows = []
    for site in range(4):
        for page in range(25):
            links = "".join(f'<a href="/p{rng.randint(0, 27)}{"x" * rng.randint(0, 2)}">команда</a>' for _ in range(3))
            rows.append((f"https://s{site}.ru", site * 100 + page, f"https://s{site}.ru/p{page}", links))
    pages = spark.createDataFrame(rows, "site_url string, page_ord long, page_url string, html string")
    starts = spark.createDataFrame([(f"https://s{s}.ru", f"https://s{s}.ru/p0") for s in range(4)], "site_url string, url string")
    ours = PG.expand_link_frontier(pages, starts, limit=7).collect()

    stored = {r[2]: r for r in rows}
    for site in range(4):
        queue, seen, got = [f"https://s{site}.ru/p0"], set(), []
        while queue and len(got) < 7:
            url = queue.pop(0)
            if url in seen or url not in stored:
                continue
            seen.add(url)
            got.append(url)
            found = [f"https://s{site}.ru{h}" for h in __import__("re").findall(r'href="([^"]+)"', stored[url][3])]
            queue += sorted(dict.fromkeys(found), key=len)
        mine = sorted((r for r in ours if r.site_url == f"https://s{site}.ru"), key=lambda r: r.visit)
        assert [r.url for r in mine] == got


def test_spread_join_equals_plain_join(spark):
    big = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) as k")
    small = spark.range(30).selectExpr("id as k", "id * 10 as v")
    for how in ("left", "inner", "left_semi", "left_anti"):
        ours = skew.spread_join(big, small, ["k"], how, ["id"]).collect()
        plain = big.join(small, ["k"], how).collect()
        assert sorted(map(tuple, ours), key=repr) == sorted(map(tuple, plain), key=repr)


def test_running_before_equals_window(spark):
    df = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 0, id % 7) as k", "id % 11 as v")
    ours = skew.running_before(df, ["k"], ["id"], F.col("v"), F.floor(F.col("id") / 64), "before").collect()
    totals = {}
    for row in sorted(ours, key=lambda r: r.id):
        assert row.before == totals.get(row.k, 0)
        totals[row.k] = totals.get(row.k, 0) + row.v


def test_merge_does_not_depend_on_row_order_and_is_stable(spark, sf_dir):
    contacts = D.contacts(spark, sf_dir)
    once = dedup.dedup_merge(contacts)
    again = dedup.dedup_merge(once)
    shuffled = dedup.dedup_merge(contacts.orderBy(F.desc("page_ord")))
    as_set = lambda df: sorted(map(str, df.collect()))
    assert as_set(once) == as_set(again) == as_set(shuffled)


def test_targets_choose_text_when_no_block_matches(spark):
    card = '<div class="card"><h3>Иванов Иван Иванович,</h3><p class="role">Слесарь</p></div>'
    text = "<p>Президент: Петров Пётр Петрович, p.petrov@x.ru</p>"
    pages = spark.createDataFrame(
        [("https://a.ru", 1, "https://a.ru/1", card + text), ("https://b.ru", 2, "https://b.ru/2", card)],
        "site_url string, page_ord long, page_url string, html string",
    )
    assert {r.full_name for r in X.extract_contacts(pages).collect()} == {"Иванов Иван Иванович"}
    # on a.ru no card fits, so the text is read: both names stand near the title
    rows = X.extract_contacts(pages, ["президент"]).collect()
    assert {(r.site_url, r.full_name, r.position_raw) for r in rows} == {
        ("https://a.ru", "Иванов Иван Иванович", "Президент"), ("https://a.ru", "Петров Пётр Петрович", "Президент"),
    }


def test_blocklist_round_trip(spark, tmp_path):
    (tmp_path / "list.txt").write_text("﻿# c\n\nhttps://www.Spam.ru/x\nA@b.ru\n7707083893\nno\n", encoding="utf-8")
    found = TR.read_blocklist_text(spark, str(tmp_path / "list.txt"))
    assert sorted(map(tuple, found.collect())) == [("domain", "spam.ru"), ("email", "a@b.ru"), ("inn", "7707083893")]
    sinks.save_blocklist(found, str(tmp_path / "out"))
    assert sorted(map(tuple, TR.read_saved_blocklist(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, found.collect()))
    rows = spark.createDataFrame([(1, "https://shop.spam.ru/a"), (2, "https://notspam.ru")], "i int, url string")
    assert [r.i for r in B.block_domains(rows, "url", found, ["i"]).collect()] == [2]
    assert [r.i for r in B.blocked_by_domain(rows, "url", found, ["i"]).collect()] == [1]


def test_blocklist_csv_keeps_long_lines(spark, tmp_path):
    (tmp_path / "l.csv").write_text('a.ru\n"b.ru",c.ru,"d.ru"\n', encoding="utf-8")
    assert sorted(r.value for r in TR.read_blocklist_csv(spark, str(tmp_path / "l.csv")).collect()) == ["a.ru", "b.ru", "c.ru", "d.ru"]


def test_site_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿Компания;Сайт;ИНН\nА;a.ru;1\nБ;;2\n;https://c.ru;\n", encoding="utf-8")
    rows = SR.read_sites_csv(spark, str(tmp_path / "s.csv")).orderBy("site_ord").collect()
    assert [(r.url, r.company_name, r.inn) for r in rows] == [("https://a.ru", "А", "1"), ("https://Б", "Б", "2"), ("https://c.ru", None, None)]
    (tmp_path / "s.txt").write_text("# x\n1. one.ru, two.ru\nabc\n1c.ru;https://t.ru\n", encoding="utf-8")
    urls = [r.url for r in SR.read_sites_txt(spark, str(tmp_path / "s.txt")).orderBy("line_ord", "part_ord").collect()]
    assert urls == ["https://one.ru", "https://two.ru", "https://1c.ru", "https://t.ru"]


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"Б": "1", "А": "2"}', encoding="utf-8")
    rows = TR.read_position_dictionary(spark, [str(tmp_path / "d.json")]).orderBy("ord").collect()
    assert [(r.variant, r.canonical) for r in rows] == [("Б", "1"), ("А", "2")]


def test_written_categories(spark, sf_dir, tmp_path):
    contacts = D.contacts(spark, sf_dir)
    sinks.write_contacts_by_category(contacts, str(tmp_path / "out"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == contacts.count()
    assert set(vocab.EXPORT_COLUMNS) < set(back.columns)


def test_corrections_without_rows_change_nothing(spark, sf_dir):
    contacts = D.contacts(spark, sf_dir)
    none = spark.createDataFrame(
        [], "site_url string, idx long, company_name string, full_name string, position string, personal_email string, company_email string, phone string"
    )
    ours = enrich.apply_corrections(contacts, none).select(*contacts.columns).collect()
    assert sorted(map(str, ours)) == sorted(map(str, contacts.collect()))


def test_merge_over_several_batches_equals_one(spark, sf_dir, tmp_path):
    """Contacts arriving in shuffled pieces merge to the same table, and a batch
    that runs twice does not count twice."""
    contacts = D.contacts(spark, sf_dir)
    for i in range(3):
        part = contacts.filter(F.xxhash64("page_ord", "contact_ord") % 3 == F.lit(i - 1))
        J.merge_state(part).write.mode("overwrite").parquet(str(tmp_path / f"batch={i}"))
        J.merge_state(part).write.mode("overwrite").parquet(str(tmp_path / f"batch={i}"))
    whole = contacts.filter((F.xxhash64("page_ord", "contact_ord") % 3).between(-1, 1))
    merged = J.read_merged(J.read_batches(spark, str(tmp_path))).select(*contacts.columns)
    assert sorted(map(str, merged.collect())) == sorted(map(str, dedup.dedup_merge(whole).collect()))


def test_hot_keys_are_cut_before_the_shuffle(spark, sf_dir):
    """Row limits per site and first-row rules are applied on the map side."""
    pages = TR.read_pages(spark, f"{sf_dir}/pages.parquet")
    capped = PG.cap_pages_per_site(pages.select("site_url", "page_ord"), ["page_ord"], limit=10)
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    first = dedup.dedup_name_email_phone(D.contacts(spark, sf_dir))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_every_name_of_a_page_is_a_contact(spark):
    first = ["Иван", "Пётр", "Лев", "Олег", "Глеб"]
    last = ["Громов", "Зуев", "Белов", "Серов", "Жданов"]
    names = [f"{a} {b} Олегович" for a in last for b in first]
    page = [("https://a.ru", 1, "https://a.ru/1", "<p>" + "; ".join(names) + "</p>")]
    pages = spark.createDataFrame(page, "site_url string, page_ord long, page_url string, html string")
    assert [r.full_name for r in X.extract_contacts(pages).orderBy("contact_ord").collect()] == names
    assert X.extract_contacts(pages, max_names=20).count() == 20


def test_names_in_character_references_are_found(spark):
    """Letters by name, by number, and an ampersand in front of a letter."""
    from html.entities import html5

    by_char = {v: k for k, v in html5.items() if k.endswith("cy;")}
    plain = ["Громов Иван Олегович", "Зуева Анна Петровна"]
    named = ["".join(f"&{by_char[c]}" if c in by_char else c for c in n) for n in plain]
    numbered = ["".join(f"&#{ord(c)};" for c in n) for n in plain]
    rows = [("https://a.ru", i, f"https://a.ru/{i}", f"<p>AT&T {a}; {b}</p>") for i, (a, b) in enumerate([plain, named, numbered])]
    pages = spark.createDataFrame(rows, "site_url string, page_ord long, page_url string, html string")
    found = {}
    for r in X.extract_contacts(pages).orderBy("page_ord", "contact_ord").collect():
        found.setdefault(r.page_ord, []).append(r.full_name)
    assert found == {0: plain, 1: plain, 2: plain}


def test_long_page_texts_go_on_in_parts(spark):
    pages = spark.createDataFrame([(1, "u", None, "ab" * 700), (2, "u", "c", ""), (3, "u", "c", None)], "page_ord long, page_url string, company_name string, text string")
    rows = prompts.page_prompts(pages, part_chars=1000).orderBy("page_ord", "part").collect()
    assert [(r.page_ord, r.part) for r in rows] == [(1, 0), (1, 1), (2, 0), (3, 0)]
    assert "".join(r.prompt.split("Текст страницы:\n")[1] for r in rows[:2]) == "ab" * 700


def test_refused_requests_use_nothing(spark):
    calls = spark.createDataFrame([("s", i, 60, 0) for i in range(5)], "session string, i int, tokens_prompt int, tokens_completion int")
    out = TK.token_budget_cutoff(calls, ["session"], ["i"], F.col("i"), budget=100).orderBy("i").collect()
    assert [(r.used_before, r.refused) for r in out] == [(0, False), (60, False), (120, True), (120, True), (120, True)]


def test_html_stays_out_of_shuffles(spark, sf_dir):
    """With no broadcast to lean on, the way from pages to contacts shuffles no html and scans it once."""
    pages = TR.read_pages(spark, f"{sf_dir}/pages.parquet")
    blocked = spark.createDataFrame([("domain", "spam.ru")], "kind string, value string")
    keys = B.block_domains(pages.select("site_url", "page_ord", "page_url"), "site_url", blocked, ["page_ord"])
    contacts = X.extract_contacts(PG.drop_captcha_pages(pages))
    joined = contacts.join(PG.first_pages(keys), ["site_url", "page_ord"], "left_semi")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    nodes = [x for x in re.split(r"\n\n+", plan) if x.startswith("(")]
    moved = [x for x in nodes if "Exchange" in x.splitlines()[0]]
    assert moved and not any("html#" in x for x in moved)
    assert sum("html" in x for x in nodes if "Scan parquet" in x.splitlines()[0]) == 1
