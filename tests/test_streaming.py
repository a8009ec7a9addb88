"""Streaming jobs: levels, crashes, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from rosterline.operators import dedup
from rosterline.plans import derived as D
from rosterline.streaming import jobs as J, levels as LV


def total(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_levels_bound_what_a_reader_opens(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    for i in range(21):
        LV.append_batch(spark.createDataFrame([(i % 3, 1), (9, 1)], "k long, n long"), i, path, total)
        for k in (i % 3, 9):
            want[k] = want.get(k, 0) + 1
        made = LV.manifest(spark, path)
        assert made["batch"] == i and all(len(level) < LV.FAN for level in made["levels"])
        assert sum(map(len, made["levels"])) <= 7
    assert rows(total(LV.read_levels(spark, path))) == sorted(want.items())
    assert len(LV._manifests(spark, path)) == LV.KEPT
    live = {f for level in LV.manifest(spark, path)["levels"] for f in level}
    assert live <= {p.name for p in (tmp_path / "t").iterdir()} and len(list((tmp_path / "t").glob("l*"))) < 21


def test_a_crash_before_the_swap_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    batch = lambda i: spark.createDataFrame([(i, 1)], "k long, n long")
    for i in range(3):
        LV.append_batch(batch(i), i, path, total)
    before = rows(LV.read_levels(spark, path))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(LV, "_publish", crash)
        with pytest.raises(RuntimeError):
            LV.append_batch(batch(3), 3, path, total)  # this batch also folds a level
    assert rows(LV.read_levels(spark, path)) == before
    LV.append_batch(batch(3), 3, path, total)
    LV.append_batch(batch(3), 3, path, total)  # a batch that comes again
    assert rows(total(LV.read_levels(spark, path))) == [(i, 1) for i in range(4)]


def test_readers_of_an_older_generation_finish(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = lambda i: spark.createDataFrame([(i, 1)], "k long, n long")
    for i in range(3):
        LV.append_batch(batch(i), i, path, total)
    old = LV.read_levels(spark, path)
    LV.append_batch(batch(3), 3, path, total)
    assert old.count() == 3 and LV.read_levels(spark, path).count() == 4


def test_partial_merges_fold_to_the_same_table(spark, sf_dir):
    contacts = D.contacts(spark, sf_dir)
    parts = [J.merge_state(contacts.filter(F.pmod(F.xxhash64("page_ord", "contact_ord"), F.lit(3)) == i)) for i in range(3)]
    folded = J.combine_state(J.combine_state(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    assert folded.columns == parts[0].columns
    got = J.read_merged(folded).select(*contacts.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, dedup.dedup_merge(contacts).collect()))


def arrive(spark, tmp_path, batches, schema):
    """One file per micro-batch; ts is given in minutes."""
    for batch in batches:
        df = spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_seconds(F.col("ts") * 60 + 1_704_067_200))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(made).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_tasks_close_once_and_late_events_are_routed(spark, tmp_path):
    batches = [
        [(1, 0, 1, "progress"), (1, 5, 2, "completed"), (2, 5, 3, "progress")],
        [(2, 30, 4, "progress"), (1, 6, 5, "progress")],  # task 1 goes on before its closing is final
        [(1, 31, 6, "error"), (3, 200, 7, "progress")],
        [(1, 40, 8, "progress"), (3, 201, 9, "progress")],  # behind the watermark of 140 minutes
        [(1, 250, 10, "completed"), (3, 400, 11, "progress")],  # opened anew
    ]
    events = arrive(spark, tmp_path, batches, "task_id long, ts long, event_id long, type string")
    query = J.write_batches(J.stream_terminal_status(events, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    minute = (F.unix_seconds("closed_at") - 1_704_067_200) / 60
    got = rows(J.read_batches(spark, str(tmp_path / "out")).select("task_id", "outcome", "type", minute.cast("long").alias("m"), "n_events"))
    assert got == [(1, "closed", "completed", 250, 1), (1, "closed", "error", 31, 4), (1, "late", "progress", 40, 1)]
    left = [p["numRowsTotal"] for x in query.recentProgress for p in x["stateOperators"]]
    assert left[-1] == 2  # the open tasks


def test_repeats_within_and_after_the_delay(spark, tmp_path):
    row = lambda n, ts: ("s", n, None, None, ts)
    batches = [[row("a", 0), row("a", 10)], [row("a", 50), row("b", 100)], [row("a", 101), row("c", 20)], [row("a", 160)]]
    schema = "site_url string, full_name string, personal_email string, phone string, ts long"
    contacts = arrive(spark, tmp_path, batches, schema).withColumnRenamed("ts", "scan_date")
    J.write_batches(J.stream_dedup_contacts(contacts, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    minute = ((F.unix_seconds("scan_date") - 1_704_067_200) / 60).cast("long")
    got = rows(J.read_batches(spark, str(tmp_path / "out")).select("full_name", minute.alias("m"), "outcome"))
    # the watermark of the third batch is 40: 20 is late, and `a` of minute 0 is remembered until 60; that of the fourth is 41
    assert got == [("a", 0, "first"), ("b", 100, "first"), ("c", 20, "late")]


CONTACT = "site_url string, full_name string, personal_email string, phone string, ts long"


def test_contacts_share_calls_and_state_rows(spark, tmp_path):
    """As many calls and state rows as there are groups, however many keys arrive."""
    groups = getattr(J, "KEY_GROUPS", 1024)
    batches = [[("s", f"n{b}-{i}", None, None, b) for i in range(2 * groups)] for b in range(2)]
    contacts = arrive(spark, tmp_path, batches, CONTACT).withColumnRenamed("ts", "scan_date")
    query = J.write_batches(J.stream_dedup_contacts(contacts, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    kept = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(kept) <= groups
    got = J.read_batches(spark, str(tmp_path / "out"))
    assert got.count() == got.filter("outcome = 'first'").select("full_name").distinct().count() == 4 * groups


def test_contacts_of_a_group_against_a_walk(spark, tmp_path, monkeypatch):
    """Many keys in few groups, several Arrow batches in a group, late rows, repeats before and after the delay, a hot key."""
    rng, name, hour = random.Random(5), "spark.sql.execution.arrow.maxRecordsPerBatch", 60
    key = lambda: (rng.choice(["s", "t", None]), rng.choice(["hot"] * 9 + [f"n{i}" for i in range(12)] + [None, ""]), None, rng.choice([None, "", "7"]))
    batches = [[(*key(), max(0, 70 * b + rng.randint(-90, 60))) for _ in range(60)] for b in range(6)]
    monkeypatch.setattr(J, "KEY_GROUPS", 3, raising=False)
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        contacts = arrive(spark, tmp_path, batches, CONTACT).withColumnRenamed("ts", "scan_date")
        J.write_batches(J.stream_dedup_contacts(contacts, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    finally:
        spark.conf.set(name, before)
    minute = ((F.unix_seconds("scan_date") - 1_704_067_200) / 60).cast("long")
    same = lambda site, name, phone, *more: (site or "-", name or "", phone or "", *more)
    got = sorted(same(*r) for r in J.read_batches(spark, str(tmp_path / "out")).select("site_url", "full_name", "phone", minute, "outcome").collect())

    want, seen, watermark = [], {}, -10**9
    for batch in batches:
        seen = {k: first for k, first in seen.items() if first + hour >= watermark}
        for site, full_name, _, phone, ts in sorted(batch, key=lambda r: r[4]):
            k = same(site, full_name, phone)
            if ts < watermark:
                want.append((*k, ts, "late"))
            elif k not in seen:
                seen[k] = ts
                want.append((*k, ts, "first"))
        watermark = max(watermark, max(r[4] for r in batch) - hour)
    assert got == sorted(want)
    firsts = [r[:3] for r in want if r[4] == "first"]
    assert len(set(firsts)) < len(firsts) and any(r[4] == "late" for r in want)
