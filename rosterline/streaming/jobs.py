"""Structured Streaming jobs: pages and progress events that keep arriving.

Sinks are folders of one sub-folder per micro-batch, overwritten by batch id: a
batch that runs twice after a failure leaves the same result once.
"""

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from rosterline.functions.text import empty_to_null
from rosterline.operators.dedup import MERGED_FIELDS, _text_key
from rosterline.operators.extraction import extract_contacts
from rosterline.operators.skew import earliest
from rosterline.schemas import CONTACT_ORDER, TERMINAL_EVENTS
from rosterline.streaming.levels import append_batch, remove_folder

#: Days by which the column that carries the watermark lies ahead of the event time.
AHEAD = 36_500
#: Groups that the keys of contacts are dealt into by their hash.  A group is one call of Python a micro-batch and one row
#: of state, so a stream that goes on behind a checkpoint must keep the number.
KEY_GROUPS = 1024
#: Formats that keep a row whole on its way through a state function.
_STAMP, _STAMP_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
    shape: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Write every micro-batch to its own folder; stops when input is used up."""
    def save(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_extract_contacts(pages: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Contacts of arriving pages.  The plan is the batch one: without targets it
    needs no state and no shuffle."""
    return extract_contacts(pages, targets)


def _millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _marked(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """`rows` with _ts, the event time in milliseconds, and _mark, which carries the watermark.

    Spark drops late rows before a stateful operator sees them; here they must
    arrive, to be routed.  _mark lies AHEAD days after the event time and the
    delay is longer by as much, so the watermark is the same as that of `ts` and no
    row lies behind it.
    """
    mark = F.timestamp_millis(F.unix_millis(F.col(ts)) + AHEAD * 86_400_000)
    marked = rows.select("*", F.unix_millis(F.col(ts)).alias("_ts"), mark.alias("_mark"))
    return marked.withWatermark("_mark", f"{AHEAD} days {_millis(delay)} milliseconds")


def _packed(rows: DataFrame, ts: str, delay: str, keys: list[Column]) -> DataFrame:
    """(_key, _ts, _row, _mark): a string key, the event time and the whole row."""
    whole = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"timestampFormat": _STAMP, "timestampNTZFormat": _STAMP_NTZ})
    key = F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    return _marked(rows, ts, delay).select(key.alias("_key"), "_ts", whole.alias("_row"), "_mark")


def _unpacked(rows: DataFrame, like: DataFrame, *more: str) -> DataFrame:
    row = F.from_json("_row", like.schema, {"timestampFormat": _STAMP, "timestampNTZFormat": _STAMP_NTZ})
    return rows.select(row.alias("_r"), *more).select("_r.*", *more)


def stream_dedup_contacts(contacts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First arrivals per site, name, email and phone, and late rows: the columns and `outcome`.

    A row is late if its scan_date lies before the watermark (the latest scan_date of
    the earlier micro-batches less `delay`); late rows come out as `late`, whatever
    they hold, and change no state.  Of the others the earliest of a key comes out
    as `first`, and a repeat is left out.  A key is forgotten when the watermark
    has passed its first row by `delay`, so the state holds the keys of that time
    span only (a group without rows goes when its last key does), and a repeat after
    it is a first one again.

    Keys are dealt into KEY_GROUPS groups: a call of the state function costs
    milliseconds whatever it holds, so one for each key would take hours for
    millions of them.  A call keeps one row for each new key of its group.
    """
    span = _millis(delay)

    def remember(key, frames, state):
        watermark = state.getCurrentWatermarkMs()
        firsts = state.get[0] if state.exists else {}
        firsts = {k: first for k, first in firsts.items() if first + span >= watermark}
        new: dict[str, tuple] = {}
        for rows in () if state.hasTimedOut else frames:  # one Arrow batch at a time: a key may hold a large share of the rows
            late = rows["_ts"] < watermark
            if late.any():
                yield rows.loc[late, ["_row"]].assign(outcome="late")
                rows = rows[~late]
            for k, ts, row in zip(rows["_key"], rows["_ts"].fillna(float("inf")), rows["_row"]):
                if k not in firsts and (k not in new or (ts, row) < new[k]):
                    new[k] = (ts, row)
        if new:
            yield pd.DataFrame({"_row": [row for _, row in new.values()], "outcome": "first"})
            firsts |= {k: int(ts) for k, (ts, _) in new.items()}
        if firsts:
            state.update((firsts,))
            state.setTimeoutTimestamp(max(max(firsts.values()) + span, watermark + 1))
        elif state.exists:
            state.remove()

    filled = [F.coalesce(F.col(c), F.lit("")) for c in ("full_name", "personal_email", "phone")]
    packed = _packed(contacts, "scan_date", delay, [F.col("site_url"), *filled])
    grouped = packed.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(KEY_GROUPS)).cast("int"))
    found = grouped.groupBy("_group").applyInPandasWithState(
        remember, "_row string, outcome string", "firsts map<string, long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return _unpacked(found, contacts, "outcome")


def merge_state(contacts: DataFrame) -> DataFrame:
    """Partial merge of one batch: per person the first row and, for each field,
    its earliest value with the place it came from.

    Partial merges of different batches merge again to the same result, so a
    batch costs its own size and the kept table is never rewritten.
    """
    keep = [c for c in contacts.columns if c not in MERGED_FIELDS]
    ready = contacts.withColumns({c: empty_to_null(F.col(c)) for c in MERGED_FIELDS})
    place = F.struct(*CONTACT_ORDER)
    return ready.groupBy(
        F.col("site_url").alias("key_site"), _text_key("full_name").alias("key_name"),
        _text_key("company_name").alias("key_company"),
    ).agg(
        F.min(place).alias("row_place"),
        F.min_by(F.struct(*keep), place).alias("row"),
        *[F.min(F.when(F.col(c).isNotNull(), place)).alias(f"place_{c}") for c in MERGED_FIELDS],
        *[earliest(c, CONTACT_ORDER).alias(c) for c in MERGED_FIELDS],
    )


def combine_state(state: DataFrame) -> DataFrame:
    """Partial merges folded into one per person, with the same columns."""
    return state.groupBy("key_site", "key_name", "key_company").agg(
        F.min("row_place").alias("row_place"), F.min_by("row", "row_place").alias("row"),
        *[F.min(f"place_{c}").alias(f"place_{c}") for c in MERGED_FIELDS],
        *[F.min_by(c, f"place_{c}").alias(c) for c in MERGED_FIELDS],
    )


def read_merged(state: DataFrame) -> DataFrame:
    """The kept table: the merge of all partial merges."""
    return combine_state(state).select("row.*", *MERGED_FIELDS)


def stream_upsert_merge(contacts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the merged contacts in a levelled table; `read_merged(read_levels(spark, path))` is their present state.

    A batch writes its own partial merge; folders are folded as they gather, so the
    cost of a batch and of a reader does not grow with the history but with its
    logarithm and the number of persons.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        append_batch(merge_state(batch), batch_id, path, combine_state)

    return (
        contacts.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


def stream_progress(
    events: DataFrame, path: str, checkpoint: str, total: float, delay: str = "10 minutes", width: str = "1 minute"
) -> StreamingQuery:
    """Progress per task and tumbling window, written once per window, when it is final.
    events: task_id, ts, value.

    Folder rows: window_start, task_id, n_events and value of the window, processed
    (events up to its end), percent of `total`, rate (events a minute since the
    task's first window) and eta_minutes; folder totals: first window and events per
    task after each batch.  A batch reads the totals of the batch before and its own
    final windows, one row per task and window, so neither it nor a reader looks back
    at the history.  A batch that runs again writes the same folders.  Events behind
    the watermark are left out.
    """
    spark = events.sparkSession
    minutes = _millis(width) / 60_000
    kind = dict(events.dtypes)["task_id"]
    kept = f"task_id {kind}, first timestamp, processed long"
    windows = (
        events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "task_id")
        .agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("window_start"), "task_id", "n_events", "value")
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema(kept).parquet(f"{path}/totals/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], kept)
        task = Window.partitionBy("task_id").orderBy("window_start")
        rows = batch.join(known, "task_id", "left").select(
            "window_start", "task_id", "n_events", "value",
            (F.coalesce("processed", F.lit(0)) + F.sum("n_events").over(task)).alias("processed"),
            F.coalesce("first", F.min("window_start").over(task)).alias("first"),
        )
        passed = F.timestamp_diff("MILLISECOND", F.col("first"), F.col("window_start")) / 60_000 + minutes
        shown = rows.withColumn("percent", 100.0 * F.col("processed") / total).withColumn("rate", F.col("processed") / passed)
        left = F.greatest(F.lit(total) - F.col("processed"), F.lit(0.0))
        shown.withColumn("eta_minutes", left / F.col("rate")).drop("first").write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        ends = known.unionByName(rows.select("task_id", "first", "processed")).groupBy("task_id")
        ends.agg(F.min("first").alias("first"), F.max("processed").alias("processed")).write.mode("overwrite").parquet(f"{path}/totals/batch={batch_id}")
        remove_folder(spark, f"{path}/totals/batch={batch_id - 3}")

    return (
        windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


def stream_terminal_status(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per closed task, and late events: task_id, outcome, type, closed_at, n_events.
    events: task_id, ts, event_id, type.

    A task whose latest event (by ts, event_id) is a terminal one is closed when the
    watermark has passed that event by `delay`; it comes out once as `closed`, with
    the number of its events, and its state goes.  An event that arrives in between
    counts, and one that is later and not terminal keeps the task open.  An event
    before the watermark comes out as `late` and changes nothing; an event after
    the closing that is not late opens the task anew.
    """
    span = _millis(delay)

    def follow(key, frames, state):
        watermark = state.getCurrentWatermarkMs()
        ts, event_id, kind, n = state.get if state.exists else (None, None, None, 0)
        out = []
        if ts is not None and kind in TERMINAL_EVENTS and ts + span < watermark:
            out.append(pd.DataFrame({"task_id": [key[0]], "outcome": ["closed"], "type": [kind], "closed": [ts], "n_events": [n]}))
            ts, event_id, kind, n = None, None, None, 0
            state.remove()
        if not state.hasTimedOut:
            for rows in frames:  # one Arrow batch at a time: a task may hold a large share of the events
                late = rows["_ts"] < watermark
                if late.any():
                    gone = rows[late]
                    out.append(pd.DataFrame({"task_id": key[0], "outcome": "late", "type": gone["type"], "closed": gone["_ts"], "n_events": 1}))
                rows = rows[~late]
                if len(rows):
                    last = rows.sort_values(["_ts", "event_id"]).iloc[-1]
                    n += len(rows)
                    if ts is None or (int(last["_ts"]), int(last["event_id"])) > (ts, event_id):
                        ts, event_id, kind = int(last["_ts"]), int(last["event_id"]), last["type"]
        if ts is not None:
            state.update((ts, event_id, kind, n))
            if kind in TERMINAL_EVENTS:
                state.setTimeoutTimestamp(max(ts + span, watermark + 1))
        yield from out

    task = dict(events.dtypes)["task_id"]
    rows = _marked(events, "ts", delay).select("task_id", "_ts", "event_id", "type", "_mark")
    found = rows.groupBy("task_id").applyInPandasWithState(
        follow, f"task_id {task}, outcome string, type string, closed long, n_events long",
        "ts long, event_id long, type string, n long", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return found.select("task_id", "outcome", "type", F.timestamp_millis("closed").alias("closed_at"), "n_events")
