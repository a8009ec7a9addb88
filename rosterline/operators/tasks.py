"""Tasks, requests and progress: totals, budgets, paging."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.operators.skew import running_before, spread_join
from rosterline.schemas import TASK_STATUS
from rosterline.session import cut_lineage


def task_totals(tasks: DataFrame) -> DataFrame:
    """Dashboard totals over tasks: status, contacts_found, processed_sites,
    total_pages, elapsed_seconds."""
    done = F.col("status") == "completed"
    timed = done & (F.col("elapsed_seconds") > 0) & (F.col("processed_sites") > 0)
    speed = F.when(timed, F.try_divide(F.col("processed_sites"), F.col("elapsed_seconds") / 60))
    return tasks.agg(
        F.count("*").alias("total_tasks"),
        F.coalesce(F.sum("contacts_found"), F.lit(0)).alias("total_contacts"),
        F.coalesce(F.sum("processed_sites"), F.lit(0)).alias("total_sites"),
        F.coalesce(F.sum("total_pages"), F.lit(0)).alias("total_pages"),
        F.coalesce(F.round(F.avg(speed), 1), F.lit(0.0)).alias("avg_speed"),
        F.count_if(done).alias("completed_tasks"),
        F.count_if(F.col("status") == "running").alias("running_tasks"),
        F.count_if(F.col("status") == "failed").alias("failed_tasks"),
    )


def contacts_by_day(tasks: DataFrame, last_day: Column, days: int = 7) -> DataFrame:
    """Contacts found per day over the last days, empty days as zero."""
    spark = tasks.sparkSession
    calendar = spark.range(1).select(
        F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day")
    )
    first = F.date_sub(last_day, days - 1).cast("timestamp")
    recent = tasks.filter((F.col("created_at") >= first) & (F.col("created_at") < F.date_add(last_day, 1).cast("timestamp")))
    daily = recent.groupBy(F.to_date("created_at").alias("day")).agg(F.sum("contacts_found").alias("n"))
    return calendar.join(daily, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def list_tasks(tasks: DataFrame, status: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest tasks first; an unknown status is ignored.  Equal times follow the
    task id, so pages do not overlap."""
    chosen = tasks.filter(F.col("status") == status) if status in TASK_STATUS else tasks
    return chosen.orderBy(F.desc("created_at"), "task_id").offset(offset).limit(limit)


def sort_tasks(tasks: DataFrame, field: str, descending: bool = True) -> DataFrame:
    key = F.col(field)
    return tasks.orderBy(key.desc() if descending else key.asc(), "task_id")


def token_usage(calls: DataFrame, budget: int = 1_000_000) -> DataFrame:
    """Tokens spent, requests made and what is left of the budget."""
    totals = calls.agg(
        F.coalesce(F.sum("tokens_prompt"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("tokens_completion"), F.lit(0)).alias("completion_tokens"),
        F.count("*").alias("request_count"),
    ).withColumn("used", F.col("prompt_tokens") + F.col("completion_tokens"))
    return totals.select(
        F.lit(budget).cast("long").alias("budget"), "used",
        F.greatest(F.lit(budget) - F.col("used"), F.lit(0)).cast("long").alias("remaining"),
        (F.col("used") >= budget).alias("exhausted"),
        "request_count", "prompt_tokens", "completion_tokens",
    )


def token_budget_cutoff(
    calls: DataFrame, session: list[str], order: list[str], block: Column | None = None, budget: int = 1_000_000
) -> DataFrame:
    """Adds used_before and refused: a request is refused once the requests
    before it have used up the budget of its session.  Refused requests use
    nothing, so used_before stays at what was used when the budget ran out.

    Sessions are cut into sampled ranges of the order, or by `block`.  The running
    totals are written once and read for the rows and for the ends of budgets."""
    spent = F.col("tokens_prompt") + F.col("tokens_completion")
    out = cut_lineage(running_before(calls, session, order, spent, block, "used_before"))
    over = F.col("used_before") >= budget
    ends = out.filter(over).groupBy(*session).agg(F.min("used_before").alias("_end"))
    joined = spread_join(out, ends, session, "left", order).withColumn("used_before", F.when(over, F.col("_end")).otherwise(F.col("used_before")))
    return joined.drop("_end").withColumn("refused", over).withColumn(
        "reason", F.when(F.col("refused"), "token_budget_exhausted")
    )


def fallback_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("reason").agg(F.count("*").alias("n"))


def progress_track(steps: DataFrame, order: list[str], block: Column | None = None) -> DataFrame:
    """Progress of every task after each processed site.

    steps: task_id, total_sites, elapsed_seconds and the order columns; percent
    is processed / total, rate is sites per second, eta is remaining / rate.
    Tasks are cut into sampled ranges of the order, or by `block`.
    """
    out = running_before(steps, ["task_id"], order, F.lit(1), block, "_before")
    out = out.withColumn("processed", (F.col("_before") + 1).cast("long")).drop("_before")
    total, elapsed = F.col("total_sites"), F.col("elapsed_seconds")
    rate = F.try_divide(F.col("processed"), elapsed)
    return out.withColumns({
        "percent": F.coalesce(F.try_divide(F.col("processed") * 100.0, total), F.lit(0.0)),
        "rate": rate,
        "eta_seconds": F.when(rate > 0, (total - F.col("processed")) / rate),
    })


def upload_preview(sites: DataFrame, size: int = 10) -> DataFrame:
    """Number of listed sites and their first URLs, in one row.

    The list is cut by the distributed top-k of orderBy + limit before it is
    collected into the array.
    """
    first = sites.orderBy("site_ord").limit(size).agg(
        F.array_sort(F.collect_list(F.struct("site_ord", "url"))).alias("first")
    )
    urls = first.select(F.lit(1).alias("_one"), F.transform("first", lambda s: s.url).alias("preview_urls"))
    total = sites.agg(F.count("*").alias("rows_count")).withColumn("_one", F.lit(1))
    return total.join(urls, "_one").drop("_one")
