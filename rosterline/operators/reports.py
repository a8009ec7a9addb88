"""Export rows, statistics and logs."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions import names as N
from rosterline.functions.categories import contact_position, crm_category, ui_category
from rosterline.functions.fields import phone_city, phone_mobile
from rosterline.functions.text import capitalize_first, empty_to_null, safe_partition_name, scan_date_text
from rosterline.schemas import CONTACT_ORDER


def _or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def with_category(contacts: DataFrame) -> DataFrame:
    position = contact_position(F.col("position_normalized"), F.col("position_raw"))
    return contacts.withColumn("category", crm_category(position))


def export_projection(contacts: DataFrame) -> DataFrame:
    """The 17 export columns as text; null becomes empty.  The order columns
    and a category, if there is one, are kept in front."""
    name = F.coalesce(F.col("full_name"), F.lit(""))
    named = contacts.withColumn("_fio", N.split_fio(name)).withColumn("_gender", N.detect_gender(F.col("_fio")))
    fio, gender = F.col("_fio"), F.col("_gender")
    phone = F.coalesce(empty_to_null(F.col("phone")), F.col("phone_raw"))
    derived = {
        "position_normalized": capitalize_first(_or_empty("position_normalized")),
        "full_name": name,
        "fio_dative": N.fio_dative(fio, gender),
        "name_patronymic": N.name_patronymic(fio),
        "gender_ending": N.gender_ending(gender),
        "phone_mobile": phone_mobile(phone),
        "phone_city": phone_city(phone),
        "scan_date": scan_date_text(F.col("scan_date")),
    }
    front = [c for c in (*CONTACT_ORDER, "category") if c in contacts.columns]
    return named.select(
        *front, *[derived.get(k, _or_empty(k)).alias(k) for k in vocab.EXPORT_COLUMNS]
    )


def category_rows(contacts: DataFrame) -> DataFrame:
    """Export rows with their category and the name of its sheet or folder."""
    rows = export_projection(with_category(contacts))
    return rows.withColumn("sheet", safe_partition_name(F.col("category")))


def category_order(spark: SparkSession) -> DataFrame:
    """Fixed order of the categories, the default last."""
    rows = [(i, c) for i, c in enumerate([*vocab.CATEGORY_VARIANTS, vocab.DEFAULT_CATEGORY])]
    return spark.createDataFrame(rows, "category_ord long, category string")


def category_counts(categorised: DataFrame) -> DataFrame:
    """Contacts per category; the default is always there."""
    default = categorised.sparkSession.createDataFrame([(vocab.DEFAULT_CATEGORY, 0)], "category string, n long")
    counts = categorised.groupBy("category").agg(F.count("*").alias("n"))
    return counts.unionByName(default).groupBy("category").agg(F.sum("n").alias("n"))


def order_categories(categorised: DataFrame) -> DataFrame:
    """Non-empty categories in their fixed order."""
    counts = categorised.groupBy("category").agg(F.count("*").alias("n"))
    return counts.join(category_order(categorised.sparkSession), "category").orderBy("category_ord")


def site_counts(sites: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts per listed site, sites without contacts included."""
    counts = contacts.groupBy("site_url").agg(F.count("*").alias("n"))
    listed = sites.select(F.col("url").alias("site_url")).distinct()
    return listed.join(counts, "site_url", "left").select("site_url", F.coalesce("n", F.lit(0)).alias("n"))


def ui_category_counts(contacts: DataFrame) -> DataFrame:
    """Coarse categories and their total under `all`."""
    grouped = contacts.select(
        ui_category(F.col("position_normalized"), F.col("position_raw")).alias("category")
    ).rollup("category").agg(F.count("*").alias("n"))
    return grouped.select(F.coalesce("category", F.lit("all")).alias("category"), "n")


# Labels of the task rows, in their order: fixed values.
TASK_LABELS = [
    "Дата создания задачи", "Дата завершения", "Режим парсинга", "Вариант извлечения", "Ошибок", "Просмотрено страниц",
    "Время выполнения", "Токенов LLM использовано", "Переключений на Вариант A",
]


def _task_rows(task: DataFrame) -> DataFrame:
    """The rows of one task: created_at, finished_at, mode, variant, errors, total_pages,
    elapsed_seconds, llm_tokens_used, fallback_count.  No time without elapsed
    seconds, no token rows but for variant B."""
    stamp = lambda c: F.date_format(c, "dd.MM.yyyy HH:mm:ss")
    text = lambda c: F.col(c).cast("string")
    seconds, by_model = F.floor("elapsed_seconds"), F.col("variant") == "B"
    spent = F.concat(F.floor(seconds / 60).cast("string"), F.lit(" мин "), (seconds % 60).cast("string"), F.lit(" сек"))
    values = [
        stamp("created_at"), F.coalesce(stamp("finished_at"), F.lit("—")), F.concat(F.lit("Режим "), text("mode")), F.col("variant"),
        text("errors"), text("total_pages"), F.when(F.col("elapsed_seconds") > 0, spent), F.when(by_model, text("llm_tokens_used")),
        F.when(by_model, text("fallback_count")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("label"), v.alias("value")) for i, (k, v) in enumerate(zip(TASK_LABELS, values))])
    shown = task.select(F.inline(rows)).filter("value is not null")
    return shown.select(F.lit("task").alias("section"), "label", "value", F.col("place").cast("long"))


def statistics_table(sites: DataFrame, contacts: DataFrame, task: DataFrame | None = None) -> DataFrame:
    """section, label and value (text): the task if given, the total, per category, per site; largest first."""
    categorised = with_category(contacts)

    def counted(section: str, rows: DataFrame, label: Column, n: str) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), label.alias("label"), F.col(n).cast("string").alias("value"), (-F.col(n)).alias("place"))

    out = counted("total", contacts.agg(F.count("*").alias("n")), F.lit("Итого контактов"), "n")
    out = out.unionByName(counted("category", category_counts(categorised), F.col("category"), "n"))
    out = out.unionByName(counted("site", site_counts(sites, contacts), F.col("site_url"), "n"))
    if task is not None:
        out = out.unionByName(_task_rows(task))
    sections = F.array(*map(F.lit, ("task", "total", "category", "site")))
    return out.orderBy(F.array_position(sections, F.col("section")), "place", "label").drop("place")


def site_summary(pages: DataFrame, contacts: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Pages, and contacts and errors if given, per site; each is counted before they are put together."""
    out = pages.groupBy("site_url").agg(F.count("*").alias("n_pages"))
    for name, rows in (("n_contacts", contacts), ("n_errors", errors)):
        if rows is not None:
            out = out.join(rows.groupBy("site_url").agg(F.count("*").alias(name)), "site_url", "full")
    return out.select("site_url", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "site_url"])


def site_log_table(sites: DataFrame, pages: DataFrame, contacts: DataFrame, at: Column | None = None) -> DataFrame:
    """Time, site, pages read and a status line; `at` is the time of the log, now by default."""
    n_pages = pages.groupBy("site_url").agg(F.count("*").alias("n_pages"))
    n = F.col("n").cast("string")
    status = F.concat(
        F.when(F.col("n") > 0, "OK").otherwise("Нет контактов"), F.lit(": найдено "), n, F.lit(" контактов")
    )
    return (
        site_counts(sites, contacts).join(n_pages, "site_url", "left")
        .select(
            scan_date_text(F.current_timestamp() if at is None else at).alias("time"), "site_url",
            F.coalesce("n_pages", F.lit(0)).alias("n_pages"), status.alias("status"),
        )
    )


def error_log(blocked_sites: DataFrame, page_errors: DataFrame | None = None, site_errors: DataFrame | None = None) -> DataFrame:
    """Log lines of rejected sites, failed pages and failed sites.

    blocked_sites: url; page_errors: url, message; site_errors: url, message.
    """
    def lines(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"[{tag}] "), "url", F.lit(": "), "message").alias("line"))

    out = blocked_sites.select(F.concat(F.lit("[BLACKLIST] "), "url", F.lit(" — в чёрном списке")).alias("line"))
    if page_errors is not None:
        out = out.unionByName(lines(page_errors, "PAGE_ERROR"))
    if site_errors is not None:
        out = out.unionByName(lines(site_errors, "SITE_ERROR"))
    return out


def union_site_results(*results: DataFrame) -> DataFrame:
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def list_records(contacts: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of the exported contacts, in contact order.  The page is cut
    first, so only its rows are formatted."""
    order = ["site_url", *CONTACT_ORDER]
    return export_projection(contacts.orderBy(*order).offset(offset).limit(limit))


SEARCH_FIELDS = ["full_name", "company_name", "personal_email", "phone", "inn"]


def search_contacts(contacts: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring in any of six fields; blank keeps all."""
    if not query.strip():
        return contacts
    values = [F.col(c) for c in SEARCH_FIELDS] + [F.coalesce("position_normalized", "position_raw")]
    hit = F.lit(False)
    for value in values:
        hit = hit | F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lit(query.lower()))
    return contacts.filter(hit)


def sort_contacts(contacts: DataFrame, field: str = "full_name", descending: bool = False) -> DataFrame:
    """By lower-case text, null as empty; binary order, not a locale's."""
    key = F.lower(F.coalesce(F.col(field), F.lit("")))
    return contacts.orderBy(key.desc() if descending else key.asc(), *CONTACT_ORDER)
