"""Prompt and answer tables for an outside correction step.  No model is called."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.answers import json_array_from_text
from rosterline.functions.text import empty_to_null
from rosterline.operators.enrich import contact_index
from rosterline.operators.site_keys import match_sites


def _or_dash(column: str) -> Column:
    return F.coalesce(empty_to_null(F.col(column)), F.lit("-"))


#: What is asked about a table of contacts; a parameter of the prompts.
CORRECTION_TASK = (
    "Проверь строки таблицы. Для каждой верни объект с полями idx, company_name, full_name, position, personal_email, company_email, phone."
    " Чего нет или что неверно, то null; у строки не о человеке null в full_name. Общие ящики пиши в company_email. Ответ: массив JSON."
)


def correction_prompts(
    contacts: DataFrame, sites: DataFrame | None = None, contacts_per_part: int = 500, task: str = CORRECTION_TASK
) -> DataFrame:
    """Prompt texts per site: its URL, its company in the site list, the task, numbered contact lines.

    A site has one part up to `contacts_per_part` contacts; a larger site goes
    on in further parts with running numbers, so no row grows without limit.
    """
    line = F.concat(
        F.col("idx").cast("string"), F.lit(". ФИО: "), _or_dash("full_name"), F.lit(" | Должность: "),
        _or_dash("position_raw"), F.lit(" | Email: "), _or_dash("personal_email"), F.lit(" | Тел: "), _or_dash("phone"),
    )
    part = F.floor((F.col("idx") - 1) / contacts_per_part).cast("long")
    lines = contact_index(contacts).select("site_url", part.alias("part"), "idx", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "line")))
    parts = lines.groupBy("site_url", "part").agg(
        F.count("*").alias("n_contacts"), F.array_join(F.transform(ordered, lambda s: s.line), "\n").alias("lines")
    )
    if sites is None:
        parts = parts.withColumn("site_company", F.lit(None).cast("string"))
    else:
        listed = match_sites(parts.select("site_url", F.col("site_url").alias("_same")), sites, "_same", "site_url")
        parts = parts.join(listed.select("site_url", "site_company"), "site_url", "left")
    prompt = F.concat(
        F.lit("Сайт: "), "site_url", F.lit("\nКомпания (из входного файла): "), F.coalesce("site_company", F.lit("")),
        F.lit(f"\n\n{task}\n\nТаблица:\n"), "lines",
    )
    return parts.select("site_url", "part", "n_contacts", prompt.alias("prompt"))


def page_prompts(pages: DataFrame, targets: list[str] | None = None, part_chars: int = 12288) -> DataFrame:
    """Prompt texts of every page: company, URL, wanted positions, text.

    pages: page_ord, page_url, company_name, text.  A text longer than
    `part_chars` goes on in further parts, so the whole of it is asked about."""
    hint = "\nЦелевые должности для поиска: " + ", ".join(targets) if targets else ""
    prompt = F.concat(
        F.lit("Компания: "), F.coalesce(empty_to_null(F.col("company_name")), F.lit("неизвестна")),
        F.lit("\nURL: "), "page_url", F.lit(hint), F.lit("\n\nТекст страницы:\n"),
        F.substr("text", F.col("part") * part_chars + 1, F.lit(part_chars)),
    )
    last = F.greatest(F.ceil(F.length("text") / part_chars), F.lit(1)) - 1
    parts = pages.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(last, F.lit(0)))))
    return parts.select("page_ord", "page_url", "part", prompt.alias("prompt"))


ANSWER_FIELDS = ["company_name", "full_name", "position", "personal_email", "company_email", "phone"]


def parse_answers(answers: DataFrame) -> DataFrame:
    """Answer texts (site_url, answer) -> correction rows.

    Items that are no objects are skipped; of items with one number the last
    wins.
    """
    items = answers.select(
        "site_url", F.posexplode(F.from_json(json_array_from_text(F.col("answer")), "array<string>")).alias("pos", "item")
    ).filter(F.startswith("item", F.lit("{")))
    schema = "idx bigint, " + ", ".join(f"{f} string" for f in ANSWER_FIELDS)
    parsed = items.select("site_url", "pos", F.from_json("item", schema).alias("c")).select(
        "site_url", "pos", F.coalesce("c.idx", F.lit(0)).cast("long").alias("idx"), *[f"c.{f}" for f in ANSWER_FIELDS]
    )
    last = parsed.groupBy("site_url", "idx").agg(F.max_by(F.struct(*ANSWER_FIELDS), "pos").alias("c"))
    return last.select("site_url", "idx", "c.*")
