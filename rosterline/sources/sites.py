"""Site lists: CSV, text, sheet rows already landed as a table, search results."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline import vocab
from rosterline.functions.text import empty_to_null, strip_ws
from rosterline.functions.urls import url_host, url_scheme
from rosterline.operators.skew import first_by, spread_join
from rosterline.sources.lines import csv_records, numbered_lines

_HAS_SCHEME = r"^https?://"


def _add_scheme(url: Column) -> Column:
    return F.when(url.rlike(_HAS_SCHEME), url).otherwise(F.concat(F.lit("https://"), url))


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The most frequent of comma, semicolon and tab in the header line."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(",;\t", key=line.count)


def read_sites_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Site lists with a header each; columns are found by keyword.

    URL: the first column named like one, else the first cell with a dot, else
    the first filled cell.  Company and INN: the last column named like one.
    site_ord is the number of the record's first line over all files in the order
    of their paths; a quoted field may hold line breaks.  Cells behind the last
    header are ignored.
    """
    records = csv_records(spark, path, sep or sniff_separator(spark, path))
    names = F.transform("cells", F.lower)

    def named(keywords: list[str]) -> Column:
        places = F.transform(names, lambda n, i: F.when(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(n, k)), i))
        return F.filter(places, lambda i: i.isNotNull())

    heads = records.filter("line = 0").select(
        "path", F.size("cells").alias("_width"), F.array_min(named(vocab.CSV_URL_KEYWORDS)).alias("_url"),
        F.array_max(named(vocab.CSV_NAME_KEYWORDS)).alias("_name"), F.array_max(named(vocab.CSV_INN_KEYWORDS)).alias("_inn"),
    )
    rows = spread_join(records.filter("line > 0"), heads, ["path"], "inner", ["line"])
    rows = rows.withColumn("cells", F.transform(F.slice("cells", F.lit(1), F.col("_width")), strip_ws))
    cell = lambda c: empty_to_null(F.get("cells", F.col(c)))
    with_dot = F.get(F.filter("cells", lambda c: c.contains(".")), F.lit(0))
    filled = F.get(F.filter("cells", lambda c: c != ""), F.lit(0))
    picked = rows.select(
        F.col("line_ord").alias("site_ord"), F.coalesce(cell("_url"), with_dot, filled).alias("url"),
        cell("_name").alias("company_name"), cell("_inn").alias("inn"),
    )
    return picked.filter("url is not null").withColumn("url", _add_scheme(F.col("url")))


def sites_from_lines(lines: DataFrame) -> DataFrame:
    """Lines (line_ord, line) -> sites: comments dropped, several sites per line,
    row numbers such as `12. ` removed."""
    text = strip_ws(F.regexp_replace("line", "^﻿", ""))
    rows = lines.select("line_ord", text.alias("line")).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    parts = rows.select("line_ord", F.posexplode(F.split("line", r"[,;\t]+")).alias("part_ord", "part"))
    part = F.regexp_replace(strip_ws(F.col("part")), r"(?U)^\d+[.)]\s+", "")
    kept = parts.filter(F.length(strip_ws(F.col("part"))) >= 4).select("line_ord", "part_ord", part.alias("part"))
    return kept.filter("part != ''").select(
        "line_ord", F.col("part_ord").cast("long").alias("part_ord"), _add_scheme(F.col("part")).alias("url")
    )


def read_sites_txt(spark: SparkSession, path: str) -> DataFrame:
    """Sites of text files; line_ord counts the lines of all files in the order of their paths."""
    return sites_from_lines(numbered_lines(spark, path).select("line_ord", F.col("value").alias("line")))


HEADER_ROWS, SAMPLE_ROWS = 10, 5  # fixed values: where a header may stand; rows read below it


def find_header_row(rows: DataFrame) -> DataFrame:
    """Header place of each sheet: the first of ten rows with two filled cells
    and a header keyword; row 0 if there is none.
    rows: sheet_id, row_ord, cells array<string>."""
    cells = F.transform(F.filter("cells", lambda c: c.isNotNull()), lambda c: F.lower(strip_ws(c)))
    filled = F.filter(cells, lambda c: c != "")
    pattern = "|".join(vocab.HEADER_KEYWORDS)
    is_header = (F.size(filled) >= 2) & F.exists(filled, lambda c: c.rlike(pattern))
    place = F.min(F.when(is_header, F.col("row_ord")))
    return rows.filter(F.col("row_ord") < HEADER_ROWS).groupBy("sheet_id").agg(F.coalesce(place, F.lit(0)).cast("long").alias("header_row"))


def _first_column(headers: Column, keywords: list[str]) -> Column:
    pattern = "|".join(keywords)
    places = F.transform(headers, lambda h, i: F.when(F.lower(strip_ws(h)).rlike(pattern), i))
    return F.array_min(places).cast("long")


def infer_column_roles(headers: DataFrame) -> DataFrame:
    """sheet_id, cells of the header row -> url_col, name_col, inn_col (or null)."""
    cells = F.col("cells")
    return headers.select(
        "sheet_id",
        _first_column(cells, vocab.URL_COLUMN_KEYWORDS).alias("url_col"),
        _first_column(cells, vocab.NAME_COLUMN_KEYWORDS).alias("name_col"),
        _first_column(cells, vocab.INN_COLUMN_KEYWORDS).alias("inn_col"),
    )


def infer_url_column_by_content(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Per sheet the first column with two URL-like values among the five rows
    after the header.  Only those rows are exploded."""
    top = rows.filter(F.col("row_ord") < HEADER_ROWS + SAMPLE_ROWS)
    below = top.join(headers, "sheet_id").filter(
        (F.col("row_ord") > F.col("header_row")) & (F.col("row_ord") <= F.col("header_row") + SAMPLE_ROWS)
    )
    cell = strip_ws(F.col("cell"))
    counts = (
        below.select("sheet_id", F.posexplode("cells").alias("col", "cell"))
        .groupBy("sheet_id", "col")
        .agg(F.count_if(cell.contains(".") & ~cell.contains(" ")).alias("n"))
    )
    return counts.filter("n >= 2").groupBy("sheet_id").agg(F.min("col").cast("long").alias("url_col"))


def clean_url_cell(cell: Column) -> Column:
    """URL of a cell, also of `name;type;url` cells; null for blanks and #."""
    value = strip_ws(cell)
    parts = F.transform(F.split(value, ";"), strip_ws)
    like_url = F.filter(
        parts,
        lambda p: p.rlike(_HAS_SCHEME) | (p.contains(".") & ~p.contains(" ") & (F.length(p) > 4)),
    )
    url = F.when(value.contains(";"), F.coalesce(F.get(like_url, F.lit(0)), value)).otherwise(value)
    return F.when((value != "") & ~F.startswith(value, F.lit("#")), _add_scheme(url))


def read_sites_table(rows: DataFrame) -> DataFrame:
    """Sites of sheets landed as rows: sheet_id, row_ord, cells array<string>.

    Header place and column roles are one small row per sheet; they are joined
    back with the hot sheets spread.
    """
    headers = find_header_row(rows)
    top = rows.filter(F.col("row_ord") < HEADER_ROWS)
    header_cells = top.join(headers, "sheet_id").filter("row_ord = header_row").select("sheet_id", "cells")
    roles = infer_column_roles(header_cells)
    by_content = infer_url_column_by_content(rows, headers).withColumnRenamed("url_col", "content_col")
    meta = headers.join(roles, "sheet_id", "left").join(by_content, "sheet_id", "left").select(
        "sheet_id", "header_row", F.coalesce("url_col", "content_col", F.lit(0)).cast("int").alias("url_col"),
        F.col("name_col").cast("int").alias("name_col"), F.col("inn_col").cast("int").alias("inn_col"),
    )
    data = spread_join(rows, meta, ["sheet_id"], "inner", ["row_ord"]).filter("row_ord > header_row")

    def cell(col: str) -> Column:
        return empty_to_null(strip_ws(F.get("cells", F.col(col))))

    return data.select(
        "sheet_id", F.col("row_ord").alias("site_ord"), clean_url_cell(F.get("cells", F.col("url_col"))).alias("url"),
        cell("name_col").alias("company_name"), cell("inn_col").alias("inn"),
    ).filter("url is not null")


def seed_sites_from_search_results(results: DataFrame) -> DataFrame:
    """Stored result pages (result_ord, html) -> one site per bare domain, the
    first in result order."""
    hits = results.select(
        "result_ord", F.posexplode(F.regexp_extract_all("html", F.lit(r'/url\?q=(https?://[^&"]+)'), F.lit(1))).alias("hit_ord", "raw")
    )
    url = F.try_url_decode("raw")
    parsed = hits.select("result_ord", "hit_ord", url.alias("full")).select(
        "result_ord", "hit_ord",
        F.concat(url_scheme(F.col("full")), F.lit("://"), F.regexp_extract("full", r"^[^:]*://([^/?#]*)", 1)).alias("url"),
        F.regexp_replace(url_host(F.col("full")), r"^www\.", "").alias("domain"),
    ).filter("domain != ''")
    return first_by(parsed, [F.col("domain")], ["result_ord", "hit_ord"]).select("domain", "url")
