"""Stored pages, blocklists and dictionaries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterline.functions.text import strip_ws
from rosterline.functions.urls import url_host, url_scheme
from rosterline.operators.blocklist import blocklist_from_entries


def spread_scan(scan: DataFrame, key: str) -> DataFrame:
    """Hash a scan over the cores if it has fewer splits than cores: reading
    html or long text costs more than moving it once.  A large table has more
    splits than cores and stays where it is.  For scans only, not for plans."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def as_pages(stored: DataFrame) -> DataFrame:
    """page_id, url, html -> the pages table; the site is scheme and host."""
    url = F.col("url")
    return stored.select(
        F.concat(url_scheme(url), F.lit("://"), url_host(url)).alias("site_url"),
        F.col("page_id").alias("page_ord"), url.alias("page_url"), "html",
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return as_pages(spark.read.parquet(path))


def read_blocklist_text(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("entry"))
    return blocklist_from_entries(lines)


def csv_cells(lines: DataFrame) -> DataFrame:
    """Every cell of every line.  Lines may differ in length, which a CSV reader
    with one schema would cut."""
    cell = r'(?:^|,)(?:"((?:[^"]|"")*)"|([^,]*))'
    line = F.regexp_replace("line", "^﻿", "")
    quoted = F.regexp_extract_all(line, F.lit(cell), F.lit(1))
    plain = F.regexp_extract_all(line, F.lit(cell), F.lit(2))
    cells = F.zip_with(quoted, plain, lambda q, p: F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(p))
    return lines.select(F.explode(cells).alias("entry"))


def read_blocklist_csv(spark: SparkSession, path: str) -> DataFrame:
    return blocklist_from_entries(csv_cells(spark.read.text(path).withColumnRenamed("value", "line")))


def json_entries(documents: DataFrame) -> DataFrame:
    """Entries of JSON blocklists: a list of strings, or an object with
    domains, emails and inns.  Items that are no strings are skipped."""
    text = F.regexp_replace("json", "^﻿", "")
    items = "array<variant>"
    as_list = F.from_json(text, items)
    as_object = F.from_json(text, f"struct<domains:{items},emails:{items},inns:{items}>")
    none = F.array().cast("array<string>")

    def strings(values):
        return F.coalesce(
            F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string")),
            none,
        )

    listed = F.startswith(strip_ws(text), F.lit("["))
    from_object = F.concat(strings(as_object.domains), strings(as_object.emails), strings(as_object.inns))
    return documents.select(F.explode(F.when(listed, strings(as_list)).otherwise(from_object)).alias("entry"))


def read_blocklist_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    documents = spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")
    return blocklist_from_entries(json_entries(documents))


def read_saved_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """What save_blocklist wrote."""
    return spark.read.schema("kind string, value string").json(path)


def dictionary_entries(documents: DataFrame) -> DataFrame:
    """JSON objects (file_ord, json) -> file_ord, ord, variant, canonical, in
    the order of the text."""
    entries = F.map_entries(F.from_json("json", T.MapType(T.StringType(), T.StringType())))
    return documents.select("file_ord", F.posexplode(entries).alias("ord", "e")).select(
        "file_ord", "ord", F.col("e.key").alias("variant"), F.col("e.value").alias("canonical")
    )


def read_position_dictionary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Dictionary files in priority order -> ord (file, place), variant, canonical."""
    documents = None
    for i, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.lit(i).alias("file_ord"), F.col("value").alias("json"))
        documents = one if documents is None else documents.unionByName(one)
    rows = dictionary_entries(documents)
    return rows.select(F.struct("file_ord", "ord").alias("ord"), "variant", "canonical")
