"""Writers.  Results stay whole and distributed: one folder per category, no
single-file merge."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.operators.reports import category_rows


def write_contacts_by_category(
    contacts: DataFrame, path: str, file_format: str = "parquet", rows_per_file: int = 2_000_000
) -> None:
    """One folder per non-empty category with the export columns; a rerun replaces them.

    Rows are rebalanced by category before the write: small categories end in one
    file each, a large one is split where its bytes pass the advisory partition
    size, so the number of files follows the bytes and not the number of tasks.
    """
    rows = category_rows(contacts).drop("sheet").hint("rebalance", "category")
    rows = rows.sortWithinPartitions("category", "site_url", "page_ord", "contact_ord")
    writer = rows.write.mode("overwrite").partitionBy("category").option("maxRecordsPerFile", rows_per_file)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


def blocklist_rows(blocklist: DataFrame) -> DataFrame:
    """Distinct entries sorted by kind and value; the sort is distributed."""
    return blocklist.select("kind", "value").distinct().orderBy("kind", "value")


def save_blocklist(blocklist: DataFrame, path: str) -> None:
    """Sorted JSON lines of kind and value, the same form at every size."""
    blocklist_rows(blocklist).write.mode("overwrite").json(path)


def blocklist_tsv(blocklist: DataFrame) -> DataFrame:
    return blocklist.select(F.concat_ws("\t", "kind", "value").alias("line"))


def export_blocklist_tsv(blocklist: DataFrame, path: str) -> None:
    blocklist_tsv(blocklist).write.mode("overwrite").text(path)


def write_error_log(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
