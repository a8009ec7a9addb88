"""From raw documents to training batches: five stages, each written before the next one reads it.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and
returns the columns of `documents`; the last one returns packed batches.
"""

from pyspark.sql import DataFrame, SparkSession

from rosterline.llm.common import documents, stored
from rosterline.llm.line_dedup import without_repeated_lines
from rosterline.llm.mixing import mixed_documents
from rosterline.llm.packing import pack
from rosterline.llm.quality import keep_quality
from rosterline.llm.simhash import keep_one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines the first one stays; every document stays, with the lines left."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", source_mixing),
    ("packing", packing),
]

#: The stages hash, sample and iterate in ways SQL does not have; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
