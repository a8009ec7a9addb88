"""A table that grows by micro-batches: levels of merged folders behind one manifest.

A batch is written to a folder of its own.  When FAN folders stand on a level
they are merged into one of the next level, so a reader opens at most
(FAN - 1) * levels + 1 folders, and a row is rewritten once per level.  Which
folders make up the table stands in a manifest file; a new one is written aside
and renamed into place, so a reader always sees one whole generation.  A batch
that fails before the rename has changed nothing, and one that comes again after
it is known by its number and left out.  One writer at a time (a streaming query
with its checkpoint) is assumed.
"""

import json
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

FAN = 4
#: Generations whose folders are kept for readers that have begun on them.
KEPT = 3


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its maker of paths."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def remove_folder(spark: SparkSession, path: str) -> None:
    files, of = _files(spark, path)
    files.delete(of(path), True)


def _manifests(spark: SparkSession, path: str) -> list[str]:
    files, of = _files(spark, path)
    folder = of(f"{path}/_manifests")
    if not files.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().endswith(".json"))


def _load(spark: SparkSession, path: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_manifests/{name}", wholetext=True).first()[0])


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest: generation, batch (the last one in it) and levels (folder names, lowest level first)."""
    names = _manifests(spark, path)
    return _load(spark, path, names[-1]) if names else {"generation": 0, "batch": -1, "levels": []}


def _publish(spark: SparkSession, path: str, made: dict) -> None:
    files, of = _files(spark, path)
    aside = of(f"{path}/_manifests/_{uuid.uuid4().hex}")
    out = files.create(aside, True)
    out.write(bytearray(json.dumps(made), "utf-8"))
    out.close()
    if not files.rename(aside, of(f"{path}/_manifests/{made['generation']:012d}.json")):
        raise RuntimeError(f"generation {made['generation']} of {path} is there already")


def _clean(spark: SparkSession, path: str) -> None:
    """Removes manifests beyond the last KEPT, and the folders that only those name."""
    names = _manifests(spark, path)
    if len(names) <= KEPT:
        return
    files, of = _files(spark, path)
    folders = lambda some: {f for n in some for level in _load(spark, path, n)["levels"] for f in level}
    gone = folders(names[:-KEPT]) - folders(names[-KEPT:])
    for name in names[:-KEPT]:
        files.delete(of(f"{path}/_manifests/{name}"), False)
    for folder in gone:
        files.delete(of(f"{path}/{folder}"), True)


def append_batch(batch: DataFrame, batch_id: int, path: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Add a batch of mergeable rows; `merge` folds rows of several folders into rows of the same columns."""
    spark = batch.sparkSession
    known = manifest(spark, path)
    if batch_id <= known["batch"]:
        return
    folder = f"l0-{batch_id:012d}"
    batch.write.mode("overwrite").parquet(f"{path}/{folder}")
    levels = [list(level) for level in known["levels"]] or [[]]
    levels[0].append(folder)
    at = 0
    while at < len(levels) and len(levels[at]) >= FAN:
        merged = f"l{at + 1}-{batch_id:012d}"
        merge(spark.read.schema(batch.schema).parquet(*[f"{path}/{f}" for f in levels[at]])).write.mode("overwrite").parquet(f"{path}/{merged}")
        levels[at] = []
        if at + 1 == len(levels):
            levels.append([])
        levels[at + 1].append(merged)
        at += 1
    _publish(spark, path, {"generation": known["generation"] + 1, "batch": batch_id, "levels": levels})
    _clean(spark, path)


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest generation."""
    folders = [f for level in manifest(spark, path)["levels"] for f in level]
    if not folders:
        raise ValueError(f"{path} has no batch yet")
    return spark.read.parquet(*[f"{path}/{f}" for f in folders])
