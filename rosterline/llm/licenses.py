"""Op 5: license scans by diagonal voting."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm.common import ByteWords, documents, mix64, null_safe, query, row_key, text_chunks

#: Base phrases and their labels: fixed values of the query's contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of public license notices, the templates of the method.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-long": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation",
    "gpl-short": "under the terms of the gnu general public license",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "all-rights": "all rights reserved",
}
GRAM = 3
#: Neighbouring diagonals up to this far apart are one alignment.
DRIFT = 3
BROADCAST_ROWS = 50_000
#: Share of a template's words that an alignment must cover.
COVER = 0.75

_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[ord("0"):ord("9") + 1] = _WORD_BYTES[ord("a"):ord("z") + 1] = _WORD_BYTES[128:] = True


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of every run of `size` word hashes."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix64(out * np.uint64(3) + words[i:i + n] + np.uint64(i))
    return out


def words_of(text: str) -> np.ndarray:
    return ByteWords([text], _WORD_BYTES).hashes()


def template_grams(spark: SparkSession, templates: dict[str, str], size: int = GRAM) -> DataFrame:
    """(gram, template, place, n): every k-gram of every template, n its words.

    Broadcast up to BROADCAST_ROWS rows (about 2 MB); a larger library is left to
    Spark's own choice of join.
    """
    rows = [
        (int(g), name, i, len(words_of(text)))
        for name, text in templates.items() for i, g in enumerate(gram_hashes(words_of(text), size).view(np.int64))
    ]
    grams = spark.createDataFrame(rows, "gram long, template string, place int, n int")
    return F.broadcast(grams) if len(rows) <= BROADCAST_ROWS else grams


def document_grams(docs: DataFrame, doc_id: str, text: str, size: int = GRAM) -> DataFrame:
    """(__id, __th, at, gram) for every k-gram of every text."""

    def grams(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in text_chunks(texts):
                scanned = ByteWords(texts[start:end], _WORD_BYTES)
                words, doc = scanned.hashes(), scanned.doc
                if len(words) < size:
                    continue
                found = gram_hashes(words, size)
                first = np.searchsorted(doc, np.arange(end - start))
                at = np.flatnonzero(doc[: len(found)] == doc[size - 1:])
                for i in range(0, len(at), 65536):
                    part = at[i:i + 65536]
                    d = pa.array(doc[part] + start)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(d), batch.column(1).take(d),
                         pa.array((part - first[doc[part]]).astype(np.int32)), pa.array(found[part].view(np.int64))],
                        names=["__id", "__th", "at", "gram"],
                    )

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(*row_key(F.col(text), F.col(doc_id)), F.col(text).alias("text"))
    return rows.mapInArrow(grams, f"__id {kind}, __th long, at int, gram long")


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(__id, __th, template, first, last, cover): verified alignments of templates.

    All rolling word k-grams are joined to the template places, votes are counted per offset
    diagonal, neighbouring diagonals up to DRIFT apart are merged until one is a
    complete placement of its own or the span would pass the bound below, and an
    alignment stands if its votes cover COVER of the template's words inside a
    span at most half as long again as the template.
    """
    votes = document_grams(docs, doc_id, text).join(template_grams(docs.sparkSession, templates), "gram")
    votes = votes.select("__id", "__th", "template", "n", "at", "place", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    key = ["__id", "__th", "template", "n"]
    # A diagonal is one placement of the template: its votes lie within n words
    placed = votes.groupBy(*key, "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))

    @F.pandas_udf("array<int>")
    def alignments(n: pd.Series, diagonal: pd.Series, first: pd.Series, last: pd.Series, votes: pd.Series) -> pd.Series:
        """The number of the alignment of every diagonal."""
        out = []
        for words, *columns in zip(n, diagonal, first, last, votes):
            numbers, number, before, start, end = [], -1, None, 0, 0
            for d, f, t, v in zip(*columns):
                far = before is None or d - before > DRIFT
                if far or v == words - GRAM + 1 or max(end, t) + GRAM - min(start, f) > 1.5 * words + GRAM:
                    number, start, end = number + 1, f, t
                start, end, before = min(start, f), max(end, t), d
                numbers.append(number)
            out.append(numbers)
        return pd.Series(out, dtype=object)

    listed = placed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("diagonal", "first", "last", "places"))).alias("p"))
    listed = listed.withColumn("a", alignments("n", "p.diagonal", "p.first", "p.last", F.transform("p", lambda x: F.size(x["places"]))))
    grouped = listed.select(*key, F.explode(F.arrays_zip("a", "p")).alias("z")).select(*key, F.col("z.a").alias("alignment"), "z.p.*")
    spans = grouped.groupBy(*key, "alignment").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"),
        (F.max("last") + GRAM - 1).alias("last"),
    )
    words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + GRAM - 1))))
    return spans.select(*key, "first", "last", (F.size(words) / F.col("n")).alias("cover")).filter(
        (F.col("cover") >= COVER) & (F.col("last") - F.col("first") + 1 <= 1.5 * F.col("n") + GRAM)
    )


def base_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(__id, __th, n_words, n_base, first_word, last_word, base_labels) of every row."""
    wanted = [(words_of(p), label) for p, label in PHRASES.items()]

    def count(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            numbers = np.zeros(len(texts), dtype=np.int64)
            places, labels = [[] for _ in texts], [set() for _ in texts]
            for start, end in text_chunks(texts):
                scanned = ByteWords(texts[start:end], _WORD_BYTES)
                words, doc = scanned.hashes(), scanned.doc
                first = np.searchsorted(doc, np.arange(end - start + 1))
                numbers[start:end] = np.diff(first)
                for phrase, label in wanted:
                    k = len(phrase)
                    if len(words) < k:
                        continue
                    m = len(words) - k + 1
                    hit = doc[:m] == doc[k - 1:]
                    for i, h in enumerate(phrase):
                        hit &= words[i:i + m] == h
                    for at in np.flatnonzero(hit):
                        places[start + doc[at]].append(int(at - first[doc[at]]))
                        labels[start + doc[at]].add(label)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(numbers), pa.array([len(p) for p in places], pa.int64()),
                pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
            ], names=["__id", "__th", "n_words", "n_base", "first_word", "last_word", "found"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(*row_key(F.col(text), F.col(doc_id)), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"__id {kind}, __th long, n_words long, n_base long, first_word long, last_word long, found array<string>")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    `labels` has the base labels and the names of verified templates; `score` is
    1 where a base phrase stands and else the best cover of a template.  Null and
    empty texts have no words and score 0; repeated rows get equal results; other
    columns are ignored; an empty table gives an empty table.
    """
    base = base_counts(docs, doc_id, text)
    spans = license_spans(docs, doc_id=doc_id, text=text)
    found = spans.groupBy("__id", "__th").agg(F.collect_set("template").alias("templates"), F.max("cover").alias("cover"))
    joined = null_safe(base, found, ["__id", "__th"], "left")
    every = F.array_sort(F.array_union("found", F.coalesce("templates", F.array().cast("array<string>"))))
    return joined.select(
        F.col("__id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("found", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("cover", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )


@query
def op5_license_diagonals(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))
