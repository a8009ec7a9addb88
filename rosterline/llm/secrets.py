"""Op 9: secret scans with corpus-wide ownership frequency."""

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import documents, null_safe, query, row_key, stored
from rosterline.operators.skew import spread_join

#: Kinds in the order of the contract; "entropy" is the method's own.
KINDS = ["assign", "access", "hex", "entropy"]
#: Base patterns: fixed values of the query's contract.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The method's own candidates: long runs of token characters that mix kinds and look random.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
LEAST_BITS = 3.5
#: A value is taken for a published example if more than this share of all owners (and more than one) hold it, in
#: as many repositories of different text.  A value of one owner is that owner's, however often it stands.
LIVE_OWNERS = 0.1


def entropy_bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, secret value) of a whole text, in order."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    runs = list(RUN.finditer(text))
    # a hex run may stand inside other characters, so it is searched on its own
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    base = [(s, e) for s, e, _, _ in found]
    for m in runs:
        value = m[0]
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        if mixed and entropy_bits(value) >= LEAST_BITS and not any(s < m.end() and m.start() < e for s, e in base):
            found.append((m.start(), m.end(), 3, value))
    return sorted(found)


def spans_text(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, *_ in found)


def scan_candidates(docs: DataFrame, doc_id: str, text: str, owner: str, repository: str) -> DataFrame:
    """(__id, __th, owner, repository, n_assign, n_access, n_hex, base_sha256, found) of every row."""

    def scan(batches):
        struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("hash", pa.string())])
        for batch in batches:
            every = [candidates(t) for t in batch.column(4).to_pylist()]
            count = lambda kind: pa.array([sum(f[2] == kind for f in found) for found in every], pa.int64())
            digest = [hashlib.sha256(spans_text([f for f in found if f[2] < 3]).encode()).hexdigest() for found in every]
            rows = [[(s, e, k, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]) for s, e, k, v in found] for found in every]
            named = [[dict(zip(("start", "end", "kind", "hash"), r)) for r in found] for found in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], count(0), count(1), count(2), pa.array(digest), pa.array(named, pa.list_(struct))],
                names=["__id", "__th", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    kind = dict(docs.dtypes)
    rows = docs.select(
        *row_key(F.col(text), F.col(doc_id)), F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"), F.col(text).alias("text"),
    )
    return rows.mapInArrow(
        scan,
        f"__id {kind[doc_id]}, __th long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "found array<struct<start:int, end:int, kind:int, hash:string>>",
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate value in the corpus.

    Exact copies of a text count as one repository, and so do several texts of
    one.  Distinct tuples are made before the counts, each combined before its
    shuffle: a value that stands in a third of all rows costs a row per task.
    Null owners and repositories count as one each.
    """
    each = lambda c: F.coalesce(c, F.lit("\0none")).alias(c)
    tuples = found.select("hash", each("owner"), each("repository"), "__th").distinct()
    return tuples.groupBy("hash").agg(
        F.count_distinct("owner").alias("owners"),
        F.least(F.count_distinct("repository"), F.count_distinct("__th")).alias("repositories"),
    )


def scan_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id"
) -> DataFrame:
    """Secrets of every document: the digest columns of the query, then verdicts.

    `spans` has all base spans and, as kind entropy, random-looking runs whose
    value is live.  n_live counts the spans whose value is live, n_example the
    widely copied ones, owners the most owners of any value in the document.  A
    document copied as it is to many owners makes no example, nor does one owner who
    uses a value in many documents.  Null and empty texts have no spans;
    repeated rows get equal results and count once; other columns are ignored; an
    empty table gives an empty table.
    """
    rows = stored(scan_candidates(docs, doc_id, text, owner, repository))
    each = rows.select("__id", "__th", "owner", "repository", F.explode("found").alias("f")).select(
        "__id", "__th", "owner", "repository", "f.*"
    )
    known = ownership(each)
    judged = spread_join(each.drop("owner", "repository").distinct(), known, ["hash"], "inner", ["__id", "__th", "start"])
    owners = rows.agg(F.count_distinct(F.coalesce("owner", F.lit("\0none")))).first()[0]
    wide = F.least("owners", "repositories") > max(1, math.floor(LIVE_OWNERS * owners))
    live = ~wide
    shown = judged.filter((F.col("kind") < 3) | live)
    span = F.struct("start", "kind", "end")
    per = shown.groupBy("__id", "__th").agg(
        F.sort_array(F.collect_list(span)).alias("s"), F.sum(live.cast("long")).alias("n_live"),
        F.sum((~live).cast("long")).alias("n_example"), F.max("owners").alias("owners"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
    joined = null_safe(rows.drop("found", "owner", "repository"), per, ["__id", "__th"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        F.col("__id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.transform("s", one), ","), F.lit("")).alias("spans"),
        zero("n_live"), zero("n_example"), zero("owners"),
    )


@query
def op9_secret_ownership(spark, sf_dir):
    return scan_secrets(documents(spark, sf_dir))
