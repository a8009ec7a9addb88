"""Op 2: weighted rendezvous hashing of stable record keys."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import documents, query, ranked


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard that wins the key: the largest -weight / ln(u) over all shards,
    u a hash of key and shard in (0, 1).

    The score of a shard does not depend on the others: a new shard takes rows
    only into itself, a removed one gives away only its own, and a changed
    weight moves rows only to or from that shard, in proportion to the weights.
    A null key is a key of its own.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def score(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s["shard"]), 11) + 0.5) / float(1 << 53)
        return F.struct((-s["w"] / F.ln(u)).alias("score"), (-s["shard"]).alias("minus"))

    return -F.array_max(F.transform(shards, score))["minus"]


def shard_records(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", weights: list[float] | None = None
) -> DataFrame:
    """Every record with its shard, its slot in the shard and the shard it would
    have if one more were there.

    Columns: key, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard,
    slot, grown_shard.  The text is read once and never shuffled.  Slots are
    gapless per shard; repeated rows get slots of their own.  A null text has
    size 8 and no checksum, a null key is placed like any other; other columns
    of the input are ignored; an empty table gives an empty table.
    """
    weights = weights or [1.0] * shards
    if len(weights) != shards:
        raise ValueError("one weight per shard")
    grown = [*weights, sum(weights) / shards]
    record = F.col(key)
    rows = docs.select(
        record.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous_shard(record, weights).alias("shard"),
        rendezvous_shard(record, grown).alias("grown_shard"),
    )
    return ranked(rows, ["shard"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query
def op2_rendezvous_sharding(spark, sf_dir):
    return shard_records(documents(spark, sf_dir), 24)
