"""Weighted rendezvous hashing of stable record keys over shards, with gapless slots.

Every record scores every shard by ``-weight / ln(u)`` with ``u`` in (0, 1) from a hash of
key and shard, and goes to the best. A record's shard depends on its key, the shards and
their weights alone, so a new shard takes records only into itself, in proportion to its
weight. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.tables import settle


def rendezvous_shard(keys: list[str], weights: list[float]) -> Column:
    """The shard (0-based int) of a record; shards with weight 0 take nothing.

    Null keys hash like a value of their own. Equal scores go to the smaller shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")

    def score(shard: int, weight: float) -> Column:
        # Nulls pass a hash unnoticed, so each key comes with a mark of its presence.
        parts = [c for k in keys for c in (F.col(k).isNull(), F.col(k))]
        bits = F.shiftrightunsigned(F.xxhash64(*parts, F.lit(shard)), 11)
        unit = (bits.cast("double") + 0.5) * F.lit(2.0**-53)
        return F.lit(-weight) / F.log(unit)

    scored = [F.struct(score(i, w).alias("score"), F.lit(-i).alias("back")) for i, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*scored))["back"]).cast("int")


def with_slots(placed: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, without one task per shard.

    Every row gets a number, which is written before anything reads it twice; blocks inside a shard are
    dealt by a hash of that number (no key can be hot), and a block's first slot follows
    from the counts of the blocks before it. The number of blocks per shard is the number
    of shuffle partitions.
    """
    spark = placed.sparkSession
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = settle(placed.withColumn("_row", F.monotonically_increasing_id()), "placed")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(shard).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy(shard, "_block").orderBy("_row"))
    numbered = rows.withColumn("_place", inside - 1).join(firsts, [shard, "_block"])
    return numbered.withColumn(slot, F.col("_first") + F.col("_place")).drop("_block", "_first", "_place", "_row")


def shard_documents(
    docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", added: float | None = None
) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    ``law`` is "key": the key and the weighted shards decide. ``size`` is the text's UTF-8
    length plus 1; a null text has size 1 and crc32 0. ``added`` is the weight of one more
    shard (the mean weight unless given); ``grown_shard`` is the shard with it. Records with
    a null key share one shard, as do repeated keys; equal texts under different keys need
    not meet. An empty table gives an empty result; extra columns are ignored.
    """
    more = sum(weights) / len(weights) if added is None else added
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard([key], weights).alias("shard"),
        rendezvous_shard([key], [*weights, more]).alias("grown_shard"),
    )
    return with_slots(placed).select(
        key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
