"""Sharding by rendezvous hashing.

Every (record key, shard) pair has a pseudo-random draw u in (0, 1); a record goes
to the shard with the greatest -weight / ln(u).  A shard's draws do not depend on
the other shards, so a new shard only takes records into itself and a removed one
only gives its own away, in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import bucket_digits, save, spread_key


def draw(key: Column, shard: int) -> Column:
    """u of (key, shard) from 52 bits of an MD5 sum, never 0 or 1."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def best(key: Column, weights: Sequence[float]) -> Column:
    """score and minus (the shard times -1) of the shard of `key`; on equal scores the lower one."""
    return F.array_max(F.array(*[
        F.struct((-weight / F.log(draw(key, shard))).alias("score"), F.lit(-shard).alias("minus"))
        for shard, weight in enumerate(weights)
    ]))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of `key`."""
    return -best(key, weights)["minus"]


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown_weight: float = 1.0) -> DataFrame:
    """One row per row of `docs` (doc_id, text): its shard, and its slot in that shard.

    size is the UTF-8 bytes of the text plus 1, of long texts too; a null text counts as empty; a null
    doc_id has the key "".  Equal keys share a shard.  Slots run from 0 without gaps
    in each shard, in the order of an MD5 sum of key and text; rows alike in both, such as repeated ones, are interchangeable.  They come from two levels, row
    numbers in small buckets plus the sum of the buckets before, so no task holds a
    shard.  grown_shard is the shard with one more shard of `grown_weight`: the present one unless the new one scores higher.
    Other columns of `docs` are not read.  An empty table gives an empty one.
    """
    weights = list(weights)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), best(F.col("doc_id"), weights).alias("_best"))
    new = -grown_weight / F.log(draw(F.col("doc_id"), len(weights)))
    order = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32"))
    rows = save(rows.select(
        "doc_id", "size", "text_crc32", (-F.col("_best.minus")).cast("int").alias("shard"),
        F.when(new > F.col("_best.score"), len(weights)).otherwise(-F.col("_best.minus")).cast("int").alias("grown_shard"), spread_key(order).alias("_order")), "shards")
    rows = rows.withColumn("_bucket", F.substring("_order", 1, bucket_digits(rows.count(), len(weights))))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_bucket").count().select(
        "shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_order", "size", "text_crc32")
    placed = rows.withColumn("_row", F.row_number().over(inside)).join(offsets, ["shard", "_bucket"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_offset") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 8) -> None:
    """Writes `docs` below `path`, one folder `shard=n` for each shard, split into many files."""
    docs.withColumn("shard", rendezvous(F.col("doc_id"), list(weights)).cast("int")).write.partitionBy("shard").parquet(path)
