"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is a number of equal-token blocks.  Sources get blocks by highest quotients
target / (k - 1/2), so each has an integer quota, and the blocks of all sources are dealt to the shards
in turn, so each source has an integer quota of every shard.  A source's documents, in an order
drawn from the seed, stand end to end and are cut into blocks; a seeded permutation of these
says which come first.  Picks go through the permutation, lap after lap, until the source has its
target; the last picked block is taken in part.  A document gives the words that picked blocks take of it, to
the shards that the picks fall to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, bucket_digits, save, spread_key, unused

#: Fixed values of the contract: weights in turn, the share of all tokens to take, the most a source may be repeated.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Tokens of a block at most; blocks are smaller where they would be coarse, so that an even mix has some 1000 blocks a source.
BLOCK_TOKENS, BLOCKS_A_SOURCE = 256, 1000
#: Shards that the blocks are dealt to.
SHARDS = 8
#: Primes of which one that divides no number of blocks is the stride of a permutation; no four of them divide one number below 2^63.
STRIDES = (611953, 704269, 799999, 868771, 927001, 999983)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, rank, target.

    Sources by code point, null last, have the weights in turn.  Targets fill up to
    most * source_size and what is above is shared again by weight.  The sources that
    end at their limit are those with the least limit / weight, so one ordered pass
    over the sources finds the level at which the others stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    everything = Window.partitionBy()
    table = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
             .withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
             .withColumn("limit", (F.col("source_size") * most).cast("double"))
             .withColumn("total", F.sum("source_size").over(everything) * share))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    level = (F.col("total") - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("full", F.col("limit") / F.col("weight") <= level)
    rest = (F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)) / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    return table.select("source", "source_size", "rank", "total",
                        F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * rest).alias("target"))


def apportion(targets: DataFrame, most: int = MOST) -> DataFrame:
    """Adds block (tokens of one), quota (blocks of the source) and first (the blocks of the sources before) to source_targets().

    Every source surely has the seats whose quotient is above total / (blocks - n/2),
    n sources having less than n seats more among them; only the quotients near that
    line are listed and ranked, ties by source.  No quota exceeds most * source_size.
    """
    everything = Window.partitionBy()
    n = F.count(F.lit(1)).over(everything)
    table = targets.withColumn("n", n.cast("double")).withColumn("block", F.greatest(F.lit(1), F.least(
        F.lit(BLOCK_TOKENS), F.floor(F.col("total") / (F.col("n") * BLOCKS_A_SOURCE)))).cast("long"))
    table = table.withColumn("blocks", F.round(F.col("total") / F.col("block")).cast("long"))
    table = table.withColumn("limit", F.floor(F.col("source_size") * most / F.col("block")).cast("long"))
    line = F.col("total") / F.nullif(F.greatest(F.col("blocks") - F.col("n") / 2, F.lit(0.0)), F.lit(0.0))
    sure = F.greatest(F.lit(0), F.coalesce(F.floor(F.col("target") / line + 0.5), F.lit(0)) - 1)
    table = table.withColumn("sure", F.least(sure.cast("long"), F.col("limit")))
    table = table.withColumn("open", F.col("blocks") - F.sum("sure").over(everything))
    more = F.least(F.col("limit"), F.col("sure") + 8 + 2 * F.ceil(F.coalesce(F.col("target") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0)) * F.col("n")))
    seats = table.where("limit > sure").select(
        "rank", "target", "open", F.explode(F.sequence(F.col("sure") + 1, more.cast("long"))).alias("k"))
    won = (seats.withColumn("place", F.row_number().over(Window.orderBy((F.col("target") / (F.col("k") - 0.5)).desc(), "rank", "k")))
           .where("place <= open and target > 0").groupBy("rank").agg(F.count(F.lit(1)).alias("won")))
    table = table.join(won, "rank", "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0)))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return table.select("source", "source_size", "rank", "target", "block", "quota", F.coalesce(F.sum("quota").over(before), F.lit(0)).alias("first"))


def shard_quotas(apportioned: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source, shard, blocks: the blocks of all sources, end to end by rank, dealt to the shards in turn."""
    dealt = apportioned.select("source", "first", "quota", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    offset = F.pmod(F.col("shard") - F.col("first"), F.lit(shards))
    return dealt.select("source", "shard", F.greatest(F.lit(0), F.ceil((F.col("quota") - offset) / shards)).cast("long").alias("blocks"))


def seeded(seed: str, source: Column) -> Column:
    """A number of 32 bits for a source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")


def selection(apportioned: DataFrame, seed: str) -> DataFrame:
    """Adds to apportion(): n (blocks that the source is cut into), stride and shift of the permutation, laps (full ones), rest (words of the last lap), odd (place of the shorter block in the permutation).

    Block i is the (i * stride + shift) mod n-th of a lap.
    """
    n = F.greatest(F.ceil(F.col("source_size") / F.col("block")), F.lit(1)).cast("long")
    number = seeded(seed, F.col("source"))
    strides = F.filter(F.array(*[F.lit(p) for p in STRIDES]), lambda p: F.col("n") % p != 0)
    words = F.floor(F.col("target") + 0.5).cast("long")
    table = apportioned.withColumn("n", n).withColumn("shift", number % F.col("n"))
    table = table.withColumn("stride", F.element_at(strides, (number % F.size(strides) + 1).cast("int")).cast("long"))
    return table.select(
        "*", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long").alias("laps"),
        F.when(F.col("source_size") > 0, words % F.col("source_size")).otherwise(0).cast("long").alias("rest"),
        (((F.col("n") - 1) * F.col("stride") + F.col("shift")) % F.col("n")).alias("odd"))


def picked(at: Column, size: Column) -> Column:
    """Words by shard, an array of SHARDS numbers, that the picks of selection() take of the `size` words from `at` on in their source."""
    c = F.col
    last = c("source_size") - (c("n") - 1) * c("block")

    def of_block(i: Column) -> Column:
        place = (i * c("stride") + c("shift")) % c("n")
        before = place * c("block") - F.when(c("odd") < place, c("block") - last).otherwise(0)
        inside = F.least(at + size, (i + 1) * c("block")) - F.greatest(at, i * c("block"))
        part = F.greatest(F.lit(0), F.least(at + size, i * c("block") + F.greatest(F.lit(0), c("rest") - before)) - F.greatest(at, i * c("block")))
        # Every full lap takes the block whole; the last lap what its rest leaves for it.
        return F.transform(F.sequence(F.lit(0).cast("long"), c("laps")), lambda lap: F.struct(
            F.pmod(c("first") + lap * c("n") + place, F.lit(SHARDS)).alias("shard"), F.when(lap < c("laps"), inside).otherwise(F.least(part, inside)).alias("words")))

    picks = F.flatten(F.transform(F.sequence(F.floor(at / c("block")).cast("long"), F.floor((at + size - 1) / c("block")).cast("long")), of_block))
    sums = F.aggregate(picks, F.array_repeat(F.lit(0).cast("long"), SHARDS), lambda total, pick: F.transform(total, lambda x, s: x + F.when(s == pick["shard"], pick["words"]).otherwise(0)))
    return F.when(size > 0, sums).otherwise(F.array_repeat(F.lit(0).cast("long"), SHARDS))


def mix_documents(docs: DataFrame, seed: str = "mix", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, size, source_size, target, taken, shard_taken, source, text_hash.

    size is the number of words, 0 for a null or empty text; long texts are counted whole.  taken is the words of the mix that
    come from the document, at most `most` times its size, and shard_taken tells them by shard; documents on the edge of
    a block are taken in part.  A source's taken words are its target, rounded to a word.  Null is a source of its own; an empty table
    gives an empty one; equal doc_ids are ordered by size and text, and what is then alike is interchangeable.  Other columns are not read.
    """
    digits = bucket_digits(docs.count())
    text_hash = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    sizes = docs.select("doc_id", "source", text_hash.alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    order = F.when(F.col("doc_id").isNull(), F.concat(F.lit("null:"), "text_hash")).otherwise(F.col("doc_id").cast("string"))
    sizes = save(sizes.withColumn("_order", spread_key(order, seed)).withColumn("_bucket", F.substring("_order", 1, digits)), "mix-sizes")
    quotas = save(selection(apportion(source_targets(sizes, weights, share, most), most), seed), "mix-quotas").withColumnRenamed("source", "_source").drop("quota", "rank")
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")).select(
        F.col("source").alias("_source2"), F.col("_bucket").alias("_bucket2"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("_source2")) & (F.col("_bucket") == F.col("_bucket2")))
    rows = rows.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_at", F.col("_offset") + F.col("_inside"))
    rows = rows.withColumn("shard_taken", picked(F.col("_at"), F.col("size")))
    return rows.select("doc_id", "size", "source_size", "target", F.aggregate("shard_taken", F.lit(0).cast("long"), lambda a, b: a + b).alias("taken"), "shard_taken", "source", "text_hash")


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it: taken / size, rounded; rows alike in doc_id, source and text equally often.

    Documents without words go.  Columns of any name are kept; an empty table gives an empty one.
    """
    found = mix_documents(docs, seed).groupBy("doc_id", "source", "text_hash").agg(
        F.floor(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0)) + 0.5).cast("int").alias("copies"))
    names = unused(docs, "same_id", "same_source", "same_hash", "same_copies", "same_copy")
    found = found.where("copies > 0").select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "source", "text_hash", "copies"), names)])
    same_id, same_source, same_hash, copies, copy = names
    text_hash = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    same = F.col("doc_id").eqNullSafe(F.col(same_id)) & F.col("source").eqNullSafe(F.col(same_source)) & (text_hash == F.col(same_hash))
    rows = docs.join(found.hint("shuffle_hash"), same)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
