"""What the operators share: tables written to the shared folder, and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship

ship(__name__)

#: Rows and bytes of an Arrow batch that holds whole texts.
TEXT_ROWS, TEXT_BYTES = 2000, 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
#: Tasks that a shuffle of parts has at most; further parts follow one another in these.
PART_TASKS = 20_000
#: Bits of a broadcast filter at most, and rows of a key from which it may be joined apart from the others.
MOST_BITS, HOT_ROWS = 1 << 30, 2_000
#: Whether the shuffle files of a query go when it ends, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set and driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back.

    This cuts the lineage: the files outlive any executor, several consumers read
    them instead of repeating the work, and the planner knows their true size.  The
    shuffles behind it have then served their purpose and go at once, so the disk
    holds those of one write at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow with batches small enough for whole texts.

    Spark reads the limits when it runs the plan, so they stay set for the session; smaller ones of the caller's are kept.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    return df.mapInArrow(fn, schema)


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """The rows of each `part` together, in one task; a task has its parts one after the other."""
    return df.repartition(min(parts, PART_TASKS), "part").sortWithinPartitions("part")


def by_part(batches: Iterator, place: int) -> Iterator[Iterator[tuple]]:
    """The rows of one part after the other, read as they come; column `place` of dealt() batches is the part."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, own in groupby(rows, itemgetter(place)):
        yield own


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32(doc_id as text) mod folds is `fold`; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def spread_key(doc_id: Column, seed: str = "") -> Column:
    """Hex digits that order the rows of a table as if at random, the same in every run and engine."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def bucket_digits(rows: int, groups: int = 1, per_bucket: int = 20_000) -> int:
    """Hex digits of spread_key that split `rows` of `groups` even groups into buckets of about `per_bucket`; 2 at least."""
    digits = 2
    while 16**digits * groups * per_bucket < rows:
        digits += 1
    return digits


def bitmap_bits(keys: int) -> int:
    """Bits of a filter for `keys` values: 16 a value, 128 MB in all at most; beyond that more bits are set in vain."""
    bits = 1 << 20
    while bits < 16 * keys and bits < MOST_BITS:
        bits *= 2
    return bits


def key_bitmap(keys: Column, df: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of bits / 8 bytes, whatever the number of rows, with a bit for each value of the long `keys`.

    It tells which keys surely do not occur; a caller must get the same result where a bit is set in vain.
    """
    bit = F.pmod(keys, F.lit(bits)) + 1
    parts = df.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("map"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in parts.toLocalIterator():
        out[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["map"], np.uint8)
    return out


class Filter:
    """A broadcast bitmap of bounded size of the long `keys` of a written table."""

    def __init__(self, keys: DataFrame, name: str):
        self.bits = bitmap_bits(keys.count())
        self.sent = keys.sparkSession.sparkContext.broadcast(key_bitmap(F.col(name), keys, self.bits))

    def has_one(self, key: int) -> bool:
        at = key % self.bits
        return bool(self.sent.value[at >> 3] >> (at & 7) & 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        return in_bitmap(self.sent.value, keys, self.bits)


def wide_hash(*columns: Column) -> Column:
    """16 bytes: two hashes of the columns with different seeds."""
    digits = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(*columns), F.xxhash64(F.lit(0x5DEECE66D), *columns))]
    return F.unhex(F.concat(*digits))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each of `names`, with underscores before it until no column of `df` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def by_group(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """The inner join of `rows` with one row of `groups` for each `key`, which also tells the `size` of the key in `rows`.

    The keys that have more than a thousandth of all rows are fewer than a thousand, so these are
    broadcast and their rows stay where they are; no task gets all rows of one key.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) > max(HOT_ROWS, total // 1000)
    hot = F.broadcast(groups.where(large))
    if not groups.where(large).limit(1).count():
        return rows.join(groups, key)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(groups.where(~large), key))


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = keys % bits
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
