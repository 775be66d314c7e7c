"""Incremental refresh: page versions come as a stream, and only what changed is worked on.

What is known of pages lies in a table of buckets; a micro-batch reads and rewrites the buckets of its own pages
and no history, and it replaces itself if it runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..session import settled
from ..storage import BUCKETS, BucketTable


def changed(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """The latest row of each page in a batch (page_id, version, content) with print, without those whose content is known.

    print is the SHA-256 of the whole content, empty for null.  With a state (page_id, version, print), versions below the known one are old news.
    """
    newest = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("version").desc(), "content"))
    rows = batch.withColumn("_n", newest).where("_n = 1").drop("_n").withColumn("print", F.coalesce(content_hash(F.col("content")), F.lit("")))
    if state is None:
        return rows
    known = state.select(F.col("page_id").alias("_page"), F.col("version").alias("_version"), F.col("print").alias("_print"))
    both = rows.join(known, F.col("page_id") == F.col("_page"), "left")
    return both.where(F.col("_page").isNull() | ((F.col("_print") != F.col("print")) & (F.col("version") >= F.col("_version")))).select(*rows.columns)


def pages_table(spark: SparkSession, target: str, schema: str, buckets: int = BUCKETS) -> BucketTable:
    return BucketTable(spark, target, "page_id", schema, buckets)


def refresh(stream: DataFrame, target: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame], schema: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Upserts derive(changed pages) into the table of buckets at `target`, whose rows have `schema`.

    `derive` keeps page_id, version and print, one row a page.  A page without page_id is left out.
    """
    table = pages_table(stream.sparkSession, target, schema, buckets)

    def upsert(batch: DataFrame, epoch: int) -> None:
        own = settled(batch.where("page_id is not null"), "refresh-batch")
        state = table.read(below=epoch, only=table.touched(own))
        rows = settled(derive(changed(own, state)), "refresh-derived")
        table.upsert(rows, epoch)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """The latest derived row of each page."""
    return pages_table(spark, target, schema, buckets).read()


def deduplicated(events: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """A stream without repeated keys inside the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
