"""A session with the settings that the engine is tuned for, and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch that goes to a parser.
BATCH_ROWS, BATCH_BYTES = 64, 1 << 20
#: Rows of a table up to which Spark may broadcast it by the size of its files.
SENT = 200_000


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, UTC, skew handling; a cluster's own settings win where given."""
    builder = SparkSession.builder.appName("vellum")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, one of our own if driver and executors are one machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches() -> None:
    """Arrow batches of whole files and pages hold a few MB: a worker's memory depends on these, not on the rows of a task.

    Spark reads the limits when it runs a plan, so they stay set for the session; smaller ones of the caller's are kept.
    """
    spark = SparkSession.active()
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(spark.conf.get(name))
        except (TypeError, ValueError):
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def shuffled(df: DataFrame, many: bool | None = None) -> DataFrame:
    """`df`, a settled table or what is derived of one, to be joined by a shuffle if it has `many` rows, which are counted if not given.

    Files of columns that are much alike are far smaller than their rows, which the driver would have to hold for a broadcast.
    """
    many = df.limit(SENT + 1).count() > SENT if many is None else many
    return df.hint("merge") if many else df


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written once to the shared folder and read from there: several consumers share it, and lost executors cost no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
