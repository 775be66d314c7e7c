"""Tables of the latest row of each key, in buckets, that are changed bucket by bucket.

A version writes the buckets that it touches into a folder of its own and then a manifest, a single file that says for every bucket in
which version it lies.  Readers follow the last manifest, so they see a version whole or not at all, and a version that
failed half-way leaves the one before readable.  A version that is written again replaces itself.  What a version costs depends on the buckets that
it touches, not on how many came before.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; their number is fixed when it is made, so that one is a fraction of a task's share.
BUCKETS = 64


@dataclass
class BucketTable:
    """The table at `path`; `schema` is that of its rows, `key` the column that names a row."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    buckets: int = BUCKETS

    def bucket_of(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def manifest(self, below: int | None = None) -> dict[int, str]:
        """The folder that each bucket lies in, by the last version, or the last below a given one; a row for each bucket."""
        try:
            rows = self.spark.read.schema("bucket int, folder string, v long").json(f"{self.path}/manifest")
        except AnalysisException:
            return {}
        if below is not None:
            rows = rows.where(F.col("v") < below)
        last = rows.agg(F.max("v").alias("v")).first()["v"]
        return {} if last is None else {r["bucket"]: r["folder"] for r in rows.where((F.col("v") == last) & (F.col("bucket") >= 0)).collect()}

    def read(self, below: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of the last version (below `below`), of the buckets in `only` if given; no others are opened."""
        folders = {b: f for b, f in self.manifest(below).items() if only is None or b in only}
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())])

    def touched(self, keys: DataFrame, name: str | None = None) -> list[int]:
        return sorted(r["b"] for r in keys.select(self.bucket_of(name).alias("b")).distinct().collect())

    def replace(self, rows: DataFrame, version: int, touched: list[int]) -> None:
        """`rows` are all that the buckets in `touched` hold from `version` on; one that they leave empty holds nothing."""
        folders = {b: f for b, f in self.manifest(below=version).items() if b not in touched}
        held, folder = self.touched(rows), f"{version}-{uuid.uuid4().hex}"
        if held:
            rows.withColumn("bucket", self.bucket_of()).repartition(len(held), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        lines = sorted((folders | dict.fromkeys(held, folder)).items()) or [(-1, "")]
        self.spark.createDataFrame(lines, "bucket int, folder string").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v={version}")

    def upsert(self, rows: DataFrame, version: int) -> None:
        """Puts `rows`, one for each key, in the place of those of their keys; other rows of the touched buckets are kept."""
        touched = self.touched(rows)
        if touched:
            kept = self.read(below=version, only=touched).join(rows.select(self.key), self.key, "left_anti")
            self.replace(kept.unionByName(rows.select(*kept.columns)), version, touched)
