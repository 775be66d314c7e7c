"""Sinks: pages with their metadata and manifest, the conversion cache, the index, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint, html_to_markdown
from ..session import settled
from ..storage import BUCKETS, BucketTable
from .attachments import cache_additions

STORED = "page_id long, page_md string, metadata string, fingerprint string, n_images long, n_links long"


def stored_pages(pages: DataFrame, ingested_at: Column) -> DataFrame:
    """What is kept of pages (PAGE of sources.wiki): page.md with its title, metadata as JSON with the time of ingestion, the fingerprint and the manifest's counts.

    A null title is "Untitled" and null HTML an empty page.
    """
    html, title = F.coalesce("html", F.lit("")), F.coalesce("title", F.lit("Untitled"))
    body = F.concat(F.lit("# "), title, F.lit("\n\n"), html_to_markdown(html))
    metadata = F.to_json(F.struct(F.col("page_id").alias("id"), title.alias("title"), "space", "version", "url", F.date_format(ingested_at, "yyyy-MM-dd'T'HH:mm:ss").alias("ingested_at")))
    count = lambda tag: F.size(F.regexp_extract_all(html, F.lit(rf"(?i)(<{tag}\s)"))).cast("long")
    return pages.select("page_id", body.alias("page_md"), metadata.alias("metadata"), fingerprint(body).alias("fingerprint"), count("img").alias("n_images"), count("a").alias("n_links"))


def page_table(spark: SparkSession, path: str, schema: str = STORED, buckets: int = BUCKETS) -> BucketTable:
    return BucketTable(spark, path, "page_id", schema, buckets)


def overwrite_pages(table: BucketTable, rows: DataFrame, version: int) -> None:
    """Replaces the pages that `rows` holds and leaves others as they are; a version that fails half-way leaves all as they are.

    The table goes through the rows several times, so they are made once.
    """
    table.upsert(settled(rows, "pages"), version)


def add_to_cache(converted: DataFrame, cache: DataFrame, path: str) -> None:
    """Appends valid conversions that `cache` lacks to the table at `path`."""
    cache_additions(converted, cache).write.mode("append").parquet(path)


def copy_to_index(rows: DataFrame, index: BucketTable, version: int) -> int:
    """Puts pages into an index and returns how many of them can be read back; raises if some are missing."""
    overwrite_pages(index, rows, version)
    wanted = rows.select("page_id").distinct()
    missing = wanted.join(index.read(only=index.touched(wanted)).select("page_id"), "page_id", "left_anti").count()
    if missing:
        raise OSError(f"{missing} pages did not reach the index {index.path}")
    return wanted.count()


def write_text(rows: DataFrame, path: str, column: str) -> None:
    """One text column, one file for each partition; line breaks stay as they are."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


#: A skill: (documents, rules) -> findings with the columns of validation.findings().
Skill = Callable[[DataFrame, DataFrame], DataFrame]


def run_skills(skills: dict[str, Skill], docs: DataFrame, rules: DataFrame, category: str) -> DataFrame | None:
    """Findings of external skills with origin and ran, for validation.collate(); a skill that can't be planned leaves a row per document with ran false."""
    out = None
    for name, skill in skills.items():
        try:
            rows = skill(docs, rules).withColumn("ran", F.lit(True))
        except Exception:  # noqa: BLE001  a failing plug-in must not stop the others
            rows = docs.select("doc_id", F.lit(name).alias("rule_id"), F.lit("SKIPPED").alias("status"), F.lit(False).alias("found"), F.lit(False).alias("ran"))
        rows = rows.withColumn("origin", F.lit(name)).withColumn("category", F.lit(category))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
