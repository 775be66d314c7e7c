"""Whether derived rules are current with their pages, and what to refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint, stored_fingerprint


def file_status(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, status, reason, fingerprints and times.

    `pages`: page_id, content, mtime; `rules`: page_id, content, mtime.  Ids that start
    with a dot are hidden.  The fingerprint decides where both are known, else the time.
    """
    p = pages.select(F.col("page_id").alias("p_id"), fingerprint(F.col("content")).alias("source_fingerprint"), F.col("mtime").alias("source_mtime"))
    r = rules.select(F.col("page_id").alias("r_id"), stored_fingerprint(F.coalesce("content", F.lit(""))).alias("rules_fingerprint"), F.col("mtime").alias("rules_mtime"))
    both = p.join(r, F.col("p_id") == F.col("r_id"), "full_outer")
    printed = (F.col("source_fingerprint") != "") & (F.col("rules_fingerprint") != "")
    differs = F.col("source_fingerprint") != F.col("rules_fingerprint")
    newer = F.col("source_mtime") > F.col("rules_mtime")
    status = (F.when(F.col("p_id").isNull(), "orphan").when(F.col("r_id").isNull(), "missing")
              .when(printed, F.when(differs, "stale").otherwise("current")).when(newer, "stale").otherwise("current"))
    reason = (F.when(F.col("p_id").isNull(), "source deleted").when(F.col("r_id").isNull(), "no rules")
              .when(printed & differs, "fingerprint differs").when(printed, "fingerprint equal").when(newer, "source newer").otherwise("rules newer"))
    out = both.select(F.coalesce("p_id", "r_id").alias("page_id"), status.alias("status"), reason.alias("reason"),
                      "source_fingerprint", "rules_fingerprint", "source_mtime", "rules_mtime")
    return out.where(~F.col("page_id").cast("string").startswith("."))


def summary(status: DataFrame, consolidated_missing: bool = False) -> DataFrame:
    """Counts by status; `total` leaves orphans out, `total_json` counts all rows and a missing consolidated file."""
    n = lambda s: F.count_if(F.col("status") == s)
    return status.agg(n("stale").alias("stale"), n("missing").alias("missing"), n("current").alias("current"), n("orphan").alias("orphan"),
                      F.count_if(F.col("status") != "orphan").alias("total"), (F.count(F.lit(1)) + int(consolidated_missing)).alias("total_json"))


def consolidated(status: DataFrame, folders: DataFrame, present: bool = True) -> DataFrame:
    """folder, status of each folder's consolidated rules; `folders` maps page_id to folder.  An empty folder has no row."""
    bad = F.bool_or(F.col("status").isin("stale", "missing"))
    if not present:
        return status.join(folders, "page_id").groupBy("folder").agg(F.lit("missing").alias("status"))
    return status.join(folders, "page_id").groupBy("folder").agg(F.when(bad, "stale").otherwise("current").alias("status"))


def to_refresh(status: DataFrame) -> DataFrame:
    return status.where(F.col("status").isin("stale", "missing")).select("page_id")


def report_json(status: DataFrame) -> DataFrame:
    """page_id, line: each status as a JSON object."""
    return status.select("page_id", F.to_json(F.struct("page_id", "status", "reason", "source_fingerprint", "rules_fingerprint")).alias("line"))


def page_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """page_id, change between two versions tables (page_id, version): added, removed, updated or same."""
    b, a = before.select("page_id", F.col("version").alias("old")), after.select("page_id", F.col("version").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") > F.col("old"), "updated").otherwise("same")
    return b.join(a, "page_id", "full_outer").select("page_id", change.alias("change"))
