"""A registry of skills, rules of one's own that are added to those that ship, whose state at any version can be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BucketTable
from . import keywords

SKILL = "name string, category string, keywords array<string>"


class SkillRegistry:
    """Skills by name in a table of buckets at `path`; each change is a version, and versions are counted up by the caller.

    A change that would add a known name, or update or remove an unknown one, is refused as a whole with the names at fault.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 4):
        self.table = BucketTable(spark, path, "name", SKILL, buckets)

    def list(self, version: int | None = None, category: str | None = None) -> DataFrame:
        """The skills after `version` (the last, if not given), of one category if asked."""
        rows = self.table.read(below=None if version is None else version + 1)
        return rows if category is None else rows.where(F.col("category") == category)

    def add(self, skills: DataFrame, version: int) -> None:
        self._refuse(skills.join(self.list(version - 1), "name", "left_semi"), "known already")
        self.table.upsert(skills, version)

    def update(self, skills: DataFrame, version: int) -> None:
        self._refuse(skills.join(self.list(version - 1), "name", "left_anti"), "not known")
        self.table.upsert(skills, version)

    def remove(self, names: DataFrame, version: int) -> None:
        self._refuse(names.join(self.list(version - 1), "name", "left_anti"), "not known")
        touched = self.table.touched(names)
        self.table.replace(self.table.read(below=version, only=touched).join(names, "name", "left_anti"), version, touched)

    def findings(self, docs: DataFrame, version: int | None = None, category: str | None = None) -> DataFrame:
        """doc_id, name: the skills, as they were at `version`, with a keyword in the document (doc_id, text)."""
        found = keywords.hits(docs, self.list(version, category).withColumnRenamed("name", "rule_id"))
        return found.withColumnRenamed("rule_id", "name")

    @staticmethod
    def _refuse(wrong: DataFrame, why: str) -> None:
        names = [r["name"] for r in wrong.select("name").limit(20).collect()]
        if names:
            raise ValueError(f"skills {why}: {', '.join(sorted(names))}")
