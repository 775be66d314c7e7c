"""Runs of several steps: counts of what passes each step, and work that fails and is tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import settled

#: Characters of an error's text that are kept.
ERROR = 500


class Steps:
    """Counts of the rows that pass named places of a plan, gathered while the plan runs: no second scan."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seen = spark, {}

    def count(self, rows: DataFrame, name: str) -> DataFrame:
        """`rows` as they are; what an action over them counts is the step `name`, in the order of the calls."""
        self.seen[name] = Observation(name)
        return rows.observe(self.seen[name], F.count(F.lit(1)).alias("n"))

    def table(self) -> DataFrame:
        """step, pos, n and line, a line to log; waits for the actions that the steps are part of."""
        rows = [(name, pos, o.get["n"]) for pos, (name, o) in enumerate(self.seen.items(), 1)]
        return self.spark.createDataFrame(rows, "step string, pos int, n long").withColumn("line", F.format_string("[%d] %s: %d rows", "pos", "step", "n"))


def retried(rows: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], attempts: int) -> DataFrame:
    """What attempt(rows, 1) gives, in which error is null where it went well; only what failed is tried again, with 2 and so on, `attempts` times at most.

    Adds attempts, how many a row took, and cuts its last error to ERROR characters.  An attempt keeps the columns of `rows`, and
    the rows that never went well are returned with their error, so none stops the others.
    """
    left, done = rows, None
    for n in range(1, attempts + 1):
        tried = settled(attempt(left, n).withColumn("error", F.substring("error", 1, ERROR)).withColumn("attempts", F.lit(n)), "attempt")
        if n == attempts:
            return tried if done is None else done.unionByName(tried)
        well = tried.where("error is null")
        done = well if done is None else done.unionByName(well)
        left = tried.where("error is not null").select(*rows.columns)
        if left.isEmpty():
            return done
    raise ValueError("attempts must be 1 at least")
