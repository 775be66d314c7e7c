"""Reports: category tables, the merged scorecard and the HTML dashboard as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PASS_FROM, WARN_FROM


def report_rows(found: DataFrame) -> DataFrame:
    """doc_id, category, markdown: a table of the findings of each document and category."""
    line = F.concat(F.lit("| "), "rule_id", F.lit(" | "), "severity", F.lit(" | "), "status", F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return found.groupBy("doc_id", "category").agg(F.concat(F.lit("| Rule | Severity | Status |\n|---|---|---|\n"), body).alias("markdown"))


def score_class(score: Column) -> Column:
    return F.when(score >= PASS_FROM, "score-pass").when(score >= WARN_FROM, "score-warn").otherwise("score-fail")


def merged_report(cards: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, markdown of the scorecard with its critical issues and quick wins."""
    text = F.format_string("# Governance report %s\n\nOverall: %.2f (%s)\n\n| Category | Score |\n|---|---|\n| patterns | %d |\n| standards | %d |\n| security | %d |\n\nCritical issues: %s\n\nQuick wins: %s",
                           F.col("doc_id").cast("string"), "overall", "grade", "patterns_score", "standards_score", "security_score", "critical_issues", "quick_wins")
    return cards.join(issues, "doc_id").select("doc_id", text.alias("markdown"))


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def dashboard(cards: DataFrame, reports: DataFrame) -> DataFrame:
    """doc_id, html: a shell, one closed section for each category, an end."""
    part = F.concat(F.lit("<details><summary>"), "category", F.lit("</summary><pre>"), escaped(F.col("markdown")), F.lit("</pre></details>"))
    parts = reports.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", part.alias("html")))), lambda x: x["html"]), "\n").alias("parts"))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>Governance report</title></head><body>\n<h1 class="'), score_class(F.col("overall")), F.lit('">'), F.format_string("%.2f %s", "overall", "grade"), F.lit("</h1>\n"))
    return cards.join(parts, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce("parts", F.lit("")), F.lit("\n</body></html>")).alias("html"))
