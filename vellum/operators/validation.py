"""Documents against rules: evidence, findings, scores, grades."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keywords as K
from ..schemas import PASS_FROM, PROBE_RULES, RULE, SHIPPED_RULES, WARN_FROM, WEIGHTS

#: Rules that are compiled into expressions of one pass over the texts; a larger set goes through an index.
COMPILED_RULES = 500


def rule_table(spark: SparkSession, probes: bool = False) -> DataFrame:
    return spark.createDataFrame(PROBE_RULES if probes else SHIPPED_RULES, RULE)


def keyword_pattern(keyword: str) -> str:
    """Whole words where the keyword begins and ends with a letter or digit, else anywhere; cases alike."""
    plain = re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", keyword)
    if keyword and re.match("[A-Za-z0-9]", keyword[0]) and re.match("[A-Za-z0-9]", keyword[-1]):
        return rf"(^|[^A-Za-z0-9_]){plain}($|[^A-Za-z0-9_])"
    return plain


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, _low (a-z for A-Z) and _words (runs of other characters than letters, digits and _ as one blank, blanks around)."""
    rows = docs.select("doc_id", K.low(F.col("text")).alias("_low"))
    return rows.withColumn("_words", F.concat(F.lit(" "), F.regexp_replace("_low", "[^a-z0-9_]+", " "), F.lit(" ")))


def keyword_test(keyword: str) -> Column:
    """Over prepared(): plain searches; a pattern only for keywords of several words, and only where their text occurs."""
    low = keyword.translate(str.maketrans(K.UPPER, K.LOWER))
    if re.fullmatch("[a-z0-9][a-z0-9_]*[a-z0-9]|[a-z0-9]", low):
        return F.col("_words").contains(f" {low} ")
    pattern = keyword_pattern(low)
    there = F.col("_low").contains(low)
    return there & F.col("_low").rlike(pattern) if pattern.startswith("(^") else there


def evidence(docs: DataFrame, rules: DataFrame, compiled: int = COMPILED_RULES) -> DataFrame:
    """doc_id, rule_id, found: each rule against each text (null: empty), misses included.

    Up to `compiled` rules become one array expression, so texts are read once and
    never shuffled.  Larger sets are found by an index over the keywords (keywords.hits()), where rows
    of one doc_id are one document.  A rule without keywords is found nowhere.
    """
    head = rules.select("rule_id", "keywords").limit(compiled + 1).collect()
    if len(head) <= compiled:
        any_of = lambda words: reduce(lambda a, b: a | b, (keyword_test(w) for w in words or () if w is not None), F.lit(False))
        tests = [F.struct(F.lit(r["rule_id"]).alias("rule_id"), any_of(r["keywords"]).alias("found")) for r in sorted(head, key=lambda r: r["rule_id"])]
        if not tests:
            return docs.select("doc_id", F.lit("").alias("rule_id"), F.lit(False).alias("found")).limit(0)
        return prepared(docs).select("doc_id", F.inline(F.array(*tests)))
    return K.listed(docs, rules, K.hits(docs, rules))


def keyword_hits(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, keyword, n_docs: in how many documents each keyword is evident."""
    pairs = rules.select("rule_id", F.explode("keywords").alias("keyword")).distinct()
    # A keyword is a rule of its own, named by its place.
    named = pairs.select(F.to_json(F.struct("rule_id", "keyword")).alias("rule_id"), F.array("keyword").alias("keywords"))
    counts = evidence(docs, named).groupBy("rule_id").agg(F.count_if("found").alias("n_docs"))
    return counts.select(F.get_json_object("rule_id", "$.rule_id").alias("rule_id"), F.get_json_object("rule_id", "$.keyword").alias("keyword"), "n_docs")


def status(kind: Column, required: Column, found: Column) -> Column:
    return (F.when(kind == "rule", F.when(found, "PASS").when(required, "ERROR").otherwise("WARN"))
            .when(found & (kind == "vulnerability"), "CRITICAL").when(found, "ERROR").otherwise("PASS"))


def findings(docs: DataFrame, rules: DataFrame, origin: str = "builtin") -> DataFrame:
    """One row for each document and rule."""
    facts = F.broadcast(rules.select("rule_id", "category", "kind", "severity", "required").limit(COMPILED_RULES)) if rules.limit(COMPILED_RULES + 1).count() <= COMPILED_RULES else rules
    out = evidence(docs, rules).join(facts.select("rule_id", "category", "kind", "severity", "required"), "rule_id")
    return out.select("doc_id", "rule_id", "category", F.lit(origin).alias("origin"), "kind", "severity", "required", "found",
                      status(F.col("kind"), F.col("required"), F.col("found")).alias("status"))


def points() -> Column:
    """Additive points of a finding."""
    return points_of(F.col("found"))


def points_of(found: Column) -> Column:
    kind, sev, req = F.col("kind"), F.col("severity"), F.col("required")
    rule = (F.when(F.col("category") == "patterns", F.when(req, 15).otherwise(5)).when(F.col("category") == "standards", F.when(req, 12).otherwise(4))
            .otherwise(F.when(sev == "critical", 15).when(sev == "high", 10).otherwise(5)))
    return F.when(~found, 0).when(kind == "rule", rule).when(kind == "anti_pattern", -10).otherwise(-20)


def category_reports(found: DataFrame, scoring: str = "add", error_weight: int = 10, warning_weight: int = 5) -> DataFrame:
    """doc_id, category, score, counts by status, required_status.  scoring "deduct": 100 less weights for errors and warnings.

    Findings of status SKIPPED are counted and leave the score as it is.
    """
    live = F.col("status") != "SKIPPED"
    is_ = lambda s: F.count_if(F.col("status") == s)
    errors = F.count_if(F.col("status").isin("ERROR", "CRITICAL"))
    raw = F.sum(F.when(live, points()).otherwise(0)) if scoring == "add" else 100 - errors * error_weight - is_("WARN") * warning_weight
    missing = F.bool_or(live & (F.col("kind") == "rule") & F.col("required") & ~F.col("found"))
    return found.groupBy("doc_id", "category").agg(
        F.least(F.lit(100), F.greatest(F.lit(0), raw)).cast("long").alias("score"),
        F.count(F.lit(1)).alias("total"), is_("PASS").alias("n_pass"), is_("WARN").alias("n_warn"), is_("ERROR").alias("n_error"),
        is_("CRITICAL").alias("n_critical"), is_("SKIPPED").alias("n_skipped"), F.when(missing, "FAIL").otherwise("PASS").alias("required_status"))


def hits(docs: DataFrame, rules: DataFrame, compiled: int = COMPILED_RULES) -> DataFrame:
    """doc_id, rule_id: the rules that are evident in each document; rows of one doc_id are one document."""
    if rules.limit(compiled + 1).count() > compiled:
        return K.hits(docs, rules)
    return evidence(docs, rules, compiled).where("found").select("doc_id", "rule_id").distinct()


def reports_of_hits(docs: DataFrame, rules: DataFrame, found: DataFrame, scoring: str = "add", error_weight: int = 10, warning_weight: int = 5) -> DataFrame:
    """The rows of category_reports(), from hits alone: what the misses add is the same for every document and is counted once, over the rules.

    A document has a row for each category that has rules.
    """
    facts = rules.select("rule_id", "category", "kind", "severity", "required")
    of = lambda found, name: status(F.col("kind"), F.col("required"), F.lit(found)).alias(name)
    required = ((F.col("kind") == "rule") & F.col("required")).cast("int").alias("need")
    facts = facts.select("rule_id", "category", of(True, "if_found"), of(False, "if_missed"), points_of(F.lit(True)).alias("points"), required)
    names = ("PASS", "WARN", "ERROR", "CRITICAL")
    misses = facts.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.sum("need").alias("needed"), *[F.count_if(F.col("if_missed") == s).alias(f"base_{s}") for s in names])
    gain = [F.sum((F.col("if_found") == s).cast("int") - (F.col("if_missed") == s).cast("int")).alias(f"more_{s}") for s in names]
    got = found.join(K.few(facts), "rule_id").groupBy("doc_id", "category").agg(F.sum("points").alias("points"), F.sum("need").alias("met"), *gain)
    # The categories are a handful of rows, which every document gets as one value.
    base = [F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in misses.collect()]
    if not base:
        return category_reports(docs.select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (("category", "string"), ("status", "string"), ("kind", "string"), ("severity", "string"), ("required", "boolean"), ("found", "boolean"))]).limit(0))
    every = docs.select("doc_id").distinct().select("doc_id", F.inline(F.array(*base)))
    rows = every.join(got, ["doc_id", "category"], "left")
    n = lambda s: (F.col(f"base_{s}") + F.coalesce(F.col(f"more_{s}"), F.lit(0)))
    raw = F.coalesce("points", F.lit(0)) if scoring == "add" else 100 - (n("ERROR") + n("CRITICAL")) * error_weight - n("WARN") * warning_weight
    return rows.select(
        "doc_id", "category", F.least(F.lit(100), F.greatest(F.lit(0), raw)).cast("long").alias("score"), "total", n("PASS").alias("n_pass"), n("WARN").alias("n_warn"), n("ERROR").alias("n_error"),
        n("CRITICAL").alias("n_critical"), F.lit(0).cast("long").alias("n_skipped"), F.when(F.col("needed") > F.coalesce("met", F.lit(0)), "FAIL").otherwise("PASS").alias("required_status"))


def reports(docs: DataFrame, rules: DataFrame, scoring: str = "add") -> DataFrame:
    """The category reports of documents, with no row for what is not found."""
    return reports_of_hits(docs, rules, hits(docs, rules), scoring)


def grade(score: Column) -> Column:
    return F.when(score >= PASS_FROM, "PASS").when(score >= WARN_FROM, "WARN").otherwise("FAIL")


def scorecards(reports: DataFrame) -> DataFrame:
    """doc_id, a score for each category, overall and grade; a category without report scores 0."""
    of = lambda c: F.coalesce(F.max(F.when(F.col("category") == c, F.col("score"))), F.lit(0))
    table = reports.groupBy("doc_id").agg(*[of(c).alias(f"{c}_score") for c in WEIGHTS], F.max("required_status").alias("_high"), F.min("required_status").alias("_low"))
    overall = sum(F.col(f"{c}_score") * w for c, w in WEIGHTS.items()) / F.lit(100.0)
    return table.select("doc_id", *[f"{c}_score" for c in WEIGHTS], overall.alias("overall"), grade(overall).alias("grade"), F.col("_low").alias("required_status"))


def risk_levels(found: DataFrame) -> DataFrame:
    """doc_id, risk_level from the security findings: CRITICAL, HIGH, MEDIUM or LOW."""
    rows = found.where(F.col("category") == "security")
    missing = (F.col("kind") == "rule") & F.col("required") & ~F.col("found")
    level = F.max(F.when(F.col("status") == "CRITICAL", 3).when(missing & (F.col("severity") == "critical"), 3).when(missing & (F.col("severity") == "high"), 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return rows.groupBy("doc_id").agg(level.alias("_level")).select("doc_id", F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), F.col("_level") + 1).alias("risk_level"))


def issue_lists(found: DataFrame) -> DataFrame:
    """doc_id, critical_issues (ids of errors) and quick_wins (ids of warnings), each sorted and joined by commas."""
    ids = lambda *s: F.array_join(F.sort_array(F.collect_list(F.when(F.col("status").isin(*s), F.col("rule_id")))), ",")
    return found.groupBy("doc_id").agg(ids("ERROR", "CRITICAL").alias("critical_issues"), ids("WARN").alias("quick_wins"))


def status_pivot(found: DataFrame) -> DataFrame:
    return found.groupBy("category").pivot("status", ["PASS", "WARN", "ERROR", "CRITICAL"]).count().na.fill(0)


def severity_rollup(rules: DataFrame) -> DataFrame:
    """Rules by severity, and all of them as `all`."""
    return rules.rollup("severity").agg(F.count(F.lit(1)).alias("n_rules")).select(F.coalesce("severity", F.lit("all")).alias("severity"), "n_rules")


def collate(builtin: DataFrame, external: DataFrame | None, registry: DataFrame, category: str) -> DataFrame:
    """Findings of a category with those of external skills.

    `external` has the columns of findings and `ran` (false: the skill failed).  Skills of
    another category are left out; a failed skill leaves a SKIPPED row.
    """
    if external is None:
        return builtin
    known = external.join(registry.where(F.col("category") == category).select(F.col("name").alias("origin")), "origin", "left_semi")
    rows = known.withColumn("status", F.when(F.col("ran"), F.col("status")).otherwise("SKIPPED")).withColumn("found", F.coalesce("found", F.lit(False)))
    return builtin.unionByName(rows.drop("ran"), allowMissingColumns=True)


def grounded(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings that cite a known rule."""
    return found.join(rules.select("rule_id"), "rule_id", "left_semi")
