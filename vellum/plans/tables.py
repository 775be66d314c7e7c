"""Tables derived from the driver's, in the shapes that the operators take, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.validation import keyword_pattern
from ..schemas import EDGE_STYLES, PROBE_RULES, SHAPES, SHIPPED_RULES


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quoted(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(quoted, value)) + "]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows: list[tuple], columns: str) -> str:
    """A SELECT of literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({columns})"


def rules_sql(probes: bool) -> str:
    """rules and kw (one row for each keyword, with its pattern)."""
    rows = PROBE_RULES if probes else SHIPPED_RULES
    kw = [(r[0], k, keyword_pattern(k)) for r in rows for k in dict.fromkeys(r[5])]
    return f"rules AS ({values([r[:5] for r in rows], 'rule_id, category, kind, severity, required')}), kw AS ({values(kw, 'rule_id, keyword, pattern')})"


def findings_sql(probes: bool) -> str:
    return rules_sql(probes) + """, evid AS (
  SELECT d.doc_id, k.rule_id, bool_or(regexp_matches(coalesce(d.text, ''), k.pattern, 'i')) AS found FROM documents d CROSS JOIN kw k GROUP BY ALL),
findings AS (
  SELECT e.doc_id, r.*, e.found,
    CASE WHEN r.kind = 'rule' THEN CASE WHEN e.found THEN 'PASS' WHEN r.required THEN 'ERROR' ELSE 'WARN' END
         WHEN NOT e.found THEN 'PASS' WHEN r.kind = 'vulnerability' THEN 'CRITICAL' ELSE 'ERROR' END AS status
  FROM evid e JOIN rules r USING (rule_id))"""


def reports_sql(probes: bool) -> str:
    return findings_sql(probes) + """, reports AS (
  SELECT doc_id, category, greatest(0, least(100, sum(CASE WHEN NOT found THEN 0
      WHEN kind = 'anti_pattern' THEN -10 WHEN kind = 'vulnerability' THEN -20
      WHEN category = 'patterns' THEN CASE WHEN required THEN 15 ELSE 5 END WHEN category = 'standards' THEN CASE WHEN required THEN 12 ELSE 4 END
      WHEN severity = 'critical' THEN 15 WHEN severity = 'high' THEN 10 ELSE 5 END)))::BIGINT AS score,
    count(*) AS total, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'WARN') AS n_warn,
    count(*) FILTER (status = 'ERROR') AS n_error, count(*) FILTER (status = 'CRITICAL') AS n_critical,
    CASE WHEN bool_or(kind = 'rule' AND required AND NOT found) THEN 'FAIL' ELSE 'PASS' END AS required_status
  FROM findings GROUP BY ALL),
cards AS (
  SELECT doc_id, patterns_score, standards_score, security_score, (patterns_score * 30 + standards_score * 30 + security_score * 40)::DOUBLE / 100 AS overall, required_status FROM (
    SELECT doc_id, coalesce(max(score) FILTER (category = 'patterns'), 0) AS patterns_score, coalesce(max(score) FILTER (category = 'standards'), 0) AS standards_score,
      coalesce(max(score) FILTER (category = 'security'), 0) AS security_score, min(required_status) AS required_status FROM reports GROUP BY doc_id))"""


# A graph for each user: events are nodes, and one event leads to the next.

def event_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("diagram_id"), pos.alias("pos"), F.concat(F.lit("n"), i).alias("id"), F.concat("event_type", F.lit(" "), i % 5).alias("label"),
        F.element_at(F.array(*map(F.lit, SHAPES)), (i % 7 + 1).cast("int")).alias("shape"), (i * 37 % 400).cast("double").alias("x"), (i * 91 % 300).cast("double").alias("y"),
        F.when(i % 11 == 0, "#FFA500").alias("fill_color"), F.lit(None).cast("string").alias("stroke_color"), F.lit(None).cast("string").alias("font_color"),
        ((i % 100) / 100.0).alias("confidence"))


def event_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i = F.col("event_id")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.withColumn("_b", before).where("_b is not null")
    source = F.concat(F.lit("n"), "_b")
    target = F.when(i % 50 == 0, "n-1").when(i % 61 == 0, source).otherwise(F.concat(F.lit("n"), i))
    rows = rows.select(F.col("user_id").alias("diagram_id"), "event_id", source.alias("source"), target.alias("target"), F.when(i % 5 == 0, F.col("event_type")).otherwise("").alias("label"),
                       F.element_at(F.array(*map(F.lit, EDGE_STYLES)), (i % 4 + 1).cast("int")).alias("style"), (i % 3 == 0).alias("arrow_start"), (i % 7 != 0).alias("arrow_end"),
                       F.when(i % 13 == 0, "#FF0000").alias("color"), ((i % 90) / 100.0).alias("confidence"))
    twice = rows.withColumn("k", F.explode(F.when(i % 40 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.withColumn("pos", i * 2 + F.col("k")).withColumn("id", F.concat(F.lit("e"), F.col("pos"))).drop("event_id", "k")


def event_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("diagram_id"), F.col("event_type").alias("label")).agg(
        F.transform(F.array_sort(F.collect_list("event_id")), lambda i: F.concat(F.lit("n"), i)).alias("children"))
    pos = F.row_number().over(Window.partitionBy("diagram_id").orderBy("label")) - 1
    return rows.withColumn("pos", pos).withColumn("id", F.concat(F.lit("g_"), "label")).withColumn("style", F.when(F.col("label") == "click", "dashed").otherwise("solid")).withColumn("fill_color", F.when(F.col("label") == "view", "#ADD8E6"))


def event_diagrams(spark: SparkSession, sf: str) -> DataFrame:
    """The users, and one diagram without anything."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("diagram_id")).distinct()
    return rows.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("diagram_id"))).withColumn("direction", F.lit("TB"))


GRAPH_SQL = f"""nodes AS (
  SELECT user_id AS diagram_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, 'n' || event_id AS id, event_type || ' ' || (event_id % 5) AS label,
    {quoted(SHAPES)}[event_id % 7 + 1] AS shape, (event_id * 37 % 400)::DOUBLE AS x, (event_id * 91 % 300)::DOUBLE AS y,
    CASE WHEN event_id % 11 = 0 THEN '#FFA500' END AS fill_color, (event_id % 100) / 100.0::DOUBLE AS confidence FROM events),
prior AS (SELECT *, 'n' || lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source FROM events),
edges AS (
  SELECT user_id AS diagram_id, event_id * 2 + k AS pos, 'e' || (event_id * 2 + k) AS id, source,
    CASE WHEN event_id % 50 = 0 THEN 'n-1' WHEN event_id % 61 = 0 THEN source ELSE 'n' || event_id END AS target,
    CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END AS label, {quoted(EDGE_STYLES)}[event_id % 4 + 1] AS style, event_id % 3 = 0 AS arrow_start, event_id % 7 <> 0 AS arrow_end,
    CASE WHEN event_id % 13 = 0 THEN '#FF0000' END AS color, (event_id % 90) / 100.0::DOUBLE AS confidence
  FROM prior, (VALUES (0), (1)) AS t(k) WHERE source IS NOT NULL AND (k = 0 OR event_id % 40 = 0)),
groups AS (
  SELECT user_id AS diagram_id, event_type AS label, list('n' || event_id ORDER BY event_id) AS children, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS pos
  FROM events GROUP BY user_id, event_type),
diagrams AS (SELECT DISTINCT user_id AS diagram_id FROM events UNION ALL SELECT -1)"""


# Boxes are parts, points are events, on 500 sheets.

def boxes(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select((k % 500).alias("diagram_id"), k.alias("shape_pos"), (k * 37 % 900).cast("double").alias("x"), (k * 53 % 700).cast("double").alias("y"),
                    (F.col("p_size") * 3 + 20).cast("double").alias("width"), (F.col("p_size") * 2 + 15).cast("double").alias("height"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    e, k = table(spark, sf, "events"), F.col("event_id")
    return e.select((k % 500).alias("diagram_id"), k.alias("text_pos"), F.col("event_type").alias("text"), (k * 71 % 1000).cast("double").alias("px"), (k * 29 % 800).cast("double").alias("py"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    s, k = table(spark, sf, "orders"), F.col("o_orderkey")
    return s.select((k % 500).alias("diagram_id"), k.alias("line_pos"), *[(k * m % n).cast("double").alias(c) for c, m, n in (("x1", 17, 950), ("y1", 23, 750), ("x2", 41, 950), ("y2", 59, 750))])


PLANE_SQL = """boxes AS (SELECT p_partkey % 500 AS diagram_id, p_partkey AS shape_pos, (p_partkey * 37 % 900)::DOUBLE AS x, (p_partkey * 53 % 700)::DOUBLE AS y, (p_size * 3 + 20)::DOUBLE AS width, (p_size * 2 + 15)::DOUBLE AS height FROM part),
points AS (SELECT event_id % 500 AS diagram_id, event_id AS text_pos, event_type AS text, (event_id * 71 % 1000)::DOUBLE AS px, (event_id * 29 % 800)::DOUBLE AS py FROM events),
segments AS (SELECT o_orderkey % 500 AS diagram_id, o_orderkey AS line_pos, (o_orderkey * 17 % 950)::DOUBLE AS x1, (o_orderkey * 23 % 750)::DOUBLE AS y1, (o_orderkey * 41 % 950)::DOUBLE AS x2, (o_orderkey * 59 % 750)::DOUBLE AS y2 FROM orders)"""


# File names from parts; page snapshots from documents; a web of nations.

def files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    before = F.when(k % 10 == 0, "drawio-backup-").when(k % 10 == 1, "tmp").when(k % 10 == 2, "~").otherwise("")
    ending = F.element_at(F.array(*map(F.lit, (".drawio", ".png", ".JPG", ".pdf", ".docx", "", ".svg", ".txt"))), (k % 8 + 1).cast("int"))
    return table(spark, sf, "part").select(k.alias("file_id"), F.concat(before, F.replace("p_name", F.lit(" "), F.lit("_")), ending).alias("title"))


FILES_SQL = """files AS (SELECT p_partkey AS file_id, CASE p_partkey % 10 WHEN 0 THEN 'drawio-backup-' WHEN 1 THEN 'tmp' WHEN 2 THEN '~' ELSE '' END || replace(p_name, ' ', '_')
  || ['.drawio', '.png', '.JPG', '.pdf', '.docx', '', '.svg', '.txt'][p_partkey % 8 + 1] AS title FROM part)"""


def snapshot(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, rules and folders."""
    from ..functions.text import fingerprint

    d, i = table(spark, sf, "documents"), F.col("doc_id")
    pages = d.where("doc_id % 10 != 7").select(i.alias("page_id"), F.col("text").alias("content"), (i % 100).cast("double").alias("mtime"))
    noted = F.when(i % 5 == 0, fingerprint(F.col("text"))).when(i % 5 == 1, "deadbeef0000")
    rules = d.where("doc_id % 10 != 3").select(i.alias("page_id"), F.concat(F.lit("# Rules\n"), F.coalesce(F.concat(F.lit("Fingerprint: "), noted), F.lit("none"))).alias("content"), (i * 7 % 100).cast("double").alias("mtime"))
    return pages, rules, d.select(i.alias("page_id"), F.col("source").alias("folder"))


SNAPSHOT_SQL = """p AS (SELECT doc_id, substr(md5(coalesce(text, '')), 1, 12) AS sf, (doc_id % 100)::DOUBLE AS sm FROM documents WHERE doc_id % 10 <> 7),
r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN substr(md5(coalesce(text, '')), 1, 12) WHEN 1 THEN 'deadbeef0000' ELSE '' END AS rf, (doc_id * 7 % 100)::DOUBLE AS rm FROM documents WHERE doc_id % 10 <> 3),
status AS (SELECT coalesce(p.doc_id, r.doc_id) AS page_id,
  CASE WHEN p.doc_id IS NULL THEN 'orphan' WHEN r.doc_id IS NULL THEN 'missing' WHEN rf <> '' THEN CASE WHEN rf <> sf THEN 'stale' ELSE 'current' END WHEN sm > rm THEN 'stale' ELSE 'current' END AS status
  FROM p FULL JOIN r ON p.doc_id = r.doc_id)"""


def links(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    to = F.array((n * 2) % 25, (n * 3 + 1) % 25, (n + 5) % 25, n)
    return table(spark, sf, "nation").select(n.alias("page_id"), F.explode(to).alias("linked_page_id"))


LINKS_SQL = "links AS (SELECT n_nationkey AS page_id, unnest([n_nationkey * 2 % 25, (n_nationkey * 3 + 1) % 25, (n_nationkey + 5) % 25, n_nationkey]) AS linked_page_id FROM nation)"
