"""Queries over large rule sets, single sheets of many shapes, and state that is kept between runs; each with SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import keywords as K
from ..operators import rules as U
from ..operators import sinks, spatial
from ..operators.skills import SkillRegistry
from ..operators.steps import Steps, retried
from ..session import new_folder, settled, small_batches
from ..sources import wiki
from ..streaming import refresh
from . import tables as T
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


LOW_SQL = f"translate(coalesce(text, ''), '{K.UPPER}', '{K.LOWER}')"


# A rule for each document, whose keywords are the longest of its words, its first two words together and its second word with a full stop.

def document_rules(spark: SparkSession, sf: str) -> DataFrame:
    small_batches()
    keywords = F.pandas_udf(lambda texts: pd.Series([keywords_of(t) for t in texts]), "array<string>")(K.low(F.col("text")))
    return table(spark, sf, "documents").select(F.concat(F.lit("D"), "doc_id").alias("rule_id"), keywords.alias("keywords"))


def keywords_of(text: str) -> list[str]:
    words = re.findall("[a-z0-9_]+", text)
    most = max(map(len, words), default=0)
    longest = [min({w for w in words if len(w) == most})] if words else []
    return [*longest, *([f"{words[0]} {words[1]}", f"{words[1]}."] if len(words) >= 2 else [])]


@query(f"""WITH d AS (SELECT doc_id, {LOW_SQL} AS low, regexp_extract_all({LOW_SQL}, '[a-z0-9_]+') AS w FROM documents),
kw AS (SELECT 'D' || doc_id AS rule_id, unnest([(SELECT x FROM (SELECT unnest(w) AS x) ORDER BY length(x) DESC, x LIMIT 1), CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END, CASE WHEN len(w) >= 2 THEN w[2] || '.' END]) AS k FROM d),
words AS (SELECT DISTINCT doc_id, unnest(w) AS k FROM d),
odd AS (SELECT DISTINCT k, CASE WHEN k LIKE '%.' OR NOT regexp_matches(k, '^[a-z0-9].*[a-z0-9]$') THEN NULL ELSE '(^|[^a-z0-9_])' || k || '($|[^a-z0-9_])' END AS pattern FROM kw WHERE k IS NOT NULL AND NOT regexp_matches(k, '^[a-z0-9]([a-z0-9_]*[a-z0-9])?$')),
met AS (SELECT doc_id, k FROM words WHERE k IN (SELECT k FROM kw WHERE regexp_matches(k, '^[a-z0-9]([a-z0-9_]*[a-z0-9])?$')) UNION ALL SELECT doc_id, k FROM odd JOIN d ON contains(low, k) AND (pattern IS NULL OR regexp_matches(low, pattern)))
SELECT rule_id, count(DISTINCT doc_id) AS n_docs FROM kw JOIN met USING (k) GROUP BY rule_id""")
def keyword_index(spark, sf):
    docs = table(spark, sf, "documents")
    return K.counts(docs.select("doc_id", "text"), document_rules(spark, sf))


# All shapes, texts and lines on one sheet.

def one_sheet(rows: DataFrame) -> DataFrame:
    return rows.withColumn("diagram_id", F.lit(0))


SHEET_SQL = T.PLANE_SQL.replace("p_partkey % 500 AS", "0 AS").replace("event_id % 500 AS", "0 AS").replace("o_orderkey % 500 AS", "0 AS")
CENTRE_SQL = "sqrt((px - (x + width / 2)) * (px - (x + width / 2)) + (py - (y + height / 2)) * (py - (y + height / 2)))"


@query(f"""WITH {SHEET_SQL} SELECT text_pos, shape_pos, distance FROM (SELECT *, {CENTRE_SQL} AS distance FROM points JOIN boxes USING (diagram_id)
  WHERE px BETWEEN x AND x + width AND py BETWEEN y - 10 AND y + height + 10) QUALIFY row_number() OVER (PARTITION BY text_pos ORDER BY distance, shape_pos) = 1""")
def sheet_nearest_shape(spark, sf):
    return spatial.texts_to_shapes(one_sheet(T.points(spark, sf)), one_sheet(T.boxes(spark, sf))).drop("diagram_id")


# Few shapes on a wide sheet, so that many texts go to the second pass and many find nothing.
@query(f"""WITH {SHEET_SQL}, wide AS (SELECT * REPLACE (x * 9 AS x, y * 9 AS y) FROM boxes WHERE shape_pos % 5 = 0), far AS (SELECT * REPLACE (px * 9 AS px, py * 9 AS py) FROM points),
c AS (SELECT *, {CENTRE_SQL} AS distance, px BETWEEN x - 15 AND x + width + 15 AND py BETWEEN y - 15 AND y + height + 15 AS inside FROM far JOIN wide USING (diagram_id)),
one AS (SELECT * FROM c WHERE inside QUALIFY row_number() OVER (PARTITION BY text_pos ORDER BY distance, shape_pos) = 1),
two AS (SELECT * FROM c WHERE distance < 80 AND text_pos NOT IN (SELECT text_pos FROM one) QUALIFY row_number() OVER (PARTITION BY text_pos ORDER BY distance, shape_pos) = 1)
SELECT text_pos, shape_pos, distance, 1 AS pass FROM one UNION ALL SELECT text_pos, shape_pos, distance, 2 FROM two""")
def sheet_label_passes(spark, sf):
    wide = one_sheet(T.boxes(spark, sf)).where("shape_pos % 5 = 0").withColumn("x", F.col("x") * 9).withColumn("y", F.col("y") * 9)
    far = one_sheet(T.points(spark, sf)).withColumn("px", F.col("px") * 9).withColumn("py", F.col("py") * 9)
    return spatial.labels_to_shapes(far, wide).drop("diagram_id")


def _end_sql(x: str, y: str, name: str) -> str:
    box = f"greatest(abs({x} - (x + width / 2)) - width / 2, 0)", f"greatest(abs({y} - (y + height / 2)) - height / 2, 0)"
    return f"""{name} AS (SELECT line_pos, shape_pos AS {name} FROM segments JOIN boxes USING (diagram_id) WHERE sqrt({box[0]} * {box[0]} + {box[1]} * {box[1]}) <= 30
  QUALIFY row_number() OVER (PARTITION BY line_pos ORDER BY sqrt(({x} - (x + width / 2)) * ({x} - (x + width / 2)) + ({y} - (y + height / 2)) * ({y} - (y + height / 2))), shape_pos) = 1)"""


@query(f"""WITH {SHEET_SQL}, {_end_sql('x1', 'y1', 'source')}, {_end_sql('x2', 'y2', 'target')}
SELECT line_pos, source, target FROM source JOIN target USING (line_pos) WHERE source <> target QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY line_pos) = 1""")
def sheet_line_edges(spark, sf):
    return spatial.lines_to_edges(one_sheet(T.segments(spark, sf)), one_sheet(T.boxes(spark, sf))).drop("diagram_id")


@query(f"""WITH {SHEET_SQL}, far AS (SELECT * REPLACE (x1 * 20 AS x1, y1 * 20 AS y1, x1 * 20 + x2 / 10 AS x2, y1 * 20 + y2 / 10 AS y2) FROM segments), p AS (SELECT * REPLACE (px * 19 AS px, py * 19 AS py) FROM points),
t AS (SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) END AS t FROM p JOIN far ON abs(px - x1) < 200 AND abs(py - y1) < 200),
d AS (SELECT *, px - (x1 + t * (x2 - x1)) AS ex, py - (y1 + t * (y2 - y1)) AS ey FROM t)
SELECT text_pos, line_pos AS edge_pos, round(sqrt(ex * ex + ey * ey), 6) AS distance FROM d WHERE sqrt(ex * ex + ey * ey) < 80 QUALIFY row_number() OVER (PARTITION BY text_pos ORDER BY sqrt(ex * ex + ey * ey), line_pos) = 1""")
def sheet_edge_labels(spark, sf):
    x1, y1 = F.col("x1") * 20, F.col("y1") * 20
    far = one_sheet(T.segments(spark, sf)).select("diagram_id", F.col("line_pos").alias("edge_pos"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("x2") / 10).alias("x2"), (y1 + F.col("y2") / 10).alias("y2"))
    points = one_sheet(T.points(spark, sf)).withColumn("px", F.col("px") * 19).withColumn("py", F.col("py") * 19)
    return spatial.labels_to_edges(points, far).select("text_pos", "edge_pos", F.round("distance", 6).alias("distance"))


@query("""WITH near AS (SELECT p_partkey AS shape_pos, (p_partkey * 37 % 600)::DOUBLE AS x, (p_partkey * 53 % 500)::DOUBLE AS y, (p_size * 3 + 20)::DOUBLE AS width, (p_size * 2 + 15)::DOUBLE AS height FROM part)
SELECT o.shape_pos, string_agg(i.shape_pos, ',' ORDER BY i.shape_pos) AS children FROM near o JOIN near i ON o.shape_pos <> i.shape_pos
  AND i.x >= o.x AND i.y >= o.y AND i.x + i.width <= o.x + o.width AND i.y + i.height <= o.y + o.height AND o.width * o.height > 1.5 * i.width * i.height GROUP BY o.shape_pos HAVING count(*) >= 2""")
def sheet_containment(spark, sf):
    k = F.col("shape_pos")
    boxes = one_sheet(T.boxes(spark, sf)).withColumn("x", (k * 37 % 600).cast("double")).withColumn("y", (k * 53 % 500).cast("double"))
    stacks = spatial.containment_stacks(boxes).select("members", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))
    return stacks.select(F.explode("members").alias("shape_pos"), "children")


# Rules from documents come in three increments.

def similar_document_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The first words of each document by the alphabet are its rule's keywords and condition, so near copies give similar rules."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(K.low(F.col("text")), F.lit("([a-z]{5,})"))))
    d = table(spark, sf, "documents").select("doc_id", "source", words.alias("w"))
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("rule_id"), severity.alias("severity"), F.slice("w", 1, 6).alias("keywords"),
                    F.array_join(F.slice("w", 1, 12), " ").alias("condition"), F.array("source").alias("sources"))


ROOTS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, list_sort(list_distinct(regexp_extract_all({LOW_SQL}, '[a-z]{{5,}}'))) AS w FROM documents),
r AS (SELECT 'D' || lpad(doc_id::VARCHAR, 12, '0') AS rule_id, source, doc_id % 4 AS severity, array_to_string(w[1:12], ' ') AS condition, w[1:6] AS k, CASE WHEN len(w) = 0 THEN [''] ELSE w[1:12] END AS c FROM d),
kw AS (SELECT rule_id, unnest(k) AS k FROM r), near AS (SELECT x.rule_id AS a, y.rule_id AS b FROM kw x JOIN kw y USING (k) WHERE x.rule_id < y.rule_id GROUP BY ALL HAVING count(*) >= 3),
pairs AS (SELECT a, b FROM near JOIN r x ON x.rule_id = a JOIN r y ON y.rule_id = b WHERE len(list_intersect(x.c, y.c)) / len(list_distinct(list_concat(x.c, y.c))) >= 0.6),
ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
roots AS (SELECT r.rule_id, least(r.rule_id, coalesce(min(b), r.rule_id)) AS root FROM r LEFT JOIN reach ON a = r.rule_id GROUP BY r.rule_id)"""


@query(f"{ROOTS_SQL} SELECT rule_id, root FROM roots")
def rules_incremental(spark, sf):
    rules = settled(similar_document_rules(spark, sf), "document-rules")
    state = U.Consolidation(spark, new_folder(spark, "consolidation"), buckets=8)
    for version in range(3):
        state.add(rules.where(F.col("doc_id") % 3 == version), version)
    return state.groups()


@query(f"""{ROOTS_SQL}, best AS (SELECT rule_id, root, severity, condition FROM r JOIN roots USING (rule_id) QUALIFY row_number() OVER (PARTITION BY root ORDER BY length(condition) DESC, severity, rule_id) = 1),
merged AS (SELECT root, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM r JOIN roots USING (rule_id) GROUP BY root)
SELECT rule_id, ['critical', 'high', 'medium', 'low'][severity + 1] AS severity, condition, coalesce(sources, '') AS sources, printf('R-%03d', row_number() OVER (ORDER BY severity, rule_id)) AS number FROM best JOIN merged USING (root)""")
def rules_consolidated(spark, sf):
    rules = settled(similar_document_rules(spark, sf).drop("doc_id"), "document-rules")
    out = U.consolidate(rules, U.merge_groups(rules, U.linking_pairs(rules)))
    return out.select("rule_id", "severity", "condition", F.array_join("sources", ",").alias("sources"), "number")


# Versions of pages come as a stream of events: a page for each user.

REFRESHED = "page_id long, version long, print string, n_chars int"


def _refreshed(spark: SparkSession, folder: str, parts: list[DataFrame]) -> None:
    """Each part is written to the folder of the stream, in as many files as it has partitions, and is a micro-batch of its own."""
    for rows in parts:
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("page_id long, version long, content string").parquet(f"{folder}/in")
        done = refresh.refresh(stream, f"{folder}/out", f"{folder}/state", lambda d: d.select("page_id", "version", "print", F.length("content").alias("n_chars")), REFRESHED, 8)
        done.awaitTermination()


@query("SELECT user_id AS page_id, max(event_id) AS version, sha256(arg_max(event_type || ' ' || event_id, event_id)) AS print, length(arg_max(event_type || ' ' || event_id, event_id))::INT AS n_chars FROM events GROUP BY user_id")
def pages_refreshed(spark, sf):
    folder, i = new_folder(spark, "pages"), F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("page_id"), i.alias("version"), F.concat("event_type", F.lit(" "), i).alias("content"))
    _refreshed(spark, folder, [rows.where(i % 3 == part) for part in range(3)])
    return refresh.current(spark, f"{folder}/out", REFRESHED, 8)


@query("SELECT doc_id AS page_id, CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version, (length(text) + CASE WHEN doc_id % 5 = 0 OR doc_id % 3 <> 0 THEN 3 ELSE 0 END)::INT AS n_chars FROM documents WHERE text IS NOT NULL")
def incremental_refresh(spark, sf):
    """Three micro-batches of page versions; the second and third hold a part of the pages."""
    folder, parts = new_folder(spark, "refresh"), []
    rows = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("page_id"), F.col("text").alias("content"))
    for version, keep in ((1, "true"), (2, "page_id % 3 = 0"), (3, "page_id % 5 = 0")):
        text = F.col("content") if version == 2 else F.concat("content", F.lit(f" v{version}"))
        parts.append(rows.where(keep).select("page_id", F.lit(version).cast("long").alias("version"), text.alias("content")))
    _refreshed(spark, folder, parts)
    return refresh.current(spark, f"{folder}/out", REFRESHED, 8).select("page_id", F.col("version").cast("int").alias("version"), "n_chars")


# The pages as an export of a wiki.

def _wiki(spark: SparkSession, sf: str) -> str:
    folder = new_folder(spark, "wiki")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("seq"), "page_id", F.concat(F.lit("Page "), "page_id").alias("title"), F.lit("DOC").alias("space"), (F.col("page_id") % 5 + 1).cast("int").alias("version"), "url", "html")
    wiki.export_pages(pages, folder, limit=40)
    spark.dataSource.register(wiki.WikiPages)
    return folder if folder.startswith("file:") else "file://" + folder


@query("SELECT page_id, 'Page ' || page_id AS title, 'DOC' AS space, (page_id % 5 + 1)::INT AS version, url, sha256(html) AS print FROM pages")
def wiki_pages(spark, sf):
    rows = spark.read.format("wiki").option("url", _wiki(spark, sf)).option("limit", "40").load()
    return rows.withColumn("print", F.sha2("html", 256)).drop("html")


@query("""SELECT page_id, sha256('# Page ' || page_id || CASE WHEN page_id % 3 = 0 THEN ' again' ELSE '' END) AS title_print, CASE WHEN page_id % 3 = 0 THEN 2 ELSE page_id % 5 + 1 END::BIGINT AS version, len(regexp_extract_all(html, '(<img\\s)', 1, 'i'))::BIGINT AS n_images,
  len(regexp_extract_all(html, '(<a\\s)', 1, 'i'))::BIGINT AS n_links FROM pages""")
def wiki_ingested(spark, sf):
    """Pages come from the wiki as a stream into the table of pages; a third of them is then stored once more."""
    url, out = _wiki(spark, sf), new_folder(spark, "stored")
    store, at = sinks.page_table(spark, f"{out}/pages", buckets=8), F.to_timestamp(F.lit("2026-01-02 03:04:05"))
    stream = spark.readStream.format("wiki").option("url", url).option("limit", "40").load()
    for _ in range(2):  # the second run finds nothing new
        stream.writeStream.foreachBatch(lambda batch, epoch: sinks.overwrite_pages(store, sinks.stored_pages(batch, at), epoch)).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    again = spark.read.format("wiki").option("url", url).option("limit", "40").load().where("page_id % 3 = 0").withColumn("title", F.concat("title", F.lit(" again"))).withColumn("version", F.lit(2))
    sinks.overwrite_pages(store, sinks.stored_pages(again, at), 1_000)
    title = F.sha2(F.substring_index("page_md", "\n", 1), 256)
    return store.read().select("page_id", title.alias("title_print"), F.get_json_object("metadata", "$.version").cast("long").alias("version"), "n_images", "n_links")


# Conditions over a document's words and its diagram, which is that of the user of its number.

JOINT = [
    ("C1", "node:click 1 exists AND the"), ("C2", "NOT node:click 1 exists AND que OR edge:click 1->view 2 exists AND in"), ("C3", "edge:view 2->click 1 missing AND die"), ("C4", "NOT der AND NOT que"),
    ("C5", "und AND node:view 0 in group:view OR fan-out:view 3 > 3"), ("C6", "NOT node:view 0 exists"), ("C7", "the AND NOT the"), ("C8", None)]


def _has(keyword: str) -> str:
    return f"regexp_matches({LOW_SQL}, '(^|[^a-z0-9_]){keyword}($|[^a-z0-9_])')"


@query(f"""WITH {T.GRAPH_SQL}, ends AS (SELECT e.diagram_id, s.label AS s, t.label AS t, e.target FROM edges e JOIN nodes s ON e.diagram_id = s.diagram_id AND e.source = s.id JOIN nodes t ON e.diagram_id = t.diagram_id AND e.target = t.id),
d AS (SELECT doc_id, {', '.join(f'{_has(k)} AS {k}_' for k in ('the', 'que', 'die', 'der', 'und', 'in'))},
  doc_id IN (SELECT diagram_id FROM nodes WHERE label = 'click 1') AS click1, doc_id IN (SELECT diagram_id FROM nodes WHERE label = 'view 0') AS view0,
  doc_id IN (SELECT diagram_id FROM ends WHERE s = 'click 1' AND t = 'view 2') AS forth, doc_id IN (SELECT diagram_id FROM ends WHERE s = 'view 2' AND t = 'click 1') AS back,
  doc_id IN (SELECT g.diagram_id FROM groups g JOIN nodes n ON g.diagram_id = n.diagram_id WHERE g.label = 'view' AND n.label = 'view 0' AND list_contains(g.children, n.id)) AS member,
  doc_id IN (SELECT diagram_id FROM ends WHERE s = 'view 3' GROUP BY diagram_id HAVING count(DISTINCT target) > 3) AS fan FROM documents)
SELECT doc_id, 'C1' AS rule_id FROM d WHERE click1 AND the_ UNION ALL SELECT doc_id, 'C2' FROM d WHERE NOT click1 AND que_ OR forth AND in_ UNION ALL SELECT doc_id, 'C3' FROM d WHERE NOT back AND die_
UNION ALL SELECT doc_id, 'C4' FROM d WHERE NOT der_ AND NOT que_ UNION ALL SELECT doc_id, 'C5' FROM d WHERE und_ AND member OR fan UNION ALL SELECT doc_id, 'C6' FROM d WHERE NOT view0""")
def joint_conditions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    diagrams = T.event_diagrams(spark, sf).select(F.col("diagram_id").alias("doc_id"), "diagram_id")
    return U.joint_findings(spark.createDataFrame(JOINT, "rule_id string, condition string"), docs, diagrams, T.event_nodes(spark, sf), T.event_edges(spark, sf), T.event_groups(spark, sf))


# Steps, attempts and skills.

@query(f"""SELECT 1 AS pos, 'documents' AS step, count(*) AS n FROM documents UNION ALL SELECT 2, 'with the', count(*) FILTER ({_has('the')}) FROM documents
UNION ALL SELECT 3, 'sources', count(DISTINCT coalesce(source, 'none')) FILTER ({_has('the')}) FROM documents""")
def observed_counts(spark, sf):
    steps = Steps(spark)
    rows = steps.count(table(spark, sf, "documents").select("text", F.coalesce("source", F.lit("none")).alias("source")), "documents")
    rows = steps.count(rows.where(K.low(F.col("text")).rlike("(^|[^a-z0-9_])the($|[^a-z0-9_])")), "with the")
    steps.count(rows.groupBy("source").count(), "sources").write.format("noop").mode("overwrite").save()
    return steps.table().select("pos", "step", "n")


@query("SELECT user_id AS diagram_id, CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS attempts, CASE WHEN user_id % 4 = 3 THEN 500 END AS error_length FROM (SELECT DISTINCT user_id FROM events)")
def mermaid_attempts(spark, sf):
    """By the user's number: fine at once, after a first line is put before it, after a node is put into it, never."""
    code = F.element_at(F.array(*map(F.lit, ("graph LR\n  A --> B", "  A --> B", "graph LR", ""))), (F.col("diagram_id") % 4 + 1).cast("int"))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("diagram_id")).distinct().select("diagram_id", code.alias("code"))

    def attempt(left: DataFrame, n: int) -> DataFrame:
        c = F.col("code")
        if n >= 2:
            c = F.when((c != "") & ~c.startswith("graph"), F.concat(F.lit("graph LR\n"), c)).otherwise(c)
        if n >= 3:
            c = F.when(c == "graph LR", F.concat(c, F.lit("\n  A[empty]"))).otherwise(c)
        return left.withColumn("error", F.when(~F.coalesce(X.mermaid_valid(c), F.lit(False)), F.concat(F.lit("not valid: "), F.repeat(F.lit("x"), 600))))

    return retried(rows, attempt, 3).select("diagram_id", "attempts", F.length("error").alias("error_length"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_name AS name, ['patterns', 'standards', 'security'][s_suppkey % 3 + 1] AS category FROM supplier)
SELECT 1 AS at, name, CASE WHEN k % 3 = 0 THEN 'moved' ELSE category END AS category FROM s WHERE k % 5 < 4 UNION ALL
SELECT 3, name, CASE WHEN k % 3 = 0 AND k % 5 < 4 THEN 'moved' ELSE category END FROM s WHERE k % 5 = 4 OR k % 4 <> 0""")
def skill_registry(spark, sf):
    """Some suppliers' skills are added, some of these updated, some removed and the others added; the list after the update and at the end."""
    k = F.col("s_suppkey")
    category = F.element_at(F.array(*map(F.lit, ("patterns", "standards", "security"))), (k % 3 + 1).cast("int"))
    rows = table(spark, sf, "supplier").select(k, F.col("s_name").alias("name"), category.alias("category"), F.split("s_name", "#").alias("keywords"))
    registry = SkillRegistry(spark, new_folder(spark, "skills"))
    registry.add(rows.where(k % 5 < 4).drop("s_suppkey"), 0)
    registry.update(rows.where((k % 5 < 4) & (k % 3 == 0)).drop("s_suppkey").withColumn("category", F.lit("moved")), 1)
    registry.remove(rows.where((k % 5 < 4) & (k % 4 == 0)).select("name"), 2)
    registry.add(rows.where(k % 5 == 4).drop("s_suppkey"), 3)
    return registry.list(1).select(F.lit(1).alias("at"), "name", "category").unionByName(registry.list().select(F.lit(3).alias("at"), "name", "category"))
