"""Formats written from the driver tables and read back: what the parsers find is what was written, which SQL tells from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diagrams as D
from ..functions import text as X
from ..operators import attachments, graphs, spatial
from ..operators import rules as U
from ..operators import staleness as S
from ..operators import validation as V
from ..session import settled
from ..sources import drawings, drawio, files, html, macros, plantuml, svg
from . import tables as T
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def text(*parts: Column | str) -> Column:
    """Columns and pieces of text, one after the other."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# Pages of a wiki in storage format, one for each document.

def macro(name: str, body: Column, **parameters: Column | str) -> Column:
    given = [p for k, v in parameters.items() for p in (f'<ac:parameter ac:name="{k}">', v, "</ac:parameter>")]
    return text(f'<ac:structured-macro ac:name="{name}">', *given, "<ac:plain-text-body><![CDATA[", body, "]]></ac:plain-text-body></ac:structured-macro>")


def storage_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A document is the body of four macros; every third page has a view, in which their marks are lost."""
    i, body = F.col("doc_id"), F.concat(F.lit("a "), "text", F.lit(" z"))
    graph = text("graph LR\n  A", i.cast("string"), " --> B")
    blocks = [macro("markdown", body), macro("code", body, language="sql", title=text("Q", i.cast("string"))), macro("mermaid-cloud", graph), macro("noformat", body)]
    page = F.concat(text("<h1>T", i.cast("string"), "</h1>\n"), F.concat_ws("\n", *blocks))
    view = F.when(i % 3 == 0, text("<p>view ", i.cast("string"), "</p>"))
    return table(spark, sf, "documents").where("text is not null").select(i.alias("page_id"), page.alias("storage_html"), view.alias("view_html"))


BLOCKS_SQL = """body AS (SELECT doc_id AS page_id, 'a ' || text || ' z' AS b FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT page_id, b AS markdown, '**Q' || page_id || '**' || chr(10) || chr(10) || '```sql' || chr(10) || b || chr(10) || '```' AS code,
  '```mermaid' || chr(10) || 'graph LR' || chr(10) || '  A' || page_id || ' --> B' || chr(10) || '```' AS mermaid, '```' || chr(10) || b || chr(10) || '```' AS noformat FROM body)"""


@query(f"WITH {BLOCKS_SQL} " + " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, 0 AS idx, {k} AS content FROM blocks" for k in ("markdown", "mermaid", "code", "noformat")))
def macro_blocks(spark, sf):
    return macros.macro_blocks(storage_pages(spark, sf))


@query(f"""WITH {BLOCKS_SQL} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'view ' || page_id || {' || '.join(f"chr(10) || chr(10) || {k} || chr(10)" for k in ('markdown', 'mermaid', 'code', 'noformat'))}
  ELSE '# T' || page_id || chr(10) || chr(10) || markdown || chr(10) || code || chr(10) || mermaid || chr(10) || noformat END AS markdown FROM blocks""")
def macro_pages(spark, sf):
    return macros.page_text(storage_pages(spark, sf))


@query("""SELECT doc_id AS page_id, '<div class="aui-tabs"><div class="tabs-pane tab-section-visible" data-pane-title="Tab ' || doc_id || '" style="display: block;"><h3>📑 Tab ' || doc_id || '</h3><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p></div></div>' AS html FROM documents""")
def tabs_flatten(spark, sf):
    i = F.col("doc_id").cast("string")
    body = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = text('<div class="aui-tabs"><ul class="tabs-menu"><li>', i, '</li></ul><div class="tabs-pane" data-pane-title="Tab ', i, '" style="display:none;" jwtdata="x"><p>', body, '</p></div><div class="lazy-loading-div"><p>gone</p></div></div>')
    return table(spark, sf, "documents").select("doc_id", page.alias("html")).select(F.col("doc_id").alias("page_id"), html.flatten_tabs(F.col("html")).alias("html"))


# Diagrams, one for each user: events are nodes, and one event leads to the next.

def drawn(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and the edges between known nodes, without labels of edges."""
    n, e = T.event_nodes(spark, sf), T.event_edges(spark, sf)
    known = n.select("diagram_id", F.col("id").alias("target"))
    return n.select("diagram_id", "pos", "id", "label"), e.join(known, ["diagram_id", "target"]).select("diagram_id", "pos", "source", "target", "style")


def joined(rows: DataFrame, line: Column, name: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"])
    return rows.groupBy("diagram_id").agg(F.array_join(lines, "\n").alias(name))


DRAWN_SQL = f"{T.GRAPH_SQL}, drawn AS (SELECT e.* FROM edges e JOIN nodes n ON e.diagram_id = n.diagram_id AND e.target = n.id)"


@query(f"""WITH {DRAWN_SQL} SELECT diagram_id || '#0' AS diagram_id, 'node' AS kind, id, label || '|' || CASE pos % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'stadium' ELSE 'diamond' END AS detail FROM nodes
UNION ALL SELECT diagram_id || '#0', 'edge', 'edge_' || row_number() OVER (PARTITION BY diagram_id ORDER BY pos), source || '|' || target || '|' || CASE WHEN pos % 2 = 0 THEN 'dashed' ELSE 'solid' END FROM drawn""")
def drawio_ast(spark, sf):
    nodes, edges = drawn(spark, sf)
    style = F.element_at(F.array(*map(F.lit, ("shape=cylinder3", "rounded=1", "rhombus;html=1"))), (F.col("pos") % 3 + 1).cast("int"))
    cell = text('<mxCell id="', F.col("id"), '" value="', F.col("label"), '" style="', style, '" vertex="1" parent="1"><mxGeometry x="', (F.col("pos") * 50).cast("string"), '" y="20" width="40" height="20"/></mxCell>')
    line = text('<mxCell id="e', F.col("pos").cast("string"), '" style="', F.when(F.col("pos") % 2 == 0, "dashed=1").otherwise("html=1"), '" edge="1" source="', F.col("source"), '" target="', F.col("target"), '" parent="1"/>')
    both = joined(nodes, cell, "cells").join(joined(edges, line, "lines"), "diagram_id", "left")
    content = text('<mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>', F.col("cells"), F.coalesce("lines", F.lit("")), "</root></mxGraphModel>")
    n, e, _ = drawio.graph(drawio.cells(both.select(F.col("diagram_id").cast("string").alias("diagram_id"), content.alias("content"))))
    part = lambda rows, kind, detail: rows.select("diagram_id", F.lit(kind).alias("kind"), "id", detail.alias("detail"))
    return part(n, "node", F.concat_ws("|", "label", "shape")).unionByName(part(e, "edge", F.concat_ws("|", "source", "target", "style")))


@query(f"""WITH {T.GRAPH_SQL} SELECT diagram_id::VARCHAR AS diagram_id, label, CASE WHEN pos % 2 = 0 THEN 'rectangle' ELSE 'stadium' END AS shape, (pos * 200)::DOUBLE AS x FROM nodes""")
def svg_ast(spark, sf):
    left = (F.col("pos") * 200).cast("string")
    box = text('<rect x="', left, '" y="0" width="100" height="50" fill="#dae8fc" rx="', F.when(F.col("pos") % 2 == 0, "0").otherwise("25"), '"/><text x="', (F.col("pos") * 200 + 50).cast("string"), '" y="25">', F.col("label"), "</text>")
    rows = joined(T.event_nodes(spark, sf), box, "boxes")
    content = text('<svg xmlns="http://www.w3.org/2000/svg">', F.col("boxes"), "</svg>")
    nodes, _, _ = svg.graph(svg.parse(rows.select(F.col("diagram_id").cast("string").alias("diagram_id"), content.alias("content"))))
    return nodes.select("diagram_id", "label", "shape", "x")


@query(f"""WITH {T.GRAPH_SQL} SELECT diagram_id::VARCHAR AS diagram_id, pos, source_pos, pos AS target_pos FROM (SELECT n.diagram_id, n.pos, n.pos - 1 AS source_pos FROM nodes n WHERE n.pos > 0)""")
def svg_lines(spark, sf):
    """A line from each box to the next."""
    at = F.col("pos") * 200
    box = text('<rect x="', at.cast("string"), '" y="0" width="100" height="50" fill="#dae8fc"/><text x="', (at + 50).cast("string"), '" y="25">N', F.col("pos").cast("string"), '</text>',
               F.when(F.col("pos") > 0, text('<line x1="', (at - 100).cast("string"), '" y1="25" x2="', at.cast("string"), '" y2="25" marker-end="url(#a)"/>')).otherwise(""))
    rows = joined(T.event_nodes(spark, sf), box, "boxes").select(F.col("diagram_id").cast("string").alias("diagram_id"), text('<svg xmlns="http://www.w3.org/2000/svg">', F.col("boxes"), "</svg>").alias("content"))
    nodes, edges, _ = svg.graph(svg.parse(rows))
    place = nodes.select("diagram_id", "id", F.regexp_extract("label", "N([0-9]+)", 1).cast("long").alias("n"))
    ends = edges.join(place.select("diagram_id", F.col("id").alias("source"), F.col("n").alias("source_pos")), ["diagram_id", "source"]).join(place.select("diagram_id", F.col("id").alias("target"), F.col("n").alias("target_pos")), ["diagram_id", "target"])
    return ends.select("diagram_id", F.col("target_pos").alias("pos"), "source_pos", "target_pos")


def components(spark: SparkSession, sf: str) -> DataFrame:
    """PlantUML of components: a node a line, then an arrow an edge."""
    nodes, edges = drawn(spark, sf)
    node = text("[", F.col("label"), "] as ", F.col("id"))
    edge = text(F.col("source"), F.when(F.col("pos") % 2 == 0, " --> ").otherwise(" -> "), F.col("target"))
    both = joined(nodes, node, "nodes").join(joined(edges, edge, "edges"), "diagram_id", "left")
    block = text("@startuml\n", F.col("nodes"), "\n", F.coalesce("edges", F.lit("")), "\n@enduml")
    return settled(plantuml.diagrams(both.select(F.col("diagram_id").cast("string").alias("diagram_id"), block.alias("block"))), "components")


@query(f"""WITH {DRAWN_SQL} SELECT diagram_id::VARCHAR AS diagram_id, 'component' AS kind, (SELECT count(*) FROM nodes n WHERE n.diagram_id = d.diagram_id)::INT AS n_nodes, (SELECT count(*) FROM drawn e WHERE e.diagram_id = d.diagram_id)::INT AS n_edges, 0 AS n_groups
FROM diagrams d WHERE diagram_id >= 0""")
def plantuml_ast(spark, sf):
    return components(spark, sf).select("diagram_id", "kind", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), F.size("groups").alias("n_groups"))


@query(f"""WITH {T.GRAPH_SQL} SELECT diagram_id::VARCHAR AS diagram_id, 'sequenceDiagram' || chr(10) || string_agg('    participant ' || id || ' as ' || label, chr(10) ORDER BY pos) || CASE WHEN count(*) > 1 THEN chr(10) || string_agg(CASE WHEN pos > 0 THEN '    n' || before || '->>' || id || ': ' || label END, chr(10) ORDER BY pos) ELSE '' END AS mermaid, NULL::VARCHAR AS error
FROM (SELECT *, lag(substr(id, 2)) OVER (PARTITION BY diagram_id ORDER BY pos) AS before FROM nodes) GROUP BY diagram_id""")
def plantuml_mermaid(spark, sf):
    """Sequence diagrams: each event tells the next."""
    before = F.lag("id").over(T.Window.partitionBy("diagram_id").orderBy("pos"))
    nodes = T.event_nodes(spark, sf).select("diagram_id", "pos", "id", "label", before.alias("before"))
    who = joined(nodes, text('participant "', F.col("label"), '" as ', F.col("id")), "who")
    said = joined(nodes.where("before is not null"), text(F.col("before"), " -> ", F.col("id"), " : ", F.col("label")), "said")
    both = who.join(said, "diagram_id", "left").select(F.col("diagram_id").cast("string").alias("diagram_id"), text("@startuml\n", F.col("who"), "\n", F.coalesce("said", F.lit("")), "\n@enduml").alias("block"))
    return plantuml.diagrams(both).select("diagram_id", F.rtrim("mermaid").alias("mermaid"), "error")


@query(f"""WITH {DRAWN_SQL} SELECT diagram_id::VARCHAR AS diagram_id, (3 + (SELECT count(*) FROM nodes n WHERE n.diagram_id = d.diagram_id) + (SELECT count(*) + count(*) FILTER (pos % 2 = 0) FROM drawn e WHERE e.diagram_id = d.diagram_id))::INT AS n_lines
FROM diagrams d WHERE diagram_id >= 0""")
def plantuml_rendered(spark, sf):
    """A line for each node, edge and dashed edge, and three around them."""
    return graphs.render(components(spark, sf).where("nodes is not null")).select("diagram_id", F.size(F.split("mermaid", "\n")).alias("n_lines"))


@query("""SELECT p_partkey AS diagram_id, 'node' AS kind, 'n' || p_partkey AS id, p_name AS text, (p_partkey % 90 + 30 - 20)::DOUBLE AS x, (p_size + 40 - 10)::DOUBLE AS y FROM part""")
def rendered_drawing(spark, sf):
    k = F.col("p_partkey")
    content = text('<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(', (k % 90).cast("string"), ",", F.col("p_size").cast("string"), ')"><g class="node default" id="n', k.cast("string"), '" transform="translate(30, 40)"><rect x="-20" y="-10" width="40" height="20"/><text>', F.col("p_name"), "</text></g></g></svg>")
    found = drawings.rendered(table(spark, sf, "part").select(k.cast("string").alias("diagram_id"), content.alias("content")))
    return found.select(F.col("diagram_id").cast("long").alias("diagram_id"), "kind", "id", "text", "x", "y")


# Decks from conversations: a slide for each turn.

@query("""SELECT conv_id::VARCHAR AS source, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, role || ' ' || turn AS title, 'graph LR' || chr(10) || '  A --> T' || turn AS mermaid, '#00ff0' || (turn % 10) AS color, 'said ' || role AS label, 'x ' || text || ' y' AS notes
FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL""")
def slide_decks(spark, sf):
    turn = F.col("turn").cast("string")
    slide = text("## Slide ", turn, ": ", F.col("role"), " ", turn, "\n```mermaid\ngraph LR\n  A --> T", turn, "\n```\n<span style=\"background:#00ff0", (F.col("turn") % 10).cast("string"), "\">&nbsp;</span> said ", F.col("role"), "\n**Notes:** x ", F.col("text"), " y")
    rows = table(spark, sf, "conversations").where("text is not null and role is not null")
    decks = rows.groupBy(F.col("conv_id").cast("string").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", slide.alias("s")))), lambda s: s["s"]), "\n---\n").alias("content"))
    found = files.slides(decks)
    return found.select("source", "pos", "title", F.trim(F.regexp_replace("mermaid", r"\n$", "")).alias("mermaid"), F.col("legend")[0]["color"].alias("color"), F.col("legend")[0]["label"].alias("label"), "notes")


# Rules of parts.

def part_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.lpad(k.cast("string"), 9, "0")).alias("rule_id"), of(("patterns", "standards", "security"), k).alias("category"), of(("rule", "rule", "anti_pattern", "vulnerability"), k).alias("kind"),
        of(("critical", "high", "medium", "low"), k + F.col("p_size")).alias("severity"), (k % 2 == 0).alias("required"), F.array_distinct(F.split("p_name", " ")).alias("keywords"))


PART_RULES_SQL = """pr AS (SELECT 'P' || lpad(p_partkey::VARCHAR, 9, '0') AS rule_id, ['patterns', 'standards', 'security'][p_partkey % 3 + 1] AS category, ['rule', 'rule', 'anti_pattern', 'vulnerability'][p_partkey % 4 + 1] AS kind,
  ['critical', 'high', 'medium', 'low'][(p_partkey + p_size) % 4 + 1] AS severity, p_partkey % 2 = 0 AS required, list_distinct(string_split(p_name, ' ')) AS keywords FROM part)"""


@query(f"WITH {PART_RULES_SQL} SELECT rule_id, category, kind, severity, required, len(keywords)::INT AS n_keywords FROM pr")
def rule_catalog(spark, sf):
    return part_rules(spark, sf).select("rule_id", "category", "kind", "severity", "required", F.size("keywords").alias("n_keywords"))


@query(f"WITH {PART_RULES_SQL} SELECT coalesce(severity, 'all') AS severity, count(*) AS n_rules FROM pr GROUP BY ROLLUP (severity)")
def severity_rollup(spark, sf):
    return V.severity_rollup(part_rules(spark, sf))


@query(f"WITH {PART_RULES_SQL} SELECT rule_id, category, ((row_number() OVER (PARTITION BY category ORDER BY rule_id) - 1) // 50)::BIGINT AS batch FROM pr")
def rule_batches(spark, sf):
    return U.batches(part_rules(spark, sf)).select("rule_id", "category", "batch")


@query(f"WITH {PART_RULES_SQL} SELECT rule_id, 'security' AS category, CASE WHEN kind = 'anti_pattern' THEN 'vulnerability' ELSE kind END AS kind, severity, required AND kind = 'rule' AS required, array_to_string(list_sort(keywords), ',') AS keywords FROM pr WHERE category = 'security'")
def rule_json(spark, sf):
    """A file of JSON for each security rule."""
    rule = F.struct(F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), "severity", "required", "keywords")
    weak = F.struct(F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), "severity", "keywords")
    none = lambda kind: F.array().cast(kind)
    block = F.to_json(F.struct(F.lit("security").alias("category"), F.when(F.col("kind") == "rule", F.array(rule)).alias("rules"), F.when(F.col("kind") != "rule", F.array(weak)).alias("vulnerabilities")))
    rows = part_rules(spark, sf).where("category = 'security'").select(F.col("rule_id").alias("source"), text("# Rules\n\n```json\n", block, "\n```\n").alias("content"))
    return files.rule_blocks(rows).select("rule_id", "category", "kind", "severity", "required", F.array_join(F.array_sort("keywords"), ",").alias("keywords"))


@query(f"""WITH {PART_RULES_SQL} SELECT category AS source, rule_id, upper(substr(severity, 1, 1)) AS severity, required, array_to_string(keywords, ',') AS keywords, 'all of ' || rule_id AS condition, CASE WHEN required THEN 'node:' || rule_id || ' exists' END AS ast_condition, NULL::VARCHAR AS error FROM pr
UNION ALL SELECT category, NULL, NULL, false, NULL, NULL, NULL, 'expected 7 cells, got 2' FROM pr GROUP BY category""".replace("array_to_string(keywords, ',')", "array_to_string(list_sort(keywords), ',')"))
def rule_markdown(spark, sf):
    """A table of rules for each category, with a broken row at its end."""
    row = text("| ", F.col("rule_id"), " | ", F.col("kind"), " | ", F.upper(F.substring("severity", 1, 1)), " | ", F.when(F.col("required"), "Y").otherwise("N"), " | ", F.array_join("keywords", ", "), " | all of ", F.col("rule_id"), " | ",
               F.when(F.col("required"), text("node:", F.col("rule_id"), " exists")).otherwise("-"), " |")
    head = "| ID | Rule | Sev | Req | Keywords | Condition | AST Condition |\n|---|---|---|---|---|---|---|\n"
    tables = part_rules(spark, sf).groupBy(F.col("category").alias("source")).agg(text(head, F.array_join(F.array_sort(F.collect_list(row)), "\n"), "\n| broken | row |\n").alias("content"))
    found = files.rule_rows(tables)
    return found.select("source", "rule_id", "severity", "required", F.array_join(F.array_sort("keywords"), ",").alias("keywords"), "condition", "ast_condition", "error")


# Skills of suppliers, agents of nations, by category.

def supplier_skills(spark: SparkSession, sf: str) -> DataFrame:
    category = F.element_at(F.array(*map(F.lit, ("patterns", "standards", "security", ""))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    content = text("---\nname: ", F.col("s_name"), "\ncategory: ", category, "\ndescription: nation ", F.col("s_nationkey").cast("string"), "\n---\nbody")
    return files.skills(table(spark, sf, "supplier").select(content.alias("content")))


SKILLS_SQL = "sk AS (SELECT s_name AS name, nullif(['patterns', 'standards', 'security', ''][s_suppkey % 4 + 1], '') AS category, 'nation ' || s_nationkey AS description FROM supplier)"


@query(f"WITH {SKILLS_SQL} SELECT name, category, description, category IS NOT NULL AS tagged FROM sk")
def skill_files(spark, sf):
    return supplier_skills(spark, sf)


@query(f"WITH {SKILLS_SQL} SELECT n_name AS agent, name AS skill FROM nation JOIN sk ON category = ['patterns', 'standards', 'security'][n_nationkey % 3 + 1]")
def skill_dispatch(spark, sf):
    category = F.element_at(F.array(*map(F.lit, ("patterns", "standards", "security"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    agents = table(spark, sf, "nation").select(F.col("n_name").alias("agent"), category.alias("category"))
    return U.dispatched(agents, supplier_skills(spark, sf).select(F.col("name").alias("skill"), "category"))


# Macros, images and files by name.

@query("""WITH m AS (SELECT p_partkey // 3 AS page_id, p_partkey AS pos, 'm' || p_partkey AS macro_id, 'D' || p_partkey || CASE p_partkey % 3 WHEN 1 THEN ' plan' ELSE '' END AS name FROM part)
SELECT page_id, macro_id, CASE pos % 3 WHEN 0 THEN 'd' || pos || '.drawio' WHEN 1 THEN 'd' || pos || ' plan' ELSE 'other' || pos || '.drawio' END AS file FROM m""")
def macro_matches(spark, sf):
    """Three macros a page: one is within its file's name, one equals it, and one is left for the file that is left."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.floor(k / 3).alias("page_id"), k.alias("pos"), k.cast("string").alias("s"))
    m = rows.select("page_id", "pos", text("m", F.col("s")).alias("macro_id"), text("D", F.col("s"), F.when(F.col("pos") % 3 == 1, " plan").otherwise("")).alias("name"))
    name = F.when(F.col("pos") % 3 == 0, text("d", F.col("s"), ".drawio")).when(F.col("pos") % 3 == 1, text("d", F.col("s"), " plan")).otherwise(text("other", F.col("s"), ".drawio"))
    return attachments.match_macros(m, rows.select("page_id", F.col("pos").alias("file_pos"), name.alias("name")))


@query("""SELECT 'i' || p_partkey || '.png' AS image, CASE p_partkey % 6 WHEN 0 THEN 'manifest' WHEN 1 THEN 'ast' WHEN 2 THEN 'file' WHEN 3 THEN 'file ast' WHEN 5 THEN 'file' END AS mermaid FROM part""")
def mermaid_lookup(spark, sf):
    """By p_partkey % 6: in the manifest, its AST, a .mmd, an .ast.json, only a partial AST, a .mmd beside an .ast.json."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select((k % 6).alias("r"), text("i", k.cast("string")).alias("stem"))
    manifest = rows.where("r < 2").select(text(F.col("stem"), ".png").alias("image"), F.when(F.col("r") == 0, "manifest").alias("mmd"), F.lit("ast").alias("ast_mmd"))
    of = lambda which, end, label: rows.where(F.col("r").isin(*which)).select(text(F.col("stem"), end).alias("name"), F.lit(label).alias("mermaid"))
    found = of([0, 2, 5], ".mmd", "file").unionByName(of([3, 5], ".ast.json", "file ast")).unionByName(of([4], ".partial.ast.json", "partial"))
    return attachments.mermaid_for_images(rows.select(text(F.col("stem"), ".png").alias("image")), manifest, found)


# Arrows, colours and relations in the order of orders.

def chosen(values: list[tuple], row: str) -> str:
    """SQL for the value of each order."""
    return f"SELECT o_orderkey, v.* EXCLUDE (i) FROM orders JOIN ({T.values([(i, *v) for i, v in enumerate(values)], row)}) v ON v.i = o_orderkey % {len(values)}"


def picked(spark: SparkSession, sf: str, values: list[str], name: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k, F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int")).alias(name))


ARROWS = [
    ("->", "solid", False, True, None, False, 0), ("-->", "dashed", False, True, None, False, 0), ("..>", "dotted", False, True, None, False, 0), ("<==>", "thick", True, True, None, False, 0),
    ("--", "dashed", False, False, None, False, 0), ("-", "solid", False, False, None, False, 0), ("-[#red]>", "solid", False, True, "#FF0000", False, 0), ("->++", "solid", False, True, None, False, 1),
    ("-->--", "dashed", False, True, None, False, -1), ("->x", "solid", False, False, None, True, 0), ("->o", "solid", False, True, None, False, 0), ("<->", "solid", True, True, None, False, 0)]


@query(chosen(ARROWS, "i, arrow, style, has_start, has_end, color, lost, activate"))
def arrow_parse(spark, sf):
    return picked(spark, sf, [a[0] for a in ARROWS], "arrow").select("o_orderkey", "arrow", F.inline(F.array(D.parsed_arrow(F.col("arrow")))))


@query("SELECT o_orderkey, printf('#%06X', o_orderkey * 7919 % 16777216) AS hex, o_orderkey * 7919 % 16777216 // 65536 AS r, o_orderkey * 7919 % 65536 // 256 AS g, o_orderkey * 7919 % 256 AS b FROM orders")
def colour_resolve(spark, sf):
    """Colours by their digits, of which every second has no mark before them."""
    n = F.col("o_orderkey") * 7919 % 16777216
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "#").otherwise(""), F.lpad(F.hex(n), 6, "0")).alias("name"))
    hexed = rows.select("o_orderkey", F.upper(D.color(F.col("name"))).alias("hex"))
    part = lambda i: F.conv(F.substring("hex", i, 2), 16, 10).cast("long")
    return hexed.select("o_orderkey", "hex", part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


RELATIONS = [("--|>", "extends", "<|--"), ("..|>", "implements", "<|.."), ("<|--", "extends", "<|--"), ("*--", "composition", "*--"), ("o--", "aggregation", "o--"), ("..>", "dependency", "<.."), ("--", "association", "--"), ("-->", "association", "--")]


@query(chosen(RELATIONS, "i, arrow, relation, mermaid"))
def class_relations(spark, sf):
    r = D.class_relation(F.col("arrow"))
    return picked(spark, sf, [a[0] for a in RELATIONS], "arrow").select("o_orderkey", "arrow", r.alias("relation"), D.relation_text(r).alias("mermaid"))


@query(f"""WITH {T.GRAPH_SQL}, prior_nodes AS (SELECT *, lag(id) OVER (PARTITION BY diagram_id ORDER BY pos) AS before FROM nodes)
SELECT diagram_id, 'graph LR' || chr(10) || string_agg(CASE WHEN before IS NULL THEN '  Z --> ' || id ELSE '  ' || before || ' --> ' || id END, chr(10) ORDER BY pos) || chr(10) || '  subgraph S' || chr(10) || '  C["x(y)"]' || chr(10) || '    end' AS fixed,
  true AS valid, (count(*) + 2)::INT AS node_count, count(*)::INT AS edge_count, 1 AS subgraph_count FROM prior_nodes GROUP BY diagram_id""")
def mermaid_autofix(spark, sf):
    """A chain of each user's events, with arrows of the wrong sign, an open subgraph and an unquoted label."""
    before = F.lag("id", 1, "Z").over(T.Window.partitionBy("diagram_id").orderBy("pos"))
    nodes = T.event_nodes(spark, sf).select("diagram_id", "pos", "id", before.alias("before"))
    codes = joined(nodes, text("  ", F.col("before"), " --→ ", F.col("id")), "lines").select("diagram_id", text("graph LR\n", F.col("lines"), "\n  subgraph S\n  C[x(y)]").alias("code"))
    fixed = codes.select("diagram_id", X.autofix(F.col("code")).alias("fixed"))
    return fixed.select("diagram_id", "fixed", X.mermaid_valid(F.col("fixed")).alias("valid"), F.inline(F.array(X.mermaid_counts(F.col("fixed")))))


# What is left: reports, questions, sizes and colours.

@query(f"WITH {T.findings_sql(True)} SELECT rule_id, status, count(*) AS n FROM findings WHERE severity = 'high' GROUP BY ALL")
def findings_grounded(spark, sf):
    """Findings whose rule is in a rule set that holds those of high severity alone."""
    rules = V.rule_table(spark, True)
    found = V.findings(table(spark, sf, "documents").select("doc_id", "text"), rules)
    return V.grounded(found, rules.where("severity = 'high'")).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {T.SNAPSHOT_SQL} SELECT page_id, page_id AS in_line, status FROM status")
def staleness_lines(spark, sf):
    pages, rules, _ = T.snapshot(spark, sf)
    of = lambda name: F.get_json_object("line", f"$.{name}")
    return S.report_json(S.file_status(pages, rules)).select("page_id", of("page_id").cast("long").alias("in_line"), of("status").alias("status"))


@query(f"""WITH {T.FILES_SQL}, r AS (SELECT title LIKE 'drawio-backup-%' OR title LIKE 'tmp%' OR title LIKE '~%' AS b, regexp_matches(lower(title), '[.](pdf|docx|txt)$') AS u FROM files)
SELECT count(*) FILTER (b) AS backup, count(*) FILTER (u AND NOT b) AS unnecessary, count(*) FILTER (NOT u AND NOT b) AS kept FROM r""")
def prune_summary(spark, sf):
    return attachments.prune_counts(T.files(spark, sf))


@query("""SELECT 'Does the document describe ' || array_to_string(string_split(p_name, ' ')[1:3], ', ') || '?' AS question, string_agg('P' || lpad(p_partkey::VARCHAR, 9, '0'), ',' ORDER BY p_partkey) AS rule_ids FROM part GROUP BY ALL""")
def probe_questions(spark, sf):
    rules = table(spark, sf, "part").select(F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("rule_id"), F.split("p_name", " ").alias("keywords"))
    return U.probe_questions(rules).select("question", F.array_join("rule_ids", ",").alias("rule_ids"))


@query("""WITH c AS (SELECT p_partkey, p_partkey % 9 AS v, CASE WHEN p_partkey % 13 > 0 THEN (p_partkey % 13) / 12.0 END AS c, (p_size % 20) / 10.0 AS a, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 180 END AS g, p_size * 40.0 AS area FROM part),
s AS (SELECT *, (abs(g) % 90 > 25) AND (abs(g) % 90 < 65) AND a > 0.6 AND a < 1.6 AS turned FROM c WHERE area BETWEEN 100000 * 0.0008 AND 100000 * 0.5)
SELECT p_partkey, CASE WHEN c IS NULL THEN 'rectangle' WHEN c > 0.8 THEN 'circle' WHEN v = 4 AND coalesce(turned, false) THEN 'diamond' WHEN v = 4 THEN 'rectangle' WHEN v = 6 THEN 'hexagon' WHEN v = 3 THEN 'diamond' WHEN v > 6 THEN 'stadium' ELSE 'rectangle' END AS shape FROM s""")
def contour_shapes(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf, "part").select(k, (k % 9).alias("v"), F.when(k % 13 > 0, (k % 13) / F.lit(12.0)).alias("c"), ((size % 20) / F.lit(10.0)).alias("a"), F.when(k % 5 > 0, (k % 180).cast("double")).alias("g"), (size * 40.0).alias("area"), F.lit(100000.0).alias("image_area"))
    return spatial.contours(rows).select("p_partkey", D.cv_shape(F.col("v"), F.col("c"), F.col("a"), F.col("g"))["shape"].alias("shape"))


@query("SELECT p_partkey, least(960.0 / w, 540.0 / h) AS scale, (960.0 - w * least(960.0 / w, 540.0 / h)) / 2 AS dx, (540.0 - h * least(960.0 / w, 540.0 / h)) / 2 AS dy FROM (SELECT p_partkey, (p_partkey % 1900 + 1)::DOUBLE AS w, (p_size * 37 + 1)::DOUBLE AS h FROM part)")
def slide_fit(spark, sf):
    """Drawings of the sizes of parts on slides of 960 by 540."""
    wide, high = (F.col("p_partkey") % 1900 + 1).cast("double"), (F.col("p_size") * 37 + 1).cast("double")
    return table(spark, sf, "part").select("p_partkey", F.inline(F.array(D.fit_scale(wide, high, 960.0, 540.0))))


@query("""SELECT o_orderkey, printf('#%02X%02X%02X', r, g, b) AS hex, r > 230 AND g > 230 AND b > 230 AS white, r < 30 AND g < 30 AND b < 30 AS black
FROM (SELECT o_orderkey, o_orderkey % 7 * 42 AS r, o_orderkey % 5 * 63 AS g, o_orderkey % 3 * 127 AS b FROM orders)""")
def near_colours(spark, sf):
    k = F.col("o_orderkey")
    r, g, b = k % 7 * 42, k % 5 * 63, k % 3 * 127
    return table(spark, sf, "orders").select(k, D.rgb_hex(r, g, b).alias("hex"), D.near_white(r, g, b).alias("white"), D.near_black(r, g, b).alias("black"))
