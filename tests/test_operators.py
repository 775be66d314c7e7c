"""Operators on small inline inputs."""

import re

import samples
from pyspark.sql import functions as F

from vellum.functions import diagrams as D
from vellum.functions import text as X
from vellum.operators import attachments, graphs, links, rules, spatial, staleness, validation
from vellum.schemas import SHIPPED_RULES
from vellum.sources import drawio, files, html, macros, plantuml, svg
from vellum.streaming import refresh


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def card(spark, found):
    """Scores where exactly the rules of `found` are evident."""
    rows = [(1, r[0], r[1], "b", r[2], r[3], r[4], r[0] in found) for r in SHIPPED_RULES]
    df = spark.createDataFrame(rows, "doc_id long, rule_id string, category string, origin string, kind string, severity string, required boolean, found boolean")
    df = df.withColumn("status", validation.status(F.col("kind"), F.col("required"), F.col("found")))
    return validation.scorecards(validation.category_reports(df)).first(), validation.risk_levels(df).first()["risk_level"]


def test_scores(spark):
    good = {r[0] for r in SHIPPED_RULES if r[2] == "rule"}
    best, risk = card(spark, good)
    assert (best.patterns_score, best.standards_score, best.security_score, best.overall, best.grade, risk) == (60, 88, 100, 84.4, "PASS", "LOW")
    none, risk = card(spark, set())
    assert (none.overall, none.grade, none.required_status, risk) == (0, "FAIL", "FAIL", "CRITICAL")
    assert card(spark, good | {"VULN-001"})[0].security_score == 85 and card(spark, good | {"VULN-001"})[1] == "CRITICAL"
    assert card(spark, {"ANTI-001"})[0].patterns_score == 0


def test_grades(spark):
    assert [one(spark, validation.grade(F.col("s")), s=s) for s in (70.0, 69.99, 50.0, 49.99)] == ["PASS", "WARN", "WARN", "FAIL"]


def test_keywords(spark):
    rule = [("R", "security", "rule", "high", True, ["DI", "password=", "at rest", "pub/sub"])]
    texts = [(1, "a di b"), (2, "media"), (3, "xpassword=1"), (4, "data at rest."), (5, "that rest"), (6, None), (7, "DI"), (8, "a pub/sub b"), (9, "at-rest")]
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rule, "rule_id string, category string, kind string, severity string, required boolean, keywords array<string>")
    for compiled in (500, 0):
        assert {r.doc_id for r in validation.evidence(docs, table, compiled).collect() if r.found} == {1, 3, 4, 7, 8}


def test_staleness_truth_table(spark):
    body = "page"
    fp = spark.range(1).select(X.fingerprint(F.lit(body))).first()[0]
    pages = [("a", body, 5.0), ("b", body, 5.0), ("c", body, 5.0), ("d", body, 5.0), ("e", body, 1.0), (".hidden", body, 1.0), ("late", body, 5.0)]
    stored = [("o", "x", 1.0), ("b", "Fingerprint: 000000000000", 9.0), ("c", f"Fingerprint: {fp}", 1.0), ("d", "none", 1.0), ("e", "none", 1.0), ("late", "\n" * 10 + f"Fingerprint: {fp}", 1.0)]
    table = lambda rows: spark.createDataFrame(rows, "page_id string, content string, mtime double")
    found = staleness.file_status(table(pages), table(stored))
    assert {r.page_id: r.status for r in found.collect()} == {"a": "missing", "o": "orphan", "b": "stale", "c": "current", "d": "stale", "e": "current", "late": "stale"}
    assert tuple(staleness.summary(found, True).first()) == (3, 1, 2, 1, 6, 8)
    assert staleness.to_refresh(found).count() == 4


def test_a_long_page_changed_at_its_end(spark):
    page = lambda version, content: spark.createDataFrame([("p", version, content)], "page_id string, version int, content string")
    state = refresh.changed(page(1, "x" * 70_000 + "a"), None)
    assert [r.version for r in refresh.changed(page(2, "x" * 70_000 + "b"), state).collect()] == [2]
    assert refresh.changed(page(2, "x" * 70_000 + "a"), state).isEmpty()


def test_attachments(spark):
    rows = spark.createDataFrame([("a.png", 1, 1), ("a.png", 3, 2), ("a.png", 2, 3), ("b.svg", 2, 1), ("b.svg", 2, 2), ("c", None, 1)], "title string, version int, pos int")
    assert {(r.title, r.version, r.pos) for r in attachments.latest(rows, ["title"]).collect()} == {("a.png", 3, 2), ("b.svg", 2, 1), ("c", None, 1)}
    names = ["drawio-backup-x.drawio", "~c.png", "tmp1", "d.pdf", "diagram", "e.PNG"]
    assert [one(spark, X.prune_reason(F.col("n")), n=n) for n in names] == ["backup", "backup", "backup", "unnecessary", None, None]
    assert one(spark, X.is_drawio(F.col("n"), F.col("c")), n="x", c="  <mxfile>") and not one(spark, X.is_drawio(F.col("n"), F.col("c")), n="x", c=" " * 600 + "<mxfile>")


def test_ids(spark):
    base = lambda label, cell="c": one(spark, D.safe_id_base(F.col("l"), F.col("c")), l=label, c=cell)
    assert [base("API Gateway"), base("1st"), base("end"), base("", "abcdefgh"), base("x" * 30), base("", "")] == ["API_Gateway", "n_1st", "end_node", "node_cdefgh", "x" * 20, "node_0"]
    rows = spark.createDataFrame([("d", i, b) for i, b in enumerate(["x_1", "x", "x", "y", "x", "x_1"])], "diagram_id string, pos int, base string")
    assert [r.safe_id for r in graphs.unique_ids(rows).orderBy("pos").collect()] == ["x_1", "x", "x_2", "y", "x_3", "x_1_1"]


def test_direction(spark):
    way = lambda pts: graphs.spread_direction(spark.createDataFrame([("d", *map(float, p)) for p in pts], "diagram_id string, x double, y double")).first()["direction"]
    assert [way([(1, 1), (301, 101)]), way([(1, 1), (151, 101)]), way([(5, 5)]), way([(0, 1), (0, 9)])] == ["LR", "TB", "TB", "TB"]


def graph(spark, nodes, edges, groups=()):
    n = spark.createDataFrame([("d", i, *x) for i, x in enumerate(nodes)], "diagram_id string, pos int, id string, label string, shape string, x double, y double")
    e = spark.createDataFrame([("d", i, f"e{i}", *x) for i, x in enumerate(edges)], "diagram_id string, pos int, id string, source string, target string, label string, style string, arrow_start boolean, arrow_end boolean")
    g = spark.createDataFrame([("d", i, *x) for i, x in enumerate(groups)], "diagram_id string, pos int, id string, label string, children array<string>")
    return spark.createDataFrame([("d", "TB")], "diagram_id string, direction string"), n, e, g


def test_checks(spark):
    d, n, e, g = graph(spark, [("a", "A", "rectangle", 0.0, 0.0), ("b", "node_7", "cloud", 10.0, 10.0), ("c", " ", "circle", 1.0, 1.0), ("l", "Node 7", "circle", 1.0, 1.0)],
                       [("a", "b", "", "solid", False, True), ("a", "b", "", "wavy", False, True), ("b", "a", "", "solid", False, True), ("a", "zz", "", "solid", False, True), ("a", "a", "", "solid", False, True), ("[*]", "a", "", "solid", False, True)], [("g", "G", ["l"])])
    issues = {(r.check, r.subject, r.message) for r in graphs.evaluate(d, n, e, g).collect()}
    assert issues == {("generic_labels", "b", "generic label node_7"), ("generic_labels", "c", "empty label"), ("schema", "nodes[1]", "unknown shape cloud"), ("schema", "edges[1]", "unknown style wavy"),
                      ("duplicate_edges", "e1", "duplicates e0"), ("edge_validity", "e3", "unknown target zz"), ("edge_validity", "e4", "self-loop at a"), ("orphan_nodes", "c", "no edges"), ("orphan_nodes", "l", "in a group but without edges")}


def test_drift(spark):
    _, before, e, _ = graph(spark, [("a", "A", "circle", 10.0, 10.0), ("b", "B", "circle", 10.0, 10.0), ("o", "O", "circle", 0.0, 0.0), ("r", "R", "circle", 1.0, 1.0)], [("a", "b", "", "solid", False, True), ("b", "a", "", "solid", False, True)])
    _, after, f, _ = graph(spark, [("a", "A", "circle", 15.0, 10.0), ("b", "B", "circle", 16.0, 10.0), ("o", "O", "circle", 90.0, 90.0), ("new", "N", "circle", 1.0, 1.0)], [("a", "b", "", "solid", False, True)])
    assert {(r.subject, r.message) for r in graphs.check_drift(after, f, before, e).collect()} == {("b", "node moved"), ("r", "node removed"), ("b->a", "edge removed")}


def test_flowchart(spark):
    d, n, e, g = graph(spark, [("1", "A b", "rectangle", 0.0, 0.0), ("2", "A b", "database", 0.0, 0.0), ("3", "end", "hexagon", 0.0, 0.0)],
                       [("1", "2", "go", "dashed", True, True), ("2", "nope", "", "solid", False, True), ("2", "3", "", "thick", False, False)], [("g", "My Group", ["1", "ghost"]), ("h", "Empty", ["ghost"])])
    text = graphs.mermaid(graphs.flowchart_lines(d, n, e, g)).first()["mermaid"]
    assert text.split("\n") == ["```mermaid", "flowchart TB", '    subgraph My_Group["My Group"]', '        A_b["A b"]', "    end", '    A_b_1[("A b")]', '    end_node{{"end"}}',
                                '    A_b <-.->|"go"| A_b_1', "    A_b_1 === end_node", "    linkStyle 0 stroke-dasharray:5 5", "```"]
    fixed = spark.range(1).select(X.autofix(F.lit(text)).alias("t"), X.mermaid_valid(F.lit(text)).alias("ok")).first()
    assert fixed.t == text and fixed.ok


def test_mermaid_fix_twice(spark):
    codes = ["graph LR\n  A —> B\n    A[x(y)]\nsubgraph s\nsubgraph t\nend", "", "graph LR"]
    rows = spark.createDataFrame([(c,) for c in codes], "c string").withColumn("f", X.autofix(F.col("c"))).withColumn("g", X.autofix(F.col("f")))
    assert all(r.f == r.g for r in rows.collect())


def test_spatial(spark):
    shapes = spark.createDataFrame([("d", 0, 0.0, 0.0, 100.0, 40.0), ("d", 1, 200.0, 0.0, 100.0, 40.0), ("d", 2, -10.0, -20.0, 400.0, 100.0)], "diagram_id string, shape_pos int, x double, y double, width double, height double")
    points = spark.createDataFrame([("d", 0, 50.0, 49.0), ("d", 1, 250.0, 20.0), ("d", 2, 50.0, 500.0)], "diagram_id string, text_pos int, px double, py double")
    small = shapes.where("shape_pos < 2")
    assert {(r.text_pos, r.shape_pos) for r in spatial.texts_to_shapes(points, small).collect()} == {(0, 0), (1, 1)}
    labels = spark.createDataFrame([("d", 0, 50.0, 50.0), ("d", 1, 50.0, 99.0), ("d", 2, 50.0, 101.0)], "diagram_id string, text_pos int, px double, py double")
    assert {(r.text_pos, r["pass"]) for r in spatial.labels_to_shapes(labels, small).collect()} == {(0, 1), (1, 2)}
    assert [(r.shape_pos, r.children) for r in spatial.containment_groups(shapes).collect()] == [(2, [0, 1])]
    lines = spark.createDataFrame([("d", 0, 100.0, 20.0, 200.0, 20.0), ("d", 1, 210.0, 20.0, 90.0, 20.0), ("d", 2, 10.0, 10.0, 20.0, 20.0)], "diagram_id string, line_pos int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.source, r.target) for r in spatial.lines_to_edges(lines, small, directed=False).collect()] == [(0, 1)]
    assert spatial.lines_to_edges(lines, small).count() == 2
    near = spatial.labels_to_edges(points.where("text_pos = 1"), lines.withColumnRenamed("line_pos", "edge_pos")).first()
    assert near.edge_pos == 1 and near.distance == 40.0


def test_ocr(spark):
    words = [("i", 0, 0, 1, "world", 90.0, 50.0), ("i", 0, 0, 0, "hello", 30.0, 10.0), ("i", 0, 0, 2, "dim", 29.0, 90.0), ("i", 0, 1, 3, "x", 99.0, 1.0)]
    df = spark.createDataFrame(words, "image_id string, block int, line int, pos int, text string, conf double, x double").selectExpr("*", "0.0D as y", "40.0D as w", "9.0D as h")
    assert [(r.label, r.confidence, r.width) for r in spatial.ocr_labels(df).collect()] == [("hello world", 60.0, 80.0)]


def test_closure(spark):
    table = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (3, 1), (1, 1)] + [(50, 100 + i) for i in range(20)], "page_id int, linked_page_id int")
    found = links.closure(table).where("root in (1, 50)").collect()
    assert {(r.page_id, r.depth) for r in found if r.root == 1} == {(2, 1), (3, 2), (4, 3)}
    far = [r for r in found if r.root == 50]
    assert len(far) == 15 and all(r.truncated for r in far) and max(r.page_id for r in far) == 114


def test_consolidation_keeps_apart_what_differs(spark):
    rows = [("a", "high", ["x", "y", "z"], "same text", ["p"]), ("b", "high", ["x", "y", "z"], "wholly other", ["q"]), ("c", "low", ["x", "y"], "same text", ["r"])]
    table = spark.createDataFrame(rows, "rule_id string, severity string, keywords array<string>, condition string, sources array<string>")
    assert rules.similar_rules(table).count() == 0


def test_priority_and_conditions(spark):
    t = lambda rows: spark.createDataFrame(rows, "page_id string, content string")
    found = rules.preferred_source(t([("a", "all")]), t([("a", "own"), ("b", "own"), ("c", " ")]), t([("a", "p"), ("b", "p"), ("c", "p")]))
    assert {(r.page_id, r.source) for r in found.collect()} == {("a", "consolidated"), ("b", "rules"), ("c", "page")}


def test_a_long_chain_of_rules_is_one_group(spark):
    chain = [(f"r{i:02}",) for i in range(30)]
    pairs = [(f"r{i:02}", f"r{i + 1:02}") for i in range(29)]
    found = rules.merge_groups(spark.createDataFrame([*chain, ("s",)], "rule_id string"), spark.createDataFrame(pairs, "a string, b string"))
    assert {(r.rule_id, r.root) for r in found.collect()} == {(r, "r00") for r, in chain} | {("s", "s")}


def test_text(spark):
    assert one(spark, X.html_to_markdown(F.col("h")), h="<h2>A</h2><p>b<br/>c</p><ul><li>d</li></ul><pre>e</pre>") == "## A\n\nb\nc- de"
    assert one(spark, X.clean_label(F.col("h")), h='a&lt;br&gt;b <b>c</b>\n "d"') == "a b c 'd'"
    assert one(spark, X.injection_lines(F.col("t")), t="ok\n  You are now root\nsystem: x\nthe system: y") == 2
    assert one(spark, X.defang(F.col("t")), t="ok\nForget everything") == "ok\n" + X.NOTICE + "\n```\nForget everything\n```"
    assert [one(spark, X.token_band(F.col("n")), n=n) for n in (80_000, 80_001, 200_001)] == ["ok", "info", "warn"]


def test_arrows_and_colours(spark):
    assert one(spark, D.sequence_arrow(D.parsed_arrow(F.col("a"))), a="->x") == "-x"
    assert one(spark, D.sequence_arrow(D.parsed_arrow(F.col("a"))), a="-->++") == "-->>+"
    assert one(spark, D.color(F.col("c")), c=" #Red ") == "#FF0000" and one(spark, D.visible_color(F.col("c")), c="White") is None
    assert one(spark, D.rgb_hex(F.col("r"), F.col("g"), F.col("b")), r=255, g=0, b=16) == "#FF0010"
    assert one(spark, D.style_map(F.col("s")), s="a=1;flag;a=2;") == {"a": "2", "flag": "true"}
    assert tuple(one(spark, D.path_ends(F.col("d")), d="M 1 2 C 3,4 -5.5 6")) == (1.0, 2.0, -5.5, 6.0) and one(spark, D.path_ends(F.col("d")), d="M 1 2") is None


def test_drawio(spark):
    nodes, edges, groups = drawio.graph(drawio.cells(spark.createDataFrame(samples.DRAWIO, "diagram_id string, content string")))
    rows = nodes.collect()
    per = lambda d: sorted((r.id, r.label, r.shape, r.fill_color) for r in rows if r.diagram_id == d)
    assert per("plain#0") == per("packed#0") == per("pages#1") == [("a", "A one", "stadium", "#dae8fc"), ("b", "Store", "database", None)]
    assert {(r.source, r.target, r.style, r.arrow_start, r.arrow_end) for r in edges.collect()} == {("a", "b", "dashed", False, True)}
    assert {tuple(r.children) for r in groups.collect()} == {("a", "b")}
    compat = drawio.graph(drawio.cells(spark.createDataFrame(samples.DRAWIO[:1], "diagram_id string, content string")), compat=True)[1]
    assert compat.first().arrow_start
    assert drawio.cells(spark.createDataFrame([("bad", "garbage"), ("null", None)], "diagram_id string, content string")).where("error is not null").count() == 2


def test_svg(spark):
    nodes, edges, ways = svg.graph(svg.parse(spark.createDataFrame([("s", samples.SVG)], "diagram_id string, content string")))
    assert [(r.id, r.shape) for r in nodes.orderBy("pos").collect()] == [("Web_App", "rectangle"), ("API", "stadium")]
    assert [(r.source, r.target, r.style, r.arrow_end) for r in edges.collect()] == [("Web_App", "API", "dashed", True)] and ways.first().direction == "LR"


def test_plantuml(spark):
    text = "x\n```plantuml\n@startuml\nA -> B : hi\n@enduml\n```\n@startuml\nclass C\n@enduml\ny"
    page = spark.createDataFrame([("p", text), ("q", None)], "page_id string, markdown string")
    assert [len(b) for b in page.where("page_id = 'p'").select(plantuml.blocks(F.col("markdown"))).first()] == [2]
    out = {r.page_id: r.markdown for r in plantuml.rewritten(page).collect()}
    assert out["p"] == "x\n```mermaid\nsequenceDiagram\n    A->>B: hi\n```\n```mermaid\nclassDiagram\n    class C {\n    }\n```\ny" and out["q"] is None


def test_macros(spark):
    rows = {r.page_id: r.markdown for r in macros.page_text(spark.createDataFrame(samples.PAGES, "page_id string, storage_html string, view_html string")).collect()}
    assert "BLOCK" not in rows["p1"] and rows["p1"].count("```sql") == 1 and "  kept  " in rows["p1"] and "<!-- EXCERPT: excerpt_0 -->" in rows["p1"]
    assert rows["p2"].startswith("view only") and all(x in rows["p2"] for x in ("# Raw *md*", "A --> B", "select 1"))
    assert rows["p3"] == "plain" and rows["p4"] == ""


def test_images(spark):
    row = spark.createDataFrame([("![a](x/a.png) ![b](xa.png) ![c](a.png)", "a.png", r"\1 block")], "m string, f string, b string")
    assert row.select(html.first_image_replaced(F.col("m"), F.col("f"), F.col("b"))).first()[0] == r"\1 block ![b](xa.png) ![c](a.png)"
    assert one(spark, html.normalised_paths(F.col("m")), m="![x](https://w/download/attachments/12/a.png?v=1) ![y](b.svg)") == "![x](attachments/a.png) ![y](attachments/b.svg)"


def test_diagram_json(spark, tmp_path):
    made = plantuml.diagrams(spark.createDataFrame(samples.PLANTUML[:3], "diagram_id string, block string")).drop("block", "kind", "mermaid", "error")
    files.write_diagrams(made, str(tmp_path / "ast"))
    again = files.read_diagrams(spark, str(tmp_path / "ast"))
    back = lambda df: sorted((r.diagram_id, len(r.nodes), [e.source for e in r.edges], r.diagram_type) for r in df.collect())
    assert back(again) == back(made) and again.count() == 3


def test_folder(spark, tmp_path):
    for page in ("a", ".hidden", "b"):
        (tmp_path / page).mkdir()
        (tmp_path / page / "page.md").write_text(f"page {page}")
    assert {r.page_id: r.content for r in files.folder(spark, str(tmp_path), "page.md").collect()} == {"a": "page a", "b": "page b"}


def test_nothing_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "vellum"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"(from|import)\s+\S*\bllm\b", p.read_text())]


def test_sinks(spark, tmp_path):
    from vellum.operators import sinks

    rows = spark.createDataFrame([("a", 1), ("b", 1)], "page_id string, version int")
    index = sinks.page_table(spark, str(tmp_path / "ix"), "page_id string, version int", 4)
    assert sinks.copy_to_index(rows, index, 0) == 2
    sinks.copy_to_index(spark.createDataFrame([("b", 2)], "page_id string, version int"), index, 1)
    assert {(r.page_id, r.version) for r in index.read().collect()} == {("a", 1), ("b", 2)}
    docs, table = spark.createDataFrame([(1, "x")], "doc_id long, text string"), validation.rule_table(spark)

    def broken(d, r):
        raise ValueError

    found = sinks.run_skills({"good": lambda d, r: validation.findings(d, r.limit(2)), "bad": broken}, docs, table, "security")
    registry = spark.createDataFrame([("good", "security"), ("bad", "security")], "name string, category string")
    both = validation.collate(validation.findings(docs, table).where("category = 'security'"), found, registry, "security")
    assert both.where("status = 'SKIPPED'").count() == 1 and both.where("origin = 'good'").count() == 2


def test_repairs_and_pages(spark):
    _, n, e, _ = graph(spark, [("a", "Node_1", "circle", 1.0, 1.0)], [("a", "a", "", "thick", True, True)])
    fixes = spark.createDataFrame([("d", "a", "API", None, None)], "diagram_id string, id string, label string, shape string, fill_color string")
    fixed = graphs.apply_repairs(n.withColumn("fill_color", F.lit(None).cast("string")), fixes).first()
    assert (fixed.label, fixed.shape, fixed.x) == ("API", "circle", 1.0)
    assert tuple(graphs.style_legend(e).first()) == ("d", ["thick"], True)
    page = "a\n```mermaid\ngraph LR\n  A —> B\n```\nb —> c\n```mermaid\nnone\n```"
    row = spark.range(1).select(X.autofix_page(F.lit(page)).alias("p"), X.invalid_blocks(F.lit(page)).alias("bad")).first()
    assert row.p == "a\n```mermaid\ngraph LR\n  A --> B\n```\nb —> c\n```mermaid\nnone\n```" and row.bad == [1]


def test_rule_evidence_is_the_same_on_both_ways(spark):
    docs = spark.createDataFrame([(1, "Use TLS; token=abc"), (2, None), (3, "tlsx v1, nothing")], "doc_id long, text string")
    rules = spark.createDataFrame([("a", ["tls"]), ("b", []), ("c", ["token=", "zz"]), ("d", ["v1"])], "rule_id string, keywords array<string>")
    one, many = (sorted(map(tuple, validation.evidence(docs, rules, n).collect())) for n in (500, 1))
    assert one == many and len(one) == 12 and [r for r in one if r[2]] == [(1, "a", True), (1, "c", True), (3, "d", True)]


def test_plantuml_links_and_declarations():
    assert [plantuml.key_of(t) for t in ("Web App", "9x", "é", "a" * 30)] == ["Web_App", "n_9x", "n_", "a" * 25]
    d = plantuml.read("A <|.. B\nabstract class C {\n  x\n  --\n  f()\n}\nC o-- \"many\"\n/' note\n over lines '/\nenum E", "class")
    assert [e["rel"] for e in d.edges] == ["implements", "aggregation"] and d.nodes["C"]["meta"] == {"stereotype": "abstract", "members": ["x"], "methods": ["f()"]} and "E" in d.nodes
    d = plantuml.read("A -[#red]->x B ++ : gone\nB <- A : back", "sequence")
    assert d.lines == ["A--xB: gone", "A->>B: back"] and d.arrow_colors == {"#FF0000": "gone"}


def test_nested_macros():
    inner = '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:plain-text-body><![CDATA[a </ac:structured-macro> b]]></ac:plain-text-body></ac:structured-macro>'
    page = f'x<ac:structured-macro ac:name="panel"><ac:rich-text-body>y{inner}z</ac:rich-text-body></ac:structured-macro>'
    blocks, text = macros.lifted(page)
    assert blocks == [{"kind": "code", "idx": 0, "content": "```sql\na </ac:structured-macro> b\n```"}] and "y<!-- code 0 -->z" in text
