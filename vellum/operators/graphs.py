"""Diagram graphs as tables of nodes, edges and groups: ids, checks, direction, Mermaid.

nodes: diagram_id, pos, id, label, shape, x, y and optionally fill_color, stroke_color, font_color, confidence, metadata.
edges: diagram_id, pos, id, source, target, label, style, arrow_start, arrow_end and optionally color, metadata.
groups: diagram_id, pos, id, label, children and optionally style, fill_color.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import diagrams as D
from ..schemas import DIAGRAM_TYPES, DIRECTIONS, EDGE_STYLES, SHAPES


def exploded(diagrams: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and groups of nested diagrams."""
    part = lambda name: diagrams.select("diagram_id", F.posexplode(name).alias("pos", "x")).select("diagram_id", "pos", "x.*")
    return part("nodes"), part("edges"), part("groups")


def nested(diagrams: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The inverse of exploded(); `diagrams` has diagram_id and further columns of its own."""
    out = diagrams
    for name, rows in (("nodes", nodes), ("edges", edges), ("groups", groups)):
        fields = [c for c in rows.columns if c not in ("diagram_id", "pos")]
        item = F.struct("pos", F.struct(*fields).alias("v"))
        packed = rows.groupBy("diagram_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"]).alias(name))
        out = out.join(packed, "diagram_id", "left")
    return out


def unique_ids(rows: DataFrame, base: str = "base", out: str = "safe_id") -> DataFrame:
    """`rows` (diagram_id, pos, base) with ids made unique in each diagram: base, base_1, and so on, in the order of pos.

    Numbers by base are right unless a base looks like another's numbered id.  Only bases that are alike but for numbers at their end
    can clash; such families are numbered once more, each apart from all others and in time that grows with its rows.
    """
    n = F.row_number().over(Window.partitionBy("diagram_id", base).orderBy("pos")) - 1
    quick = rows.withColumn(out, F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), n.cast("string"))))
    quick = quick.withColumn("_family", F.regexp_replace(base, "(_[0-9]+)+$", ""))
    quick = quick.withColumn("_twice", F.count(F.lit(1)).over(Window.partitionBy("diagram_id", out)) > 1)
    quick = quick.withColumn("_clash", F.max("_twice").over(Window.partitionBy("diagram_id", "_family"))).drop("_twice")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    again = quick.where("_clash").select("diagram_id", "pos", F.col(base).alias("_base"), "_family")

    def numbered(family):
        used, number, ids = set(), {}, []
        family = family.sort_values("pos", kind="stable")
        for own in family["_base"]:
            k = number.get(own, 0)
            while (name := f"{own}_{k}" if k else own) in used:
                k += 1
            number[own] = k + 1
            used.add(name)
            ids.append(name)
        return family[["diagram_id", "pos"]].assign(_own=ids)

    slow = again.groupBy("diagram_id", "_family").applyInPandas(numbered, f"diagram_id {kinds['diagram_id']}, pos {kinds['pos']}, _own string")
    done = quick.join(slow, ["diagram_id", "pos"], "left").withColumn(out, F.coalesce("_own", out))
    return done.select(*rows.columns, *([out] if out not in rows.columns else []))


def _spread() -> Column:
    spread = lambda c: F.max(F.when(F.col(c) != 0, F.col(c))) - F.min(F.when(F.col(c) != 0, F.col(c)))
    wide = (F.count(F.lit(1)) >= 2) & (spread("x") > spread("y") * 1.5)
    return F.when(wide, "LR").otherwise("TB")


def spread_direction(nodes: DataFrame) -> DataFrame:
    """diagram_id, direction: LR if the nodes spread more than 1.5 times as far across as down, zeros not counting."""
    return nodes.groupBy("diagram_id").agg(_spread().alias("direction"))


def mean_confidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    both = nodes.select("diagram_id", "confidence").unionByName(edges.select("diagram_id", "confidence"))
    return both.groupBy("diagram_id").agg(F.bround(F.avg("confidence"), 2).alias("confidence"))


# The evaluation gate: each check gives diagram_id, check, level, subject, message.

def _issue(rows: DataFrame, check: str, level: str, subject: Column, message: Column) -> DataFrame:
    return rows.select("diagram_id", F.lit(check).alias("check"), F.lit(level).alias("level"), subject.alias("subject"), message.alias("message"))


def check_schema(nodes: DataFrame, edges: DataFrame, diagrams: DataFrame | None = None) -> DataFrame:
    at = lambda name: F.concat(F.lit(f"{name}["), F.col("pos"), F.lit("]"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    out = _issue(nodes.where(blank("id")), "schema", "error", at("nodes"), F.lit("missing id"))
    out = out.unionByName(_issue(nodes.where(F.col("label").isNull()), "schema", "error", at("nodes"), F.lit("missing label")))
    out = out.unionByName(_issue(nodes.where(~F.col("shape").isin(*SHAPES)), "schema", "error", at("nodes"), F.concat(F.lit("unknown shape "), "shape")))
    for end in ("source", "target"):
        out = out.unionByName(_issue(edges.where(blank(end)), "schema", "error", at("edges"), F.lit(f"missing {end}")))
    out = out.unionByName(_issue(edges.where(~F.col("style").isin(*EDGE_STYLES)), "schema", "error", at("edges"), F.concat(F.lit("unknown style "), "style")))
    if diagrams is not None:
        for field, domain in (("diagram_type", DIAGRAM_TYPES), ("direction", DIRECTIONS)):
            bad = diagrams.where((F.col(field) != "") & ~F.col(field).isin(*domain))
            out = out.unionByName(_issue(bad, "schema", "error", F.lit(field), F.concat(F.lit(f"unknown {field} "), field)))
    return out


def check_generic_labels(nodes: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("label"), F.lit(""))
    generic = label.rlike(r"^[Nn]ode_\d+$")
    return _issue(nodes.where(generic | (F.trim(label) == "")), "generic_labels", "error", F.col("id"), F.when(generic, F.concat(F.lit("generic label "), label)).otherwise("empty label"))


def check_edge_validity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends that are no node, and self-loops; `[*]` is a node of every state diagram."""
    known = nodes.select("diagram_id", F.col("id").alias("_id")).distinct()
    out = None
    for end in ("source", "target"):
        used = edges.where((F.coalesce(F.col(end), F.lit("")) != "") & (F.col(end) != "[*]"))
        lost = used.join(known, (used["diagram_id"] == known["diagram_id"]) & (F.col(end) == F.col("_id")), "left_anti")
        rows = _issue(lost, "edge_validity", "error", F.col("id"), F.concat(F.lit(f"unknown {end} "), end))
        out = rows if out is None else out.unionByName(rows)
    loops = edges.where((F.col("source") == F.col("target")) & (F.col("source") != ""))
    return out.unionByName(_issue(loops, "edge_validity", "error", F.col("id"), F.concat(F.lit("self-loop at "), "source")))


def check_duplicate_edges(edges: DataFrame) -> DataFrame:
    pair = Window.partitionBy("diagram_id", "source", "target").orderBy("pos")
    rows = edges.withColumn("_n", F.row_number().over(pair)).withColumn("_first", F.first("id").over(pair))
    return _issue(rows.where("_n > 1"), "duplicate_edges", "error", F.col("id"), F.concat(F.lit("duplicates "), "_first"))


def check_empty(diagrams: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    empty = diagrams.select("diagram_id").join(nodes.select("diagram_id").distinct(), "diagram_id", "left_anti")
    some = edges.select("diagram_id").distinct().withColumn("_edges", F.lit(True))
    rows = empty.join(some, "diagram_id", "left")
    return _issue(rows, "empty_graph", "error", F.col("diagram_id").cast("string"), F.when(F.col("_edges"), "edges but no nodes").otherwise("no nodes and no edges"))


def check_orphans(nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    ends = edges.select("diagram_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    grouped = groups.select("diagram_id", F.explode("children").alias("id")).distinct().withColumn("_grouped", F.lit(True))
    lonely = nodes.join(ends, ["diagram_id", "id"], "left_anti").join(grouped, ["diagram_id", "id"], "left")
    return _issue(lonely, "orphan_nodes", "warning", F.col("id"), F.when(F.col("_grouped"), "in a group but without edges").otherwise("no edges"))


def check_drift(nodes: DataFrame, edges: DataFrame, before_nodes: DataFrame, before_edges: DataFrame) -> DataFrame:
    """What a repair has moved by more than 5 or removed; additions are fine, and nodes that were at the origin may move."""
    now = nodes.select("diagram_id", "id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(True).alias("_there"))
    rows = before_nodes.join(now, ["diagram_id", "id"], "left")
    moved = ~((F.col("x") == 0) & (F.col("y") == 0)) & ((F.abs(F.col("_x") - F.col("x")) > 5) | (F.abs(F.col("_y") - F.col("y")) > 5))
    rows = rows.where(F.col("_there").isNull() | moved)
    out = _issue(rows, "cv_drift", "warning", F.col("id"), F.when(F.col("_there").isNull(), "node removed").otherwise("node moved"))
    gone = before_edges.select("diagram_id", "source", "target").distinct().join(edges.select("diagram_id", "source", "target"), ["diagram_id", "source", "target"], "left_anti")
    return out.unionByName(_issue(gone, "cv_drift", "warning", F.concat("source", F.lit("->"), "target"), F.lit("edge removed")))


def evaluate(diagrams: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """All checks of single diagrams."""
    parts = [check_schema(nodes, edges), check_generic_labels(nodes), check_edge_validity(nodes, edges), check_duplicate_edges(edges), check_empty(diagrams, nodes, edges), check_orphans(nodes, edges, groups)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(diagrams: DataFrame, nodes: DataFrame, edges: DataFrame, issues: DataFrame) -> DataFrame:
    """diagram_id, passed, total_errors, total_warnings, n_nodes, n_edges."""
    counts = issues.groupBy("diagram_id").agg(F.count_if(F.col("level") == "error").alias("e"), F.count_if(F.col("level") == "warning").alias("w"))
    n = nodes.groupBy("diagram_id").agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy("diagram_id").agg(F.count(F.lit(1)).alias("m"))
    out = diagrams.select("diagram_id").join(counts, "diagram_id", "left").join(n, "diagram_id", "left").join(m, "diagram_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("diagram_id", (zero("e") == 0).alias("passed"), zero("e").alias("total_errors"), zero("w").alias("total_warnings"), zero("n").alias("n_nodes"), zero("m").alias("n_edges"))


# Mermaid: a table of lines (diagram_id, section, ord, line), joined at the end.

def _optional(rows: DataFrame, **kinds: str) -> DataFrame:
    for name, kind in kinds.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def _styles(*parts: tuple[str, str]) -> Column:
    some = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{k}:"), F.col(c))) for k, c in parts]
    return F.array_join(F.array_compact(F.array(*some)), ",")


def flowchart_lines(diagrams: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Lines of flowcharts; a direction of TB is inferred again from the nodes, and edges without both ends are left out."""
    nodes = _optional(nodes, fill_color="string", stroke_color="string", font_color="string")
    edges, groups = _optional(edges, color="string"), _optional(groups, style="string", fill_color="string")
    nodes = unique_ids(nodes.withColumn("base", D.safe_id_base(F.col("label"), F.col("id"))))

    def lines(rows: DataFrame, *items: tuple[int, Column, Column] | Column) -> DataFrame:
        """Every row gives its lines at once, so its table is read once."""
        made = [x if isinstance(x, Column) else F.array(line(*x)) for x in items]
        return rows.select("diagram_id", F.inline(F.filter(F.concat(*made), lambda x: x["line"].isNotNull())))

    def line(section: int, order: Column, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), order.cast("long").alias("ord"), text.alias("line"))

    zero = F.lit(0)
    given = F.coalesce(F.col("direction"), F.lit("TB"))
    ways = nodes.groupBy("diagram_id").agg(_spread().alias("_spread"))
    some = edges.select("diagram_id").distinct().withColumn("_edges", F.lit(True))
    head = diagrams.join(ways, "diagram_id", "left").join(some, "diagram_id", "left")
    way = F.when(given == "TB", F.coalesce("_spread", F.lit("TB"))).otherwise(given)
    parts = [lines(head, (0, zero, F.lit("```mermaid")), (1, zero, F.concat(F.lit("flowchart "), way)), (9, zero, F.lit("```")),
                   (2, zero, F.when(F.col("_spread").isNull() & F.col("_edges").isNull(), "    A[No diagram data extracted]")))]

    # Nodes, in each of their groups or on their own, and their styles.
    member = groups.select("diagram_id", F.col("pos").alias("g"), F.explode(F.array_distinct("children")).alias("id"))
    homes = member.groupBy("diagram_id", "id").agg(F.array_sort(F.collect_list("g")).alias("_homes"))
    text = D.node_text(F.col("safe_id"), F.coalesce("label", F.lit("")), F.col("shape"))
    look = _styles(("fill", "fill_color"), ("stroke", "stroke_color"), ("color", "font_color"))
    placed = nodes.join(homes, ["diagram_id", "id"], "left").withColumn("_text", text).withColumn("_look", look)
    inside = F.transform(F.coalesce("_homes", F.array().cast(placed.schema["_homes"].dataType)), lambda g: line(3, g * 1_000_000 + F.col("pos") + 1, F.concat(F.lit("        "), "_text")))
    parts.append(lines(placed, inside, (4, F.col("pos"), F.when(F.col("_homes").isNull(), F.concat(F.lit("    "), "_text"))),
                       (6, F.col("pos"), F.when(F.col("_look") != "", F.concat(F.lit("    style "), "safe_id", F.lit(" "), "_look")))))

    # Groups that have a node.
    ids = nodes.select("diagram_id", "id", "safe_id")
    full = groups.join(member.join(ids, ["diagram_id", "id"], "left_semi").select("diagram_id", F.col("g").alias("pos")).distinct(), ["diagram_id", "pos"], "left_semi")
    tag = F.regexp_replace("label", "[^a-zA-Z0-9_]", "_")
    shade = F.array_join(F.array_compact(F.array(
        F.when(F.col("fill_color") != "", F.concat(F.lit("fill:"), "fill_color", F.lit(",fill-opacity:0.15"))), F.when(F.col("style") == "dashed", "stroke-dasharray:5 5"))), ",")
    first = F.col("pos") * 1_000_000
    parts.append(lines(full, (3, first, F.concat(F.lit("    subgraph "), tag, F.lit('["'), "label", F.lit('"]'))), (3, first + 999_999, F.lit("    end")),
                       (7, F.col("pos"), F.when(shade != "", F.concat(F.lit("    style "), tag, F.lit(" "), shade)))))

    # Edges with both ends; link styles count these only.
    drawn = edges.join(ids.select("diagram_id", F.col("id").alias("source"), F.col("safe_id").alias("s")), ["diagram_id", "source"]).join(
        ids.select("diagram_id", F.col("id").alias("target"), F.col("safe_id").alias("t")), ["diagram_id", "target"])
    nth = F.row_number().over(Window.partitionBy("diagram_id").orderBy("pos")) - 1
    stroke = F.array_join(F.array_compact(F.array(F.when(F.col("color") != "", F.concat(F.lit("stroke:"), "color")), F.when(F.col("style") == "dashed", "stroke-dasharray:5 5"))), ",")
    arrow = D.flow_arrow(F.col("style"), F.col("arrow_start"), F.col("arrow_end"))
    parts.append(lines(drawn.withColumn("_nth", nth), (5, F.col("pos"), D.edge_text(F.col("s"), F.col("t"), F.col("label"), arrow)),
                       (8, F.col("_nth"), F.when(stroke != "", F.concat(F.lit("    linkStyle "), "_nth", F.lit(" "), stroke)))))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def other_lines(kind: str, diagrams: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of sequence, class, state and er diagrams; `metadata` (map) has role, stereotype, members, methods (one in a line) and rel_type."""
    nodes, edges = _optional(nodes, metadata="map<string,string>"), _optional(edges, metadata="map<string,string>")
    meta = lambda k: F.coalesce(F.col("metadata")[k], F.lit(""))
    label = F.coalesce(F.col("label"), F.lit(""))
    row = lambda rows, section, line: rows.select("diagram_id", F.lit(section).alias("section"), F.col("pos").cast("long").alias("ord"), line.alias("line"))
    head = diagrams.withColumn("pos", F.lit(0))
    title = {"sequence": "sequenceDiagram", "class": "classDiagram", "state": "stateDiagram-v2", "er": "erDiagram"}[kind]
    parts = [row(head, 0, F.lit("```mermaid\n" + title)), row(head, 9, F.lit("```"))]
    tail = F.when(label != "", F.concat(F.lit(" : "), label)).otherwise("")
    if kind == "sequence":
        word = F.when(meta("role") == "actor", "actor").otherwise("participant")
        parts.append(row(nodes, 1, F.concat(F.lit("    "), word, F.lit(" "), "id", F.lit(" as "), label)))
        arrow = F.when(F.col("style").isin("dashed", "dotted"), "-->>").otherwise("->>")
        parts.append(row(edges, 2, F.concat(F.lit("    "), "source", arrow, "target", F.lit(": "), label)))
    elif kind == "class":
        listed = lambda k: F.when(meta(k) != "", F.concat(F.lit("        "), F.replace(meta(k), F.lit("\n"), F.lit("\n        ")), F.lit("\n"))).otherwise("")
        mark = F.when(meta("stereotype") != "", F.concat(F.lit("        <<"), meta("stereotype"), F.lit(">>\n"))).otherwise("")
        parts.append(row(nodes, 1, F.concat(F.lit("    class "), "id", F.lit(" {\n"), mark, listed("members"), listed("methods"), F.lit("    }"))))
        parts.append(row(edges, 2, F.concat(F.lit("    "), "source", F.lit(" "), D.relation_text(meta("rel_type")), F.lit(" "), "target", tail)))
    elif kind == "state":
        parts.append(row(nodes.where((label != "") & (label != "[*]")), 1, F.concat(F.lit("    "), "id", F.lit(" : "), label)))
        parts.append(row(edges, 2, F.concat(F.lit("    "), "source", F.lit(" --> "), "target", tail)))
    else:
        parts.append(row(edges, 2, F.concat(F.lit("    "), "source", F.lit(" ||--o{ "), "target", F.lit(' : "'), label, F.lit('"'))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mermaid(lines: DataFrame) -> DataFrame:
    """diagram_id, mermaid."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "ord", "line")))
    return lines.groupBy("diagram_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("mermaid"))


RENDERERS = {kind: (lambda kind: lambda d, n, e, g: other_lines(kind, d, n, e))(kind) for kind in ("sequence", "class", "state", "er")} | {"flowchart": flowchart_lines}


def render(diagrams: DataFrame) -> DataFrame:
    """diagram_id, mermaid of nested diagrams, each by its type; unknown types as flowcharts."""
    out = None
    for kind, lines in RENDERERS.items():
        own = F.col("diagram_type") == kind if kind != "flowchart" else ~F.coalesce(F.col("diagram_type"), F.lit("")).isin(*[k for k in RENDERERS if k != "flowchart"])
        part = diagrams.where(own)
        text = mermaid(lines(part, *exploded(part)))
        out = text if out is None else out.unionByName(text)
    return out


def apply_repairs(nodes: DataFrame, repairs: DataFrame) -> DataFrame:
    """`nodes` with the label, shape and colours that `repairs` (diagram_id, id, label, shape, fill_color) gives; positions stay as they were found."""
    fixes = repairs.select("diagram_id", "id", *[F.col(c).alias(f"_{c}") for c in ("label", "shape", "fill_color")])
    out = nodes.join(fixes, ["diagram_id", "id"], "left")
    for c in ("label", "shape", "fill_color"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*nodes.columns)


def style_legend(edges: DataFrame) -> DataFrame:
    """diagram_id, styles (distinct, sorted) and bidirectional."""
    return edges.groupBy("diagram_id").agg(F.array_sort(F.collect_set("style")).alias("styles"), F.coalesce(F.bool_or(F.col("arrow_start") & F.col("arrow_end")), F.lit(False)).alias("bidirectional"))
