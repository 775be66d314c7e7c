"""SVG drawings as diagrams: XML runs in Python, the rest is joins in the plane."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import diagrams as D
from ..operators import graphs, spatial
from ..session import settled, shuffled, small_batches

ELEMENTS = "diagram_id string, kind string, pos int, tag string, text string, x double, y double, width double, height double, x2 double, y2 double, rx double, ry double, fill string, stroke string, dashed boolean, stroke_width double, arrow_end boolean, arrow_start boolean"


def number(value, default: float = 0.0) -> float:
    try:
        return float(re.sub(r"[^\d.eE+-]", "", value or "") or default)
    except ValueError:
        return default


def elements(svg: str) -> list[tuple]:
    """Rows of ELEMENTS without the id; none for text that isn't XML."""
    try:
        root = ET.fromstring(svg)
    except ET.ParseError:
        return []
    out = []
    for pos, e in enumerate(root.iter()):
        tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
        css = dict((k.strip(), v.strip()) for k, _, v in (p.partition(":") for p in e.get("style", "").split(";")) if v)
        look = lambda name, e=e, css=css: next((v for v in (e.get(name), css.get(name)) if v and v != "none"), None)
        n = lambda name, e=e: number(e.get(name))
        box, ends, text, kind = [0.0] * 4, (0.0, 0.0), None, None
        if tag == "rect":
            kind, box = "shape", [n("x"), n("y"), n("width"), n("height")]
        elif tag in ("circle", "ellipse"):
            rx, ry = (n("r"), n("r")) if tag == "circle" else (n("rx"), n("ry"))
            kind, box = "shape", [n("cx") - rx, n("cy") - ry, 2 * rx, 2 * ry]
        elif tag in ("text", "tspan") and (e.text or "").strip():
            kind, text, box = "text", e.text.strip(), [n("x"), n("y"), 0.0, 0.0]
        elif tag in ("line", "path", "polyline"):
            numbers = [n("x1"), n("y1"), n("x2"), n("y2")] if tag == "line" else [float(v) for v in re.findall(r"[-+]?\d*\.?\d+", e.get("d" if tag == "path" else "points", ""))]
            if len(numbers) >= 4 and math.dist(numbers[:2], numbers[-2:]) >= 10:
                kind, box, ends = "line", [*numbers[:2], 0.0, 0.0], tuple(numbers[-2:])
        elif tag == "image":
            kind = "image"
        if kind:
            start = bool(look("marker-start"))
            out.append((kind, pos, tag, text, *box, *ends, n("rx"), n("ry"), look("fill"), look("stroke"), bool(look("stroke-dasharray")), number(look("stroke-width"), 1.0), bool(look("marker-end")) or start, start))
    return out


def parse(drawings: DataFrame) -> DataFrame:
    """ELEMENTS of `drawings` (diagram_id, content)."""

    def run(frames):
        names = [c.split()[0] for c in ELEMENTS.split(", ")]
        for frame in frames:
            yield pd.DataFrame([(i, *row) for i, content in zip(frame["diagram_id"], frame["content"]) for row in elements(content or "")], columns=names)

    small_batches()
    return drawings.select("diagram_id", "content").mapInPandas(run, ELEMENTS)


def graph(found: DataFrame, tolerance: float = 30.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and diagrams (diagram_id, direction); drawings without shapes, such as wrapped images, have none."""
    found = settled(found, "svg-elements")
    many = found.limit(session.SENT + 1).count() > session.SENT
    shapes = found.where("kind = 'shape' and width > 5 and height > 5").where(~(F.coalesce(F.lower("fill"), F.lit("white")).isin("#ffffff", "white") & F.col("stroke").isNull()))
    shapes = shapes.select("diagram_id", F.col("pos").alias("shape_pos"), "x", "y", "width", "height", "fill", "stroke", D.svg_shape(F.col("tag"), F.col("rx"), F.col("ry")).alias("shape"))
    texts = found.where("kind = 'text'").select("diagram_id", F.col("pos").alias("text_pos"), "text", F.col("x").alias("px"), F.col("y").alias("py"))
    labels = shuffled(spatial.shape_labels(spatial.texts_to_shapes(texts, shapes), shuffled(texts, many)), many)
    shapes = spatial.labelled_only(shapes.join(labels, ["diagram_id", "shape_pos"], "left"))
    named = graphs.unique_ids(shapes.withColumn("base", D.svg_id_base(F.col("label"))).withColumn("pos", F.col("shape_pos")), out="id")
    nodes = named.select("diagram_id", "pos", "id", "label", "shape", "x", "y", "width", "height", F.col("fill").alias("fill_color"), F.col("stroke").alias("stroke_color"), F.lit(1.0).alias("confidence"))
    lines = found.where("kind = 'line'").select("diagram_id", F.col("pos").alias("line_pos"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", "dashed", "stroke_width", "arrow_end", "arrow_start")
    ends = spatial.lines_to_edges(lines, shapes, tolerance).join(shuffled(lines, many), ["diagram_id", "line_pos"])
    ids = shuffled(nodes.select("diagram_id", "pos", "id"), many)
    ends = ends.join(ids.select("diagram_id", F.col("pos").alias("source"), F.col("id").alias("s")), ["diagram_id", "source"]).join(ids.select("diagram_id", F.col("pos").alias("target"), F.col("id").alias("t")), ["diagram_id", "target"])
    style = F.when(F.col("stroke_width") > 2.5, "thick").when(F.col("dashed"), "dashed").otherwise("solid")
    nth = F.row_number().over(Window.partitionBy("diagram_id").orderBy("line_pos"))
    edges = ends.select("diagram_id", F.col("line_pos").alias("pos"), F.concat(F.lit("edge_"), nth).alias("id"), F.col("s").alias("source"), F.col("t").alias("target"), F.lit("").alias("label"), style.alias("style"), "arrow_start", "arrow_end", F.lit(1.0).alias("confidence"))
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    flat = (F.max(cx) - F.min(cx)) > (F.max(cy) - F.min(cy))
    return nodes, edges, nodes.groupBy("diagram_id").agg(F.when(flat, "LR").otherwise("TB").alias("direction"))
