"""Draw.io files as diagrams: only inflating and XML run in Python, cells become rows, and the rest is relational."""

from __future__ import annotations

import base64
import gzip
import html
import re
import urllib.parse
import xml.etree.ElementTree as ET
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import diagrams as D
from ..functions.text import clean_label
from ..session import settled, small_batches

CELLS = "diagram_id string, page int, pos int, id string, parent string, value string, style string, vertex string, edge string, source string, target string, x double, y double, width double, height double, is_parent boolean, error string"
TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def inflated(data: str) -> str | None:
    """The XML of a page that may be compressed."""
    data = data.strip()
    if data.startswith("<"):
        return data
    try:
        raw = base64.b64decode(urllib.parse.unquote(data))
    except ValueError:
        return None
    for unpack in (lambda b: zlib.decompress(b, -15), zlib.decompress, gzip.decompress):
        try:
            text = unpack(raw).decode("utf-8", "replace")
        except (zlib.error, OSError, EOFError):
            continue
        text = urllib.parse.unquote(text) if text.startswith("%3C") else text
        if "<mxGraphModel" in text or "<mxCell" in text:
            return text
    return None


def pages(content: str) -> list[str]:
    found = re.findall(r"(?s)<diagram[^>]*>(.*?)</diagram>", content)
    if found:
        return [p for p in (inflated(html.unescape(x) if x.lstrip().startswith("&lt;") else x) for x in found if x.strip()) if p]
    return [content] if "<mxGraphModel" in content else []


def number(value) -> float:
    try:
        return float(value or 0)
    except ValueError:
        return 0.0


def cells(diagrams: DataFrame) -> DataFrame:
    """CELLS of `diagrams` (diagram_id, content); a file that can't be read is one row with an error.  is_parent: a cell of its page names it as its parent."""

    def run(batches):
        types = dict(c.split() for c in CELLS.split(", "))
        for batch in batches:
            out = {name: [] for name in types}

            def add(n, **columns):
                for name, kind in types.items():
                    out[name].extend(columns.get(name) or [{"double": 0.0, "int": 0, "boolean": False}.get(kind)] * n)

            for diagram, content in zip(batch["diagram_id"].to_pylist(), batch["content"].to_pylist()):
                found = pages(content or "")
                if not found:
                    add(1, diagram_id=[diagram], error=["no diagram data"])
                for page, xml in enumerate(found):
                    part = re.search(r"(?s)<mxGraphModel[^>]*>.*</mxGraphModel>", xml)
                    try:
                        root = ET.fromstring(part[0] if part else xml)
                    except ET.ParseError as e:
                        add(1, diagram_id=[diagram], page=[page], error=[f"XML: {e}"])
                        continue
                    all_cells = list(root.iter("mxCell"))
                    boxes, n = [cell.find("mxGeometry") for cell in all_cells], len(all_cells)
                    said = {k: [cell.get(k) for cell in all_cells] for k in ("id", "parent", "value", "style", "vertex", "edge", "source", "target")}
                    at = {k: [number(box.get(k)) if box is not None else 0.0 for box in boxes] for k in ("x", "y", "width", "height")}
                    parents = set(said["parent"]) - {None}
                    add(n, diagram_id=[diagram] * n, page=[page] * n, pos=range(n), is_parent=[i in parents for i in said["id"]], **said, **at)
            yield pa.RecordBatch.from_arrays([pa.array(out[name], TYPES[kind], from_pandas=True) for name, kind in types.items()], list(types))

    small_batches()
    return diagrams.select("diagram_id", "content").mapInArrow(run, CELLS)


def classified(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Cells with label, shape and what they are: edge, group, node or null.  compat: edges without a start arrow have one."""
    style = D.style_map(F.col("style"))
    out = rows.where("error is null and coalesce(id, '') not in ('0', '1', '')")
    out = out.withColumn("_style", style).withColumn("label", clean_label(F.coalesce("value", F.lit("")))).withColumn("shape", D.drawio_shape(F.col("_style")))
    is_edge = (F.coalesce("edge", F.lit("")) == "1") | ((F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    is_group = (F.col("shape") == "group") | F.col("is_parent")
    kind = F.when(is_edge, "edge").when(is_group & ((F.col("label") != "") | F.col("is_parent")), "group").when(~is_group & ((F.col("vertex") == "1") | (F.col("label") != "")), "node")
    s = F.col("_style")
    return (out.withColumn("kind", kind).withColumn("edge_style", D.drawio_edge_style(s))
            .withColumn("arrow_start", D.drawio_arrow(s, "start", "classic" if compat else "none")).withColumn("arrow_end", D.drawio_arrow(s, "end", "classic"))
            .withColumn("fill_color", D.visible_color(s["fillColor"])).withColumn("stroke_color", D.visible_color(s["strokeColor"])).withColumn("font_color", D.visible_color(s["fontColor"])).drop("_style", "is_parent"))


def graph(rows: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and groups of cells(); pages are diagrams of their own, `<diagram_id>#<page>`.

    Cells are classified once and written: a filter on their kind would else take the place of its column, with the map of the style in it dozens of times, for nodes and edges apart.
    """
    c = settled(classified(rows, compat).withColumn("diagram_id", F.concat("diagram_id", F.lit("#"), F.col("page").cast("string"))), "classified")
    tail = F.substring("id", -4, 4)
    named = lambda word: F.when(F.col("label") != "", F.col("label")).otherwise(F.concat(F.lit(word), tail))
    nodes = c.where("kind = 'node'").select("diagram_id", "pos", "id", named("Node_").alias("label"), "shape", "x", "y", "width", "height", "fill_color", "stroke_color", "font_color",
                                             F.when(~F.col("parent").isin("0", "1"), F.col("parent")).alias("parent_group"), F.lit(1.0).alias("confidence"))
    nth = F.row_number().over(Window.partitionBy("diagram_id").orderBy("pos"))
    edges = c.where("kind = 'edge'").select("diagram_id", "pos", F.concat(F.lit("edge_"), nth).alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target"),
                                             "label", F.col("edge_style").alias("style"), "arrow_start", "arrow_end", F.lit(1.0).alias("confidence"))
    kids = c.select("diagram_id", F.col("parent").alias("id"), F.struct("pos", F.col("id").alias("child")).alias("k")).groupBy("diagram_id", "id").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["child"]).alias("children"))
    groups = c.where("kind = 'group'").select("diagram_id", "pos", "id", named("Group_").alias("label")).join(kids, ["diagram_id", "id"], "left")
    return nodes, edges, groups.select("diagram_id", "pos", "id", "label", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
