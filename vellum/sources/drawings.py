"""Rendered Mermaid drawings (SVG) as boxes and lines, and pictures as raw shapes where image libraries are installed."""

from __future__ import annotations

import base64
import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from ..session import small_batches

PARTS = "diagram_id string, pos int, kind string, id string, text string, x double, y double, width double, height double, points array<struct<x:double,y:double>>"
SHAPES = "image_id string, shape_pos int, x double, y double, width double, height double, area double, image_area double, vertices int, circularity double, error string"


def moved(transform: str | None) -> tuple[float, float]:
    m = re.search(r"translate\(\s*([-\d.]+)[\s,]+([-\d.]+)", transform or "")
    return (float(m[1]), float(m[2])) if m else (0.0, 0.0)


def decoded_points(data: str | None) -> list[dict]:
    try:
        return [{"x": float(p["x"]), "y": float(p["y"])} for p in json.loads(base64.b64decode(data or ""))]
    except (ValueError, KeyError, TypeError):
        return []


def parts(svg: str) -> list[tuple]:
    """Clusters, nodes, edges and edge labels, shifted by the groups that they are in."""
    try:
        root = ET.fromstring(svg)
    except ET.ParseError:
        return []
    out: list[tuple] = []

    def text_of(e) -> str:
        return " ".join(" ".join(e.itertext()).split())

    def walk(e, px: float, py: float) -> None:
        dx, dy = moved(e.get("transform"))
        x, y = px + dx, py + dy
        classes = e.get("class", "").split()
        kind = next((k for k in ("cluster", "node", "edgeLabel") if k in classes), None)
        if kind:
            box = next((b for b in e.iter() if b.tag.rpartition("}")[2] == "rect"), None)
            at = [float(box.get(k) or 0) if box is not None else 0.0 for k in ("x", "y", "width", "height")]
            out.append((kind, e.get("id"), text_of(e), x + at[0], y + at[1], at[2], at[3], []))
        if e.get("data-points"):
            out.append(("edge", e.get("data-id") or e.get("id"), None, 0.0, 0.0, 0.0, 0.0, decoded_points(e.get("data-points"))))
        if kind in (None, "cluster"):
            for child in e:
                walk(child, x, y)

    walk(root, 0.0, 0.0)
    return out


def rendered(drawings: DataFrame) -> DataFrame:
    """PARTS of `drawings` (diagram_id, content)."""

    def run(frames):
        names = [c.split()[0] for c in PARTS.split(", ")]
        for frame in frames:
            yield pd.DataFrame([(i, pos, *row) for i, content in zip(frame["diagram_id"], frame["content"]) for pos, row in enumerate(parts(content or ""))], columns=names)

    small_batches()
    return drawings.select("diagram_id", "content").mapInPandas(run, PARTS)


def picture_shapes(pictures: DataFrame) -> DataFrame:
    """SHAPES of `pictures` (image_id, content bytes); without the image library, or for bytes that are no picture, one row with an error."""

    def one(image_id: str, content: bytes) -> list[tuple]:
        fail = lambda why: [(image_id, 0, *[0.0] * 6, 0, None, why)]
        try:
            import cv2
            import numpy as np
        except ImportError:
            return fail("image libraries are not installed")
        image = cv2.imdecode(np.frombuffer(content or b"", np.uint8), cv2.IMREAD_COLOR)
        if image is None:
            return fail("not a picture")
        gray = cv2.GaussianBlur(cv2.cvtColor(image, cv2.COLOR_BGR2GRAY), (3, 3), 0)
        binary = cv2.dilate(cv2.adaptiveThreshold(gray, 255, cv2.ADAPTIVE_THRESH_GAUSSIAN_C, cv2.THRESH_BINARY_INV, 15, 4), np.ones((2, 2), np.uint8))
        rows = []
        for pos, contour in enumerate(cv2.findContours(binary, cv2.RETR_TREE, cv2.CHAIN_APPROX_SIMPLE)[0]):
            x, y, w, h = cv2.boundingRect(contour)
            around, area = cv2.arcLength(contour, True), cv2.contourArea(contour)
            corners = cv2.approxPolyDP(contour, 0.03 * around, True)
            rows.append((image_id, pos, float(x), float(y), float(w), float(h), float(area), float(image.shape[0] * image.shape[1]), len(corners), 4 * np.pi * area / around**2 if around else None, None))
        return rows

    def run(frames):
        names = [c.split()[0] for c in SHAPES.split(", ")]
        for frame in frames:
            yield pd.DataFrame([r for i, c in zip(frame["image_id"], frame["content"]) for r in one(i, c)], columns=names)

    small_batches()
    return pictures.select("image_id", "content").mapInPandas(run, SHAPES)
