"""Annotation scan: SVG text to (seq, cls_id, x0, y0, x1, y1) per element group."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CLASSES

NS = "{http://www.w3.org/2000/svg}"


def svg_class(group_id: Column) -> Column:
    """The first class whose name is part of the id, whatever its case: "Bedroom" is a room, "DoorWall" a wall; else null."""
    low = F.lower(group_id)
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(CLASSES))):
        out = F.when(low.contains(c), i).otherwise(out)
    return out


def class_of(group_id: str) -> int | None:
    return next((i for i, c in enumerate(CLASSES) if c in group_id.lower()), None)


def bbox(e: ET.Element) -> tuple[float, float, float, float] | None:
    """Box of a rect, line, polygon or polyline; None for others. A malformed number raises ValueError."""
    num = lambda k: float(e.get(k, 0))
    kind = e.tag.removeprefix(NS)
    if kind == "rect":
        return num("x"), num("y"), num("x") + num("width"), num("y") + num("height")
    if kind == "line":
        xs, ys = (num("x1"), num("x2")), (num("y1"), num("y2"))
    elif kind in ("polygon", "polyline"):
        pts = [p.split(",") for p in e.get("points", "").split() if "," in p]
        if not pts:
            return None
        xs, ys = [float(p[0]) for p in pts], [float(p[1]) for p in pts]
    else:
        return None
    return min(xs), min(ys), max(xs), max(ys)


def scan(text: str | None) -> tuple[list[tuple[int, float, float, float, float]], int, bool]:
    """Boxes of the direct children of all groups under the root, how many were rejected, and whether the text is XML."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return [], 0, False
    out, bad = [], 0
    for g in root.iter(f"{NS}g"):
        cls = None if g is root else class_of(g.get("id", ""))
        if cls is None:
            continue
        for child in g:
            try:
                box = bbox(child)
            except ValueError:
                bad += 1
                continue
            if box:
                out.append((cls, *box))
    return out, bad, True


def scan_svg(docs: DataFrame) -> DataFrame:
    """(name, seq, cls_id, x0, y0, x1, y1) of (name, svg). Malformed XML gives no rows, a malformed number drops its element."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(r.name_, i, *b) for r in pdf.itertuples(index=False) for i, b in enumerate(scan(r.svg)[0])]
            yield pd.DataFrame(rows, columns=["name", "seq", "cls_id", "x0", "y0", "x1", "y1"])

    return docs.select(F.col("name").alias("name_"), "svg").mapInPandas(run, "name string, seq int, cls_id int, x0 double, y0 double, x1 double, y1 double")


def svg_report(docs: DataFrame) -> DataFrame:
    """(name, n_boxes, n_rejected, well_formed) of (name, svg)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [scan(x) for x in pdf.svg]
            yield pd.DataFrame({"name": pdf.name_, "n_boxes": [len(b) for b, _, _ in got], "n_rejected": [r for _, r, _ in got], "well_formed": [w for _, _, w in got]})

    return docs.select(F.col("name").alias("name_"), "svg").mapInPandas(run, "name string, n_boxes long, n_rejected long, well_formed boolean")
