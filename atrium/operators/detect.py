"""Detections to plan elements: boxes(plan_id, ord, cls_id, conf, x1, y1, x2, y2) and masks in pixels."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import round3
from ..functions.simplify import simplified_rooms
from ..model import CLASSES, DEFAULT, Config


def class_name(cls_id: Column) -> Column:
    """Name of a class; "unknown" for any other id, negative ones included."""
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in CLASSES]), cls_id.cast("int")), F.lit("unknown"))


def confident(boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return boxes.where(F.col("conf") >= cfg.min_confidence)


def to_metres(boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return boxes.withColumns({c: F.col(c) / F.lit(cfg.pixels_per_meter) for c in ("x1", "y1", "x2", "y2")})


def segment(b: Column, cfg: Config = DEFAULT) -> dict[str, Column]:
    """A wall box in metres as a segment: wider than high it is level, else upright."""
    wide = b["x2"] - b["x1"] > b["y2"] - b["y1"]
    mx, my = (b["x1"] + b["x2"]) / 2.0, (b["y1"] + b["y2"]) / 2.0
    pick = lambda level, upright: round3(F.when(wide, level).otherwise(upright))
    return {"sx": pick(b["x1"], mx), "sy": pick(my, b["y1"]), "ex": pick(b["x2"], mx), "ey": pick(my, b["y2"]), "thickness": F.lit(cfg.wall_thickness), "confidence": round3(b["conf"])}


def opening(b: Column, cfg: Config = DEFAULT) -> dict[str, Column]:
    """A door's or window's box: its centre unrounded, its width not under the least of its kind."""
    kind = class_name(b["cls_id"])
    least = F.when(kind == "window", cfg.min_window).otherwise(cfg.min_door)
    width = F.greatest(F.least(b["x2"] - b["x1"], b["y2"] - b["y1"]), least)
    return {"kind": kind, "x": (b["x1"] + b["x2"]) / 2.0, "y": (b["y1"] + b["y2"]) / 2.0, "width": width, "confidence": round3(b["conf"])}


class Here:
    """The columns of the row at hand, as a struct's fields."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def wall_segments(boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(plan_id, ord, wall_index, sx, sy, ex, ey, thickness, confidence) of wall boxes in metres; wall_index counts the walls in order."""
    at = F.row_number().over(Window.partitionBy("plan_id").orderBy("ord")) - 1
    return boxes.where("cls_id = 0").select("plan_id", "ord", at.cast("int").alias("wall_index"), *[v.alias(k) for k, v in segment(Here(), cfg).items()])


def opening_boxes(boxes: DataFrame, kind: str | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(plan_id, ord, kind, x, y, width, confidence) of one kind or of both in one pass."""
    ids = [CLASSES.index(k) for k in ([kind] if kind else ["door", "window"])]
    return boxes.where(F.col("cls_id").isin(ids)).select("plan_id", "ord", *[v.alias(k) for k, v in opening(Here(), cfg).items()])


def mask_polygons(masks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """masks(plan_id, mask_idx, cls_id, contour array<struct<x,y>>) to (plan_id, mask_idx, label, polygon, area).

    mask_idx counts all masks, so labels may have gaps. Under three points, before or after simplifying, there is no
    room; nor under the least area, which is taken unrounded from rounded points. A contour with a missing or unbounded
    number gives none either.
    """

    @F.arrow_udf("struct<polygon:array<array<double>>,area:double>")
    def room(contours: pa.Array) -> pa.Array:
        return simplified_rooms(contours, cfg.simplify_pixels, cfg.pixels_per_meter, cfg.min_room_area)

    rooms = masks.where(F.col("cls_id") == CLASSES.index("room"))
    # Called nondeterministic so that a filter on what it gives doesn't go below it and compute it again.
    out = rooms.withColumn("__room", room.asNondeterministic()("contour")).where("__room is not null")
    return out.select("plan_id", "mask_idx", F.concat(F.lit("room_"), F.col("mask_idx")).alias("label"), "__room.polygon", "__room.area")


def zip_masks(plans: DataFrame) -> DataFrame:
    """(plan_id, mask_idx, cls_id, contour) of (plan_id, classes, contours): joined by place."""
    z = plans.select("plan_id", F.posexplode(F.arrays_zip("classes", "contours")).alias("mask_idx", "z"))
    return z.select("plan_id", "mask_idx", F.col("z.classes").alias("cls_id"), F.col("z.contours").alias("contour"))


def suppress(boxes: DataFrame, iou: float = 0.45) -> DataFrame:
    """Greedy suppression of raw boxes by confidence, then ord, within plan and class; a plan's boxes are folded as one array in the JVM."""
    rest = [c for c in boxes.columns if c not in ("plan_id", "cls_id")]
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    side = lambda a, b, lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    both = lambda a, b: side(a, b, "x1", "x2") * side(a, b, "y1", "y2")
    over = lambda a, b: both(a, b) > (area(a) + area(b) - both(a, b)) * iou
    item = F.struct((-F.col("conf")).alias("__place"), *["ord", *[c for c in rest if c != "ord"]])
    groups = boxes.groupBy("plan_id", "cls_id").agg(F.array_sort(F.collect_list(item)).alias("b"))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: over(b, k)), kept).otherwise(F.concat(kept, F.array(b))))
    return groups.select("plan_id", "cls_id", F.inline(kept)).select(*boxes.columns)


def one_call(detector: Callable[[str], list[dict]], path: str, seconds: float) -> tuple[list[dict], str | None]:
    """What the detector finds, or what went wrong; a call that takes longer is left to end by itself."""
    answer: queue.Queue = queue.Queue()

    def call() -> None:
        try:
            answer.put((list(detector(path)), None))
        except Exception as e:  # a detector may raise anything; it becomes the image's error
            answer.put(([], f"{type(e).__name__}: {e}"))

    threading.Thread(target=call, daemon=True).start()
    try:
        return answer.get(timeout=seconds)
    except queue.Empty:
        return [], f"no answer within {seconds:g} seconds"


def detect(images: DataFrame, detector: Callable[[str], list[dict]], seconds: float = 60.0) -> DataFrame:
    """Boxes of (plan_id, path) by a detector that is given a path and returns dicts of cls_id, conf, x1, y1, x2, y2.

    (plan_id, ord, cls_id, conf, x1, y1, x2, y2, error): an image whose call raises, or takes longer than the time
    limit, has one row with the error and nothing else, so that it can be told from one without boxes; the others go on.
    """
    names = ["cls_id", "conf", "x1", "y1", "x2", "y2"]
    kinds = [pa.int32(), *[pa.float64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place, found, errors = [], [], [], []
            for i, path in enumerate(batch.columns[1].to_pylist()):
                boxes, error = one_call(detector, path, seconds)
                boxes = [{}] if error else boxes
                at += [i] * len(boxes)
                place += [None] if error else range(len(boxes))
                found += boxes
                errors += [error] * len(boxes)
            cols = [pa.array([b.get(n) for b in found], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.columns[0].take(pa.array(at, pa.int64())), pa.array(place, pa.int64()), *cols, pa.array(errors, pa.string())], names=["plan_id", "ord", *names, "error"])

    kind = images.schema["plan_id"].dataType.simpleString()
    return images.select("plan_id", "path").mapInArrow(run, f"plan_id {kind}, ord long, cls_id int, conf double, x1 double, y1 double, x2 double, y2 double, error string")
