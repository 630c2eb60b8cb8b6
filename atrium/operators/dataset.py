"""Annotated collections to training labels: discovery, split, boxes to labels."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DEFAULT, Config
from .ranks import global_rank

#: Image names in order of preference; any other PNG comes after.
PREFERRED = ("F1_scaled.png", "F1_original.png", "image.png")


def path_parts(path: Column) -> Column:
    """Sorts as paths do: by parts, so that a comes before a-b."""
    return F.split(path, "/")


def find_samples(paths: DataFrame, root: str) -> DataFrame:
    """(name, dir, svg_path, image_path) of a listing (path): folders with model.svg and an image, the preferred one.

    Names are relative folders with "_" for separators; two folders of one name raise when the result is read.
    """
    p = paths.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))
    rank = F.lit(None).cast("int")
    rank = F.when(F.col("file").endswith(".png"), len(PREFERRED)).otherwise(rank)
    for i, f in reversed(list(enumerate(PREFERRED))):
        rank = F.when(F.col("file") == f, i).otherwise(rank)
    images = p.withColumn("rank", rank).where("rank is not null").groupBy("dir").agg(F.min(F.struct("rank", "file", "path")).alias("i"))
    svg = p.where("file = 'model.svg'").select("dir", F.col("path").alias("svg_path"))
    rel = F.regexp_replace(F.expr("dir"), r"^.*?\Q" + root.rstrip("/") + r"\E/?", "")
    out = svg.join(images, "dir").select(F.translate(rel, "/\\", "__").alias("name"), "dir", "svg_path", F.col("i.path").alias("image_path"))
    n = F.count("*").over(Window.partitionBy("name"))
    return out.withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("sample name is not unique: "), F.col("name"))).cast("string")))


def split_sizes(n: int, cfg: Config = DEFAULT) -> tuple[int, int, int]:
    """(train, val, test): shares are cut to whole numbers, the rest trains."""
    test, val = int(n * cfg.test_share), int(n * cfg.val_share)
    return n - test - val, val, test


def seeded_split(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """samples with position and split, by a seeded shuffle of their order: first test, then val, the rest train.

    The shuffle is Python's, whose steps follow one another, but it needs no names: the driver holds n numbers, and the
    positions are joined to the rows by their place in path order (global_rank).
    """
    ranked = global_rank(samples, path_parts(F.col("dir")))
    n = ranked.count()
    order = list(range(n))
    random.Random(cfg.seed).shuffle(order)
    train, val, test = split_sizes(n, cfg)
    plan = pd.DataFrame({"rank": np.array(order, np.int64), "position": np.arange(n, dtype=np.int32), "split": np.repeat(["test", "val", "train"], (test, val, train))})
    return ranked.join(samples.sparkSession.createDataFrame(plan, "rank long, position int, split string"), "rank").drop("rank")


def range_split(ranked: DataFrame, rank_col: str, cfg: Config = DEFAULT) -> DataFrame:
    """The same cut by ranges of a given rank from 0, with no shuffle of the rows."""
    _, val, test = split_sizes(ranked.count(), cfg)
    r = F.col(rank_col)
    return ranked.withColumn("split", F.when(r < test, "test").when(r < test + val, "val").otherwise("train"))


def yolo_labels(boxes: DataFrame, width: Column, height: Column, least: float = 0.001) -> DataFrame:
    """boxes with cx, cy, w, h as shares of the image, clamped to it; those that are then thin are dropped."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = boxes.withColumns({"cx": unit((F.col("x0") + F.col("x1")) / 2.0 / width), "cy": unit((F.col("y0") + F.col("y1")) / 2.0 / height), "w": unit((F.col("x1") - F.col("x0")) / width), "h": unit((F.col("y1") - F.col("y0")) / height)})
    return out.where((F.col("w") > least) & (F.col("h") > least))


def convert(spark, root: str, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(samples with split, labels) of an annotated collection under root."""
    from ..sources.files import png_size, read_binary
    from ..sources.svg import scan_svg

    files = read_binary(spark, root)
    samples = seeded_split(find_samples(files.select("path"), root), cfg)
    w, h = png_size(F.col("content"))
    sizes = files.where(F.lower("path").endswith(".png")).select(F.col("path").alias("image_path"), w.alias("img_w"), h.alias("img_h"))
    svg = samples.join(files.where(F.col("path").endswith("/model.svg")).select(F.col("path").alias("svg_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("svg")), "svg_path").select("name", "svg")
    boxes = scan_svg(svg).join(samples.join(sizes, "image_path").select("name", "img_w", "img_h"), "name")
    return samples, yolo_labels(boxes, F.col("img_w"), F.col("img_h")).select("name", "seq", "cls_id", "cx", "cy", "w", "h")
