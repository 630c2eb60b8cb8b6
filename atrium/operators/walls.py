"""Walls as boxes: which of them are solid, their corners and faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import direction, perpendicular
from ..model import DEFAULT, Config

#: Faces of a box whose vertices 0-3 are its bottom and 4-7 its top, in the same order; seen against the clock from outside.
BOX_FACES = ((0, 1, 2, 3), (7, 6, 5, 4), (0, 4, 5, 1), (1, 5, 6, 2), (2, 6, 7, 3), (3, 7, 4, 0))


def vertex(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def solid_walls(walls: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Walls that aren't degenerate; indexes stay."""
    return walls.where(direction(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey"), cfg.degenerate)[2] >= cfg.degenerate)


def box_corners(height: float, cfg: Config = DEFAULT) -> Column:
    """Corners of a wall: start-, start+, end+, end- below, then above."""
    dx, dy, _ = direction(*map(F.col, ("sx", "sy", "ex", "ey")), cfg.degenerate)
    px, py = perpendicular(dx, dy)
    half = F.col("thickness") / 2.0
    corner = lambda x, y, s: (F.col(x) + px * half * s, F.col(y) + py * half * s)
    ring = [corner("sx", "sy", -1.0), corner("sx", "sy", 1.0), corner("ex", "ey", 1.0), corner("ex", "ey", -1.0)]
    return F.array(*[vertex(x, y, F.lit(z)) for z in (0.0, height) for x, y in ring])
