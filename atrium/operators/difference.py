"""Walls less their openings: a sweep along the wall over the rectangles that cutters leave of its face."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import direction
from ..model import DEFAULT, Config
from .sweep import cut_meshes, mesh_numbers
from .walls import solid_walls

RECTANGLE = "struct<u0:double,u1:double,z0:double,z1:double>"
POINTS = "array<struct<x:double,y:double,z:double>>"


def holes(on_wall: DataFrame, wall_height: float = DEFAULT.wall_height) -> DataFrame:
    """(plan_id, wall_index, n_cuts, holes): the rectangles that a wall's openings take from its face, cut to the face.

    on_wall comes from opening_on_wall(). An opening that lies wholly beside its wall counts as a cut but takes nothing.
    Cutters reach further than any wall is thick, so a hole goes through.
    """
    half = F.col("width") / 2.0
    u0, u1 = F.greatest(F.lit(0.0), F.col("along") - half), F.least(F.col("length"), F.col("along") + half)
    z0, z1 = F.greatest(F.lit(0.0), F.col("sill")), F.least(F.lit(float(wall_height)), F.col("sill") + F.col("height"))
    cut = F.struct(u0.alias("u0"), u1.alias("u1"), z0.alias("z0"), z1.alias("z1"))
    hit = F.when((u0 < u1) & (z0 < z1), cut)
    return on_wall.groupBy("plan_id", "wall_index").agg(F.count("*").alias("n_cuts"), F.sort_array(F.collect_list(hit)).alias("holes"))


def wall_difference(walls: DataFrame, on_wall: DataFrame, wall_height: float = DEFAULT.wall_height, cfg: Config = DEFAULT) -> DataFrame:
    """(plan_id, wall_index, name, n_cuts, height, face_area, volume, vertices, faces) of solid walls less their openings.

    Openings may overlap each other, lean out of their wall or cover all of it; a wall of which nothing is left keeps
    its row, without vertices. An uncut wall is a box of eight vertices; the surface of any other is closed too, of
    squares with four vertices of their own. A wall's holes are one array, so walls meet their openings in one join by
    plan and wall; the sweep runs over whole batches of walls. It is called nondeterministic so as to be done once.
    """
    top = float(wall_height)

    @F.arrow_udf(f"struct<face_area:double,vertices:{POINTS},faces:array<array<int>>>")
    def mesh(sx: pa.Array, sy: pa.Array, ex: pa.Array, ey: pa.Array, thickness: pa.Array, dx: pa.Array, dy: pa.Array, length: pa.Array, n_cuts: pa.Array, holes: pa.Array) -> pa.Array:
        return cut_meshes(sx, sy, ex, ey, thickness, dx, dy, length, n_cuts, holes, top)

    w = solid_walls(walls, cfg).join(holes(on_wall, wall_height), ["plan_id", "wall_index"], "left")
    w = w.withColumns({"n_cuts": F.coalesce("n_cuts", F.lit(0)), "holes": F.coalesce("holes", F.array().cast(f"array<{RECTANGLE}>"))})
    w = w.withColumn("mesh", mesh.asNondeterministic()("sx", "sy", "ex", "ey", "thickness", *direction(*map(F.col, ("sx", "sy", "ex", "ey")), cfg.degenerate), "n_cuts", "holes"))
    name = F.concat(F.lit("Wall_"), F.col("wall_index"))
    return w.select("plan_id", "wall_index", name.alias("name"), "n_cuts", F.lit(top).alias("height"), "mesh.face_area", (F.col("mesh.face_area") * F.col("thickness")).alias("volume"), "mesh.vertices", "mesh.faces")


def mesh_volume(vertices: Column, faces: Column) -> Column:
    """Volume inside a closed surface of faces seen against the clock from outside; what isn't closed has none that means anything."""

    @F.arrow_udf("double")
    def volume(vertices: pa.Array, faces: pa.Array) -> pa.Array:
        return mesh_numbers(vertices, faces, skin=False)

    return volume(vertices, faces)


def mesh_area(vertices: Column, faces: Column) -> Column:
    """Area of flat faces, concave ones included."""

    @F.arrow_udf("double")
    def area(vertices: pa.Array, faces: pa.Array) -> pa.Array:
        return mesh_numbers(vertices, faces, skin=True)

    return area(vertices, faces)
