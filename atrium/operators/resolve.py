"""Openings to walls, and wall ends to each other."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import length_sql, round3
from ..model import DEFAULT, Config
from .detect import Here, opening, segment
from .nearest import nearest
from .snapping import snap_lists


def nearest_in_row(x: Column, y: Column, ord: Column, walls: Column, earlier_only: bool = True) -> Column:
    """array<struct<i,d>>: index and distance of the nearest wall of each of a row's openings; null without one.

    walls: structs with ord, wall_index, sx, sy, ex and ey. Called nondeterministic so that it is computed once.
    """

    @F.arrow_udf("array<struct<i:long,d:double>>")
    def best(x: pa.Array, y: pa.Array, ord: pa.Array, at: pa.Array, i: pa.Array, sx: pa.Array, sy: pa.Array, ex: pa.Array, ey: pa.Array) -> pa.Array:
        return nearest(x, y, ord, at, i, sx, sy, ex, ey, earlier_only)

    return best.asNondeterministic()(x, y, ord, *[walls[k] for k in ("ord", "wall_index", "sx", "sy", "ex", "ey")])


def nearest_wall(openings: DataFrame, walls: DataFrame, earlier_only: bool = True) -> DataFrame:
    """openings with wall_index and wall_distance of the nearest wall; ties to the lowest index, 0 (and null) without one.

    earlier_only: among walls of a lower ord, as when both come from one ordered list. One shuffle by plan on each side:
    a plan's walls are one array beside its openings, so no pair is a row. A null plan is a plan of its own.
    """
    rest = [c for c in openings.columns if c != "plan_id"]
    o = openings.groupBy("plan_id").agg(F.collect_list(F.struct(*rest)).alias("__openings"))
    w = walls.groupBy("plan_id").agg(F.collect_list(F.struct("ord", "wall_index", "sx", "sy", "ex", "ey")).alias("__walls")).withColumnRenamed("plan_id", "__plan")
    got = o.join(w, o["plan_id"].eqNullSafe(w["__plan"]), "left")
    got = got.withColumn("__best", nearest_in_row(F.col("__openings.x"), F.col("__openings.y"), F.col("__openings.ord"), F.col("__walls"), earlier_only))
    got = got.select("plan_id", F.posexplode("__openings").alias("__k", "__o"), "__best")
    kind = walls.schema["wall_index"].dataType
    cols = [F.col("plan_id") if c == "plan_id" else F.col(f"__o.{c}").alias(c) for c in openings.columns]
    return got.select(*cols, F.coalesce(F.get("__best.i", F.col("__k")), F.lit(0)).cast(kind).alias("wall_index"), F.get("__best.d", F.col("__k")).alias("wall_distance"))


def pair_places(n: Column) -> Column:
    """Places of both ends of all pairs of walls i < j, in order (i, j, end of i, end of j); wall i has ends 2i and 2i + 1."""
    ends = lambda i, j: F.array(*[F.struct((i * 2 + a).alias("p"), (j * 2 + b).alias("q")) for a in (0, 1) for b in (0, 1)])
    rest = lambda i: F.flatten(F.transform(F.sequence(i + 1, n - 1), lambda j: ends(i, j)))
    return F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), rest))).otherwise(F.array().cast("array<struct<p:int,q:int>>"))


def snapped(w: Column, cfg: Config = DEFAULT, most_folded: int = 0) -> Column:
    """Ends of a plan's walls, an array of structs with sx, sy, ex and ey in order, moved together: four numbers a wall.

    Pair after pair, ends nearer than the threshold, but apart, both go to their rounded middle, and later pairs see
    that. Plans are walked in a Python worker that looks only at pairs that come close (snap_points); those of up to
    most_folded walls are folded over all pairs in the JVM instead, which takes longer for each pair. Both take the same steps in the same order, with Python's rounding, so
    the number decides nothing but the time.
    """
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    pts = F.flatten(F.transform(w, lambda e: F.array(point(e["sx"], e["sy"]), point(e["ex"], e["ey"]))))

    def move(s: Column, k: Column) -> Column:
        a, b = F.get(s, k["p"]), F.get(s, k["q"])
        dx, dy = a["x"] - b["x"], a["y"] - b["y"]
        d = F.sqrt(dx * dx + dy * dy)
        mid = point(round3((a["x"] + b["x"]) / 2.0), round3((a["y"] + b["y"]) / 2.0))
        return F.when((d > 0) & (d < cfg.snap_threshold), F.transform(s, lambda e, i: F.when((i == k["p"]) | (i == k["q"]), mid).otherwise(e))).otherwise(s)

    @F.arrow_udf("array<double>")
    def walked(ends: pa.Array) -> pa.Array:
        return snap_lists(ends, cfg.snap_threshold)

    large = F.size(w) > most_folded
    if not most_folded:
        return walked.asNondeterministic()(F.flatten(F.transform(w, lambda e: F.array(e["sx"], e["sy"], e["ex"], e["ey"]))))
    folded = F.flatten(F.transform(F.aggregate(pair_places(F.size(w)), pts, move), lambda p: F.array(p["x"], p["y"])))
    ends = F.flatten(F.transform(w, lambda e: F.array(e["sx"], e["sy"], e["ex"], e["ey"])))
    return F.when(large, walked(F.when(large, ends))).otherwise(folded)


def snap_ends(walls: DataFrame, cfg: Config = DEFAULT, most_folded: int = 0) -> DataFrame:
    """Walls with close ends moved together, see snapped(). One shuffle by plan; a plan's walls are one array."""
    rest = [c for c in walls.columns if c not in ("plan_id", "sx", "sy", "ex", "ey")]
    by_plan = walls.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("wall_index", *[c for c in rest if c != "wall_index"], "sx", "sy", "ex", "ey"))).alias("w"))
    out = by_plan.withColumn("pts", snapped(F.col("w"), cfg, most_folded)).select("plan_id", F.posexplode("w").alias("i", "w"), "pts")
    cols = {"plan_id": F.col("plan_id"), **{c: F.get("pts", F.col("i") * 4 + k) for k, c in enumerate(("sx", "sy", "ex", "ey"))}}
    return out.select(*[cols.get(c, F.col(f"w.{c}")).alias(c) for c in walls.columns])


def detected_plans(boxes: DataFrame, cfg: Config = DEFAULT, snap: bool = True) -> DataFrame:
    """(plan_id, walls, openings, boxes): a detected plan in a row, from boxes in metres. One shuffle by plan and one pass.

    walls: ord, wall_index, sx, sy, ex, ey, thickness, confidence, in order; openings: ord, kind, x, y, width,
    confidence, wall_index, wall_distance, tied to the nearest wall of a lower ord as it stood before snapping (0 and
    null without one). boxes holds all boxes in order. Same rows as wall_segments(), nearest_wall() and snap_ends().
    """
    names = ["ord", "cls_id", "conf", "x1", "y1", "x2", "y2"]
    # Made before the boxes are grouped: row by row it is compiled code, within arrays it isn't.
    made = lambda kind: F.struct(*[v.alias(k) for k, v in kind(Here(), cfg).items()])
    wall, o = F.when(F.col("cls_id") == 0, made(segment)), F.when(F.col("cls_id").isin(1, 2), made(opening))
    d = boxes.select("plan_id", F.struct(*names, wall.alias("w"), o.alias("o")).alias("b")).groupBy("plan_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    field = lambda b, part, kind: [b[part][k].alias(k) for k in kind(Here(), cfg)]
    d = d.withColumn("walls", F.transform(F.filter("b", lambda b: b["cls_id"] == 0), lambda b, i: F.struct(b["ord"].alias("ord"), i.alias("wall_index"), *field(b, "w", segment))))
    d = d.withColumn("o", F.transform(F.filter("b", lambda b: b["cls_id"].isin(1, 2)), lambda b: F.struct(b["ord"].alias("ord"), *field(b, "o", opening))))
    d = d.withColumn("best", nearest_in_row(F.col("o.x"), F.col("o.y"), F.col("o.ord"), F.col("walls")))
    best = lambda i, k: F.get("best", i)[k]
    tied = F.transform("o", lambda o, i: F.struct(o["ord"].alias("ord"), *[o[k].alias(k) for k in opening(Here(), cfg)], F.coalesce(best(i, "i"), F.lit(0)).cast("int").alias("wall_index"), best(i, "d").alias("wall_distance")))
    d = d.withColumn("openings", tied).withColumn("boxes", F.transform("b", lambda b: b.dropFields("w", "o")))
    if snap:
        moved = F.transform("walls", lambda w, i: w.withField("sx", F.get("pts", i * 4)).withField("sy", F.get("pts", i * 4 + 1)).withField("ex", F.get("pts", i * 4 + 2)).withField("ey", F.get("pts", i * 4 + 3)))
        d = d.withColumn("pts", snapped(F.col("walls"), cfg)).withColumn("walls", moved)
    return d.select("plan_id", "walls", "openings", "boxes")


def long_enough(walls: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Walls of the least length or more; indexes stay as they are."""
    return walls.where(F.expr(length_sql()) >= cfg.min_wall_length)


def with_resolved_index(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """openings with wall_index_resolved: the place of their wall among those that are left, null if it went."""
    from pyspark.sql import Window

    left = walls.select("plan_id", "wall_index", (F.row_number().over(Window.partitionBy("plan_id").orderBy("wall_index")) - 1).alias("wall_index_resolved"))
    return openings.join(left, ["plan_id", "wall_index"], "left")
