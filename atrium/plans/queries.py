"""Queries over the driver's tables and their DuckDB SQL. Boxes come from lineitem by one derivation in both engines."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import direction, length_sql, perpendicular, polygon_area, segment_distance_sql, vertex_mean
from ..functions.text import PROMPTS, fenced_json, label_text, prompt, status_icon, suffix
from ..model import CLASSES, MATERIALS, Config
from ..operators import dataset, detect, resolve, scene
from ..operators.ranks import global_rank
from ..sources import files, plans
from ..sources.svg import scan_svg, svg_class

CFG = Config(snap_threshold=0.35)  # wide enough that many of these plans snap

#: About 40 rows to a plan at any size.
BOXES = """select l_orderkey % m as plan_id,
 row_number() over (partition by l_orderkey % m order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as ord,
 cast((l_partkey + l_linenumber) % 4 as int) as cls_id,
 1e0 - cast(l_discount as double) * 6e0 as conf,
 cast(l_suppkey * 7 % 300 as double) as x1, cast(l_partkey % 250 as double) as y1,
 cast(l_suppkey * 7 % 300 + 5 + l_partkey % 90 as double) as x2, cast(l_partkey % 250 + 5 + l_suppkey % 70 as double) as y2
 from lineitem cross join (select greatest(cast(floor(count(*) / 4e1) as bigint), 1) as m from lineitem) k"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BOXES, with what follows from a row's own columns made after its place is known, so that only those are shuffled and sorted."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    m = lineitem.agg(F.greatest(F.floor(F.count("*") / 40.0), F.lit(1)).alias("m"))
    rows = lineitem.select(*keys, "l_discount").crossJoin(F.broadcast(m)).withColumn("plan_id", F.col("l_orderkey") % F.col("m"))
    placed = rows.withColumn("ord", F.row_number().over(Window.partitionBy("plan_id").orderBy(*keys)) - 1)
    x, y = F.col("l_suppkey") * 7 % 300, F.col("l_partkey") % 250
    corners = {"x1": x, "y1": y, "x2": x + 5 + F.col("l_partkey") % 90, "y2": y + 5 + F.col("l_suppkey") % 70}
    cls_id, conf = (F.col("l_partkey") + F.col("l_linenumber")) % 4, F.lit(1.0) - F.col("l_discount").cast("double") * 6.0
    return placed.select("plan_id", "ord", cls_id.cast("int").alias("cls_id"), conf.alias("conf"), *[v.cast("double").alias(k) for k, v in corners.items()])


def metres(spark, sf_dir) -> DataFrame:
    return detect.to_metres(detect.confident(boxes(spark, sf_dir), CFG), CFG)


def found_walls(spark, sf_dir) -> DataFrame:
    return detect.wall_segments(metres(spark, sf_dir), CFG)


def found_openings(spark, sf_dir) -> DataFrame:
    return detect.opening_boxes(metres(spark, sf_dir), None, CFG)


def mm(c: Column) -> Column:
    """Thousandths, as a whole number."""
    return F.floor(c * 1000.0 + 0.5).cast("long")


def mm_sql(e: str) -> str:
    return f"cast(floor(({e}) * 1e3 + 5e-1) as bigint)"


def R(e: str) -> str:
    """Three decimals of the exact binary value, as printf does."""
    return f"cast(printf('%.3f', {e}) as double)"


WITH = f"""with b as ({BOXES}), f as (select * from b where conf >= 5e-1),
m as (select plan_id, ord, cls_id, conf, x1 / 5e1 as x1, y1 / 5e1 as y1, x2 / 5e1 as x2, y2 / 5e1 as y2 from f),
w as (select plan_id, ord, cast(row_number() over (partition by plan_id order by ord) - 1 as int) as wall_index,
 {R("case when x2 - x1 > y2 - y1 then x1 else (x1 + x2) / 2e0 end")} as sx, {R("case when x2 - x1 > y2 - y1 then (y1 + y2) / 2e0 else y1 end")} as sy,
 {R("case when x2 - x1 > y2 - y1 then x2 else (x1 + x2) / 2e0 end")} as ex, {R("case when x2 - x1 > y2 - y1 then (y1 + y2) / 2e0 else y2 end")} as ey,
 15e-2 as thickness, {R("conf")} as confidence from m where cls_id = 0),
o as (select plan_id, ord, case cls_id when 1 then 'door' else 'window' end as kind, (x1 + x2) / 2e0 as x, (y1 + y2) / 2e0 as y,
 greatest(least(x2 - x1, y2 - y1), case cls_id when 1 then 7e-1 else 5e-1 end) as width, {R("conf")} as confidence from m where cls_id in (1, 2))
"""  # noqa: S608


def near_sql(earlier: bool) -> str:
    return f"""j as (select o.plan_id, o.ord, o.kind, o.x, o.y, o.width, w.wall_index as wi, case when w.wall_index is null then null else {segment_distance_sql("o.x", "o.y", "w.sx", "w.sy", "w.ex", "w.ey")} end as d from o left join w on w.plan_id = o.plan_id {"and w.ord < o.ord" if earlier else ""}),
n as (select * from (select *, row_number() over (partition by plan_id, ord order by d nulls last, wi) as rn from j) where rn = 1)"""


NEAR = near_sql(True)
#: Openings on their walls, with defaults for what boxes don't say.
ON = f"""{NEAR}, ow as (select n.plan_id, n.kind, n.ord, n.width, n.x as px, n.y as py, w.wall_index, w.sx, w.sy, w.thickness, {length_sql("w.sx", "w.sy", "w.ex", "w.ey")} as len, w.ex, w.ey,
 case n.kind when 'door' then 21e-1 else 12e-1 end as height, case n.kind when 'door' then 0e0 else 9e-1 end as sill from n join w on w.plan_id = n.plan_id and w.wall_index = coalesce(n.wi, 0)),
c as (select *, (ex - sx) / len as dx, (ey - sy) / len as dy from ow where len >= 1e-6), a as (select *, (px - sx) * dx + (py - sy) * dy as along from c)"""


def walls_out(w: DataFrame) -> DataFrame:
    return w.select("plan_id", "wall_index", *[mm(F.col(c)).alias(f"{c}_mm") for c in ("sx", "sy", "ex", "ey")])


WALLS_OUT = "plan_id, wall_index, " + ", ".join(f"{mm_sql(c)} as {c}_mm" for c in ("sx", "sy", "ex", "ey"))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(WITH + "select plan_id, ord, " + ", ".join(f"{mm_sql(c)} as {c}_mm" for c in ("x1", "y1", "x2", "y2")) + " from m")
def p1_pixels_to_metres(spark, sf_dir):
    return metres(spark, sf_dir).select("plan_id", "ord", *[mm(F.col(c)).alias(f"{c}_mm") for c in ("x1", "y1", "x2", "y2")])


@query(f"with b as ({BOXES}) select plan_id, ord, case cls_id + cast(ord % 2 as int) when 0 then 'wall' when 1 then 'door' when 2 then 'window' when 3 then 'room' else 'unknown' end as class from b")
def p2_class_decode(spark, sf_dir):
    return boxes(spark, sf_dir).select("plan_id", "ord", detect.class_name(F.col("cls_id") + F.col("ord") % 2).alias("class"))


@query(WITH + f"select {WALLS_OUT}, {mm_sql('confidence')} as confidence_mm from w")
def p3_wall_segments(spark, sf_dir):
    return found_walls(spark, sf_dir).select("plan_id", "wall_index", *[mm(F.col(c)).alias(f"{c}_mm") for c in ("sx", "sy", "ex", "ey", "confidence")])


def opening_query(kind):
    def f(spark, sf_dir):
        return detect.opening_boxes(metres(spark, sf_dir), kind, CFG).select("plan_id", "ord", *[mm(F.col(c)).alias(f"{c}_mm") for c in ("x", "y", "width", "confidence")])

    return f


for _name, _kind in (("p4_doors", "door"), ("p5_windows", "window")):
    QUERIES[_name] = opening_query(_kind)
    ORACLE_SQL[_name] = WITH + "select plan_id, ord, " + ", ".join(f"{mm_sql(c)} as {c}_mm" for c in ("x", "y", "width", "confidence")) + f" from o where kind = '{_kind}'"


@query(f"with b as ({BOXES}) select plan_id, ord, cls_id from b where conf >= 5e-1")
def f1_confidence(spark, sf_dir):
    return detect.confident(boxes(spark, sf_dir), CFG).select("plan_id", "ord", "cls_id")


@query(f"with b as ({BOXES}) select plan_id, count(*) filter (cls_id = 3) as n_rooms, count(*) filter (cls_id <> 3) as n_other from b group by plan_id")
def f2_class_routing(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("plan_id").agg(F.count_if(F.col("cls_id") == 3).alias("n_rooms"), F.count_if(F.col("cls_id") != 3).alias("n_other"))


@query(WITH + f", {near_sql(True)} select plan_id, ord, kind, coalesce(wi, 0) as wall_index, coalesce({mm_sql('d')}, -1) as distance_mm from n")
def j1_prefix_nearest_wall(spark, sf_dir):
    got = resolve.nearest_wall(found_openings(spark, sf_dir), found_walls(spark, sf_dir))
    return got.select("plan_id", "ord", "kind", "wall_index", F.coalesce(mm(F.col("wall_distance")), F.lit(-1)).alias("distance_mm"))


@query(WITH + f", {near_sql(False)} select plan_id, ord, kind, coalesce(wi, 0) as wall_index, coalesce({mm_sql('d')}, -1) as distance_mm from n")
def j1b_nearest_wall(spark, sf_dir):
    got = resolve.nearest_wall(found_openings(spark, sf_dir), found_walls(spark, sf_dir), earlier_only=False)
    return got.select("plan_id", "ord", "kind", "wall_index", F.coalesce(mm(F.col("wall_distance")), F.lit(-1)).alias("distance_mm"))


SNAP = """, e as (select plan_id, count(*) as n, list(sx order by wall_index) as lsx, list(sy order by wall_index) as lsy, list(ex order by wall_index) as lex, list(ey order by wall_index) as ley from w group by plan_id),
s0 as (select plan_id, n, list_transform(range(2 * n), lambda k: case when k % 2 = 0 then lsx[k // 2 + 1] else lex[k // 2 + 1] end) as xs, list_transform(range(2 * n), lambda k: case when k % 2 = 0 then lsy[k // 2 + 1] else ley[k // 2 + 1] end) as ys from e),
ns as (select distinct n from e),
pairs as (select n, row_number() over (partition by n order by i, j, a, b) as k, 2 * i + a + 1 as p, 2 * j + b + 1 as q from ns, (select unnest(range((select max(n) from ns))) as i), (select unnest(range((select max(n) from ns))) as j), (select unnest([0, 1]) as a), (select unnest([0, 1]) as b) where i < j and j < n),
st as (select plan_id, n, cast(0 as bigint) as k, xs, ys from s0 union all
 select plan_id, n, k + 1, case when hit then list_transform(xs, lambda v, i: case when i = p or i = q then mx else v end) else xs end, case when hit then list_transform(ys, lambda v, i: case when i = p or i = q then my else v end) else ys end
 from (select st.*, p, q, sqrt((xs[p] - xs[q]) * (xs[p] - xs[q]) + (ys[p] - ys[q]) * (ys[p] - ys[q])) > 0 and sqrt((xs[p] - xs[q]) * (xs[p] - xs[q]) + (ys[p] - ys[q]) * (ys[p] - ys[q])) < 35e-2 as hit,
  cast(printf('%.3f', (xs[p] + xs[q]) / 2e0) as double) as mx, cast(printf('%.3f', (ys[p] + ys[q]) / 2e0) as double) as my from st join pairs on pairs.n = st.n and pairs.k = st.k + 1)),
done as (select * from st where k = 2 * n * (n - 1)),
sw as (select w.plan_id, w.wall_index, xs[2 * w.wall_index + 1] as sx, ys[2 * w.wall_index + 1] as sy, xs[2 * w.wall_index + 2] as ex, ys[2 * w.wall_index + 2] as ey from w join done on w.plan_id = done.plan_id)
"""
RECURSIVE = WITH.replace("with b as", "with recursive b as", 1)


@query(RECURSIVE + SNAP + f"select {WALLS_OUT} from sw")
def a1_snap_endpoints(spark, sf_dir):
    return walls_out(resolve.snap_ends(found_walls(spark, sf_dir), CFG))


@query(RECURSIVE + SNAP + f"select {WALLS_OUT} from sw where {length_sql()} >= 3e-1")
def f7_wall_length(spark, sf_dir):
    return walls_out(resolve.long_enough(resolve.snap_ends(found_walls(spark, sf_dir), CFG), CFG))


def room_columns(m: DataFrame, *others: str | Column) -> DataFrame:
    """Boxes in metres with the place and the rectangle that they have as rooms, and the other columns."""
    pt = lambda x, y: F.array(F.col(x), F.col(y))
    return m.select(*others, F.col("ord").alias("room_index"), F.array(pt("x1", "y1"), pt("x2", "y1"), pt("x2", "y2"), pt("x1", "y2")).alias("polygon"))


def room_polygons(spark, sf_dir) -> DataFrame:
    """Rectangles of room boxes, as open rings."""
    m = metres(spark, sf_dir).where("cls_id = 3")
    return room_columns(m, "plan_id", F.concat(F.lit("room_"), F.col("ord")).alias("label"), F.lit(None).cast("double").alias("area")).select("plan_id", "room_index", "label", "polygon", "area")


@query(WITH + f"select plan_id, ord as room_index, {mm_sql('(x2 - x1) * (y2 - y1) + 1e-9')} as area_mm from m where cls_id = 3")
def a2_polygon_area(spark, sf_dir):
    return room_polygons(spark, sf_dir).select("plan_id", "room_index", mm(polygon_area(F.col("polygon")) + 1e-9).alias("area_mm"))


@query(WITH + f"select plan_id, ord as room_index, {mm_sql('(x1 + x2) / 2e0 + 1e-9')} as x_mm, {mm_sql('(y1 + y2) / 2e0 + 1e-9')} as y_mm from m where cls_id = 3")
def a3_vertex_mean(spark, sf_dir):
    x, y = vertex_mean(F.col("polygon"))
    return room_polygons(spark, sf_dir).select("plan_id", "room_index", mm(x + 1e-9).alias("x_mm"), mm(y + 1e-9).alias("y_mm"))


@query(WITH + "select plan_id, ord as room_index from m where cls_id = 3 and (x2 - x1) * (y2 - y1) >= 1.00005e0")
def f5_room_area(spark, sf_dir):
    return room_polygons(spark, sf_dir).where(polygon_area(F.col("polygon")) >= 1.00005).select("plan_id", "room_index")


@query("select p_partkey from part where (p_partkey % 4) * 5e-1 * (p_size % 4) * 5e-1 >= 1e0")
def f5_room_area_edge(spark, sf_dir):
    """Rooms of up to one and a half square metres a side; one of exactly the least area stays."""
    pt = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    w, h, o = F.col("p_partkey") % 4 * 0.5, F.col("p_size") % 4 * 0.5, F.lit(0.0)
    rooms = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array(pt(o, o), pt(w, o), pt(w, h), pt(o, h)).alias("polygon"))
    return rooms.where(polygon_area(F.col("polygon")) >= CFG.min_room_area).select("p_partkey")


@query(WITH + f", d as (select *, {length_sql()} as len from w), u as (select *, (ex - sx) / len as dx, (ey - sy) / len as dy from d where len >= 1e-6), z as (select unnest([0e0, 27e-1]) as z), k as (select unnest([0, 1, 2, 3]) as k)" + f" select plan_id, wall_index, cast(k + case when z > 0 then 4 else 0 end as int) as vertex, {mm_sql('case when k < 2 then sx else ex end + (-dy) * (thickness / 2e0) * (case when k in (0, 3) then -1e0 else 1e0 end) + 1e-7')} as x_mm, {mm_sql('case when k < 2 then sy else ey end + dx * (thickness / 2e0) * (case when k in (0, 3) then -1e0 else 1e0 end) + 1e-7')} as y_mm, {mm_sql('z')} as z_mm from u, z, k")
def p12_wall_prism(spark, sf_dir):
    v = scene.wall_prisms(found_walls(spark, sf_dir)).select("plan_id", "wall_index", F.posexplode("vertices").alias("vertex", "v"))
    return v.select("plan_id", "wall_index", "vertex", mm(F.col("v.x") + 1e-7).alias("x_mm"), mm(F.col("v.y") + 1e-7).alias("y_mm"), mm(F.col("v.z")).alias("z_mm"))


def placed(spark, sf_dir) -> DataFrame:
    """Openings of the detection path in the form of documents'."""
    got = resolve.nearest_wall(found_openings(spark, sf_dir), found_walls(spark, sf_dir))
    door = F.col("kind") == "door"
    return got.select("plan_id", "kind", F.col("ord").alias("opening_index"), F.col("x").alias("px"), F.col("y").alias("py"), F.lit(None).cast("double").alias("along"), F.lit(False).alias("bad_position"), "width", F.when(door, 2.1).otherwise(1.2).alias("height"), F.when(door, 0.0).otherwise(0.9).alias("sill"), "wall_index")


@query(WITH + f", {ON} select plan_id, kind, ord as opening_index, wall_index, {mm_sql('along + 1e-7')} as along_mm from a")
def j2_opening_wall(spark, sf_dir):
    got = scene.opening_on_wall(placed(spark, sf_dir), found_walls(spark, sf_dir))
    return got.select("plan_id", "kind", "opening_index", "wall_index", mm(F.col("along") + 1e-7).alias("along_mm"))


def cutter_query(kind):
    def f(spark, sf_dir):
        on = scene.opening_on_wall(placed(spark, sf_dir).where(F.col("kind") == kind), found_walls(spark, sf_dir))
        return scene.cutters(on).select("plan_id", "opening_index", "name", *[mm(F.col(c) + 1e-7).alias(f"{c}_mm") for c in ("cx", "cy", "cz", "hx", "hy", "hz")], mm(F.col("rotation") + 1e-7).alias("rotation_mrad"))

    return f


for _name, _kind in (("p13_door_cutter", "door"), ("p14_window_cutter", "window")):
    QUERIES[_name] = cutter_query(_kind)
    ORACLE_SQL[_name] = WITH + f", {ON} select plan_id, ord as opening_index, '{_kind.title()}Cutter_' || ord as name, " + ", ".join(f"{mm_sql(e + ' + 1e-7')} as {n}_mm" for n, e in (("cx", "sx + dx * along"), ("cy", "sy + dy * along"), ("cz", "sill + height / 2e0"), ("hx", "width / 2e0"), ("hy", "thickness * 15e-1"), ("hz", "height / 2e0"))) + f", {mm_sql('atan2(dy, dx) + 1e-7')} as rotation_mrad from a where kind = '{_kind}'"


@query(WITH + f", {ON} select plan_id, kind, count(*) as n_cut from a group by plan_id, kind")
def j3_cutter_wall(spark, sf_dir):
    w = found_walls(spark, sf_dir)
    cut = scene.cut_walls(scene.cutters(scene.opening_on_wall(placed(spark, sf_dir), w)), scene.wall_prisms(w))
    return cut.where("cut").groupBy("plan_id", "kind").agg(F.count("*").alias("n_cut"))


def slab_query(kind):
    def f(spark, sf_dir):
        s = scene.slabs(room_polygons(spark, sf_dir), kind).select("plan_id", "room_index", F.posexplode(F.get("faces", F.lit(0))).alias("place", "i"), "vertices")
        v = F.get("vertices", F.col("i"))
        return s.select("plan_id", "room_index", "place", mm(v["x"]).alias("x_mm"), mm(v["y"]).alias("y_mm"), mm(v["z"]).alias("z_mm"))

    return f


for _name, _kind, _order, _z in (("p15_floor_polygon", "floor", "k", "0"), ("p16_ceiling_polygon", "ceiling", "3 - k", "2700")):
    QUERIES[_name] = slab_query(_kind)
    ORACLE_SQL[_name] = WITH + f", k as (select unnest([0, 1, 2, 3]) as k) select plan_id, ord as room_index, cast({_order} as int) as place, {mm_sql('case when k in (0, 3) then x1 else x2 end')} as x_mm, {mm_sql('case when k < 2 then y1 else y2 end')} as y_mm, cast({_z} as bigint) as z_mm from m, k where cls_id = 3"


@query("select p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') as label from part")
def p17_label_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", label_text(F.translate("p_name", " ", "_")).alias("label"))


def objects(spark, sf_dir) -> DataFrame:
    """Walls and rooms as objects with a type; walls of odd index have a height of their own."""
    w = found_walls(spark, sf_dir).select("plan_id", F.col("wall_index").cast("long").alias("i"), F.lit("wall").alias("type"), F.when(F.col("wall_index") % 2 == 1, 3.0).alias("height"))
    r = room_polygons(spark, sf_dir)
    flat = [r.select("plan_id", F.col("room_index").cast("long").alias("i"), F.lit(t).alias("type"), F.lit(None).cast("double").alias("height")) for t in ("floor", "label")]
    return w.unionByName(flat[0]).unionByName(flat[1])


OBJECTS = ", ob as (select plan_id, cast(wall_index as bigint) as i, 'wall' as type, case when wall_index % 2 = 1 then 3e0 end as height from w union all select plan_id, ord, t, null from m, (select unnest(['floor', 'label']) as t) where cls_id = 3)"


@query(WITH + OBJECTS + f" select plan_id, i, type, {mm_sql('case when type = ' + chr(39) + 'wall' + chr(39) + ' then 32e-1 / coalesce(height, 27e-1) else 1e0 end')} as scale_mm from ob")
def p18_adjust_height(spark, sf_dir):
    return scene.adjust_height(objects(spark, sf_dir), 3.2).select("plan_id", "i", "type", mm(F.col("scale_z")).alias("scale_mm"))


@query(WITH + OBJECTS + " select plan_id, i, type, case type when 'wall' then 'Wall' when 'floor' then 'Floor' end as material, " + ", ".join(f"cast(case type when 'wall' then {round(MATERIALS['wall'][k] * 1000)} when 'floor' then {round(MATERIALS['floor'][k] * 1000)} end as bigint) as {c}_mm" for k, c in enumerate("rgb")) + " from ob")
def p19_materials(spark, sf_dir):
    return scene.with_materials(objects(spark, sf_dir)).select("plan_id", "i", "type", "material", *[mm(F.col(c)).alias(f"{c}_mm") for c in "rgb"])


@query(WITH + f", {ON}, q as (select plan_id, 'wall' as kind from w where {length_sql()} >= 1e-6 union all select plan_id, kind from a union all select plan_id, t from m, (select unnest(['floor', 'label']) as t) where cls_id = 3), g as (select plan_id, " + ", ".join(f"count(*) filter (kind = '{k}') as {k}s" for k in ("wall", "door", "window", "floor", "ceiling", "label")) + " from q group by plan_id) select *, concat_ws(', ', " + ", ".join(f"case when {k}s > 0 then {k}s || ' {k}s' end" for k in ("wall", "door", "window", "floor", "ceiling", "label")) + ") as summary from g")
def a5_scene_counts(spark, sf_dir):
    """Documents of the detected plans, in a row each, counted within the row."""
    d = resolve.detected_plans(metres(spark, sf_dir), CFG, snap=False)
    walls = F.transform("walls", lambda w: F.struct(F.array(w["sx"], w["sy"]).alias("start"), F.array(w["ex"], w["ey"]).alias("end")))
    null = F.lit(None).cast("variant")
    part = lambda k: F.transform(F.filter("openings", lambda o: o["kind"] == k), lambda o: F.struct(null.alias("position"), o["wall_index"].alias("wall_index")))
    rooms = F.transform(room_rings(F.col("boxes")), lambda p: F.struct(F.lit(None).cast("string").alias("label"), p.alias("polygon")))
    documents = d.select("plan_id", walls.alias("walls"), part("door").alias("doors"), part("window").alias("windows"), rooms.alias("rooms"))
    return scene.scene_counts(documents, cfg=CFG)


@query(WITH + OBJECTS + " select plan_id, count(*) filter (type = 'wall') as n_adjusted from ob group by plan_id")
def a6_adjusted_count(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("plan_id").agg(F.count_if(F.col("type") == "wall").alias("n_adjusted"))


YOLO = "(x1 + x2) / 2e0 / 32e1 as cx, (y1 + y2) / 2e0 / 24e1 as cy, (x2 - x1) / 32e1 as w, (y2 - y1) / 24e1 as h"


@query(f"with b as ({BOXES}), s as (select plan_id, ord, {YOLO} from b), u as (select plan_id, ord, " + ", ".join(f"greatest(0e0, least(1e0, {c})) as {c}" for c in ("cx", "cy", "w", "h")) + " from s) select plan_id, ord, " + ", ".join(f"cast(floor({c} * 1e6 + 5e-1) as bigint) as {c}_ppm" for c in ("cx", "cy", "w", "h")) + " from u where w > 1e-3 and h > 1e-3")
def p21_yolo_labels(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumnsRenamed({"x1": "x0", "y1": "y0"}).withColumnsRenamed({"x2": "x1", "y2": "y1"})
    return dataset.yolo_labels(b, F.lit(320.0), F.lit(240.0)).select("plan_id", "ord", *[F.floor(F.col(c) * 1000000.0 + 0.5).cast("long").alias(f"{c}_ppm") for c in ("cx", "cy", "w", "h")])


@query("select event_id, case when lower(g) like '%wall%' then 0 when lower(g) like '%door%' then 1 when lower(g) like '%window%' then 2 when lower(g) like '%room%' then 3 end as cls_id from (select event_id, event_type || case event_id % 5 when 0 then 'DoorWall' when 1 then 'Bedroom' when 2 then 'WINDOW' when 3 then 'door' else '' end as g from events)")
def p22_class_map(spark, sf_dir):
    tail = F.get(F.array(*[F.lit(x) for x in ("DoorWall", "Bedroom", "WINDOW", "door", "")]), (F.col("event_id") % 5).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", svg_class(F.concat("event_type", tail)).alias("cls_id"))


@query("select event_id, case event_id % 3 when 2 then null else props end is not null as found, case event_id % 3 when 2 then null else try_cast(json_extract_string(props, '$.v') as double) end as v from events")
def p25_fenced_json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("So:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("```\n{broken\n```\n```\n"), "props", F.lit("\n```")))
    j = fenced_json(text)
    return e.select("event_id", j.isNotNull().alias("found"), F.try_variant_get(j, "$.v", "double").alias("v"))


@query("select event_id, case when s in ('', 'Ready') then null when s like 'Error%' then 'ERROR' when s like 'Done%' or s like 'Sample%' then 'CHECKMARK' else 'INFO' end as icon from (select event_id, case event_id % 6 when 0 then '' when 1 then 'Ready' when 2 then 'Error: ' || event_type when 3 then 'Done' when 4 then 'Sample ' || event_type else event_type end as s from events)")
def p26_status_icon(spark, sf_dir):
    k = F.col("event_id") % 6
    s = F.when(k == 0, "").when(k == 1, "Ready").when(k == 2, F.concat(F.lit("Error: "), "event_type")).when(k == 3, "Done").when(k == 4, F.concat(F.lit("Sample "), "event_type")).otherwise(F.col("event_type"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", status_icon(s).alias("icon"))


@query("with r as (select p_partkey, row_number() over (order by p_partkey) - 1 as rank, count(*) over () as n from part) select p_partkey, case when rank < cast(floor(n * 5e-2) as bigint) then 'test' when rank < cast(floor(n * 5e-2) as bigint) + cast(floor(n * 15e-2) as bigint) then 'val' else 'train' end as split from r")
def o3_split(spark, sf_dir):
    ranked = global_rank(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey")
    return dataset.range_split(ranked.select("p_partkey", "rank"), "rank").select("p_partkey", "split")


@query("select page_id, len(string_split(url, '/')) as n_parts, string_split(url, '/')[3] as host from pages")
def s4_path_parts(spark, sf_dir):
    parts = dataset.path_parts(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.size(parts).cast("long").alias("n_parts"), F.get(parts, F.lit(2)).alias("host"))


FILES = "url || case page_id % 5 when 0 then '/__pycache__/x' when 1 then '/a.pyc' when 2 then '/.DS_Store' else '/a.py' end"


@query(f"select page_id from pages where not contains({FILES}, '__pycache__') and not contains({FILES}, '.pyc') and not contains({FILES}, '.pyo') and not contains({FILES}, '.DS_Store')")
def f12_exclude(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where(files.included(F.expr(FILES))).select("page_id")


@query("select page_id, case page_id % 4 when 0 then '.glb' when 1 then '.obj' when 2 then '' else '.fbx' end as suffix from pages")
def s11_export_suffix(spark, sf_dir):
    k = F.col("page_id") % 4
    name = F.concat(F.lit("/out/plan"), F.when(k == 0, ".GLB").when(k == 1, ".obj").when(k == 2, "").otherwise(".v2.FBX"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", suffix(name).alias("suffix"))


@query("select event_id, case when event_id % 3 = 0 then 'json' when event_id % 3 = 1 then 'image' end as kind from events")
def s2_source_choice(spark, sf_dir):
    k = F.col("event_id") % 3
    chosen = plans.choose_source(F.when(k == 0, "a.json"), F.when(k < 2, "a.png"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", chosen["kind"].alias("kind"))


_HEAD, _TAIL = PROMPTS["critique"]


@query(f"select event_id, md5('{_HEAD}' || chr(10) || chr(10) || '{{' || chr(10) || '  \"event_type\" : \"' || event_type || '\"' || chr(10) || '}}' || chr(10) || chr(10) || '{_TAIL}') as prompt_md5 from events")
def p24_prompts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.md5(prompt("critique", F.struct("event_type"))).alias("prompt_md5"))


def document_rows(spark, sf_dir, label: Column | None = None, polygon: Column | None = None) -> DataFrame:
    """Whole plan documents of the boxes, a JSON text each; rooms have the given label or none, and the given polygon or
    their rectangle. label and polygon are made of a room's room_index and polygon. Walls and rooms are grouped in one pass."""
    m = room_columns(metres(spark, sf_dir).where("cls_id in (0, 3)"), "plan_id", "ord", "cls_id", *[v.alias(k) for k, v in detect.segment(detect.Here(), CFG).items()])
    wall = F.struct("ord", F.array("sx", "sy").alias("start"), F.array("ex", "ey").alias("end"), "thickness")
    room = F.struct("ord", *([] if label is None else [label.alias("label")]), (F.col("polygon") if polygon is None else polygon).alias("polygon"))
    parts = {"walls": F.when(F.col("cls_id") == 0, wall), "rooms": F.when(F.col("cls_id") == 3, room)}
    d = m.groupBy("plan_id").agg(*[F.sort_array(F.collect_list(v)).alias(k) for k, v in parts.items()])
    some = [F.when(F.size(k) > 0, F.transform(k, lambda x: x.dropFields("ord"))).alias(k) for k in parts]
    return d.select("plan_id", F.to_json(F.struct(*some)).alias("doc"))


@query(WITH + ", x as (select plan_id, count(*) filter (cls_id = 0) as n_walls, count(*) filter (cls_id = 3) as n_rooms from m where cls_id in (0, 3) group by plan_id) select plan_id, n_walls, n_rooms from x")
def s1_plan_scan(spark, sf_dir):
    p = plans.parse_plans(document_rows(spark, sf_dir), "plan_id", "doc")
    return p.select("plan_id", F.coalesce(F.size("walls"), F.lit(0)).cast("long").alias("n_walls"), F.coalesce(F.size("rooms"), F.lit(0)).cast("long").alias("n_rooms"))


@query(WITH + f", x as (select plan_id, ord, row_number() over (partition by plan_id order by ord) - 1 as i, {mm_sql('(x2 - x1) * (y2 - y1) + 1e-9')} as area_mm from m where cls_id = 3) select plan_id, cast(i as int) as room_index, 'Room_' || i as label, area_mm from x")
def p23_room_label_default(spark, sf_dir):
    r = plans.rooms(plans.parse_plans(document_rows(spark, sf_dir), "plan_id", "doc"))
    return r.select("plan_id", "room_index", "label", mm(polygon_area(F.col("polygon")) + 1e-9).alias("area_mm"))


@query("select * from (values " + ", ".join(f"('{n}', {w}, {d}, {v}, {r}, {r}, {r}, '{w} walls, {d} doors, {v} windows, {r} floors, {r} ceilings, {r} labels')" for n, w, d, v, r in (("apartment", 5, 2, 2, 2), ("studio", 6, 2, 2, 3), ("three_bedroom", 9, 5, 6, 5))) + ") as t(plan_id, walls, doors, windows, floors, ceilings, labels, summary)")
def s3_sample_scenes(spark, sf_dir):
    return scene.scene_counts(plans.sample_plans(spark), with_ceiling=True)


@query(f"with b as ({BOXES}) select cast(plan_id as varchar) as name, cast(row_number() over (partition by plan_id order by ord) - 1 as int) as seq, cls_id, x1 as x0, y1 as y0, x2 as x1, y2 as y1 from b")
def s5_svg_labels(spark, sf_dir):
    """One group per box, written as SVG and scanned again."""
    b = boxes(spark, sf_dir)
    g = F.format_string('<g id="%s_%d"><rect x="%s" y="%s" width="%s" height="%s"/></g>', detect.class_name(F.col("cls_id")), F.col("ord"), F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    docs = b.select(F.col("plan_id").cast("string").alias("name"), F.struct("ord", g.alias("g")).alias("g")).groupBy("name").agg(F.array_sort(F.collect_list("g")).alias("g"))
    return scan_svg(docs.select("name", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(F.transform("g", lambda x: x["g"]), ""), F.lit("</svg>")).alias("svg")))


@query(f"with b as ({BOXES}), r as (select plan_id, ord, x1 * 4e0 / 5e1 as x1, y1 * 4e0 / 5e1 as y1, x2 * 4e0 / 5e1 as x2, y2 * 4e0 / 5e1 as y2 from b where conf >= 5e-1 and cls_id = 3), k as (select unnest([0, 1, 2, 3]) as k) select plan_id, ord as mask_idx, 'room_' || ord as label, cast(k as int) as place, {mm_sql('case when k in (0, 3) then x1 else x2 end')} as x_mm, {mm_sql('case when k < 2 then y1 else y2 end')} as y_mm, cast(floor((x2 - x1) * (y2 - y1) * 1e2 + 5e-1) as bigint) as area_cm from r, k where (x2 - x1) * (y2 - y1) >= 1e0")
def p6_mask_polygons(spark, sf_dir):
    """Contours with a point on one side's middle, moved out by a pixel, which simplifying drops again; a row for each point."""
    b = boxes(spark, sf_dir).where("conf >= 0.5")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1, x2, y2 = (F.col(c) * 4.0 for c in ("x1", "y1", "x2", "y2"))
    contour = F.array(pt(x1, y1), pt((x1 + x2) / 2.0, y1 - 1.0), pt(x2, y1), pt(x2, y2), pt(x1, y2))
    got = detect.mask_polygons(b.select("plan_id", F.col("ord").alias("mask_idx"), "cls_id", contour.alias("contour")))
    got = got.select("plan_id", "mask_idx", "label", F.posexplode("polygon").alias("place", "p"), F.round(F.col("area") * 100.0).cast("long").alias("area_cm"))
    return got.select("plan_id", "mask_idx", "label", "place", mm(F.get("p", F.lit(0))).alias("x_mm"), mm(F.get("p", F.lit(1))).alias("y_mm"), "area_cm")


BOTH = "greatest(0e0, least(q.x2, r.x2) - greatest(q.x1, r.x1)) * greatest(0e0, least(q.y2, r.y2) - greatest(q.y1, r.y1))"


@query(f"with recursive b as ({BOXES}), r as (select plan_id, cls_id, ord, x1, y1, x2, y2, row_number() over (partition by plan_id, cls_id order by conf desc, ord) as k from b), g as (select plan_id, cls_id, cast(1 as bigint) as k, [{{'ord': ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] as kept from r where k = 1 union all select g.plan_id, g.cls_id, r.k, case when len(list_filter(kept, lambda q: {BOTH} > ((r.x2 - r.x1) * (r.y2 - r.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - {BOTH}) * 45e-2)) > 0 then kept else list_append(kept, {{'ord': r.ord, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) end from g join r on r.plan_id = g.plan_id and r.cls_id = g.cls_id and r.k = g.k + 1), z as (select plan_id, cls_id, arg_max(kept, k) as kept from g group by plan_id, cls_id) select plan_id, cls_id, (unnest(kept)).ord as ord from z")
def f1_suppression(spark, sf_dir):
    return detect.suppress(boxes(spark, sf_dir)).select("plan_id", "ord", "cls_id")


@query(RECURSIVE + SNAP + f"select {WALLS_OUT} from sw")
def a1_snap_exact(spark, sf_dir):
    """The walk of large plans, used for all."""
    return walls_out(resolve.snap_ends(found_walls(spark, sf_dir), CFG, most_folded=0))


@query()
def s11_obj_export(spark, sf_dir):
    return files.obj_text(scene.build_scene(plans.sample_plans(spark)))


def sample_json(text: str) -> str:
    """A sample as its sink writes it: fields in the schema's order, numbers of the schema's type, missing ones left out."""
    d, num = json.loads(text), lambda v: [num(x) for x in v] if isinstance(v, list) else float(v)
    kinds = {"scale": {"pixels_per_meter": num}, "walls": {"start": num, "end": num, "thickness": num}, "doors": {"position": list, "width": num, "type": str, "wall_index": int}, "windows": {"position": list, "width": num, "wall_index": int}, "rooms": {"label": str, "polygon": num, "area": num}}
    row = lambda part, r: {k: f(r[k]) for k, f in kinds[part].items()}
    return json.dumps({p: row(p, d[p]) if p == "scale" else [row(p, r) for r in d[p]] for p in kinds}, separators=(",", ":"))


@query("select * from (values " + ", ".join(f"('{n}', '{sample_json(t)}')" for n, t in plans.SAMPLES.items()) + ") as t(plan_id, json)")
def s8_json_sink(spark, sf_dir):
    return files.json_documents(plans.sample_plans(spark))


def room_rings(boxes: Column) -> Column:
    """Rectangles of a plan's room boxes, as open rings."""
    ring = lambda b: F.array(*[F.array(b[x], b[y]) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    return F.transform(F.filter(boxes, lambda b: b["cls_id"] == 3), ring)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection to counts: walls that stay, openings on them, rooms, per plan. All of a plan is in one row after one shuffle."""
    d = resolve.detected_plans(metres(spark, sf_dir), CFG)
    dx, dy = (lambda w: w["ex"] - w["sx"]), (lambda w: w["ey"] - w["sy"])
    kept = F.transform(F.filter("walls", lambda w: F.sqrt(dx(w) * dx(w) + dy(w) * dy(w)) >= CFG.min_wall_length), lambda w: w["wall_index"])
    d = d.withColumn("kept", kept).withColumn("tied", F.filter("openings", lambda o: F.array_contains("kept", o["wall_index"])))
    rooms = F.filter(room_rings(F.col("boxes")), lambda p: polygon_area(p) >= CFG.min_room_area)
    of = lambda k: F.size(F.filter("tied", lambda o: o["kind"] == k))
    return scene.with_summary(d.select("plan_id", *scene.counts(wall=F.size("kept"), door=of("door"), window=of("window"), floor=F.size(rooms))))


@query(RECURSIVE + SNAP + f", {NEAR}, kw as (select plan_id, wall_index from sw where {length_sql()} >= 3e-1), q as (select plan_id, 'wall' as kind from kw union all select n.plan_id, n.kind from n join kw on kw.plan_id = n.plan_id and kw.wall_index = coalesce(n.wi, 0) union all select plan_id, 'floor' from m where cls_id = 3 and (x2 - x1) * (y2 - y1) >= 1e0), g as (select plan_id, " + ", ".join(f"count(*) filter (kind = '{k}') as {k}s" for k in ("wall", "door", "window", "floor", "ceiling", "label")) + " from q group by plan_id) select *, concat_ws(', ', " + ", ".join(f"case when {k}s > 0 then {k}s || ' {k}s' end" for k in ("wall", "door", "window", "floor", "ceiling", "label")) + ") as summary from g")
def e2_detection_to_counts(spark, sf_dir):
    return flagship(spark, sf_dir)



# Parts of the operators above, each by itself.

UNIT = f", d as (select *, {length_sql()} as len from w), u as (select plan_id, wall_index, len, case when len < 1e-6 then 1e0 else (ex - sx) / len end as dx, case when len < 1e-6 then 0e0 else (ey - sy) / len end as dy from d)"


@query(WITH + UNIT + f" select plan_id, wall_index, {mm_sql('dx + 1e-7')} as dx_mm, {mm_sql('dy + 1e-7')} as dy_mm, {mm_sql('case when len < 1e-6 then 0e0 else len + 1e-7 end')} as length_mm from u")
def p7_wall_direction(spark, sf_dir):
    dx, dy, n = direction(*map(F.col, ("sx", "sy", "ex", "ey")))
    return found_walls(spark, sf_dir).select("plan_id", "wall_index", mm(dx + 1e-7).alias("dx_mm"), mm(dy + 1e-7).alias("dy_mm"), mm(F.when(n > 0, n + 1e-7).otherwise(0.0)).alias("length_mm"))


@query(WITH + UNIT + f" select plan_id, wall_index, {mm_sql('1e-7 - dy')} as px_mm, {mm_sql('dx + 1e-7')} as py_mm from u")
def p8_perpendicular(spark, sf_dir):
    dx, dy, _ = direction(*map(F.col, ("sx", "sy", "ex", "ey")))
    px, py = perpendicular(dx, dy)
    return found_walls(spark, sf_dir).select("plan_id", "wall_index", mm(px + 1e-7).alias("px_mm"), mm(py + 1e-7).alias("py_mm"))


@query(WITH + f"select plan_id, wall_index, {mm_sql(length_sql() + ' + 1e-7')} as length_mm from w")
def p9_wall_length(spark, sf_dir):
    return found_walls(spark, sf_dir).select("plan_id", "wall_index", mm(F.expr(length_sql()) + 1e-7).alias("length_mm"))


@query(WITH + f"select o.plan_id, o.ord, {mm_sql(segment_distance_sql('x', 'y') + ' + 1e-7')} as distance_mm from o join w on w.plan_id = o.plan_id and w.wall_index = 0")
def p10_segment_distance(spark, sf_dir):
    """Each opening to the first wall of its plan."""
    w = found_walls(spark, sf_dir).where("wall_index = 0").select("plan_id", "sx", "sy", "ex", "ey")
    return found_openings(spark, sf_dir).join(w, "plan_id").select("plan_id", "ord", mm(F.expr(segment_distance_sql("x", "y")) + 1e-7).alias("distance_mm"))


@query("select p_partkey, case p_partkey % 4 when 0 then cast(p_size as double) when 2 then 0e0 end as px, case p_partkey % 4 when 0 then 25e-1 when 2 then 0e0 end as py, case p_partkey % 4 when 1 then p_size / 2e0 end as along, p_partkey % 4 = 3 as bad from part")
def p11_opening_position(spark, sf_dir):
    """Positions as a pair, a distance, missing, or malformed."""
    k, p = F.col("p_partkey") % 4, spark.read.parquet(f"{sf_dir}/part.parquet")
    place = F.when(k == 0, F.format_string('"position":[%s,2.5]', "p_size")).when(k == 1, F.format_string('"position":%s', F.col("p_size") / 2.0)).when(k == 2, F.lit('"width":1')).otherwise(F.lit('"position":[1,2,3]'))
    docs = p.select("p_partkey", F.concat(F.lit('{"doors":[{'), place, F.lit("}]}")).alias("doc"))
    o = plans.openings(plans.parse_plans(docs, "p_partkey", "doc"), "door")
    fine = ~F.col("bad_position")
    return o.select(F.col("plan_id").alias("p_partkey"), *[F.when(fine & F.col("along").isNull(), F.col(c)).alias(c) for c in ("px", "py")], F.when(fine, F.col("along")).alias("along"), F.col("bad_position").alias("bad"))


@query("select cast(p_partkey as string) as name, case p_partkey % 3 when 0 then s else 1e0 end as x0, case p_partkey % 3 when 2 then 1e0 else 2e0 end as y0, case p_partkey % 3 when 0 then s + 3e0 else greatest(s, 1e0) end as x1, case p_partkey % 3 when 0 then 6e0 when 1 then 9e0 else 5e0 end as y1 from (select p_partkey, cast(p_size as double) as s from part)")
def p20_element_box(spark, sf_dir):
    """Boxes of a rect, a line drawn backwards, and a polygon."""
    k, s = F.col("p_partkey") % 3, F.col("p_size")
    shape = F.when(k == 0, F.format_string('<rect x="%s" y="2" width="3" height="4"/>', s)).when(k == 1, F.format_string('<line x1="%s" y1="9" x2="1" y2="2"/>', s)).otherwise(F.format_string('<polygon points="1,1 %s,5  1,4"/>', s))
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g id="Wall">'), shape, F.lit("</g></svg>")).alias("svg"))
    return scan_svg(docs).select("name", "x0", "y0", "x1", "y1")


def masks(spark, sf_dir) -> DataFrame:
    """Detections of a plan as two lists, joined again by place."""
    b = boxes(spark, sf_dir).groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("ord", "cls_id", "x1", "y1"))).alias("b"))
    contour = lambda x: F.array(F.struct(x["x1"].alias("x"), x["y1"].alias("y")))
    return detect.zip_masks(b.select("plan_id", F.transform("b", lambda x: x["cls_id"]).alias("classes"), F.transform("b", contour).alias("contours")))


@query(f"with b as ({BOXES}) select plan_id, cast(ord as int) as mask_idx, cls_id, x1 as x from b")
def j5_mask_box(spark, sf_dir):
    return masks(spark, sf_dir).select("plan_id", "mask_idx", "cls_id", F.get("contour", F.lit(0))["x"].alias("x"))


@query(f"with b as ({BOXES}) select plan_id, 'room_' || ord as label from b where cls_id = 3")
def f3_room_masks(spark, sf_dir):
    """Places count all masks, so the labels have gaps."""
    return masks(spark, sf_dir).where(detect.class_name(F.col("cls_id")) == "room").select("plan_id", F.concat(F.lit("room_"), F.col("mask_idx")).alias("label"))


@query(WITH + "select plan_id, ord as room_index from m where cls_id = 3 and ord % 5 >= 3")
def f4_polygon_points(spark, sf_dir):
    """Rooms cut to (place % 5) points."""
    r = room_polygons(spark, sf_dir).withColumn("polygon", F.slice("polygon", F.lit(1), (F.col("room_index") % 5).cast("int")))
    return scene.slabs(r, "floor").select("plan_id", "room_index")


@query(f"with b as ({BOXES}) select plan_id, ord from b where ord % 4 > 1")
def f6_label_size(spark, sf_dir):
    """Boxes of 0 to 3 quarters of a pixel: those of a thousandth of the image's width or less go."""
    b = boxes(spark, sf_dir).select("plan_id", "ord", F.col("x1").alias("x0"), (F.col("x1") + F.col("ord") % 4 * 0.25).alias("x1"), F.lit(0.0).alias("y0"), F.lit(8.0).alias("y1"))
    return dataset.yolo_labels(b, F.lit(320.0), F.lit(240.0)).select("plan_id", "ord")


def short_walls(spark, sf_dir) -> DataFrame:
    """Walls of which every third is a point."""
    point = F.col("wall_index") % 3 == 0
    return found_walls(spark, sf_dir).withColumns({"ex": F.when(point, F.col("sx")).otherwise(F.col("ex")), "ey": F.when(point, F.col("sy")).otherwise(F.col("ey"))})


@query(WITH + f"select plan_id, wall_index from w where wall_index % 3 <> 0 and {length_sql()} >= 1e-6")
def f8_degenerate_walls(spark, sf_dir):
    return scene.solid_walls(short_walls(spark, sf_dir)).select("plan_id", "wall_index")


@query(WITH + f", i as (select plan_id, ord, kind, cast(ord % 9 - 1 as int) as wi from o), r as (select i.plan_id, i.ord as opening_index, case when i.wi < 0 then 'negative wall' when w.wall_index is null then 'no such wall' when w.wall_index % 3 = 0 or {length_sql()} < 1e-6 then 'degenerate wall' end as reason from i left join w on w.plan_id = i.plan_id and w.wall_index = i.wi) select * from r where reason is not null")
def f9_opening_in_range(spark, sf_dir):
    """Openings that no wall takes, with the reason."""
    o = placed(spark, sf_dir).withColumn("wall_index", (F.col("opening_index") % 9 - 1).cast("int"))
    return scene.rejected_openings(o, short_walls(spark, sf_dir)).select("plan_id", "opening_index", "reason")


@query(WITH + ", k as (select unnest(['floor', 'ceiling']) as type) select plan_id, type, count(*) as n from m, k where cls_id = 3 group by plan_id, type")
def f10_ceiling_toggle(spark, sf_dir):
    s = scene.build_scene(plans.parse_plans(document_rows(spark, sf_dir), "plan_id", "doc"), with_ceiling=True)
    return s.where("type in ('floor', 'ceiling')").groupBy("plan_id", "type").agg(F.count("*").alias("n"))


@query(WITH + OBJECTS + " select plan_id, i from ob where type = 'wall'")
def f11_wall_objects(spark, sf_dir):
    return objects(spark, sf_dir).where("type = 'wall'").select("plan_id", "i")


@query(WITH + ", n as (select plan_id, count(*) as n from w group by plan_id), k as (select unnest([0, 1]) as k) select n.plan_id, cast(2 * a.wall_index + k1.k as int) as p, cast(2 * b.wall_index + k2.k as int) as q from n join w a on a.plan_id = n.plan_id join w b on b.plan_id = n.plan_id and b.wall_index > a.wall_index, k k1, k k2")
def j4_endpoint_pairs(spark, sf_dir):
    n = found_walls(spark, sf_dir).groupBy("plan_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("plan_id", F.explode(resolve.pair_places(F.col("n"))).alias("x")).select("plan_id", "x.p", "x.q")


@query("select 'c' || p_partkey || '_a' as name, '/data/c' || p_partkey || '/a/' || case p_partkey % 4 when 0 then 'F1_scaled.png' when 1 then 'F1_original.png' else 'other.png' end as image_path from part where p_partkey % 7 <> 0 and p_partkey % 4 <> 3")
def j6_svg_image(spark, sf_dir):
    """Folders with and without a drawing, and with none, one or two images."""
    k = F.col("p_partkey") % 4
    images = F.when(k == 0, F.array(F.lit("image.png"), F.lit("F1_scaled.png"))).when(k == 1, F.array(F.lit("F1_original.png"), F.lit("a.png"))).when(k == 2, F.array(F.lit("other.png"))).otherwise(F.array(F.lit("notes.txt")))
    listed = F.concat(images, F.when(F.col("p_partkey") % 7 != 0, F.array(F.lit("model.svg"))).otherwise(F.array().cast("array<string>")))
    paths = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(listed).alias("f"), "p_partkey").select(F.concat(F.lit("/data/c"), "p_partkey", F.lit("/a/"), "f").alias("path"))
    return dataset.find_samples(paths, "/data").select("name", "image_path")


@query(WITH + OBJECTS + " select case type when 'wall' then 'Wall' when 'floor' then 'Floor' end as material, count(*) as n from ob group by 1")
def j7_material_dimension(spark, sf_dir):
    return scene.with_materials(objects(spark, sf_dir)).groupBy("material").agg(F.count("*").alias("n"))


@query(WITH + f"select plan_id, {', '.join(f'{mm_sql(e)} as {c}_mm' for c, e in (('x0', 'min(least(sx, ex))'), ('y0', 'min(least(sy, ey))'), ('x1', 'max(greatest(sx, ex))'), ('y1', 'max(greatest(sy, ey))')))} from w group by plan_id")
def a4_extent(spark, sf_dir):
    low, high = (lambda c, f=f, g=g: f(g(f"s{c}", f"e{c}")) for f, g in ((F.min, F.least), (F.max, F.greatest)))
    return found_walls(spark, sf_dir).groupBy("plan_id").agg(mm(low("x")).alias("x0_mm"), mm(low("y")).alias("y0_mm"), mm(high("x")).alias("x1_mm"), mm(high("y")).alias("y1_mm"))


@query("select n - cast(floor(n * 5e-2) as bigint) - cast(floor(n * 15e-2) as bigint) as train, cast(floor(n * 15e-2) as bigint) as val, cast(floor(n * 5e-2) as bigint) as test from (select count(*) as n from part)")
def a7_split_sizes(spark, sf_dir):
    return spark.createDataFrame([dataset.split_sizes(spark.read.parquet(f"{sf_dir}/part.parquet").count())], "train long, val long, test long")


@query("select page_id, url from pages where url is not null order by string_split(url, '/'), page_id")
def o1_path_sort(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null").select("page_id", "url").orderBy(dataset.path_parts(F.col("url")), "page_id")


def shuffled_sql() -> str:
    """Python's seeded shuffle has no SQL, so its order is given for tables of 10, 100 and 1,000 rows."""
    rows = []
    for n in (10, 100, 1000):
        order = list(range(n))
        random.Random(42).shuffle(order)
        rows += [f"({n}, {rank}, {at})" for at, rank in enumerate(order)]
    return f"with p(n, rank, position) as (values {', '.join(rows)}), s as (select s_suppkey, row_number() over (order by string_split('c/' || s_suppkey, '/')) - 1 as rank, count(*) over () as n from supplier) select s_suppkey, cast(position as int) as position, case when position < cast(floor(n * 5e-2) as bigint) then 'test' when position < cast(floor(n * 5e-2) as bigint) + cast(floor(n * 15e-2) as bigint) then 'val' else 'train' end as split from s join p using (n, rank)"


@query(shuffled_sql())
def o2_seeded_shuffle(spark, sf_dir):
    return dataset.seeded_split(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.concat(F.lit("c/"), "s_suppkey").alias("dir"))).select("s_suppkey", "position", "split")


@query(WITH + "select plan_id, ord, kind from (select plan_id, ord, kind, row_number() over (partition by plan_id order by confidence desc, ord) as rn from o) where rn = 1")
def o4_top_opening(spark, sf_dir):
    best = found_openings(spark, sf_dir).groupBy("plan_id").agg(F.min_by(F.struct("ord", "kind"), F.struct(-F.col("confidence"), F.col("ord"))).alias("x"))
    return best.select("plan_id", "x.*")


@query("select p_partkey, cast(p_partkey % 5000 + 1 as int) as img_w, cast(p_size * 7 as int) as img_h from part")
def s6_image_size(spark, sf_dir):
    """Headers of images, written and read."""
    part = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    content = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), part(F.col("p_partkey") % 5000 + 1), part(F.col("p_size") * 7)))
    w, h = files.png_size(content)
    return p.select("p_partkey", w.alias("img_w"), h.alias("img_h"))


@query(f"with b as ({BOXES}), t as (select plan_id, string_agg(printf('%d %.6f %.6f 0.500000 0.250000', cls_id, ord % 8 / 8e0, ord % 4 / 4e0), chr(10) order by ord) as t from b where plan_id % 3 <> 0 group by plan_id) select cast(p.plan_id as string) as name, 'train' as split, coalesce(t, '') as content from (select distinct plan_id from b) p left join t on t.plan_id = p.plan_id")
def s9_label_text(spark, sf_dir):
    """One text per sample; samples without labels have an empty one."""
    b = boxes(spark, sf_dir).withColumn("name", F.col("plan_id").cast("string"))
    labels = b.where("plan_id % 3 <> 0").select("name", F.col("ord").alias("seq"), "cls_id", (F.col("ord") % 8 / 8.0).alias("cx"), (F.col("ord") % 4 / 4.0).alias("cy"), F.lit(0.5).alias("w"), F.lit(0.25).alias("h"))
    return files.label_lines(labels, b.select("name", F.lit("train").alias("split")).distinct())


@query("select concat_ws(chr(10), 'names:', '- wall', '- door', '- window', '- room', 'nc: 4', 'path: /out', 'test: images/test', 'train: images/train', 'val: images/val', '') as yaml")
def s10_manifest(spark, sf_dir):
    return spark.createDataFrame([(files.manifest("/out", CLASSES),)], "yaml string")


def by_length(path: str) -> list[dict]:
    """Stands in for a detector: a box that follows from the path's length."""
    return [{"cls_id": len(path) % 4, "conf": 0.5, "x1": 0.0, "y1": 0.0, "x2": float(len(path)), "y2": 1.0}]


@query("select page_id as plan_id, cast(0 as bigint) as ord, cast(length(url) % 4 as int) as cls_id, cast(length(url) as double) as x2 from pages where url is not null")
def s14_detector_call(spark, sf_dir):
    images = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null").select(F.col("page_id").alias("plan_id"), F.col("url").alias("path"))
    return detect.detect(images, by_length).select("plan_id", "ord", "cls_id", "x2")


@query("select * from (values ('simple', 5, 2, false), ('broken', null, null, true), ('studio', 6, 3, false), ('empty', null, null, false)) as t(name, n_walls, n_rooms, corrupt)")
def s1_plan_files(spark, sf_dir):
    """Documents as files, of which one is cut off and one says nothing."""
    texts = {"simple": plans.SAMPLES["apartment"], "broken": plans.SAMPLES["studio"][:200], "studio": plans.SAMPLES["studio"], "empty": "{}"}
    out = files.scratch(spark, "plans")
    spark.createDataFrame(list(texts.items()), "name string, value string").write.partitionBy("name").text(out)
    got = plans.read_plans(spark, out)
    sizes = [F.when(F.col(c).isNotNull(), F.size(c)).cast("int").alias(f"n_{c}") for c in ("walls", "rooms")]
    return got.select(F.regexp_extract("plan_id", "name=([a-z]+)/", 1).alias("name"), *sizes, F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("select * from (values ('data.nc', '4'), ('data.names', '[\"wall\", \"door\"]'), ('model.imgsz', '640'), ('model.conf', '0.5'), ('model.device', '\"auto\"'), ('augment', 'true')) as t(key, value)")
def s7_config(spark, sf_dir):
    """A configuration written and read, its settings by their whole names."""
    text = "data: {nc: 4, names: [wall, door]}\nmodel:\n  imgsz: 640\n  conf: 0.5  # least\n  device: auto\naugment: true\n"
    out = files.scratch(spark, "config")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(out)
    flat = {f"{k}.{n}" if n else k: v for k, part in files.load_config(spark, out).items() for n, v in (part.items() if isinstance(part, dict) else [("", part)])}
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in flat.items()], "key string, value string")


@query(f"select page_id, 'code/p' || page_id || '/' || f as entry from (select page_id, string_split({FILES}, '/')[-1] as f, {FILES} as path from pages) where not contains(path, '__pycache__') and not contains(path, '.pyc') and not contains(path, '.pyo') and not contains(path, '.DS_Store')")
def s13_archive_entries(spark, sf_dir):
    """Names in an archive, without what is left out."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("url", F.expr(FILES)).where("url is not null")
    path = F.concat(F.lit("/home/x/repo/p"), "page_id", F.lit("/"), F.when(F.col("url").contains("__pycache__"), "__pycache__/x").otherwise(F.substring_index("url", "/", -1)))
    return files.entries(p.select("page_id", path.alias("path")), "/home/x/repo/", "code").select("page_id", "entry")


@query("select * from (values ('apartment', 'ceiling', 2), ('apartment', 'floor', 2), ('apartment', 'label', 2), ('apartment', 'wall', 5), ('studio', 'ceiling', 3), ('studio', 'floor', 3), ('studio', 'label', 3), ('studio', 'wall', 6)) as t(plan_id, type, n)")
def c1_scene_replaced(spark, sf_dir):
    """A scene of all samples, then one of two with ceilings in its place."""
    out, samples = files.scratch(spark, "scene"), plans.sample_plans(spark)
    scene.write_scene(scene.build_scene(samples), out)
    got = scene.write_scene(scene.build_scene(samples.where("plan_id <> 'three_bedroom'"), with_ceiling=True), out)
    return got.groupBy("plan_id", "type").agg(F.count("*").cast("int").alias("n"))
