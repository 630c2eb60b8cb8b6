"""Queries on solids and faces: walls less their openings, valid rings, simplified contours, meshes."""

from __future__ import annotations

import math
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.geometry import length_sql, ring_fault
from ..operators import detect, difference, scene
from ..sources import files, glb, plans
from .queries import CFG, ON, WITH, boxes, document_rows, found_walls, mm, mm_sql, placed, query, room_polygons

#: Cells between all borders of a wall and its holes, each whole or in a hole, with its neighbours.
CELLS = f"""{ON}, sw as (select plan_id, wall_index, thickness, {length_sql()} as len from w where {length_sql()} >= 1e-6),
h0 as (select plan_id, wall_index, greatest(0e0, along - width / 2e0) as u0, least(len, along + width / 2e0) as u1, greatest(0e0, sill) as z0, least(27e-1, sill + height) as z1 from a),
h as (select * from h0 where u0 < u1 and z0 < z1), cuts as (select plan_id, wall_index, count(*) as n_cuts from h0 group by plan_id, wall_index),
us as (select *, lead(u) over (partition by plan_id, wall_index order by u) as u2 from (select plan_id, wall_index, 0e0 as u from sw union select plan_id, wall_index, len from sw union select plan_id, wall_index, u0 from h union select plan_id, wall_index, u1 from h)),
zs as (select *, lead(z) over (partition by plan_id, wall_index order by z) as z2 from (select plan_id, wall_index, 0e0 as z from sw union select plan_id, wall_index, 27e-1 from sw union select plan_id, wall_index, z0 from h union select plan_id, wall_index, z1 from h)),
cell as (select us.plan_id, us.wall_index, u, u2, z, z2, count(h.u0) = 0 as whole from us join zs on zs.plan_id = us.plan_id and zs.wall_index = us.wall_index
 left join h on h.plan_id = us.plan_id and h.wall_index = us.wall_index and h.u0 <= u and h.u1 >= u2 and h.z0 <= z and h.z1 >= z2 where u2 is not null and z2 is not null group by all),
edge as (select *, coalesce(lag(whole) over across, false) as l, coalesce(lead(whole) over across, false) as r, coalesce(lag(whole) over up, false) as d, coalesce(lead(whole) over up, false) as t from cell
 window across as (partition by plan_id, wall_index, z order by u), up as (partition by plan_id, wall_index, u order by z)),
face as (select plan_id, wall_index, sum(case when whole then (u2 - u) * (z2 - z) else 0e0 end) as face, sum(case when whole then (z2 - z) * ((not l)::int + (not r)::int) + (u2 - u) * ((not d)::int + (not t)::int) else 0e0 end) as rim from edge group by plan_id, wall_index)"""


@query(WITH + f", {CELLS} select sw.plan_id, sw.wall_index, coalesce(n_cuts, 0) as n_cuts, {mm_sql('face + 1e-7')} as face_mm, {mm_sql('face * thickness + 1e-7')} as volume_mm, {mm_sql('2e0 * face + rim * thickness + 1e-7')} as surface_mm from sw join face on face.plan_id = sw.plan_id and face.wall_index = sw.wall_index left join cuts on cuts.plan_id = sw.plan_id and cuts.wall_index = sw.wall_index")
def j3_wall_difference(spark, sf_dir):
    """Walls with holes: volume and surface are taken from the closed mesh, the face from the sweep."""
    w = found_walls(spark, sf_dir)
    d = difference.wall_difference(w, scene.opening_on_wall(placed(spark, sf_dir), w))
    mesh = {"volume": difference.mesh_volume(F.col("vertices"), F.col("faces")), "surface": difference.mesh_area(F.col("vertices"), F.col("faces"))}
    return d.select("plan_id", "wall_index", "n_cuts", mm(F.col("face_area") + 1e-7).alias("face_mm"), *[mm(v + 1e-7).alias(f"{k}_mm") for k, v in mesh.items()])


def bent_rooms(spark, sf_dir):
    """Room rectangles by place: every seventh one crossed, flat, with a point twice, cut to two points, one number missing, or with two sides on each other."""
    k = F.col("room_index") % 7
    at = lambda i: F.get("polygon", F.lit(i))
    x, y = (lambda i: F.get(at(i), F.lit(0))), (lambda i: F.get(at(i), F.lit(1)))
    bent = (
        F.when(k == 1, F.array(at(0), at(1), at(3), at(2)))
        .when(k == 2, F.array(at(0), at(1), F.array(x(2), y(0)), F.array((x(0) + x(1)) / 2.0, y(0))))
        .when(k == 3, F.array(at(0), at(1), at(2), at(1), at(3)))
        .when(k == 4, F.slice("polygon", 1, 2))
        .when(k == 5, F.array(at(0), F.array(x(1), F.lit(None).cast("double")), at(2), at(3)))
        .when(k == 6, F.array(at(0), at(1), at(2), F.array((x(0) + x(1)) / 2.0, y(2)), F.array((x(0) + x(1)) / 2.0, y(0)), F.array(x(0), y(2))))
        .otherwise(F.col("polygon"))
    )
    return room_polygons(spark, sf_dir).withColumn("polygon", bent)


#: The same rings as points in order, and their sides in pairs.
BENT = """, q as (select plan_id, ord as room_index, ord % 7 as k, x1, y1, x2, y2, (x1 + x2) / 2e0 as xm from m where cls_id = 3),
pts as (select plan_id, room_index, unnest(range(len(xs))) as i, unnest(xs) as x, unnest(ys) as y, len(xs) as n from (select plan_id, room_index,
 case k when 1 then [x1, x2, x1, x2] when 2 then [x1, x2, x2, xm] when 3 then [x1, x2, x2, x2, x1] when 4 then [x1, x2] when 6 then [x1, x2, x2, xm, xm, x1] else [x1, x2, x2, x1] end as xs,
 case k when 1 then [y1, y1, y2, y2] when 2 then [y1, y1, y1, y1] when 3 then [y1, y1, y2, y1, y2] when 4 then [y1, y1] when 5 then [y1, null, y2, y2] when 6 then [y1, y1, y2, y2, y1, y2] else [y1, y1, y2, y2] end as ys from q)),
sides as (select a.plan_id, a.room_index, a.i, a.n, a.x, a.y, b.x as u, b.y as v from pts a join pts b on b.plan_id = a.plan_id and b.room_index = a.room_index and b.i = (a.i + 1) % a.n),
turn as (select s.plan_id, s.room_index, s.i, t.i as j, s.n, s.x, s.y, s.u, s.v, t.x as tx, t.y as ty, t.u as tu, t.v as tv,
 (s.u - s.x) * (t.y - s.y) - (s.v - s.y) * (t.x - s.x) as a, (s.u - s.x) * (t.v - s.y) - (s.v - s.y) * (t.u - s.x) as b, (t.u - t.x) * (s.y - t.y) - (t.v - t.y) * (s.x - t.x) as c, (t.u - t.x) * (s.v - t.y) - (t.v - t.y) * (s.u - t.x) as d
 from sides s join sides t on s.plan_id = t.plan_id and s.room_index = t.room_index and s.i < t.i),
sign as (select *, case when a > 1e-9 then 1 when a < -1e-9 then -1 else 0 end as oa, case when b > 1e-9 then 1 when b < -1e-9 then -1 else 0 end as ob, case when c > 1e-9 then 1 when c < -1e-9 then -1 else 0 end as oc, case when d > 1e-9 then 1 when d < -1e-9 then -1 else 0 end as od from turn),
pair as (select plan_id, room_index, bool_or(j - i > 1 and j - i < n - 1 and (oa <> ob and oc <> od or oa = 0 and ob = 0 and greatest(least(x, u), least(tx, tu)) <= least(greatest(x, u), greatest(tx, tu)) and greatest(least(y, v), least(ty, tv)) <= least(greatest(y, v), greatest(ty, tv)))) as crossed, bool_and(oa = 0 and ob = 0) as flat from sign group by plan_id, room_index),
ring as (select plan_id, room_index, max(n) as n, count(*) filter (x is null or y is null) as missing, count(distinct (x, y)) as places from pts group by plan_id, room_index),
fault as (select r.plan_id, r.room_index, case when n < 3 then 'few points' when missing > 0 then 'bad point' when flat then 'no area' when places < n then 'repeated point' when crossed then 'crossing' end as reason from ring r left join pair p on p.plan_id = r.plan_id and p.room_index = r.room_index)"""


@query(WITH + BENT + " select plan_id, room_index, reason, reason in ('repeated point', 'crossing') as made from fault where reason is not null")
def p15_rejected_rooms(spark, sf_dir):
    """Rings that aren't simple, each with its reason, and whether floor and ceiling are made of it all the same."""
    return scene.rejected_rooms(bent_rooms(spark, sf_dir)).select("plan_id", "room_index", "reason", "made")


@query(WITH + BENT + " select plan_id, type, count(*) as n, count(reason) as n_faulty from fault, (select unnest(['floor', 'ceiling']) as type) where coalesce(reason, '') not in ('few points', 'bad point', 'no area') group by plan_id, type")
def p16_faces_made(spark, sf_dir):
    made = scene.slabs(bent_rooms(spark, sf_dir), ("floor", "ceiling"))
    return made.groupBy("plan_id", "type").agg(F.count("*").alias("n"), F.count("fault").alias("n_faulty"))


@query(WITH + f", z as (select plan_id, ord, row_number() over (partition by plan_id order by ord) - 1 as i from m where cls_id = 3) select plan_id, 'Wall_' || wall_index as name from w where {length_sql()} >= 1e-6 union all select plan_id, k || '_room_' || (ord % 3) || '_' || i from z, (select unnest(['Floor', 'Ceiling', 'Label']) as k)")
def c1_object_names(spark, sf_dir):
    """Names of a scene's objects, where several rooms of a plan have one label."""
    # Dealt out, so that the parts of the scene read the documents from one shuffle and don't each make them again.
    d = document_rows(spark, sf_dir, label=F.concat(F.lit("room_"), F.col("room_index") % 3)).repartition("plan_id", "doc")
    return scene.build_scene(plans.parse_plans(d, "plan_id", "doc"), with_ceiling=True).select("plan_id", "name")


@query(WITH + ", r as (select plan_id, ord, cast(floor(conf * 100) as int) % 4 as k from b where cls_id = 3 and conf >= 5e-1) select plan_id, ord as mask_idx, case k when 0 then 4 when 1 then 4 when 2 then 8 else 3 end as n_points, true as simple from r")
def p6_simple_rings(spark, sf_dir):
    """Contours that simplifying might break: a spike that reaches into a shallow dent, rough sides, a sliver of a triangle.

    No ring meets itself afterwards, and none is left with fewer than three points.
    """
    b = boxes(spark, sf_dir).where("conf >= 0.5")
    ring = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    square = [(0, 0), (400, 0), (400, 400), (0, 400)]
    rough = [p for a, c in zip(square, square[1:] + square[:1], strict=True) for p in [a, *[(a[0] + (c[0] - a[0]) * t / 8 + (t % 2) * 3 * (c[1] != a[1]), a[1] + (c[1] - a[1]) * t / 8 + (t % 2) * 3 * (c[0] != a[0])) for t in range(1, 8)]]]
    dent = [(0, 0), (180, 0), (200, -4), (220, 0), (400, 0), (400, 400), (202, 400), (200, -2), (198, 400), (0, 400)]
    k = F.floor(F.col("conf") * 100).cast("int") % 4
    contour = F.when(k == 0, ring(square)).when(k == 1, ring(rough)).when(k == 2, ring(dent)).otherwise(ring([(0, 0), (900, 3), (450, 4)]))
    masks = b.select("plan_id", F.col("ord").alias("mask_idx"), "cls_id", contour.alias("contour"))
    got = detect.mask_polygons(masks, replace(CFG, min_room_area=0.0))
    return got.select("plan_id", "mask_idx", F.size("polygon").alias("n_points"), ring_fault(F.col("polygon")).isNull().alias("simple"))


def cornered(spark, sf_dir):
    """Documents of which every other room is an L."""
    x = lambda p: F.get(p, F.lit(0))
    y = lambda p: F.get(p, F.lit(1))
    a, b, c, d = (F.get("polygon", F.lit(i)) for i in range(4))
    mid_x, mid_y = (x(a) + x(b)) / 2.0, (y(b) + y(c)) / 2.0
    bent = F.array(a, b, F.array(x(b), mid_y), F.array(mid_x, mid_y), F.array(mid_x, y(c)), d)
    return document_rows(spark, sf_dir, polygon=F.when(F.col("room_index") % 2 == 1, bent).otherwise(F.col("polygon")))


WHOLE = f""", s as (select plan_id, count(*) as n_walls from w where {length_sql()} >= 1e-6 group by plan_id),
r as (select plan_id, count(*) as n_rooms, count(*) filter (ord % 2 = 1) as n_bent, sum((x2 - x1) * (y2 - y1) * case when ord % 2 = 1 then 75e-2 else 1e0 end) as area from m where cls_id = 3 group by plan_id),
p as (select coalesce(s.plan_id, r.plan_id) as plan_id, coalesce(n_walls, 0) as n_walls, coalesce(n_rooms, 0) as n_rooms, coalesce(n_bent, 0) as n_bent, coalesce(area, 0) as area from s full join r on s.plan_id = r.plan_id)"""


@query(WITH + WHOLE + " select plan_id, n_walls + 2 * n_rooms as n_nodes, n_walls + n_rooms as n_meshes, 8 * n_walls + 4 * n_rooms + 2 * n_bent as n_vertices, 12 * n_walls + 2 * n_rooms + 2 * n_bent as n_triangles, cast(floor(area * 1e4 + 5e-1) as bigint) as floor_cm2 from p")
def s11_glb_export(spark, sf_dir):
    """Each plan's file, read again by its own accessors: concave floors have the area of their rings."""
    got = glb.read_glb(glb.glb_files(scene.build_scene(plans.parse_plans(cornered(spark, sf_dir), "plan_id", "doc"))))
    made = F.col("n_triangles") > 0
    area = F.sum(F.when(F.col("type") == "floor", F.col("area")).otherwise(0.0))
    return got.groupBy("plan_id").agg(F.count("*").alias("n_nodes"), F.count_if(made).alias("n_meshes"), F.sum("n_vertices").alias("n_vertices"), F.sum("n_triangles").alias("n_triangles"), F.floor(area * 1e4 + 0.5).alias("floor_cm2"))


def obj_numbers(batches):
    """Objects, vertices, faces, largest corner and thousandths of x of floors of four corners, of each plan's mesh text."""
    for batch in glb.few_plans(batches):
        rows = []
        for plan, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            objects, n_faces, last = [], 0, None
            for line in text.split("\n"):
                kind, *words = line.split(" ")
                if kind == "o":
                    objects.append((words[0], []))
                elif kind == "v":
                    objects[-1][1].append(math.floor(float(words[0]) * 1000.0 + 0.5))
                elif kind == "f":
                    n_faces, last = n_faces + 1, max(last or 0, *map(int, words))
            even = sum(sum(xs) for name, xs in objects if name.startswith("Floor") and len(xs) == 4)
            rows.append((plan, len(objects), sum(len(xs) for _, xs in objects), n_faces, last, even))
        names = ("plan_id", "n_objects", "n_vertices", "n_faces", "last_corner", "even_mm")
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(n, pa.int64()) for n in names]))


@query(WITH + WHOLE + ", x as (select plan_id, cast(sum(cast(round(case when k < 2 then x1 else x2 end * 1e3) as bigint) * case when ord % 2 = 1 then 0 else 1 end) as bigint) as even_mm from m, (select unnest([0, 1, 2, 3]) as k) where cls_id = 3 group by plan_id) select p.plan_id, n_walls + n_rooms as n_objects, 8 * n_walls + 4 * n_rooms + 2 * n_bent as n_vertices, 6 * n_walls + n_rooms as n_faces, 8 * n_walls + 4 * n_rooms + 2 * n_bent as last_corner, coalesce(even_mm, 0) as even_mm from p left join x on x.plan_id = p.plan_id")
def s11_obj_meshes(spark, sf_dir):
    """Each plan's mesh text, read line by line: objects, vertices, faces, the largest corner, and x of the square floors."""
    text = files.obj_text(scene.build_scene(plans.parse_plans(cornered(spark, sf_dir), "plan_id", "doc")))
    return text.mapInArrow(obj_numbers, "plan_id long, n_objects long, n_vertices long, n_faces long, last_corner long, even_mm long")
