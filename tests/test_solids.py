"""Cut walls, valid rings, simplified contours, snapping of large plans, exact rounding and meshes, each against plain Python."""

import itertools
import json
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atrium.functions import geometry as g
from atrium.functions.simplify import simplified, simplify_ring
from atrium.functions.triangles import clip_ears, clip_few, flattened, triangles
from atrium.model import Config
from atrium.operators import detect, difference, resolve, scene, sweep
from atrium.operators.snapping import snap_points
from atrium.sources import files, glb, plans

WALL = "plan_id int, wall_index int, sx double, sy double, ex double, ey double, thickness double"
OPENING = "plan_id int, kind string, opening_index int, px double, py double, along double, bad_position boolean, width double, height double, sill double, wall_index int"


def cut(spark, walls, openings, height=2.7):
    """walls: (index, ends..., thickness); openings: (wall, along, width, height, sill)."""
    w = spark.createDataFrame([(1, *x) for x in walls], WALL)
    o = spark.createDataFrame([(1, "door", i, None, None, float(a), False, float(b), float(h), float(s), k) for i, (k, a, b, h, s) in enumerate(openings)], OPENING)
    d = difference.wall_difference(w, scene.opening_on_wall(o, w), height)
    mesh = (difference.mesh_volume(F.col("vertices"), F.col("faces")).alias("inside"), difference.mesh_area(F.col("vertices"), F.col("faces")).alias("skin"))
    return {r.wall_index: r for r in d.select("*", *mesh).collect()}


def union_area(rects):
    us, zs = (sorted({x[k] for x in rects} | {x[k + 1] for x in rects}) for k in (0, 2))
    return sum((b - a) * (d - c) for a, b in itertools.pairwise(us) for c, d in itertools.pairwise(zs) if any(r[0] <= a and b <= r[1] and r[2] <= c and d <= r[3] for r in rects))


def test_holes_of_a_wall(spark):
    walls = [(i, 0.0, float(i), 4.0, float(i), 0.2) for i in range(8)]
    openings = [
        (1, 1, 1, 2.1, 0), (2, 1, 1, 1.2, 0.9), (3, 1, 1, 2, 0), (3, 1.5, 1, 2.5, 0),  # a door, a window, two doors that overlap
        (4, 0, 1, 2.1, 0), (4, 4, 2, 9, 0), (4, 9, 1, 1, 0),  # over both ends, over the top, wholly beside
        (5, 2, 9, 9, 0), (6, 2, 1, 0.5, 1), (6, 2, 0.5, 1.5, 0.5), (7, 1, 1, 1, 1), (7, 2, 1, 1, 0), (9, 1, 1, 1, 1),  # all of it, a cross, holes that meet in a corner, no wall
    ]
    got = cut(spark, walls, openings)
    assert {k: r.n_cuts for k, r in got.items()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 1, 6: 2, 7: 2}
    gone = {0: 0, 1: 2.1, 2: 1.2, 3: 2 + 0.5 * 2.5 + 0.5 * 0.5, 4: 1.05 + 2.7, 5: 4 * 2.7, 6: 1.0, 7: 2.0}
    for k, area in gone.items():
        assert got[k].face_area == pytest.approx(10.8 - area) and got[k].volume == pytest.approx(0.2 * (10.8 - area)) and got[k].inside == pytest.approx(got[k].volume)
    assert len(got[0].vertices) == 8 and got[5].vertices == [] and got[5].faces == []
    rim = {1: 2 * 4 + 2 * 2.7 + 2 * 2.1, 2: 2 * 6.7 + 4.4, 6: 2 * 6.7 + 5.0}  # of the face, its holes included
    for k, n in rim.items():
        assert got[k].skin == pytest.approx(2 * got[k].face_area + 0.2 * n)


def test_holes_of_random_walls(spark):
    """Slanted walls with many openings: the mesh is closed and holds the prism less the union of its cutters."""
    rng = random.Random(4)
    walls = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(6, 9), rng.uniform(6, 9), rng.choice((0.1, 0.2))) for i in range(12)]
    openings = [(rng.randrange(12), rng.uniform(-1, 12), rng.uniform(0.1, 5), rng.uniform(0.1, 3), rng.uniform(0, 2.5)) for _ in range(70)]
    got = cut(spark, walls, openings)
    for i, sx, sy, ex, ey, t in walls:
        n = math.hypot(ex - sx, ey - sy)
        rects = [(max(0, a - b / 2), min(n, a + b / 2), max(0, s), min(2.7, s + h)) for k, a, b, h, s in openings if k == i]
        left = n * 2.7 - union_area([r for r in rects if r[0] < r[1] and r[2] < r[3]])
        assert got[i].face_area == pytest.approx(left) and got[i].inside == pytest.approx(left * t)
        # Closed: the directed sides of all faces add up to nothing.
        total = sum(np.array([v[b][c] - v[a][c] for c in "xyz"]) for v, f in [(got[i].vertices, q) for q in got[i].faces] for a, b in zip(f, f[1:] + f[:1], strict=True))
        assert np.allclose(total, 0)


def test_cut_scene(spark):
    s = scene.build_scene(plans.sample_plans(spark, "apartment"))
    v = {r.wall_index: r.v for r in s.where("type = 'wall'").select("wall_index", difference.mesh_volume(F.col("vertices"), F.col("faces")).alias("v")).collect()}
    assert v == pytest.approx({0: 0.15 * (16.2 - 1.89), 1: 0.15 * 10.8, 2: 0.15 * (16.2 - 1.44 - 1.2), 3: 0.15 * 10.8, 4: 0.1 * (10.8 - 1.89)})


def crosses(p):
    """Brute: any two sides that meet elsewhere than at a common corner, exact for whole numbers."""
    n = len(p)
    turn = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    between = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    for i, j in itertools.combinations(range(n), 2):
        a, b, c, d = p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]
        if j == i + 1 or (i == 0 and j == n - 1):
            far, joint, near = (d, b, a) if j == i + 1 else (c, a, b)
            if turn(near, joint, far) == 0 and np.dot(np.subtract(near, joint), np.subtract(far, joint)) > 0:
                return True
            continue
        if turn(a, b, c) != turn(a, b, d) and turn(c, d, a) != turn(c, d, b):
            return True
        if any(turn(*s, q) == 0 and between(*s, q) for s, q in (((a, b), c), ((a, b), d), ((c, d), a), ((c, d), b))):
            return True
    return False


def spiral(turns, gap, rng):
    """A band that winds inwards and back, rough by less than half a gap."""
    out, back = [], []
    for k in range(turns * 24):
        a, r = k * math.pi / 12, 20 + gap * 2 * (turns * 24 - k) / 24
        out.append((r * math.cos(a) + rng.uniform(-0.2, 0.2) * gap, r * math.sin(a) + rng.uniform(-0.2, 0.2) * gap))
        back.append(((r + gap) * math.cos(a) + rng.uniform(-0.2, 0.2) * gap, (r + gap) * math.sin(a) + rng.uniform(-0.2, 0.2) * gap))
    return [(round(x, 2), round(y, 2)) for x, y in out + back[::-1]]


def test_simplified_rings_never_cross():
    rng = random.Random(6)
    dent = [(0, 0), (180, 0), (200, -4), (220, 0), (400, 0), (400, 400), (202, 400), (200, -2), (198, 400), (0, 400)]
    rings = [dent] + [spiral(t, gap, rng) for t in (2, 3) for gap in (3, 5, 9) for _ in range(3)]
    for _ in range(30):  # star shapes with thin spikes and dents
        rings.append([(round(r * math.cos(a)), round(r * math.sin(a))) for a, r in ((k * math.pi / 20, rng.choice((100, 103, 97, 40, 200))) for k in range(40))])
    fewer = 0
    for ring in rings:
        if crosses(ring):
            continue
        x, y = simplify_ring(*np.array(ring, float).T, 5.0)
        out = list(zip(x.tolist(), y.tolist(), strict=True))
        assert len(out) >= 3 and not crosses(out)
        assert set(out) <= set(ring)
        fewer += len(ring) - len(out)
    assert fewer > 100
    assert len(simplify_ring(*np.array(dent, float).T, 5.0)[0]) == 8


def test_simplified_edge_cases():
    cases = [None, [], [(0, 0), (1, 1)], [(0, 0), (0, 0), (0, 0)], [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(0, 0), (900, 3), (450, 4)], [(0, 0), (100, 1), (200, 0), (100, -1)], [(0, 0), (1, None), (2, 2)], [(0, 0), (math.inf, 0), (2, 2)]]
    col = pa.array([None if c is None else [{"x": x, "y": y} for x, y in c] for c in cases], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    got = simplified(col, 5.0).to_pylist()
    assert [len(x) for x in got] == [0, 0, 0, 1, 4, 3, 3, 0, 0]
    assert got[4] == [[0, 0], [9, 0], [9, 9], [0, 9]]
    assert simplified(col.slice(4, 2), 5.0).to_pylist() == got[4:6]
    many = np.linspace(0, 2 * math.pi, 20_001)[:-1]
    began = time.time()
    x, y = simplify_ring(1e4 * np.cos(many), 1e4 * np.sin(many), 5.0)
    assert 20 < len(x) < 200 and time.time() - began < 20


def fault(p):
    if len(p or []) < 3:
        return "few points"
    if any(len(v) != 2 or any(x is None or not math.isfinite(x) for x in v) for v in p):
        return "bad point"
    turn = lambda a, b, c: (lambda t: 0 if abs(t) <= 1e-9 else math.copysign(1, t))((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    if all(turn(p[0], p[i], p[i + 1]) == 0 for i in range(1, len(p) - 1)):
        return "no area"
    if len({tuple(v) for v in p}) < len(p):
        return "repeated point"
    n = len(p)
    for i, j in itertools.combinations(range(n), 2):
        if j > i + 1 and not (i == 0 and j == n - 1):
            a, b, c, d = p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]
            o = [turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)]
            box = all(max(min(a[k], b[k]), min(c[k], d[k])) <= min(max(a[k], b[k]), max(c[k], d[k])) for k in (0, 1))
            if o[0] != o[1] and o[2] != o[3] or o[0] == o[1] == 0 and box:
                return "crossing"
    return None


def test_ring_faults(spark):
    rng = random.Random(9)
    rings = [None, [], [[0, 0], [1, 1]], [[0, 0], [1, 0], [2, 0]], [[0, 0], [2, 2], [2, 0], [0, 2]], [[0, 0], [1, 0], [1, None]], [[0, 0], [1, 0], [1]], [[0, 0], [4, 0], [4, 4], [4, 0], [0, 4]], [[0, 0], [4, 0], [2, 0], [2, 2]], [[0, 0], [math.nan, 0], [2, 0]], [[0, 0], [4, 0], [4, 4], [2, 0], [0, 4]]]
    rings += [[[float(rng.randrange(5)), float(rng.randrange(5))] for _ in range(rng.randrange(3, 9))] for _ in range(150)]
    rings = [r if r is None else [[None if x is None else float(x) for x in v] for v in r] for r in rings]
    df = spark.createDataFrame(list(enumerate(rings)), "i int, p array<array<double>>")
    got = [r.f for r in df.select("i", g.ring_fault(F.col("p")).alias("f")).orderBy("i").collect()]
    assert got == [fault(r) for r in rings]
    assert {"crossing", "no area", "repeated point", None} <= set(got)


def test_area_of_rectangles_is_width_times_height(spark):
    """rooms of just the least area, which a sum over far corners missed by its last digit."""
    boxes = [(a / 50, b / 50, (a + w) / 50, (b + h) / 50) for a in range(0, 300, 7) for b in range(0, 250, 11) for w, h in ((50, 50), (40, 62.5), (25, 100))]
    df = spark.createDataFrame([(i, [[x, y], [u, y], [u, v], [x, v]], (u - x) * (v - y)) for i, (x, y, u, v) in enumerate(boxes)], "i int, p array<array<double>>, a double")
    assert df.where(g.polygon_area(F.col("p")) != F.col("a")).count() == 0


def test_rejected_rooms(spark):
    doc = {"rooms": [{"polygon": [[0, 0], [2, 2], [2, 0], [0, 2]]}, {"polygon": [[0, 0], [1, 0], [2, 0]]}, {"polygon": [[0, 0], [1, 0], [1, 1]]}, {"polygon": [[0, 0]]}, {}]}
    r = plans.rooms(plans.parse_plans(spark.createDataFrame([(1, json.dumps(doc))], "id int, doc string"), "id", "doc"))
    assert [tuple(x) for x in scene.slabs(r, "floor").orderBy("room_index").select("name", "fault").collect()] == [("Floor_Room_0_0", "crossing"), ("Floor_Room_2_2", None)]
    assert [tuple(x)[1:] for x in scene.rejected_rooms(r).orderBy("room_index").select("label", "room_index", "reason", "made").collect()] == [(0, "crossing", True), (1, "no area", False), (3, "few points", False), (4, "few points", False)]


def walk(pts, threshold):
    pts = [list(p) for p in pts]
    for i in range(len(pts) // 2):
        for j in range(i + 1, len(pts) // 2):
            for p in (2 * i, 2 * i + 1):
                for q in (2 * j, 2 * j + 1):
                    if abs(pts[p][0] - pts[q][0]) < threshold and 0 < ((pts[p][0] - pts[q][0]) ** 2 + (pts[p][1] - pts[q][1]) ** 2) ** 0.5 < threshold:
                        mid = [round((pts[p][k] + pts[q][k]) / 2, 3) for k in (0, 1)]
                        pts[p], pts[q] = list(mid), list(mid)
    return pts


def test_snap_of_a_large_plan(spark):
    """2,000 walls as a plain loop over their 8 million pairs of ends leaves them, in time that follows the ends."""
    rng = random.Random(1)
    some = lambda n, size: [[rng.uniform(0, size), rng.uniform(0, size)] for _ in range(2 * n)]
    pts = some(2000, 30.0)
    want = walk(pts, 0.35)
    assert want != pts
    began = time.time()
    assert snap_points(pts, 0.35) == want
    small = time.time() - began
    began = time.time()
    snap_points(some(16_000, 30.0 * 8**0.5), 0.35)
    assert time.time() - began < 40 * small + 2  # 64 times the pairs
    rows = [(1, i, *pts[2 * i], *pts[2 * i + 1], 0.1) for i in range(2000)] + [(2, 0, 0.0, 0.0, 1.0, 0.0, 0.1), (2, 1, 1.01, 0.0, 2.0, None, 0.1)]
    got = resolve.snap_ends(spark.createDataFrame(rows, WALL), Config(snap_threshold=0.35)).orderBy("plan_id", "wall_index").collect()
    assert [[(r.sx, r.sy), (r.ex, r.ey)] for r in got if r.plan_id == 1] == [[tuple(want[2 * i]), tuple(want[2 * i + 1])] for i in range(2000)]
    assert [tuple(r)[2:6] for r in got if r.plan_id == 2] == [(0.0, 0.0, 1.005, 0.0), (1.005, 0.0, 2.0, None)]


def test_rounding_is_pythons(spark):
    """All of k * 7 / 20000, where plain rounding differs in some 3,700, and odd numbers."""
    odd = [0.0005, 0.0015, 0.0025, 2.5, 1.0005, 1.2345, 1e15 + 0.5, 4503599627370.4975, 1e300, 5e-324, 0.1 + 0.2, -0.0005, -1.2345, -2.0015]
    df = spark.range(200_001).select((F.col("id") * 7 / F.lit(20000.0)).alias("x")).unionAll(spark.createDataFrame([(x,) for x in odd], "x double"))
    rows = df.select("x", g.round_exact(F.col("x"), 3).alias("r3"), g.round_exact(F.col("x"), 2).alias("r2")).collect()
    assert not [r for r in rows if r.r3 != round(r.x, 3) or r.r2 != round(r.x, 2)]
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.choice((1, -1)) * rng.randrange(10**7) / rng.choice((2000, 20000, 16, 3)),) for _ in range(50_000)], "x double").select("x", g.round3(F.col("x")).alias("r")).collect()
    assert not [r for r in rows if r.r != round(r.x, 3)]


def area(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def test_ears():
    """Triangles of concave rings, flat corners and both windings have the ring's area and stay inside it."""
    rng = random.Random(5)
    rings = [[(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(0, 0), (1, 0), (2, 0), (2, 2), (1, 2), (0, 2)], [(0, 0), (0, 3), (3, 3), (3, 0)]]
    for _ in range(2000):  # of an L one diagonal goes through the inner corner, but for rounding
        x, y = rng.randrange(300) / 50, rng.randrange(250) / 50
        u, v = x + (5 + rng.randrange(90)) / 50, y + (5 + rng.randrange(70)) / 50
        rings.append([(x, y), (u, y), (u, (y + v) / 2), ((x + u) / 2, (y + v) / 2), ((x + u) / 2, v), (x, v)])
    for n in (5, 9, 30, 80):
        rings += [[(r * math.cos(a), r * math.sin(a)) for a, r in ((2 * math.pi * k / n, rng.uniform(1, 9)) for k in range(n))] for _ in range(5)]
    for ring in rings + [r[::-1] for r in rings]:
        p = flattened(np.array([(*v, 2.0) for v in ring]))
        tri = clip_ears(p)
        sizes = [area([tuple(p[i]) for i in t]) for t in tri]
        assert len(tri) == len(ring) - 2 and min(sizes) >= -1e-12
        assert sum(sizes) == pytest.approx(abs(area(ring)))
    upright = np.array([(1.0, 0, 0), (1, 4, 0), (1, 4, 4), (1, 2, 1), (1, 0, 4)])
    cut = triangles(upright, np.arange(5), np.array([0, 5]))
    assert sum(np.linalg.norm(np.cross(upright[b] - upright[a], upright[c] - upright[a])) / 2 for a, b, c in cut) == pytest.approx(10)
    outward = [np.cross(upright[b] - upright[a], upright[c] - upright[a])[0] for a, b, c in cut]
    assert min(outward) >= 0  # as the face is wound


def test_glb(spark):
    files = glb.glb_files(scene.build_scene(plans.sample_plans(spark), with_ceiling=True)).cache()
    data = {r.plan_id: bytes(r.glb) for r in files.collect()}["studio"]
    assert data[:4] == b"glTF" and len(data) % 4 == 0
    size = int.from_bytes(data[12:16], "little")
    head = json.loads(data[20 : 20 + size])
    assert [m["name"] for m in head["materials"]] == ["Wall", "Floor", "Ceiling"]
    assert head["buffers"][0]["byteLength"] == len(data) - 28 - size
    for v in head["bufferViews"]:
        assert v["byteOffset"] % 4 == 0 and v["byteOffset"] + v["byteLength"] <= head["buffers"][0]["byteLength"]
    assert max(a["max"][1] for a in head["accessors"] if "max" in a) == pytest.approx(2.7)  # upwards is y
    got = {(r.plan_id, r.name): r for r in glb.read_glb(files).collect()}
    assert len(got) == 11 + 6 + 9 + 9 + 3 * 5
    assert got["studio", "Floor_main_room_0"].n_triangles == 3 and got["studio", "Floor_main_room_0"].area == pytest.approx(12.5)
    assert got["studio", "Label_main_room_0"].text == "Main Room" and got["studio", "Label_main_room_0"].n_triangles == 0
    assert got["studio", "Wall_0"].area == pytest.approx(2 * (5 * 2.7 - 0.9 * 2.1) + 0.15 * (2 * 5 + 2 * 2.7 + 2 * 2.1), rel=1e-5)
    with pytest.raises(ValueError):
        glb.parts(b"abcd" + data[4:])
    assert glb.glb_files(scene.build_scene(plans.sample_plans(spark).where("false"))).count() == 0


def test_files_are_made_few_plans_at_a_time():
    """a batch of many plans leaves as several, so that their files don't all stand in memory."""
    corner = [{"x": float(x), "y": float(y), "z": 0.0} for x, y in ((0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (0, 2))]
    o = {"type": "floor", "source_index": 0, "name": "Floor_a_0", "text": None, "vertices": corner, "faces": [[0, 1, 2, 3, 4, 5]]}
    point = pa.struct([(k, pa.float64()) for k in "xyz"])
    kind = pa.struct([("type", pa.string()), ("source_index", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("vertices", pa.list_(point)), ("faces", pa.list_(pa.list_(pa.int32())))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([[o] * (i % 3) for i in range(1000)], pa.list_(kind))], names=["plan_id", "objects"])
    for write in (glb.write_glb, files.write_obj):
        out = list(write(iter([batch])))
        assert max(b.num_rows for b in out) <= glb.PLANS and [p for b in out for p in b.columns[0].to_pylist()] == list(range(1000))
    made = [d for b in glb.write_glb(iter([batch])) for d in b.columns[1].to_pylist()]
    assert [[t.shape for *_, t in glb.parts(d)] for d in made[:3]] == [[], [(4, 3, 3)], [(4, 3, 3)] * 2]


def test_ears_by_plain_numbers():
    rng = np.random.default_rng(3)
    for n in range(4, 17):
        for _ in range(20):
            angle = np.sort(rng.uniform(0, 2 * math.pi, n))
            ring = np.stack((np.cos(angle), np.sin(angle)), axis=1) * rng.uniform(0.3, 2, (n, 1))
            assert clip_few(*ring.T.tolist()) == clip_ears(ring)


def test_many_holes_are_swept_as_few():
    """walls of many holes by themselves, of few together; both leave the same."""
    rng = np.random.default_rng(8)
    n, h = 30, 5
    length, u0, z0 = rng.uniform(3, 9, n), np.sort(rng.integers(0, 6, n * h) / 2), rng.integers(0, 4, n * h) / 2
    rect, at = [u0, u0 + 0.5 + rng.integers(0, 2, n * h), z0, np.minimum(z0 + 0.5, 2.7)], np.arange(0, n * h + 1, h)
    rect[1] = np.minimum(rect[1], np.repeat(length, h))
    some, one = sweep.sweep(length, rect, at[:-1], at[1:], 2.7), sweep.sweep(length, rect, at[:-1], at[1:], 2.7, together=0)
    for a, b in zip(some[:3], one[:3], strict=True):
        assert sorted(zip(*[c.tolist() for c in a], strict=True)) == sorted(zip(*[c.tolist() for c in b], strict=True))
    assert np.allclose(some[3], one[3])


def test_masks_without_numbers(spark):
    m = spark.createDataFrame([(1, 0, 3, None), (1, 1, 3, [{"x": 0.0, "y": None}] * 4), (1, 2, 3, [{"x": 0.0, "y": 0.0}, {"x": 100.0, "y": 0.0}, {"x": 100.0, "y": 100.0}, {"x": 0.0, "y": 100.0}])], "plan_id int, mask_idx int, cls_id int, contour array<struct<x:double,y:double>>")
    assert [(r.label, r.area) for r in detect.mask_polygons(m).collect()] == [("room_2", 4.0)]
