"""Goldens of the plan operators, and random plans against a plain Python walk."""

import json
import math
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atrium.functions import geometry as g
from atrium.functions.text import fenced_block, fenced_json, label_text, prompt, status_icon, suffix
from atrium.model import DEFAULT, Config
from atrium.operators import dataset, detect, resolve, scene
from atrium.sources import files, plans
from atrium.sources.label_sink import write_label_files
from atrium.sources.svg import scan_svg, svg_class, svg_report

WALL = "plan_id int, ord int, wall_index int, sx double, sy double, ex double, ey double, thickness double, confidence double"


def wall_rows(spark, *segments, plan=1):
    return spark.createDataFrame([(plan, i, i, *map(float, s), 0.15, 1.0) for i, s in enumerate(segments)], WALL)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def samples(spark):
    return plans.sample_plans(spark).cache()


def test_sample_structure(samples):
    got = {r.plan_id: tuple(r)[1:] for r in samples.select("plan_id", *[F.size(c) for c in ("walls", "doors", "windows", "rooms")]).collect()}
    assert got == {"apartment": (5, 2, 2, 2), "studio": (6, 2, 2, 3), "three_bedroom": (9, 5, 6, 5)}


def test_sample_names(spark):
    assert plans.sample_plans(spark, "nothing").first().plan_id == "apartment"


def test_wall_lengths(samples):
    got = plans.walls(samples).withColumn("n", F.expr(g.length_sql())).groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("wall_index", "n"))).alias("x")).collect()
    assert {r.plan_id: [x.n for x in r.x] for r in got} == {"apartment": [6, 4, 6, 4, 4], "studio": [5, 4, 5, 4, 2, 1.5], "three_bedroom": [10, 8, 10, 8, 6, 4, 4, 4, 4]}


def test_room_areas_match_declared(samples):
    r = plans.rooms(samples)
    assert r.count() == 10
    assert r.where(F.abs(g.polygon_area(F.col("polygon")) - F.col("area")) > 1e-9).count() == 0


def test_vertex_mean_is_not_the_centroid(samples):
    x, y = g.vertex_mean(F.col("polygon"))
    r = plans.rooms(samples).where("label = 'main_room'").select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == (pytest.approx(2.4), pytest.approx(1.5))


def test_openings_along_walls(samples):
    for kind, want in {
        "door": {"apartment": [2, 1], "studio": [2.5, 0.7], "three_bedroom": [5, 1.5, 5, 2.5, 2]},
        "window": {"apartment": [1.5, 4.5], "studio": [1.5, 2], "three_bedroom": [8, 4.5, 1.5, 6, 6, 8]},
    }.items():
        got = scene.opening_on_wall(plans.openings(samples, kind), plans.walls(samples)).orderBy("plan_id", "opening_index").collect()
        for p, v in want.items():
            assert [r.along for r in got if r.plan_id == p] == pytest.approx(v)


def test_scene_counts(samples):
    got = {r.plan_id: r for r in scene.scene_counts(samples, with_ceiling=True).collect()}
    a = got["apartment"]
    assert (a.walls, a.floors, a.labels, a.ceilings) == (5, 2, 2, 2)
    assert a.summary == "5 walls, 2 doors, 2 windows, 2 floors, 2 ceilings, 2 labels"
    plain = {r.plan_id: r.summary for r in scene.scene_counts(samples).collect()}
    assert "ceilings" not in plain["studio"]


def test_scene_objects(samples):
    s = scene.build_scene(samples, 2.7, True).where("plan_id = 'apartment'").cache()
    assert {r.type: r["count"] for r in s.groupBy("type").count().collect()} == {"wall": 5, "floor": 2, "ceiling": 2, "label": 2}
    z = [v.z for r in s.where("type = 'ceiling'").collect() for v in r.vertices]
    assert z == pytest.approx([2.7] * len(z))
    assert [r.n_cuts for r in s.where("type = 'wall'").orderBy("wall_index").collect()] == [1, 0, 2, 0, 1]
    assert rows(s.where("type <> 'wall'"), "name") == [(f"{k}_{n}_{i}",) for k in ("Ceiling", "Floor", "Label") for n, i in (("bedroom", 1), ("living_room", 0))]
    assert rows(s.where("type = 'label'"), "text") == [("Bedroom",), ("Living Room",)]
    assert rows(scene.build_scene(samples, 2.7, True).where("plan_id = 'apartment'"), "name") == rows(s, "name")
    with pytest.raises(ValueError):
        scene.build_scene(samples, 20)


def test_defaults_and_positions(spark):
    doc = {"walls": [{"start": [0, 0], "end": [4, 0]}, {"start": [1, 1], "end": [1, 1], "thickness": None}], "doors": [{"position": 1.5}, {}, {"position": [1, 2, 3]}, {"position": [1, 0], "wall_index": 1}, {"position": [1, 0], "wall_index": 9}, {"position": [1, 0], "wall_index": -1}, {"position": "1.5"}], "windows": [{"position": None}], "rooms": [{}, {"polygon": [[0, 0], [1, 0]]}]}
    p = plans.parse_plans(spark.createDataFrame([("x", json.dumps(doc)), ("empty", "{}")], "id string, doc string"), "id", "doc")
    w, d = plans.walls(p), plans.openings(p, "door")
    assert rows(w, "wall_index", "thickness") == [(0, 0.15), (1, 0.15)]
    on = scene.opening_on_wall(d, w)
    assert rows(on, "opening_index", "along") == [(0, 1.5), (1, 0.0), (6, 1.5)]
    assert rows(scene.rejected_openings(d, w), "opening_index", "reason") == [(2, "position"), (3, "degenerate wall"), (4, "no such wall"), (5, "negative wall")]
    win = plans.openings(p, "window").first()
    assert (win.px, win.width, win.height, win.sill) == (0.0, 1.2, 1.2, 0.9)
    assert rows(plans.rooms(p), "room_index", "label") == [(0, "Room_0"), (1, "Room_1")]
    assert [r.summary for r in scene.scene_counts(p).collect()] == ["1 walls, 3 doors, 1 windows"]


def test_plan_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(plans.SAMPLES["studio"])
    (tmp_path / "b.json").write_text("{ not json")
    got = plans.read_plans(spark, f"file://{tmp_path}").cache()
    assert got.count() == 2
    assert got.where("_corrupt_record is not null").count() == 1
    assert plans.walls(got).count() == 6


@pytest.mark.parametrize(("p", "want"), [((2.5, 0), 0), ((2.5, 1), 1), ((7, 0), 2), ((-3, 0), 3)])
def test_point_segment(spark, p, want):
    df = spark.createDataFrame([(*map(float, p), 0.0, 0.0, 5.0, 0.0)], "x double, y double, sx double, sy double, ex double, ey double")
    assert df.select(F.expr(g.segment_distance_sql("x", "y"))).first()[0] == pytest.approx(want)


def test_point_segment_degenerate(spark):
    df = spark.createDataFrame([(3.0, 4.0, 0.0, 0.0, 0.0, 0.0)], "x double, y double, sx double, sy double, ex double, ey double")
    assert df.select(F.expr(g.segment_distance_sql("x", "y"))).first()[0] == 5


@pytest.mark.parametrize(("ring", "want"), [([[0, 0], [4, 0], [4, 3], [0, 3]], 12), ([[0, 0], [3, 0], [0, 4]], 6), ([[0, 0], [1, 0], [1, 1], [0, 1]], 1), ([[0, 3], [4, 3], [4, 0], [0, 0]], 12), ([[0, 0], [1, 1]], 0), ([], 0)])
def test_area(spark, ring, want):
    df = spark.createDataFrame([([[float(v) for v in p] for p in ring],)], "p array<array<double>>")
    assert df.select(g.polygon_area(F.col("p"))).first()[0] == want


def test_direction(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5.0, 0.0), (3.0, 0.0, 3.0, 4.0), (1.0, 1.0, 1.0, 1.0)], "sx double, sy double, ex double, ey double")
    d = g.direction(*map(F.col, ("sx", "sy", "ex", "ey")))
    assert [tuple(r) for r in df.select(*d).collect()] == [(1, 0, 5), (0, 1, 4), (1, 0, 0)]
    px, py = g.perpendicular(F.lit(1.0), F.lit(0.0))
    assert tuple(df.select(px, py).first()) == (0, 1)


@pytest.mark.parametrize("most", [60, 0])
def test_snap(spark, most):
    near = {r.wall_index: r for r in resolve.snap_ends(wall_rows(spark, (0, 0, 5.01, 0), (5, 0, 5, 4)), most_folded=most).collect()}
    assert (near[0].ex, near[0].ey) == (near[1].sx, near[1].sy) == (5.005, 0)
    far = wall_rows(spark, (0, 0, 3, 0), (5, 0, 5, 4))
    assert rows(resolve.snap_ends(far, most_folded=most)) == rows(far)
    one = wall_rows(spark, (0, 0, 3, 0))
    assert rows(resolve.snap_ends(one, most_folded=most)) == rows(one)
    assert resolve.snap_ends(one.where("false"), most_folded=most).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(*[st.integers(0, 30)] * 4), min_size=1, max_size=6), min_size=1, max_size=6))
def test_snap_like_a_walk(spark, some):
    cfg, want, data = Config(snap_threshold=0.35), [], []
    for k, segs in enumerate(some):
        pts = [[v / 10 for v in p] for s in segs for p in (s[:2], s[2:])]
        data += [(k, i, i, *pts[2 * i], *pts[2 * i + 1], 0.15, 1.0) for i in range(len(segs))]
        for i in range(len(segs)):
            for j in range(i + 1, len(segs)):
                for p in (2 * i, 2 * i + 1):
                    for q in (2 * j, 2 * j + 1):
                        dx, dy = pts[p][0] - pts[q][0], pts[p][1] - pts[q][1]
                        if 0 < math.sqrt(dx * dx + dy * dy) < 0.35:
                            mid = [round((pts[p][c] + pts[q][c]) / 2.0, 3) for c in (0, 1)]
                            pts[p], pts[q] = mid, list(mid)
        want += [(k, i, *pts[2 * i], *pts[2 * i + 1]) for i in range(len(segs))]
    for most in (60, 3, 0):
        assert rows(resolve.snap_ends(spark.createDataFrame(data, WALL), cfg, most), "plan_id", "wall_index", "sx", "sy", "ex", "ey") == sorted(want)


def test_nearest_wall(spark):
    w = wall_rows(spark, (0, 0, 5, 0), (5, 0, 5, 4))
    o = spark.createDataFrame([(1, 9, 2.5, 0.0), (1, 10, 5.0, 2.0), (2, 1, 0.0, 0.0)], "plan_id int, ord int, x double, y double")
    assert rows(resolve.nearest_wall(o, w, False), "ord", "wall_index") == [(1, 0), (9, 0), (10, 1)]


def test_prefix_nearest_wall(spark):
    w = wall_rows(spark, (0, 0, 5, 0), (5, 0, 5, 4)).withColumn("ord", F.col("wall_index") * 4 + 1)
    o = spark.createDataFrame([(1, 0, 5.0, 2.0), (1, 3, 5.0, 2.0), (1, 6, 5.0, 2.0)], "plan_id int, ord int, x double, y double")
    assert rows(resolve.nearest_wall(o, w), "ord", "wall_index") == [(0, 0), (3, 0), (6, 1)]


BOX = "plan_id int, ord int, cls_id int, conf double, x1 double, y1 double, x2 double, y2 double"


def test_boxes(spark):
    b = spark.createDataFrame([(1, 0, 0, 0.9, 0.0, 0.0, 100.0, 10.0), (1, 1, 0, 0.9, 0.0, 0.0, 50.0, 50.0), (1, 2, 1, 0.5, 0.0, 0.0, 20.0, 90.0), (1, 3, 2, 0.49, 0.0, 0.0, 20.0, 90.0), (1, 4, 2, 0.6, 0.0, 0.0, 40.0, 90.0), (1, 5, 9, 0.6, 0.0, 0.0, 1.0, 1.0)], BOX)
    m = detect.to_metres(detect.confident(b))
    assert rows(detect.wall_segments(m), "wall_index", "sx", "sy", "ex", "ey") == [(0, 0.0, 0.1, 2.0, 0.1), (1, 0.5, 0.0, 0.5, 1.0)]
    assert rows(detect.opening_boxes(m, "door"), "ord", "width") == [(2, 0.7)]
    assert rows(detect.opening_boxes(m, "window"), "ord", "width") == [(4, 0.8)]
    assert rows(b.select("ord", detect.class_name(F.col("cls_id")).alias("c")).where("ord in (0, 5)")) == [(0, "wall"), (5, "unknown")]


def test_lengths_either_side(spark):
    w = wall_rows(spark, (0, 0, 0.3, 0), (0, 0, 0.299, 0))
    assert rows(resolve.long_enough(w), "wall_index") == [(0,)]


def test_masks(spark):
    pt = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    square = pt((0, 0), (25, 1), (50, 0), (50, 50), (0, 50), (0, 0))
    m = spark.createDataFrame([(1, 0, 3, square), (1, 1, 0, square), (1, 2, 3, pt((0, 0), (9, 9))), (1, 3, 3, pt((0, 0), (40, 0), (40, 40), (0, 40))), (1, 4, 3, pt((0, 0), (200, 0), (200, 100), (0, 100)))], "plan_id int, mask_idx int, cls_id int, contour array<struct<x:double,y:double>>")
    got = detect.mask_polygons(m).orderBy("mask_idx").collect()
    assert [(r.label, r.area, len(r.polygon)) for r in got] == [("room_0", 1.0, 4), ("room_4", 8.0, 4)]


def test_zip_and_suppress(spark):
    p = spark.createDataFrame([(1, [3, 0], [[{"x": 0.0, "y": 0.0}], []])], "plan_id int, classes array<int>, contours array<array<struct<x:double,y:double>>>")
    assert rows(detect.zip_masks(p), "mask_idx", "cls_id") == [(0, 3), (1, 0)]
    b = spark.createDataFrame([(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 0.8, 0.0, 0.0, 10.0, 9.0), (1, 2, 1, 0.7, 0.0, 0.0, 10.0, 9.0)], BOX)
    assert rows(detect.suppress(b), "ord") == [(0,), (2,)]


def test_detector_seam(spark):
    images = spark.createDataFrame([(1, "/a.png"), (2, "/none.png")], "plan_id int, path string")
    found = detect.detect(images, lambda path: [{"cls_id": 0, "conf": 0.9, "x1": 0.0, "y1": 0.0, "x2": 9.0, "y2": 1.0}] if "a.png" in path else [])
    assert rows(found, "plan_id", "ord") == [(1, 0)]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(label_text(F.lit("room_1a"))) == "Room 1A"
    assert one(label_text(F.lit("o'neil suite"))) == "O'Neil Suite"
    assert one(fenced_json(F.lit('x\n```json\n{"a": 1}\n```')).cast("string")) == '{"a":1}'
    assert one(fenced_json(F.lit('```\n{bad\n```\n```\n{"a": 1}\n```'))) is None
    fences = {"```json  \n\n\n1\n```": "\n\n1", "Here: ```json\n{}\n```x": "{}", "  ```\n1\n2\n``` end": "1\n2", "```python\n1\n```": None, "```\n1": None, "```\n1\n  ```": None, "```\n\n```": "", "```\n```\nx\n```": "```\nx", "a\nb": None, "": None, "````json\r\n1\n```": "1", "```xjson\n1\n```\n2\n```": "2"}
    got = spark.createDataFrame([(t,) for t in fences] + [(None,)], "t string").select("t", fenced_block(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in got} == {**fences, None: None}
    assert [one(status_icon(F.lit(s))) for s in ("", "Ready", "Error: x", "Done", "Sample y", "Busy")] == [None, None, "ERROR", "CHECKMARK", "CHECKMARK", "INFO"]
    assert [one(suffix(F.lit(s))) for s in ("/a/B.OBJ", "/a/.hidden", "/a.b/c", "x.tar.gz")] == [".obj", "", "", ".gz"]
    assert '"a"' in one(prompt("furniture", F.struct(F.lit(1).alias("a")), F.lit("more light")))
    assert one(plans.choose_source(F.lit(""), F.lit("b.png"))).kind == "image"


SVG = '<svg xmlns="http://www.w3.org/2000/svg" id="Wall"><g id="Outer"><g id="Bedroom_1"><rect x="10" y="10" width="20" height="30"/><text/></g></g><g id="DoorWall"><line x1="0" y1="5" x2="50" y2="5"/></g><g id="Window"><polygon points="0,0 4,0 4,8"/><rect x="10px"/></g></svg>'


def test_svg(spark):
    d = spark.createDataFrame([("a", SVG), ("b", "<svg"), ("c", None)], "name string, svg string")
    got = scan_svg(d).collect()
    assert [(r.name, r.seq, r.cls_id, r.x0, r.y0, r.x1, r.y1) for r in got] == [("a", 0, 3, 10, 10, 30, 40), ("a", 1, 0, 0, 5, 50, 5), ("a", 2, 2, 0, 0, 4, 8)]
    assert rows(svg_report(d), "name", "n_rejected", "well_formed") == [("a", 1, True), ("b", 0, False), ("c", 0, False)]
    y = dataset.yolo_labels(scan_svg(d), F.lit(100.0), F.lit(100.0))
    assert rows(y, "seq", "cx", "cy", "w", "h") == [(0, 0.2, 0.25, 0.2, 0.3), (2, 0.02, 0.04, 0.04, 0.08)]  # the level line is dropped
    ids = spark.createDataFrame([("Bedroom",), ("DoorWall",), ("x",)], "i string")
    assert [r[0] for r in ids.select(svg_class(F.col("i"))).collect()] == [3, 0, None]


def png(w, h):
    return bytes.fromhex("89504e470d0a1a0a0000000d49484452") + struct.pack(">II", w, h) + b"\x08\x02\x00\x00\x00"


def test_dataset(spark, tmp_path):
    for i in range(20):
        d = tmp_path / "data" / f"s{i:02d}" / "x"
        d.mkdir(parents=True)
        (d / "model.svg").write_text(SVG)
        (d / ("F1_original.png" if i % 2 else "other.png")).write_bytes(png(100, 50))
        (d / "zz.png").write_bytes(png(1, 1))
    (tmp_path / "data" / "noimage").mkdir()
    (tmp_path / "data" / "noimage" / "model.svg").write_text(SVG)
    samples, labels = dataset.convert(spark, f"{tmp_path}/data")
    samples = samples.cache()
    assert samples.count() == 20
    assert {r.split: r["count"] for r in samples.groupBy("split").count().collect()} == {"test": 1, "val": 3, "train": 16}
    assert rows(samples.where("split = 'test'"), "name") == [("s19_x",)]  # the first of the seeded order
    assert labels.count() == 40
    content = files.label_lines(labels, samples)
    assert content.first().content.split("\n")[0] == "3 0.200000 0.500000 0.200000 0.600000"
    files.write_labels(content, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    images = samples.join(files.read_binary(spark, f"{tmp_path}/data").select(F.col("path").alias("image_path"), "content"), "image_path")
    write_label_files(content, images, f"{tmp_path}/tree")
    assert len(list((tmp_path / "tree/images").glob("*/*.png"))) == 20
    assert len(list((tmp_path / "tree/labels/val").iterdir())) == 3
    assert "nc: 4" in files.manifest("/x", ("wall", "door", "window", "room"))


def test_name_collision(spark):
    p = spark.createDataFrame([(f"/r/{d}/{f}",) for d in ("a/b_c", "a_b/c") for f in ("model.svg", "image.png")], "path string")
    with pytest.raises(Exception, match="not unique"):
        dataset.find_samples(p, "/r").collect()


def test_path_order(spark):
    p = spark.createDataFrame([("a-b/x",), ("a/x",)], "p string")
    assert [r.p for r in p.orderBy(dataset.path_parts(F.col("p"))).collect()] == ["a/x", "a-b/x"]


def test_height_and_materials(spark):
    o = spark.createDataFrame([("wall", 2.7), ("wall", None), ("ceiling", None), ("label", None)], "type string, height double")
    once = scene.adjust_height(o, 3.0)
    assert rows(scene.adjust_height(once, 3.0), "type", "scale_z") == rows(once, "type", "scale_z")
    assert {r.type: r.r for r in scene.with_materials(o).collect()} == {"wall": 0.92, "ceiling": 0.95, "label": None}


def test_sinks(spark, samples, tmp_path):
    o = files.obj_text(scene.build_scene(samples)).where("plan_id = 'apartment'").first().obj
    n = o.count("\nv ")
    assert n > 5 * 8 + 2 * 4 and o.count("\no ") + o.startswith("o ") == 7
    assert max(int(i) for line in o.splitlines() if line.startswith("f ") for i in line.split()[1:]) == n
    back = plans.parse_plans(files.json_documents(samples), "plan_id", "json")
    assert rows(plans.walls(back)) == rows(plans.walls(samples))
    assert [files.export_kind(p) for p in ("a.OBJ", "a.glb", "b.gltf", "c.fbx")] == ["obj", "gltf", "gltf", "fbx"]
    with pytest.raises(ValueError):
        files.export_kind("a.stl")
    (tmp_path / "c.yaml").write_text("model:\n  classes: [wall]\n")
    assert files.load_config(spark, f"{tmp_path}/c.yaml") == {"model": {"classes": ["wall"]}}
    assert DEFAULT.snap_threshold == 0.1


def test_stream(spark, tmp_path):
    from atrium.streaming.plans import read_scenes, stream_plans, write_scenes

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(plans.SAMPLES["apartment"])
    q = write_scenes(stream_plans(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert read_scenes(spark, f"{tmp_path}/out", scene.build_scene(plans.sample_plans(spark)).schema).count() == 9
