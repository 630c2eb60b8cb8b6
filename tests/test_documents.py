"""Sinks, archives, streams, strict reading, places in an order and the detector's limits."""

import io
import json
import os
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from atrium.model import DEFAULT, configured
from atrium.operators import dataset, detect, scene
from atrium.operators.ranks import global_rank
from atrium.sources import archive, label_sink, plans
from atrium.sources.strict import strict_faults
from atrium.streaming.plans import read_scenes, replace_scenes, stream_documents, write_scenes


def test_global_rank(spark):
    rng = random.Random(7)
    values = [rng.choice((None, 0, 1, 2, *range(100))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long").repartition(7)
    got = {r.i: r["at"] for r in global_rank(df, "v", "i", name="at").collect()}
    order = sorted(range(500), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: at for at, i in enumerate(order)}
    down = global_rank(df.where("v is not null"), F.col("v").desc(), "i")
    assert down.orderBy("rank").first().v == 99 and down.agg(F.max("rank")).first()[0] == sum(v is not None for v in values) - 1
    assert global_rank(df.where("false"), "v").count() == 0
    plan = dataset.seeded_split(df.select(F.col("i").cast("string").alias("dir")))._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_seeded_split(spark):
    df = spark.createDataFrame([(f"s{i:02d}",) for i in range(20)], "dir string").repartition(5)
    got = {r.dir: (r.position, r.split) for r in dataset.seeded_split(df).collect()}
    order = list(range(20))
    random.Random(42).shuffle(order)
    assert got == {f"s{rank:02d}": (at, "test" if at < 1 else "val" if at < 4 else "train") for at, rank in enumerate(order)}


def labelled(spark, names, bad=None):
    text = F.when(F.col("name") == bad, F.raise_error(F.lit("broken"))).otherwise(F.concat(F.lit("0 "), "name")).cast("string")
    return spark.createDataFrame([(n, ("train", "val")[i % 2]) for i, n in enumerate(names)], "name string, split string").repartition(4).withColumn("content", F.when(F.col("name") == "empty", "").otherwise(text))


def test_label_files(spark, tmp_path):
    """A set is there as a whole or not at all, and takes the place of the one before."""
    out = f"{tmp_path}/set"
    names = [*(f"s{i}" for i in range(20)), "empty", "naïve name"]
    images = spark.createDataFrame([("s1", b"png")], "name string, content binary")
    label_sink.write_label_files(labelled(spark, names), images, out)
    got = {(r.split, r.name): r.content for r in label_sink.read_label_files(spark, out).collect()}
    assert got == {(("train", "val")[i % 2], n): "" if n == "empty" else f"0 {n}" for i, n in enumerate(names)}
    assert (tmp_path / "set/images/val/s1.png").read_bytes() == b"png"
    with pytest.raises(Exception, match="broken"):
        label_sink.write_label_files(labelled(spark, names, bad="s7"), None, out)
    assert {(r.split, r.name): r.content for r in label_sink.read_label_files(spark, out).collect()} == got
    assert os.listdir(tmp_path) == ["set"]  # nothing of the failed job
    with pytest.raises(Exception, match="not a file name"):
        label_sink.write_label_files(labelled(spark, ["../x"]), None, out)
    label_sink.write_label_files(labelled(spark, ["only"]), None, f"file://{out}")
    assert [(r.split, r.name) for r in label_sink.read_label_files(spark, out).collect()] == [("train", "only")]
    label_sink.write_label_files(labelled(spark, ["only"]).where("false"), None, out)
    assert label_sink.read_label_files(spark, out).count() == 0


def test_archive(spark):
    """The pieces in order are a file that the standard reader opens and finds whole."""
    content = {f"a/f{i:03d}.txt": (b"line %d\n" % i) * (i % 50) for i in range(120)} | {"é.bin": bytes(range(256)) * 40, "empty": b"", "b/__pycache__/x": b"1", "c.pyc": b"1"}
    files = spark.createDataFrame([(f"/r/{k}", v) for k, v in content.items()] + [("/r/none", None)], "path string, content binary").repartition(5)
    pieces = archive.archive(files, "/r", "pkg").orderBy("place").collect()
    data = b"".join(bytes(r.part) for r in pieces)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        want = {f"pkg/{k}": v for k, v in content.items() if "__pycache__" not in k and not k.endswith(".pyc")} | {"pkg/none": b""}
        assert z.namelist() == sorted(want) and {n: z.read(n) for n in z.namelist()} == want
    none = archive.archive(files.where("false"), "/r", "pkg").collect()
    assert zipfile.ZipFile(io.BytesIO(b"".join(bytes(r.part) for r in none))).namelist() == []


def test_large_archive_records():
    """Beyond 65,535 entries the end has the large form; the standard reader follows it."""
    part = archive.LOCAL + b"\x2d\0\0\x08\x08\0\0\0\x21\0" + bytes(4) + b"\x02\0\0\0" + bytes(4) + b"\x01\0\0\0a\x03\0"
    directory = archive.directory_entry("a", 0, 0, 2, 0) * 70_000
    with zipfile.ZipFile(io.BytesIO(part + directory + archive.end_of(70_000, len(directory), len(part)))) as z:
        assert len(z.infolist()) == 70_000
    big = archive.directory_entry("a", 0, 0, 2, 5_000_000_000)
    assert int.from_bytes(big[-8:], "little") == 5_000_000_000 and big[42:46] == b"\xff" * 4


def test_scenes_are_replaced(spark, tmp_path):
    docs = {i: {"walls": [{"start": [0, 0], "end": [i + 1, 0]}] * (i % 3), "rooms": [{"polygon": [[0, 0], [1, 0], [1, 1]]}]} for i in range(12)}
    put = lambda d: spark.createDataFrame([(k, json.dumps(v)) for k, v in d.items()], "plan_id long, doc string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: write_scenes(stream_documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", buckets=3).awaitTermination()
    schema = scene.build_scene(plans.sample_plans(spark)).schema
    schema["plan_id"].dataType = spark.createDataFrame([], "plan_id long").schema["plan_id"].dataType
    counts = lambda: {r.plan_id: r.n for r in read_scenes(spark, f"{tmp_path}/out", schema).groupBy("plan_id").agg(F.count("*").alias("n")).collect()}
    put(docs)
    run()
    assert counts() == {i: i % 3 + 2 for i in range(12)}
    before = {f for f in os.listdir(f"{tmp_path}/out/bucket=0")}
    put({k: {"rooms": docs[k]["rooms"] * 3} for k in (2, 5)} | {7: {}})
    run()
    assert counts() == {i: 6 if i in (2, 5) else i % 3 + 2 for i in range(12) if i != 7}
    put({i: {} for i in range(12)})
    run()
    assert counts() == {} and {f for f in os.listdir(f"{tmp_path}/out/bucket=0")} != before
    run()  # nothing new
    put({3: docs[2]})
    run()
    assert counts() == {3: 4}


def test_strict_faults(spark):
    fine = plans.SAMPLES["studio"]
    cases = {
        fine: [],
        "{}": [],
        '{"walls": [{"start": [0, 0], "end": [1, 1], "thickness": 1e-1}], "doors": [{"position": 1.5}, {"position": "1.5"}, {}], "rooms": [{"area": null}, {}]}': [],
        None: [("$", "not json")],
        "": [("$", "not json")],
        "null": [("$", "type")],
        "3": [("$", "type")],
        '{"walls": null, "rooms": {}, "scale": {"pixels_per_meter": null}}': [("$.walls", "null"), ("$.rooms", "type"), ("$.scale.pixels_per_meter", "null")],
        '{"walls": [{"end": [1, "a"]}, {"start": null, "end": [null, 1]}, []]}': [("$.walls[0].start", "missing"), ("$.walls[0].end", "type"), ("$.walls[1].start", "null"), ("$.walls[1].end", "null"), ("$.walls[2]", "type")],
        '{"doors": [{"position": [1, 2, 3]}, {"position": null}, {"position": {}}, {"wall_index": "0"}]}': [("$.doors[0].position", "length"), ("$.doors[1].position", "null"), ("$.doors[2].position", "type"), ("$.doors[3].wall_index", "type")],
        '{"windows": [{"sill_height": true}], "rooms": [{"label": null, "polygon": null}, {"polygon": [[1, 2], 3, []]}]}': [("$.windows[0].sill_height", "type"), ("$.rooms[0].label", "null"), ("$.rooms[0].polygon", "null"), ("$.rooms[1].polygon[1]", "type"), ("$.rooms[1].polygon[2]", "length")],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "plan_id int, doc string")
    got = {}
    for r in strict_faults(df).collect():
        got.setdefault(r.plan_id, []).append((r.path, r.fault))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in enumerate(cases.values()) if v}


def test_detector_limits(spark):
    images = spark.createDataFrame([(1, "good"), (2, "slow"), (3, "bad"), (4, "none"), (None, "good")], "plan_id long, path string").coalesce(1)

    def detector(path):
        if path == "slow":
            time.sleep(30)
        if path == "bad":
            raise ValueError("not an image")
        return [{"cls_id": 0, "conf": 0.9, "x1": 0.0, "y1": 0.0, "x2": 9.0, "y2": 1.0}] * (2 if path == "good" else 0)

    got = sorted(tuple(r) for r in detect.detect(images, detector, seconds=1.0).select(F.coalesce("plan_id", F.lit(9)), F.coalesce("ord", F.lit(-1)), "x2", "error").collect())
    assert got == [(1, 0, 9.0, None), (1, 1, 9.0, None), (2, -1, None, "no answer within 1 seconds"), (3, -1, None, "ValueError: not an image"), (9, 0, 9.0, None), (9, 1, 9.0, None)]


def test_settings():
    assert configured({}) == configured({"inference": None, "other": 1}) == DEFAULT
    got = configured({"inference": {"min_room_area": 2, "iou_threshold": 0.6}, "output": {"default_wall_height": 3}, "training": {"test_split": 0.1}})
    assert (got.min_room_area, got.max_overlap, got.wall_height, got.test_share, got.snap_threshold) == (2.0, 0.6, 3.0, 0.1, 0.1)


def test_files_by_their_lists(spark, tmp_path):
    """tasks list what they wrote, and readers take the lists; a folder without them is listed itself."""
    out = f"{tmp_path}/files"
    docs = spark.createDataFrame([(f"{i % 3}/{i}.json", "" if i == 4 else '{"walls":[]}' if i % 2 else '{"rooms":[') for i in range(40)], "path string, content string").repartition(4)
    label_sink.write_files(docs, out)
    assert len(list((tmp_path / "files/0").iterdir())) == 14
    assert sorted(tuple(r) for r in label_sink.read_files(spark, out).collect()) == sorted(tuple(r) for r in docs.collect())
    got = {r.plan_id: (r.walls, r._corrupt_record) for r in plans.read_documents(label_sink.read_files(spark, out)).collect()}
    assert got["1/1.json"] == ([], None) and got["2/2.json"] == (None, '{"rooms":[')
    tree = f"{tmp_path}/set"
    label_sink.write_label_files(labelled(spark, ["a", "b", "empty"]), None, tree)
    want = sorted(tuple(r) for r in label_sink.read_label_files(spark, tree).collect())
    (tmp_path / "set" / label_sink.NAMES).rename(tmp_path / "names")
    assert len(want) == 3 and sorted(tuple(r) for r in label_sink.read_label_files(spark, tree).collect()) == want


def test_buckets_have_several_tasks(spark, tmp_path):
    """a bucket is written by more than one task, so a task's share follows their number."""
    n = 20000
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small parts would be put together
    try:
        objects = spark.range(n).selectExpr("id as plan_id", "'wall' as type")
        replace_scenes(objects, objects.select("plan_id"), f"{tmp_path}/scenes", buckets=1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(list((tmp_path / "scenes/bucket=0").glob("*.parquet"))) > 1
    assert read_scenes(spark, f"{tmp_path}/scenes", objects.schema).count() == n
