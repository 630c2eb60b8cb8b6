"""File scans and sinks: image sizes, configuration, plan JSON, labels, manifests, meshes, archives."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .glb import few_plans

#: What an archive leaves out, wherever it stands in a path.
EXCLUDED = ("__pycache__", ".pyc", ".pyo", ".DS_Store")

#: Formats by suffix.
EXPORTS = {".fbx": "fbx", ".obj": "obj", ".glb": "gltf", ".gltf": "gltf"}


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG's header; null for other content."""
    ok = F.substring(content, 1, 8) == F.lit(bytes.fromhex("89504e470d0a1a0a"))
    at = lambda p: F.when(ok, F.conv(F.hex(F.substring(content, p, 4)), 16, 10).cast("int"))
    return at(17), at(21)


def read_binary(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def load_config(spark: SparkSession, path: str) -> dict:
    """A YAML file, read by Spark, so that any of its stores will do."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])


def json_documents(plans: DataFrame, pretty: bool = False) -> DataFrame:
    """(plan_id, json) of documents."""
    return plans.select("plan_id", F.to_json(F.struct(*[c for c in ("scale", "walls", "doors", "windows", "rooms") if c in plans.columns]), {"pretty": "true"} if pretty else {}).alias("json"))


def included(path: Column) -> Column:
    out = F.lit(True)
    for x in EXCLUDED:
        out = out & ~path.contains(x)
    return out


def entries(files: DataFrame, root: str, prefix: str) -> DataFrame:
    """files(path, ...) that an archive takes, with entry, their name in it: prefix and the path below root."""
    below = F.regexp_replace("path", rf"(?s)^.*?\Q{root.rstrip('/')}\E/", "")
    return files.where(included(F.col("path"))).withColumn("entry", F.concat(F.lit(f"{prefix}/"), below))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share: in spark.checkpoint.dir, else the warehouse; a temporary folder in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="atrium-") if spark.conf.get("spark.master", "").startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def label_lines(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """(name, split, content): one label text per sample, empty where it has no labels."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls_id", "cx", "cy", "w", "h")
    text = labels.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    return samples.select("name", "split").join(text, "name", "left").withColumn("content", F.coalesce("content", F.lit("")))


def write_labels(content: DataFrame, out: str) -> None:
    """Labels as a table partitioned by split, a row per sample."""
    content.write.mode("overwrite").partitionBy("split").parquet(out)


def manifest(out: str, classes) -> str:
    """The data set's description as YAML. Its keys are fixed values."""
    import yaml

    return yaml.dump({"path": out, "train": "images/train", "val": "images/val", "test": "images/test", "nc": len(classes), "names": list(classes)}, default_flow_style=False)


def export_kind(path: str) -> str:
    """Format by suffix, whatever its case; an error for others."""
    name = path.lower().rsplit("/", 1)[-1]
    kind = EXPORTS.get("." + name.rsplit(".", 1)[-1] if "." in name.lstrip(".") else "")
    if kind is None:
        raise ValueError(f"no export for {path}")
    return kind


def write_obj(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_plans(batches):
        texts = []
        for objects in batch.columns[1].to_pylist():
            out, before = [], 1
            for o in objects:
                out.append(f"o {o['name']}")
                out += ["v %.6f %.6f %.6f" % (p["x"], p["y"], p["z"]) for p in o["vertices"]]
                out += ["f " + " ".join([str(i + before) for i in face]) for face in o["faces"]]
                before += len(o["vertices"])
            texts.append("\n".join(out) + "\n")
        yield pa.RecordBatch.from_arrays([batch.columns[0], pa.array(texts, pa.string())], names=["plan_id", "obj"])


def obj_text(objects: DataFrame) -> DataFrame:
    """(plan_id, obj): a mesh text of each plan's objects that have faces; vertex numbers run through a plan.

    A plan's objects meet in one row, and its text is written there, so nothing is numbered across rows.
    """
    o = objects.where(F.size("faces") > 0).select("plan_id", F.struct("type", "source_index", "name", "vertices", "faces").alias("o"))
    by_plan = o.groupBy("plan_id").agg(F.sort_array(F.collect_list("o")).alias("o"))
    return by_plan.mapInArrow(write_obj, f"plan_id {objects.schema['plan_id'].dataType.simpleString()}, obj string")
