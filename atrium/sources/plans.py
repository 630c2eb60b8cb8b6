"""Plan documents: files, samples, and their arrays as tables keyed by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DEFAULT, PLAN_SCHEMA, Config

#: Three sample plans.
SAMPLES = {
    "apartment": """{"scale": {"pixels_per_meter": 50},
 "walls": [{"start": [0, 0], "end": [6, 0], "thickness": 0.15}, {"start": [6, 0], "end": [6, 4], "thickness": 0.15}, {"start": [6, 4], "end": [0, 4], "thickness": 0.15}, {"start": [0, 4], "end": [0, 0], "thickness": 0.15}, {"start": [3, 0], "end": [3, 4], "thickness": 0.1}],
 "doors": [{"position": [3, 2], "width": 0.9, "type": "hinged", "wall_index": 4}, {"position": [1, 0], "width": 0.9, "type": "hinged", "wall_index": 0}],
 "windows": [{"position": [4.5, 4], "width": 1.2, "wall_index": 2}, {"position": [1.5, 4], "width": 1.0, "wall_index": 2}],
 "rooms": [{"label": "living_room", "polygon": [[3, 0], [6, 0], [6, 4], [3, 4]], "area": 12.0}, {"label": "bedroom", "polygon": [[0, 0], [3, 0], [3, 4], [0, 4]], "area": 12.0}]}""",
    "studio": """{"scale": {"pixels_per_meter": 50},
 "walls": [{"start": [0, 0], "end": [5, 0], "thickness": 0.15}, {"start": [5, 0], "end": [5, 4], "thickness": 0.15}, {"start": [5, 4], "end": [0, 4], "thickness": 0.15}, {"start": [0, 4], "end": [0, 0], "thickness": 0.15}, {"start": [0, 2.5], "end": [2, 2.5], "thickness": 0.1}, {"start": [2, 2.5], "end": [2, 4], "thickness": 0.1}],
 "doors": [{"position": [2.5, 0], "width": 0.9, "type": "hinged", "wall_index": 0}, {"position": [2, 3.2], "width": 0.7, "type": "hinged", "wall_index": 5}],
 "windows": [{"position": [3.5, 4], "width": 1.5, "wall_index": 2}, {"position": [5, 2], "width": 1.0, "wall_index": 1}],
 "rooms": [{"label": "main_room", "polygon": [[0, 0], [5, 0], [5, 2.5], [2, 2.5], [0, 2.5]], "area": 12.5}, {"label": "kitchenette", "polygon": [[2, 2.5], [5, 2.5], [5, 4], [2, 4]], "area": 4.5}, {"label": "bathroom", "polygon": [[0, 2.5], [2, 2.5], [2, 4], [0, 4]], "area": 3.0}]}""",
    "three_bedroom": """{"scale": {"pixels_per_meter": 50},
 "walls": [{"start": [0, 0], "end": [10, 0], "thickness": 0.2}, {"start": [10, 0], "end": [10, 8], "thickness": 0.2}, {"start": [10, 8], "end": [0, 8], "thickness": 0.2}, {"start": [0, 8], "end": [0, 0], "thickness": 0.2}, {"start": [0, 4], "end": [6, 4], "thickness": 0.12}, {"start": [3.5, 4], "end": [3.5, 8], "thickness": 0.12}, {"start": [7, 4], "end": [7, 8], "thickness": 0.12}, {"start": [6, 0], "end": [6, 4], "thickness": 0.12}, {"start": [6, 4], "end": [10, 4], "thickness": 0.12}],
 "doors": [{"position": [5, 0], "width": 1.0, "type": "hinged", "wall_index": 0}, {"position": [1.5, 4], "width": 0.8, "type": "hinged", "wall_index": 4}, {"position": [5, 4], "width": 0.8, "type": "hinged", "wall_index": 4}, {"position": [8.5, 4], "width": 0.8, "type": "hinged", "wall_index": 8}, {"position": [6, 2], "width": 0.9, "type": "hinged", "wall_index": 7}],
 "windows": [{"position": [2, 8], "width": 1.5, "wall_index": 2}, {"position": [5.5, 8], "width": 1.2, "wall_index": 2}, {"position": [8.5, 8], "width": 1.2, "wall_index": 2}, {"position": [0, 2], "width": 1.2, "wall_index": 3}, {"position": [10, 6], "width": 1.2, "wall_index": 1}, {"position": [8, 0], "width": 1.5, "wall_index": 0}],
 "rooms": [{"label": "living_room", "polygon": [[0, 0], [6, 0], [6, 4], [0, 4]], "area": 24.0}, {"label": "kitchen", "polygon": [[6, 0], [10, 0], [10, 4], [6, 4]], "area": 16.0}, {"label": "bedroom_1", "polygon": [[0, 4], [3.5, 4], [3.5, 8], [0, 8]], "area": 14.0}, {"label": "bedroom_2", "polygon": [[3.5, 4], [7, 4], [7, 8], [3.5, 8]], "area": 14.0}, {"label": "bedroom_3", "polygon": [[7, 4], [10, 4], [10, 8], [7, 8]], "area": 12.0}]}""",
}


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(plan_id, document columns, _corrupt_record) of JSON files, one document each. A bad file gives a row of nulls and its text."""
    raw = spark.read.schema(PLAN_SCHEMA + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.select(F.col("_metadata.file_path").alias("plan_id"), "*")


def read_documents(files: DataFrame) -> DataFrame:
    """read_plans() of files (path, content) that are read already; plan_id is the path."""
    doc = F.from_json("content", PLAN_SCHEMA + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return files.select(F.col("path").alias("plan_id"), doc.alias("d")).select("plan_id", "d.*")


def parse_plans(texts: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(plan_id, document columns) of JSON texts."""
    doc = F.from_json(F.col(json_col), PLAN_SCHEMA)
    return texts.select(F.col(id_col).alias("plan_id"), doc.alias("d")).select("plan_id", "d.*")


def sample_plans(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """All samples, or the one of that name; an unknown name gives the apartment."""
    names = list(SAMPLES) if kind is None else [kind if kind in SAMPLES else "apartment"]
    return parse_plans(spark.createDataFrame([(n, SAMPLES[n]) for n in names], "plan_id string, doc string"), "plan_id", "doc")


def sample_requests(requests: DataFrame, kind: Column) -> DataFrame:
    """requests with the columns of the sample that kind names, the apartment where it names none. The samples are three rows."""
    samples = sample_plans(requests.sparkSession).withColumnRenamed("plan_id", "__kind")
    name = F.when(kind.isin(*SAMPLES), kind).otherwise("apartment")
    return requests.withColumn("__name", name).join(F.broadcast(samples), F.col("__name") == F.col("__kind")).drop("__name", "__kind")


def choose_source(json_path: Column, image_path: Column) -> Column:
    """Which source a request is served from: JSON before image; null where there is none."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(some(json_path), F.struct(F.lit("json").alias("kind"), json_path.alias("path"))).when(some(image_path), F.struct(F.lit("image").alias("kind"), image_path.alias("path")))


def placed(plans: DataFrame, part: str, index: str, item: str) -> DataFrame:
    """(plan_id, index, item) of one of the documents' arrays.

    The outer generator's rows without an item are left out above it. The plain one has filters on the array below it,
    and so a text is parsed for each of them again.
    """
    return plans.select("plan_id", F.posexplode_outer(part).alias(index, item)).where(F.col(index).isNotNull())


def walls(plans: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(plan_id, wall_index, sx, sy, ex, ey, thickness, confidence): place in the document is the key."""
    w = placed(plans, "walls", "wall_index", "w")
    at = lambda c, k: F.get(F.col(c), F.lit(k))
    return w.select("plan_id", "wall_index", at("w.start", 0).alias("sx"), at("w.start", 1).alias("sy"), at("w.end", 0).alias("ex"), at("w.end", 1).alias("ey"), F.coalesce("w.thickness", F.lit(cfg.wall_thickness)).alias("thickness"), F.col("w.confidence").alias("confidence"))


def bad_position(p: Column) -> Column:
    """Whether a position is neither missing, nor two numbers' list, nor a number or the text of one."""
    missing = p.isNull() | F.coalesce(F.is_variant_null(p), F.lit(False))
    many = F.coalesce(F.size(F.try_variant_get(p, "$", "array<variant>")), F.lit(-1))
    return ~missing & (many != 2) & ((many >= 0) | F.try_variant_get(p, "$", "double").isNull())


def openings(plans: DataFrame, kind: str, cfg: Config = DEFAULT) -> DataFrame:
    """(plan_id, kind, opening_index, px, py, along, bad_position, width, height, sill, wall_index) of doors or windows.

    A position of two numbers gives px, py; a single number gives along; any other is flagged. Missing is (0, 0).
    """
    window = kind == "window"
    o = placed(plans, "windows" if window else "doors", "opening_index", "o")
    p = F.col("o.position")
    missing = p.isNull() | F.coalesce(F.is_variant_null(p), F.lit(False))
    many = F.size(F.try_variant_get(p, "$", "array<variant>"))
    n = F.when(missing, 2).otherwise(F.coalesce(F.when(many >= 0, many), F.lit(0)))
    number = F.try_variant_get(p, "$", "double")
    xy = lambda k: F.when(missing, 0.0).when(n == 2, F.try_variant_get(p, f"$[{k}]", "double"))
    along = F.when(~missing & (n == 0), number)
    width, height = (cfg.window_width, cfg.window_height) if window else (cfg.door_width, cfg.door_height)
    sill = F.coalesce("o.sill_height", F.lit(cfg.sill_height)) if window else F.lit(0.0)
    return o.select("plan_id", F.lit(kind).alias("kind"), "opening_index", xy(0).alias("px"), xy(1).alias("py"), along.alias("along"), (~missing & (n != 2) & number.isNull()).alias("bad_position"), F.coalesce("o.width", F.lit(width)).alias("width"), F.coalesce("o.height", F.lit(height)).alias("height"), sill.alias("sill"), F.coalesce("o.wall_index", F.lit(0)).alias("wall_index"))


def rooms(plans: DataFrame) -> DataFrame:
    """(plan_id, room_index, label, polygon, area); label falls back on Room_{i}."""
    r = placed(plans, "rooms", "room_index", "r")
    return r.select("plan_id", "room_index", F.coalesce("r.label", F.concat(F.lit("Room_"), F.col("room_index"))).alias("label"), F.coalesce("r.polygon", F.array().cast("array<array<double>>")).alias("polygon"), F.col("r.area").alias("area"))
