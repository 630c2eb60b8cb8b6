"""A folder of plan documents as a stream: their scenes follow in the same micro-batch, one scene to a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PLAN_SCHEMA
from ..operators.scene import build_scene
from ..sources.plans import parse_plans


def stream_plans(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Files of one document each; a plan's id is its file's path."""
    raw = spark.readStream.schema(PLAN_SCHEMA).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)
    return raw.select(F.col("_metadata.file_path").alias("plan_id"), "*")


def stream_documents(spark: SparkSession, path: str, schema: str = "plan_id long, doc string", files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of many documents (plan_id, doc), as they arrive."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return parse_plans(raw, "plan_id", "doc")


def replace_scenes(objects: DataFrame, plans: DataFrame, out: str, buckets: int = 64) -> None:
    """Puts objects in place of what the plans had under out; other plans' scenes stay.

    Scenes lie in buckets by a hash of plan_id. Only buckets in which a plan changes are read and written again, all in
    one commit of a dynamic partition overwrite; several tasks write a bucket. A row without a type stands in each of them, so that one of which no
    object is left is written too. Doing it twice changes nothing.
    """
    spark = objects.sparkSession
    bucket = F.pmod(F.xxhash64("plan_id"), F.lit(buckets)).cast("int").alias("bucket")
    new = objects.select("*", bucket)
    changed = plans.select("plan_id").distinct()
    touched = [r.bucket for r in changed.select(bucket).distinct().collect()]  # no more than there are buckets
    new = new.unionByName(spark.createDataFrame([(b,) for b in touched], "bucket int"), allowMissingColumns=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        old = read_scenes(spark, out, objects.schema, with_bucket=True).where(F.col("bucket").isin(touched))
        same = old["plan_id"].eqNullSafe(changed["plan_id"])
        new = new.unionByName(old.join(changed, same, "left_anti"))
    # A bucket is dealt to several tasks, so that what a task sorts follows their number and not that of buckets.
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(touched)))
    part = F.pmod(F.xxhash64("plan_id", F.lit(1)), F.lit(slices))
    new.repartition("bucket", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)


def read_scenes(spark: SparkSession, out: str, schema, with_bucket: bool = False) -> DataFrame:
    """The objects under out, of the schema that build_scene() gave them."""
    found = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", bucket int").parquet(out)
    found = found.where("type is not null")  # see replace_scenes()
    return found if with_bucket else found.drop("bucket")


def write_scenes(plans: DataFrame, out: str, checkpoint: str, buckets: int = 64, **scene):
    """Starts a query that keeps one scene for each plan under out: a document that arrives again replaces its plan's.

    Of several documents of one plan in one batch all objects stay together, as it isn't known which is later. A batch
    that runs again leaves what it left before, and a document without objects leaves its plan without any.
    """

    def put(batch: DataFrame, number: int) -> None:
        replace_scenes(build_scene(batch, **scene), batch, out, buckets)

    return plans.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
