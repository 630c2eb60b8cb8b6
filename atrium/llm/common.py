"""Tables in the cluster's shared folder, connected components and Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where unset, the warehouse on a cluster, a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.conf.get("spark.master", "local").startswith("local") and "cluster" not in spark.conf.get("spark.master", "local")
        found = "file://" + tempfile.mkdtemp(prefix="atrium-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Shared:
    """Written tables of one operator call: they cut the lineage, and survive a lost executor.

    The result of a call may read them, so they stay until the caller drops them, by Shared.owned().
    """

    _owner: ContextVar[list | None] = ContextVar("owner", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/atrium-{uuid.uuid4().hex}"
        if self._owner.get() is not None:
            self._owner.get().append(self)

    @classmethod
    @contextmanager
    def owned(cls, made: list[Shared]):
        """Within, calls add their tables to made; drop each with drop("") once no result that reads them is needed."""
        token = cls._owner.set(made)
        try:
            yield made
        finally:
            cls._owner.reset(token)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again. Its shuffle files go with the write, so a long operator holds one query's at a time."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def without_clash(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, in this order; whatever else the input has can't clash with an operator's own names."""
    return df.select(*[df[c] for c in columns])


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first longer one that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow; a task that ends gives its freed memory back, as its worker waits for others and counts to its executor."""

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return df.mapInArrow(lean, schema)


def hub_limit(rows: DataFrame) -> int:
    """How many rows of a key one task takes: at most 10,000 keys of a table have more, so a list of these is small."""
    return max(256, rows.count() // 10_000)


def spread_join(rows: DataFrame, one: DataFrame, key: str, limit: int, how: str = "inner") -> DataFrame:
    """rows.join(one, key, how), for at most one row of a key in one; keys of more than limit (hub_limit) rows go to several tasks.

    how is inner or left; null keys match nothing and aren't split.

    rows are read twice: give a written table, or what follows from one without a shuffle.
    """
    hubs = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__k"))
    part = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("__k")).cast("int"), F.lit(0))
    left = rows.join(F.broadcast(hubs), key, "left").withColumn("__s", part).drop("__k")
    right = one.join(F.broadcast(hubs), key, "left").withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce("__k", F.lit(1)) - 1))).drop("__k")
    return left.join(right, [key, "__s"], how).drop("__s")


def components(shared: Shared, edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """(node, comp): comp is the least node reachable over the edges (a, b). Alternating large and small stars.

    Each round is a group-by with partial minima and a join that deals the edges of a hub to several tasks; edges never
    become more, so neither do hubs. It ends when all that is left are stars: no node has two edges down, and none that one leads to has
    any. Nodes without an edge are absent. An empty input gives an empty result.
    """
    cur = shared.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    limit = hub_limit(cur)
    for i in range(max_rounds + 1):
        down = cur.groupBy("a").agg(F.count("*").alias("n"))
        if down.where("n > 1").limit(1).count() == 0 and down.join(cur.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        both = cur.select("a", "b").unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both, least, "a", limit).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        cur = shared.put(small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("x").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), f"{tag}-{i + 1}")
        shared.drop(f"{tag}-{i}")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
