"""Places in a whole table's order, without bringing the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch


def global_rank(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """df with name, each row's place from 0 in the given order; rows that tie have places in no fixed order.

    Rows are dealt to tasks by ranges of the order, numbered within each, and written. A count of each task's rows says
    where its numbers begin: as many numbers as there are tasks, which are broadcast.
    """
    spark, out = df.sparkSession, scratch(df.sparkSession, "ranked")
    row = F.monotonically_increasing_id()  # the task's number from bit 33 on, the row's below
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", row).write.parquet(out)
    rows = spark.read.schema(df.withColumn("__row", row).schema).parquet(out)
    task = F.shiftright("__row", 33)
    counts = sorted(tuple(r) for r in rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    before, begins = 0, []
    for t, n in counts:
        begins.append((t, before))
        before += n
    begin = spark.createDataFrame(begins, "__task long, __begin long")
    here = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(begin), task == F.col("__task")).select(*df.columns, (F.col("__begin") + here).alias(name))
