"""Small helpers for Spark jobs: reading tables, cutting lineage, shared numbering and graph components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.graph import contracted as components
from weftgraph.storage import discard, shared_folder, stored

__all__ = ["WORD", "components", "discard", "numbered", "numbered_in_groups", "partitions", "shared_folder", "small_batches", "stored", "table"]

#: Words of the contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows, and so the memory, of the Arrow batches that Python workers get; a smaller setting stays.

    Plans read this setting of the session when they run, so it can't be put back here.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with a gapless number from 0 in ascending order of a column of distinct values, null last.

    Rows are dealt into ranges; a range is numbered by itself and shifted by the counts of the ranges before it.
    """
    spark = df.sparkSession
    by = F.col(order).asc_nulls_last()
    ranged = stored(df.repartitionByRange(partitions(spark), by).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(by)) - 1
    return ranged.withColumn("__own", own).join(shift, "__range").withColumn(name, F.col("__own") + F.col("__shift")).drop("__range", "__own", "__shift")


def numbered_in_groups(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """df with a gapless number from 0 in each group; null counts as a value.

    The rows are written first, so that all later tasks agree on the numbers, of equal rows too.  No task sees a whole
    group: rows are numbered within the task that wrote them and shifted by the counts of the tasks before it.
    """
    held = stored(df.withColumns({"__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "rows")
    counts = held.groupBy(*group, "__task").agg(F.count("*").alias("__rows"))
    shift = F.coalesce(F.sum("__rows").over(Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [*group, "__task"]
    shifts = stored(counts.select(*[F.col(c).alias(f"__key{k}") for k, c in enumerate(keys)], shift.alias("__shift")), "shifts")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__key{k}")) for k, c in enumerate(keys)))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("__at")) - 1
    numbered = held.withColumn("__own", own).join(shifts, same).withColumn(name, F.col("__own") + F.col("__shift"))
    return numbered.drop("__task", "__at", "__own", "__shift", *[f"__key{k}" for k in range(len(keys))])
