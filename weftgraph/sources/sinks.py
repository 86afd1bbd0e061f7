"""Sinks: tables with a manifest, write-if-changed, scoped exports, guarded copies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.changes import fingerprint
from weftgraph.storage import exists, remove, replace_all


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Replaces the Parquet table at path unless it holds the same rows; whether it wrote."""
    spark = df.sparkSession
    if exists(spark, path) and spark.read.parquet(path).schema == df.schema and fingerprint(spark.read.parquet(path)) == fingerprint(df):
        return False
    replace_all({path: df})
    return True


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table at path lacks; how many."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    count = new.count()
    if count:
        new.write.mode("append").parquet(path)
    return count


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def free_names(names: list[str]) -> list[str]:
    """File names from titles: `_2`, `_3` where two would be the same."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        base = re.sub(r"[^\w]+", "_", name.strip().lower()).strip("_") or "table"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


#: Bytes of an exported file; a table with a larger one is dealt into more files, as a digest takes a file as one value.
FILE_BYTES = 1 << 29


def export(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes the tables under folder and gives the manifest (path, sha256, size) of all their files, which is written too.

    No file is much larger than FILE_BYTES, whatever the sizes of the tables.
    """
    replace_all({f"{folder}/{name}": df for name, df in tables.items()})

    def files(*names: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([f"{folder}/{name}" for name in names])

    for name in tables:
        size = files(name).agg(F.max("length").alias("largest"), F.sum("length").alias("total")).first()
        if (size["largest"] or 0) > FILE_BYTES:
            replace_all({f"{folder}/{name}": spark.read.parquet(f"{folder}/{name}").repartition(-(-2 * size["total"] // FILE_BYTES))})
    manifest = files(*tables).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    if exists(spark, f"{folder}/manifest"):
        remove(spark, f"{folder}/manifest")
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return manifest


def scoped(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    """Triples whose subject is one of the curated subjects (s); an error leaves nothing written, never all of it."""
    return triples.join(subjects.select("s").distinct(), "s", "left_semi")


def copy_columns(source: DataFrame, path: str, defaults: dict[str, object] | None = None) -> int:
    """Copies the columns that source and the empty table at path share, with defaults for others; refuses a table with rows."""
    spark = source.sparkSession
    target = spark.read.parquet(path)
    if not target.isEmpty():
        raise ValueError(f"{path} has rows")
    columns = [F.col(c) if c in source.columns else F.lit((defaults or {}).get(c)).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    source.select(*columns).write.mode("append").parquet(path)
    return spark.read.parquet(path).count()
