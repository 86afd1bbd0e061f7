"""Writing intermediate tables to the folder that all executors share, and replacing tables all at once."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weft-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """df written once and read back: no lineage, and no second run after a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/weft-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, each: int) -> DataFrame:
    """df dealt by its keys to as many partitions as leave about `each` rows to one.

    Spark joins partitions of other shuffles by their compressed bytes, so that many rows that are alike go to few tasks;
    a number that is asked for stays.  The rows are counted first.
    """
    return df.repartition(max(1, -(-df.count() // each)), *keys)


def discard(df: DataFrame) -> None:
    """Removes the files of a table made by stored() that nothing will read again."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file.rpartition("/")[0])


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _files(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, files = _files(spark, path)
    files.delete(target, True)


class Round:
    """Stages of one round, each stored in a folder of its own with a marker that is written last.

    A driver that is lost is followed by one that gives the same folder: it goes on after the last stage with a marker,
    from what that stage stored; half-written files of the next one are removed.  A marker is named by a digest of `key`
    and the names of the stages up to it, so a round of another key or other stages starts where it differs.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = ""):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        #: Stages that this driver has run.
        self.ran: list[str] = []

    def run(self, start: Callable[[], DataFrame], stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
        """The result of the last stage, read from where it is stored.  Each stage takes what the one before it stored, the first start();
        what a stage stored is removed when the next one is whole."""
        marks, mark = [], self.key
        for name, _ in stages:
            mark = hashlib.sha256(f"{mark}|{name}".encode()).hexdigest()
            marks.append(mark)
        places = [f"{self.folder}/{k}-{name}" for k, (name, _) in enumerate(stages)]
        whole = [k for k, place in enumerate(places) if exists(self.spark, f"{place}/done-{marks[k]}") and exists(self.spark, f"{place}/rows")]
        at = whole[-1] if whole else -1
        rows = self.spark.read.parquet(f"{places[at]}/rows") if whole else start()
        for k in range(at + 1, len(stages)):
            name, stage = stages[k]
            remove(self.spark, places[k])
            stage(rows).write.parquet(f"{places[k]}/rows")
            target, files = _files(self.spark, f"{places[k]}/done-{marks[k]}")
            files.create(target, True).close()
            self.ran.append(name)
            rows = self.spark.read.parquet(f"{places[k]}/rows")
            if k:
                remove(self.spark, f"{places[k - 1]}/rows")
        return rows


def replace_all(tables: dict[str, DataFrame]) -> None:
    """Replaces the tables at several paths together: all are staged first; if a swap fails, all paths get their old tables back."""
    staged: dict[str, str] = {}
    done: list[tuple[str, str | None]] = []
    spark = next(iter(tables.values())).sparkSession if tables else None
    try:
        for path, df in tables.items():
            staged[path] = f"{path}.staged-{uuid.uuid4().hex}"
            df.write.parquet(staged[path])
        for path, new in staged.items():
            backup = f"{path}.backup-{uuid.uuid4().hex}" if exists(spark, path) else None
            for old, to in ((path, backup), (new, path)):
                if to is None:
                    continue
                source, files = _files(spark, old)
                if not files.rename(source, _files(spark, to)[0]):
                    raise OSError(f"cannot move {old} to {to}")
                if to == backup:
                    done.append((path, backup))
            if backup is None:
                done.append((path, None))
    except Exception:
        for path, backup in reversed(done):
            remove(spark, path)
            if backup is not None:
                source, files = _files(spark, backup)
                files.rename(source, _files(spark, path)[0])
        raise
    finally:
        for new in staged.values():
            if exists(spark, new):
                remove(spark, new)
    for _, backup in done:
        if backup is not None:
            remove(spark, backup)
