"""Exact duplicates by deterministic block naming.

A text, its A-Z lower-cased, is cut into blocks of BLOCK bytes.  The distinct blocks are sorted and their rank is their
name.  Then adjacent names of a text are paired, (name, name) or (name, 0) at an odd end, the distinct pairs are sorted,
and their rank is the name of the pair; this goes on until each text has one name.  Texts are equal exactly when their
number of rounds and their last name are.

Blocks are sorted by a salted 128-bit digest, so that only one shuffle carries their bytes.  It counts the different
blocks of each digest; if two share one, all blocks are named again under another salt, so a name never stands for two
blocks.  Names that many rows hold are joined by broadcast, of fewer than HOT keys, so no task gets a group of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm import jobs

#: Bytes of a block; keys held by more than a HOT-th of the rows are broadcast.
BLOCK, HOT = 4096, 1000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def normal(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased; null is as empty."""
    return (text or "").encode().translate(_LOWER)


def blocks(data: bytes, size: int = BLOCK) -> list[bytes]:
    """An empty text is one empty block."""
    return [data[k : k + size] for k in range(0, len(data), size)] or [b""]


def digest(block: bytes, salt: int, bits: int = 128) -> bytes:
    found = hashlib.blake2b(block, digest_size=16, salt=salt.to_bytes(4, "big")).digest()
    return found if bits == 128 else (int.from_bytes(found, "big") % (1 << bits)).to_bytes(16, "big")


def keyed(docs: DataFrame, row: str, salt: int, size: int, bits: int) -> DataFrame:
    """(row, doc_id, tie, text_sha256, keys): what later steps need of a row instead of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tie, sha, keys = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                data = normal(text)
                tie.append(hashlib.blake2b((text or "").encode(), digest_size=8).digest())
                sha.append(hashlib.sha256(data).hexdigest())
                keys.append([digest(b, salt, bits) for b in blocks(data, size)])
            columns = [batch.column(row), batch.column("doc_id"), pa.array(tie, pa.binary()), pa.array(sha, pa.string()), pa.array(keys, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "tie", "text_sha256", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col(row), "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, tie binary, text_sha256 string, keys array<binary>")


def counted_blocks(docs: DataFrame, salt: int, size: int, bits: int) -> DataFrame:
    """(key, n, variants): rows that hold a block of this digest, and the number of different blocks of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 100):
                found = [b for text in batch.column("text").slice(cut, 100) for b in blocks(normal(text.as_py()), size)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(b, salt, bits) for b in found], pa.binary()), pa.array(found, pa.binary())], names=["key", "block"])

    each = docs.select("text").mapInArrow(run, "key binary, block binary").groupBy("key", "block").agg(F.count("*").alias("n"))
    return each.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("variants"))


def named(keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows of keys, distinct in `by`, with their rank from 1 in the order of `by` as `name`."""
    ranged = keys.repartitionByRange(jobs.partitions(keys.sparkSession), *by).sortWithinPartitions(*by)
    held = jobs.stored(ranged.withColumn("at", F.monotonically_increasing_id()), "names")
    part, low = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    shift = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
    # a row for each range of the sort
    return held.withColumn("part", part).join(F.broadcast(shift), "part").withColumn("name", low + F.col("shift") + 1).drop("part", "at", "shift")


def met(rows: DataFrame, keys: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """rows with the columns of keys, which has how many rows hold each key as n; all of them find their key."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT > total  # fewer than HOT keys
    few = F.broadcast(keys.where(often).select(*by, *columns, F.lit(True).alias("often")))
    tagged = rows.join(few, by, "left")
    rest = tagged.where("often is null").drop("often", *columns).join(keys.where(~often).select(*by, *columns), by)
    return tagged.where("often").select(*rows.columns, *columns).unionByName(rest.select(*rows.columns, *columns))


def identities(docs: DataFrame, row: str, size: int = BLOCK, bits: int = 128) -> DataFrame:
    """(row, doc_id, tie, text_sha256, level, name) of each row; texts are equal where level and name are.

    docs has doc_id, text and a column `row` of distinct long numbers that stay as they are when docs is read again.
    """
    jobs.small_batches(docs.sparkSession)
    salt = 0
    while True:
        names = named(counted_blocks(docs, salt, size, bits), ["key"])
        if (names.agg(F.max("variants")).first()[0] or 1) == 1:
            break
        salt, bits = salt + 1, min(128, 2 * bits)
    held = jobs.stored(keyed(docs, row, salt, size, bits), "keyed")
    most = held.agg(F.max(F.size("keys"))).first()[0] or 1
    told = held.select("row", F.size("keys").alias("names"), F.posexplode("keys").alias("pos", "key"))
    found = jobs.stored(met(told, names, ["key"], ["name"]).drop("key"), "named")
    kept, levels = [found], 0
    while most > 1:
        most, levels = (most + 1) // 2, levels + 1
        odd = F.col("pos").bitwiseAND(1) == 1
        paired = kept[-1].where("names > 1").groupBy("row", F.shiftright(F.col("names") + 1, 1).alias("names"), F.shiftright("pos", 1).alias("pos"))
        pairs = jobs.stored(paired.agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(0)).alias("b")), "pairs")
        names = named(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"])
        kept.append(jobs.stored(met(pairs, names, ["a", "b"], ["name"]).drop("a", "b"), "named"))
        jobs.discard(pairs)
    last = reduce(DataFrame.unionByName, (x.where("names = 1").select("row", F.lit(level).alias("level"), "name") for level, x in enumerate(kept)))
    out = jobs.stored(held.drop("keys").join(last, "row"), "identities")
    for x in [held, *kept]:
        jobs.discard(x)
    return out


def judged(docs: DataFrame, row: str, size: int = BLOCK, bits: int = 128) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) of each row of docs, see identities().

    Of equal texts the row of the largest doc_id stays, null being the least; of rows that share it, the one whose text
    as it stands has the larger hash, then the larger row.  Null texts are as empty, and equal to empty ones.  An empty
    table gives an empty result.
    """
    rows = identities(docs, row, size, bits)
    order: Column = F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("doc_id"), F.col("tie").alias("tie"), F.col("row").alias("row"))
    groups = jobs.stored(rows.groupBy("level", "name").agg(F.max(order).alias("best"), F.count("*").alias("n")), "groups")
    found = met(rows, groups, ["level", "name"], ["best", "n"])
    return found.select("row", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, whole; docs may have any columns besides doc_id and text."""
    row = "__row"
    while row in docs.columns:
        row += "_"
    held = jobs.stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    stay = judged(held, row).where("kept").select(F.col("row").alias(row))
    return held.join(stay, row, "left_semi").drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: every row, with the row that stays of its texts."""
    docs = jobs.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
    return judged(docs, "__row").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
