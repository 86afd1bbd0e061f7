"""Line dedup by a deletion-neighbourhood join.

Two lines are the same if they are equal, or if one edit of a character (insertion, deletion, substitution) makes them
so and both have LEAST characters or more.  A line is dropped wherever an earlier line of the corpus, by doc_id and
line number, is the same; blank lines are kept.

1. Equal lines meet under two 64-bit hashes; only their earliest place goes on.
2. Lines one edit apart agree in the first or the second half of their common length.  Distinct lines that share no half
   with another line have no near line and go no further; a Bloom filter of the others, where they are few enough to send
   it to all tasks, lets the text scan pass them alone.
3. The rest emit their deletion neighbourhood, the line and each variant with one character less, as hashed keys.
   Equal keys with the same place deleted are substitutions; a key that is itself a line is an insertion.  Each key
   needs its earliest line only, so no pairs are formed; the edit distance to that line is then verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm import jobs, textkit
from weftgraph.llm.textkit import U

#: Characters from which an edit is allowed; blocks of 64 bits, each for four lines, up to which a Bloom filter is sent to
#: all tasks (16 bytes each).
LEAST, BLOCKS = 16, 1 << 20


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h1, h2, n) of the lines of docs that are not blank; n is in characters."""
    split = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    hashed = split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return hashed.select("doc_id", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), F.char_length("line").alias("n"))


def _variants(cases: DataFrame) -> DataFrame:
    """(v, p, first, h1, h2): the deletion neighbourhood; p is the place deleted, -1 for the line itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, line in enumerate(batch.column("line").to_pylist()):
                codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
                n = len(codes)
                up, _ = textkit._powers(n + 1)
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(textkit.mix(codes + U(1)) * up[:n], out=sums[1:])
                shorter = sums[:-1] + (sums[-1] - sums[1:]) * textkit._BASE_INVERSE
                keys = textkit.mix(np.append(shorter, sums[-1])).view(np.int64)
                take = pa.array(np.full(n + 1, k), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.append(np.arange(n), -1), pa.int32()), *(batch.column(c).take(take) for c in ("doc_id", "line_no", "h1", "h2"))],
                    names=["v", "p", "doc_id", "line_no", "h1", "h2"],
                )

    kind = cases.schema["doc_id"].dataType.simpleString()
    return cases.select("doc_id", "line_no", "h1", "h2", "line").mapInArrow(run, f"v long, p int, doc_id {kind}, line_no int, h1 long, h2 long")


def _halves() -> list[Column]:
    """Keys of both halves of a line under its own length and under one less; lines one edit apart share one of them."""
    keys = []
    for size in (F.col("n") - 1, F.col("n")):
        half = F.floor(size / 2).cast("int")
        keys += [F.xxhash64(size, F.lit(0), F.substring("line", F.lit(1), half)), F.xxhash64(size, F.lit(1), F.substring("line", F.col("n") - size + half + 1, size - half))]
    return keys


def near_lines(every: DataFrame, firsts: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2) of the distinct lines that are one edit from an earlier line.

    firsts: a stored row (h1, h2, doc_id, line_no, halves) for each distinct line.
    """
    spark = every.sparkSession
    long = every.where(F.col("n") >= least)
    keyed = firsts.select("h1", "h2", F.explode("halves").alias("half"))
    # minima and maxima of numbers are combined before the shuffle, so a frequent half is a row a task
    shared = keyed.groupBy("half").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in ("h1", "h2")])
    shared = jobs.stored(shared.where("least_h1 <> most_h1 or least_h2 <> most_h2").select("half"), "shared")
    cases = jobs.stored(keyed.join(shared, "half", "left_semi").select("h1", "h2").distinct(), "cases")
    jobs.discard(shared)
    count = cases.count()
    blocks = 1
    while blocks < count // 4:
        blocks *= 2

    def block(h1: str) -> Column:
        return F.pmod(F.col(h1), F.lit(blocks))

    def mask(h2: str) -> Column:
        bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("shiftright", F.col(h2), F.lit(6 * k)).bitwiseAND(F.lit(63).cast("bigint")).cast("int")) for k in range(5)]
        return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3]).bitwiseOR(bits[4])

    passed = long.select("h1", "h2", "line")
    if blocks <= BLOCKS:
        bloom = F.broadcast(cases.groupBy(block("h1").alias("block")).agg(F.bit_or(mask("h2")).alias("bits")))
        passed = passed.withColumn("block", block("h1")).join(bloom, "block").where(F.col("bits").bitwiseAND(mask("h2")) == mask("h2"))
    texts = passed.groupBy("h1", "h2").agg(F.min("line").alias("line")).join(cases, ["h1", "h2"], "left_semi").join(firsts, ["h1", "h2"])
    texts = jobs.stored(texts.select("h1", "h2", "line", "doc_id", "line_no"), "lines")
    jobs.discard(cases)
    variants = _variants(texts).repartition(jobs.partitions(spark), "v").withColumn("me", F.struct("doc_id", "line_no", "h1", "h2"))
    itself = F.col("p") == -1
    same_place, same_key = Window.partitionBy("v", "p"), Window.partitionBy("v")
    earliest = variants.select(
        "me",
        F.when(~itself, F.min("me").over(same_place)).alias("substituted"),
        F.when(~itself, F.min(F.when(itself, F.col("me"))).over(same_key)).alias("deleted"),
        F.when(itself, F.min(F.when(~itself, F.col("me"))).over(same_key)).alias("inserted"),
    )
    pairs = earliest.select("me", F.explode(F.array("substituted", "deleted", "inserted")).alias("other")).where("other < me").distinct()
    pairs = pairs.select(F.col("me.h1").alias("h1"), F.col("me.h2").alias("h2"), F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
    others = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other"))
    checked = pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(others, ["o1", "o2"])
    return checked.where(F.levenshtein("line", "other", 1) == 1).select("h1", "h2").distinct()


def dropped(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, dropped): the line numbers, from 0 and ascending, that each document loses; documents that lose none are not listed.

    docs has doc_id and text.  Null doc_ids and null texts lose nothing; rows that repeat a doc_id are one document.
    """
    jobs.small_batches(docs.sparkSession)
    every = lines(docs)
    halves = [F.when(F.col("n") >= least, key).alias(f"half{k}") for k, key in enumerate(_halves())]
    first = [F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("times"), *[F.min(f"half{k}").alias(f"half{k}") for k in range(len(halves))]]
    firsts = every.select("doc_id", "line_no", "h1", "h2", *halves).groupBy("h1", "h2").agg(*first)
    firsts = jobs.stored(firsts.select("h1", "h2", "first.doc_id", "first.line_no", "times", F.array_compact(F.array(*[f"half{k}" for k in range(len(halves))])).alias("halves")), "firsts")
    near = near_lines(every, firsts, least).withColumn("near", F.lit(True))
    # a stored table, so that the places of a frequent line can be split among tasks
    kept = firsts.join(near, ["h1", "h2"], "left").where("times > 1 or near").select("h1", "h2", F.struct("doc_id", "line_no").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    kept = jobs.stored(kept, "repeated")
    jobs.discard(firsts)
    places = every.select("doc_id", "line_no", "h1", "h2")
    lost = places.join(kept, ["h1", "h2"]).where(F.col("near") | (F.struct("doc_id", "line_no") != F.col("first")))
    return lost.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with their texts less the lines that dropped() lists; other lines and all columns stay as they are."""
    lost = dropped(docs, least).select(F.col("doc_id").alias("__doc"), F.col("dropped").alias("__dropped"))
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains(F.col("__dropped"), k)), "\n")
    return docs.join(lost, F.col("doc_id") == F.col("__doc"), "left").withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(rest)).drop("__doc", "__dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: lines of each document, and the numbers of those that an earlier line repeats."""
    docs = jobs.table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"))
    found = counts.join(dropped(docs), "doc_id", "left")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), place AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM split, unnest(range(1, len(l) + 1)) AS t(i) WHERE regexp_matches(l[i], '[^\x20\x09-\x0D]')
), distinct_line AS (
  SELECT line, min((doc_id, line_no)) AS first, length(line) AS n FROM place GROUP BY line
), half AS (
  SELECT line, first, n, size, side, CASE side WHEN 0 THEN left(line, size // 2) ELSE right(line, size - size // 2) END AS part
  FROM distinct_line, unnest([n - 1, n]) AS s(size), (VALUES (0), (1)) AS sides(side) WHERE n >= 16
), near AS (
  SELECT DISTINCT a.line FROM half a JOIN half b USING (size, side, part) WHERE b.first < a.first AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) = 1
), lost AS (
  SELECT doc_id, line_no FROM place JOIN distinct_line USING (line)
  WHERE (doc_id, line_no) <> first OR line IN (SELECT line FROM near)
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS dropped FROM (SELECT DISTINCT * FROM lost) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_dropped, coalesce(dropped, '') AS dropped
FROM documents LEFT JOIN listed USING (doc_id)
"""
