"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue that holds its documents `repeats` times over, in a shuffled order fixed by a hash.  The virtual
finish time of a document is the words of its source up to its end, divided by the weight of the source.  All queues are
merged by a global range sort on finish time, and the merged order is cut where the total budget is spent.  A source that
runs dry leaves its share to the others in proportion to their weights, which is the resharing that the targets describe.

No task sees a whole source: running sums are taken in hash buckets of a source, or in ranges of the merged order, and
shifted by the sums of the buckets or ranges before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm import jobs

#: Rows aimed at in a bucket, and units that rows of one (doc_id, source, size) are at most.
ROWS, PARTS = 20_000, 1000
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(jobs.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> tuple[DataFrame, float, float]:
    """Adds weight and target to (source, source_size); also the budget and the words a unit of weight gets.

    Sources take the weights in turn by code point, null last.  Targets share `share` times all words by weight; a
    target stops at `repeats` times its source's size and the excess is shared again until no target is above.
    """
    ranked = jobs.numbered(sizes, "source", "rank").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = jobs.stored(ranked, "sources")
    budget = share * float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = 0.0, None
    while True:
        over = F.lit(repeats) * F.col("source_size") < F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(over, repeats * F.col("source_size")).otherwise(0)).alias("capped"), F.sum(F.when(~over, F.col("weight")).otherwise(0)).alias("open"), F.count(F.when(over, 1)).alias("n")).first()
        if row["n"] == full or not row["open"]:
            break
        level, full = (budget - float(row["capped"])) / float(row["open"]), row["n"]
    target = F.least(F.lit(float(repeats)) * F.col("source_size"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "rank", "weight", target.alias("target")), budget, level


def queue(docs: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> tuple[DataFrame, float]:
    """Stored units of docs with their place in the queue of their source, and the budget.

    A unit is a row of docs.  Rows of one (doc_id, source, size) are one unit each too, numbered by `part`, up to PARTS of
    them; beyond, each of PARTS units has a PARTS-th of the rows.
    """
    groups = docs.select("doc_id", "source", words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    parts = F.least("n", F.lit(PARTS))
    units = groups.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    units = units.withColumn("rows", F.floor(F.col("n") / F.col("parts")) + (F.col("part") < F.col("n") % F.col("parts")).cast("long"))
    key = F.when(F.col("part") == 0, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).otherwise(F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("part")))
    units = jobs.stored(units.withColumn("shuffle_key", F.md5(key)), "units")
    size = F.col("size") * F.col("rows")
    count = units.count()
    digits = max(0, math.ceil(math.log(max(1, count / ROWS), 16)))
    table, budget, _ = targets(units.groupBy("source").agg(F.sum(size).alias("source_size")), weights, share, repeats)
    table = jobs.stored(table, "targets")
    units = units.withColumn("bucket", F.substring("shuffle_key", 1, digits))
    # running words of each source: sums of the buckets before, then inside the bucket
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = units.groupBy("source", "bucket").agg(F.sum(size).alias("bucket_size")).withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    offsets = offsets.join(table.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named", "bucket_size")
    offsets = offsets.withColumnsRenamed({"source": "of_source", "bucket": "of_bucket"})
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = units.withColumn("inside", F.sum(size).over(inside))
    queued = queued.join(offsets, (F.col("bucket") == F.col("of_bucket")) & F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source", "of_bucket")
    queued = queued.withColumn("end", F.col("offset") + F.col("inside"))
    kept = ["doc_id", "source", "size", "parts", "part", "rows", "source_size", "target", "rank", "weight", "shuffle_key", "end"]
    queued = jobs.stored(queued.select(*kept), "queued")
    jobs.discard(units)
    return queued, budget


def merged(queued: DataFrame, budget: float, repeats: int) -> DataFrame:
    """The stored entries (a unit's columns, epoch, finish, rank, shuffle_key) that the budget has room for.

    Entries are sorted into ranges of the whole order.  The first entry that would go over the budget, and all after it,
    stay out.
    """
    order = [F.col(c) for c in ("finish", "rank", "shuffle_key", "doc_id", "size", "part")]
    finish = (F.col("epoch") * F.col("source_size") + F.col("end")).cast("double") / F.col("weight")
    entries = queued.select("doc_id", "source", "size", "parts", "part", "rows", "rank", "weight", "shuffle_key", "source_size", "end", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch"))
    entries = entries.withColumn("finish", finish).drop("weight", "source_size", "end")
    ranged = jobs.stored(entries.repartitionByRange(jobs.partitions(queued.sparkSession), *order).withColumn("range", F.spark_partition_id()), "entries")
    size = F.col("size") * F.col("rows")
    # a row for each range
    before = F.coalesce(F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranged.groupBy("range").agg(F.sum(size).alias("words")).select(F.col("range").alias("of_range"), before.alias("shift"))
    running = F.sum(size).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    taken = ranged.withColumn("running", running).join(F.broadcast(shifts), F.col("range") == F.col("of_range")).where(F.col("shift") + F.col("running") <= budget)
    taken = jobs.stored(taken.drop("of_range", "shift", "running", "range"), "merged")
    jobs.discard(ranged)
    return taken


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, copies, finish), a row for each unit of docs, see queue().

    docs has doc_id, text and source; other columns are not read.  `copies` is how often the mix takes the rows of the
    unit, 0 to repeats, and `finish` its first finish time.  Null texts have size 0; a null source is a source of its own;
    null doc_ids are queued like others.  An empty table gives an empty result.
    """
    queued, budget = queue(docs, weights, share, repeats)
    taken = merged(queued, budget, repeats).groupBy(F.col("shuffle_key").alias("of_key"), F.col("rank").alias("of_rank"), F.col("size").alias("of_size")).agg(F.count("*").alias("copies"))
    same = (F.col("shuffle_key") == F.col("of_key")) & (F.col("rank") == F.col("of_rank")) & (F.col("size") == F.col("of_size"))
    finish = F.col("end").cast("double") / F.col("weight")
    return queued.join(taken, same, "left").select("doc_id", "source", "size", "rows", "source_size", "target", F.coalesce("copies", F.lit(0)).cast("int").alias("copies"), finish.alias("finish"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The rows that the mix takes, each as often as it takes them, with the columns of docs, sorted into the merged order."""
    queued, budget = queue(docs, weights, share, repeats)
    repeated = queued.where("parts > 1").select("doc_id", "source", "size", "parts").distinct()
    entries = merged(queued, budget, repeats).select(*[F.col(c).alias(f"__of_{c}") for c in ("doc_id", "source", "size", "part", "finish", "rank", "shuffle_key")])
    sized = docs.withColumn("__size", words(F.col("text"))).withColumn("__part", F.lit(0).cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in ("doc_id", "source")]
    if not repeated.isEmpty():
        twice = repeated.select(*[F.col(c).alias(f"__of_{c}") for c in ("doc_id", "source", "size", "parts")])
        twin = same[0] & same[1] & (F.col("__size") == F.col("__of_size"))
        equal = sized.join(twice, twin).drop("__of_doc_id", "__of_source", "__of_size")
        numbered = jobs.numbered_in_groups(equal, ["doc_id", "source", "__size"], "__number").withColumn("__part", F.col("__number") % F.col("__of_parts"))
        sized = sized.join(twice, twin, "left_anti").unionByName(numbered.select(*[F.col(f"`{c}`") for c in sized.columns]))
    joined = sized.join(entries, same[0] & same[1] & (F.col("__size") == F.col("__of_size")) & (F.col("__part") == F.col("__of_part")))
    order = [F.col(f"__of_{c}") for c in ("finish", "rank", "shuffle_key", "part")]
    ranged = joined.repartitionByRange(jobs.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`, mixed to weights 3, 1, 2 of the sources in turn and 150 % of all words; finish is the first finish time."""
    found = mix(jobs.table(spark, sf_dir, "documents"))
    each = found.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "finish")


ORACLE_SQL = r"""
WITH grouped AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, count(*) AS all_rows
  FROM documents GROUP BY ALL
), units AS (
  SELECT doc_id, source, size, p, all_rows // least(all_rows, 1000) + (p < all_rows % least(all_rows, 1000))::BIGINT AS n,
         md5(coalesce(doc_id::VARCHAR, '') || CASE p WHEN 0 THEN '' ELSE '#' || p END) AS k
  FROM grouped, unnest(range(least(all_rows, 1000))) AS t(p)
), sources AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM (SELECT source, sum(size * n)::BIGINT AS source_size FROM units GROUP BY source)
), steps AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS budget,
         coalesce(sum(2 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM sources
), levels AS (
  -- the first source, by size over weight, that its share doesn't fill sets the level
  SELECT (budget - capped::DOUBLE) / open_weight::DOUBLE AS level, budget
  FROM steps WHERE 2.0 * source_size >= (budget - capped::DOUBLE) / open_weight::DOUBLE * weight
  ORDER BY source_size::DOUBLE / weight, rank LIMIT 1
), queued AS (
  SELECT u.*, s.source_size, s.weight, s.rank, l.budget, least(2.0::DOUBLE * s.source_size, l.level * s.weight) AS target,
         sum(u.size * u.n) OVER (PARTITION BY u.source ORDER BY u.k, u.doc_id, u.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM units u JOIN sources s ON u.source IS NOT DISTINCT FROM s.source, levels l
), entries AS (
  SELECT *, (e * source_size + upto)::DOUBLE / weight AS finish FROM queued, (VALUES (0), (1)) epochs(e)
), merged AS (
  SELECT *, sum(size * n) OVER (ORDER BY finish, rank, k, doc_id, size, p ROWS UNBOUNDED PRECEDING) AS running FROM entries
), chosen AS (
  SELECT doc_id, source, size, p, n, source_size, target, min(finish) AS finish, count(*) FILTER (WHERE running <= budget) AS copies
  FROM merged GROUP BY ALL
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, finish FROM chosen, unnest(range(n))
"""
