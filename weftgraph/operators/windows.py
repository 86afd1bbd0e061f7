"""First, latest and top rows of a key, even samples and quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import stored


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in order; order should leave no ties."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def latest_per_key(rows: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The row of the greatest `at` of each key, nulls last, ties by the greatest `tie`."""
    return first_per_key(rows, keys, [F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def sequence_numbers(rows: DataFrame, steps: str, *keep: str) -> DataFrame:
    """The elements of an array column, numbered from 1."""
    return rows.select(*keep, F.posexplode(steps).alias("_pos", "step")).select(*keep, (F.col("_pos") + 1).alias("seq"), "step")


def even_positions(n: Column, k: Column) -> Column:
    """The k positions round(i * (n - 1) / (k - 1)), halves to even, of n; all where k >= n, the middle one where k is 1."""
    some = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.bround(i.cast("double") * (n - 1) / F.greatest(k - 1, F.lit(1)), 0).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long"))
    return F.when((k <= 0) | (n <= 0), F.array().cast("array<bigint>")).when(k >= n, every).when(k == 1, F.array(F.floor(n / 2).cast("long"))).otherwise(F.array_distinct(some))


def numbered(rows: DataFrame, order: Sequence[str], group: str, name: str, total: str) -> DataFrame:
    """rows with a gapless number from 0 in the order of each group, and the group's size; null is a group.

    Rows are sorted into ranges of (group, order); a range numbers its rows and is shifted by the counts of the ranges
    before it, so no task sees a whole group.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = stored(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    # a row for each range and each group in it
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_rows"))
    mine = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(mine.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = stored(counts.select(F.col(group).alias("_of"), F.col("_range").alias("_in"), before.alias("_shift"), F.sum("_rows").over(mine).alias(total)), "shifts")
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*keys[1:])) - 1
    joined = ranged.withColumn("_own", own).join(shifts, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    return joined.withColumn(name, F.col("_own") + F.col("_shift")).drop("_range", "_of", "_in", "_shift", "_own")


def even_sample(rows: DataFrame, order: Sequence[str], k: Mapping[str, int] | int, group: str | None = None) -> DataFrame:
    """An evenly spaced sample in order, k rows of all or of each group (quotas by group value)."""
    marked = rows.withColumn("_group", F.col(group).cast("string") if group else F.lit(""))
    if not isinstance(k, int):
        quotas_ = rows.sparkSession.createDataFrame([(str(name), int(n)) for name, n in k.items()], "_group string, _quota int")
        marked = marked.join(F.broadcast(quotas_), "_group")
    else:
        marked = marked.withColumn("_quota", F.lit(k))
    placed = numbered(marked, order, "_group", "_at", "_n")
    # whether the row's place is one of the quota's even places, by the place that is nearest to it
    at, n, quota = F.col("_at"), F.col("_n"), F.col("_quota")
    step = F.greatest((n - 1) / F.greatest(quota - 1, F.lit(1)), F.lit(1e-9))
    near = F.bround(at / step, 0)
    hit = F.exists(F.array(near - 1, near, near + 1), lambda i: (i >= 0) & (i < quota) & (F.bround(i.cast("double") * (n - 1) / F.greatest(quota - 1, F.lit(1)), 0).cast("long") == at))
    taken = F.when(quota <= 0, False).when(quota >= n, True).when(quota == 1, at == F.floor(n / 2)).otherwise(hit)
    return placed.where(taken).drop("_group", "_quota", "_at", "_n")


def first_values(rows: DataFrame, group: Sequence[str], value: str, k: int, name: str) -> DataFrame:
    """(the group's columns, an array of its k smallest distinct values); tasks pass on k values of a group at most."""
    distinct = rows.select(*group, value).where(F.col(value).isNotNull()).distinct()
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(value))
    return distinct.withColumn("_nth", nth).where(F.col("_nth") <= k).groupBy(*group).agg(F.array_sort(F.collect_list(value)).alias(name))


def quotas(sizes: Mapping[str, int], limit: int, floor: int = 1) -> dict[str, int]:
    """How many of each kind to take: all if they fit, else a floor for each and shares of the rest in proportion to what is left of it.

    No kind gets more than its size; what rounding leaves over goes to the largest kinds, as much as they hold.  Floors
    alone may be more than the limit.
    """
    held = {k: n for k, n in sizes.items() if n > 0}
    if limit >= sum(held.values()):
        return held
    given = {k: min(floor, n) if limit > 0 else 0 for k, n in held.items()}
    rest, room = limit - sum(given.values()), sum(held.values()) - sum(given.values())
    if rest > 0:
        given = {k: g + rest * (held[k] - g) // room for k, g in given.items()}
    left = limit - sum(given.values())
    for k in sorted(held, key=lambda k: (-held[k], str(k))):
        more = max(0, min(held[k] - given[k], left))
        given[k] += more
        left -= more
    return given


def balanced_sample(rows: DataFrame, kind: str, order: Sequence[str], limit: int, reserve: Column | None = None) -> DataFrame:
    """An even sample of each kind by quota, with a fifth of a kind's quota kept for the rows that `reserve` marks.

    What the reserved rows leave unused returns to the others.  Sorted by kind and order.
    """
    sizes = {r[kind]: r["n"] for r in rows.groupBy(kind).agg(F.count("*").alias("n")).collect()}  # one row for each kind
    given = quotas(sizes, limit)
    if reserve is None:
        return even_sample(rows, order, given, kind).orderBy(kind, *order)
    marked = rows.withColumn("_reserved", F.coalesce(reserve, F.lit(False)))
    held = {(r[kind], r["_reserved"]): r["n"] for r in marked.groupBy(kind, "_reserved").agg(F.count("*").alias("n")).collect()}
    first = {k: min((n + 4) // 5, held.get((k, True), 0)) for k, n in given.items()}
    others = {k: min(given[k] - first[k], held.get((k, False), 0)) for k in given}
    first = {k: min(given[k] - others[k], held.get((k, True), 0)) for k in given}
    picked = even_sample(marked.where("_reserved"), order, first, kind).unionByName(even_sample(marked.where("not _reserved"), order, others, kind))
    return picked.drop("_reserved").orderBy(kind, *order)


def reserved_first(rows: DataFrame, reserve: Column, order: Sequence[str], limit: int) -> DataFrame:
    """At most `limit` rows, a quarter of them for marked rows, which come first."""
    ranked = rows.withColumn("_reserved", F.coalesce(reserve, F.lit(False)))
    ranked = ranked.withColumn("_nth", F.row_number().over(Window.partitionBy("_reserved").orderBy(*order)))
    quarter = (limit + 3) // 4
    return ranked.where(F.col("_nth") <= limit).orderBy(~(F.col("_reserved") & (F.col("_nth") <= quarter)), F.desc("_reserved"), *order).limit(limit).drop("_reserved", "_nth")


def page(rows: DataFrame, search: str, columns: Sequence[str], order: Sequence[str], limit: int) -> tuple[int, DataFrame]:
    """(rows that hold the search text in any case, the first `limit` of them)."""
    text = F.lower(F.concat_ws(" ", *columns))
    hits = rows.where(text.contains(search.lower())) if search else rows
    return hits.count(), hits.orderBy(*order).limit(limit)


def after(rows: DataFrame, cursor: str, value: int, limit: int | None = None) -> DataFrame:
    """Rows beyond a cursor, ascending."""
    found = rows.where(F.col(cursor) > value).orderBy(cursor)
    return found.limit(limit) if limit else found


def recent(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows, oldest first."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)
