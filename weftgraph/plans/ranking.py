"""First, latest and top rows, samples and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import windows
from weftgraph.plans.registry import query, table


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderpriority, o_orderkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.top_per_group(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 5)
    return found.select("o_orderpriority", "o_orderkey", "rank")


@query("SELECT p_partkey, i::INTEGER AS seq, string_split(p_name, ' ')[i] AS step FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS t(i)")
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sequence_numbers(table(spark, sf_dir, "part").withColumn("steps", F.split("p_name", " ")), "steps", "p_partkey")


EVEN = """SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
WHERE n <= 4 OR place IN (SELECT round_even(i::DOUBLE * (n - 1) / 3, 0)::BIGINT FROM range(4) AS t(i))"""


@query(EVEN)
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts of each brand, evenly spaced."""
    parts = table(spark, sf_dir, "part")
    brands = {r[0]: 4 for r in parts.select("p_brand").distinct().collect()}  # one entry for each kind
    return windows.even_sample(parts, ["p_partkey"], brands, "p_brand").select("p_brand", "p_partkey")


@query("""WITH r AS (SELECT *, p_size > 40 AS marked FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY marked ORDER BY p_partkey) AS nth FROM r)
SELECT p_partkey FROM k WHERE nth <= 20 ORDER BY NOT (marked AND nth <= 5), marked DESC, p_partkey LIMIT 20""")
def reserved_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty parts, a quarter of them reserved; a sampling operator."""
    return windows.reserved_first(table(spark, sf_dir, "part"), F.col("p_size") > 40, ["p_partkey"], 20).select("p_partkey")


@query("""SELECT p_partkey, (SELECT count(*) FROM part WHERE lower(p_name || ' ' || p_brand) LIKE '%ring brand#1%') AS total FROM part WHERE lower(p_name || ' ' || p_brand) LIKE '%ring brand#1%' ORDER BY p_partkey LIMIT 10""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten hits of a search with the number of all."""
    total, rows = windows.page(table(spark, sf_dir, "part"), "RING brand#1", ["p_name", "p_brand"], ["p_partkey"], 10)
    return rows.select("p_partkey", F.lit(total).cast("long").alias("total"))


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 30")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty events, oldest first."""
    return windows.recent(table(spark, sf_dir, "events"), "event_id", 30).select("event_id")


@query("""WITH b AS (SELECT p_type AS kind, count(*) AS n, count(*) FILTER (WHERE p_size > 45) AS m FROM part GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS kinds FROM b), q1 AS (SELECT kind, n, m, 1 + floor((100 - kinds) * (n - 1) / (total - kinds))::BIGINT AS q FROM b, t),
q2 AS (SELECT *, row_number() OVER (ORDER BY n DESC, kind) AS nth, 100 - sum(q) OVER () AS spare FROM q1), quota AS (SELECT kind, n, m, (q + CASE WHEN nth = 1 THEN spare ELSE 0 END)::BIGINT AS q FROM q2),
s AS (SELECT *, least(q - least((q + 4) // 5, m), n - m) AS o FROM quota), placed AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type, p_size > 45 ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_type, p_size > 45) AS n, p_size > 45 AS marked FROM part),
chosen AS (SELECT p_type, p_partkey, place, p.n, CASE WHEN marked THEN least(q - o, m) ELSE o END AS k FROM placed p JOIN s ON kind = p_type)
SELECT p_type, p_partkey FROM chosen WHERE k >= n OR k = 1 AND place = n // 2 OR k > 1 AND list_contains(list_transform(range(k), lambda i: round_even(i * (n - 1)::DOUBLE / (k - 1), 0)::BIGINT), place)""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred parts over the types by quota, a fifth reserved for large ones; a sampling operator."""
    return windows.balanced_sample(table(spark, sf_dir, "part"), "p_type", ["p_partkey"], 100, F.col("p_size") > 45).select("p_type", "p_partkey")
