"""Counts, splits, coverage, cascades and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators import aggregates
from weftgraph.plans.graphs import EDGE_SQL, part_of
from weftgraph.plans.registry import query, table


@query("""SELECT 'lang' AS key, coalesce(lang, 'None') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, 'None'), count(*) FROM documents GROUP BY ALL""")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.index_statistics(table(spark, sf_dir, "documents"), ("lang", "source"))


@query("SELECT c_mktsegment, coalesce(n_name, '?') AS n_name, count(*) AS n FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 GROUP BY ALL")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return aggregates.counts_by(table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left"), "c_mktsegment", "n_name", missing="?")


@query(f"""WITH {EDGE_SQL} SELECT (SELECT count(*) FROM (SELECT src FROM edge UNION SELECT dst FROM edge)) AS nodes, count(*) AS edges,
count(*) FILTER (WHERE src NOT LIKE 'n:%') AS explicit, count(*) FILTER (WHERE src LIKE 'n:%') AS derived FROM edge""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.graph_statistics(part_of(spark, sf_dir).withColumn("derived", F.col("src").startswith("n:")))


@query("""SELECT o_orderpriority AS "group", count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
UNION ALL SELECT 'unmapped', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') HAVING count(*) > 0""")
def multi_membership_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the priorities of their finished orders, each counted in all of them."""
    members = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("group"))
    return aggregates.split_membership(members, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject")))


@query("""SELECT "group", count(*) AS n FROM (SELECT o_custkey, min(o_orderpriority) AS "group" FROM orders GROUP BY o_custkey) GROUP BY 1""")
def exclusive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.split_exclusive(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("group")))


@query("""SELECT split, count(*) AS n FROM (
  SELECT CASE WHEN bool_or(coalesce(event_type IN ('error', 'signup') AND value > 70, false)) THEN 'operational' WHEN bool_or(value > 40) THEN 'knowledge' ELSE 'untagged' END AS split FROM events GROUP BY user_id, ts::DATE
) GROUP BY split""")
def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users by the kinds of their events; low values carry no kind."""
    kind = F.when(F.col("event_type").isin("error", "signup") & (F.col("value") > 70), "observed").when(F.col("value") > 40, "web")
    return aggregates.split_sources(table(spark, sf_dir, "events").select(F.concat_ws("|", "user_id", F.to_date("ts")).alias("subject"), kind.alias("source_type")), ["observed", "internal_feature"])


@query("""WITH f AS (SELECT r_name, n_name, c_mktsegment, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 1 AS level, r_name, NULL::VARCHAR AS n_name, NULL::VARCHAR AS c_mktsegment, count(DISTINCT c_custkey) AS n FROM f GROUP BY r_name
UNION ALL SELECT 2, r_name, n_name, NULL, count(DISTINCT c_custkey) FROM f GROUP BY r_name, n_name UNION ALL SELECT 3, r_name, n_name, c_mktsegment, count(DISTINCT c_custkey) FROM f GROUP BY r_name, n_name, c_mktsegment""")
def cascade_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return aggregates.cascade(facts, ["r_name", "n_name", "c_mktsegment"], "c_custkey")


@query("""SELECT source, count(*) AS total, count(l) AS mapped, count(*) - count(l) AS unmapped, round(100.0::DOUBLE * count(l) / count(*), 1) AS pct FROM (
  SELECT DISTINCT d.doc_id, source, l.doc_id AS l FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id) GROUP BY source""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "source")


@query("""WITH lost AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)), names AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS k FROM (SELECT DISTINCT p_brand, p_name FROM lost))
SELECT p_brand, count(*) AS unmapped, (SELECT string_agg(p_name, ',' ORDER BY p_name) FROM names WHERE names.p_brand = lost.p_brand AND k <= 5) AS samples FROM lost GROUP BY p_brand ORDER BY unmapped DESC, p_brand LIMIT 8""")
def feature_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight brands with most parts that no large line has; a top-k report."""
    mapped = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return aggregates.gap(table(spark, sf_dir, "part"), mapped, "p_partkey", "p_brand", "p_name").withColumn("samples", F.array_join("samples", ","))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS covered, round(count(*) FILTER (WHERE hit)::DOUBLE / count(*), 6) AS coverage FROM (
  SELECT p_name, lower(trim(p_name)) IN (SELECT lower(trim(p_name)) FROM part WHERE p_size > 48) AS hit FROM (SELECT DISTINCT lower(trim(p_name)) AS p_name FROM part))""")
def alignment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return aggregates.alignment(parts, parts.where("p_size > 48"), "p_name")


@query("""SELECT p_brand AS family, count(*) AS n, (SELECT string_agg(p_type, ',' ORDER BY p_type) FROM (SELECT DISTINCT p_type FROM part q WHERE q.p_brand = part.p_brand)) AS citations, bool_or(p_size = 50) AS restricted FROM part GROUP BY p_brand""")
def source_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_type").alias("citation"), F.when(F.col("p_size") == 50, "restricted").alias("classification"))
    return aggregates.families(entries).withColumn("citations", F.array_join("citations", ","))


@query("""SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, 'value' AS key, sum(greatest(0, v - b))::BIGINT AS added FROM (
  SELECT ts, round(value * 100)::BIGINT AS v, coalesce(lag(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS b FROM events) GROUP BY 1""")
def today_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the users' values gained on each local day, falls as 0."""
    cents = F.round(F.col("value") * 100).cast("long")
    before = F.coalesce(F.lag(cents).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0))
    rounds = table(spark, sf_dir, "events").select("ts", cents.alias("after_value"), before.alias("before_value"))
    return aggregates.daily_increase(rounds, F.date_format(F.col("ts") + F.expr("interval 8 hours"), "yyyy-MM-dd"), ["value"])


@query("""SELECT c_mktsegment AS side, o_orderpriority AS dimension, sum(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END)::BIGINT AS delta
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 HAVING delta <= 0""")
def balance_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and priorities with no more finished than open orders."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    deltas = joined.groupBy(F.col("c_mktsegment").alias("side"), F.col("o_orderpriority").alias("dimension")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)).alias("delta"))
    return aggregates.shortfall(deltas, table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("side")).agg(F.count("*").alias("weight")))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS entry, l_suppkey AS ref FROM lineitem), t AS (SELECT count(DISTINCT entry) AS n FROM p), u AS (SELECT ref, count(*) AS n FROM p GROUP BY ref),
f AS (SELECT ref, u.n >= 0.9 * t.n AND t.n >= 20 AS generic, s_suppkey IS NOT NULL AS known FROM u CROSS JOIN t LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000) ON s_suppkey = ref)
SELECT round((SELECT count(*) FILTER (WHERE known) FROM f)::DOUBLE / (SELECT count(*) FROM f), 4) AS integrity,
round((SELECT count(DISTINCT entry) FROM p JOIN f USING (ref) WHERE NOT generic)::DOUBLE / (SELECT n FROM t), 4) AS specificity,
round((SELECT count(*) FILTER (WHERE known) FROM f)::DOUBLE / (SELECT count(*) FROM supplier WHERE s_acctbal > 1000), 4) AS touch""")
def reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_suppkey").alias("ref"))
    return aggregates.integrity(entries, table(spark, sf_dir, "supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").alias("ref")))


@query("""SELECT source AS file, count(*) AS total, count(*) FILTER (WHERE (CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) IS DISTINCT FROM quality) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def golden_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return aggregates.golden(rows.select(F.col("source").alias("file"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("expected"), F.col("quality").alias("verdict")))


@query("""SELECT p_brand, string_agg(DISTINCT w, ',' ORDER BY w) AS words FROM part, unnest(string_split(p_name, ' ')) AS t(w) GROUP BY p_brand""")
def approved_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.approved_sets(table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " ")), ["p_brand"], "words")
    return found.withColumn("words", F.array_join("words", ","))


@query("""WITH t AS (SELECT 'c:' || c_custkey AS s, c_mktsegment AS type FROM customer UNION ALL SELECT 'c:' || c_custkey, 'AuditRecord' FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 's:' || s_suppkey, 'GateAudit' FROM supplier UNION ALL SELECT 's:' || s_suppkey, 'Class' FROM supplier WHERE s_acctbal > 5000) SELECT s AS subject, type FROM t WHERE s LIKE 'c:%'""")
def individual_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types without structural ones and without subjects that are all governance."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    c, s = F.concat(F.lit("c:"), "c_custkey"), F.concat(F.lit("s:"), "s_suppkey")
    types = customers.select(c.alias("subject"), F.col("c_mktsegment").alias("type")).union(customers.where("c_acctbal < 0").select(c, F.lit("AuditRecord")))
    types = types.union(suppliers.select(s, F.lit("GateAudit"))).union(suppliers.where("s_acctbal > 5000").select(s, F.lit("Class")))
    domains = customers.select(F.col("c_mktsegment").alias("type"), F.lit("market").alias("module")).distinct()
    return aggregates.individuals(types, ["Class"], ["audit"], domains)
