"""Applying changes: merges, mappings, content states, gates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import changes
from weftgraph.plans.registry import query, table
from weftgraph.storage import Round, shared_folder


@query("""SELECT o_custkey AS id, o_orderkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1 AND o_custkey % 3 <> 0 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey % 3 = 0""")
def changes_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first proposal of each new id beside the rows that are there."""
    current = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("v"))
    return changes.added(current, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("v")), ["id"], ["v"])


MAPPING = """WITH p AS (SELECT lower(trim(p_name)) AS code, p_type AS target, p_partkey AS ord FROM part), cur AS (SELECT DISTINCT lower(p_name) AS code FROM part WHERE p_name LIKE 'red %'),
j AS (SELECT p.*, CASE WHEN target = 'SMALL' THEN 'undeclared target' WHEN code LIKE '% bolt' THEN 'unknown code' WHEN code IN (SELECT code FROM cur) AND target <> 'LARGE' THEN 'occupied' WHEN code IN (SELECT code FROM cur) THEN 'present' END AS reason FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY code, reason IS NULL ORDER BY ord) AS nth FROM j)"""


def mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part")
    proposed = parts.select(F.concat(F.lit(" "), F.upper("p_name")).alias("code"), F.col("p_type").alias("target"), F.col("p_partkey").alias("ord"))
    current = parts.where("p_name like 'red %'").select(F.lower("p_name").alias("code"), F.lit("LARGE").alias("target")).distinct()
    return changes.property_mappings(current, proposed, parts.where("p_type <> 'SMALL'").select(F.col("p_type").alias("target")), parts.where("p_name not like '% bolt'").select(F.col("p_name").alias("code")))


@query(MAPPING + " SELECT code, 'LARGE' AS target FROM cur UNION ALL SELECT code, target FROM k WHERE reason IS NULL AND nth = 1")
def changes_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir)[0]


@query(MAPPING + " SELECT code, target, coalesce(reason, 'later proposal') AS reason, count(*) AS n FROM k WHERE reason <> 'present' OR (reason IS NULL AND nth > 1) GROUP BY ALL")
def changes_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir)[1].groupBy("code", "target", "reason").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_size < 25 THEN 'same' ELSE 'conflict' END AS state FROM part")
def changes_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical content is skipped, other content of a known id goes to quarantine."""
    parts = table(spark, sf_dir, "part")
    current = parts.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.expr("if(p_size < 25, p_name, 'x')").alias("content"))
    return changes.by_content(current, parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content")), "id", "content").select("id", "state")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'only additions apply by themselves' WHEN c_custkey % 4 = 3 THEN 'no provenance' WHEN c_acctbal < 0 THEN 'confidence' WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'web source without reference' WHEN c_mktsegment <> 'BUILDING' THEN 'verdict' ELSE 'auto' END AS gate FROM customer""")
def changes_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.expr("case c_custkey % 4 when 0 then 'web' when 1 then 'human' when 2 then 'human' end")
    provenance = F.struct(source.alias("source_type"), F.expr("if(c_custkey % 3 = 0, '', 'r')").alias("ref"), F.expr("if(c_acctbal < 0, 'low', 'high')").alias("confidence"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("if(c_custkey % 9 = 0, 'deletion', 'addition')").alias("kind"), provenance.alias("provenance"), F.expr("if(c_mktsegment = 'BUILDING', 'pass', null)").alias("verdict"))
    return changes.classified(rows).select("id", "gate")


@query("SELECT o_custkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'skipped' WHEN o_custkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM (SELECT DISTINCT o_custkey FROM orders)")
def changes_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return changes.batch_status(ids, ids.where("id % 5 = 0"), ids.where("id % 7 = 0").withColumn("reason", F.lit("gate"))).select("id", "status")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P'))")
def changes_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay when finished orders go."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"))
    return changes.purged(orders, table(spark, sf_dir, "lineitem"), "l_orderkey", ["O", "P"])[1].select("l_orderkey", "l_linenumber")


@query("""WITH o AS (SELECT o_custkey AS gate, max(o_orderstatus = 'P') AS bad FROM orders GROUP BY 1), c AS (SELECT c_custkey AS gate, coalesce(bad, false) AS bad, c_custkey % 10 = 0 AS changed FROM customer LEFT JOIN o ON gate = c_custkey)
SELECT gate, CASE WHEN bad OR changed AND gate % 20 = 0 THEN 'fail' ELSE 'pass' END AS status, NOT bad AND NOT changed AS hit FROM c""")
def gate_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two checks of each customer and all of its orders: a tenth have changed since the first, a twentieth so that they fail; the rest that passed is not checked again."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gate"), F.lit("customer").alias("input"), F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("string").alias("value"), F.lit("").alias("status"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gate"), F.lit("orders").alias("input"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("string").alias("value"), F.col("o_orderstatus").alias("status"))
    path = f"{shared_folder(spark)}/weft-memo-{uuid.uuid4().hex}"
    before = customers.unionByName(orders)
    after = before.repartition(5, "id").withColumns({"value": F.when((F.col("gate") % 10 == 0) & (F.col("input") == "customer"), F.concat("value", F.lit("0"))).otherwise(F.col("value")), "status": F.when((F.col("gate") % 20 == 0) & (F.col("input") == "customer"), "P").otherwise(F.col("status"))})

    def pending(rows: DataFrame) -> DataFrame:
        return rows.where("status = 'P'").select("gate")

    changes.checked(before, "gate", pending, path)
    return changes.checked(after, "gate", pending, path)


@query("""WITH t AS (SELECT o_custkey, sum(o_totalprice)::DECIMAL(38, 2) AS spent FROM orders GROUP BY 1), n AS (SELECT c_nationkey, c_custkey, spent FROM t JOIN customer ON c_custkey = o_custkey)
SELECT c_nationkey, count(*) AS customers, max(spent)::VARCHAR AS most, 'spent:1,joined:1,grouped:2' AS runs FROM n GROUP BY c_nationkey""")
def resumed_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round whose last stage fails the first time: the second driver goes on from the stage before it."""
    folder = f"{shared_folder(spark)}/weft-round-{uuid.uuid4().hex}"
    tries: dict[str, int] = {}

    def counted(name: str, make: Callable[[DataFrame], DataFrame]) -> tuple[str, Callable[[DataFrame], DataFrame]]:
        def run(rows: DataFrame) -> DataFrame:
            tries[name] = tries.get(name, 0) + 1
            return make(rows)

        return name, run

    def grouped(rows: DataFrame) -> DataFrame:
        most = rows.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.max("spent").cast("string").alias("most"))
        return most.withColumn("customers", F.raise_error(F.lit("lost"))) if tries["grouped"] == 1 else most

    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    stages = [counted("spent", lambda o: o.groupBy("o_custkey").agg(F.sum("o_totalprice").cast("decimal(38,2)").alias("spent"))), counted("joined", lambda t: t.join(customers, "o_custkey")), counted("grouped", grouped)]
    for attempt in (1, 2):
        try:
            found = Round(spark, folder).run(lambda: table(spark, sf_dir, "orders"), stages)
        except Exception:
            if attempt == 2:
                raise
    return found.withColumn("runs", F.lit(",".join(f"{name}:{tries[name]}" for name, _ in stages)))


_PARTS_SQL = " || '|' || ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT)" for k in range(8))


@query(f"""WITH j AS (SELECT c_custkey, sha256('{{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}}') AS h FROM customer),
t AS (SELECT pair, h FROM j, (VALUES ('same'), ('dealt anew'), ('rows repeated')) v(pair) UNION ALL SELECT 'rows repeated', h FROM j WHERE c_custkey % 3 = 0)
SELECT pair, sha256(count(*) || '|' || {_PARTS_SQL}) AS fingerprint FROM t GROUP BY pair""")
def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints that decide whether a stage runs again: of a table, of its rows in another order, and with some rows twice."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    pairs = [("same", rows), ("dealt anew", rows.repartition(7)), ("rows repeated", rows.unionByName(rows.where("c_custkey % 3 = 0")))]
    return spark.createDataFrame([(name, changes.fingerprint(df)) for name, df in pairs], "pair string, fingerprint string")
