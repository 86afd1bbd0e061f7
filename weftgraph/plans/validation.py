"""Structural rules over entities made of customers: ids `fab.<segment>.<key>`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import checks
from weftgraph.plans.graphs import next_nation
from weftgraph.plans.registry import query, table

ID = "concat('fab.', lower(c_mktsegment), '.', c_custkey)"
CONTRACT = {
    "entity_types": {"BUILDING": {"type_slug": "building"}, "AUTOMOBILE": {"type_slug": "car"}},
    "id_rules": {"pattern": "^fab\\.[a-z]+\\.[0-9]*[02468]$"},
    "relation_types": {"placed": {"from": ["BUILDING", "MACHINERY", "FURNITURE"], "to": ["F", "O"]}},
    "provenance_schema": {"source_type": {"allowed": ["web", "human"]}, "confidence": {"allowed": ["low", "high"]}},
    "likelihood_schema": {"allowed": ["high", "low"], "applies_to": ["may_cause"]},
}


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities: domain, provenance and hooks follow from their keys and balances."""
    source = F.expr("case c_custkey % 4 when 0 then 'web' when 1 then 'human' when 2 then 'rumour' end")
    return table(spark, sf_dir, "customer").select(
        F.expr(ID).alias("id"), F.col("c_mktsegment").alias("type"), F.expr("if(c_nationkey < 20, 'fab', 'ap')").alias("domain"),
        F.struct(source.alias("source_type"), F.expr("if(c_custkey % 3 = 0, '', 'r')").alias("ref"), F.expr("if(c_acctbal < 0, 'low', 'high')").alias("confidence"), F.lit("2024-01-01").alias("created_at")).alias("provenance"),
        F.array(F.concat(F.lit("h"), F.col("c_custkey") % 7)).alias("hooks"), F.lit(None).cast("string").alias("_file"), F.col("c_custkey").alias("_ord"),
    )


@query("SELECT 'R001' AS rule, o_custkey::VARCHAR AS subject, count(*) - 1 AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def violations_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows with the id of their customer."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("_ord"))
    return checks.duplicate_ids(rows).groupBy("rule", "subject").agg(F.count("*").alias("n"))


@query("""SELECT 'fab.' || lower(c_mktsegment) || '.' || c_custkey AS subject, CASE WHEN c_custkey % 2 = 1 THEN 'id does not match the pattern' ELSE 'id does not name the type' END AS detail
FROM customer WHERE c_custkey % 2 = 1 OR c_mktsegment = 'AUTOMOBILE'""")
def violations_malformed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.malformed_ids(entities(spark, sf_dir), CONTRACT).select("subject", "detail")


@query("""SELECT p_partkey::VARCHAR AS subject, detail FROM part, unnest([CASE WHEN p_type NOT IN ('SMALL', 'LARGE') THEN 'unknown type ' || p_type END, CASE WHEN p_size > 40 THEN 'unknown field size' END, CASE WHEN p_size % 2 = 0 THEN 'missing field name' END]) AS t(detail) WHERE detail IS NOT NULL""")
def violations_field_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.filter(F.array(F.lit("id"), F.when(F.col("p_size") > 40, "size"), F.when(F.col("p_size") % 2 != 0, "name")), lambda k: k.isNotNull())
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), keys.alias("keys"))
    return checks.field_contract(rows, ["SMALL", "LARGE"], ["id", "name"], []).select("subject", "detail")


@query("SELECT l_orderkey::VARCHAR AS subject, 'part -> ' || l_partkey AS detail FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 3")
def violations_dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part is not among the known ones."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("part").alias("field"), F.col("l_partkey").cast("string").alias("ref"))
    known = table(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").cast("string").alias("id"))
    return checks.dangling_refs(refs, known).select("subject", "detail")


@query("""WITH e AS (SELECT 'c' || o_custkey AS src, CASE WHEN o_orderkey % 10 = 0 THEN 'sent' ELSE 'placed' END AS rel, 'o' || o_orderkey AS dst, c_mktsegment AS ft, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS tt FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0)
SELECT 'R005' AS rule, src || '|' || rel || '|' || dst AS subject, 'unknown relation type' AS detail FROM e WHERE rel = 'sent'
UNION ALL SELECT 'R004', src || '|' || rel || '|' || dst, 'from end is missing: ' || src FROM e WHERE rel = 'placed' AND ft IS NULL UNION ALL SELECT 'R004', src || '|' || rel || '|' || dst, 'to end is missing: ' || dst FROM e WHERE rel = 'placed' AND tt IS NULL
UNION ALL SELECT 'R005', src || '|' || rel || '|' || dst, 'from end may not be ' || ft FROM e WHERE rel = 'placed' AND ft NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') UNION ALL SELECT 'R005', src || '|' || rel || '|' || dst, 'to end may not be ' || tt FROM e WHERE rel = 'placed' AND tt NOT IN ('F', 'O')""")
def violations_relation_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.expr("if(o_orderkey % 10 = 0, 'sent', 'placed')").alias("rel_type"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("type"))
    known = known.union(orders.where("o_orderkey % 7 <> 0").select(F.concat(F.lit("o"), "o_orderkey"), "o_orderstatus"))
    return checks.relation_ends(edges, known, CONTRACT).select("rule", "subject", "detail")


@query("""SELECT 'fab.' || lower(c_mktsegment) || '.' || c_custkey AS subject, detail FROM customer, unnest([CASE WHEN c_custkey % 4 >= 2 THEN 'source_type' END, CASE WHEN c_custkey % 12 = 0 THEN 'web source without ref' END]) AS t(detail) WHERE detail IS NOT NULL""")
def violations_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.provenance(entities(spark, sf_dir), CONTRACT, F.col("id")).select("subject", "detail")


@query("SELECT 'fab.' || lower(c_mktsegment) || '.' || c_custkey AS subject, 'domain ap' AS detail FROM customer WHERE c_nationkey >= 20")
def violations_domain_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.domain_prefix(entities(spark, sf_dir)).select("subject", "detail")


@query("SELECT 'fab.' || lower(c_mktsegment) || '.' || c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey % 7 <> 0")
def violations_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a pending order that no reference names."""
    customers = table(spark, sf_dir, "customer")
    edges = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.expr(ID).alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    refs = customers.where("c_custkey % 7 = 0").select(F.lit("route").alias("id"), F.expr(ID).alias("ref"))
    return checks.isolated(entities(spark, sf_dir), edges, refs).select("subject")


@query("""WITH RECURSIVE edge(src, dst) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 20 FROM nation WHERE n_nationkey % 4 <> 0), path AS (SELECT src, dst FROM edge UNION SELECT p.src, e.dst FROM path p JOIN edge e ON p.dst = e.src)
SELECT DISTINCT 'R009' AS rule, src::VARCHAR AS subject FROM path WHERE src = dst""")
def violations_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.acyclic(next_nation(spark, sf_dir)).select("rule", "subject")


@query("""WITH step AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
SELECT user_id::VARCHAR AS subject, src || ' -> ' || dst AS detail, count(*) AS n FROM step WHERE dst IS NOT NULL AND NOT (src = 'click' AND dst = 'view') AND src <> 'view' GROUP BY ALL""")
def violations_route_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of users that no precedes edge allows."""
    routes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"]).alias("steps"))
    kinds = ["click", "view", "purchase", "signup", "error"]
    edges = spark.createDataFrame([("click", "precedes", "view"), *(("view", "precedes", k) for k in kinds)], "src string, rel_type string, dst string")
    return checks.route_steps(routes, edges).groupBy("subject", "detail").agg(F.count("*").alias("n"))


@query("SELECT 'fab.' || lower(c_mktsegment) || '.' || c_custkey AS subject, 'not in the vocabulary: h' || c_custkey % 7 AS detail FROM customer WHERE c_custkey % 7 > 4")
def violations_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.vocabulary(entities(spark, sf_dir), F.col("hooks"), ["h0", "h1", "h2", "h3", "h4"]).select("subject", "detail")


@query("SELECT 'R012' AS rule, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS share FROM customer HAVING avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) > 0.01")
def violations_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.low_confidence(entities(spark, sf_dir), 0.01).select("rule", F.col("detail").cast("double").alias("share"))


@query("""SELECT s_suppkey || '|' || CASE WHEN s_suppkey % 2 = 0 THEN 'may_cause' ELSE 'precedes' END || '|' || s_nationkey AS subject, detail FROM supplier, unnest([CASE WHEN s_suppkey % 3 = 2 THEN 'likelihood sure' END, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 2 = 1 THEN 'this relation has no likelihood' END]) AS t(detail) WHERE detail IS NOT NULL""")
def violations_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.expr("if(s_suppkey % 2 = 0, 'may_cause', 'precedes')").alias("rel_type"), F.col("s_nationkey").alias("dst"), F.expr("case s_suppkey % 3 when 1 then 'high' when 2 then 'sure' end").alias("likelihood"))
    return checks.likelihoods(edges, CONTRACT).select("subject", "detail")


@query("""WITH r AS (SELECT p_partkey, 'fab' AS domain, unnest(['s' || p_partkey % 90, 's' || p_size]) AS ref, unnest(['cause_ref', 'action_ref']) AS label FROM part), e AS (SELECT 's' || s_suppkey AS ref, CASE WHEN s_suppkey % 2 = 0 THEN 'Cause' ELSE 'Action' END AS type, CASE s_suppkey % 5 WHEN 0 THEN 'core' WHEN 1 THEN 'ap' ELSE 'fab' END AS domain FROM supplier WHERE s_suppkey < 80)
SELECT CASE k WHEN 2 THEN 'R015' ELSE 'R014' END AS rule, r.p_partkey::VARCHAR AS subject, (['missing ', 'wrong type ', 'foreign domain '])[k + 1] || label || ' -> ' || r.ref AS detail
FROM r LEFT JOIN e USING (ref), (VALUES (0), (1), (2)) AS v(k)
WHERE CASE k WHEN 0 THEN e.type IS NULL WHEN 1 THEN e.type <> CASE label WHEN 'cause_ref' THEN 'Cause' ELSE 'Action' END ELSE e.domain NOT IN ('core', 'fab') END""")
def violations_case_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of cases that are missing, of a wrong type or of a foreign domain."""
    pairs = F.array(F.struct(F.lit("cause_ref").alias("label"), F.concat(F.lit("s"), F.col("p_partkey") % 90).alias("ref")), F.struct(F.lit("action_ref").alias("label"), F.concat(F.lit("s"), "p_size").alias("ref")))
    refs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("fab").alias("domain"), F.explode(pairs).alias("r")).select("id", "domain", "r.*")
    known = table(spark, sf_dir, "supplier").where("s_suppkey < 80").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.expr("if(s_suppkey % 2 = 0, 'Cause', 'Action')").alias("type"), F.expr("case s_suppkey % 5 when 0 then 'core' when 1 then 'ap' else 'fab' end").alias("domain"))
    return checks.case_ref_checks(refs, known, {"cause_ref": ["Cause"], "action_ref": ["Action"]}).select("rule", "subject", "detail")


@query("""SELECT p_partkey::VARCHAR AS subject, detail FROM part, unnest([CASE WHEN p_size > 48 AND p_size % 2 = 0 THEN 'no text' END, CASE WHEN p_size % 2 = 1 AND p_size > 47 THEN 'no reason' END,
CASE WHEN p_size % 2 = 0 AND p_type NOT IN ('SMALL', 'LARGE') THEN 'undeclared type ' || p_type END, CASE WHEN p_size % 2 = 0 AND p_type <> 'SMALL' THEN 'no instance of ' || p_type END, CASE WHEN p_size % 2 = 0 AND p_partkey % 5 = 0 THEN 'no edge of blocks' END]) AS t(detail) WHERE detail IS NOT NULL""")
def violations_question_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as competency questions: even sizes are in scope."""
    questions = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.expr("if(p_size % 2 = 0, 'in_scope', 'out_of_scope')").alias("bucket"), F.expr("if(p_size > 48 and p_size % 2 = 0, '', p_name)").alias("text"), F.array("p_type").alias("entity_types"),
        F.expr("if(p_partkey % 5 = 0, array('blocks'), array('placed'))").alias("relations"), F.expr("if(p_size > 47, null, 'none')").alias("reason"),
    )
    known = spark.createDataFrame([("x", "SMALL")], "id string, type string")
    edges = spark.createDataFrame([("a", "placed", "b")], "src string, rel_type string, dst string")
    contract = {"entity_types": {"SMALL": {}, "LARGE": {}}, "relation_types": {"placed": {}, "blocks": {}}}
    return checks.question_support(questions, known, edges, contract).select("subject", "detail")


@query("""SELECT 'f' || o_orderkey AS path, problem FROM orders, unnest([CASE WHEN o_orderpriority = '5-LOW' THEN 'format' END, CASE WHEN o_orderkey % 4 = 0 THEN 'sha256 is not 64 hex digits' END, CASE WHEN o_orderkey % 5 = 0 THEN 'no such file' END,
CASE WHEN o_orderkey % 5 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 4 = 0) THEN 'sha256 differs' END, CASE WHEN o_orderstatus = 'P' THEN 'class is not declared' END, CASE WHEN o_orderkey % 11 = 0 THEN 'restricted data are refused' END]) AS t(problem) WHERE problem IS NOT NULL""")
def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as delivered files with their digests."""
    orders, digest = table(spark, sf_dir, "orders"), F.sha2(F.col("o_orderkey").cast("string"), 256)
    path = F.concat(F.lit("f"), "o_orderkey").alias("path")
    files = orders.select(
        path, F.col("o_orderpriority").alias("format"), F.when(F.col("o_orderkey") % 4 == 0, "beef").when(F.col("o_orderkey") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.upper(digest)).alias("sha256"), F.col("o_orderstatus").alias("target_class"),
        F.array(F.lit("id")).alias("entity_keys"), F.when(F.col("o_orderkey") % 11 == 0, "restricted").alias("classification"),
    )
    formats = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    classes = spark.createDataFrame([("F",), ("O",)], "class string")
    return checks.delivery_manifest(files, orders.where("o_orderkey % 5 <> 0").select(path, digest.alias("sha256")), orders.select(path, F.array(F.lit("id")).alias("columns")), classes, formats)


@query("SELECT 'individual' AS section, 'o' || l_orderkey || '-' || l_linenumber AS id, 'undeclared class ' || l_returnflag AS problem FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT 'individual', 'o' || l_orderkey || '-' || l_linenumber, 'undeclared property ' || l_linestatus FROM lineitem WHERE l_linestatus <> 'O'")
def changeset_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    id_ = F.concat(F.lit("o"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id")
    changes = lines.select(F.lit("individual").alias("section"), id_, F.lit("class").alias("kind"), F.col("l_returnflag").alias("ref")).union(lines.select(F.lit("individual"), id_, F.lit("property"), "l_linestatus"))
    return checks.reference_kinds(changes, spark.createDataFrame([("class", "N"), ("property", "O")], "kind string, ref string"))
