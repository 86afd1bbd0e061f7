"""Candidates, mappings, verdicts and rounds, made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import candidates
from weftgraph.plans.inference import facts
from weftgraph.operators.reasoner import TYPE
from weftgraph.plans.registry import query, table
from weftgraph.storage import dealt

_PICK = "element_at(array({}), cast({} as int))"


@query("""WITH t AS (SELECT 'p:' || p_partkey AS subject, 'urn:x:' || ['ReleaseGate', 'Tool', 'CoverageMetricX', 'Backlog'][p_size % 4 + 1] AS type FROM part UNION ALL SELECT 'p:' || p_partkey, 'urn:x#Robot' FROM part WHERE p_size % 3 = 0)
SELECT subject FROM t GROUP BY subject HAVING bool_and(type IN ('urn:x:ReleaseGate', 'urn:x:CoverageMetricX', 'urn:x:Backlog')) AND NOT bool_or(type = 'urn:x:Backlog')""")
def governance_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are of governance types alone, none of them in a domain."""
    parts = table(spark, sf_dir, "part")
    kind = _PICK.format("'ReleaseGate','Tool','CoverageMetricX','Backlog'", "p_size % 4 + 1")
    types = parts.selectExpr("concat('p:', p_partkey) as subject", f"concat('urn:x:', {kind}) as type").unionByName(parts.where("p_size % 3 = 0").selectExpr("concat('p:', p_partkey) as subject", "'urn:x#Robot' as type"))
    return candidates.governance_subjects(types, spark.createDataFrame([("urn:x:Backlog",)], "type string"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a,' || json_extract_string(props, '$.k') WHEN event_id % 3 = 1 THEN json_extract_string(props, '$.k') ELSE '' END AS items, event_id % 3 = 1 AS wrapped FROM events""")
def wrapped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that is a list, a single value or missing, always read as a list."""
    events = table(spark, sf_dir, "events").withColumn("v", F.get_json_object("props", "$.k"))
    document = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k":["a","'), "v", F.lit('"]}'))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise('{"k":null}')
    items, wrapped = candidates.as_list(document, "k")
    return events.select("event_id", F.array_join(items, ",").alias("items"), F.coalesce(wrapped, F.lit(False)).alias("wrapped"))


@query("""WITH a AS (SELECT o_orderpriority AS t, o_orderstatus AS d, CASE WHEN arg_max(o_custkey, o_orderkey) % 2 = 0 THEN ['profit', 'x1'] ELSE ['x2'] END AS outs FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
j AS (SELECT o_orderkey AS id, outs, list_filter(['profit', 'x' || o_custkey % 3], lambda o: list_contains(outs, o)) AS kept FROM orders LEFT JOIN a ON t = o_orderpriority AND d = o_orderstatus)
SELECT id, CASE WHEN outs IS NULL THEN '' ELSE array_to_string(kept, ',') END AS outputs, CASE WHEN outs IS NULL THEN 'pair' WHEN len(kept) = 0 THEN 'outputs' END AS reason FROM j""")
def business_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidate models of an approved pair of priority and status."""
    orders = table(spark, sf_dir, "orders")
    pair = [F.col("o_orderpriority").alias("template_ref"), F.col("o_orderstatus").alias("dataset_ref")]
    asked = orders.select(F.col("o_orderkey").alias("id"), *pair, F.array(F.lit("profit"), F.concat(F.lit("x"), (F.col("o_custkey") % 3).cast("string"))).alias("outputs"))
    approved = orders.where("o_orderstatus <> 'P'").select(*pair, F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("profit"), F.lit("x1"))).otherwise(F.array(F.lit("x2"))).alias("outputs"), F.col("o_orderkey").alias("ord"))
    return candidates.business_candidates(asked, approved).withColumn("outputs", F.array_join("outputs", ","))


@query("""WITH p AS (SELECT 'm' || s_nationkey % 5 AS m, list(DISTINCT s_suppkey % 7) AS ins, list(DISTINCT s_suppkey % 3) AS tgt, list(DISTINCT s_suppkey % 4) AS wat FROM supplier GROUP BY 1),
j AS (SELECT c_custkey AS id, p.m IS NULL AS unknown, (c_custkey % 4 < 3 AND c_custkey % 11 <> 0 AND list_contains(ins, c_custkey % 9) AND list_contains(tgt, c_custkey % 4))::INT AS i, (c_custkey % 5 < 3 AND list_contains(wat, c_custkey % 5))::INT AS a FROM customer LEFT JOIN p ON p.m = 'm' || c_nationkey % 6)
SELECT id, coalesce(i, 0)::INT AS interventions, coalesce(a, 0)::INT AS assertions, CASE WHEN unknown THEN 'model' WHEN coalesce(i, 0) = 0 THEN 'interventions' END AS reason FROM j""")
def simulation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidate scenarios, held against what suppliers' scenarios have."""
    step, check = "array(named_struct('variable', concat('v', {v}), 'operation', {o}, 'value', {x}, 'target_ref', concat('t', {t})))", "array(named_struct('variable', concat('v', {v}), 'type', {k}))"
    approved = table(spark, sf_dir, "supplier").selectExpr("concat('m', s_nationkey % 5) as model_ref", step.format(v="s_suppkey % 7", o="'set'", x="1.0D", t="s_suppkey % 3") + " as interventions", check.format(v="s_suppkey % 4", k="'unchanged'") + " as assertions")
    op = _PICK.format("'set','add','multiply','divide'", "c_custkey % 4 + 1")
    kind = _PICK.format("'nondecreasing','nonincreasing','unchanged','equal','less'", "c_custkey % 5 + 1")
    asked = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "concat('m', c_nationkey % 6) as model_ref", step.format(v="c_custkey % 9", o=op, x="if(c_custkey % 11 = 0, null, 2.0D)", t="c_custkey % 4") + " as interventions", check.format(v="c_custkey % 5", k=kind) + " as assertions"
    )
    found = candidates.simulation_candidates(asked, candidates.simulation_policies(approved))
    return found.select("id", F.size("interventions").alias("interventions"), F.size("assertions").alias("assertions"), "reason")


@query("""SELECT o_custkey AS agent, substr(string_agg(o_orderpriority, ' ' ORDER BY o_orderkey), 1, 1000) AS summary, least(count(*), 12)::INT AS pains,
array_to_string(list_sort(list_distinct(list('urn:' || o_orderstatus) || list('urn:' || o_orderpriority)))[1:3], ',') AS proposed_iris FROM orders GROUP BY o_custkey""")
def compacted_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a customer's orders: a short summary, few pains and the first distinct names."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("agent")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("o"))
    named = F.transform("o", lambda x: F.array(F.concat(F.lit("urn:"), x["o_orderstatus"]), F.concat(F.lit("urn:"), x["o_orderpriority"])))
    summary, pains, iris = candidates.compacted(F.array_join(F.transform("o", lambda x: x["o_orderpriority"]), " "), F.transform("o", lambda x: x["o_orderstatus"]), named, 3)
    return rows.select("agent", summary, F.size(pains).alias("pains"), F.array_join(iris, ",").alias("proposed_iris"))


def mapped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as delivered files, some of them with an edited mapping; classes of three types are declared."""
    parts = table(spark, sf_dir, "part")
    files = parts.selectExpr("concat(p_partkey, '.csv') as stored_name", "array(p_brand, p_type) as headers", "'SMALL' as target_class", "array(p_brand) as entity_keys", "p_brand as time_field")
    edits = parts.where("p_size > 25").selectExpr("concat(p_partkey, '.csv') as stored_name", "p_type as target_class", "array(p_type, p_name) as entity_keys", "if(p_size % 2 = 0, p_name, p_type) as time_field")
    return candidates.edited_mapping(files, edits, spark.createDataFrame([("SMALL",), ("LARGE",), ("PROMO",)], "iri string"))


@query("""SELECT p_partkey || '.csv' AS stored_name, CASE WHEN p_size > 25 THEN p_type ELSE 'SMALL' END AS target_class, CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS entity_keys,
CASE WHEN p_size <= 25 THEN p_brand WHEN p_size % 2 = 1 THEN p_type END AS time_field, p_size <= 25 OR p_type IN ('SMALL', 'LARGE', 'PROMO') AS target_class_valid FROM part""")
def edited_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_files(spark, sf_dir).select("stored_name", "target_class", F.array_join("entity_keys", ",").alias("entity_keys"), "time_field", "target_class_valid")


@query("""SELECT 'raw/j1__' || p_partkey || '.csv' AS path, p_partkey || '.csv' AS stored_name, CASE WHEN p_partkey % 4 = 0 THEN 'taken' ELSE 'new' END AS state FROM part WHERE p_size <= 25 OR p_type IN ('SMALL', 'LARGE', 'PROMO')""")
def adopted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a job may add, and those whose path is taken."""
    live = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").selectExpr("concat('raw/j1__', p_partkey, '.csv') as path")
    return candidates.adopted("j1", mapped_files(spark, sf_dir), live)


@query("""WITH v AS (SELECT o_custkey % 50 || '|' || o_orderstatus || '|' || o_orderpriority AS key, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'accept' ELSE 'reject' END, o_orderkey) AS verdict FROM orders GROUP BY 1)
SELECT p_partkey AS id, key, coalesce(v.verdict, 'gated') AS verdict FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size % 60 || '|O|5-LOW' WHEN p_size % 3 = 0 THEN 'p' || p_partkey ELSE p_name END AS key FROM part) LEFT JOIN v USING (key)""")
def attached_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a change with the verdict that their key has; relations are found by their ends and type."""
    item = "named_struct('from', cast(p_size % 60 as string), 'type', 'O', 'to', '5-LOW', 'id', if(p_size % 3 = 0, concat('p', p_partkey), ''), 'title', p_name)"
    items = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "if(p_size % 2 = 0, 'relations', 'entities') as section", f"{item} as item")
    items = items.select("id", candidates.item_key(F.col("section"), F.col("item")).alias("key"))
    verdicts = table(spark, sf_dir, "orders").selectExpr("concat_ws('|', o_custkey % 50, o_orderstatus, o_orderpriority) as key", "if(o_orderkey % 3 = 0, 'accept', 'reject') as verdict", "o_orderkey as ord")
    return candidates.with_verdicts(items, verdicts).select("id", "key", "verdict")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'not a URL' END WHEN 1 THEN CASE WHEN page_id % 8 = 1 THEN 'not delivered' WHEN page_id % 5 <> 0 THEN 'no such file' END
WHEN 2 THEN CASE WHEN page_id % 3 = 0 THEN 'outside the project' WHEN page_id % 5 <> 0 THEN 'no such file' END END AS error FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)""")
def provenance_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the sources that pages name."""
    source = F.expr(_PICK.format("'web','vfab','internal_feature','human'", "page_id % 4 + 1"))
    ref = F.when(source == "web", F.coalesce("url", F.lit(""))).when((source == "internal_feature") & (F.col("page_id") % 3 == 0), "a/../b.csv#1").otherwise("a/b.csv#1")
    return table(spark, sf_dir, "pages").select("page_id", candidates.provenance_error(source, ref, F.col("page_id") % 8 != 1, F.col("page_id") % 5 == 0).alias("error"))


@query("SELECT p_partkey, p_size <= 100 AND (p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) + (100 - p_size) = 100 AS valid FROM part")
def focus_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two shares make up a hundred."""
    first = F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", candidates.focus_valid(first, 100 - F.col("p_size")).alias("valid"))


@query("""SELECT (SELECT count(*) FROM part) AS business_models, (SELECT sum(len(string_split(p_name, ' ')))::BIGINT FROM part) AS business_relations, (SELECT count(*) FROM supplier) AS simulation_scenarios,
(SELECT count(*) FROM documents WHERE coalesce(source, '') <> '' AND coalesce(text, '') <> '') AS knowledge_entries""")
def artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("outputs"))
    return candidates.artifact_counts(models, table(spark, sf_dir, "supplier"), table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("text").alias("content")))


_STATUS = {"F": "completed", "O": "running", "P": "completed_partial"}


@query("""SELECT c_custkey AS run_id, coalesce(max(o_orderkey), 0) AS current_round, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS rounds_completed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def run_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs and orders as their rounds."""
    status = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])[F.col("o_orderstatus")]
    rounds = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("round_number"), status.alias("status"))
    return candidates.run_rounds(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id")), rounds)


@query("SELECT l_suppkey AS round, sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber END)::BIGINT AS evidence_pages FROM lineitem GROUP BY l_suppkey")
def evidence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("round"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("evidence_count"))
    return candidates.evidence_total(outputs, "round")


@query("""SELECT p_partkey AS round, array_to_string(string_split(p_name, ' ')[1:3], ',') AS focus_themes, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'source_alignment' END, CASE WHEN p_size % 3 <> 0 THEN 'full_publish_gate' END) AS unpassed_gates,
concat_ws(',', CASE WHEN p_size > 10 THEN 'a' END, CASE WHEN p_size > 40 THEN 'c' END) AS grew FROM part""")
def next_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes, open gates and growth that parts, as rounds, leave to the next one."""
    size = F.col("p_size")
    rounds = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("round"), F.split("p_name", " ").alias("themes"),
        F.create_map(F.lit("source_alignment"), size % 2 != 0, F.lit("other"), F.lit(False), F.lit("full_publish_gate"), size % 3 == 0).alias("checks"),
        F.create_map(F.lit("a"), size - 10, F.lit("b"), F.lit(0), F.lit("c"), size - 40).alias("delta"),
    )
    found = candidates.next_direction(rounds)
    return found.select("round", F.array_join("focus_themes", ",").alias("focus_themes"), F.array_join("unpassed_gates", ",").alias("unpassed_gates"), F.array_join(F.array_sort(F.map_keys("grew")), ",").alias("grew"))


@query("""WITH n AS (SELECT (SELECT count(*) FROM part) AS k, (SELECT count(*) FROM supplier) AS r), q AS (SELECT *, CASE WHEN k + r <= 40 THEN k ELSE greatest(1, round_even(40.0 * k / (k + r), 0))::BIGINT END AS kq FROM n),
rows AS (SELECT 'knowledge' AS kind, 'p:' || p_partkey AS id, k AS n, kq AS quota FROM part, q UNION ALL SELECT 'rule', 's:' || s_suppkey, r, CASE WHEN k + r <= 40 THEN r ELSE greatest(0, 40 - kq) END FROM supplier, q),
placed AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS place FROM rows)
SELECT kind, id FROM placed WHERE quota >= n OR quota = 1 AND place = n // 2 OR quota > 1 AND list_contains(list_transform(range(quota), lambda i: round_even(i * (n - 1)::DOUBLE / (quota - 1), 0)::BIGINT), place)""")
def listed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty ids of parts and suppliers, spread evenly and shared in proportion."""
    return candidates.listed_ids(table(spark, sf_dir, "part").selectExpr("concat('p:', p_partkey) as id"), table(spark, sf_dir, "supplier").selectExpr("concat('s:', s_suppkey) as id"), 40)


@query("""WITH e AS (SELECT c_custkey AS error_id, CASE WHEN c_custkey % 11 = 5 THEN 3 ELSE c_custkey % 3 END AS kind, 'Node' || c_custkey % 20 AS node FROM customer), o AS (SELECT s_suppkey AS agent, s_suppkey % 2 AS kind, 'Node' || s_suppkey % 7 || ' Node1' || s_suppkey % 4 || ' end' AS text FROM supplier),
able AS (SELECT e.*, agent, e.kind = 1 OR length(node) < 6 OR contains(text, node) AS hit FROM e JOIN o USING (kind) WHERE e.kind < 2)
SELECT error_id, agent FROM e, (SELECT DISTINCT agent FROM o) WHERE kind = 2 UNION ALL SELECT error_id, agent FROM able WHERE hit
UNION ALL SELECT error_id, agent FROM (SELECT *, row_number() OVER (PARTITION BY error_id ORDER BY agent) AS n FROM able WHERE error_id NOT IN (SELECT error_id FROM able WHERE hit)) WHERE n <= 3
UNION ALL SELECT error_id, agent FROM e, (SELECT DISTINCT agent FROM o ORDER BY agent LIMIT 3) WHERE kind = 3""")
def repair_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, as agents, whose output an error is about: by the node it names, by its kind alone, or all."""
    error = F.when(F.col("c_custkey") % 11 == 5, "the rule names no file").when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("SHACL failed. Focus Node: <Node"), (F.col("c_custkey") % 20).cast("string"), F.lit("> broken"))).when(F.col("c_custkey") % 3 == 1, "business model failed").otherwise("unclear")
    errors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("error_id"), error.alias("error"))
    outputs = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as agent", "s_suppkey as ord", "if(s_suppkey % 2 = 0, 'semantic_files', 'business_files') as kind", "concat('Node', s_suppkey % 7, ' Node1', s_suppkey % 4, ' end') as text")
    return candidates.repair_targets(errors, outputs)


@query("""SELECT 'o:' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'o:' || o_orderkey END AS name_zh, CASE WHEN o_orderkey % 5 = 0 THEN 'erp' ELSE 'fab' END AS domain, 'c:' || o_custkey AS anomaly_ref,
(SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS causes, 'medium' AS confidence FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 <> 0""")
def appended_playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as playbooks of a graph that the index lacks."""
    ns, label = "urn:weft:", "http://www.w3.org/2000/01/rdf-schema#label"
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    # no semi join, which would be moved before the dealing; repeated causes count once
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", each=500_000).join(orders.select(F.col("o_orderkey").alias("l_orderkey")).hint("merge"), "l_orderkey")
    o = "concat('o:', o_orderkey)"
    triples = facts(orders, o, TYPE, f"'{ns}DiagnosticPlaybook'").unionByName(facts(orders.where("o_orderkey % 2 = 0"), o, label, "o_orderpriority", "literal")).unionByName(facts(orders.where("o_orderkey % 5 = 0"), o, ns + "domainCode", "'erp'", "literal"))
    triples = triples.unionByName(facts(orders, o, ns + "diagnosesAnomaly", "concat('c:', o_custkey)")).unionByName(facts(lines, "concat('o:', l_orderkey)", ns + "hasPossibleCause", "concat('p:', l_partkey)"))
    found = candidates.appended_playbooks(orders.where("o_orderkey % 3 = 0").selectExpr(f"{o} as id"), triples, ns, label)
    return found.select("id", "name_zh", "domain", "anomaly_ref", F.size("cause_refs").cast("long").alias("causes"), "confidence")
