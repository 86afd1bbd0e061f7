"""Gates around a graph: rules that fire, closure of a change, shapes read from a graph, admission, growth, cards and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import candidates, changes, checks, predicates, reasoner, rules, shapes, simulate
from weftgraph.operators.reasoner import DOMAIN, FIRST, INVERSE, NIL, RANGE, REST, SUBPROPERTY, TRANSITIVE, TYPE
from weftgraph.operators.rules import Lit, Rule
from weftgraph.plans.graphs import part_of
from weftgraph.plans.inference import NS, facts, order_triples
from weftgraph.plans.registry import query, table
from weftgraph.sources import tables, turtle
from weftgraph.storage import shared_folder, stored

TRIPLE = "s string, p string, o string, o_kind string, o_dt string, o_lang string"


def _graph(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A small schema or shapes graph; numbers are literals."""
    return spark.createDataFrame([(s, p, o, "literal" if o.isdigit() else "bnode" if o.startswith("_:") else "iri", "", "") for s, p, o in rows], TRIPLE)


@query("""SELECT 'R-PAYER' AS name, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'R-WAITING', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'R-AGAIN', 0
UNION ALL SELECT 'hasPayer', count(*) FROM orders UNION ALL SELECT 'waiting', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'P'""")
def rule_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many triples each rule adds that weren't there, the second seeing what the first made and the third adding nothing; and what the graph holds then."""
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    base = order_triples(spark, sf_dir).unionByName(facts(finished, "concat('o:', o_orderkey)", NS + "hasPayer", "concat('c:', o_custkey)"))
    payer = [("?o", "hasPayer", "?c")], [("?c", "placed", "?o")]
    ran = [Rule("R-PAYER", *payer), Rule("R-WAITING", [("?c", "waiting", Lit("yes"))], [("?o", "hasPayer", "?c"), ("?o", "status", Lit("P"))]), Rule("R-AGAIN", *payer)]
    every, fired = rules.run(base, ran, NS)
    held = every.where(F.col("p").isin(NS + "hasPayer", NS + "waiting")).groupBy(F.element_at(F.split("p", ":"), -1).alias("name")).agg(F.count("*").alias("n"))
    return spark.createDataFrame(sorted(fired.items()), "name string, n long").unionByName(held)


def _closed_sql(name: str, customers: str, nations: str) -> str:
    """Tables of the closure of memberships, as in `_membership`."""
    return f"""direct_{name}(s, o) AS (SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer WHERE {customers} UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation WHERE {nations}),
part_{name}(s, o) AS (SELECT s, o FROM direct_{name} UNION SELECT p.s, d.o FROM part_{name} p JOIN direct_{name} d ON p.o = d.s),
closed_{name}(s, p, o) AS (SELECT s, 'directPartOf', o FROM direct_{name} UNION SELECT s, 'partOf', o FROM part_{name} UNION SELECT o, 'hasPart', s FROM part_{name} UNION SELECT s, 'type', '{NS}Member' FROM direct_{name} UNION SELECT o, 'type', '{NS}Group' FROM direct_{name})"""


CLOSED_SQL = "WITH RECURSIVE " + _closed_sql("before", "c_custkey % 5 <> 0", "n_regionkey <> 4") + ", " + _closed_sql("after", "true", "true")


def _membership(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, reasoner.Schema]:
    """(memberships, a change of them, schema): every fifth customer joins, and the nations of the last region."""
    late = F.expr("(src like 'c:%' and substr(src, 3) % 5 = 0) or dst = 'r:4'")
    edges = part_of(spark, sf_dir)
    schema = [("directPartOf", SUBPROPERTY, "partOf"), ("partOf", TYPE, TRANSITIVE), ("hasPart", INVERSE, "partOf"), ("directPartOf", DOMAIN, "Member"), ("directPartOf", RANGE, "Group")]
    known = reasoner.read_schema(_graph(spark, [(NS + s, p, o if ":" in o else NS + o) for s, p, o in schema]))
    return *(facts(edges.where(rows), "src", NS + "directPartOf", "dst") for rows in (~late, late)), known


@query(CLOSED_SQL + ", new AS (SELECT * FROM closed_after EXCEPT SELECT * FROM closed_before) SELECT s AS node FROM new UNION SELECT o FROM new")
def affected_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of what a change adds to a closed graph, whose shapes have to be checked again."""
    base, change, schema = _membership(spark, sf_dir)
    closed = stored(reasoner.closure(base, schema), "closed")
    return reasoner.affected(closed, reasoner.closure(change, schema, closed))


@query(CLOSED_SQL + """ SELECT 'closure of the base' AS name, (SELECT count(*) FROM closed_before) - (SELECT count(*) FROM direct_before) AS n
UNION ALL SELECT 'closure of the change', (SELECT count(*) FROM closed_after) - (SELECT count(*) FROM closed_before) UNION ALL SELECT 'differs from a fresh closure', 0""")
def closure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that the closure adds, those that a change adds to it, and those by which it differs from the closure of everything at once."""
    base, change, schema = _membership(spark, sf_dir)
    closed = stored(reasoner.closure(base, schema), "closed")
    grown = stored(reasoner.closure(change, schema, closed), "grown")
    fresh = stored(reasoner.closure(base.unionByName(change), schema), "fresh")
    apart = fresh.exceptAll(grown).count() + grown.exceptAll(fresh).count()
    rows = [("closure of the base", reasoner.added(base, closed)), ("closure of the change", reasoner.added(closed, grown)), ("differs from a fresh closure", apart)]
    return spark.createDataFrame(rows, "name string, n long")


@query("""WITH c AS (SELECT *, CASE WHEN c_custkey % 6 = 0 THEN 'CASE.' ELSE 'case.' END || CASE WHEN c_nationkey < 20 THEN 'fab' ELSE 'ap' END || '.' || c_custkey AS id FROM customer), twice AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE c_custkey % 10 = 0)
SELECT id AS subject, 'duplicate id' AS detail FROM c WHERE c_custkey % 10 = 0
UNION ALL SELECT id, detail FROM twice, unnest([CASE WHEN c_custkey % 6 = 0 THEN 'id does not match the pattern' END, CASE WHEN c_custkey % 6 <> 0 AND (c_nationkey < 20) <> (c_acctbal >= 0) THEN 'domain ' || CASE WHEN c_acctbal < 0 THEN 'ap' ELSE 'fab' END END,
CASE WHEN c_custkey % 4 >= 2 THEN 'source_type' END, CASE WHEN c_custkey % 12 = 0 THEN 'web source without ref' END]) AS t(detail) WHERE detail IS NOT NULL
UNION ALL SELECT id, detail FROM c, unnest([CASE WHEN c_custkey % 4 = 0 THEN 'missing field title' END, CASE WHEN c_custkey % 9 = 0 THEN 'unknown field extra' END]) AS t(detail) WHERE detail IS NOT NULL""")
def violations_case_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases, every tenth of them twice: unique ids by a pattern, their domain, fields and provenance."""
    source = F.expr("case c_custkey % 4 when 0 then 'web' when 1 then 'human' when 2 then 'rumour' end")
    rows = table(spark, sf_dir, "customer").select(
        F.expr("concat(if(c_custkey % 6 = 0, 'CASE.', 'case.'), if(c_nationkey < 20, 'fab', 'ap'), '.', c_custkey)").alias("id"), F.expr("if(c_acctbal < 0, 'ap', 'fab')").alias("domain"),
        F.struct(source.alias("source_type"), F.expr("if(c_custkey % 3 = 0, '', 'r')").alias("ref"), F.lit("high").alias("confidence"), F.lit("2024-01-01").alias("created_at")).alias("provenance"),
        F.lit(None).cast("string").alias("_file"), F.col("c_custkey").alias("_ord"),
    )
    keys = F.filter(F.array(F.lit("id"), F.expr("if(_ord % 4 <> 0, 'title', null)"), F.expr("if(_ord % 9 = 0, 'extra', null)")), lambda k: k.isNotNull())
    contract = {"kb_schema": {"id_pattern": r"^case\.[a-z]+\.[0-9]+$", "required_fields": ["id", "title"], "optional_fields": []}, "provenance_schema": {"source_type": {"allowed": ["web", "human"]}, "confidence": {"allowed": ["low", "high"]}}}
    found = checks.case_contract(rows.unionByName(rows.where("_ord % 10 = 0")), rows.select("id", F.lit(None).cast("string").alias("type"), keys.alias("keys"), "_file"), contract)
    return found.where("rule = 'R013'").select("subject", "detail")


@query("""WITH l AS (SELECT o_orderkey, count(DISTINCT l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT 'o:' || o_orderkey AS node, 'minCount' AS component, 'lines' AS message FROM l WHERE n < 3 UNION ALL SELECT 'o:' || o_orderkey, 'maxCount', 'lines' FROM l WHERE n > 6
UNION ALL SELECT 'o:' || o_orderkey, 'or', 'finish or urgency' FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'""")
def shapes_of_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of shapes that are triples themselves: counts of a path, and a list of alternatives."""
    sh, line, finished, urgent = shapes.SHACL, NS + "line", NS + "finished", NS + "urgent"
    graph = [
        *[("s:Lines", sh + "targetClass", NS + "Order"), ("s:Lines", sh + "property", "_:l"), ("_:l", sh + "path", line), ("_:l", sh + "minCount", "3"), ("_:l", sh + "maxCount", "6"), ("_:l", sh + "message", "lines")],
        *[("s:Either", sh + "targetClass", NS + "Order"), ("s:Either", sh + "or", "_:1"), ("_:1", FIRST, "_:a"), ("_:1", REST, "_:2"), ("_:2", FIRST, "_:b"), ("_:2", REST, NIL)],
        *[(f"_:{x}", sh + "property", f"_:p{x}") for x in "ab"], *[(f"_:p{x}", sh + "path", path) for x, path in (("a", finished), ("b", urgent))],
        *[(f"_:p{x}", sh + p, o) for x in "ab" for p, o in (("minCount", "1"), ("message", "finish or urgency"))],
    ]
    orders, o = table(spark, sf_dir, "orders"), "concat('o:', o_orderkey)"
    base = facts(orders, o, TYPE, f"'{NS}Order'").unionByName(facts(table(spark, sf_dir, "lineitem"), "concat('o:', l_orderkey)", line, "l_linenumber", "literal"))
    base = base.unionByName(facts(orders.where("o_orderstatus = 'F'"), o, finished, "'yes'", "literal")).unionByName(facts(orders.where("o_orderpriority = '1-URGENT'"), o, urgent, "'yes'", "literal"))
    base = stored(base, "triples")
    return shapes.violations(base, base, shapes.read_shapes(_graph(spark, graph))).select("node", "component", "message")


@query("SELECT 'o:' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1997")
def unsafe_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individuals that a rule puts into a class that rules must leave empty."""
    rule = Rule("R-UNSAFE", [("?o", "a", "ConfirmedRootCause")], [("?o", "status", Lit("P")), ("?o", "year", Lit("1997"))])
    return shapes.forbidden_individuals(rules.run(order_triples(spark, sf_dir), [rule], NS)[0], NS + "ConfirmedRootCause")


@query("""WITH b AS (SELECT p_brand AS name, count(*) AS before FROM part WHERE p_size < 40 GROUP BY ALL), a AS (SELECT p_brand AS name, count(*) AS after FROM part WHERE p_size >= 12 AND p_partkey % 3 <> 0 GROUP BY ALL)
SELECT name, before, coalesce(after, 0) AS after FROM b LEFT JOIN a USING (name) WHERE coalesce(after, 0) < before""")
def shrunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that have fewer parts after a change than before it."""
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "name")
    return checks.shrunk(parts.where("p_size < 40"), parts.where("p_size >= 12 and p_partkey % 3 <> 0"), "name")


@query("""SELECT 'o:' || o_orderkey AS id, o_orderpriority AS title, 's:' || o_custkey % 10 AS anomaly, s_name AS anomaly_name, 'p' || o_orderkey % 4 AS blocked, CASE WHEN s_suppkey % 3 = 0 THEN 'yield,cost' ELSE '' END AS affects,
CASE o_orderstatus WHEN 'F' THEN 'm1' WHEN 'O' THEN 'm2' END AS model, CASE (o_orderstatus IN ('F', 'O'))::INT + coalesce(s_suppkey % 3 = 0, false)::INT WHEN 2 THEN 'ready' WHEN 1 THEN 'partial' ELSE 'missing' END AS readiness
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 10""")
def scenario_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each order as a case of its supplier, with what it blocks and touches and whether it can be computed."""
    suppliers, id_ = table(spark, sf_dir, "supplier"), F.concat(F.lit("s:"), "s_suppkey").alias("id")
    cases = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o:"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("s:"), F.col("o_custkey") % 10).alias("anomaly_ref"), F.col("o_orderstatus").alias("domain"),
        F.struct(F.array(F.concat(F.lit("p"), F.col("o_orderkey") % 4)).alias("blocked_processes")).alias("impact"),
    )
    entities = suppliers.select(id_, F.lit(None).cast("string").alias("name_zh"), F.col("s_name").alias("name_en"))
    affects = suppliers.where("s_suppkey % 3 = 0").select(id_, F.array(F.lit("yield"), F.lit("cost")).alias("affects"))
    cards = simulate.scenario_cards(cases, entities, affects, spark.createDataFrame([("F", "m1"), ("O", "m2")], "domain string, model string"))
    return cards.withColumns({c: F.array_join(c, ",") for c in ("blocked", "affects")})


@query("SELECT o_orderstatus AS dataset, count(*) AS rows, arg_min(o_orderpriority, o_orderkey) AS equipment, NULL::VARCHAR AS phase FROM orders GROUP BY ALL")
def csv_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and first row of CSV deliveries, one of each status, without a column of phases."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("dataset"), "o_orderkey", F.col("o_orderpriority").alias("equipment"))
    path = f"{shared_folder(spark)}/weft-profiles-{uuid.uuid4().hex}"
    rows.repartition("dataset").sortWithinPartitions("dataset", "o_orderkey").write.partitionBy("dataset").option("header", True).csv(path)
    return tables.profiles(spark, path).select(F.regexp_extract("path", "dataset=([^/]+)", 1).alias("dataset"), "rows", "equipment", "phase")


@query("SELECT 'P' || p_partkey AS term FROM part WHERE p_size % 2 = 0 UNION SELECT 'q' || p_size FROM part")
def declared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and properties that Turtle texts declare, by their form alone; terms of another prefix, other kinds and comments don't count."""
    text = "concat('# w:no', p_partkey, ' a owl:Class\nw:P', p_partkey, ' a owl:', if(p_size % 2 = 0, 'Class', 'NamedIndividual'), ' .\n  w:q', p_size, '  a owl:DatatypeProperty ;\nother:X a owl:Class .')"
    return turtle.declared_terms(table(spark, sf_dir, "part").select(F.expr(text).alias("value")), "w:")


@query("""SELECT 'urn:o:' || o_orderkey AS s, p, o, o_kind, o_dt, o_lang FROM orders, unnest([{'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'o': 'urn:weft:Order', 'o_kind': 'iri', 'o_dt': '', 'o_lang': ''}, {'p': 'urn:weft:status', 'o': o_orderstatus, 'o_kind': 'literal', 'o_dt': '', 'o_lang': ''},
{'p': 'urn:weft:status', 'o': o_orderpriority, 'o_kind': 'literal', 'o_dt': '', 'o_lang': 'en'}, {'p': 'urn:weft:key', 'o': o_orderkey::VARCHAR, 'o_kind': 'literal', 'o_dt': 'http://www.w3.org/2001/XMLSchema#integer', 'o_lang': ''}, {'p': 'urn:weft:by', 'o': 'urn:c:' || o_custkey, 'o_kind': 'iri', 'o_dt': '', 'o_lang': ''}]) AS t(x), LATERAL (SELECT x.p, x.o, x.o_kind, x.o_dt, x.o_lang)""")
def turtle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turtle with prefixes, predicate and object lists, languages and numbers, read back."""
    line = "concat('@prefix w: <urn:weft:> . <urn:o:', o_orderkey, '> a w:Order ; w:status \"', o_orderstatus, '\" , \"', o_orderpriority, '\"@en ; w:key ', o_orderkey, ' ; w:by <urn:c:', o_custkey, '> .')"
    path = f"{shared_folder(spark)}/weft-turtle-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select(F.expr(line).alias("value")).write.option("maxRecordsPerFile", turtle.PIECE).text(path)
    quads, issues = turtle.read(spark, path)
    return turtle.triples(quads).unionByName(issues.select(F.lit("issue").alias("s"), F.lit("").alias("p"), F.col("problem").alias("o"), *[F.lit("").alias(c) for c in ("o_kind", "o_dt", "o_lang")]))


@query("""WITH r AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'x-' || p_partkey WHEN p_partkey % 11 = 0 THEN 'R-P' || p_partkey - 1 ELSE 'R-P' || p_partkey END AS id, CASE WHEN p_size % 13 = 0 THEN NULL WHEN p_size % 9 = 0 THEN 'select ?x' WHEN p_size % 10 = 0 THEN 'construct { } ; delete data { }' ELSE 'construct { } where { }' END AS text, p_partkey % 4 <> 0 AS has_test FROM part)
SELECT DISTINCT id, reason FROM r, unnest([CASE WHEN id NOT LIKE 'R-%' THEN 'id' END, CASE WHEN text IS NULL THEN 'missing text' END, CASE WHEN text LIKE 'select%' THEN 'not a construct' END, CASE WHEN text LIKE '%delete%' THEN 'update keyword' END, CASE WHEN NOT has_test THEN 'missing test' END]) AS t(reason) WHERE reason IS NOT NULL
UNION SELECT id, 'duplicate id' FROM r GROUP BY id HAVING count(*) > 1 UNION SELECT id, 'known id' FROM r WHERE id IN (SELECT 'R-P' || s_suppkey FROM supplier)""")
def rule_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rules of a registry may not run: ids, texts that don't construct or that update, missing tests, ids taken."""
    registry = table(spark, sf_dir, "part").select(
        F.expr("case when p_partkey % 7 = 0 then concat('x-', p_partkey) when p_partkey % 11 = 0 then concat('R-P', p_partkey - 1) else concat('R-P', p_partkey) end").alias("id"), F.lit("rule").alias("kind"), F.lit("").alias("path"),
        F.expr("case when p_size % 13 = 0 then null when p_size % 9 = 0 then 'select ?x' when p_size % 10 = 0 then 'construct { } ; delete data { }' else 'construct { } where { }' end").alias("text"), (F.col("p_partkey") % 4 != 0).alias("has_test"),
    )
    return rules.admissible(registry, table(spark, sf_dir, "supplier").select(F.concat(F.lit("R-P"), "s_suppkey").alias("id")))


@query("""WITH t AS (SELECT o_custkey AS owner, sha256(o_orderpriority || chr(10) || o_orderstatus) AS digest, o_orderstatus FROM orders), kept AS (SELECT DISTINCT owner, digest FROM t WHERE o_orderstatus = 'F')
SELECT owner, digest FROM kept UNION SELECT owner, digest FROM t""")
def upserted_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of customers by digest of title and text: one that its owner has already stays, others are added once."""
    orders = table(spark, sf_dir, "orders")
    topics = orders.select(F.col("o_custkey").alias("owner"), F.sha2(F.concat_ws("\n", "o_orderpriority", "o_orderstatus").cast("binary"), 256).alias("digest"), "o_orderstatus")
    return changes.upserted(topics.where("o_orderstatus = 'F'").drop("o_orderstatus").distinct(), topics.drop("o_orderstatus"), "owner", "digest")


@query("""WITH i AS (SELECT o_orderkey AS k, 'o:' || o_orderkey AS s, (o_orderkey % 5 <> 0)::INT + (o_orderkey % 7 = 0)::INT AS diagnoses, (o_orderkey % 3 <> 0)::INT AS steps, c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 AND o_orderkey % 5 <> 0 AS wrong FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
SELECT s, CASE WHEN diagnoses = 0 OR steps = 0 THEN 'has ' || 1 + (diagnoses > 0)::INT + steps || ' of 3' WHEN diagnoses > 1 THEN 'more than one diagnoses' WHEN wrong THEN 'a target of diagnoses is no Anomaly' END AS reason,
1 + CASE WHEN diagnoses = 1 AND steps = 1 AND NOT coalesce(wrong, false) THEN 3 ELSE 0 END AS n FROM i""")
def whole_playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as playbooks: what they diagnose, their steps and their advice stay only together; why they go, and how many triples are left."""
    orders, s = table(spark, sf_dir, "orders"), "concat('o:', o_orderkey)"
    made = facts(orders.where("o_orderkey % 5 <> 0"), s, "diagnoses", "concat('c:', o_custkey)").unionByName(facts(orders.where("o_orderkey % 7 = 0"), s, "diagnoses", "concat('s:', o_orderkey)"))
    made = made.unionByName(facts(orders.where("o_orderkey % 3 <> 0"), s, "hasStep", "concat('step:', o_orderkey)")).unionByName(facts(orders, s, "recommends", "'act'")).unionByName(facts(orders, s, "status", "o_orderstatus", "literal"))
    declared = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c:"), "c_custkey").alias("node"), F.expr("array(if(c_mktsegment = 'BUILDING', 'Other', 'Anomaly'))").alias("types"))
    kept, removed = candidates.whole_groups(made, declared, {"diagnoses": "Anomaly", "hasStep": None, "recommends": None}, "diagnoses")
    return kept.groupBy("s").agg(F.count("*").alias("n")).join(removed, "s", "left").select("s", "reason", "n")


@query("SELECT p_partkey, contains(p_name, 'widget') AS in_text, p_type IN ('SMALL', 'LARGE') OR p_brand = 'SMALL' AS in_list, 1 + (p_size % 2 = 0 AND p_size % 3 <> 0)::INT AS kept FROM part")
def probed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a field holds a value, as a text or as a list, and how many items of a list have all fields that they need."""
    fields = "struct(if(p_size % 2 = 0, p_name, null) as title, if(p_size % 3 <> 0, p_type, null) as kind)"
    parts = table(spark, sf_dir, "part").withColumns({"items": F.expr(f"array({fields}, struct(p_name as title, p_brand as kind), null)"), "values": F.array("p_type", "p_brand")})
    in_list = predicates.contains_value(F.col("values"), "SMALL", True) | predicates.contains_value(F.col("values"), "LARGE", True)
    return parts.select("p_partkey", predicates.contains_value(F.col("p_name"), "widget", False).alias("in_text"), in_list.alias("in_list"), F.size(predicates.kept_items(F.col("items"), ["title", "kind"])).alias("kept"))
