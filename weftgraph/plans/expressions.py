"""Text, unit and predicate expressions, simulation documents and samples over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import aggregates, changes, checks, graph, joins, predicates, questions, reasoner, simulate, windows
from weftgraph.operators.graph import Step
from weftgraph.operators.reasoner import SUBCLASS, TYPE
from weftgraph.plans.graphs import part_of
from weftgraph.plans.inference import facts
from weftgraph.plans.registry import query, table
from weftgraph.storage import shared_folder


@query("""SELECT p_partkey, p_type || ' ' || p_name AS collapsed, sha256(p_name || chr(10) || p_type) AS fingerprint, 'Dear ' || p_name || ', $other ' || p_size AS filled, p_partkey % 4 = 0 AS external, (26 * (p_partkey % 3 + 1) + p_size % 26)::INTEGER AS column_no,
CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS unit FROM part""")
def text_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed white space, digests of lists, filled templates, external ids, spreadsheet columns and unit rules."""
    parts = table(spark, sf_dir, "part")
    noisy = F.concat(F.lit(" \t"), "p_type", F.lit("<BR/>\n  "), "p_name", F.lit("  "))
    letters = F.concat(F.expr("char(65 + p_partkey % 3)"), F.expr("char(65 + p_size % 26)"))
    kind = F.col("p_size") % 4
    declared = F.when(kind == 1, "unit/month").when(kind == 2, "CNY/unit").otherwise("unit")
    actual = F.when(kind == 1, "wafer/month").when(kind == 2, "CNY/wafer").when(kind == 3, "ratio").otherwise("unit")
    return parts.select(
        "p_partkey", T.collapsed(noisy).alias("collapsed"), T.fingerprint(F.array("p_name", "p_type")).alias("fingerprint"), T.filled("Dear $name, $other ${size}", {"name": F.col("p_name"), "size": F.col("p_size")}).alias("filled"),
        T.is_external(F.concat(F.when(F.col("p_partkey") % 4 == 0, "ext.").otherwise("int."), "p_name")).alias("external"), T.column_index(letters).alias("column_no"), T.compatible_unit(declared, actual).alias("unit"),
    )


@query("""SELECT p_partkey, p_name AS body, 3::INTEGER AS sections, array_to_string(list_concat([p_brand, p_type], list_filter([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]], lambda w: length(w) > 1 AND lower(w) <> lower(p_type) AND lower(w) <> lower(p_brand))), ',') AS keywords FROM part
WHERE lower(string_split(p_name, ' ')[1]) <> lower(string_split(p_name, ' ')[2])""")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body below a heading, the number of sections, and key words of names and English names."""
    text = F.concat(F.lit("intro\n## One\nx\n## Two  \n\n"), "p_name", F.lit("\n\n## Three\ny ## z"))
    words = F.split("p_name", " ")
    parts = table(spark, sf_dir, "part").where(F.lower(words[0]) != F.lower(words[1]))
    names = F.array("p_brand", "p_type")
    return parts.select("p_partkey", T.headings(text, "Two").alias("body"), (F.size(T.sections(text)) - 1).cast("int").alias("sections"), F.array_join(T.keywords(names, F.array("p_name", F.lit("x"))), ",").alias("keywords"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS noise, (contains(p_name, 'ring')::INT + contains(p_name, 'bolt')::INT)::INTEGER AS hits,
CASE WHEN contains(lower(p_name), 'ring') THEN 'hard' WHEN contains(lower(p_name), 'blue') THEN 'isolate' ELSE 'system' END AS gate, p_size % 4 = 3 OR p_size % 4 = 2 AND p_size % 3 <> 0 AS baseline, greatest(0, 1 - (p_size % 13) / 10.0)::DOUBLE AS tone, CASE WHEN p_size % 3 = 0 AND p_size % 5 > 0 THEN 1 ELSE 1 - (p_size % 3) / 8.0 END::DOUBLE AS factual, concat_ws(',', CASE WHEN p_size % 2 = 1 THEN 'missing total' END) AS report FROM part""")
def row_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise codes, marker hits, error classes, failures of the baseline, tone and report checks."""
    parts = table(spark, sf_dir, "part")
    kind = F.col("p_size") % 5
    code = F.when(kind == 0, " ").when(kind == 1, "Total").when(kind == 2, "123-4").when(kind == 3, "abc_tmp").otherwise("abc")
    node = F.concat(F.lit("urn:Node-"), F.col("p_partkey").cast("string"))
    marked = F.col("p_size") % 4
    error = F.when(marked == 0, F.concat(F.lit("in Focus Node: "), node)).when(marked == 1, "Constraint Violation in x").when(marked == 2, F.concat(F.lit("CONSTRAINT violation. focus NODE:  <"), node, F.lit("> broken"))).otherwise("Constraint Violation; the focus node is not given")
    candidate = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("about "), F.upper(node))).otherwise("no node here; Constraint")
    turns = F.repeat(F.lit("首先，其次。"), (F.col("p_size") % 13).cast("int"))
    turns = F.substring(F.concat(F.lit("x"), F.regexp_replace(turns, "，其次", "")), 1, 100)
    errors = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), F.col("p_size") % 3)
    body = F.concat(F.lit("total: "), F.when(F.col("p_size") % 2 == 0, F.format_number(F.col("p_size") * 1000, 0)).otherwise("none"))
    return parts.select(
        "p_partkey", predicates.noise_feature(code, ["total"], r"_tmp$").alias("noise"), predicates.marker_hits(F.col("p_name"), ["ring", "bolt"]).alias("hits"), predicates.gate_error(F.col("p_name"), [("hard", ["ring"]), ("isolate", ["blue"])]).alias("gate"),
        predicates.baseline_failure(error, candidate).alias("baseline"), predicates.tone(turns).alias("tone"), predicates.factual(errors, F.col("p_size") % 5).alias("factual"), F.array_join(predicates.report_errors(body, {"total": F.col("p_size") * 1000}), ",").alias("report"),
    )


@query("""WITH d AS (SELECT o_custkey, sum((o_orderstatus = 'F')::INT) AS fa, sum((o_orderstatus = 'O')::INT) AS ob FROM orders GROUP BY 1) SELECT o_custkey, -fa::BIGINT AS only_before, ob::BIGINT AS only_after FROM d""")
def map_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters before and after, missing ones as 0."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("o"))
    delta = aggregates.map_delta(F.create_map(F.lit("f"), "f"), F.create_map(F.lit("o"), "o"))
    return counts.select("o_custkey", delta["f"].cast("long").alias("only_before"), delta["o"].cast("long").alias("only_after"))


@query("""SELECT p_partkey::VARCHAR AS entity_id, p_type AS affects, (SELECT string_agg('s:' || lpad(s_suppkey::VARCHAR, 6, '0'), ',' ORDER BY s_suppkey) FROM supplier) AS models FROM part WHERE p_size > 30""")
def hook_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with hooks, each with all models."""
    hooks = F.struct(F.when(F.col("p_size") > 30, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("affects"))
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), hooks.alias("economic_hooks"))
    models = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("id"))
    return aggregates.proposals(entities, models, ",").select("entity_id", F.array_join("affects", ",").alias("affects"), "models")


@query("""SELECT (SELECT count(*) FROM region) AS classes, 2::BIGINT AS object_properties, 1::BIGINT AS datatype_properties, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier WHERE s_suppkey <> s_nationkey) AS relations,
(SELECT count(*) FROM region) AS axioms, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + 2 * (SELECT count(*) FROM region) + 3 AS triples, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS individuals""")
def headline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, properties, relations, axioms and individuals of a small ontology made of the tables."""
    nation, region, supplier = (table(spark, sf_dir, n) for n in ("nation", "region", "supplier"))
    r = "concat('r:', r_regionkey)"
    triples = facts(region, r, TYPE, "'Class'").unionByName(facts(region, r, SUBCLASS, "'Top'")).unionByName(facts(nation, "concat('n:', n_nationkey)", "in", "concat('r:', n_regionkey)")).unionByName(facts(supplier, "concat('x:', s_suppkey)", "of", "concat('x:', s_nationkey)"))
    declared = spark.createDataFrame([("in", "ObjectProperty"), ("of", "ObjectProperty"), ("name", "DatatypeProperty")], "s string, o string")
    triples = triples.unionByName(facts(declared, "s", TYPE, "o"))
    subjects = supplier.select(F.col("s_nationkey").alias("subject"))
    return aggregates.headline(triples, subjects, TYPE, ["Class"], ["ObjectProperty"], ["DatatypeProperty"], [SUBCLASS])


@query("""WITH b AS (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS kinds FROM b), q1 AS (SELECT kind, n, 1 + floor((100 - kinds) * (n - 1) / (total - kinds))::BIGINT AS q FROM b, t),
q2 AS (SELECT *, row_number() OVER (ORDER BY n DESC, kind) AS place, 100 - sum(q) OVER () AS spare FROM q1), quota AS (SELECT kind, n, q + CASE WHEN place = 1 THEN spare ELSE 0 END AS q FROM q2),
placed AS (SELECT event_id, event_type, n, q, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place FROM events JOIN quota ON kind = event_type)
SELECT event_id, event_type FROM placed WHERE list_contains(list_transform(range(q::BIGINT), lambda i: round_even(i * (n - 1)::DOUBLE / (q - 1), 0)::BIGINT), place)""")
def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred events, shared between their kinds in proportion and evenly spaced; a sampling operator."""
    return windows.balanced_sample(table(spark, sf_dir, "events"), "event_type", ["event_id"], 100).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 25")
def after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events after a cursor; a page."""
    return windows.after(table(spark, sf_dir, "events"), "event_id", 500, 25).select("event_id")


@query("""SELECT unnest(['a', 'b', 'c', 'd']) AS id, unnest(['parent', 'own', 'parent', 'own']) AS origin, unnest([1, 2, 3, 4])::BIGINT AS place, (SELECT count(*) FROM nation) AS n""")
def resolved_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template's calculations with those it extends: a known id keeps its place, and its content unless the later one overrides."""
    templates = {"parent": {"calculations": [{"id": "a", "origin": "parent"}, {"id": "b", "origin": "parent"}, {"id": "c", "origin": "parent"}]}, "own": {"extends": ["parent"], "calculations": [{"id": "b", "origin": "own", "override": True}, {"id": "c", "origin": "own"}, {"id": "d", "origin": "own"}]}}
    rows = simulate.resolved("own", templates)["calculations"]
    n = table(spark, sf_dir, "nation").count()
    return spark.createDataFrame([(r["id"], r["origin"], k, n) for k, r in enumerate(rows, 1)], "id string, origin string, place long, n long")


MODELS = """WITH v AS (SELECT 'm' || n_nationkey AS model, unnest(['price', 'units', 'rate', 'spare']) AS id, unnest(['CNY', 'unit', 'ratio', 'unit']) AS unit FROM nation),
d AS (SELECT 'm' || n_nationkey AS model, unnest(['price', 'units', 'rate']) AS id, unnest([10.0, -1.0 * (n_nationkey % 2), n_nationkey / 10.0]) AS value, unnest([NULL, NULL, 'ratio']) AS unit FROM nation),
o AS (SELECT 'm' || n_nationkey AS model, 'price' AS id, 12.0 AS value, 'CNY' AS unit FROM nation WHERE n_nationkey % 3 = 0)"""


@query(MODELS + """ SELECT model, id, coalesce(o.value, d.value)::DOUBLE AS value, coalesce(o.unit, d.unit, v.unit) AS unit FROM d LEFT JOIN o USING (model, id) LEFT JOIN v USING (model, id)""")
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of models: their own before the dataset's, units of the template where none is given."""
    return _inputs(spark, sf_dir)[1].select("model", "id", "value", "unit")


@query(MODELS + """ SELECT model, 'spare' AS id, 'missing' AS problem FROM v WHERE id = 'spare' UNION ALL SELECT model, id, CASE WHEN id = 'units' THEN 'negative' ELSE 'ratio out of range' END FROM d WHERE id = 'units' AND value < 0 OR id = 'rate' AND value > 1
UNION ALL SELECT 'm' || n_nationkey, 'rate', 'source without reference' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'm' || n_nationkey, 'units', 'unknown reference' FROM nation WHERE n_nationkey % 7 = 1""")
def input_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the values of models: missing ones, ranges, sources without and unknown references."""
    variables, inputs = _inputs(spark, sf_dir)
    known = spark.createDataFrame([("known",)], "ontology_ref string")
    return simulate.missing_inputs(variables, inputs, []).withColumn("problem", F.lit("missing")).unionByName(simulate.input_problems(inputs, known))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation").selectExpr("concat('m', n_nationkey) as model", "n_nationkey as k")
    variables = nation.select("model", F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(u).alias("unit")) for i, u in (("price", "CNY"), ("units", "unit"), ("rate", "ratio"), ("spare", "unit"))])).alias("v")).select("model", "v.*", F.lit(True).alias("required"))
    k = F.col("k")
    none = F.lit(None).cast("string")
    rate_source = F.when(k % 5 == 0, "web").otherwise("assumption")
    values = [("price", F.lit(10.0), none, F.lit("assumption"), none), ("units", -1.0 * (k % 2), none, F.lit("assumption"), F.when(k % 7 == 1, "lost").otherwise("known")), ("rate", k / 10.0, F.lit("ratio"), rate_source, none)]
    each = [F.struct(F.lit(i).alias("id"), v.cast("double").alias("value"), u.alias("unit"), s.alias("source"), none.alias("source_ref"), r.alias("ontology_ref")) for i, v, u, s, r in values]
    dataset = nation.select("model", F.explode(F.array(*each)).alias("v")).select("model", "v.*")
    own = nation.where(k % 3 == 0).select("model", F.lit("price").alias("id"), F.lit(12.0).alias("value"), F.lit("CNY").alias("unit"), F.lit("human").alias("source"), none.alias("source_ref"), none.alias("ontology_ref"))
    return variables, simulate.model_inputs(variables, dataset, own)


@query("""SELECT 'q:' || c_custkey AS qid, CASE WHEN c_custkey % 4 = 0 THEN 'instance_level' WHEN c_custkey % 4 = 1 THEN 'answerable' WHEN c_custkey % 4 = 2 THEN 'out_of_scope' ELSE 'unlisted' END AS verdict, CASE c_custkey % 4 WHEN 0 THEN 'i1' WHEN 1 THEN 'i1' WHEN 2 THEN 'i2' END AS item FROM customer""")
def question_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about instances, answerable ones, those out of scope, and those that no item lists."""
    kind = F.col("c_custkey") % 4
    text = F.when(kind == 0, "How is yield loss defined on lot A123?").when(kind == 1, "How is yield loss defined?").when(kind == 2, "Give me the weather report").otherwise("Who are you")
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("q:"), F.col("c_custkey").cast("string")).alias("qid"), text.alias("question"))
    none = "cast(array() as array<string>)"
    items = spark.createDataFrame([("i1", "in_scope", ["yield loss"]), ("i2", "out_of_scope", ["weather"])], "id string, bucket string, match_terms array<string>").selectExpr("*", f"{none} as entity_types", f"{none} as relations")
    names = spark.createDataFrame([], "type string, name string, id string")
    return questions.verdicts(asked, items, names).select("qid", "verdict", "item")


@query("""WITH q AS (SELECT c_mktsegment AS file, c_custkey % 3 = 0 AS answerable, c_custkey % 5 = 0 AS asked FROM customer) SELECT file, count(*) AS total, count(*) FILTER (WHERE answerable <> asked) AS failed FROM q GROUP BY file""")
def routing_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose verdict differs from what is expected of them, by file."""
    customers = table(spark, sf_dir, "customer")
    expected = customers.select(F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("qid"), F.when(F.col("c_custkey") % 3 == 0, "answerable").otherwise("refuse").alias("expect"))
    found = customers.select(F.col("c_custkey").alias("qid"), F.when(F.col("c_custkey") % 5 == 0, "answerable").otherwise("unlisted").alias("verdict"))
    return questions.regression(expected, found)


@query("""SELECT 'r:' || r_regionkey AS start, count(s_suppkey)::BIGINT AS n, coalesce((SELECT string_agg(x, ',') FROM (SELECT 's:' || s_suppkey AS x FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey ORDER BY x LIMIT 5)), '') AS sample
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_regionkey""")
def edge_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers two steps down from each region reach, with the first five."""
    edges = part_of(spark, sf_dir).withColumn("rel_type", F.lit("part_of"))
    types = edges.select(F.col("src").alias("id")).distinct().withColumn("type", F.when(F.col("id").startswith("s:"), "Supplier").otherwise("Other"))
    starts = table(spark, sf_dir, "region").selectExpr("concat('r:', r_regionkey) as id")
    found = questions.probe_edges(edges, starts, [Step("part_of", "in"), Step("part_of", "in", "Supplier")], types)
    return found.select("start", F.col("n").cast("long").alias("n"), F.array_join("sample", ",").alias("sample"))


@query("""SELECT unnest(['p' || (SELECT min(p_partkey) FROM part), 'x', 'y']) AS item, unnest(['accepted', 'rejected', 'accepted']) AS state""")
def bisected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that pass together are taken whole; a bad one is found by halving."""
    first = table(spark, sf_dir, "part").agg(F.min("p_partkey")).first()[0]
    good, bad, _ = changes.bisected([f"p{first}", "x", "y"], lambda items: "x" not in items)
    return spark.createDataFrame([(i, "accepted") for i in good] + [(i, "rejected") for i in bad], "item string, state string")


@query("""SELECT c_custkey AS item, coalesce('accept', '') AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'a' WHEN c_custkey % 3 = 1 THEN 'default' ELSE c_mktsegment END AS filled FROM customer""")
def filled_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns filled where they are null."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.lit(None).cast("string").alias("kind"), F.when(F.col("c_custkey") % 3 == 0, "a").when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment")).alias("filled"))
    return changes.defaults(rows, {"kind": F.lit("accept"), "filled": F.lit("default")})


@query("""SELECT 'o:' || o_orderkey AS s, CASE WHEN o_orderstatus = 'P' THEN 'provenance' ELSE 'instance' END AS part, 2::BIGINT AS triples FROM orders""")
def provenance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of subjects of a provenance type apart from the others."""
    orders = table(spark, sf_dir, "orders")
    o = "concat('o:', o_orderkey)"
    triples = facts(orders, o, TYPE, "if(o_orderstatus = 'P', 'Evidence', 'Order')").unionByName(facts(orders, o, "by", "concat('c:', o_custkey)"))
    a, b = changes.split_provenance(triples, ["Evidence"], TYPE)
    return a.withColumn("part", F.lit("instance")).unionByName(b.withColumn("part", F.lit("provenance"))).groupBy("s", "part").agg(F.count("*").alias("triples"))


@query("""SELECT 'n:' || n_nationkey AS node FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT 'r:' || n_regionkey FROM nation WHERE n_nationkey % 5 = 0""")
def affected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that a change touches: ends of the triples that are new."""
    nation = table(spark, sf_dir, "nation")
    every = facts(nation, "concat('n:', n_nationkey)", "in", "concat('r:', n_regionkey)")
    before = facts(nation.where("n_nationkey % 5 <> 0"), "concat('n:', n_nationkey)", "in", "concat('r:', n_regionkey)")
    return reasoner.affected(before, every)


@query("""SELECT 'l:' || s_suppkey AS id, 'undeclared' || ' relation r' || s_suppkey % 3 AS problem FROM supplier WHERE s_suppkey % 3 = 2 AND s_suppkey % 2 = 0 UNION ALL SELECT 'l:' || s_suppkey, 'unknown part l:x' FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT 'all', 'domains: ' || count(DISTINCT s_suppkey % 2) FROM supplier""")
def capability_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competency questions that rest on undeclared relations or unknown parts, and too few domains."""
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "concat('l:', s_suppkey) as id", "if(s_suppkey % 2 = 0, 1, 2) as level", "cast(s_suppkey % 2 as string) as domain", "array('c') as classes", "if(s_suppkey % 2 = 0, array(concat('r', s_suppkey % 3)), array('r0')) as relations", "if(s_suppkey % 2 = 1, array('l:0', 'l:x'), cast(array() as array<string>)) as composes"
    )
    terms = spark.createDataFrame([("class", "c"), ("relation", "r0"), ("relation", "r1")], "kind string, ref string")
    return checks.capability_levels(rows, terms)


@query("""SELECT p_partkey::VARCHAR AS id, 'p:' || p_partkey || ':' || k AS src, 'may_cause' AS rel_type, 'a:' || p_size AS dst FROM part, (VALUES (0), (1)) t(k) WHERE (p_partkey + k) % 3 <> 0 UNION ALL SELECT p_partkey::VARCHAR, 'a:' || p_size, 'mitigated_by', 'fix' FROM part""")
def missing_case_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes and actions of cases that the graph has no edge for."""
    cases = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) as id", "concat('a:', p_size) as anomaly_ref", "array(named_struct('cause_ref', concat('p:', p_partkey, ':0')), named_struct('cause_ref', concat('p:', p_partkey, ':1'))) as possible_causes", "array(named_struct('action_ref', 'fix')) as actions")
    pairs = cases.select(F.col("anomaly_ref").alias("dst"), F.posexplode("possible_causes").alias("k", "c"), "id").where((F.col("id").cast("long") + F.col("k")) % 3 == 0)
    return checks.case_edges(cases, pairs.select(F.col("c.cause_ref").alias("src"), F.lit("may_cause").alias("rel_type"), "dst"))


@query("""SELECT o_custkey AS gate, o_orderkey::VARCHAR AS ref FROM orders WHERE o_orderkey % 2 = 0""")
def all_edge_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of explicit edges beside derived ones: explicit ones are not derived."""
    explicit = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("cast(o_orderkey as string) as src", "'by' as rel_type", "cast(o_custkey as string) as dst")
    derived = explicit.limit(0).withColumn("derived", F.lit(True)).withColumn("field", F.lit("x"))
    return graph.all_edges(explicit, derived).where("not derived").select(F.col("dst").cast("long").alias("gate"), F.col("src").alias("ref"))


@query("""SELECT l_orderkey, l_linenumber, min(CASE WHEN l_returnflag = 'N' THEN 'low' WHEN l_returnflag = 'R' THEN 'medium' ELSE 'high' END) AS level, min(CASE WHEN l_returnflag = 'N' THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INTEGER AS rank FROM lineitem GROUP BY ALL""")
def likelihood_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of likelihoods."""
    level = F.when(F.col("l_returnflag") == "N", "low").when(F.col("l_returnflag") == "R", "medium").otherwise("high")
    return table(spark, sf_dir, "lineitem").withColumn("level", level).groupBy("l_orderkey", "l_linenumber").agg(F.min("level").alias("level"), F.min(joins.rank_of("level")).alias("rank"))


@query("""WITH RECURSIVE line AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, props || chr(10) AS l FROM events),
walk AS (SELECT user_id, i, 0 AS chunk_no, length(l) AS used, l FROM line WHERE i = 1
  UNION ALL SELECT n.user_id, n.i, CASE WHEN used + length(n.l) > 64 THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN used + length(n.l) > 64 THEN length(n.l) ELSE used + length(n.l) END, n.l FROM walk w JOIN line n ON n.user_id = w.user_id AND n.i = w.i + 1)
SELECT user_id, chunk_no::INTEGER AS chunk_no, string_agg(l, '' ORDER BY i) AS chunk FROM walk GROUP BY user_id, chunk_no""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines in chunks of at most 64 bytes, with their text."""
    T.register(spark)
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("e"))
    rows.select("user_id", F.concat(F.array_join(F.transform("e", lambda x: x["props"]), "\n"), F.lit("\n")).alias("text")).createOrReplaceTempView("weft_lines")
    return spark.sql("SELECT user_id, c.chunk_no, c.chunk FROM weft_lines, LATERAL byte_chunks(text, 64) AS c")


@query("""SELECT url, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY url""")
def unwrapped_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results, every other one behind a redirect; each address once, at its first place."""
    pages = table(spark, sf_dir, "pages").where("url is not null")
    behind = F.concat(F.lit("https://search.example/l/?kh=1&uddg="), F.url_encode("url"), F.lit("&rut=x"))
    rows = pages.select("page_id", T.unwrapped_url(F.when(F.col("page_id") % 2 == 0, behind).otherwise(F.col("url"))).alias("url"))
    return windows.first_per_key(rows, ["url"], ["page_id"])


@query("""WITH m AS (SELECT o_orderpriority AS model FROM orders GROUP BY 1) SELECT model AS item, 'price: negative' AS issue FROM m WHERE model LIKE '5%' UNION ALL SELECT 'a:' || model, 'no such model: ' || model FROM m WHERE model LIKE '5%'
UNION ALL SELECT 'b:' || model, 'no such model: x' FROM m UNION ALL SELECT 'c:' || model, 'units is negative' FROM m WHERE model NOT LIKE '5%' UNION ALL SELECT 'c:' || model, 'revenue fell' FROM m WHERE model NOT LIKE '5%' UNION ALL SELECT 'c:' || model, 'no such model: ' || model FROM m WHERE model LIKE '5%'""")
def project_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with the models of priorities and their scenarios, written as JSON and read again."""
    models = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model")).distinct()
    price = F.when(F.col("model").startswith("5"), -1.0).otherwise(10.0)
    values = F.array(F.struct(F.lit("units").alias("id"), F.lit(5.0).alias("value"), F.lit("unit").alias("unit")), F.struct(F.lit("price").alias("id"), price.alias("value"), F.lit("CNY").alias("unit")))
    inputs = models.select("model", F.explode(values).alias("v"), F.lit("assumption").alias("source")).select("model", "v.*", "source")
    none = F.lit(None).cast("string")
    problems = simulate.input_problems(inputs.withColumns({"declared_unit": none, "source_ref": none, "ontology_ref": none}), spark.createDataFrame([], "ontology_ref string"))
    kinds = models.select("model", F.explode(F.array(*map(F.lit, "abc"))).alias("kind"))
    scenarios = kinds.select(F.concat_ws(":", "kind", "model").alias("scenario"), F.when(F.col("kind") == "b", "x").otherwise(F.col("model")).alias("model"))
    steps = scenarios.where("scenario like 'c:%'").select("scenario", F.lit("units").alias("variable"), F.lit("multiply").alias("operation"), F.lit(-1.0).alias("value"), F.lit(0).alias("ord"))
    results, summary = simulate.run(inputs, [{"id": "revenue", "algorithm": "finance.revenue", "inputs": ["units", "price"], "unit": "CNY"}], ["revenue"], scenarios, steps)
    violations = simulate.assertion_violations(results, steps.select("scenario", F.lit("revenue").alias("variable"), F.lit("nondecreasing").alias("type")))
    path = f"{shared_folder(spark)}/weft-sweep-{uuid.uuid4().hex}"
    simulate.sweep(models, problems, scenarios, summary, violations).write.json(path)
    return spark.read.schema("item string, issue string").json(path)
