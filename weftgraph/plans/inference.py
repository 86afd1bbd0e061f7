"""Closure, rules and shapes over triples made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import graph, reasoner, rules, shapes
from weftgraph.operators.reasoner import CHAIN, DOMAIN, FIRST, INVERSE, NIL, RANGE, REST, SUBCLASS, SUBPROPERTY, TRANSITIVE, TYPE
from weftgraph.operators.rules import Lit, Rule
from weftgraph.plans.graphs import part_of
from weftgraph.plans.registry import query, table
from weftgraph.storage import stored

NS = "urn:weft:"


def facts(rows: DataFrame, s: str, p: str, o: str, kind: str = "iri", datatype: str = "") -> DataFrame:
    """Triples of SQL expressions for subject and object."""
    return rows.select(F.expr(s).alias("s"), F.lit(p).alias("p"), F.expr(o).cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).alias("o_dt"), F.lit("").alias("o_lang"))


def schema_triples(spark: SparkSession) -> DataFrame:
    """directPartOf below the transitive partOf, hasPart its inverse, usesZone passed on along partOf, two levels of classes."""
    rows = [
        *[("directPartOf", SUBPROPERTY, "partOf"), ("partOf", TYPE, TRANSITIVE), ("hasPart", INVERSE, "partOf"), ("directPartOf", DOMAIN, "Member"), ("directPartOf", RANGE, "Group")],
        *[("Customer", SUBCLASS, "Party"), ("Supplier", SUBCLASS, "Party"), ("Party", SUBCLASS, "Agent"), ("usesZone", CHAIN, "_:one"), ("_:one", FIRST, "partOf"), ("_:one", REST, "_:two"), ("_:two", FIRST, "usesZone"), ("_:two", REST, NIL)],
    ]
    return spark.createDataFrame([(s, p, o, "bnode" if o.startswith("_:") else "iri", "", "") for s, p, o in rows], "s string, p string, o string, o_kind string, o_dt string, o_lang string")


@query("""WITH RECURSIVE direct(s, o) AS (SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation),
part(s, o) AS (SELECT s, o FROM direct UNION SELECT p.s, d.o FROM part p JOIN direct d ON p.o = d.s)
SELECT s, 'directPartOf' AS p, o FROM direct UNION SELECT s, 'partOf', o FROM part UNION SELECT o, 'hasPart', s FROM part
UNION SELECT s, 'type', 'Member' FROM direct UNION SELECT o, 'type', 'Group' FROM direct
UNION SELECT s, 'type', c FROM direct, (VALUES ('Customer'), ('Party'), ('Agent')) v(c) WHERE s LIKE 'c:%' UNION SELECT s, 'type', c FROM direct, (VALUES ('Supplier'), ('Party'), ('Agent')) v(c) WHERE s LIKE 's:%'
UNION SELECT 'r:' || r_regionkey, 'usesZone', 'z:' || r_regionkey % 2 FROM region UNION SELECT s, 'usesZone', 'z:' || substr(o, 3)::INT % 2 FROM part WHERE o LIKE 'r:%'""")
def reasoner_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that follows about customers, suppliers, nations and regions."""
    edges = part_of(spark, sf_dir)
    base = facts(edges, "src", "directPartOf", "dst").unionByName(facts(edges.where("src like 'c:%'"), "src", TYPE, "'Customer'")).unionByName(facts(edges.where("src like 's:%'"), "src", TYPE, "'Supplier'"))
    base = base.unionByName(facts(table(spark, sf_dir, "region"), "concat('r:', r_regionkey)", "usesZone", "concat('z:', r_regionkey % 2)"))
    schema = schema_triples(spark)
    closed = reasoner.closure(base.unionByName(schema), reasoner.read_schema(schema))
    known = closed.join(schema.select("s").distinct(), "s", "left_anti").where(~F.col("s").isin("Agent"))
    return known.select("s", F.element_at(F.split("p", "#"), -1).alias("p"), "o").distinct()


def order_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    c, o = "concat('c:', {})", "concat('o:', o_orderkey)"
    return (
        facts(customers, c.format("c_custkey"), TYPE, f"'{NS}Customer'")
        .unionByName(facts(orders, c.format("o_custkey"), NS + "placed", o))
        .unionByName(facts(orders, o, TYPE, f"'{NS}Order'"))
        .unionByName(facts(orders, o, NS + "year", "year(o_orderdate)", "literal"))
        .unionByName(facts(orders, o, NS + "status", "o_orderstatus", "literal"))
    )


@query("SELECT 'c:' || c_custkey AS s FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1997)")
def not_exists_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of 1997."""
    rule = Rule("R-DORMANT", [("?c", "state", Lit("dormant"))], [("?c", "a", "Customer")], unless=[("?c", "placed", "?o"), ("?o", "year", Lit("1997"))])
    return rules.constructed(order_triples(spark, sf_dir), rule, NS).select("s")


@query("""SELECT DISTINCT 'c:' || o_custkey AS s, 'hasPair' AS p, 'o:' || o_orderkey AS o FROM orders x WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM orders y WHERE y.o_custkey = x.o_custkey AND y.o_orderstatus = 'P' AND year(y.o_orderdate) = year(x.o_orderdate))""")
def join_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders of customers with a pending one of the same year: a rule of six patterns."""
    where = [("?c", "placed", "?o"), ("?o", "status", Lit("F")), ("?o", "year", "?y"), ("?c", "placed", "?q"), ("?q", "status", Lit("P")), ("?q", "year", "?y")]
    made = rules.constructed(order_triples(spark, sf_dir), Rule("R-PAIR", [("?c", "hasPair", "?o")], where), NS)
    return made.select("s", F.element_at(F.split("p", ":"), -1).alias("p"), "o")


@query("SELECT 'p:' || p_partkey AS s FROM part WHERE regexp_matches(lower(p_name), 'ring|edge') UNION SELECT 'p:' || p_partkey FROM part WHERE regexp_matches(lower(p_type), 'small')")
def union_regex_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    s = "concat('p:', p_partkey)"
    triples = facts(parts, s, TYPE, f"'{NS}Part'").unionByName(facts(parts, s, NS + "name", "p_name", "literal")).unionByName(facts(parts, s, NS + "kind", "p_type", "literal"))
    either = [([("?p", "name", "?n")], lambda v: F.lower(v("?n")).rlike("ring|edge")), ([("?p", "kind", "?k")], lambda v: F.lower(v("?k")).rlike("small"))]
    return rules.constructed(triples, Rule("R-PATTERN", [("?p", "mode", Lit("systematic"))], [("?p", "a", "Part")], either=either), NS).select("s")


@query("""WITH c AS (SELECT p_brand, p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT 'p:' || p_partkey AS node, (n - k)::BIGINT AS after, (k - 1)::BIGINT AS before, nxt IS NOT NULL AS started FROM c WHERE n > 1""")
def reasoner_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each brand in a chain of `directly precedes`, a part of the transitive `precedes` with an inverse and a domain: how many come after and before each part."""
    parts = table(spark, sf_dir, "part")
    chain = graph.adjacent_pairs(parts, "p_brand", ["p_partkey"], "p_partkey")
    schema = [(NS + "directlyPrecedes", reasoner.SUBPROPERTY, NS + "precedes"), (NS + "precedes", TYPE, reasoner.TRANSITIVE), (NS + "follows", reasoner.INVERSE, NS + "precedes"), (NS + "precedes", reasoner.DOMAIN, NS + "Start")]
    rules = reasoner.read_schema(spark.createDataFrame([(s, p, o, "iri", "", "") for s, p, o in schema], "s string, p string, o string, o_kind string, o_dt string, o_lang string"))
    rest, counts = reasoner.counted(facts(chain, "concat('p:', src)", NS + "directlyPrecedes", "concat('p:', dst)"), rules)
    of = [F.sum(F.when(F.col("p") == NS + p, F.col("n")).otherwise(0)).alias(c) for p, c in (("precedes", "after"), ("follows", "before"))]
    started = (F.col("p") == TYPE) & (F.col("o") == NS + "Start")
    every = counts.select("s", "p", "n", F.lit(False).alias("started")).unionByName(rest.select("s", "p", F.lit(0).cast("long").alias("n"), started.alias("started")))
    return every.groupBy(F.col("s").alias("node")).agg(*of, F.max("started").alias("started"))


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type FROM events)
SELECT DISTINCT 'e:' || a.event_id AS s, 'impactsLot' AS p, 'lot:' || b.user_id AS o FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND a.ts < b.ts + INTERVAL 1 HOUR AND b.ts < a.ts + INTERVAL 1 HOUR
UNION ALL SELECT 'e:' || a.event_id, 'derivedFrom', 'e:' || b.event_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND a.ts < b.ts + INTERVAL 1 HOUR AND b.ts < a.ts + INTERVAL 1 HOUR""")
def impact_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plant rule of overlapping intervals: errors as down events, purchases as processing of a lot; edges that it makes, and what its statements rest on."""
    from weftgraph.operators.rule_catalog import catalog

    rule = next(r for r in catalog(NS) if r.id == "R-INF-003")
    events = table(spark, sf_dir, "events")
    s, end = "concat('e:', event_id)", "date_format(ts + interval 1 hour, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    parts = []
    for kind, type_, tool in (("error", "DownEvent", "affectsEquipment"), ("purchase", "ProcessingEvent", "usesEquipment")):
        rows = events.where(F.col("event_type") == kind)
        parts += [facts(rows, s, TYPE, f"'{NS}{type_}'"), facts(rows, s, NS + tool, "concat('u:', user_id)"), facts(rows, s, NS + "validTo", end, "literal"), facts(rows, s, NS + "validFrom", end.replace("ts + interval 1 hour", "ts"), "literal")]
    parts.append(facts(events.where("event_type = 'purchase'"), s, NS + "processesLot", "concat('lot:', user_id)"))
    triples = parts[0]
    for part in parts[1:]:
        triples = triples.unionByName(part)
    # stored, as it is read three times
    made = stored(rules.constructed(triples, rule, NS), "made")
    edges = made.where(F.col("p") == NS + "impactsLot").select("s", F.lit("impactsLot").alias("p"), "o")
    # the statements' ends: the down event that each is about and the run that it is derived from
    about = made.where(F.col("p").endswith("#subject")).select(F.col("s").alias("node"), F.col("o").alias("s"))
    sources = made.where(F.col("p") == NS + "derivedFrom").select(F.col("s").alias("node"), "o").join(about, "node").where("o <> s")
    return edges.unionByName(sources.select("s", F.lit("derivedFrom").alias("p"), "o"))


@query("""WITH l AS (SELECT o_orderkey, count(DISTINCT l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT 'o:' || o_orderkey AS node, 'minCount' AS component, 'line' AS path, 'lines' AS message FROM l WHERE n < 3 UNION ALL SELECT 'o:' || o_orderkey, 'maxCount', 'line', 'lines' FROM l WHERE n > 6
UNION ALL SELECT 'o:' || o_orderkey, 'class', 'by', 'customer' FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE c_custkey IS NULL
UNION ALL SELECT 'o:' || o_orderkey, 'or', NULL, 'finish or urgency' FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'
UNION ALL SELECT 'o:' || o_orderkey, 'datatype', 'placed', 'date' FROM orders WHERE o_orderkey % 3 = 0""")
def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders need three to six lines, a customer in credit, a date that is one, and a finish or urgency."""
    orders, lines, customers = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    o = "concat('o:', o_orderkey)"
    base = facts(orders, o, TYPE, "'Order'").unionByName(facts(orders, o, "by", "concat('c:', o_custkey)")).unionByName(facts(customers.where("c_acctbal > 0"), "concat('c:', c_custkey)", TYPE, "'Solvent'"))
    base = base.unionByName(facts(lines, "concat('o:', l_orderkey)", "line", "l_linenumber", "literal", "urn:int"))
    base = base.unionByName(facts(orders.where("o_orderstatus = 'F'"), o, "finished", "'yes'", "literal")).unionByName(facts(orders.where("o_orderpriority = '1-URGENT'"), o, "urgent", "'yes'", "literal"))
    for rest, datatype in ((0, ""), (1, "urn:date"), (2, "urn:date")):
        base = base.unionByName(facts(orders.where(f"o_orderkey % 3 = {rest}"), o, "placed", "date_format(o_orderdate, 'yyyy-MM-dd')", "literal", datatype))
    constraints = [
        ("Date", "Order", "", "placed", None, None, None, "urn:date", "date"),
        *[("Lines", "Order", "", "line", 3, 6, None, "urn:int", "lines"), ("Payer", "Order", "", "by", None, None, "Solvent", None, "customer")],
        *[("Either", "Order", "a", "finished", 1, None, None, None, "finish or urgency"), ("Either", "Order", "b", "urgent", 1, None, None, None, "finish or urgency")],
    ]
    base = stored(base, "triples")
    found = shapes.violations(base, base, spark.createDataFrame(constraints, shapes.CONSTRAINT))
    return found.select("node", "component", "path", "message")
