"""Graph queries: customers and suppliers are part of nations, nations of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.operators.graph import Step
from weftgraph.plans.registry import query, table
from weftgraph.storage import stored


def part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, rel_type, dst) of membership."""

    def edges(name: str, a: str, key: str, b: str, parent: str) -> DataFrame:
        rows = table(spark, sf_dir, name)
        return rows.select(F.concat(F.lit(f"{a}:"), F.col(key)).alias("src"), F.lit("partOf").alias("rel_type"), F.concat(F.lit(f"{b}:"), F.col(parent)).alias("dst"))

    return edges("customer", "c", "c_custkey", "n", "c_nationkey").union(edges("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(edges("nation", "n", "n_nationkey", "r", "n_regionkey"))


def types(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.withColumn("type", F.split("id", ":")[0])


EDGE_SQL = """edge(src, dst) AS (
  SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation
)"""


@query("SELECT 'r:' || n_regionkey AS start, 'c:' || c_custkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_walk_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that two hops against partOf reach from each region."""
    edges = part_of(spark, sf_dir)
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey")).alias("id"))
    return graph.walk(edges, starts, [Step("partOf", "in"), Step("partOf", "in", "c")], types(edges))


@query(f"WITH RECURSIVE {EDGE_SQL}, path AS (SELECT src, dst FROM edge UNION SELECT p.src, e.dst FROM path p JOIN edge e ON p.dst = e.src) SELECT src, dst FROM path")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitive_closure(part_of(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGE_SQL}, below(node) AS (SELECT 'r:1' UNION SELECT e.src FROM below b JOIN edge e ON e.dst = b.node) SELECT node FROM below")
def graph_transitive_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitive_subjects(part_of(spark, sf_dir), spark.createDataFrame([("r:1",)], "node string"))


NEXT_SQL = "edge(src, dst) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 20 FROM nation WHERE n_nationkey % 4 <> 0)"


def next_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("src"), F.lit("precedes").alias("rel_type"), F.expr("(n_nationkey * 7 + 3) % 20").alias("dst"))


@query(f"WITH RECURSIVE {NEXT_SQL}, path AS (SELECT src, dst FROM edge UNION SELECT p.src, e.dst FROM path p JOIN edge e ON p.dst = e.src) SELECT DISTINCT src AS node FROM path WHERE src = dst")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(next_nation(spark, sf_dir))


BLOCK_SQL = """edge(src, dst) AS (SELECT p_partkey, p_partkey // 10 * 10 + (p_partkey * 7 + p_size) % 10 FROM part UNION SELECT p_partkey, p_partkey // 10 * 10 + p_size % 10 FROM part WHERE p_size % 3 = 0
UNION SELECT p_partkey, p_partkey + 10 FROM part WHERE p_partkey % 130 = 0),
reach(src, dst) AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src),
comp AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"""


def block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among each ten parts, and some from ten to ten."""
    parts = table(spark, sf_dir, "part")
    first = parts.selectExpr("p_partkey as src", "p_partkey div 10 * 10 + (p_partkey * 7 + p_size) % 10 as dst")
    return first.union(parts.where("p_size % 3 = 0").selectExpr("p_partkey", "p_partkey div 10 * 10 + p_size % 10")).union(parts.where("p_partkey % 130 = 0").selectExpr("p_partkey", "p_partkey + 10"))


@query(f"WITH RECURSIVE {BLOCK_SQL} SELECT node, component FROM comp")
def graph_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(block_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {BLOCK_SQL}, inner_edge AS (SELECT a.component, src, dst FROM edge JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.component = b.component),
walk(component, node, d) AS (SELECT DISTINCT component, component, 0 FROM comp UNION SELECT w.component, e.dst, w.d + 1 FROM walk w JOIN inner_edge e ON e.component = w.component AND e.src = w.node WHERE w.d < 11),
dist AS (SELECT component, node, min(d) FILTER (d > 0) AS d FROM walk GROUP BY component, node),
before AS (SELECT t.component, t.node, t.d, min(e.src) AS prev FROM dist t JOIN inner_edge e ON e.component = t.component AND e.dst = t.node
  LEFT JOIN dist s ON s.component = t.component AND s.node = e.src WHERE CASE WHEN t.d = 1 THEN e.src = t.component ELSE e.src <> t.component AND s.d = t.d - 1 END GROUP BY t.component, t.node, t.d),
back(component, node, d, path) AS (SELECT component, component, d, component::VARCHAR FROM before WHERE node = component
  UNION ALL SELECT k.component, b.prev, k.d - 1, b.prev::VARCHAR || ' -> ' || k.path FROM back k JOIN before b ON b.component = k.component AND b.node = k.node AND b.d = k.d WHERE k.d > 0)
SELECT component, path, (length(path) - length(replace(path, '>', '')))::BIGINT AS edges, (SELECT count(*) FROM comp c WHERE c.component = back.component)::BIGINT AS nodes FROM back WHERE d = 0""")
def graph_witness_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest cycle of each component, as text, with its edges and the component's nodes."""
    edges = block_edges(spark, sf_dir)
    nodes = stored(graph.strong_components(edges), "components")
    found = graph.witness_cycles(edges, nodes)
    sizes = nodes.groupBy("component").agg(F.count("*").alias("nodes"))
    return found.join(sizes, "component").select("component", F.array_join(F.transform("path", lambda n: n.cast("string")), " -> ").alias("path"), (F.size("path") - 1).cast("long").alias("edges"), "nodes")


@query("SELECT a.p_brand AS brand, a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def graph_chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each brand in a chain, closed."""
    chain = graph.adjacent_pairs(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], "p_partkey")
    return graph.transitive_closure(chain, within=["p_brand"]).select(F.col("p_brand").alias("brand"), "src", "dst")


@query(f"""WITH RECURSIVE {EDGE_SQL}, up(node, dst, depth) AS (
  SELECT src, src, 0 FROM edge UNION SELECT dst, dst, 0 FROM edge UNION SELECT u.node, e.dst, u.depth + 1 FROM up u JOIN edge e ON u.dst = e.src
), hit AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, dst) AS nth FROM up WHERE dst LIKE 'r:%' OR dst IN (SELECT 'n:' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0))
SELECT node, dst AS nearest, depth FROM hit WHERE nth = 1""")
def graph_nearest_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest region or even nation above each node."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n:"), F.col("n_nationkey")).alias("node"))
    return graph.nearest_marked(part_of(spark, sf_dir), nations.union(table(spark, sf_dir, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey")))))


@query("""WITH RECURSIVE pair(a, b) AS (SELECT DISTINCT 'u' || user_id, 't' || event_type || floor(value)::BIGINT FROM events WHERE value > 60),
both_ways(a, b) AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of users and the kinds of their high events."""
    events = table(spark, sf_dir, "events").where("value > 60")
    return graph.connected_components(events.select(F.concat(F.lit("u"), F.col("user_id")).alias("src"), F.concat(F.lit("t"), "event_type", F.floor("value")).alias("dst")))


@query(f"WITH {EDGE_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY node")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(part_of(spark, sf_dir))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a pending order."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    # orders have a range of keys of their own
    orders = orders.withColumn("dst", -1 - F.col("dst"))
    return graph.orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), orders)


@query("""SELECT p_partkey AS id, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey)::BIGINT AS degree FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)""")
def graph_coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without a large return, with their number of lines."""
    lines = table(spark, sf_dir, "lineitem")
    covered = lines.where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("id"))
    edges = lines.select(F.col("l_partkey").alias("src"), (-1 - F.col("l_orderkey")).alias("dst"))
    return graph.coverage_gap(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), covered, edges)


@query("""SELECT DISTINCT id FROM (
  SELECT o_custkey AS id, count(DISTINCT o_orderpriority) AS domains, max(o_orderstatus = 'P') AS hinted FROM orders GROUP BY o_custkey
) WHERE domains = 1 AND hinted""")
def graph_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders are all of one priority though one is pending."""
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.concat(F.lit("c:"), F.col("o_custkey")).alias("src"), F.concat(F.lit("o:"), F.col("o_orderkey")).alias("dst"), F.col("o_orderstatus").alias("note"))
    entities = orders.select(F.concat(F.lit("o:"), F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("domain"))
    return graph.one_sided(entities, edges, ["P"]).select(F.split("id", ":")[1].cast("long").alias("id"))


@query("""WITH RECURSIVE edge(src, dst) AS (
  SELECT 'r:' || n_regionkey, 'n:' || n_nationkey FROM nation UNION SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier
  UNION SELECT 'r:' || s_suppkey % 5, 's:' || s_suppkey FROM supplier
), path(src, dst) AS (SELECT src, dst FROM edge UNION ALL SELECT p.src, e.dst FROM path p JOIN edge e ON p.dst = e.src)
SELECT src AS node, count(*) AS paths FROM path GROUP BY src""")
def graph_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downward paths, where suppliers hang below a nation and below a region directly."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    edges = nations.select(F.concat(F.lit("r:"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n:"), F.col("n_nationkey")).alias("dst"))
    edges = edges.union(suppliers.select(F.concat(F.lit("n:"), F.col("s_nationkey")), F.concat(F.lit("s:"), F.col("s_suppkey"))))
    return graph.path_counts(edges.union(suppliers.select(F.concat(F.lit("r:"), F.col("s_suppkey") % 5), F.concat(F.lit("s:"), F.col("s_suppkey")))))


@query("SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_regionkey >= 3")
def graph_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without a parent that is known: regions 0 to 2 are."""
    edges = part_of(spark, sf_dir)
    nodes = types(edges).where("type = 'n' or id in ('r:0', 'r:1', 'r:2')").select("id")
    return graph.roots(nodes, edges).where("id like 'n:%'")


@query(f"WITH RECURSIVE {EDGE_SQL}, up(node) AS (SELECT 'c:' || c_custkey FROM customer WHERE c_acctbal > 9500 UNION SELECT e.dst FROM up u JOIN edge e ON u.node = e.src) SELECT node FROM up")
def graph_with_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("node"))
    return graph.with_ancestors(hits, part_of(spark, sf_dir))


@query(f"WITH {EDGE_SQL} SELECT DISTINCT node FROM (SELECT 'n:3' AS node UNION ALL SELECT src FROM edge WHERE dst = 'n:3' UNION ALL SELECT dst FROM edge WHERE src = 'n:3')")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(spark.createDataFrame([("n:3",)], "node string"), part_of(spark, sf_dir))


@query("""SELECT 'c:' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 2
UNION ALL SELECT 's:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 2 UNION ALL SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey < 2""")
def graph_accepted_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that can be accepted, parents first, where two regions are known."""
    edges = part_of(spark, sf_dir)
    known = spark.createDataFrame([("r:0",), ("r:1",)], "id string")
    return graph.accepted_in_order(edges.select(F.col("src").alias("id")), edges.select(F.col("src").alias("id"), F.col("dst").alias("parent")), known)


@query("""WITH line AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey),
short_order AS (SELECT o_orderkey FROM orders LEFT JOIN line ON l_orderkey = o_orderkey WHERE coalesce(n, 0) < 4),
placed AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM short_order) GROUP BY o_custkey)
SELECT 'o:' || o_orderkey AS s FROM short_order
UNION ALL SELECT 'c:' || c_custkey FROM customer LEFT JOIN placed ON o_custkey = c_custkey WHERE coalesce(n, 0) < 5""")
def graph_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of fewer than four lines go, then customers of fewer than five remaining orders."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    order, customer = F.concat(F.lit("o:"), F.col("o_orderkey")), F.concat(F.lit("c:"), F.col("o_custkey"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o:"), F.col("l_orderkey")).alias("s"), F.lit("line").alias("p"), F.concat(F.lit("l:"), "l_orderkey", F.lit("-"), "l_linenumber").alias("o"))
    triples = lines.union(orders.select(customer, F.lit("placed"), order))
    subjects = orders.select(order.alias("s"), F.lit("Order").alias("type")).union(customers.select(F.concat(F.lit("c:"), F.col("c_custkey")), F.lit("Customer")))
    return graph.pruned(triples, subjects, spark.createDataFrame([("Order", "line", 4), ("Customer", "placed", 5)], "type string, p string, least int"))[1]


@query("SELECT user_id, event_type AS src, dst FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL")
def graph_adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacent_pairs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT 'fab.' || lower(c_mktsegment) || '.' || c_custkey AS src, 'belongs_to' AS rel_type, 'n:' || c_nationkey AS dst FROM customer
UNION ALL SELECT 'm:' || m, 'used_by', 'fab.' || lower(c_mktsegment) || '.' || c_custkey FROM customer, unnest([c_custkey % 3, c_custkey % 5]) AS t(m)""")
def graph_derived_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges implied by a scalar and an array field, one of them reversed."""
    entities = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("fab."), F.lower("c_mktsegment"), F.lit("."), "c_custkey").alias("id"), F.concat(F.lit("n:"), "c_nationkey").alias("stage"),
        F.array(F.concat(F.lit("m:"), F.col("c_custkey") % 3), F.concat(F.lit("m:"), F.col("c_custkey") % 5)).alias("materials"),
    )
    return graph.derived_edges(entities, [("stage", "belongs_to", "entity -> value"), ("materials", "used_by", "value -> entity")]).select("src", "rel_type", "dst")


@query("""WITH cls(id) AS (VALUES ('Member'), ('Customer'), ('Nation')), ind(id, type) AS (
  SELECT 'c:' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'n:' || n_nationkey, 'Nation' FROM nation)
SELECT 'Customer' AS src, 'Member' AS dst, 'subclass' AS kind, '' AS label UNION ALL SELECT 'Customer', 'Nation', 'relation', 'partOf'
UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'instance', 'partOf' FROM customer""")
def graph_class_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the ontology graph of customers and nations."""
    kind = "o_kind"
    schema = spark.createDataFrame([("Member", "a", "Class"), ("Customer", "a", "Class"), ("Nation", "a", "Class"), ("Customer", "sub", "Member"), ("Nation", "sub", "Nation"), ("partOf", "domain", "Customer"), ("partOf", "range", "Nation")], "s string, p string, o string")
    edges = part_of(spark, sf_dir).where("src like 'c:%'")
    facts = edges.select(F.col("src").alias("s"), F.lit("partOf").alias("p"), F.col("dst").alias("o"))
    typed = facts.select("s", F.lit("a").alias("p"), F.lit("Customer").alias("o")).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), "n_nationkey"), F.lit("a"), F.lit("Nation")))
    triples = schema.union(facts).union(typed).withColumn(kind, F.lit("iri"))
    return graph.class_graph(triples, "a", "sub", "domain", "range", ["Class"])[1]
