"""Parts, suppliers and orders as index records, projected to quads, and as documents under a closed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import json_schema, projection
from weftgraph.plans.registry import query, table
from weftgraph.schemas import PROVENANCE

NS = "urn:plant:"
_V = {"type": "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "skos": "http://www.w3.org/2004/02/skos/core#", "prov": "http://www.w3.org/ns/prov#"}


def _sql(graph: str, rows: list[tuple[str, str, str, str, str]], source: str) -> str:
    """A SELECT for each quad (s, p, o, kind, language) of source, nulls and blanks left out."""
    return " UNION ".join(f"SELECT '{NS}{graph}' AS g, {s} AS s, {p} AS p, {o} AS o, '{kind}' AS o_kind, '' AS o_dt, '{lang}' AS o_lang FROM {source} WHERE {o} IS NOT NULL AND regexp_matches({o}, '\\S')" for s, p, o, kind, lang in rows)


def _lit(name: str, vocabulary: str = "") -> str:
    return f"'{_V[vocabulary] if vocabulary else NS}{name}'"


_P = "'urn:plant:catalog:part%2F' || p_partkey || '%20x'"
_PROV = f"'{NS}provenance:' || substr(sha256({{s}}), 1, 24)"


def _provenance_sql(s: str, source: str, ref: str, confidence: str) -> str:
    at = _PROV.format(s=s)
    return _sql("graph:provenance", [(at, f"'{_V['type']}'", _lit("Entity", "prov"), "iri", ""), (at, _lit("specializationOf", "prov"), s, "iri", ""), (at, _lit("sourceRef"), ref, "literal", ""), (at, _lit("confidence"), confidence, "literal", "")], source)


@query(
    _sql(
        "graph:catalog",
        [
            (_P, f"'{_V['type']}'", "CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'urn:plant:' || p_type || 'Part' END", "iri", ""), (_P, f"'{_V['type']}'", _lit("CatalogConcept"), "iri", ""), (_P, _lit("legacyId"), "'part/' || p_partkey || ' x'", "literal", ""),
            (_P, _lit("notation", "skos"), "'part/' || p_partkey || ' x'", "literal", ""), (_P, _lit("prefLabel", "skos"), "p_name", "literal", "zh"), (_P, _lit("altLabel", "skos"), "p_brand", "literal", ""), (_P, _lit("size"), "CASE WHEN p_size > 10 THEN p_size::VARCHAR ELSE ' ' END", "literal", ""),
        ],
        "part",
    )
    + " UNION "
    + _provenance_sql(_P, "part", "CASE WHEN p_partkey % 2 = 0 THEN 'ref' || p_partkey ELSE 'parts.yaml' END", "CASE WHEN p_size > 20 THEN 'high' END")
)
def entity_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities: mapped and unmapped types, ids to escape, blank attributes, provenance by reference or by file."""
    none = F.lit(None).cast("string")
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part/"), F.col("p_partkey"), F.lit(" x")).alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name_zh"), none.alias("name_en"), none.alias("description"), none.alias("unit"), none.alias("severity"),
        F.array(F.col("p_brand"), none).alias("aliases"), F.create_map(F.lit("size"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise(" ")).alias("attributes"),
        F.struct(none.alias("source_type"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ref"), F.col("p_partkey"))).otherwise("").alias("ref"), F.when(F.col("p_size") > 20, "high").alias("confidence"), none.alias("created_at")).alias("provenance"), F.lit("parts.yaml").alias("_file"),
    )
    types = spark.createDataFrame([(t, f"{NS}{t}Part") for t in ("SMALL", "LARGE")], "type string, class string")
    return projection.entity_quads(parts, types, NS)


_EDGES = """(SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk, CASE WHEN l_suppkey % 3 = 0 THEN 'ext.' ELSE 's.' END || l_suppkey AS dst, l_returnflag AS flag, CASE WHEN l_returnflag = 'R' THEN 'returned by' ELSE 'supplied_by' END AS rel,
  'p' || l_partkey || '|' || CASE WHEN l_returnflag = 'R' THEN 'returned by' ELSE 'supplied_by' END || '|' || CASE WHEN l_suppkey % 3 = 0 THEN 'ext.' ELSE 's.' END || l_suppkey || '|lines|' AS key FROM lineitem)"""
_AT, _S = f"'{NS}assertion:' || substr(sha256(key), 1, 24)", f"'{NS}catalog:p' || pk"
_O = f"CASE WHEN sk % 3 = 0 THEN '{NS}external:' ELSE '{NS}catalog:' END || dst"
_R = f"CASE WHEN flag = 'R' THEN '{NS}relation:returned%20by' ELSE '{NS}suppliedBy' END"


@query(
    _sql("graph:relations", [(_S, _R, _O, "iri", "")], _EDGES)
    + " UNION "
    + _sql("graph:provenance", [(_AT, f"'{_V['type']}'", _lit("Statement", "rdf"), "iri", ""), (_AT, _lit("subject", "rdf"), _S, "iri", ""), (_AT, _lit("predicate", "rdf"), _R, "iri", ""), (_AT, _lit("object", "rdf"), _O, "iri", ""), (_AT, _lit("likelihood"), "CASE WHEN flag = 'A' THEN 'high' END", "literal", ""), (_AT, _lit("sourceRef"), "'lines'", "literal", "")], _EDGES)
)
def relation_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their suppliers as relations: a mapped and an unmapped type, ends outside, and a statement about each."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.when(F.col("l_returnflag") == "R", "returned by").otherwise("supplied_by").alias("rel_type"), F.concat(F.when(F.col("l_suppkey") % 3 == 0, "ext.").otherwise("s."), F.col("l_suppkey")).alias("dst"),
        F.lit(None).cast("string").alias("note"), F.when(F.col("l_returnflag") == "A", "high").alias("likelihood"), F.lit(None).cast("string").alias("field"), F.lit(None).cast(PROVENANCE).alias("provenance"), F.lit("lines").alias("_file"),
    )
    return projection.relation_quads(edges, spark.createDataFrame([("supplied_by", NS + "suppliedBy")], "rel_type string, predicate string"), NS)


_B, _C = f"'{NS}playbook:o' || o_orderkey", f"'{NS}catalog:p' || l_partkey"
_N = f"'{NS}cause-assertion:o' || o_orderkey || '%3A' || k"
_LINES = "(SELECT o_orderkey, l_partkey, l_linestatus, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_linestatus) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P')"
_ORDERS = "(SELECT * FROM orders WHERE o_orderstatus = 'P')"


@query(
    _sql("graph:playbooks", [(_B, f"'{_V['type']}'", _lit("DiagnosticPlaybook"), "iri", ""), (_B, _lit("legacyId"), "'o' || o_orderkey", "literal", ""), (_B, _lit("label", "rdfs"), "o_orderpriority", "literal", "zh"), (_B, _lit("diagnosesAnomaly"), f"'{NS}catalog:c' || o_custkey", "iri", "")], _ORDERS)
    + " UNION "
    + _sql("graph:playbooks", [(_N, f"'{_V['type']}'", _lit("PossibleCauseAssertion"), "iri", ""), (_N, _lit("assertsCause"), _C, "iri", ""), (_B, _lit("hasCauseAssertion"), _N, "iri", ""), (_B, _lit("hasPossibleCause"), _C, "iri", ""), (_N, _lit("discriminatorText"), "l_linestatus", "literal", "zh")], _LINES)
    + " UNION "
    + _provenance_sql(_B, _ORDERS, "'orders'", "'low'")
)
def playbook_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders as playbooks, their lines as possible causes, numbered in their order."""
    none = F.lit(None).cast("string")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_linestatus"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(lines, "o_orderkey", "left")
    causes = F.transform("lines", lambda l: F.struct(F.concat(F.lit("p"), l["l_partkey"]).alias("cause_ref"), none.alias("likelihood"), l["l_linestatus"].alias("discriminator")))
    cases = orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("c"), F.col("o_custkey")).alias("anomaly_ref"), none.alias("detected_at_ref"), F.array().cast("array<string>").alias("symptoms"), causes.alias("possible_causes"),
        F.lit(None).cast("array<struct<metric_ref:string,signal:string>>").alias("detection"), F.lit(None).cast("array<struct<action_ref:string,condition:string,`order`:int>>").alias("actions"), F.lit(None).cast("struct<blocked_processes:array<string>,economic:string>").alias("impact"),
        F.struct(none.alias("source_type"), none.alias("ref"), F.lit("low").alias("confidence"), none.alias("created_at")).alias("provenance"), F.lit("orders").alias("_file"),
    )
    return projection.playbook_quads(cases, NS)


#: A document for each order, with its lines in an array.
ORDER_SCHEMA = {
    "type": "object", "required": ["id", "placed", "provenance", "lines"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^ord\\.[0-9]+$"}, "placed": {"type": "string", "format": "date"}, "note": {"type": "string", "minLength": 3}, "total": {"type": "number", "minimum": 1000},
        "provenance": {"type": "object", "required": ["source"], "properties": {"source": {"enum": ["web", "human"]}}, "additionalProperties": False}, "lines": {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/line"}},
    },
    "$defs": {"line": {"type": "object", "required": ["part"], "properties": {"part": {"type": "integer"}, "flag": {"enum": ["A", "R"]}, "open": {"type": "boolean"}}, "additionalProperties": False, "oneOf": [{"required": ["flag"], "not": {"required": ["open"]}}, {"required": ["open"], "not": {"required": ["flag"]}}]}},
}


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_totalprice, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
l AS (SELECT l_orderkey, l_orderkey % 7 AS k, l_returnflag AS flag, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS n, l_linestatus AS status FROM lineitem)
SELECT o_orderkey, '$' AS path, 'json' AS rule FROM o WHERE k = 6 UNION ALL SELECT o_orderkey, '$.id', 'pattern' FROM o WHERE k = 1 UNION ALL SELECT o_orderkey, '$.id', 'type' FROM o WHERE k = 2
UNION ALL SELECT o_orderkey, '$', 'required' FROM o WHERE k = 3 UNION ALL SELECT o_orderkey, '$.placed', 'format' FROM o WHERE k = 4 UNION ALL SELECT o_orderkey, '$.extra', 'additionalProperties' FROM o WHERE k = 5
UNION ALL SELECT o_orderkey, '$.provenance.source', 'enum' FROM o WHERE k = 5 UNION ALL SELECT o_orderkey, '$.provenance', 'required' FROM o WHERE k = 4 UNION ALL SELECT o_orderkey, '$.note', 'minLength' FROM o WHERE k = 1
UNION ALL SELECT o_orderkey, '$.total', 'minimum' FROM o WHERE k <> 6 AND o_totalprice < 1000 UNION ALL SELECT o_orderkey, '$.lines', 'minItems' FROM o WHERE k <> 6 AND lines < 2
UNION ALL SELECT l_orderkey, '$.lines[' || n || '].flag', 'enum' FROM l WHERE k <> 6 AND flag = 'N' AND status = 'O' UNION ALL SELECT l_orderkey, '$.lines[' || n || ']', 'oneOf' FROM l WHERE k <> 6 AND flag <> 'N' AND status = 'F'
UNION ALL SELECT l_orderkey, '$.lines[' || n || '].open', 'type' FROM l WHERE k = 2 AND status = 'F'""")
def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders, written as JSON with faults of many kinds, break of their schema."""
    k, open_ = F.col("o_orderkey") % 7, F.when(F.col("l_orderkey") % 7 == 2, '"yes"').otherwise("true")
    # a line has its flag, or whether it is open, or wrongly both
    members = F.when(F.col("l_linestatus") == "O", F.concat(F.lit(', "flag": "'), "l_returnflag", F.lit('"'))).when(F.col("l_returnflag") == "N", F.concat(F.lit(', "open": '), open_)).otherwise(F.concat(F.lit(', "flag": "'), "l_returnflag", F.lit('", "open": '), open_))
    line = F.concat(F.lit('{"part": '), "l_partkey", members, F.lit("}"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", line.alias("text")))), lambda x: x["text"]), ", ").alias("lines"))
    id_ = F.when(k == 1, F.lit('"order 1"')).when(k == 2, "2").otherwise(F.concat(F.lit('"ord.'), "o_orderkey", F.lit('"')))
    parts = [
        F.concat(F.lit('"id": '), id_), F.when(k != 3, F.concat(F.lit('"placed": "'), F.when(k == 4, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit('"'))), F.when(k == 1, '"note": "é!"'), F.concat(F.lit('"total": '), F.col("o_totalprice").cast("decimal(20,2)").cast("string")),
        F.when(k == 4, '"provenance": {}').when(k == 5, '"provenance": {"source": "guess"}, "extra": [1]').otherwise('"provenance": {"source": "web"}'), F.concat(F.lit('"lines": ['), F.coalesce("lines", F.lit("")), F.lit("]")),
    ]
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.concat(F.when(k == 6, "[").otherwise("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("text"))
    return json_schema.violations(orders, "o_orderkey", "text", ORDER_SCHEMA).select("o_orderkey", "path", "rule")
