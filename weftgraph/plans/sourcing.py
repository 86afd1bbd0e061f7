"""Sources and sinks: tables written out in each format and read back."""

from __future__ import annotations

import io
import uuid
import zipfile

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import changes
from weftgraph.plans.inference import NS, facts, order_triples
from weftgraph.operators.reasoner import TYPE
from weftgraph.plans.registry import query, table
from weftgraph.sources import documents, sinks, tables, turtle
from weftgraph.storage import exists, replace_all, shared_folder, stored


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/weft-{name}-{uuid.uuid4().hex}"


@query("SELECT 'o:' || o_orderkey AS s, o_orderstatus || chr(34) || chr(10) || chr(92) || o_orderpriority AS o FROM orders")
def quads_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads with quotes, line ends and backslashes as N-Quads lines, read back by the Turtle reader."""
    orders = table(spark, sf_dir, "orders")
    quads = facts(orders, "concat('o:', o_orderkey)", NS + "text", "concat(o_orderstatus, chr(34), chr(10), chr(92), o_orderpriority)", "literal").withColumn("g", F.lit("urn:g:1"))
    path = _place(spark, "quads")
    turtle.write(quads, path)
    back, issues = turtle.read(spark, path)
    # a line that can't be read would be missing from the rows and listed here
    return back.where(f"g = 'urn:g:1' and p = '{NS}text' and o_kind = 'literal'").select("s", "o").unionByName(issues.select(F.lit("issue").alias("s"), F.col("problem").alias("o")))


@query("SELECT DISTINCT 'c:' || o_custkey AS s, 'placed' AS p FROM orders UNION SELECT 'c:' || c_custkey, 'type' FROM customer")
def scoped_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of curated subjects alone: customers, none of the orders; each once, from all graphs."""
    triples = order_triples(spark, sf_dir).withColumn("g", F.lit("a"))
    every = turtle.triples(triples.unionByName(triples.withColumn("g", F.lit("b"))))
    subjects = table(spark, sf_dir, "customer").selectExpr("concat('c:', c_custkey) as s")
    local = F.when(F.col("p") == TYPE, "type").otherwise(F.element_at(F.split("p", ":"), -1))
    return sinks.scoped(every, subjects).select("s", local.alias("p")).distinct()


@query("SELECT p_partkey::VARCHAR AS key, p_name AS name, p_brand AS brand FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "csv")
    rows = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) as key", "p_name as name", "p_brand as brand")
    sinks.csv(rows, path)
    assert tables.headers(spark, path, "csv") == ["key", "name", "brand"]
    return spark.read.option("header", True).csv(path).select("key", "name", "brand")


@query("SELECT unnest(['csv', 'tsv', 'parquet', 'json', 'xlsx']) AS format, 'n_name|n_nationkey' AS headers, (SELECT count(*) FROM nation) AS n")
def delivered_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of one table delivered in each format, and the rows that it has there."""
    nation = table(spark, sf_dir, "nation").select("n_name", "n_nationkey").coalesce(1)
    places = {f: _place(spark, f) for f in ("csv", "tsv", "parquet", "json")}
    nation.write.option("header", True).csv(places["csv"])
    nation.write.option("header", True).option("sep", "\t").csv(places["tsv"])
    nation.write.parquet(places["parquet"])
    nation.write.json(places["json"])
    counts = {"csv": spark.read.option("header", True).csv(places["csv"]).count(), "tsv": spark.read.option("header", True).option("sep", "\t").csv(places["tsv"]).count(), "parquet": spark.read.parquet(places["parquet"]).count(), "json": spark.read.json(places["json"]).count()}
    found = {f: tables.headers(spark, p, f) for f, p in places.items()}
    book = stored(spark.createDataFrame([("nation.xlsx", _workbook([["n_name", "n_nationkey"], *([r["n_name"], r["n_nationkey"]] for r in nation.collect())]))], "path string, content binary"), "books")  # a row for each nation
    cells = tables.cells_of(book)
    found["xlsx"] = [r["value"] for r in cells.where("row = 1").orderBy("col").collect()]
    counts["xlsx"] = tables.sheet_rows(cells, ["n_name", "n_nationkey"]).count()
    return spark.createDataFrame([(f, "|".join(sorted(names)), counts[f]) for f, names in found.items()], "format string, headers string, n long")


def _workbook(rows: list[list]) -> bytes:
    """A workbook of one sheet with inline texts and numbers."""
    cells = "".join(
        f'<row r="{r}">' + "".join(f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(64 + c)}{r}"><v>{v}.0</v></c>' for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1)
    )
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        archive.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


@query("SELECT n_name AS name, n_nationkey::VARCHAR AS key, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each region, read cell by cell."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    books: dict[str, list] = {}
    for r in nation.select("r_name", "n_name", "n_nationkey").collect():  # a row for each nation
        books.setdefault(r["r_name"], [["name", "key"]]).append([r["n_name"], r["n_nationkey"]])
    files = stored(spark.createDataFrame([(k, _workbook(v)) for k, v in books.items()], "path string, content binary"), "books")
    return tables.features(tables.sheet_rows(tables.cells_of(files), ["name", "key"]), "name").select("name", "key", F.col("path").alias("region"))


@query("""SELECT c_custkey, 0 AS table_no, (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1)::INT AS row_no, 'Tool ' || c_custkey AS equipment, 'run' AS phase, o_orderkey::VARCHAR AS key, o_orderstatus AS state, o_orderpriority AS state_1
FROM customer JOIN orders ON o_custkey = c_custkey""")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables of orders, a text for each customer; equal headings are told apart."""
    tables.register(spark)
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("o"))
    lines = F.array_join(F.transform("o", lambda x: F.concat(F.lit("| "), x["o_orderkey"].cast("string"), F.lit(" | **"), x["o_orderstatus"], F.lit("** |<br>"), x["o_orderpriority"], F.lit(" |"))), "\n")
    orders.select("c_custkey", F.concat(F.lit("# Log\n## Tool "), F.col("c_custkey").cast("string"), F.lit("场景\n### run\n\n| Key | State | State |\n|---|:-:|---|\n"), lines, F.lit("\n\nend")).alias("text")).createOrReplaceTempView("weft_markdown")
    rows = spark.sql("SELECT c_custkey, m.table_no, m.row_no, m.cells FROM weft_markdown, LATERAL markdown_tables(text) AS m")
    return rows.select("c_custkey", "table_no", "row_no", *[F.col("cells")[c].alias(c) for c in ("equipment", "phase", "key", "state", "state_1")])


@query("SELECT 'n:' || n_nationkey AS id, 'Nation' AS type, n_name AS name_en, CASE WHEN n_nationkey % 2 = 0 THEN 'web' ELSE 'human' END AS source_type, 'medium' AS confidence, 0 AS duplicates FROM nation UNION ALL SELECT 'r:' || r_regionkey, 'Region', r_name, 'web', 'medium', 1 FROM region")
def yaml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of YAML files with a default provenance; regions are listed twice and the first row of each counts."""
    regions = [{"id": f"r:{r['r_regionkey']}", "type": "Region", "name_en": r["r_name"]} for r in table(spark, sf_dir, "region").collect()]
    nations = [{"id": f"n:{r['n_nationkey']}", "type": "Nation", "name_en": r["n_name"], **({} if r["n_nationkey"] % 2 == 0 else {"provenance": {"source_type": "human"}})} for r in table(spark, sf_dir, "nation").collect()]
    default = {"source_type": "web", "confidence": "medium"}
    files = [("a.yaml", yaml.safe_dump({"default_provenance": default, "entities": [*regions, *nations]})), ("b.yaml", yaml.safe_dump({"entities": [{**r, "name_en": "later"} for r in regions]}))]
    first, later, _ = documents.entities(spark, files)
    again = later.groupBy("id").agg(F.count("*").cast("int").alias("duplicates"))
    nodes = documents.entity_nodes(first).join(again, "id", "left")
    return nodes.select("id", "type", "name_en", "source_type", "confidence", F.coalesce("duplicates", F.lit(0)).alias("duplicates"))


@query("SELECT 'n:' || n_nationkey AS src, 'partOf' AS rel_type, 'r:' || n_regionkey AS dst, false AS derived FROM nation")
def yaml_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [{"from": f"n:{r['n_nationkey']}", "type": "partOf", "to": f"r:{r['n_regionkey']}"} for r in table(spark, sf_dir, "nation").collect()]
    return documents.relations(spark, [("r.yaml", yaml.safe_dump({"relations": [*rows, "not a mapping"]}))]).select("src", "rel_type", "dst", "derived")


@query("""SELECT 'n:' || n_nationkey AS id, 'Playbook' AS type, n_name AS name_zh, 'a:' || n_regionkey AS anomaly_ref, 'x:' || n_nationkey || ',y' AS cause_refs, 'act' AS action_refs FROM nation""")
def yaml_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records of cases: references plucked from nested lists."""
    cases = [{"id": f"n:{r['n_nationkey']}", "title": r["n_name"], "anomaly_ref": f"a:{r['n_regionkey']}", "possible_causes": [{"cause_ref": f"x:{r['n_nationkey']}"}, {"cause_ref": "y"}], "actions": [{"action_ref": "act"}]} for r in table(spark, sf_dir, "nation").collect()]
    found, _ = documents.cases(spark, [("c.yaml", yaml.safe_dump({"cases": cases}))])
    nodes = documents.case_nodes(found)
    return nodes.select("id", "type", "name_zh", "anomaly_ref", F.array_join("cause_refs", ",").alias("cause_refs"), F.array_join("action_refs", ",").alias("action_refs"))


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS summary, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS content FROM documents WHERE doc_id % 7 <> 0""")
def redacted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge entries from JSON, one document a line: restricted ones without their text, those without an id left out."""
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("summary"), F.col("source").alias("content"), F.when(F.col("doc_id") % 3 == 0, "restricted").otherwise("open").alias("classification"))
    path = _place(spark, "entries")
    docs.write.json(path)
    return documents.redacted(spark.read.schema(documents.KNOWLEDGE).json(path)).select("id", "summary", "content")


@query("SELECT unnest(['first', 'same', 'changed']) AS step, unnest([true, false, true]) AS wrote, unnest([(SELECT count(*) FROM part), (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_size > 9)]) AS n")
def written_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is written again only if its rows differ, whatever their order."""
    parts, path = table(spark, sf_dir, "part").select("p_partkey", "p_size"), _place(spark, "sink")
    steps = []
    for step, df in (("first", parts), ("same", parts.repartition(3)), ("changed", parts.where("p_size > 9"))):
        wrote = sinks.write_if_changed(df, path)
        steps.append((step, wrote, spark.read.parquet(path).count()))
    return spark.createDataFrame(steps, "step string, wrote boolean, n long")


@query("SELECT o_custkey AS k, 1 AS batch FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY ALL")
def appended_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a second batch whose key the table lacks are appended, each key once."""
    orders, path = table(spark, sf_dir, "orders"), _place(spark, "appended")
    sinks.append_new(orders.where("o_orderkey % 2 = 0").selectExpr("o_custkey as k", "1 as batch"), path, "k")
    sinks.append_new(orders.selectExpr("o_custkey as k", "2 as batch"), path, "k")
    return spark.read.parquet(path)


@query("SELECT s_suppkey, s_name, s_acctbal, 'new' AS state, NULL::DOUBLE AS rating FROM supplier")
def copied_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows copied into an empty table of other columns: shared ones as they are, others by default; a second copy is refused."""
    path = _place(spark, "copy")
    supplier = table(spark, sf_dir, "supplier")
    spark.createDataFrame([], "s_suppkey long, s_name string, s_acctbal double, state string, rating double").write.parquet(path)
    sinks.copy_columns(supplier, path, {"state": "new"})
    try:
        sinks.copy_columns(supplier, path)
    except ValueError:
        return spark.read.parquet(path)
    raise AssertionError("the table has rows")


@query("SELECT unnest(['nation', 'region']) AS name, unnest([(SELECT count(*) FROM nation), (SELECT count(*) FROM region)]) AS n, true AS digests")
def exported_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of two tables: their rows, and whether the manifest's digests are those of the files."""
    folder = _place(spark, "export")
    names = ("nation", "region")
    manifest = sinks.export(spark, {n: table(spark, sf_dir, n) for n in names}, folder)
    held = tables.digests(spark, *[f"{folder}/{n}/part-*" for n in names])
    same = manifest.join(held, ["path", "sha256", "size"], "left_anti").isEmpty() and held.join(manifest, ["path", "sha256", "size"], "left_anti").isEmpty()
    return spark.createDataFrame([(n, spark.read.parquet(f"{folder}/{n}").count(), same) for n in names], "name string, n long, digests boolean")


@query("SELECT 'kept' AS step, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'replaced', count(*) FROM region")
def replaced_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables are replaced together: when one can't be written, the other keeps its old rows."""
    a, b = _place(spark, "a"), _place(spark, "b")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    replace_all({a: nation})
    broken = region.select(F.raise_error(F.lit("broken")).alias("x"))
    try:
        replace_all({a: region, b: broken})
    except Exception:
        kept = spark.read.parquet(a).count() if not exists(spark, b) else -1
    else:
        kept = -2
    replace_all({a: region, b: nation})
    return spark.createDataFrame([("kept", kept), ("replaced", spark.read.parquet(a).count())], "step string, n long")


@query("SELECT unnest(range(1, 6)) AS run, unnest([true, false, true, false, true]) AS ran")
def runs_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage runs when its input has changed since its last good run, and when it is asked for in any case."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    state, out = {}, []
    for k, (inputs, always) in enumerate([([nation], False), ([nation.repartition(2)], False), ([nation.where("n_nationkey > 3"), region], False), ([nation.where("n_nationkey > 3"), region], False), ([nation.where("n_nationkey > 3"), region], True)], 1):
        state, ran = changes.run_if_changed(state, "stage", inputs, lambda: None, always)
        out.append((k, ran))
    return spark.createDataFrame(out, "run long, ran boolean")
