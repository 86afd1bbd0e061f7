"""YAML and JSON documents as entity, relation, case and question tables.

Documents are files of one item list each.  Load order is part of their meaning, as the first of two equal ids counts:
files go by the order of their domains, then by name, and `_ord` keeps that order in the tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import schemas

DOMAINS = ("core", "fab", "ap", "erp")


def files(spark: SparkSession, folder: str, kind: str, domains: Sequence[str] = DOMAINS) -> list[tuple[str, str]]:
    """(path, text) of folder/<domain>/<kind>/*.yaml in load order."""
    found = []
    for domain in domains:
        pattern = f"{folder}/{domain}/{kind}/*.yaml" if kind else f"{folder}/{domain}/*.yaml"
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        names = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if names is not None and len(names):
            rows = spark.read.text(pattern, wholetext=True).select("value", F.input_file_name().alias("path")).collect()  # ontology files are small
            found += sorted((r["path"], r["value"]) for r in rows)
    return found


def overlaid(item: Mapping, default: Mapping | None) -> dict:
    """The item with the file's default provenance under its own; a key of its own counts even if null."""
    out = dict(item)
    if default:
        out["provenance"] = {**default, **(item.get("provenance") or {})}
    return out


def items(sources: Iterable[tuple[str, str]], key: str, default_key: str = "default_provenance") -> list[dict]:
    """Items of all files with `_file` and `_ord`; what is not a mapping is left out."""
    out = []
    for path, text in sources:
        document = yaml.safe_load(text) or {}
        attributes = document.get("default_attributes") or {}
        for item in document.get(key) or ():
            if isinstance(item, dict):
                made = overlaid(item, document.get(default_key)) | {"_file": path, "_ord": len(out)}
                if attributes and key == "entities":
                    made["attributes"] = {**attributes, **(item.get("attributes") or {})}
                out.append(made)
    return out


def _shaped(value, kind):
    """A document value as the type of its column: scalars become text, missing fields null."""
    from pyspark.sql import types as T

    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_shaped(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [_shaped(v, kind.elementType) for v in (value if isinstance(value, list) else [value])]
    if isinstance(kind, T.MapType):
        return {str(k): None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str) for k, v in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return int(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    return value if isinstance(value, str) else str(value)


def table(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    kind = schemas.struct(schema)
    return spark.createDataFrame([_shaped(r, kind) for r in rows], kind)


def entities(spark: SparkSession, sources: Iterable[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities of the first row of each id, later rows of known ids, (id, type, keys, _file) of all rows)."""
    rows = [r for r in items(sources, "entities") if r.get("id")]
    every = table(spark, rows, schemas.ENTITY).withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy("_ord")))
    keys = spark.createDataFrame([(r["id"], r.get("type"), sorted(k for k in r if not k.startswith("_")), r["_file"]) for r in rows], "id string, type string, keys array<string>, _file string")
    return every.where("_nth = 1").drop("_nth"), every.where("_nth > 1").drop("_nth"), keys


def relations(spark: SparkSession, sources: Iterable[tuple[str, str]]) -> DataFrame:
    rows = [{**r, "src": r.get("from"), "rel_type": r.get("type"), "dst": r.get("to"), "derived": False} for r in items(sources, "relations")]
    return table(spark, rows, schemas.EDGE)


def cases(spark: SparkSession, sources: Iterable[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(cases, (id, type, keys, _file)); repeated ids are kept for the checks."""
    rows = items(sources, "cases")
    keys = spark.createDataFrame([(r.get("id"), None, sorted(k for k in r if not k.startswith("_")), r["_file"]) for r in rows], "id string, type string, keys array<string>, _file string")
    return table(spark, rows, schemas.CASE), keys


def questions(spark: SparkSession, text: str) -> DataFrame:
    """(id, bucket, text, match_terms, entity_types, relations, probe JSON array, reason) of a competency catalogue."""
    document, rows = yaml.safe_load(text) or {}, []
    for bucket in ("in_scope", "out_of_scope"):
        for item in document.get(bucket) or ():
            needs, probe = item.get("requires") or {}, item.get("probe")
            probes = probe if isinstance(probe, list) else [probe] if probe else []
            rows.append((item.get("id"), bucket, item.get("question") or item.get("text"), item.get("match_terms") or [], needs.get("entity_types") or [], needs.get("relations") or [], [json.dumps(p, ensure_ascii=False) for p in probes], item.get("reason")))
    return spark.createDataFrame(rows, "id string, bucket string, text string, match_terms array<string>, entity_types array<string>, relations array<string>, probe array<string>, reason string")


def catalogue(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, document JSON); a file that cannot be read keeps its row with a null document."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def document(texts):
        def one(text):
            try:
                return json.dumps(yaml.safe_load(text), ensure_ascii=False, default=str)
            except yaml.YAMLError:
                return None

        return texts.map(one)

    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), document("value").alias("document"))


KNOWLEDGE = "id string, title string, domain string, summary string, content string, source_refs array<string>, related_iris array<string>, confidence string, provenance struct<source_type:string,source_ref:string>, classification string"


def knowledge(spark: SparkSession, *paths: str) -> DataFrame:
    """Knowledge entries, one JSON document a file; what does not parse has a null id and is left out, restricted text is withheld."""
    return redacted(spark.read.schema(KNOWLEDGE).json(list(paths), multiLine=True))


def redacted(entries: DataFrame) -> DataFrame:
    """Entries with an id, restricted ones without summary and content."""
    rows = entries.where("id is not null")
    open_ = ~F.coalesce(F.col("classification") == "restricted", F.lit(False))
    return rows.withColumns({"summary": F.when(open_, F.col("summary")), "content": F.when(open_, F.col("content"))})


def case_nodes(cases_: DataFrame) -> DataFrame:
    """Index records of cases: constant type, references plucked from nested arrays."""
    return cases_.select("id", F.lit("Playbook").alias("type"), "domain", F.col("title").alias("name_zh"), "anomaly_ref", F.transform("possible_causes", lambda x: x["cause_ref"]).alias("cause_refs"), F.transform("actions", lambda x: x["action_ref"]).alias("action_refs"), F.col("provenance.confidence").alias("confidence"), "tags")


def entity_nodes(entities_: DataFrame) -> DataFrame:
    """Index records of entities: provenance flattened, economic hooks as an array that is never null."""
    empty = F.array().cast("array<string>")
    return entities_.select("id", "type", "domain", "name_zh", "name_en", F.coalesce("aliases", empty).alias("aliases"), F.coalesce("tags", empty).alias("tags"), F.coalesce(F.col("economic_hooks.affects"), empty).alias("affects"), F.col("provenance.source_type").alias("source_type"), F.col("provenance.confidence").alias("confidence"))


def index_records(entities_: DataFrame, cases_: DataFrame) -> DataFrame:
    return entity_nodes(entities_).unionByName(case_nodes(cases_), allowMissingColumns=True)
