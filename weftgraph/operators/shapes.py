"""Shape constraints over triples, as violation rows.

Constraints are rows (shape, target_class, branch, path, min_count, max_count, class, datatype, message).  branch is
empty for constraints that must all hold; rows of one shape with branches are alternatives: the shape is violated where
every branch is.  Targets are what the base triples type directly; counts and classes are those of the closed triples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.reasoner import FIRST, NIL, REST, TYPE
from weftgraph.operators.graph import fixpoint
from weftgraph.storage import stored

SHACL = "http://www.w3.org/ns/shacl#"
CONSTRAINT = "shape string, target_class string, branch string, path string, min_count int, max_count int, class string, datatype string, message string"
#: Predicates of shapes that the checks cover.
COVERED = [SHACL + x for x in ("targetClass", "property", "path", "minCount", "maxCount", "class", "datatype", "message", "or")] + [TYPE, FIRST, REST]


def read_shapes(triples: DataFrame) -> DataFrame:
    """The constraint table of a shapes graph; `or` lists give branches named by their list nodes."""

    def of(name: str, s: str, o: str) -> DataFrame:
        p = name if name.startswith("http") else SHACL + name
        return triples.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))

    targets = of("targetClass", "shape", "target_class")
    direct = targets.join(of("property", "shape", "node"), "shape").withColumn("branch", F.lit(""))
    cells = of(REST, "cell", "next").where(F.col("next") != NIL)
    heads = targets.join(of("or", "shape", "cell"), "shape").select("shape", "target_class", "cell")
    lists = fixpoint(heads, lambda new, _: new.join(cells, "cell").select("shape", "target_class", F.col("next").alias("cell")))
    branches = lists.join(of(FIRST, "cell", "branch"), "cell").join(of("property", "branch", "node"), "branch")
    rows = direct.select("shape", "target_class", "branch", "node").unionByName(branches.select("shape", "target_class", "branch", "node"))
    for name, column, kind in (("path", "path", "string"), ("minCount", "min_count", "int"), ("maxCount", "max_count", "int"), ("class", "class", "string"), ("datatype", "datatype", "string"), ("message", "message", "string")):
        rows = rows.join(of(name, "node", "_v").groupBy("node").agg(F.min("_v").cast(kind).alias(column)), "node", "left")
    return rows.drop("node")


def targets(base: DataFrame) -> DataFrame:
    """(node, target_class) of directly typed nodes."""
    return base.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("target_class")).distinct()


def violations(base: DataFrame, closed: DataFrame, constraints: DataFrame) -> DataFrame:
    """(shape, node, path, component, message), one row for each constraint that a target breaks; a shape of branches gives one row, component `or`.

    Values are counted by node and path before constraints, of which there are few, meet them; messages come last.
    """
    constraints = stored(constraints.withColumn("_c", F.monotonically_increasing_id()), "constraints")
    paths = constraints.select("path").distinct()
    values = closed.select(F.col("s").alias("node"), F.col("p").alias("path"), "o", "o_kind", "o_dt", "o_lang").join(F.broadcast(paths), "path", "left_semi").distinct()
    datatype = F.when(F.col("o_kind") != "literal", "").when(F.col("o_dt") != "", F.col("o_dt")).when(F.col("o_lang") != "", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise("http://www.w3.org/2001/XMLSchema#string")
    # a node's values of a path have few datatypes, "" for those that have none
    counts = values.groupBy("node", "path").agg(F.count("*").alias("n"), F.collect_set(datatype).alias("datatypes"))
    classes = constraints.where("class is not null").select("path", "class").distinct()
    members = closed.where(F.col("p") == TYPE).select(F.col("s").alias("o"), F.col("o").alias("class")).join(F.broadcast(classes.select("class").distinct()), "class", "left_semi").distinct()
    inside = values.where("o_kind <> 'literal'").join(F.broadcast(classes), "path").join(members, ["o", "class"]).groupBy("node", "path", "class").agg(F.count("*").alias("members"))
    aimed = targets(base).join(F.broadcast(constraints.drop("message")), "target_class")
    held = aimed.join(counts, ["node", "path"], "left").join(inside, ["node", "path", "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad_datatype = F.exists("datatypes", lambda t: t != F.col("datatype"))
    components = F.array(
        F.when(F.col("n") < F.col("min_count"), "minCount"), F.when(F.col("n") > F.col("max_count"), "maxCount"), F.when(F.col("class").isNotNull() & (F.coalesce("members", F.lit(0)) < F.col("n")), "class"), F.when(bad_datatype, "datatype")
    )
    broken = held.select("shape", "node", "branch", "path", "_c", F.explode_outer(F.array_compact(components)).alias("component"))
    texts = F.broadcast(constraints.select("_c", "message"))
    single = broken.where("branch = '' and component is not null").join(texts, "_c").select("shape", "node", "path", "component", "message")
    branches = broken.where("branch <> ''").groupBy("shape", "node", "branch").agg(F.max(F.col("component").isNotNull()).alias("broken"))
    named = constraints.where("branch <> ''").groupBy("shape").agg(F.min("message").alias("message"))
    every = branches.groupBy("shape", "node").agg(F.min("broken").alias("broken")).where("broken").join(F.broadcast(named), "shape")
    return single.unionByName(every.select("shape", "node", F.lit(None).cast("string").alias("path"), F.lit("or").alias("component"), "message"))


def forbidden_individuals(triples: DataFrame, class_iri: str) -> DataFrame:
    """(node): individuals of a class that must stay empty, after rules."""
    return triples.where((F.col("p") == TYPE) & (F.col("o") == class_iri)).select(F.col("s").alias("node")).distinct()
