"""Closed schemas of JSON documents: a JSON Schema compiled to tables of rules and steps, which documents are joined with.

A document is walked one level a job: its values, as variants with the schema node that describes them, meet the node's
rules, then give their members and items with the nodes of those.  Rounds are as many as documents are deep; the rules are
a table, so the plan does not grow with the schema.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.storage import dealt, stored

RULES = "node int, rule string, arg string, args array<string>, number double, ways array<struct<needs:array<string>,bars:array<string>>>"
STEPS = "node int, key string, child int"
#: Keywords that say nothing of a document's validity.
_SILENT = frozenset(("$schema", "$id", "$defs", "title", "description", "default", "examples", "$comment"))
#: Documents in a part.
EACH = 20_000
_LIMITS = ("minLength", "maxLength", "minItems", "maxItems", "minimum", "maximum")


class Compiled:
    """rules (see RULES) and steps (see STEPS: to a member by its key, to items by `[]`, to members without an own node by `*`) of a schema; node 0 is the document."""

    def __init__(self, schema: Mapping):
        self.schema = schema
        self.rules: list[tuple] = []
        self.steps: list[tuple[int, str, int]] = []
        self._refs: dict[str, int] = {}
        self._nodes = 0
        self._node(schema)

    def _rule(self, node: int, rule: str, arg: str | None = None, args: list[str] | None = None, number: float | None = None, ways: list | None = None) -> None:
        self.rules.append((node, rule, arg, args, number, ways))

    def _step(self, node: int, key: str, part: object) -> None:
        ref = part.get("$ref") if isinstance(part, Mapping) else None
        if ref is not None:
            if len(part) > 1 or not ref.startswith("#/"):
                raise ValueError(f"reference {part}")
            if ref not in self._refs:
                target = self.schema
                for name in ref[2:].split("/"):
                    target = target[name]
                self._node(target, ref)
            self.steps.append((node, key, self._refs[ref]))
        elif part is not True:
            self.steps.append((node, key, self._node(part)))

    def _node(self, part: Mapping, ref: str | None = None) -> int:
        node, self._nodes = self._nodes, self._nodes + 1
        if ref is not None:
            self._refs[ref] = node
        for word, value in part.items():
            if word == "type":
                self._rule(node, "type", args=[value] if isinstance(value, str) else list(value))
            elif word in ("enum", "const"):
                self._rule(node, word, args=[json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in (value if word == "enum" else [value])])
            elif word == "pattern" or word == "format" and value == "date":
                self._rule(node, word, arg=value)
            elif word in _LIMITS:
                self._rule(node, word, number=float(value))
            elif word == "required":
                for name in value:
                    self._rule(node, "required", arg=name)
            elif word == "properties":
                for name, child in value.items():
                    self._step(node, name, child)
            elif word == "items":
                self._step(node, "[]", value)
            elif word == "additionalProperties":
                if value is False:
                    self._rule(node, "additionalProperties", args=sorted(part.get("properties", {})))
                else:
                    self._step(node, "*", value)
            elif word == "oneOf" and all(set(way) <= {"required", "not"} and set(way.get("not", {})) <= {"required"} for way in value):
                self._rule(node, "oneOf", ways=[(list(way.get("required", [])), list(way.get("not", {}).get("required", []))) for way in value])
            elif word not in _SILENT:
                raise ValueError(f"keyword {word}: {value}")
        return node


def _broken(rule: Column, kind: Column, keys: Column) -> Column:
    """Whether a value `v` of a JSON type breaks its rule; null where the rule is not about such values."""
    text, number = F.try_variant_get("v", "$", "string"), F.try_variant_get("v", "$", "double")
    size = F.size(F.try_variant_get("v", "$", "array<variant>"))
    is_, arg, limit = lambda k: kind == k, F.col("arg"), F.col("number")
    whole = is_("integer") & F.array_contains("args", "number")
    holds = F.size(F.filter("ways", lambda w: F.forall(w["needs"], lambda n: F.array_contains(keys, n)) & ((F.size(w["bars"]) == 0) | ~F.forall(w["bars"], lambda n: F.array_contains(keys, n)))))
    cases = {
        "type": ~(F.array_contains("args", kind) | whole), "enum": ~F.array_contains("args", F.to_json("v")), "const": ~F.array_contains("args", F.to_json("v")),
        "pattern": is_("string") & ~F.rlike(text, arg), "format": is_("string") & ~(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()),
        "minLength": is_("string") & (F.char_length(text) < limit), "maxLength": is_("string") & (F.char_length(text) > limit), "minItems": is_("array") & (size < limit), "maxItems": is_("array") & (size > limit),
        "minimum": kind.isin("integer", "number") & (number < limit), "maximum": kind.isin("integer", "number") & (number > limit),
        "required": is_("object") & ~F.array_contains(keys, arg), "oneOf": is_("object") & (holds != 1),
    }
    return reduce(lambda out, x: out.when(rule == x[0], x[1]), list(cases.items())[1:], F.when(rule == "type", cases["type"]))


def _kind() -> Column:
    """The JSON type of a value; its schema, of all that is in it, is made once."""

    def named(found: Column) -> Column:
        number = F.try_variant_get("v", "$", "double")
        plain = F.when(found.startswith("OBJECT"), "object").when(found.startswith("ARRAY"), "array").when(found == "STRING", "string").when(found == "BOOLEAN", "boolean").when(found == "VOID", "null").when(found == "BIGINT", "integer")
        return plain.when(number == F.floor(number), "integer").otherwise("number")

    return F.get(F.transform(F.array(F.schema_of_variant("v")), named), F.lit(0))


def _typed(values: DataFrame) -> DataFrame:
    """(key, path, node, v, kind, members) of a level's values, as each is looked at for its rules and for what is in it."""
    kinds = values.select("key", "path", "node", "v", _kind().alias("kind"))
    names = F.when(F.col("kind") == "object", F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")))
    return kinds.withColumn("members", F.coalesce(names, F.array().cast("array<string>")))


def violations(documents: DataFrame, key: str, text: str, schema: Mapping) -> DataFrame:
    """(key, path, rule, detail) of each rule of the schema that a document breaks.

    path is `$` with `.name` and `[n]` from 0; a member that is not allowed has a row of its own.  A text that is null or
    not JSON has one row with rule `json`.  A schema with a keyword that is not compiled is refused: covered are type,
    enum, const, pattern, format date, lengths, item counts, bounds, required, properties, items, additionalProperties,
    references into the document, and oneOf over required members.
    """
    spark: SparkSession = documents.sparkSession
    made = Compiled(schema)
    # of the schema
    rules, steps = F.broadcast(spark.createDataFrame(made.rules, RULES)), spark.createDataFrame(made.steps, STEPS)
    exact, rest = (F.broadcast(steps.where(c)) for c in ("key <> '*'", "key = '*'"))
    known = F.broadcast(steps.where("key not in ('*', '[]')").groupBy("node").agg(F.collect_set("key").alias("known")))
    # texts are few bytes for the work that they are: without a number of parts by rows a level would be in few files, and the next one's work in few tasks
    texts = stored(documents.select(F.col(key).alias("key"), F.col(text).alias("text")), "texts")
    read = dealt(texts, "key", each=EACH).select("key", F.lit("$").alias("path"), F.lit(0).alias("node"), F.try_parse_json("text").alias("v"))
    level = stored(_typed(read), "level")
    found = [level.where("v is null").select("key", "path", F.lit("json").alias("rule"), F.lit("").alias("detail"))]
    level = level.where("v is not null")
    while not level.isEmpty():
        met = level.join(rules, "node")
        found.append(met.where(_broken(F.col("rule"), F.col("kind"), F.col("members"))).select("key", "path", "rule", F.coalesce("arg", F.array_join("args", ","), F.col("number").cast("string"), F.lit("")).alias("detail")))
        strange = met.where("rule = 'additionalProperties' and kind = 'object'").select("key", "path", "rule", F.explode(F.array_except("members", "args")).alias("detail"))
        found.append(strange.select("key", F.concat("path", F.lit("."), "detail").alias("path"), "rule", "detail"))
        inside = level.where("kind = 'object'").select("key", "path", "node", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "v")).withColumn("path", F.concat("path", F.lit("."), "name"))
        items = level.where("kind = 'array'").select("key", "path", "node", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("n", "v")).select("key", F.concat("path", F.lit("["), "n", F.lit("]")).alias("path"), "node", F.lit("[]").alias("name"), "v")
        own = inside.unionByName(items).join(exact.withColumnRenamed("key", "name"), ["node", "name"]).select("key", "path", F.col("child").alias("node"), "v")
        if any(name == "*" for _, name, _ in made.steps):
            own = own.unionByName(inside.join(known, "node", "left").where("known is null or not array_contains(known, name)").join(rest.drop("key"), "node").select("key", "path", F.col("child").alias("node"), "v"))
        level = stored(_typed(own), "level")
    return stored(reduce(DataFrame.unionByName, found), "violations").select(F.col("key").alias(key), "path", "rule", "detail")
