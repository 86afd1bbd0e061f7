"""Structural rules and contract checks; each gives violation rows (severity, rule, subject, detail, _file).

The contract is a plain document: id pattern, entity types with slugs, relation types with their ends, field lists,
enumerations.  It is read from the caller's own file and only its small lists reach expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import is_external
from weftgraph.operators import graph
from weftgraph.storage import stored


def _rows(df: DataFrame, severity: str, rule: str, subject: Column | str, detail: Column) -> DataFrame:
    file = F.col("_file") if "_file" in df.columns else F.lit(None).cast("string")
    subject = F.col(subject) if isinstance(subject, str) else subject
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"), file.alias("_file"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _among(column: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(column.isin(*allowed), F.lit(False)) if allowed else F.lit(False)


def duplicate_ids(entities: DataFrame, rule: str = "R001", id_: str = "id") -> DataFrame:
    window = Window.partitionBy(id_).orderBy("_ord")
    later = entities.withColumn("_nth", F.row_number().over(window)).where(f"_nth > 1 and {id_} is not null")
    return _rows(later, "error", rule, id_, F.lit("duplicate id"))


def malformed_ids(entities: DataFrame, contract: Mapping) -> DataFrame:
    slugs = F.create_map(*[F.lit(x) for name, spec in contract["entity_types"].items() for x in (name, spec["type_slug"])])
    pattern = contract["id_rules"]["pattern"]
    bad = F.when(~F.coalesce(F.col("id").rlike(pattern), F.lit(False)), F.lit("id does not match the pattern")).when(
        slugs[F.col("type")].isNotNull() & (F.split("id", r"\.")[1] != slugs[F.col("type")]), F.lit("id does not name the type")
    )
    return _rows(entities.withColumn("_bad", bad).where("_bad is not null"), "error", "R002", "id", F.col("_bad"))


def field_contract(keys: DataFrame, types: Sequence[str], required: Sequence[str], optional: Sequence[str], rule: str = "R003") -> DataFrame:
    """keys: (id, type, keys array, _file), the fields that each parsed row really had."""
    unknown = F.array_except("keys", F.array(*map(F.lit, [*required, *optional])))
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("keys"))
    return union(
        [
            _rows(keys.where(~_among(F.col("type"), types)), "error", rule, "id", F.concat(F.lit("unknown type "), F.coalesce("type", F.lit("?")))) if types else _rows(keys.limit(0), "error", rule, "id", F.lit("")),
            _rows(keys.withColumn("_f", F.explode(unknown)), "error", rule, "id", F.concat(F.lit("unknown field "), F.col("_f"))),
            _rows(keys.withColumn("_f", F.explode(missing)), "error", rule, "id", F.concat(F.lit("missing field "), F.col("_f"))),
        ]
    )


def dangling_refs(refs: DataFrame, entities: DataFrame, rule: str = "R004") -> DataFrame:
    """refs: (id, field, ref)."""
    lost = refs.where(~is_external(F.col("ref"))).join(entities.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti")
    return _rows(lost, "error", rule, "id", F.concat_ws(" ", F.col("field"), F.lit("->"), F.col("ref")))


def relation_ends(edges: DataFrame, entities: DataFrame, contract: Mapping) -> DataFrame:
    """R004 for missing ends and R005 for unknown relation types and wrong end types; an unknown type stops further checks of a row."""
    types = contract["relation_types"]
    known = _among(F.col("rel_type"), list(types))
    unknown = _rows(edges.where(~known), "error", "R005", F.concat_ws("|", "src", "rel_type", "dst"), F.lit("unknown relation type"))
    ends = entities.select("id", "type").dropDuplicates(["id"])
    joined = edges.where(known).join(ends.toDF("src", "_from"), "src", "left").join(ends.toDF("dst", "_to"), "dst", "left")
    parts = [unknown]
    for end, kind, side in (("src", "_from", "from"), ("dst", "_to", "to")):
        allowed = F.create_map(*[x for name, spec in types.items() for x in (F.lit(name), F.array(*map(F.lit, spec[side])))])
        inside = ~is_external(F.col(end))
        subject = F.concat_ws("|", "src", "rel_type", "dst")
        parts.append(_rows(joined.where(inside & F.col(kind).isNull()), "error", "R004", subject, F.concat(F.lit(f"{side} end is missing: "), F.coalesce(end, F.lit("?")))))
        parts.append(_rows(joined.where(inside & F.col(kind).isNotNull() & ~F.array_contains(allowed[F.col("rel_type")], F.col(kind))), "error", "R005", subject, F.concat(F.lit(f"{side} end may not be "), F.col(kind))))
    return union(parts)


def provenance(rows: DataFrame, contract: Mapping, id_: Column, rule: str = "R006") -> DataFrame:
    spec = contract["provenance_schema"]
    p = F.col("provenance")
    bad = F.array(
        F.when(p.isNull(), "no provenance"),
        F.when(p.isNotNull() & ~_among(p["source_type"], spec["source_type"]["allowed"]), "source_type"),
        F.when(p.isNotNull() & ~_among(p["confidence"], spec["confidence"]["allowed"]), "confidence"),
        F.when(p.isNotNull() & (F.coalesce(p["created_at"], F.lit("")) == ""), "created_at"),
        F.when((p["source_type"] == "web") & (F.coalesce(p["ref"], F.lit("")) == ""), "web source without ref"),
    )
    return _rows(rows.withColumn("_bad", F.explode(F.filter(bad, lambda b: b.isNotNull()))), "error", rule, id_, F.col("_bad"))


def edge_confidence(edges: DataFrame, contract: Mapping) -> DataFrame:
    bad = edges.where(F.col("confidence").isNotNull() & ~_among(F.col("confidence"), contract["provenance_schema"]["confidence"]["allowed"]))
    return _rows(bad, "error", "R006", F.concat_ws("|", "src", "rel_type", "dst"), F.concat(F.lit("confidence "), F.col("confidence")))


def domain_prefix(rows: DataFrame, rule: str = "R007", part: int = 0) -> DataFrame:
    return _rows(rows.where(F.col("domain").isNull() | (F.split("id", r"\.")[part] != F.col("domain"))), "error", rule, "id", F.concat(F.lit("domain "), F.coalesce("domain", F.lit("?"))))


def isolated(entities: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    return _rows(graph.orphans(entities, edges, refs), "warn", "R008", "id", F.lit("on no edge and in no field"))


def acyclic(edges: DataFrame, rel_type: str = "precedes") -> DataFrame:
    """R009: nodes on a cycle, each with a shortest cycle through the smallest node of its component."""
    edges = edges.where(F.col("rel_type") == rel_type)
    nodes = stored(graph.strong_components(edges), "components")
    paths = graph.witness_cycles(edges, nodes).select("component", F.array_join(F.transform("path", lambda n: n.cast("string")), " -> ").alias("_path"))
    return _rows(nodes.join(paths, "component"), "error", "R009", "node", F.concat(F.lit(f"on a cycle of {rel_type}: "), "_path"))


def route_steps(routes: DataFrame, edges: DataFrame, rel_type: str = "precedes") -> DataFrame:
    """R010: neighbouring steps (id, steps array) without an explicit edge."""
    steps = routes.select("id", F.posexplode("steps").alias("_pos", "_step"))
    pairs = graph.adjacent_pairs(steps, "id", ["_pos"], "_step")
    lost = pairs.join(edges.where(F.col("rel_type") == rel_type).select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return _rows(lost, "warn", "R010", "id", F.concat_ws(" -> ", "src", "dst"))


def vocabulary(entities: DataFrame, values: Column, allowed: Sequence[str], rule: str = "R011") -> DataFrame:
    rows = entities.withColumn("_value", F.explode(values))
    return _rows(rows.where(~_among(F.col("_value"), allowed)), "error", rule, "id", F.concat(F.lit("not in the vocabulary: "), F.coalesce("_value", F.lit("?"))))


def low_confidence(rows: DataFrame, most: float = 0.4) -> DataFrame:
    """R012: one warning where the share of low confidence is above `most`."""
    share = rows.agg(F.avg(F.when(F.col("provenance.confidence") == "low", 1.0).otherwise(0.0)).alias("share")).where(F.col("share") > most)
    return _rows(share, "warn", "R012", F.lit("all"), F.round("share", 4))


def case_contract(cases: DataFrame, keys: DataFrame, contract: Mapping) -> DataFrame:
    """R013: ids, domains, fields and provenance of cases."""
    spec = contract["kb_schema"]
    bad = cases.where(~F.coalesce(F.col("id").rlike(spec["id_pattern"]), F.lit(False)))
    return union(
        [
            duplicate_ids(cases, "R013"),
            _rows(bad, "error", "R013", "id", F.lit("id does not match the pattern")),
            domain_prefix(cases.where(F.col("id").rlike(spec["id_pattern"])), "R013", 1),
            field_contract(keys, [], spec["required_fields"], spec["optional_fields"], "R013"),
            provenance(cases, contract, F.col("id"), "R013"),
        ]
    )


def case_refs(cases: DataFrame) -> DataFrame:
    """(id, domain, label, ref, _file) of all references of cases."""
    each = F.flatten(
        F.array(
            F.array(F.struct(F.lit("anomaly_ref").alias("label"), F.col("anomaly_ref").alias("ref")), F.struct(F.lit("detected_at_ref").alias("label"), F.col("detected_at_ref").alias("ref"))),
            F.transform(F.coalesce("possible_causes", F.array()), lambda x: F.struct(F.lit("cause_ref").alias("label"), x["cause_ref"].alias("ref"))),
            F.transform(F.coalesce("detection", F.array()), lambda x: F.struct(F.lit("metric_ref").alias("label"), x["metric_ref"].alias("ref"))),
            F.transform(F.coalesce("actions", F.array()), lambda x: F.struct(F.lit("action_ref").alias("label"), x["action_ref"].alias("ref"))),
            F.transform(F.coalesce(F.col("impact.blocked_processes"), F.array().cast("array<string>")), lambda x: F.struct(F.lit("blocked_processes").alias("label"), x.alias("ref"))),
        )
    )
    return cases.select("id", "domain", "_file", F.explode(each).alias("r")).select("id", "domain", "_file", "r.label", "r.ref").where("ref is not null")


def case_ref_checks(refs: DataFrame, entities: DataFrame, expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """R014: references exist and have one of the types expected for their label; R015: they stay in their domain or core."""
    joined = refs.join(entities.select(F.col("id").alias("ref"), F.col("type").alias("_type"), F.col("domain").alias("_domain")).dropDuplicates(["ref"]), "ref", "left")
    allowed = F.create_map(*[x for label, types in expected.items() for x in (F.lit(label), F.array(*map(F.lit, types)))])
    inside = ~is_external(F.col("ref"))
    detail = F.concat_ws(" ", F.col("label"), F.lit("->"), F.col("ref"))
    wrong = F.col("_type").isNotNull() & allowed[F.col("label")].isNotNull() & ~F.array_contains(allowed[F.col("label")], F.col("_type"))
    return union(
        [
            _rows(joined.where(inside & F.col("_type").isNull()), "error", "R014", "id", F.concat(F.lit("missing "), detail)),
            _rows(joined.where(inside & wrong), "error", "R014", "id", F.concat(F.lit("wrong type "), detail)),
            _rows(joined.where(inside & ~F.col("_domain").isin("core") & (F.col("_domain") != F.col("domain"))), "error", "R015", "id", F.concat(F.lit("foreign domain "), detail)),
        ]
    )


def question_support(questions: DataFrame, entities: DataFrame, edges: DataFrame, contract: Mapping) -> DataFrame:
    """R016: questions (id, bucket, text, entity_types array, relations array, reason) rest on declared types that have instances."""
    inside = questions.where("bucket = 'in_scope'")
    types = inside.select("id", F.explode("entity_types").alias("_need"))
    relations = inside.select("id", F.explode("relations").alias("_need"))
    live_types, live_relations = entities.select(F.col("type").alias("_need")).distinct(), edges.select(F.col("rel_type").alias("_need")).distinct()
    return union(
        [
            _rows(questions.where("text is null or text = ''"), "error", "R016", "id", F.lit("no text")),
            _rows(questions.where("bucket = 'out_of_scope' and (reason is null or reason = '')"), "error", "R016", "id", F.lit("no reason")),
            _rows(types.where(~_among(F.col("_need"), list(contract["entity_types"]))), "error", "R016", "id", F.concat(F.lit("undeclared type "), F.col("_need"))),
            _rows(relations.where(~_among(F.col("_need"), list(contract["relation_types"]))), "error", "R016", "id", F.concat(F.lit("undeclared relation "), F.col("_need"))),
            _rows(types.join(live_types, "_need", "left_anti"), "error", "R016", "id", F.concat(F.lit("no instance of "), F.col("_need"))),
            _rows(relations.join(live_relations, "_need", "left_anti"), "error", "R016", "id", F.concat(F.lit("no edge of "), F.col("_need"))),
        ]
    )


def likelihoods(edges: DataFrame, contract: Mapping) -> DataFrame:
    spec = contract["likelihood_schema"]
    has = F.col("likelihood").isNotNull()
    subject = F.concat_ws("|", "src", "rel_type", "dst")
    return union(
        [
            _rows(edges.where(has & ~_among(F.col("likelihood"), spec["allowed"])), "error", "R017", subject, F.concat(F.lit("likelihood "), F.col("likelihood"))),
            _rows(edges.where(has & ~_among(F.col("rel_type"), spec["applies_to"])), "error", "R017", subject, F.lit("this relation has no likelihood")),
        ]
    )


def structure(entities: DataFrame, edges: DataFrame, derived: DataFrame, entity_keys: DataFrame, contract: Mapping, ref_fields: Sequence[str]) -> DataFrame:
    """R001 to R012 and R017 together."""
    refs = graph.entity_refs(entities, ref_fields)
    first = entities.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy("_ord"))).where("_nth = 1").drop("_nth")
    every = graph.all_edges(edges, derived)
    return union(
        [
            duplicate_ids(entities),
            malformed_ids(first, contract),
            field_contract(entity_keys, list(contract["entity_types"]), contract["entity_required_fields"], contract["entity_optional_fields"]),
            dangling_refs(refs, first),
            relation_ends(every, first, contract),
            provenance(first, contract, F.col("id")),
            edge_confidence(edges, contract),
            domain_prefix(first),
            isolated(first, every, refs),
            acyclic(edges),
            route_steps(first.where("type = 'Route' and steps is not null"), edges),
            vocabulary(first, F.col("economic_hooks.affects"), contract["economic_hooks_schema"]["affects"]["allowed"]),
            low_confidence(first),
            likelihoods(edges, contract),
        ]
    )


def grown(before: Mapping[str, int], after: Mapping[str, int]) -> list[str]:
    """Names whose counts fell; a change may only add."""
    return sorted(k for k, n in before.items() if after.get(k, 0) < n)


def shrunk(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """(by, before, after): values of a column that fewer rows have after a change than before it; null counts as a value."""
    counts = before.groupBy(by).agg(F.count("*").alias("before")), after.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("after"))
    met = counts[0].join(counts[1], F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "before", F.coalesce("after", F.lit(0)).alias("after"))
    return met.where("after < before")


def delivery_manifest(files: DataFrame, digests: DataFrame, headers: DataFrame, classes: DataFrame, formats: Sequence[str], classifications: Sequence[str] = ("internal", "internal_confidential", "restricted")) -> DataFrame:
    """(path, problem) of delivered files.

    files: (path, format, sha256, target_class, entity_keys array, classification); digests: (path, sha256) of the files
    that exist; headers: (path, columns array); classes: (class) declared.
    """
    have, columns = digests.select("path", F.col("sha256").alias("_real")), headers.select("path", F.col("columns").alias("_columns"))
    known = classes.select(F.col("class").alias("target_class")).distinct().withColumn("_known", F.lit(True))
    joined = files.join(have, "path", "left").join(columns, "path", "left").join(known, "target_class", "left")
    outside = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    problems = F.array(
        F.when(F.col("path").isNull() | F.col("format").isNull() | F.col("sha256").isNull() | F.col("target_class").isNull(), "missing field"),
        F.when(F.col("format").isNotNull() & ~_among(F.col("format"), formats), "format"),
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "sha256 is not 64 hex digits"),
        F.when(outside, "path leaves the delivery"),
        F.when(F.col("_real").isNull(), "no such file"),
        F.when(F.lower("_real") != F.lower("sha256"), "sha256 differs"),
        F.when(F.size(F.array_except(F.coalesce("entity_keys", F.array().cast("array<string>")), F.coalesce("_columns", F.array().cast("array<string>")))) > 0, "key is not a column"),
        F.when(F.col("target_class").isNotNull() & F.col("_known").isNull(), "class is not declared"),
        F.when(F.col("classification").isNotNull() & ~_among(F.col("classification"), classifications), "classification"),
        F.when(F.col("classification") == "restricted", "restricted data are refused"),
    )
    return joined.select("path", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def reference_kinds(changes: DataFrame, declared: DataFrame) -> DataFrame:
    """(section, id, problem) of changeset references that no declaration meets.

    changes: (section, id, kind, ref), e.g. kind `class`, `property`, `individual`; declared: (kind, ref).
    """
    lost = changes.where("ref is not null").join(declared.select("kind", "ref").distinct(), ["kind", "ref"], "left_anti")
    return lost.select("section", "id", F.concat_ws(" ", F.lit("undeclared"), "kind", "ref").alias("problem"))


def capability_levels(questions: DataFrame, terms: DataFrame, least_domains: int = 11) -> DataFrame:
    """(id, problem): declared terms, unique first-level ids, second-level questions made of existing ones, enough domains.

    questions: (id, level, domain, classes array, relations array, composes array); terms: (kind, ref).
    """
    need = questions.select("id", F.lit("class").alias("kind"), F.explode("classes").alias("ref")).union(questions.select("id", F.lit("relation"), F.explode("relations")))
    lost = need.join(terms.distinct(), ["kind", "ref"], "left_anti").select("id", F.concat_ws(" ", F.lit("undeclared"), "kind", "ref").alias("problem"))
    twice = questions.where("level = 1").groupBy("id").count().where("count > 1").select("id", F.lit("id is not unique").alias("problem"))
    parts = questions.where("level = 2").select("id", F.explode("composes").alias("part")).join(questions.where("level = 1").select(F.col("id").alias("part")).distinct(), "part", "left_anti")
    few = questions.agg(F.countDistinct("domain").alias("n")).where(F.col("n") < least_domains).select(F.lit("all").alias("id"), F.concat(F.lit("domains: "), F.col("n")).alias("problem"))
    return union([lost, twice, parts.select("id", F.concat(F.lit("unknown part "), F.col("part")).alias("problem")), few])


def case_edges(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, src, rel_type, dst): cause and action pairs of cases that the graph has no edge for."""
    causes = cases.select("id", F.explode("possible_causes.cause_ref").alias("src"), F.lit("may_cause").alias("rel_type"), F.col("anomaly_ref").alias("dst"))
    actions = cases.select("id", F.col("anomaly_ref").alias("src"), F.lit("mitigated_by").alias("rel_type"), F.explode("actions.action_ref").alias("dst"))
    return causes.unionByName(actions).join(edges.select("src", "rel_type", "dst").distinct(), ["src", "rel_type", "dst"], "left_anti").select("id", "src", "rel_type", "dst")
