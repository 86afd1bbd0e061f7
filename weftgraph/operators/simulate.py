"""What-if simulation: templates, datasets and models as documents and tables, all scenarios of a model in one plan.

Templates are small documents that are resolved on the driver; values, interventions and scenarios are tables of any
size.  Each row of the wide table is one (model, scenario), and every calculation is a column expression over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.formula import FormulaError, compiled, execute, names
from weftgraph.functions.text import compatible_unit

# Kinds of sources, those that need a reference, and those that count as observed.
SOURCES = ("observed", "internal_feature", "vfab", "web", "industry_prior", "assumption", "model_prior", "human")
WITH_REF = ("observed", "internal_feature", "vfab", "web")
OBSERVED = ("observed", "internal_feature", "vfab")


class ModelError(ValueError):
    """A template or model that cannot be resolved."""


def merged(base: Sequence[Mapping], extra: Sequence[Mapping]) -> list[dict]:
    """Items of both by id: a known id keeps its place and content unless the later item says override."""
    out = {item["id"]: dict(item) for item in base}
    for item in extra:
        if item["id"] not in out or item.get("override"):
            out[item["id"]] = dict(item)
    return list(out.values())


def resolved(ref: str, templates: Mapping[str, Mapping], trail: tuple[str, ...] = ()) -> dict[str, list[dict]]:
    """A template's variables and calculations with those it extends, parents in order first."""
    if ref in trail:
        raise ModelError("template cycle: " + " -> ".join((*trail, ref)))
    own, out = templates[ref], {"variables": [], "calculations": []}
    for part in (*(resolved(parent, templates, (*trail, ref)) for parent in own.get("extends") or ()), own):
        out = {kind: merged(out[kind], part.get(kind) or ()) for kind in out}
    return out


def model_inputs(variables: DataFrame, dataset: DataFrame, overrides: DataFrame) -> DataFrame:
    """(model, id, value, unit, declared_unit, source, source_ref, ontology_ref): values of each model.

    variables: (model, id, unit, required); dataset and overrides: (model, id, value, unit, source, source_ref,
    ontology_ref).  A model's own value goes before the dataset's; a missing unit is that of the template; values that
    the template doesn't know stay.
    """
    own = overrides.withColumn("_rank", F.lit(0)).unionByName(dataset.withColumn("_rank", F.lit(1)))
    supplied = own.groupBy("model", "id").agg(F.min_by(F.struct("value", "unit", "source", "source_ref", "ontology_ref"), "_rank").alias("v")).select("model", "id", "v.*")
    declared = variables.select("model", "id", F.col("unit").alias("declared_unit"))
    out = supplied.join(declared, ["model", "id"], "left")
    return out.select("model", "id", "value", F.coalesce("unit", "declared_unit").alias("unit"), "declared_unit", "source", "source_ref", "ontology_ref")


def missing_inputs(variables: DataFrame, inputs: DataFrame, calculated: Sequence[str]) -> DataFrame:
    """(model, id) of required variables that nothing supplies or calculates."""
    need = variables.where(F.coalesce("required", F.lit(True)) & ~F.col("id").isin(*calculated)) if calculated else variables.where(F.coalesce("required", F.lit(True)))
    return need.select("model", "id").join(inputs.select("model", "id"), ["model", "id"], "left_anti")


def input_problems(inputs: DataFrame, known: DataFrame) -> DataFrame:
    """(model, id, problem) of units, ranges, sources and references; known: (ontology_ref)."""
    value = F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    twice = inputs.groupBy("model", "id").count().where("count > 1").select("model", "id", F.lit("duplicate id").alias("problem"))
    joined = inputs.join(known.select("ontology_ref").distinct().withColumn("_known", F.lit(True)), "ontology_ref", "left")
    checks = F.array(
        F.when(F.col("unit").isNull() | F.col("source").isNull(), "missing field"),
        F.when(~F.col("source").isin(*SOURCES), "source"),
        F.when(F.col("declared_unit").isNotNull() & ~compatible_unit(F.col("declared_unit"), F.col("unit")), "unit differs from the template"),
        F.when(~finite, "not a finite number"),
        F.when((F.col("unit") == "ratio") & ((value < 0) | (value > 1)), "ratio out of range"),
        F.when((F.col("unit") != "ratio") & (value < 0), "negative"),
        F.when(F.col("source").isin(*WITH_REF) & (F.coalesce("source_ref", F.lit("")) == ""), "source without reference"),
        F.when(F.col("ontology_ref").isNotNull() & F.col("_known").isNull(), "unknown reference"),
    )
    return joined.select("model", "id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("problem")).unionByName(twice)


def calculation_problems(calculations: Sequence[Mapping], inputs: Sequence[str], outputs: Sequence[str], known_algorithms: Sequence[str]) -> list[str]:
    out, seen = [], set(inputs)
    for item in calculations:
        if "id" not in item or "unit" not in item:
            out.append(f"missing field: {dict(item)}")
            continue
        if item["id"] in seen and not item.get("override"):
            out.append(f"duplicate id: {item['id']}")
        if not item.get("algorithm") and not item.get("formula"):
            out.append(f"nothing to compute: {item['id']}")
        if item.get("algorithm") and item["algorithm"] not in known_algorithms:
            out.append(f"unknown algorithm: {item['algorithm']}")
        seen.add(item["id"])
    out += [f"{item.get('id')} needs {x}" for item in calculations for x in item.get("inputs") or () if x not in seen]
    return out + [f"no such output: {x}" for x in outputs if x not in seen]


def ordered(calculations: Sequence[Mapping], inputs: Sequence[str]) -> list[Mapping]:
    """Calculations so that each comes after what it needs."""
    have, rest, out = set(inputs), list(calculations), []
    while rest:
        ready = [c for c in rest if set(c.get("inputs") or ()) | (set() if c.get("algorithm") else names(c["formula"])) <= have]
        if not ready:
            raise ModelError("calculations that wait for each other: " + ", ".join(c["id"] for c in rest))
        out += ready
        have |= {c["id"] for c in ready}
        rest = [c for c in rest if c not in ready]
    return out


def evaluated(values: Mapping[str, Column], calculations: Sequence[Mapping]) -> tuple[dict[str, Column], Column]:
    """(a column for each name, an array of errors) of the calculations over input columns."""
    out, errors = dict(values), []
    for item in ordered(calculations, list(values)):
        try:
            column = execute(item["algorithm"], [out[x] for x in item["inputs"]], item.get("params")) if item.get("algorithm") else compiled(item["formula"], out)
        except FormulaError as error:
            raise ModelError(f"{item['id']}: {error}") from error
        bad = column.isNull() | F.isnan(column) | (F.abs(column) == float("inf"))
        errors.append(F.when(bad, F.lit(f"{item['id']} is not finite")))
        if item["unit"] == "ratio":
            errors.append(F.when((column < -1e-12) | (column > 1 + 1e-12), F.lit(f"{item['id']} is not a ratio")))
        out[item["id"]] = column
    return out, F.filter(F.array(*errors, F.lit(None).cast("string")), lambda e: e.isNotNull())


def run(inputs: DataFrame, calculations: Sequence[Mapping], outputs: Sequence[str], scenarios: DataFrame, interventions: DataFrame, investments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, summary) of every scenario over its model.

    inputs: (model, id, value, unit, source); scenarios: (scenario, model); interventions: (scenario, variable,
    operation, value, ord); investments: (scenario, one_time).
    results: (scenario, variable, baseline, changed, delta), rounded to six places.  summary: (scenario, model,
    payback_periods, evidence_grade, errors).  errors lists what makes a scenario invalid: names that are not inputs or
    come twice, unknown operations, values out of range, results that are not finite or not ratios.
    """
    ids = sorted(r["id"] for r in inputs.select("id").distinct().collect())  # the names of one model's inputs
    wide = inputs.groupBy("model").pivot("id", ids).agg(F.first("value"))
    units = inputs.groupBy("model").pivot("id", ids).agg(F.first("unit"))
    units = units.select("model", *[F.col(f"`{i}`").alias(f"_unit_{i}") for i in ids])
    kinds = F.collect_set("source")
    sources = inputs.groupBy("model").agg(kinds.alias("_sources"))
    ops = interventions.groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("ord", "variable", "operation", F.col("value").cast("double").alias("value")))).alias("_ops"))
    rows = scenarios.join(wide, "model").join(units, "model").join(sources, "model").join(ops, "scenario", "left")
    none = F.from_json(F.lit("[]"), ops.schema["_ops"].dataType)
    rows = rows.withColumn("_ops", F.coalesce("_ops", none))
    base = {i: F.col(f"`{i}`").cast("double") for i in ids}

    def applied(name: str) -> Column:
        def one(value: Column, op: Column) -> Column:
            return F.when(op["operation"] == "set", op["value"]).when(op["operation"] == "add", value + op["value"]).when(op["operation"] == "multiply", value * op["value"]).otherwise(value)

        return F.aggregate(F.filter("_ops", lambda o: o["variable"] == name), base[name], one)

    rows = rows.select("*", *[applied(i).alias(f"_new_{i}") for i in ids])
    changed = {i: F.col(f"`_new_{i}`") for i in ids}
    before, errors = evaluated(base, calculations)
    after, more = evaluated(changed, calculations)
    named = F.transform("_ops", lambda o: o["variable"])
    problems = [
        F.when(F.exists("_ops", lambda o: ~F.coalesce(o["operation"].isin("set", "add", "multiply"), F.lit(False))), F.lit("unknown operation")),
        F.when(F.size(F.array_except(named, F.array(*map(F.lit, ids)))) > 0, F.lit("not an input")),
        F.when(F.size(named) != F.size(F.array_distinct(named)), F.lit("variable changed twice")),
    ]
    for i in ids:
        unit, value = F.col(f"`_unit_{i}`"), changed[i]
        problems.append(F.when((unit == "ratio") & ((value < 0) | (value > 1)), F.lit(f"{i} out of range")))
        problems.append(F.when((unit != "ratio") & (value < 0), F.lit(f"{i} is negative")))
    errors = F.array_distinct(F.concat(F.filter(F.array(*problems), lambda e: e.isNotNull()), errors, more))
    pairs = F.array(*[F.struct(F.lit(o).alias("variable"), F.round(before[o], 6).alias("baseline"), F.round(after[o], 6).alias("changed")) for o in outputs])
    rows = rows.select("scenario", "model", "_sources", pairs.alias("_pairs"), errors.alias("errors"))
    results = rows.select("scenario", F.explode("_pairs").alias("p")).select("scenario", "p.*", F.round(F.col("p.changed") - F.col("p.baseline"), 6).alias("delta"))
    gains = results.where("variable = 'profit'").select("scenario", F.col("delta").alias("_gain"))
    seen = F.col("_sources")
    hits = F.size(F.array_intersect(seen, F.array(*map(F.lit, OBSERVED))))
    grade = F.when((F.size(seen) > 0) & (hits == F.size(seen)), "observed").when(hits > 0, "mixed").otherwise("assumption_only")
    spent = (investments if investments is not None else scenarios.select("scenario", F.lit(0.0).alias("one_time"))).select("scenario", F.col("one_time").cast("double").alias("_spent"))
    summary = rows.join(gains, "scenario", "left").join(spent, "scenario", "left")
    payback = F.when((F.col("_spent") > 0) & (F.col("_gain") > 0), F.round(F.col("_spent") / F.col("_gain"), 6))
    return results, summary.select("scenario", "model", payback.alias("payback_periods"), grade.alias("evidence_grade"), "errors")


def sweep(models: DataFrame, problems: DataFrame, scenarios: DataFrame, summary: DataFrame, violations: DataFrame) -> DataFrame:
    """(item, issue) of all models and scenarios at once.

    models: (model); problems: (model, id, problem) of input_problems() and missing_inputs(); scenarios, summary and
    violations as run() and assertion_violations() take and give them.  A scenario of an unknown model, or of one with
    problems, is an issue itself.
    """
    of_models = problems.select(F.col("model").alias("item"), F.concat_ws(": ", "id", "problem").alias("issue"))
    sound = models.select("model").join(problems.select("model"), "model", "left_anti")
    lost = scenarios.join(sound, "model", "left_anti").select(F.col("scenario").alias("item"), F.concat(F.lit("no such model: "), F.col("model")).alias("issue"))
    tried = scenarios.join(sound, "model", "left_semi").select("scenario")
    errors = summary.join(tried, "scenario", "left_semi").select(F.col("scenario").alias("item"), F.explode("errors").alias("issue"))
    broken = violations.join(tried, "scenario", "left_semi").select(F.col("scenario").alias("item"), F.concat_ws(" ", "variable", "problem").alias("issue"))
    return of_models.unionByName(lost).unionByName(errors).unionByName(broken).distinct()


def assertion_violations(results: DataFrame, assertions: DataFrame) -> DataFrame:
    """(scenario, variable, type, problem) of assertions (scenario, variable, type) that the results break."""
    joined = assertions.join(results, ["scenario", "variable"], "left")
    problem = (
        F.when(F.col("baseline").isNull(), "not an output")
        .when(~F.col("type").isin("nondecreasing", "nonincreasing", "unchanged"), "unknown assertion")
        .when((F.col("type") == "nondecreasing") & (F.col("changed") < F.col("baseline")), "fell")
        .when((F.col("type") == "nonincreasing") & (F.col("changed") > F.col("baseline")), "rose")
        .when((F.col("type") == "unchanged") & (F.col("changed") != F.col("baseline")), "moved")
    )
    return joined.withColumn("problem", problem).where("problem is not null").select("scenario", "variable", "type", "problem")


def scenario_cards(cases: DataFrame, entities: DataFrame, affects: DataFrame, models: DataFrame) -> DataFrame:
    """(id, title, anomaly, anomaly_name, blocked, affects, model, readiness), a card for each case.

    affects: (id, affects array) of entities; models: (domain, model), the model a domain is computed with.  readiness
    is ready with a model and affected variables, partial with one of them, else missing.
    """
    titles = entities.select(F.col("id").alias("anomaly_ref"), F.coalesce("name_zh", "name_en").alias("anomaly_name")).dropDuplicates(["anomaly_ref"])
    hooks = affects.select(F.col("id").alias("anomaly_ref"), "affects").dropDuplicates(["anomaly_ref"])
    rows = cases.join(titles, "anomaly_ref", "left").join(hooks, "anomaly_ref", "left").join(models.select("domain", "model").dropDuplicates(["domain"]), "domain", "left")
    has_model, has_hooks = F.col("model").isNotNull(), F.size(F.coalesce("affects", F.array().cast("array<string>"))) > 0
    readiness = F.when(has_model & has_hooks, "ready").when(has_model | has_hooks, "partial").otherwise("missing")
    return rows.select("id", "title", F.col("anomaly_ref").alias("anomaly"), "anomaly_name", F.coalesce(F.col("impact.blocked_processes"), F.array().cast("array<string>")).alias("blocked"), F.coalesce("affects", F.array().cast("array<string>")).alias("affects"), "model", readiness.alias("readiness"))
