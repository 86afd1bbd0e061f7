"""Candidates of a round: what may be taken over, how it is mapped, what has to be repaired, and where the next round goes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.matching import hits
from weftgraph.operators.predicates import focus_nodes
from weftgraph.operators.windows import even_sample, first_per_key
from weftgraph.storage import dealt, stored

#: Triples in a part where those of a subject meet.
EACH = 200_000
#: Rows that meet others at once, blocks of them that a part has, and pairs that a part has about.
BLOCK, CELLS, PAIRS = 1024, 4, 50_000_000
# Parts of local names that mark a type as one of governance.
GOVERNANCE = [
    "SHACL", "Shape", "OntologyValidation", "OntologyIntegrity", "ValidationFinding", "ValidationResult", "ValidationRun", "ValidationReport", "ValidationProfile", "ValidationSuite", "ValidationCheck", "Constraint",
    "ReleaseGate", "ReleaseReadiness", "CoverageGate", "CoverageMetric", "FeatureMappingGap", "FeatureMappingCoverage", "FeatureMappingBacklog", "MetricGroup", "Golden", "ReasoningConsistency", "AsymmetricRelation",
    "MissingInverse", "InverseAsymmetry", "EvidenceCompleteness", "EvidenceCoverage", "Scorecard", "ScoreCardRecord", "Backlog", "IncompletenessFinding", "UncoveredAnomaly",
]
# Statuses of a finished round, and gates in the order in which they are named.
FINISHED = ["completed", "completed_partial", "completed_no_change"]
GATES = ["source_alignment", "business_simulation", "semantic_precheck", "full_publish_gate"]
# Operations of an intervention and kinds of an assertion.
OPERATIONS, ASSERTIONS = ["set", "add", "multiply"], ["nondecreasing", "nonincreasing", "unchanged"]
# Words of an error and the kind of output that they are about, the first that occurs.
REPAIRS = [
    ("仿真", "simulation_files"), ("经营", "business_files"), ("规则", "rule_files"), ("知识", "knowledge_files"), ("knowledge", "knowledge_files"), ("rule", "rule_files"), ("simulation", "simulation_files"), ("business", "business_files"),
    ("diagnostic", "semantic_files"), ("possiblecause", "semantic_files"), ("possible cause", "semantic_files"), ("shacl", "semantic_files"), ("owl", "semantic_files"),
]


def is_governance(type_: Column) -> Column:
    """Whether the part of a type after its last `:`, `#` or `/` has one of the names of governance."""
    local = F.regexp_extract(type_, r"[^:#/]*$", 0)
    return F.exists(F.array(*map(F.lit, GOVERNANCE)), lambda word: local.contains(word))


def governance_subjects(types: DataFrame, domains: DataFrame) -> DataFrame:
    """(subject) of (subject, type) rows all of whose types are of governance and none of which a domain module (type) has."""
    held = types.join(domains.select("type").distinct().withColumn("_domain", F.lit(True)), "type", "left")
    marks = held.groupBy("subject").agg(F.min(is_governance(F.col("type"))).alias("every"), F.max(F.coalesce("_domain", F.lit(False))).alias("some"))
    return marks.where("every and not some").select("subject")


def as_list(document: Column, field: str) -> tuple[Column, Column]:
    """(array of texts, whether a single value was wrapped) of a field of JSON text; a missing or null field is an empty array."""
    value = F.get_json_object(document, f"$.{field}")
    listed = value.startswith("[")
    texts = F.when(value.isNull(), F.array().cast("array<string>")).when(listed, F.from_json(value, "array<string>")).otherwise(F.array(value))
    return texts, value.isNotNull() & ~listed


def business_candidates(candidates: DataFrame, approved: DataFrame) -> DataFrame:
    """(id, outputs, reason): candidates (id, template_ref, dataset_ref, outputs) held against approved models of the same columns and `ord`.

    template and dataset have to be an approved pair (the last model of a pair counts), and only its outputs stay; reason
    is null for what is kept.
    """
    pairs = first_per_key(approved, ["template_ref", "dataset_ref"], [F.desc("ord")]).select("template_ref", "dataset_ref", F.col("outputs").alias("_approved"))
    joined = candidates.join(pairs, ["template_ref", "dataset_ref"], "left")
    none = F.array().cast("array<string>")
    outputs = F.when(F.col("_approved").isNull(), none).otherwise(F.filter(F.coalesce("outputs", none), lambda o: F.array_contains(F.col("_approved"), o)))
    reason = F.when(F.col("_approved").isNull(), "pair").when(F.size("outputs") == 0, "outputs")
    return joined.select("id", "_approved", outputs.alias("outputs")).select("id", "outputs", reason.alias("reason"))


def simulation_policies(approved: DataFrame) -> DataFrame:
    """(model_ref, inputs, targets, watched) of approved scenarios (model_ref, interventions, assertions)."""
    names = {"inputs": "interventions.variable", "targets": "interventions.target_ref", "watched": "assertions.variable"}
    return approved.groupBy("model_ref").agg(*[F.array_compact(F.array_distinct(F.flatten(F.collect_list(c)))).alias(n) for n, c in names.items()])


def simulation_candidates(candidates: DataFrame, policies: DataFrame) -> DataFrame:
    """(id, interventions, assertions, reason): scenarios (id, model_ref, interventions, assertions) less what no approved scenario of the model has.

    An intervention needs a known operation, a number, and an approved variable and target; an assertion a known kind and
    an approved variable.  A scenario without interventions left isn't kept, nor is one of an unknown model.
    """
    joined = candidates.join(policies, "model_ref", "left")

    def good(i: Column) -> Column:
        return i["operation"].isin(*OPERATIONS) & i["value"].isNotNull() & F.array_contains("inputs", i["variable"]) & F.array_contains("targets", i["target_ref"])

    kept = joined.select(
        "id", F.col("inputs").isNull().alias("_unknown"),
        F.filter("interventions", lambda i: F.coalesce(good(i), F.lit(False))).alias("interventions"),
        F.filter("assertions", lambda a: F.coalesce(a["type"].isin(*ASSERTIONS) & F.array_contains("watched", a["variable"]), F.lit(False))).alias("assertions"),
    )
    reason = F.when(F.col("_unknown"), "model").when(F.size("interventions") == 0, "interventions")
    return kept.select("id", "interventions", "assertions", reason.alias("reason"))


def compacted(summary: Column, pains: Column, iris: Column, most: int = 500) -> list[Column]:
    """What the next round is told of the one before: the summary's beginning, the first pains, the first distinct IRIs in order."""
    short = F.transform(F.slice(pains, 1, 12), lambda p: F.substring(p, 1, 500))
    named = F.slice(F.array_sort(F.array_distinct(F.filter(F.flatten(iris), lambda i: i.isNotNull() & (i != "")))), 1, most)
    return [F.substring(F.coalesce(summary, F.lit("")), 1, 1000).alias("summary"), short.alias("pains"), named.alias("proposed_iris")]


def edited_mapping(files: DataFrame, edits: DataFrame, classes: DataFrame) -> DataFrame:
    """files (stored_name, headers, target_class, entity_keys, time_field) with edits of the same names laid over them.

    Null fields of an edit change nothing.  Keys and time field stay only if they are headers; target_class_valid says
    whether the class (iri) is declared.  Edits of unknown files are left out.
    """
    new = edits.select("stored_name", *[F.col(c).alias(f"_{c}") for c in ("target_class", "entity_keys", "time_field")])
    known = classes.select(F.col("iri").alias("target_class")).distinct().withColumn("_declared", F.lit(True))
    joined = files.drop("target_class_valid").join(new, "stored_name", "left")
    keys = F.filter("_entity_keys", lambda k: F.array_contains("headers", k))
    time = F.when(F.array_contains("headers", F.col("_time_field")), F.col("_time_field"))
    joined = joined.withColumns({
        "target_class": F.coalesce("_target_class", "target_class"),
        "entity_keys": F.when(F.col("_entity_keys").isNotNull(), keys).otherwise(F.col("entity_keys")),
        "time_field": F.when(F.col("_time_field").isNotNull(), time).otherwise(F.col("time_field")),
    }).drop("_target_class", "_entity_keys", "_time_field")
    return joined.join(known, "target_class", "left").withColumn("target_class_valid", F.coalesce("_declared", F.lit(False))).drop("_declared")


def adoptable(files: DataFrame) -> DataFrame:
    """Files with a declared class."""
    return files.where((F.coalesce("target_class", F.lit("")) != "") & F.coalesce("target_class_valid", F.lit(False)))


def adopted(job: str, files: DataFrame, live: DataFrame) -> DataFrame:
    """(path, stored_name, state) of a job's adoptable files: `new`, or `taken` where live (path) has the path; one taken path forbids the whole job."""
    rows = adoptable(files).select(F.concat(F.lit(f"raw/{job}__"), "stored_name").alias("path"), "stored_name")
    there = live.select("path").distinct().withColumn("_there", F.lit(True))
    return rows.join(there, "path", "left").select("path", "stored_name", F.when(F.col("_there"), "taken").otherwise("new").alias("state"))


def item_key(section: Column, item: Column) -> Column:
    """Where a verdict finds an item: its ends and type for a relation, else its id or title."""
    triple = F.concat_ws("|", item["from"], item["type"], item["to"])
    return F.when(section == "relations", triple).otherwise(F.coalesce(F.nullif(item["id"], F.lit("")), F.nullif(item["title"], F.lit("")), F.lit("")))


def with_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """items (key) with the verdict of their key, `gated` where there is none; the last row (ord) of a key counts."""
    last = first_per_key(verdicts.where("key is not null and key <> ''"), ["key"], [F.desc("ord")]).select("key", "verdict")
    return items.join(last, "key", "left").withColumn("verdict", F.coalesce("verdict", F.lit("gated")))


def provenance_error(source_type: Column, source_ref: Column, delivered: Column, exists: Column) -> Column:
    """What is wrong with a source: web sources need a URL, plant sources a delivery, internal ones a file inside the project."""
    path = F.split(source_ref, "#", 2)[0]
    outside = path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    return (
        F.when((source_type == "web") & ~source_ref.rlike("^https?://"), "not a URL")
        .when((source_type == "vfab") & ~delivered, "not delivered")
        .when(source_type.isin("internal_feature", "vfab") & outside, "outside the project")
        .when(source_type.isin("internal_feature", "vfab") & ~exists, "no such file")
    )


def focus_valid(*shares: Column) -> Column:
    """Whether the shares are 0 to 100 each and 100 together."""
    good, total = F.lit(True), F.lit(0)
    for share in shares:
        good, total = good & share.between(0, 100), total + share
    return F.coalesce(good & (total == 100), F.lit(False))


def artifact_counts(models: DataFrame, scenarios: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: models, their outputs together, scenarios, and entries with an id and content."""
    one = models.agg(F.count("*").alias("business_models"), F.coalesce(F.sum(F.coalesce(F.size("outputs"), F.lit(0))), F.lit(0)).alias("business_relations"))
    filled = entries.where("coalesce(id, '') <> '' and coalesce(content, '') <> ''").agg(F.count("*").alias("knowledge_entries"))
    return one.join(scenarios.agg(F.count("*").alias("simulation_scenarios")), F.lit(True)).join(filled, F.lit(True))


def run_rounds(runs: DataFrame, rounds: DataFrame) -> DataFrame:
    """(run_id, current_round, rounds_completed) of every run (run_id); rounds: (run_id, round_number, status)."""
    counted = rounds.groupBy("run_id").agg(F.max("round_number").alias("current_round"), F.count(F.when(F.col("status").isin(*FINISHED), 1)).alias("rounds_completed"))
    return runs.select("run_id").join(counted, "run_id", "left").na.fill(0, ["current_round", "rounds_completed"])


def evidence_total(outputs: DataFrame, key: str) -> DataFrame:
    """(key, evidence_pages): the sum of evidence_count over a round's outputs, missing counts as 0."""
    return outputs.groupBy(key).agg(F.sum(F.coalesce("evidence_count", F.lit(0))).alias("evidence_pages"))


def next_direction(rounds: DataFrame) -> DataFrame:
    """(round, focus_themes, unpassed_gates, grew): the first three themes, the gates that were looked at and not passed, and the positive deltas.

    rounds: (round, themes array, checks map to boolean, delta map to number).
    """
    open_ = F.filter(F.array(*map(F.lit, GATES)), lambda g: F.array_contains(F.map_keys("checks"), g) & ~F.coalesce(F.try_element_at("checks", g), F.lit(False)))
    themes = F.slice(F.coalesce("themes", F.array().cast("array<string>")), 1, 3)
    return rounds.select("round", F.filter(themes, lambda t: t.isNotNull() & (t != "")).alias("focus_themes"), F.coalesce(open_, F.array().cast("array<string>")).alias("unpassed_gates"), F.map_filter("delta", lambda _, v: v > 0).alias("grew"))


def listed_ids(knowledge: DataFrame, rules: DataFrame, limit: int) -> DataFrame:
    """(kind, id): all ids, or an even sample of `limit`, shared between the kinds in proportion."""
    k, r = (d.where("coalesce(id, '') <> ''").count() for d in (knowledge, rules))
    rows = knowledge.select(F.lit("knowledge").alias("kind"), "id").unionByName(rules.select(F.lit("rule").alias("kind"), "id")).where("coalesce(id, '') <> ''")
    if k + r <= limit:
        return rows
    first = max(1, round(limit * k / (k + r))) if k else 0
    return even_sample(rows, ["id"], {"knowledge": first, "rule": max(0, limit - first)}, "kind")


def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of left (key, value) with all of right (key, value) of its key, without the key.

    A key may have very many rows on both sides: they meet in blocks of about `BLOCK` rows, which are dealt by block and, copied, by `CELLS`
    blocks of left.  A part has few blocks and repeats them for each row of left, so that files of the result are small.
    """
    key, a, b = left.columns[0], left.columns[1], right.columns[1]
    left, right = stored(left, "left"), stored(right, "right")
    sizes = [stored(rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias(n)), "sizes") for rows, n in ((left, "_left"), (right, "_right"))]
    both = stored(sizes[0].join(sizes[1], key), "sizes")
    # blocks of blocks are pairs of rows
    met = both.agg(F.sum(F.col("_left") * F.col("_right"))).first()[0] or 0
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-met * BLOCK * BLOCK // PAIRS))
    zero = F.lit(0).cast("long")

    def placed(rows: DataFrame, value: str, n: str) -> DataFrame:
        return rows.join(both, key).withColumn(f"{n}_at", F.pmod(F.xxhash64(value), F.col(n)))

    ours = placed(left, a, "_left").select(key, a, F.floor(F.col("_left_at") / CELLS).alias("_cell"), F.explode(F.sequence(zero, F.col("_right") - 1)).alias("_right_at"))
    theirs = placed(right, b, "_right").select(key, b, F.explode(F.sequence(zero, F.floor((F.col("_left") - 1) / CELLS))).alias("_cell"), "_right_at")
    on = [key, "_right_at", "_cell"]
    return ours.repartition(parts, *on).join(theirs.repartition(parts, *on).hint("shuffle_hash"), on).select(a, b)


def repair_targets(errors: DataFrame, outputs: DataFrame) -> DataFrame:
    """(error_id, agent): outputs to repair for each error (error_id, error); outputs: (agent, ord, kind, text) per kind of file.

    The error's kind is that of the first word of REPAIRS in it; without one, all agents are.  Of the agents with files of
    the kind those are whose text holds a node that the error names, all of them if it names none; if none is, the first
    three with files of the kind are, and if there are none, the first three of all.

    Errors that ask the same (kind and nodes) are answered once; one automaton looks for the nodes of all errors in each
    text, and an error meets the texts that hold one of its nodes.
    """
    lowered = F.lower("error")
    kind = F.coalesce(*[F.when(lowered.contains(word), name) for word, name in REPAIRS])
    whole = focus_nodes(F.col("error"))
    tokens = F.array_distinct(F.concat(whole, F.transform(whole, lambda t: F.regexp_extract(t, "[^:]*$", 0)), F.transform(whole, lambda t: F.regexp_extract(t, "[^/]*$", 0))))
    asked = stored(errors.select("error_id", kind.alias("kind"), F.array_sort(F.filter(tokens, lambda t: F.char_length(t) >= 6)).alias("tokens")), "asked")
    files = stored(outputs.withColumn("_row", F.struct("agent", "kind")), "outputs")
    agents = files.groupBy("agent").agg(F.min("ord").alias("ord"))
    question = asked.select("kind", "tokens").distinct().withColumn("ask", F.xxhash64("kind", "tokens"))
    question = stored(question, "questions")
    named = question.where("kind is not null and size(tokens) > 0").select("ask", "kind", F.explode("tokens").alias("word"))
    found = hits(files, "_row", F.col("text"), named).select(F.col("_row.agent").alias("agent"), F.col("_row.kind").alias("kind"), "word")
    by_node = named.join(found, ["kind", "word"]).select("ask", "agent").distinct()
    by_kind = files.select("kind", "agent", "ord").groupBy("kind", "agent").agg(F.min("ord").alias("ord"))
    of_kind = question.where("kind is not null and size(tokens) = 0").join(by_kind, "kind").select("ask", "agent")
    hit = stored(by_node.unionByName(of_kind), "hit")
    lost = question.where("kind is not null").join(hit.select("ask").distinct(), "ask", "left_anti")
    first = by_kind.withColumn("_nth", F.row_number().over(Window.partitionBy("kind").orderBy("ord", "agent"))).where("_nth <= 3").select("kind", "agent")
    of_first = lost.join(first, "kind").select("ask", "agent")
    # three rows
    last = lost.join(first.select("kind").distinct(), "kind", "left_anti").join(F.broadcast(agents.orderBy("ord", "agent").limit(3).select("agent")), F.lit(True)).select("ask", "agent")
    answers = hit.unionByName(of_first).unionByName(last)
    # an unclear error is one for every agent, that is what the rule says
    told = crossed(asked.where("kind is not null").select(F.xxhash64("kind", "tokens").alias("ask"), "error_id"), answers.select("ask", "agent"))
    all_ = F.lit(0).cast("long").alias("ask")
    unclear = crossed(asked.where("kind is null").select(all_, "error_id"), agents.select(all_, "agent"))
    return unclear.unionByName(told)


def appended_playbooks(records: DataFrame, triples: DataFrame, namespace: str, label_p: str) -> DataFrame:
    """Index records (id, name_zh, domain, anomaly_ref, cause_refs, action_refs, confidence, source_type) of playbooks in triples that records (id) lack."""
    names = {"anomaly_ref": "diagnosesAnomaly", "domain": "domainCode", "confidence": "confidence", "source_type": "sourceType"}
    triples = stored(triples.select("s", "p", "o"), "triples")
    typed = triples.where((F.col("p") == "http://www.w3.org/1999/02/22-rdf-syntax-ns#type") & (F.col("o") == namespace + "DiagnosticPlaybook")).select("s").distinct()
    new = stored(typed.join(records.select(F.col("id").alias("s")), "s", "left_anti"), "new")
    # lists are gathered where their subjects are dealt to; a semi join would be moved before the dealing, and one with what is not stored take its parts
    of = dealt(triples, "s", each=EACH).join(new.hint("merge"), "s")

    def one(p: str) -> Column:
        return F.min(F.when(F.col("p") == p, F.col("o")))

    def many(p: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o"))))

    made = of.groupBy(F.col("s").alias("id")).agg(one(label_p).alias("name_zh"), *[one(namespace + p).alias(n) for n, p in names.items()], many(namespace + "hasPossibleCause").alias("cause_refs"), many(namespace + "hasDiagnosticAction").alias("action_refs"))
    defaults = {"name_zh": F.col("id"), "domain": F.lit("fab"), "confidence": F.lit("medium"), "source_type": F.lit("model_prior")}
    return made.withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})


def whole_groups(triples: DataFrame, declared: DataFrame, group: Mapping[str, str | None], single: str) -> tuple[DataFrame, DataFrame]:
    """(triples that stay, removed (s, reason)): a subject keeps its triples of the predicates in `group` only together.

    They go if one of the predicates is missing, if `single` has more than one value, or if a target that is declared, in
    (node, types array), lacks the type its predicate asks for; of wrong targets the first predicate of `group` is named.
    Targets that are not declared here are taken as they are.  Repeated triples count once; other triples always stay.
    """
    names = list(group)
    place = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])
    asked = F.create_map(*[x for name, kind in group.items() for x in (F.lit(name), F.lit(kind).cast("string"))])
    triples = stored(triples, "triples")
    parts = max(1, -(-triples.count() // EACH))
    inside = triples.where(F.col("p").isin(*names)).select("s", "p", "o").repartition(parts, "s").distinct()
    types = declared.groupBy(F.col("node").alias("o")).agg(F.flatten(F.collect_set("types")).alias("_types"))
    wrong = F.col("_types").isNotNull() & ~F.array_contains("_types", asked[F.col("p")])
    # targets of predicates that ask for no type meet nothing: many subjects may share one; the others are not sorted for their types
    aimed = inside.where(asked[F.col("p")].isNotNull()).join(types.hint("shuffle_hash"), "o", "left").select("s", "p", F.when(wrong, place[F.col("p")]).alias("wrong"))
    free = inside.where(asked[F.col("p")].isNull()).select("s", "p", F.lit(None).cast("int").alias("wrong"))
    have = reduce(Column.__add__, [F.max(F.when(F.col("p") == name, 1).otherwise(0)) for name in names])
    facts = aimed.unionByName(free).repartition(parts, "s").groupBy("s").agg(have.alias("have"), F.count_if(F.col("p") == single).alias("singles"), F.min("wrong").alias("wrong"))
    texts = F.array(*[F.lit(f"a target of {name} is no {kind}") for name, kind in group.items()])
    reason = (
        F.when(F.col("have") < len(names), F.concat(F.lit("has "), F.col("have").cast("string"), F.lit(f" of {len(names)}")))
        .when(F.col("singles") > 1, F.lit(f"more than one {single}"))
        .when(F.col("wrong").isNotNull(), F.get(texts, F.col("wrong")))
    )
    removed = stored(facts.select("s", reason.alias("reason")).where("reason is not null"), "removed")
    gone = removed.select("s", F.lit(True).alias("_gone"))
    stay = F.col("_gone").isNull() | F.col("p").isNull() | ~F.col("p").isin(*names)
    return triples.repartition(parts, "s").join(gone.hint("merge"), "s", "left").where(stay).select(*triples.columns), removed
