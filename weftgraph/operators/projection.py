"""Projection of index records to quads: entities, relations with a statement each, and playbooks, with their provenance.

Records are those of `weftgraph.schemas`.  What a type or relation is called in RDF comes from mapping tables of the
caller's, applied as joins.  Nodes are named by what they stand for, statement and provenance nodes by a hash of it, so a
second run gives the same quads.  Blank texts give no quad.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.reasoner import RDF, RDFS, TYPE
from weftgraph.storage import dealt

# The vocabularies of SKOS, PROV and the integers of XML Schema.
SKOS, PROV, INTEGER = "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/ns/prov#", "http://www.w3.org/2001/XMLSchema#integer"
# Fixed value: what begins the ids of other ontologies.
EXTERNAL = "ext."
#: Names of the four graphs, below the namespace.
CATALOG, RELATIONS, PLAYBOOKS, PROVENANCE = "graph:catalog", "graph:relations", "graph:playbooks", "graph:provenance"


def node(ns: str, kind: str, id_: Column) -> Column:
    """The IRI of a record; of its id all but letters, digits and `._-~` is escaped."""
    escaped = F.url_encode(id_)
    for written, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        escaped = F.replace(escaped, F.lit(written), F.lit(plain))
    return F.concat(F.lit(f"{ns}{kind}:"), escaped)


def hashed(ns: str, kind: str, text: Column) -> Column:
    return F.concat(F.lit(f"{ns}{kind}:"), F.substring(F.sha2(text, 256), 1, 24))


def _iri(s: Column, p: Column | str, o: Column | str) -> Column:
    """A quad between nodes, null if one of them is; without its graph."""
    p, o = (F.lit(x) if isinstance(x, str) else x for x in (p, o))
    return F.when(s.isNotNull() & p.isNotNull() & o.isNotNull(), F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang")))


def _text(s: Column, p: Column | str, value: Column, lang: str = "", datatype: str = "") -> Column:
    """A quad with a text, null if that is null or blank."""
    p = F.lit(p) if isinstance(p, str) else p
    value = value.cast("string")
    return F.when(s.isNotNull() & value.rlike(r"\S"), F.struct(s.alias("s"), p.alias("p"), value.alias("o"), F.lit("literal").alias("o_kind"), F.lit(datatype).alias("o_dt"), F.lit(lang).alias("o_lang")))


def _quads(rows: DataFrame, key: str, graphs: Sequence[tuple[str, Sequence[Column], Sequence[Column]]]) -> DataFrame:
    """Quads, each once, of rows dealt by `key`: for each graph columns that hold one each, and columns that hold an array of them.

    Equal quads have one key, so that quads are made and told apart where their records were dealt to.
    """
    made = []
    for graph, single, many in graphs:
        every = F.concat(F.array(*single), *[F.coalesce(m, F.array().cast(rows.select(m.alias("m")).schema["m"].dataType)) for m in many])
        named = F.lit(graph).alias("g")
        made.append(F.transform(every, partial(lambda named, q: F.struct(named, q.alias("q")), named)))
    found = rows.select(key, F.explode(F.concat(*made)).alias("t")).where("t.q is not null")
    return found.select(key, "t.g", "t.q.*").distinct().drop(key)


def _provenance(ns: str, subject: Column, provenance: Column, file: Column) -> list[Column]:
    at = hashed(ns, "provenance", subject)
    return [_iri(at, TYPE, PROV + "Entity"), _iri(at, PROV + "specializationOf", subject), _text(at, ns + "sourceRef", F.coalesce(F.when(provenance["ref"] != "", provenance["ref"]), file)), *[_text(at, ns + p, provenance[c]) for p, c in (("confidence", "confidence"), ("sourceType", "source_type"), ("createdAt", "created_at"))]]


def entity_quads(entities: DataFrame, types: DataFrame, ns: str) -> DataFrame:
    """Quads of entities (see schemas.ENTITY).  types: (type, class); every entity is a CatalogConcept, one of an unmapped type only that.

    types is a vocabulary and is sent to all tasks: by their few types, entities would go to as few tasks.
    """
    known = F.broadcast(types.select("type", F.col("class").alias("_class")).dropDuplicates(["type"]))
    rows = entities.where("id is not null").join(known, "type", "left")
    rows = dealt(rows.withColumn("_s", node(ns, "catalog", F.col("id"))), "_s", each=20_000)
    s = F.col("_s")
    concept = ns + "CatalogConcept"
    single = [
        _iri(s, TYPE, F.when(F.col("_class") != concept, F.col("_class"))), _iri(s, TYPE, concept), _text(s, ns + "legacyId", F.col("id")), _text(s, SKOS + "notation", F.col("id")), _text(s, SKOS + "prefLabel", F.col("name_zh"), "zh"), _text(s, SKOS + "prefLabel", F.col("name_en"), "en"),
        _text(s, SKOS + "definition", F.col("description"), "zh"), _text(s, ns + "unitCode", F.col("unit")), _text(s, ns + "severity", F.col("severity")),
    ]
    aliases = F.transform("aliases", lambda a: _text(s, SKOS + "altLabel", a))
    attributes = F.transform(F.map_entries("attributes"), lambda e: _text(s, F.concat(F.lit(ns), e["key"]), e["value"]))
    return _quads(rows, "_s", [(ns + CATALOG, single, [aliases, attributes]), (ns + PROVENANCE, _provenance(ns, s, F.col("provenance"), F.col("_file")), [])])


def relation_quads(edges: DataFrame, predicates: DataFrame, ns: str) -> DataFrame:
    """Quads of relations (see schemas.EDGE), with a statement about each.  predicates: (rel_type, predicate); others are named after their type.

    The statement's name is a hash of ends, type, file and field, so one edge of two files has two statements.  predicates
    is a vocabulary and is sent to all tasks, as the types of entities are.
    """
    known = F.broadcast(predicates.select("rel_type", "predicate").dropDuplicates(["rel_type"]))
    edges = edges.where("src is not null and dst is not null and rel_type is not null")
    p = F.coalesce("predicate", node(ns, "relation", F.col("rel_type")))
    s, o = (F.when(F.col(c).startswith(EXTERNAL), node(ns, "external", F.col(c))).otherwise(node(ns, "catalog", F.col(c))) for c in ("src", "dst"))
    key = F.concat_ws("|", "src", "rel_type", "dst", F.coalesce("_file", F.lit("")), F.coalesce("field", F.lit("")))
    at = hashed(ns, "assertion", key)
    # relations are told apart by their source, statements by their name
    by_source, by_name = (dealt(edges.join(known, "rel_type", "left").withColumn("_key", key), "_key", each=20_000) for key in (s, at))
    at = F.col("_key")
    about = [_iri(at, TYPE, RDF + "Statement"), _iri(at, RDF + "subject", s), _iri(at, RDF + "predicate", p), _iri(at, RDF + "object", o)]
    about += [_text(at, ns + "confidence", F.col("provenance.confidence")), _text(at, ns + "likelihood", F.col("likelihood")), _text(at, RDFS + "comment", F.col("note"), "zh"), _text(at, ns + "sourceRef", F.coalesce(F.when(F.col("provenance.ref") != "", F.col("provenance.ref")), F.col("_file")))]
    rest = ["q.p", "q.o", "q.o_kind", "q.o_dt", "q.o_lang"]
    relations = by_source.select("_key", _iri(s, p, o).alias("q")).select(F.lit(ns + RELATIONS).alias("g"), F.col("_key").alias("s"), *rest).distinct()
    statements = by_name.select("_key", F.explode(F.array(*about)).alias("q")).where("q is not null").select(F.lit(ns + PROVENANCE).alias("g"), F.col("_key").alias("s"), *rest).distinct()
    return relations.unionByName(statements)


#: Of a playbook's lists: kind of their nodes, class, what the node is to the playbook, to its target, what the target is to the playbook, its field, and texts.
_PARTS = {
    "possible_causes": ("cause-assertion", "PossibleCauseAssertion", "hasCauseAssertion", "assertsCause", "hasPossibleCause", "cause_ref", (("likelihood", "likelihood", "", ""), ("discriminatorText", "discriminator", "zh", ""))),
    "detection": ("detection", "DetectionInstruction", "hasDetectionInstruction", "detectsWithMetric", "hasDetectionMetric", "metric_ref", (("signalText", "signal", "zh", ""),)),
    "actions": ("action-instruction", "ActionInstruction", "hasActionInstruction", "instructsAction", "hasDiagnosticAction", "action_ref", (("actionConditionText", "condition", "zh", ""), ("actionOrder", "order", "", INTEGER))),
}


def _listed(ns: str, s: Column, field: str) -> Column:
    """The quads of one of a playbook's lists."""
    kind, class_, has, to, has_target, ref, texts = _PARTS[field]

    def part(item: Column, at: Column) -> Column:
        n, target = node(ns, kind, F.concat(F.col("id"), F.lit(":"), (at + 1).cast("string"))), node(ns, "catalog", item[ref])
        return F.array(_iri(n, TYPE, ns + class_), _iri(n, ns + to, target), _iri(s, ns + has, n), _iri(s, ns + has_target, target), *[_text(n, ns + p, item[c], lang, datatype) for p, c, lang, datatype in texts])

    return F.flatten(F.transform(F.col(field), part))


def playbook_quads(cases: DataFrame, ns: str) -> DataFrame:
    """Quads of cases (see schemas.CASE) as playbooks: their anomaly, symptoms, and numbered nodes for causes, detection and actions."""
    rows = dealt(cases.where("id is not null").withColumn("_s", node(ns, "playbook", F.col("id"))), "_s", each=5_000)
    s = F.col("_s")
    single = [
        _iri(s, TYPE, ns + "DiagnosticPlaybook"), _text(s, ns + "legacyId", F.col("id")), _text(s, RDFS + "label", F.col("title"), "zh"), _iri(s, ns + "diagnosesAnomaly", node(ns, "catalog", F.col("anomaly_ref"))),
        _iri(s, ns + "hasDetectionProcess", node(ns, "catalog", F.when(F.col("detected_at_ref") != "", F.col("detected_at_ref")))), _text(s, ns + "economicImpactText", F.col("impact.economic"), "zh"),
    ]
    many = [F.transform("symptoms", lambda t: _text(s, ns + "symptomText", t, "zh"))]
    many += [_listed(ns, s, field) for field in _PARTS]
    return _quads(rows, "_s", [(ns + PLAYBOOKS, single, many), (ns + PROVENANCE, _provenance(ns, s, F.col("provenance"), F.col("_file")), [])])


def projected(entities: DataFrame, edges: DataFrame, cases: DataFrame, types: DataFrame, predicates: DataFrame, ns: str) -> DataFrame:
    """All quads of a set of records, each once."""
    return reduce(DataFrame.unionByName, [entity_quads(entities, types, ns), relation_quads(edges, predicates, ns), playbook_quads(cases, ns)]).distinct()
