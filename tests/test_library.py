"""Operators on small tables made by hand: closure, rules, shapes, simulation, samples, parsers, sinks, streams."""

from __future__ import annotations

import io
import itertools
import zipfile
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph import schemas
from weftgraph.functions import formula, text
from weftgraph.operators import aggregates, changes, checks, graph, predicates, questions, reasoner, rules, shapes, simulate, windows
from weftgraph.operators.reasoner import CHAIN, DOMAIN, FIRST, INVERSE, NIL, RANGE, REST, SUBCLASS, SUBPROPERTY, TRANSITIVE, TYPE
from weftgraph.operators.rule_catalog import catalog
from weftgraph.sources import documents, sinks, tables, turtle
from weftgraph.storage import stored
from weftgraph.streaming import events

NS = "urn:plant:"


def triples(spark, *rows):
    """Triples of names; a value with a leading `"` is a literal, with `^^type` behind it a typed one."""
    out = []
    for s, p, o in rows:
        if o.startswith('"'):
            value, _, kind = o[1:].partition("^^")
            out.append((s, p, value, "literal", kind, ""))
        else:
            out.append((s, p, o, "bnode" if o.startswith("_:") else "iri", "", ""))
    return spark.createDataFrame(out, schemas.TRIPLE)


def facts(df):
    return {(r["s"], r["p"], r["o"]) for r in df.collect()}


SCHEMA = [
    *[("hasChamber", INVERSE, "chamberOf"), ("directlyPrecedes", SUBPROPERTY, "precedes"), ("precedes", TYPE, TRANSITIVE), ("usesTool", DOMAIN, "Step"), ("usesTool", RANGE, "Tool")],
    *[("inFab", CHAIN, "_:a"), ("_:a", FIRST, "locatedIn"), ("_:a", REST, "_:b"), ("_:b", FIRST, "inFab"), ("_:b", REST, NIL), ("Tool", SUBCLASS, "Asset"), ("Asset", SUBCLASS, "Thing")],
]


def test_closure(spark):
    base = [("ch", "chamberOf", "eq"), ("eq", "locatedIn", "area"), ("area", "inFab", "fab"), ("A", "directlyPrecedes", "B"), ("B", "directlyPrecedes", "C"), ("st", "usesTool", "eq"), ("x", "usesTool", '"text')]
    schema = triples(spark, *SCHEMA)
    axioms = reasoner.read_schema(schema)
    closed = facts(reasoner.closure(triples(spark, *base, *SCHEMA), axioms))
    assert {("eq", "hasChamber", "ch"), ("eq", "inFab", "fab"), ("A", "precedes", "C"), ("st", TYPE, "Step"), ("eq", TYPE, "Tool"), ("eq", TYPE, "Thing"), ("Tool", SUBCLASS, "Thing")} <= closed
    assert ("text", TYPE, "Tool") not in closed and ("A", "directlyPrecedes", "C") not in closed
    # what a change adds to a closed table is what the closure of all has
    before = reasoner.closure(triples(spark, *base[:3], *SCHEMA), axioms)
    assert facts(reasoner.closure(triples(spark, *base[3:]), axioms, before)) == closed
    assert reasoner.blockers(schema) == []
    assert reasoner.blockers(triples(spark, ("a", reasoner.OWL + "sameAs", "b"))) != []


def test_interval_rule_and_hypothesis(spark):
    at = "2026-08-29T0{}:00:00Z"

    def lasting(name, kind, tool, a, b, *more):
        rows = [(name, TYPE, NS + kind), (name, NS + tool, "tool"), (name, NS + "validFrom", '"' + at.format(a))]
        return [*rows, *([(name, NS + "validTo", '"' + at.format(b))] if b else []), *more]

    run = ("processesLot", "lot")
    rows = lasting("down", "DownEvent", "affectsEquipment", 1, 3)
    rows += lasting("run", "ProcessingEvent", "usesEquipment", 2, 4, ("run", NS + run[0], run[1]))
    rows += lasting("touching", "ProcessingEvent", "usesEquipment", 3, 5, ("touching", NS + run[0], "lot2"))
    rows += lasting("open", "ProcessingEvent", "usesEquipment", 2, None, ("open", NS + run[0], "lot3"))
    rows += [("cause", NS + "mayCause", "anomaly"), ("book", TYPE, NS + "DiagnosticPlaybook"), ("book", NS + "diagnosesAnomaly", "anomaly")]
    base = triples(spark, *rows)
    by_id = {r.id: r for r in catalog(NS)}
    assert len(by_id) == 24
    made = rules.constructed(base, by_id["R-INF-003"], NS).collect()
    assert len(made) == 8 and ("down", NS + "impactsLot", "lot") in {(r["s"], r["p"], r["o"]) for r in made}
    assert {r["o"] for r in made if r["p"] == NS + "derivedFrom"} == {"down", "run"}
    assert len(rules.constructed(base, by_id["R-INF-004"], NS).collect()) == 7
    first, fired = rules.run(base, [by_id["R-INF-003"], by_id["R-INF-004"]], NS)
    assert fired == {"R-INF-003": 8, "R-INF-004": 7}
    # a second run finds everything there
    assert set(rules.run(first, [by_id["R-INF-003"], by_id["R-INF-004"]], NS)[1].values()) == {0}
    assert shapes.forbidden_individuals(first, NS + "ConfirmedRootCause").isEmpty()


def test_rule_order_and_absence(spark):
    base = triples(spark, ("g", TYPE, NS + "ReleaseGate"), ("g", NS + "hasValidationFinding", "f"), ("f", TYPE, NS + "ValidationFinding"), ("f", NS + "releaseBlockingFlag", '"TRUE'))
    rule = next(r for r in catalog(NS) if "BLOCKING" in r.id)
    _, fired = rules.run(base, [rule, rules.Rule("R-COPY", [("?g", "copy", "?c")], [("?g", "gateDecisionCode", "?c")])], NS)
    assert fired == {rule.id: 2, "R-COPY": 1}
    bad = rules.admissible(spark.createDataFrame([("R-A", "CONSTRUCT {} WHERE {}", True), ("R-A", "DELETE x", False), ("x", None, True)], "id string, text string, has_test boolean"))
    assert {tuple(r) for r in bad.collect()} == {("R-A", "duplicate id"), ("R-A", "not a construct"), ("R-A", "update keyword"), ("R-A", "missing test"), ("x", "id"), ("x", "missing text")}


def test_shapes_hold_after_the_closure(spark):
    schema = triples(spark, ("hasChamber", INVERSE, "chamberOf"))
    axioms = reasoner.read_schema(schema)
    constraints = spark.createDataFrame([("E", "Equipment", "", "code", 1, None, None, None, "code"), ("C", "Chamber", "", "chamberOf", None, 1, None, None, "one")], shapes.CONSTRAINT)
    for delta, broken in (
        ([("ok", TYPE, "Equipment"), ("ok", "code", '"X')], set()),
        ([("bad", TYPE, "Equipment")], {("bad", "minCount")}),
        ([("c", TYPE, "Chamber"), ("c", "chamberOf", "a"), ("c", "chamberOf", "b")], {("c", "maxCount")}),
        ([("c", TYPE, "Chamber"), ("c", "chamberOf", "a"), ("b", "hasChamber", "c")], {("c", "maxCount")}),
    ):
        base = triples(spark, *delta)
        found = shapes.violations(base, reasoner.closure(base, axioms), constraints)
        assert {(r["node"], r["component"]) for r in found.collect()} == broken


def simulation(spark, opex=100.0):
    values = [("input_units", 1000.0, "unit/month"), ("assembly_yield", 0.9, "ratio"), ("test_yield", 0.8, "ratio"), ("selling_price", 10.0, "CNY/unit"), ("unit_cost", 5.0, "CNY/unit"), ("intervention_opex", 0.0, "CNY/month")]
    inputs = spark.createDataFrame([("m", *v, "assumption") for v in values], "model string, id string, value double, unit string, source string")
    calculations = [
        {"id": "process_yield", "algorithm": "yield.cascade", "inputs": ["assembly_yield", "test_yield"], "unit": "ratio"},
        {"id": "profit", "formula": "input_units * process_yield * selling_price - input_units * unit_cost - intervention_opex", "unit": "CNY/month"},
    ]
    ops = spark.createDataFrame([("s", "assembly_yield", "set", 0.95, 0), ("s", "intervention_opex", "set", opex, 1), ("bad", "nothing", "set", 1.0, 0), ("bad", "test_yield", "add", 0.5, 1)], "scenario string, variable string, operation string, value double, ord int")
    return simulate.run(inputs, calculations, ["process_yield", "profit"], spark.createDataFrame([("s", "m"), ("none", "m"), ("bad", "m")], "scenario string, model string"), ops, spark.createDataFrame([("s", 500.0)], "scenario string, one_time double"))


def test_simulation(spark):
    results, summary = simulation(spark)
    found = {(r["scenario"], r["variable"]): (r["baseline"], r["changed"], r["delta"]) for r in results.collect()}
    assert found["s", "process_yield"] == (0.72, 0.76, 0.04) and found["s", "profit"] == (2200.0, 2500.0, 300.0)
    assert found["none", "profit"] == (2200.0, 2200.0, 0.0)
    rows = {r["scenario"]: r for r in summary.collect()}
    assert rows["s"]["payback_periods"] == 1.666667 and rows["s"]["evidence_grade"] == "assumption_only" and rows["s"]["errors"] == []
    assert rows["none"]["payback_periods"] is None
    assert "not an input" in rows["bad"]["errors"] and "test_yield out of range" in rows["bad"]["errors"]


def test_templates_and_formulas(spark):
    known = {"a": {"variables": [{"id": "x", "unit": "ratio"}]}, "b": {"extends": ["a"], "variables": [{"id": "x", "unit": "CNY", "override": True}, {"id": "y", "unit": "CNY"}]}}
    assert [v["unit"] for v in simulate.resolved("b", known)["variables"]] == ["CNY", "CNY"]
    with pytest.raises(simulate.ModelError):
        simulate.resolved("p", {"p": {"extends": ["q"]}, "q": {"extends": ["p"]}})
    with pytest.raises(simulate.ModelError):
        simulate.ordered([{"id": "a", "formula": "b + 1"}, {"id": "b", "formula": "a"}], [])
    for bad in ("__import__('os')", "x.y", "x if x else 1", "'a'", "x +"):
        with pytest.raises(formula.FormulaError):
            formula.compiled(bad, {"x": F.lit(1.0)})
    row = spark.range(1).select(formula.compiled("-x ** 2 / (y - 1) + 3", {"x": F.lit(2.0), "y": F.lit(3.0)}).alias("a"), formula.compiled("x / y", {"x": F.lit(2.0), "y": F.lit(0.0)}).alias("b")).first()
    assert row["a"] == 1.0 and row["b"] is None
    with pytest.raises(formula.FormulaError):
        formula.execute("finance.roi", [F.lit(1.0)])


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=2), st.integers(0, 900), max_size=6), st.integers(0, 800))
def test_quotas(sizes, limit):
    given_ = windows.quotas(sizes, limit)
    total = sum(sizes.values())
    kinds = sum(n > 0 for n in sizes.values())
    assert all(0 <= given_[k] <= sizes[k] for k in given_)
    if limit >= kinds:
        assert sum(given_.values()) == min(limit, total)


def test_samples(spark):
    rows = spark.range(100)
    picked = sorted(r[0] for r in windows.even_sample(rows, ["id"], 10).collect())
    assert picked == [round(i * 99 / 9) for i in range(10)]
    assert windows.even_sample(rows, ["id"], 0).count() == 0 and windows.even_sample(rows, ["id"], 500).count() == 100
    assert windows.quotas({"class": 850, "object": 436, "datatype": 895}, 200).keys() == {"class", "object", "datatype"}
    kinds = spark.range(60).withColumn("kind", F.when(F.col("id") < 50, "a").otherwise("b"))
    found = windows.balanced_sample(kinds, "kind", ["id"], 12, F.col("id") % 10 == 0).collect()
    counts = {k: sum(r["kind"] == k for r in found) for k in "ab"}
    assert counts == windows.quotas({"a": 50, "b": 10}, 12) and sum(r["id"] % 10 == 0 for r in found) >= 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=14))
def test_closure_and_components_against_sets(spark, pairs):
    edges = spark.createDataFrame(pairs, "src long, dst long")
    want = set(pairs)
    while True:
        more = want | {(a, d) for (a, b), (c, d) in itertools.product(want, set(pairs)) if b == c}
        if more == want:
            break
        want = more
    assert {tuple(r) for r in graph.transitive_closure(edges).collect()} == want
    near = {n: {n} for p in pairs for n in p}
    for _ in near:
        for a, b in pairs:
            near[a] = near[b] = near[a] | near[b]
    assert {tuple(r) for r in graph.connected_components(edges).collect()} == {(n, min(s)) for n, s in near.items()}


def test_paths_and_ties(spark):
    up = spark.createDataFrame([("x", "m2"), ("x", "m1"), ("m1", "top"), ("y", "x"), ("z", "z2"), ("z2", "z")], "src string, dst string")
    found = {r["node"]: (r["nearest"], r["depth"]) for r in graph.nearest_marked(up, spark.createDataFrame([("m1",), ("m2",), ("top",)], "node string")).collect()}
    assert found["x"] == ("m1", 1) and found["y"] == ("m1", 2) and found["m1"] == ("m1", 0) and "z" not in found
    with pytest.raises(ValueError):
        graph.path_counts(up)
    empty = spark.createDataFrame([], "src string, dst string")
    assert graph.transitive_closure(empty).count() == 0 and graph.connected_components(empty).count() == 0


def test_bisection():
    bad = {"c", "f"}
    accepted, rejected, used = changes.bisected("abcdefgh", lambda group: not bad & set(group))
    assert set(accepted) == set("abcdefgh") - bad and set(rejected) == bad and used <= 32
    assert changes.bisected("ab", lambda group: True, budget=0) == ([], ["a", "b"], 0)


def test_stages_run_when_their_input_changes(spark):
    state, ran = {}, []
    rows = spark.range(5)
    for table in (rows, rows.repartition(3), rows.union(rows)):
        state, done = changes.run_if_changed(state, "stage", [table], lambda: ran.append(1))
    assert len(ran) == 2 and done
    before = dict(state)
    with pytest.raises(ZeroDivisionError):
        changes.run_if_changed(state, "stage", [spark.range(9)], lambda: 1 / 0)
    assert state == before


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(
        '@prefix : <urn:x:> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n:a a :T ; :p "q\\"x"@en, 3, 2.5, true, "7"^^xsd:int ; :l (:b :c) ; :n [ :m :d ] . # end\n_:z :p """two\nlines""" .\n', encoding="utf-8"
    )
    (tmp_path / "b.trig").write_text("@prefix : <urn:x:> .\n:g { :a :p :b . }\nGRAPH :h { :a :p :b }\n", encoding="utf-8")
    (tmp_path / "bad.ttl").write_text("<urn:x:a> <urn:x:p> ", encoding="utf-8")
    quads, issues = turtle.read(spark, str(tmp_path))
    rows = {(r["g"], r["p"].split(":")[-1].split("#")[-1], r["o"], r["o_kind"], r["o_dt"].split("#")[-1], r["o_lang"]) for r in quads.collect()}
    assert {("", "p", 'q"x', "literal", "", "en"), ("", "p", "3", "literal", "integer", ""), ("", "p", "2.5", "literal", "decimal", ""), ("", "p", "true", "literal", "boolean", ""), ("", "p", "7", "literal", "int", ""), ("", "p", "two\nlines", "literal", "", "")} <= rows
    assert {r[0] for r in rows} == {"", "urn:x:g", "urn:x:h"} and sum(r[1] == "first" for r in rows) == 2
    assert [r["file"].rsplit("/", 1)[1] for r in issues.collect()] == ["bad.ttl"]
    assert turtle.triples(quads).where("s = 'urn:x:a' and o = 'urn:x:b'").count() == 1
    turtle.write(quads, f"{tmp_path}/out")
    again, issues = turtle.read(spark, f"{tmp_path}/out/part-*")
    assert issues.count() == 0 and again.count() == quads.count()


ENTITIES = """
default_provenance: {source_type: web, ref: r, confidence: high, created_at: '2024-01-01'}
entities:
- {id: fab.anomaly.a, type: Anomaly, domain: fab, name_zh: 名, name_en: Edge ring, aliases: [Ring], stage: fab.stage.s, economic_hooks: {affects: [yield]}}
- {id: fab.anomaly.a, type: Anomaly, domain: fab}
- {id: fab.cause.c, type: Cause, domain: fab, provenance: {ref: null}}
- just text
"""


def test_documents(spark):
    found, later, keys = documents.entities(spark, [("f.yaml", ENTITIES)])
    rows = {r["id"]: r for r in found.collect()}
    assert set(rows) == {"fab.anomaly.a", "fab.cause.c"} and later.count() == 1 and keys.count() == 3
    assert rows["fab.cause.c"]["provenance"]["source_type"] == "web" and rows["fab.cause.c"]["provenance"]["ref"] is None
    relations = documents.relations(spark, [("r.yaml", "relations:\n- {from: fab.cause.c, type: may_cause, to: fab.anomaly.a, likelihood: low}\n")])
    derived = graph.derived_edges(found, [("stage", "belongs_to", "entity -> value")])
    assert {(r["src"], r["rel_type"], r["dst"], r["derived"]) for r in graph.all_edges(relations, derived).collect()} == {("fab.cause.c", "may_cause", "fab.anomaly.a", False), ("fab.anomaly.a", "belongs_to", "fab.stage.s", True)}
    lost = checks.dangling_refs(graph.entity_refs(found, ["stage"]), found).collect()
    assert [r["detail"] for r in lost] == ["stage -> fab.stage.s"]
    assert checks.duplicate_ids(found.union(later)).count() == 1
    assert documents.index_records(found, documents.cases(spark, [])[0]).count() == 2


QUESTIONS = [("1", "晶圆边缘环的可能原因有哪些"), ("2", "昨天 EQP 12 的边缘环"), ("3", "今晚吃什么"), ("4", "股价预测")]


def test_routing(spark):
    items = spark.createDataFrame([("CQ01", "in_scope", ["可能原因"], ["Anomaly"], []), ("OOS01", "out_of_scope", ["股价"], [], [])], "id string, bucket string, match_terms array<string>, entity_types array<string>, relations array<string>")
    names = spark.createDataFrame([("Anomaly", "边缘环", "fab.anomaly.a")], "type string, name string, id string")
    asked = spark.createDataFrame(QUESTIONS, "qid string, question string")
    found = questions.verdicts(asked, items, names)
    assert {r["qid"]: r["verdict"] for r in found.collect()} == {"1": "answerable", "2": "instance_level", "3": "unlisted", "4": "out_of_scope"}
    assert next(r for r in questions.scored(asked, items, names).collect() if r["qid"] == "1")["score"] == 13.0
    expected = spark.createDataFrame([("f", "1", "answerable"), ("f", "2", "refuse"), ("f", "3", "answerable")], "file string, qid string, expect string")
    assert tuple(questions.regression(expected, found).first()) == ("f", 3, 1)


def test_signals(spark):
    rows = spark.createDataFrame([("昨天有几台",), ("top 10 list",), ("lot ab123",), ("这批怎么了",), ("什么是良率",)], "q string")
    assert [r[0] for r in rows.select(F.array_join(predicates.instance_signals(F.col("q")), ",")).collect()] == ["time,quantity", "quantity", "instance", "deixis", ""]


@pytest.mark.parametrize(
    ("url", "ok"),
    [("https://example.com/a?b=1", True), ("http://10.0.0.1/", False), ("http://localhost/", False), ("ftp://example.com", False), ("https://u:p@example.com", False), ("https://example.com/?api_key=1", False), ("https://example.com/" + "a" * 2048, False), (None, False), ("http://[::1]/", False), ("https://example.com/?author=1&keyword=2", True), ("https://example.com/?sig=1", False), ("http://localhost./", False), ("http://localhost.localdomain/", False)],
)
def test_public_url(url, ok):
    assert predicates.public_url(url) is ok


def test_public_url_expression(spark):
    hosts = ["example.com", "EXAMPLE.com:443", "10.1.2.3", "100.64.1.1", "172.20.0.1", "172.32.0.1", "192.168.3.4", "8.8.8.8", "256.1.1.1", "169.254.1.1", "198.18.0.1", "localhost", "LOCALHOST.", "a.local", "[::1]", "[2606:4700::1111]", "[2001:db8::1]", "u:p@example.com", "example.com:99999", "example.com:x", "", "01.2.3.4"]
    urls = [f"{scheme}://{h}{rest}" for scheme in ("http", "HTTPS", "ftp") for h in hosts for rest in ("", "/a?b=1", "/?x=1&Access_Token=2", "?q=a%20b&to%6ben=1", "/?author=1&monkey=2", "/?SIG=1", "#token=1")] + [None, "", "nothing", "http://e.com/" + "x" * 2040]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select("u", predicates.is_public_url(F.col("u")).alias("ok")).collect()
    assert [(r["u"], r["ok"]) for r in found] == [(u, predicates.public_url(u)) for u in urls]



@settings(max_examples=100, deadline=None)
@given(st.text(), st.integers(4, 40))
def test_byte_chunks(value, most):
    value = value.encode("utf-8", "ignore").decode()
    chunks = list(text.byte_chunks(value, most))
    assert "".join(chunks) == value and all(0 < len(c.encode()) <= most for c in chunks)


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    assert one(text.terms(F.lit("CVD 腔体异常!"))) == ["cvd", "腔体", "体异", "异常"] and one(text.terms(F.lit("x单"))) == ["x"]
    assert one(text.keywords(F.array(F.lit("Ring"), F.lit(None)), F.array(F.lit("Edge ring/a (map)")))) == ["Ring", "Edge", "map"]
    assert one(text.filled("$a and ${b} $c", {"a": F.lit("x$1"), "b": F.lit(2)})) == "x$1 and 2 $c"
    assert one(text.column_index(F.lit("AA"))) == 26 and one(text.iri_tail(F.lit("urn:a/b#c"))) == "c"
    assert one(text.percent_encoded(F.lit("a b*~é"))) == "a%20b%2A~%C3%A9"
    assert one(text.headings(F.lit("## A\nx\ny\n## B\nz"), "A")) == "x\ny"
    assert text.first_object('noise {bad} ```{"b": 1, "a": {"c": "é"}}``` more') == '{"a":{"c":"é"},"b":1}' and text.first_object("none") is None
    assert one(aggregates.map_delta(F.from_json(F.lit('{"a": 1, "b": 5}'), "map<string,int>"), F.from_json(F.lit('{"b": 3, "c": 4}'), "map<string,int>"))) == {"a": -1, "b": -2, "c": 4}


MARKDOWN = """## 刻蚀场景
### 运行
| 描述 | 状态机 | | notes |
| --- | --- | --- | --- |
| | 控制 | 访问 | |
| a<br>b | x | y | |
| c | | z | |
## 清洗
| 列 | 列 |
|---|---|
| 1 | 2 |
"""


def test_markdown():
    first, second = tables.markdown_tables(MARKDOWN)
    assert first[1][:3] == ["equipment", "phase", "描述"] and len(first[1]) == 5
    assert first[2][0] == ["刻蚀", "运行", "a b", "x", "y"] and len(first[2]) == 2
    assert second[1] == ["equipment", "phase", "列", "列_1"] and second[2] == [["清洗", "", "1", "2"]]


def workbook() -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>code</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>')
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>3.0</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="inlineStr"><is><t> x </t></is></c></row></sheetData></worksheet>',
        )
    return out.getvalue()


def test_delivered_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "a.csv").write_text("﻿id, name,\n1,2,3\n", encoding="utf-8")
    (tmp_path / "a.json").write_text('[{"x": 1, "y": 2}, {"z": 3}]', encoding="utf-8")
    assert tables.headers(spark, f"{tmp_path}/a.xlsx", "xlsx") == ["code", "name"]
    assert tables.headers(spark, f"{tmp_path}/a.csv", "csv")[:2] == ["id", "name"]
    assert tables.headers(spark, f"{tmp_path}/a.json", "json") == ["x", "y"]
    with pytest.raises(ValueError):
        tables.headers(spark, f"{tmp_path}/a.xls", "xls")
    rows = tables.sheet_rows(tables.cells(spark, f"{tmp_path}/a.xlsx"), ["code", "flag", "name"]).collect()
    assert [(r["code"], r["flag"], r["name"]) for r in rows] == [("3", "true", "x")]


def test_page_text():
    page = "<html><script>var thing = 'not this text at all';</script><p>short</p><p>This is a long   enough text</p></html>"
    assert tables.page_text(page) == "This is a long enough text" and tables.page_text(page, 4) == "This" and tables.page_text(None) == ""


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sinks.write_if_changed(rows, path) and not sinks.write_if_changed(rows.repartition(3), path)
    assert sinks.append_new(spark.createDataFrame([(2, "x"), (3, "c"), (3, "d")], "id int, v string"), path, "id") == 1 and spark.read.parquet(path).count() == 3
    manifest = sinks.export(spark, {"t": rows}, f"{tmp_path}/zip")
    assert manifest.count() >= 1 and all(len(r["sha256"]) == 64 and r["size"] > 0 for r in manifest.collect())
    assert sinks.free_names(["A b", "a B", "", "c"]) == ["a_b", "a_b_2", "table", "c"]
    with pytest.raises(ValueError):
        sinks.copy_columns(rows, path)
    assert stored(rows).schema == rows.schema


def log(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, user long, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def test_tail_goes_on_where_it_ended(spark, tmp_path):
    path, start = f"{tmp_path}/log", datetime(2024, 1, 1)
    log(spark, path, [(k, k % 2, start + timedelta(seconds=k)) for k in range(5)])

    def read():
        return sorted(r["event_id"] for r in events.drained(events.tail(events.source(spark, path), 1), "tail", f"{tmp_path}/out", f"{tmp_path}/point").collect())

    assert read() == [2, 3, 4]
    log(spark, path, [(5, 1, start)])
    assert read() == [2, 3, 4, 5]
    seen = []
    events.for_each_batch(events.source(spark, path, 1), lambda df, k: seen.append(df.count()), f"{tmp_path}/point2")
    assert sum(seen) == 6 and len(seen) == 2


def test_sessions(spark, tmp_path):
    path, start = f"{tmp_path}/log", datetime(2024, 1, 1)
    offsets = {1: [0, 10, 20, 500, 510], 2: [5, 400], 3: [4000]}
    rows = [(k, user, start + timedelta(seconds=s)) for k, (user, s) in enumerate((u, s) for u, times in offsets.items() for s in times)]
    log(spark, path, rows[:4])
    log(spark, path, rows[4:])
    found = events.drained(events.sessions(events.source(spark, path, 1), "user", "ts", 100, "1 hour"), "sessions")
    closed = {(r["user"], r["n"], r["closed"] - r["opened"]) for r in found.collect()}
    every = {(1, 3, 20_000), (1, 2, 10_000), (2, 1, 0), (3, 1, 0)}
    assert closed <= every and (1, 3, 20_000) in closed


def test_jobs_and_reminders(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    jobs = spark.createDataFrame([(1, "queued", None), (2, "running", datetime(2024, 1, 1, 0, 59, 0)), (3, "running", datetime(2024, 1, 1, 0, 57, 59)), (4, "running", None), (5, "completed", None)], "id int, status string, heartbeat timestamp")
    assert {r["id"] for r in events.stale(jobs, now).collect()} == {1, 3, 4}
    tasks = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 1)), (3, datetime(2025, 1, 1))], "id int, due timestamp")
    assert {r["id"] for r in events.overdue(tasks, spark.createDataFrame([(2,)], "id int"), "id", "due", now).collect()} == {1}


def test_manifest_and_capabilities(spark):
    assert checks.grown({"a": 3, "b": 1}, {"a": 2, "b": 5}) == ["a"]
    levels = spark.createDataFrame([("q1", 1, "d", ["C"], ["r"], None), ("q1", 1, "d", [], [], None), ("q2", 2, "e", ["D"], [], ["q1", "q9"])], "id string, level int, domain string, classes array<string>, relations array<string>, composes array<string>")
    terms = spark.createDataFrame([("class", "C"), ("relation", "r")], "kind string, ref string")
    found = {tuple(r) for r in checks.capability_levels(levels, terms, 3).collect()}
    assert found == {("q2", "undeclared class D"), ("q1", "id is not unique"), ("q2", "unknown part q9"), ("all", "domains: 2")}
