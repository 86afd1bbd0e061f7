"""Joins, fixpoints and indexes of the library against brute force on small tables."""

from __future__ import annotations

import datetime
import hashlib
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import candidates, changes, checks, graph, joins, json_schema, matching, predicates, projection, questions, reasoner
from weftgraph.sources import sinks, tables
from weftgraph.storage import Round
from weftgraph.streaming import events

# interval join


def moment(x: int | None):
    return None if x is None else datetime.datetime(9999, 12, 31) if x == 99 else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=x)


def test_interval_overlap(spark):
    rng = random.Random(1)

    def intervals(n: int) -> list[tuple]:
        ends = [rng.choice([None, 99, *range(40)]) for _ in range(2 * n)]
        pairs = [sorted(p, key=lambda x: (x is None, x or 0)) if rng.random() < 0.8 else p for p in zip(ends[::2], ends[1::2], strict=True)]
        return [(k, rng.choice("ab"), *p) for k, p in enumerate(pairs)]

    left, right = intervals(120), intervals(90)
    a, b = (spark.createDataFrame([(i, k, moment(s), moment(e)) for i, k, s, e in rows], "id long, key string, start timestamp, end timestamp") for rows in (left, right))
    want = sorted((i, j) for i, k, s, e in left for j, m, t, f in right if k == m and None not in (s, e, t, f) and s < f and t < e)
    found = joins.interval_overlap(a, b, ["key"])
    assert sorted((r["id"], r["r_id"]) for r in found.collect()) == want and len(want) > 500
    assert found.columns == ["key", "id", "start", "end", "r_id", "r_start", "r_end"]
    assert joins.interval_overlap(a.limit(0), b, ["key"]).count() == joins.interval_overlap(a.limit(0), b.limit(0), ["key"]).count() == 0


def test_intervals_of_one_open_row_stay_few(spark):
    """An interval that ends in 9999 gives no more nodes than twice the levels, and the levels follow the number of rows."""
    a = spark.createDataFrame([(k, "x", moment(1000 + k), moment(99)) for k in range(200)], "id long, key string, start timestamp, end timestamp")
    b = spark.createDataFrame([(k, "x", moment(1000 + k), moment(1000 + k)) for k in range(200)], "id long, key string, start timestamp, end timestamp")
    found = joins.interval_overlap(a, b, ["key"])
    assert found.count() == 200 * 199 // 2
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


# closure, components and cycles


def reachable(edges: list[tuple]) -> set[tuple]:
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in out:
        front = set(out[start])
        seen: set = set()
        while front:
            seen |= front
            front = {c for b in front for c in out.get(b, ())} - seen
        found |= {(start, b) for b in seen}
    return found


def graphs() -> dict[str, list[tuple]]:
    rng = random.Random(11)
    return {
        "chain": [(k, k + 1) for k in range(20)],
        "ring and tails": [(k, (k + 1) % 12) for k in range(12)] + [(100 + k, 101 + k) for k in range(3)] + [(103, 7), (9, 200), (200, 201)],
        "two rings": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (9, 9), (8, 9), (1, 1)],
        "random": [(rng.randrange(40), rng.randrange(40)) for _ in range(55)],
    }


def test_closure_components_and_cycles(spark):
    """All the graphs side by side."""
    found = [(a + 1000 * k, b + 1000 * k) for k, edges in enumerate(graphs().values()) for a, b in edges]
    edges = spark.createDataFrame([*found, *found[:2]], "src long, dst long")
    closed = reachable(found)
    pairs = [tuple(r) for r in graph.transitive_closure(edges).select("src", "dst").collect()]
    assert len(pairs) == len(closed) and set(pairs) == closed
    want = {a: min(b for x, b in closed if x == a and (b, a) in closed) for a in {a for a, b in closed if a == b}}
    assert {r["node"]: r["component"] for r in graph.strong_components(edges).collect()} == want
    nodes = spark.createDataFrame(list(want.items()), "node long, component long")
    paths = {r["component"]: r["path"] for r in graph.witness_cycles(edges, nodes).collect()}
    assert set(paths) == set(want.values())
    none = edges.limit(0)
    assert graph.strong_components(none).count() == graph.witness_cycles(none, nodes.limit(0)).count() == graph.transitive_closure(none).count() == 0
    for component, path in paths.items():
        assert path[0] == path[-1] == component and all(e in set(found) for e in zip(path, path[1:], strict=False))
        assert {want[n] for n in path} == {component} and len(set(path)) == len(path) - 1
        # no shorter cycle leads through the component's smallest node
        reach, steps = {component}, 0
        while True:
            reach, steps = {b for a, b in found if a in reach}, steps + 1
            if component in reach:
                break
        assert steps == len(path) - 1


def test_rounds_of_a_chain(spark):
    """A chain of 2,000 edges is closed in 12 rounds."""
    edges = spark.range(2000).selectExpr("id as src", "id + 1 as dst")
    rounds = []
    found = graph.transitive_closure(edges, each_round=rounds.append)
    assert found.count() == 2000 * 2001 // 2 and len(rounds) <= 12


def test_closure_within_groups(spark):
    edges = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 3, 4)], "p string, src long, dst long")
    assert {tuple(r) for r in graph.transitive_closure(edges, within=["p"]).select("p", "src", "dst").collect()} == {("a", 1, 2), ("a", 2, 3), ("a", 1, 3), ("b", 3, 4)}


def test_reasoner_on_a_chain(spark):
    """Transitive, sub- and chained predicates together give what single steps give, and a start that is closed gives the same."""
    ns = "urn:x:"
    schema = [(ns + "next", reasoner.SUBPROPERTY, ns + "before"), (ns + "before", reasoner.TYPE, reasoner.TRANSITIVE), (ns + "after", reasoner.INVERSE, ns + "before"), (ns + "C0", reasoner.SUBCLASS, ns + "C1"), (ns + "C1", reasoner.SUBCLASS, ns + "C2"), (ns + "before", reasoner.DOMAIN, ns + "C0")]
    schema += [(ns + "uses", reasoner.CHAIN, "_:l1"), ("_:l1", reasoner.FIRST, ns + "before"), ("_:l1", reasoner.REST, "_:l2"), ("_:l2", reasoner.FIRST, ns + "holds"), ("_:l2", reasoner.REST, reasoner.NIL)]
    facts = [(f"{ns}n{k}", ns + "next", f"{ns}n{k + 1}") for k in range(12)] + [(f"{ns}n8", ns + "after", f"{ns}z"), (f"{ns}n12", ns + "holds", f"{ns}tool"), (f"{ns}tool", ns + "before", f"{ns}n3")]

    def frame(rows):
        return spark.createDataFrame([(s, p, o, "iri", "", "") for s, p, o in rows], "s string, p string, o string, o_kind string, o_dt string, o_lang string")

    rules = reasoner.read_schema(frame(schema))
    once = {tuple(r)[:3] for r in reasoner.closure(frame(schema + facts), rules).collect()}
    before = {(a, b) for a, p, b in once if p == ns + "before"}
    direct = {(a, b) for a, p, b in facts if p == ns + "next"} | {(f"{ns}z", f"{ns}n8"), (f"{ns}tool", f"{ns}n3")}
    assert before == reachable(sorted(direct)) and {(b, a) for a, p, b in once if p == ns + "after"} == before
    assert {a for a, p, _ in once if p == ns + "uses"} == {a for a, b in before if b == f"{ns}n12"}
    assert {a for a, p, b in once if p == reasoner.TYPE and b == ns + "C2"} == {a for a, _ in before}
    half = reasoner.closure(frame(schema + facts[:8]), rules)
    assert {tuple(r)[:3] for r in reasoner.closure(frame(facts[8:]), rules, start=half).collect()} == once


# many words in many texts, and routing by postings


def test_hits_of_words(spark):
    rng = random.Random(4)
    words = ["", "a", "ab", "abc", "bc", "边缘", "缘环", "x y", "c", "A"]
    texts = [None, ""] + ["".join(rng.choice(["a", "b", "c", "A", "边", "缘", "环", "x", " ", "y"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(k, w) for k, t in enumerate(texts) for w in words if w and t and w in t}
    listed = spark.createDataFrame([(w,) for w in [*words, "a", None]], "word string")
    for most in (1000, 3):  # one pass, and many
        found = [tuple(r) for r in matching.hits(rows, "id", F.col("text"), listed, most=most).collect()]
        assert len(found) == len(want) and set(found) == want
    assert matching.hits(rows, "id", F.col("text"), listed.limit(0)).columns == ["id", "word"]
    classes = spark.createDataFrame([("bc", "two", 2), ("abc", "three", 1), ("a", "one", 3), ("", "none", 0)], "word string, class string, ord int")
    found = {r["id"]: r["class"] for r in matching.first_classes(rows, "id", F.col("text"), classes).collect()}
    assert found == {k: next(c for w, c in (("abc", "three"), ("bc", "two"), ("a", "one")) if w in t) for k, t in enumerate(texts) if t and ("a" in t or "bc" in t)}
    held = spark.createDataFrame([("abc", "g"), ("缘", "g"), ("zz", "h")], "word string, grp string")
    first = sorted(k for k, t in enumerate(texts) if t and ("abc" in t or "缘" in t))[:3]
    assert [tuple(r) for r in matching.first_hits(rows, "id", F.col("text"), held, "grp", 3).orderBy("id").collect()] == [("g", k) for k in first]


def test_routing_without_pairs(spark):
    """The best item is the same whether all pairs are scored or only candidates, and scores are those of the definition."""
    rng = random.Random(9)
    vocabulary = ["yield", "loss", "edge", "ring", "tool", "lot", "边缘", "良率", "step"]
    items = [(f"i{k:02d}", rng.choice(["in_scope", "out_of_scope"]), [" ".join(rng.sample(vocabulary, rng.choice([1, 2, 3, 4]))) for _ in range(rng.randrange(3))], rng.sample(["A", "B", "C"], rng.randrange(3)), rng.choice([[], ["edge"], ["tool", "lot"]])) for k in range(25)]
    names = [("A", "ring", "e1"), ("A", "tool", "e2"), ("B", "ring", "e3"), ("C", "良率", "e4"), ("C", "zzz", "e5")]
    asked = [(k, " ".join(rng.choices([*vocabulary, "what", "is"], k=rng.randrange(1, 7)))) for k in range(40)] + [(99, None)]
    q = spark.createDataFrame(asked, "qid long, question string")
    i = spark.createDataFrame(items, "id string, bucket string, match_terms array<string>, entity_types array<string>, relations array<string>")
    n = spark.createDataFrame(names, "type string, name string, id string")

    def term_set(text: str) -> set[str]:
        clean = text.replace(" ", "")
        import re

        rest = re.sub("[a-z0-9]+", "", clean)
        return set(re.findall("[a-z0-9]+", clean)) | {rest[k : k + 2] for k in range(len(rest) - 1)}

    want = {}
    for qid, text in asked:
        body = (text or "").replace(" ", "")
        for ident, _, words, types, relations in items:
            whole = [w for w in words if w.replace(" ", "") in body]
            half = [w for w in words if w not in whole and len(term_set(w)) >= 3 and 2 * len(term_set(w) & term_set(text or "")) >= len(term_set(w))]
            anchors = sorted({e for t, name, e in names if t in types and name in body})
            named = [r for r in relations if r in body]
            score = 10.0 * (len(whole) + 0.5 * len(half) + len(named)) + 3.0 * len(anchors)
            if score:
                want[qid, ident] = (score, whole + named, anchors)
    every = questions.scored(q, i, n)
    assert {(r["qid"], r["id"]): (r["score"], r["intent"], r["anchors"]) for r in every.collect()} == want and len(want) > 100
    few = questions.scored(q, i, n, every=False)
    best = [{tuple(r) for r in questions.best(s).select("qid", "id", "score").collect()} for s in (every, few)]
    assert best[0] == best[1] and few.count() < every.count()
    plan = few._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# rules on reports and articles


def test_baseline_failures(spark):
    cases = [
        ("Constraint Violation. Focus Node: <urn:x:node1>", "no node here; Constraint", True), ("Constraint Violation. Focus Node: <urn:x:node1>", "has URN:X:NODE1 in it", False), ("constraint violation, focus node unknown", "any", True),
        ("Focus Node: <urn:x:node1>", "", False), ("Constraint Violation", "", False), (None, "x", False), ("Constraint violation FOCUS NODE: urn:a Focus node:urn:b", "holds urn:b", False), ("Constraint violation Focus Node: urn:a", None, True),
    ]
    rows = spark.createDataFrame([(k, e, c) for k, (e, c, _) in enumerate(cases)], "k int, error string, candidate string")
    found = {r["k"]: r["b"] for r in rows.select("k", predicates.baseline_failure(F.col("error"), F.col("candidate")).alias("b")).collect()}
    assert [found[k] for k in range(len(cases))] == [c[2] for c in cases]


def test_scores_of_articles(spark):
    row = spark.createDataFrame([("首先其次最后综上", 2)], "text string, evidence int").select(predicates.tone(F.col("text")).alias("t"), predicates.factual(F.array().cast("array<string>"), F.col("evidence")).alias("f"), predicates.factual(F.array(F.lit("a"), F.lit("b")), F.col("evidence")).alias("g"), predicates.factual(F.array().cast("array<string>"), F.lit(0)).alias("h")).first()
    assert tuple(row) == (0.6, 1.0, 0.75, 1.0)


def test_repair_fallbacks(spark):
    errors = [(1, "shacl. Focus Node: <urn:x/longname>"), (2, "shacl. Focus Node: <urn:x/otherone>"), (3, "rule broken"), (4, "unclear"), (5, "shacl"), (6, "shacl Focus Node: ab")]
    outputs = [(f"a{k}", k, "semantic_files", f"text {k} longname" if k == 3 else f"text {k}") for k in range(5)]
    found = candidates.repair_targets(spark.createDataFrame(errors, "error_id int, error string"), spark.createDataFrame(outputs, "agent string, ord int, kind string, text string"))
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["error_id"], []).append(r["agent"])
    every, three = [f"a{k}" for k in range(5)], ["a0", "a1", "a2"]
    assert {k: sorted(v) for k, v in got.items()} == {1: ["a3"], 2: three, 3: three, 4: every, 5: every, 6: every}


# rounds, gates and timers


DRIVER = """
import os, sys
sys.path.insert(0, {repo!r})
from weftgraph.session import session
from weftgraph.sources import sinks, tables
from weftgraph.storage import Round
spark = session(2, 2)
stages = [("doubled", lambda d: d.selectExpr("id * 2 as id")), ("even", lambda d: d.where("id % 4 = 0")), ("last", lambda d: os._exit(3))]
Round(spark, {folder!r}, "k").run(lambda: spark.range(100), stages)
"""


def test_a_killed_round_goes_on(spark, tmp_path):
    """The first driver dies in stage three; the second runs that stage alone."""
    folder = str(tmp_path / "round")
    repo = str(Path(__file__).resolve().parent.parent)
    assert subprocess.run([sys.executable, "-c", DRIVER.format(repo=repo, folder=folder)], capture_output=True, timeout=300).returncode == 3
    calls = []

    def stage(name, make):
        def run(rows):
            calls.append(name)
            return make(rows)

        return name, run

    def stages(third="last"):
        return [stage("doubled", lambda d: d.selectExpr("id * 2 as id")), stage("even", lambda d: d.where("id % 4 = 0")), stage(third, lambda d: d.selectExpr("sum(id) as total"))]

    second = Round(spark, folder, "k")
    found = second.run(lambda: spark.range(100), stages())
    assert found.first()[0] == sum(x for x in range(0, 200, 4)) and calls == ["last"] == second.ran
    assert Round(spark, folder, "k").run(lambda: spark.range(100), stages()).count() == 1 and calls == ["last"]
    other = Round(spark, folder, "another")
    assert other.run(lambda: spark.range(10), stages()).first()[0] == 0 + 4 + 8 + 12 + 16 and other.ran == ["doubled", "even", "last"]


def test_gates_of_changed_inputs(spark, tmp_path):
    path, seen = str(tmp_path / "memo"), []

    def rows(*extra):
        return spark.createDataFrame([("a", "x", 1, "ok"), ("a", "y", 2, "ok"), ("b", "x", 1, "bad"), ("c", "x", None, "ok"), ("c", "x", None, "ok"), *extra], "gate string, input string, v int, w string")

    def check(due):
        seen.append(sorted({r["gate"] for r in due.select("gate").collect()}))
        return due.where("w = 'bad'")

    def run(df, **more):
        return {r["gate"]: (r["status"], r["hit"]) for r in changes.checked(df, "gate", check, path, **more).collect()}

    assert run(rows()) == {"a": ("pass", False), "b": ("fail", False), "c": ("pass", False)}
    assert run(rows((None, "x", 1, "bad")).orderBy(F.desc("v"))) == {"a": ("pass", True), "b": ("fail", False), "c": ("pass", True)}
    assert run(rows(("c", "x", None, "ok"))) == {"a": ("pass", True), "b": ("fail", False), "c": ("pass", False)}
    assert run(rows().withColumn("input", F.when(F.col("gate") == "a", "z").otherwise(F.col("input")))) == {"a": ("pass", False), "b": ("fail", False), "c": ("pass", True)}
    assert run(rows(), version="2")["a"] == ("pass", False)
    assert seen == [["a", "b", "c"], ["b"], ["b", "c"], ["a", "b"], ["a", "b", "c"]]
    def broken(due):
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        changes.checked(rows(("d", "x", 1, "ok")), "gate", broken, path)
    assert "d" not in {r["gate"] for r in spark.read.parquet(path).collect()}


def test_watchdog_over_several_runs(spark, tmp_path):
    """Alarms come when the watermark passes them, from events of several runs; an answer in flight holds the age rule back."""
    base = datetime.datetime(2024, 1, 1)

    def write(part: int, found: list[tuple]) -> None:
        rows = [(k, base + datetime.timedelta(minutes=m), s, part * 100 + j) for j, (k, m, s) in enumerate(found)]
        spark.createDataFrame(rows, "k string, ts timestamp, s int, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run() -> set[tuple]:
        stream = events.watchdog(events.source(spark, str(tmp_path / "in")), "k", "ts", F.col("s"), "id", 600, 3600, "1 minute")
        found = events.drained_with_timers(stream, "watch", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        return {(r["k"], r["reason"], (r["opened"] - zero) // 60_000 if r["opened"] >= 0 else -1, (r["due"] - zero) // 60_000) for r in found.collect()}

    zero = int(base.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    up, down = events.UP, events.DOWN
    write(0, [("a", 0, up), ("b", 0, up), ("a", 5, down), ("b", 15, 1), ("c", 3, down), ("a", 12, up), ("tick", 20, up)])
    assert run() == {("c", "disconnected", -1, 13)}
    write(1, [("b", 75, -1), ("a", 30, down), ("tick", 74, up)])
    assert run() == {("c", "disconnected", -1, 13), ("a", "disconnected", 12, 40), ("a", "aged", 12, 72)}
    write(2, [("tick", 90, up)])
    assert run() == {("c", "disconnected", -1, 13), ("a", "disconnected", 12, 40), ("a", "aged", 12, 72), ("b", "aged", 0, 75)}


# schemas of documents, and projection


def test_violations_of_a_schema(spark):
    tag = {"type": "object", "required": ["k"], "properties": {"k": {"enum": ["a", "b", 1]}, "sub": {"type": "array", "items": {"$ref": "#/$defs/tag"}}}, "additionalProperties": False, "oneOf": [{"required": ["k"], "not": {"required": ["z"]}}]}
    schema = {"type": "object", "required": ["id", "tags"], "properties": {"id": {"type": "string", "pattern": "^s[a-z0-9]+$"}, "n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/tag"}}, "d": {"type": "string", "format": "date"}}, "additionalProperties": {"type": "string", "maxLength": 2}, "$defs": {"tag": tag}}
    cases = {
        '{"id": "sa", "tags": [{"k": "a"}, {"k": 1}], "n": 2.0, "d": "2024-02-29"}': [],
        '{"id": "X", "n": 0, "tags": []}': ["$.id pattern", "$.n minimum", "$.tags minItems"],
        "nope": ["$ json"],
        '{"id": 5, "tags": [{"k": "c", "y": 1, "sub": [{"k": "a"}, {"k": 1.5, "q": null}]}, 7], "d": "2024-13-01", "more": "abc", "less": 3}': ["$.d format", "$.id type", "$.less type", "$.more maxLength", "$.tags[0].k enum", "$.tags[0].sub[1].k enum", "$.tags[0].sub[1].q additionalProperties", "$.tags[0].y additionalProperties", "$.tags[1] type"],
        '{"id": "sa", "n": 2.5, "tags": [{}]}': ["$.n type", "$.tags[0] oneOf", "$.tags[0] required"],
        "[]": ["$ type"],
        None: ["$ json"],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    found: dict[int, list[str]] = {k: [] for k in range(len(cases))}
    for r in json_schema.violations(rows, "id", "text", schema).collect():
        found[r["id"]].append(f"{r['path']} {r['rule']}")
    assert [sorted(v) for v in found.values()] == [sorted(v) for v in cases.values()]
    assert json_schema.violations(rows.limit(0), "id", "text", schema).count() == 0
    for bad in ({"allOf": []}, {"properties": {"a": {"$ref": "other.json"}}}, {"oneOf": [{"type": "string"}]}, {"format": "email"}):
        with pytest.raises(ValueError):
            json_schema.Compiled(bad)


def test_node_names(spark):
    from urllib.parse import quote

    ids = ["a b", "x/y", "é漢", "a*b", "~t", "p.q_r-s", "100%", "a+b", ""]
    found = spark.createDataFrame([(i,) for i in ids], "id string").select("id", projection.node("urn:x:", "catalog", F.col("id")).alias("n")).collect()
    assert {r["id"]: r["n"] for r in found} == {i: f"urn:x:catalog:{quote(i, safe='._-')}" for i in ids}


# gates around a graph


def test_whole_groups(spark):
    """Groups that lack a predicate, have two values of the single one or a target of a wrong type go; the rest stays."""
    group = {"d": "Anomaly", "c": None, "a": "Action"}
    rows = [("ok", "d", "x"), ("ok", "d", "x"), ("ok", "c", "1"), ("ok", "c", "2"), ("ok", "a", "elsewhere"), ("two", "d", "x"), ("two", "d", "y"), ("two", "c", "1"), ("two", "a", "z")]
    rows += [("wrong", "d", "y"), ("wrong", "c", "1"), ("wrong", "a", "x"), ("half", "c", "1"), ("half", "name", "n"), ("half", None, "q"), ("none", "name", None), (None, "d", "x"), ("late", "d", "x"), ("late", "c", "1"), ("late", "a", "x")]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    declared = spark.createDataFrame([("x", ["Anomaly"]), ("x", ["Other"]), ("y", []), ("z", ["Action"]), (None, ["Anomaly"])], "node string, types array<string>")
    kept, removed = candidates.whole_groups(triples, declared, group, "d")
    assert {r["s"]: r["reason"] for r in removed.collect()} == {
        "two": "more than one d", "wrong": "a target of d is no Anomaly", "late": "a target of a is no Action", "half": "has 1 of 3", None: "has 1 of 3",
    }
    left = {(r["s"], r["p"]) for r in kept.collect()}
    assert {x for x in left if x[0] is not None} == {("ok", "d"), ("ok", "c"), ("ok", "a"), ("half", "name"), ("half", None), ("none", "name")}
    assert candidates.whole_groups(triples.limit(0), declared, group, "d")[1].count() == 0


def test_counts_that_fell(spark):
    before = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    after = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",)], "k string")
    assert sorted(map(tuple, checks.shrunk(before, after, "k").collect()), key=repr) == [("a", 2, 1), (None, 2, 1)]
    assert checks.shrunk(before.limit(0), after, "k").count() == 0


def test_export_keeps_files_small(spark, tmp_path, monkeypatch):
    """A table whose file is too large for one digest is dealt into more files with the same rows."""
    monkeypatch.setattr(sinks, "FILE_BYTES", 4000)
    tables_ = {"large": spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("h")).coalesce(1), "small": spark.range(3).coalesce(1), "empty": spark.range(0)}
    manifest = sinks.export(spark, tables_, str(tmp_path)).collect()
    files = [r for r in manifest if "/large/" in r["path"]]
    assert len(files) > 20 and sum("/small/" in r["path"] for r in manifest) == 1
    for r in files[:5]:
        assert hashlib.sha256(Path(r["path"].removeprefix("file:")).read_bytes()).hexdigest() == r["sha256"]
    back = spark.read.parquet(f"{tmp_path}/large")
    assert back.count() == back.distinct().count() == 20_000


def test_profile_of_a_file_read_in_pieces(spark, tmp_path):
    """The first row of a large file is its first one, whichever piece is read first; a column may start with nulls."""
    rows = spark.range(4000).select(F.when(F.col("id") < 5, None).otherwise(F.concat(F.lit("e"), "id")).alias("equipment"), F.col("id").alias("other")).coalesce(1)
    rows.write.option("header", True).csv(f"{tmp_path}/d")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        found = tables.profiles(spark, f"{tmp_path}/d").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert [(r["rows"], r["equipment"], r["phase"]) for r in found] == [(4000, "e5", None)]
