"""Findings of the third round: each test would have failed before its change."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pytest
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.operators import aggregates, candidates, changes, graph, joins, json_schema, projection, reasoner, rules
from weftgraph.operators.rules import Rule
from weftgraph.schemas import PROVENANCE
from weftgraph.sources import turtle
from weftgraph.storage import stored

TRIPLE = "s string, p string, o string, o_kind string, o_dt string, o_lang string"


def test_variables_that_nothing_reads_make_no_rows(spark):
    """Two thousand signals and as many repairs of one tool would be four million solutions; the rule reads two of its variables."""
    rows = [("a", "tool", "t"), ("b", "tool", "u"), ("x", "log", "l")]
    rows += [("a", "signal", f"s{k}") for k in range(2000)] + [(f"r{k}", "mends", "t") for k in range(2000)] + [(f"r{k}", "log", f"l{k % 2}") for k in range(2000)]
    triples = stored(spark.createDataFrame([(f"urn:{s}", f"urn:{p}", f"urn:{o}", "iri", "", "") for s, p, o in rows], TRIPLE), "triples")
    where = [("?a", "signal", "?signal"), ("?a", "tool", "?tool"), ("?repair", "mends", "?tool"), ("?repair", "log", "?log")]
    rule = Rule("R-LOG", [("?a", "log", "?log")], where)
    found = rules.solutions(triples, rule, "urn:")
    assert sorted(found.columns) == ["?a", "?log"] and sorted((r["?a"]["v"], r["?log"]["v"]) for r in found.collect()) == [("urn:a", "urn:l0"), ("urn:a", "urn:l1")]
    # a filter's variables stay, and a new node is named by the whole solution
    kept = rules.solutions(triples, Rule("R-F", [("?a", "x", "?log")], where, filter=lambda v: v("?repair") != "urn:r0"), "urn:")
    assert sorted(kept.columns) == ["?a", "?log", "?repair"] and kept.count() == 1999
    assert rules.constructed(triples, Rule("R-N", [("_:n", "of", "?a")], where[1:]), "urn:").count() == 2000


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_causes_of_cases_are_not_broadcast(spark):
    """A case is one row of a small file with many causes: the plan must not send what they state to all tasks."""
    cases = spark.range(4).selectExpr("id as anomaly_ref", "transform(sequence(0L, 9L), s -> struct(s as cause_ref, if(id = 3, null, 'high') as likelihood)) as possible_causes")
    edges = spark.createDataFrame([(1, 1, "low"), (2, 3, "low"), (77, 1, None)], "src long, dst long, likelihood string")
    found = joins.case_likelihood(edges, stored(cases, "cases"))
    assert "Broadcast" not in _plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, 1, "high", 0), (2, 3, "low", 2), (77, 1, None, 3)}


def test_models_are_joined_to_a_text_once(spark):
    entities = spark.createDataFrame([("a", (["x", "y"],)), ("b", ([],)), ("c", None)], "id string, economic_hooks struct<affects:array<string>>")
    models = spark.createDataFrame([("m2",), ("m1",), ("m2",)], "id string")
    found = aggregates.proposals(entities, models, ",")
    assert "array_join" not in _plan(found) and [tuple(r) for r in found.collect()] == [("a", ["x", "y"], "m1,m2")]
    assert [tuple(r) for r in aggregates.proposals(entities, models).collect()] == [("a", ["x", "y"], ["m1", "m2"])]


def test_copied_agents_are_not_broadcast(spark):
    """Agents copied to each part are many rows of few bytes."""
    errors = spark.createDataFrame([(1, "unclear"), (2, "business model failed"), (3, "SHACL failed. Focus Node: <Node12>")], "error_id int, error string")
    outputs = spark.createDataFrame([(f"a{k}", k, kind, "Node12" if k % 2 else "") for k in range(6) for kind in ("semantic_files", "business_files")], "agent string, ord int, kind string, text string")
    found = candidates.repair_targets(errors, outputs)
    assert _plan(found).count("ShuffledHashJoin") == 2
    assert sorted(tuple(r) for r in found.collect()) == [(1, f"a{k}") for k in range(6)] + [(2, f"a{k}") for k in range(6)] + [(3, f"a{k}") for k in (1, 3, 5)]


def test_long_turtle_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """Rows of a long file come a few at a time, none if it has a fault at its end; written files are short."""
    text = "@prefix w: <urn:w:> .\n" + "".join(f"w:s{k} w:p w:o{k % 7} , [ w:q {k} ] .\n" for k in range(1000))
    whole = turtle.parsed(text, "f")
    assert len(whole) == 3000 and isinstance(turtle._Reader(text, "f").tokens, Iterator)
    monkeypatch.setattr(turtle, "LONG", 100)
    monkeypatch.setattr(turtle, "PIECE", 50)
    pieces = list(turtle._pieces(text.encode(), "f"))
    assert [row for piece in pieces for row in piece] == whole and max(map(len, pieces)) < 60
    with pytest.raises(turtle.TurtleError):
        next(turtle._pieces((text + "w:a w:b .").encode(), "f"))
    quads = spark.range(220).coalesce(1).selectExpr("'' as g", "concat('urn:', id) as s", "'urn:p' as p", "'x' as o", "'literal' as o_kind", "'' as o_dt", "'' as o_lang")
    turtle.write(quads, str(tmp_path / "q"))
    assert len(list((tmp_path / "q").glob("part-*"))) == 5


def test_nodes_of_intervals_are_not_broadcast(spark):
    """Nodes and points of intervals are many times the rows of the files that they come from."""
    rows = spark.range(20).selectExpr("id % 2 as k", "timestamp_seconds(id * 60) as start", "timestamp_seconds(id * 60 + 90) as end", "id")
    found = joins.interval_overlap(stored(rows, "a"), stored(rows, "b"), ["k"])
    assert "Broadcast" not in _plan(found) and found.count() == 20


def test_overlaps_are_counted_without_pairs(spark, monkeypatch):
    """Equal, reversed, open and unknown ends against all pairs; the tree's highest level is below the rows."""
    dice = random.Random(3)
    sides = [[(k % 2, dice.choice([None, *range(12)]), dice.choice([None, 99, *range(12)]), k) for k in range(90)] for _ in range(2)]
    a, b = (spark.createDataFrame(rows, "k int, s int, e int, id int").selectExpr("k", "id", "timestamp_seconds(s) as start", "timestamp_seconds(e) as end") for rows in sides)
    want = {}
    for k, s, e, i in sides[0]:
        met = [r for r in sides[1] if None not in (s, e, r[1], r[2]) and r[0] == k and s < r[2] and r[1] < e]
        if met:
            want[k, i] = (len(met), sum(r[1] == r[2] for r in met))
    monkeypatch.setattr(joins, "TOP", 3)
    found = joins.overlap_counts(a, b, ["k"], ["id"], {"points": "start = end"}).groupBy("k", "id").agg(F.sum("n").alias("n"), F.sum("points").alias("p")).where("n > 0")
    assert "Join" not in _plan(found) and {(r["k"], r["id"]): (r["n"], r["p"]) for r in found.collect()} == want


def test_values_with_equal_others_are_one(spark):
    """Forty tools of the same fifty logs are joined as one tool, and tools go after repairs; terms that differ in kind stay apart."""
    rows = [(f"r{k}", "mends", f"t{k % 40}", "iri") for k in range(400)] + [(f"r{k}", "log", f"l{j}", "iri") for k in range(400) for j in range(50)]
    rows += [(f"a{k}", "tool", f"t{k % 40}", "iri") for k in range(80)] + [("r0", "log", "l0", "literal"), ("x", "tool", "t99", "iri"), ("a7", "seen", "s", "iri"), ("l9", "a", "Log", "iri")]
    triples = stored(spark.createDataFrame([(f"urn:{s}", f"urn:{p}", o if kind == "literal" else f"urn:{o}", kind, "", "") for s, p, o, kind in rows], TRIPLE), "triples")
    where = [("?a", "tool", "?tool"), ("?repair", "mends", "?tool"), ("?repair", "log", "?log")]
    rule = Rule("R-LOG", [("?a", "log", "?log")], where)
    found = rules.solutions(triples, rule, "urn:")
    pairs = {(r["?a"]["v"], r["?log"]["v"]) for r in found.collect()}
    assert pairs == {(f"urn:a{k}", f"urn:l{j}") for k in range(80) for j in range(50)} | {("urn:a0", "l0"), ("urn:a40", "l0")} and found.count() == len(pairs)
    numbers = [(spark.range(400).selectExpr("id as `?repair`", "id % 40 as `?tool`")), spark.range(20_000).selectExpr("id div 50 as `?repair`", "id % 50 as `?log`")]
    assert sorted(r.count() for r in rules._alike(numbers, "?repair")) == [40, 2000]
    made = rules.constructed(triples, rule, "urn:")
    assert "HashAggregate" not in _plan(made) and made.count() == len(pairs)
    # as the subject, a literal and a node of one text make one triple
    turned = rules.constructed(triples, Rule("R-T", [("?log", "of", "?repair")], [("?repair", "log", "?log")]), "urn:")
    assert turned.count() == turned.distinct().count() == 20001


def test_triples_of_many_subjects_are_dealt_by_their_number(spark, monkeypatch):
    """Rows that are few bytes are not left in few tasks."""
    rows = stored(spark.range(1000).selectExpr("concat('o:', id) as s", "'t' as p", "if(id % 3 = 0, 'E', 'O') as o"), "triples")
    assert storage.dealt(rows, "s", each=100).rdd.getNumPartitions() == 10 and storage.dealt(rows.limit(0), "s", each=100).count() == 0
    a, b = changes.split_provenance(rows, ["E"], "t")
    assert all("REPARTITION_BY_NUM" in _plan(d) for d in (a, b)) and (a.count(), b.count()) == (666, 334)


def test_quads_are_made_where_their_records_are_dealt(spark):
    """Two types are no key to deal by, and quads are not dealt again once they are made; equal records give each quad once."""
    none = F.lit(None).cast("string")
    edges = spark.range(100).selectExpr("concat('a', id % 50) as src", "if(id % 2 = 0, 'r', 'x y') as rel_type", "'b' as dst", "'f' as _file").withColumns({"note": F.when(F.rand(1) < 2, "n"), "likelihood": none, "field": none, "provenance": F.lit(None).cast(PROVENANCE)})
    found = projection.relation_quads(stored(edges, "edges"), spark.createDataFrame([("r", "urn:r")], "rel_type string, predicate string"), "urn:")
    plan = _plan(found)
    assert "SortMergeJoin" not in plan and plan.count("REPARTITION_BY_NUM") == 2
    assert found.count() == found.distinct().count() == 50 + 50 * 6
    entities = spark.range(100).selectExpr("concat('a', id % 50) as id", "if(id % 2 = 0, 'T', 'U') as type", "'n' as name_zh", "'f' as _file", "array('q', null) as aliases", "map('k', 'v') as attributes").withColumns({c: none for c in ("name_en", "description", "unit", "severity")} | {"provenance": F.lit(None).cast(PROVENANCE)})
    quads = projection.entity_quads(stored(entities, "entities"), spark.createDataFrame([("T", "urn:T")], "type string, class string"), "urn:")
    assert _plan(quads).count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in _plan(quads)
    assert quads.count() == quads.distinct().count() == 50 * (6 + 3) + 25


def test_chains_are_counted_without_pairs(spark, monkeypatch):
    """Three thousand nodes in a chain would be four and a half million pairs, twice; forks are closed, rings and chains aren't."""
    chain = [("a", f"c{k}", f"c{k + 1}") for k in range(40)] + [("a", "x", "y"), ("a", "y", "z"), ("a", "z", "x"), ("a", "l", "l")]
    forks = [("a", "f", "g"), ("a", "f", "h"), ("a", "h", "i"), ("a", "g", "i"), ("b", "f", "g"), ("b", "g", "c1"), ("b", "m", "m"), ("b", "m", "n")]
    for rows in (chain, chain + forks):
        edges = spark.createDataFrame(rows, "g string, src string, dst string")
        pairs = graph.transitive_closure(edges, within=["g"])
        sides = [pairs.groupBy("g", F.col(c).alias("node")).count() for c in ("src", "dst")]
        expected = {(r[0], r[1], r[2] or 0, r[3] or 0) for r in sides[0].join(sides[1].withColumnRenamed("count", "before"), ["g", "node"], "full").collect()}
        found = [tuple(r) for r in graph.reach_counts(edges, within=["g"]).collect()]
        assert len(found) == len(set(found)) and set(found) == expected
    monkeypatch.setattr(graph, "transitive_closure", None)
    long = spark.range(3000).selectExpr("id as src", "id + 1 as dst")
    assert all(r["after"] == 3000 - r["node"] and r["before"] == r["node"] for r in graph.reach_counts(long).collect())


def test_closed_predicates_are_counted(spark):
    """Counts are those of the closure, whether the schema lets them be made without it or not."""
    before, follows, zone = "urn:before", "urn:follows", "urn:zone"
    rows = [("a", before, "b"), ("c", follows, "b"), ("c", before, "d"), ("a", zone, "z"), ("q", "urn:other", "r"), ("d", zone, "w")]
    triples = spark.createDataFrame([*[(s, p, o, "iri", "", "") for s, p, o in rows], ("a", before, "text", "literal", "", "")], TRIPLE)
    base = [(before, reasoner.TYPE, reasoner.TRANSITIVE), (follows, reasoner.INVERSE, before), (before, reasoner.DOMAIN, "urn:Start"), ("urn:other", reasoner.SUBPROPERTY, before)]
    chain = [(zone, reasoner.CHAIN, "_:1"), ("_:1", reasoner.FIRST, before), ("_:1", reasoner.REST, "_:2"), ("_:2", reasoner.FIRST, zone), ("_:2", reasoner.REST, reasoner.NIL)]
    for more in ([], chain):
        schema = reasoner.read_schema(spark.createDataFrame([(s, p, o, "iri", "", "") for s, p, o in base + more], TRIPLE))
        every = reasoner.closure(triples, schema)
        rest, counts = reasoner.counted(triples, schema)
        wide = {r["p"] for r in counts.collect()}
        assert {before, follows} <= wide and sorted(map(tuple, rest.collect())) == sorted(map(tuple, every.where(~F.col("p").isin(*wide)).collect()))
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, every.where(F.col("p").isin(*wide)).groupBy("s", "p").count().collect()))


def test_documents_are_dealt_and_typed_once(spark, monkeypatch):
    """Texts of few bytes are many values: a level is written in parts by the number of documents, and a value's schema is made once."""
    levels = []

    def seen(df, name):
        out = stored(df, name)
        if name == "level":
            levels.append((len(out.inputFiles()), len(re.findall(r"schemaOfVariant\(|schema_of_variant\(", df._jdf.queryExecution().optimizedPlan().toString()))))
        return out

    monkeypatch.setattr(json_schema, "stored", seen)
    monkeypatch.setattr(json_schema, "EACH", 20)
    documents = spark.range(200).selectExpr("id", "concat('{\"a\": [', id, ', 1.0, null, \"x\"]}') as text").coalesce(1)
    found = json_schema.violations(documents, "id", "text", {"type": "object", "properties": {"a": {"type": "array", "items": {"type": ["integer", "null"]}}}, "additionalProperties": False})
    assert sorted((r["id"], r["path"]) for r in found.collect()) == [(k, "$.a[3]") for k in range(200)]
    assert levels[0] == (10, 1)


def test_pruned_triples_are_dealt_by_rows(spark, monkeypatch):
    """Values are counted in parts by the number of triples, not by compressed bytes."""
    plans = {}

    def seen(df, name):
        plans.setdefault(name, []).append(_plan(df))
        return stored(df, name)

    monkeypatch.setattr(graph, "stored", seen)
    monkeypatch.setattr(graph, "EACH", 40)
    triples = spark.range(200).selectExpr("concat('o', id div 4) as s", "'line' as p", "concat('l', if(id < 4, 0, id)) as o").unionByName(spark.range(50).selectExpr("'c' as s", "'placed' as p", "concat('o', id) as o"))
    subjects = spark.range(50).selectExpr("concat('o', id) as s", "'Order' as type").union(spark.createDataFrame([("c", "Customer")], "s string, type string"))
    kept, gone = graph.pruned(triples, subjects, spark.createDataFrame([("Order", "line", 4), ("Customer", "placed", 49)], "type string, p string, least int"))
    assert [r["s"] for r in gone.collect()] == ["o0"] and kept.count() == 196 + 49
    assert "REPARTITION_BY_NUM" in plans["short"][0]


def test_turtle_files_are_parsed_once_and_quads_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Quads and issues come from what was parsed once; quads that are alike are few bytes of many rows, which would go to one task."""
    (tmp_path / "a.ttl").write_text("".join(f"<urn:s{k}> <urn:p> <urn:o> .\n" for k in range(100)))
    (tmp_path / "b.ttl").write_text("<urn:s1> <urn:p> <urn:o> .\n<urn:s2> <urn:q> <urn:o> .\n")
    (tmp_path / "c.ttl").write_text("<urn:s1> <urn:p>")
    monkeypatch.setattr(turtle, "EACH", 10, raising=False)
    quads, issues = turtle.read(spark, f"{tmp_path}/*.ttl")
    assert "MapInArrow" not in _plan(quads) and "MapInArrow" not in _plan(issues)
    assert quads.rdd.getNumPartitions() == 11 and quads.count() == 101 and issues.count() == 1


def test_levels_of_the_interval_join_follow_the_rows_of_a_key(spark, monkeypatch):
    """Two thousand keys of two rows each need no tree over time; one key of as many rows still does, and pairs stay the same."""
    tops = []

    class Spy(str):
        def format(self, top):
            tops.append(top)
            return super().format(top=top)

    monkeypatch.setattr(joins, "_COVER", Spy(joins._COVER))
    when = lambda seconds: f"timestamp_seconds(1700000000 + {seconds})"
    each, all_ = "id as k", "1L as k"
    near = sum(1 for a in range(2000) for b in range(max(0, a - 11), min(2000, a + 11)) if -10000 < b * 1000 + 500 - a * 1000 < 10000)
    for key, pairs in ((each, 2000), (all_, near)):
        left, right = (spark.range(2000).selectExpr("id", key, f"{when(f'id * 1000 + {d}')} as start", f"{when(f'id * 1000 + {d} + 10000')} as end") for d in (0, 500))
        assert joins.interval_overlap(left, right, ["k"]).count() == pairs
    assert max(tops[:2]) <= 2 and min(tops[2:]) >= 4


def test_playbooks_are_dealt_by_rows(spark, monkeypatch):
    """Triples that are alike are few bytes of many rows: the parts in which a playbook's meet follow their number."""
    monkeypatch.setattr(candidates, "EACH", 20, raising=False)
    type_, label = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "urn:label"
    rows = [(f"o{k}", p, o, "iri", "", "") for k in range(40) for p, o in ((type_, "urn:DiagnosticPlaybook"), ("urn:hasPossibleCause", f"c{k % 3}"), ("urn:hasPossibleCause", "c9"))]
    found = candidates.appended_playbooks(spark.createDataFrame([("o1",)], "id string"), spark.createDataFrame(rows, TRIPLE), "urn:", label)
    assert found.rdd.getNumPartitions() == 6 and found.count() == 39 and all(r["cause_refs"] == [f"c{int(r['id'][1:]) % 3}", "c9"] for r in found.collect())
    made = spark.createDataFrame([(f"o{k}", p, o, "iri", "", "") for k in range(40) for p, o in (("d", f"c{k % 4}"), ("r", "act"))], TRIPLE)
    kept, removed = candidates.whole_groups(made, spark.createDataFrame([("c0", ["B"]), ("c1", ["A"])], "node string, types array<string>"), {"d": "A", "r": None}, "d")
    assert kept.rdd.getNumPartitions() == 4 and {r["s"] for r in removed.collect()} == {f"o{k}" for k in range(0, 40, 4)} and kept.count() == 60


def test_new_triples_are_dealt_by_rows(spark, monkeypatch):
    """What a rule makes is compared with triples of its predicate alone, in parts that follow their number."""
    monkeypatch.setattr(rules, "EACH", 10, raising=False)
    rows = [(f"urn:a{k}", "urn:p", f"urn:b{k}", "iri", "", "") for k in range(60)] + [(f"urn:b{k}", "urn:q", f"urn:a{k}", "iri", "", "") for k in range(20)]
    parts = []
    monkeypatch.setattr(rules, "stored", lambda df, name: parts.append((name, df.rdd.getNumPartitions())) or stored(df, name))
    every, fired = rules.run(spark.createDataFrame(rows, TRIPLE), [Rule("R-Q", [("?b", "q", "?a")], [("?a", "p", "?b")])], "urn:")
    assert fired == {"R-Q": 40} and every.count() == 120 and [n for name, n in parts if name == "rules"] == [8, 8]
