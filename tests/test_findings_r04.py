"""Findings of the fourth round: each test would have failed before its change."""

from __future__ import annotations

from hashlib import sha256

from weftgraph import plans
from weftgraph.operators import candidates, graph, rules
from weftgraph.operators.reasoner import TYPE
from weftgraph.operators.rule_catalog import catalog
from weftgraph.operators.rules import Lit, Rule
from weftgraph.storage import stored

TRIPLE = "s string, p string, o string, o_kind string, o_dt string, o_lang string"


def test_relations_are_made_of_all_lines(spark, tmp_path):
    """Lines of small and of unknown quantities count as others do."""
    rows = [(1, 2, "N", 1.0), (1, 3, "R", 45.0), (2, 4, "A", None), (2, 4, "A", 50.0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = plans.queries()["relation_quads"](spark, str(tmp_path))
    related = found.where("g like '%graph:relations'").collect()
    assert len({r["s"] for r in related}) == 2 and len(related) == 3
    assert "l_quantity" not in plans.oracle_sql()["relation_quads"]


def test_a_variable_is_taken_out_within_its_neighbours(spark, monkeypatch):
    """Orders and customers of one year are no pairs to make where the rule has the orders of each customer."""
    rows = [(f"urn:c{k}", "urn:placed", f"urn:{o}{k}", "iri") for k in range(60) for o in "fp"]
    rows += [(f"urn:{o}{k}", "urn:status", o, "literal") for k in range(60) for o in "fp"] + [(f"urn:{o}{k}", "urn:year", f"y{k % 2 if k else o}", "literal") for k in range(60) for o in "fp"]
    triples = stored(spark.createDataFrame([(*row, "", "") for row in rows], TRIPLE), "triples")
    where = [("?c", "placed", "?o"), ("?o", "status", Lit("f")), ("?o", "year", "?y"), ("?c", "placed", "?q"), ("?q", "status", Lit("p")), ("?q", "year", "?y")]
    sizes = []

    def seen(df, name):
        out = stored(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(rules, "stored", seen)
    found = rules.constructed(triples, Rule("R-PAIR", [("?c", "hasPair", "?o")], where), "urn:")
    assert sorted((r["s"], r["o"]) for r in found.collect()) == sorted((f"urn:c{k}", f"urn:f{k}") for k in range(1, 60))
    assert max(n for name, n in sizes if name == "relation") <= 120


def _made_once(df) -> bool:
    """Whether triples are made of solutions, first of all in the plan, and not told apart after that."""
    return "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_minted_chains_are_not_told_apart(spark):
    """An alarm of two tools gives one chain about both; texts with the sign that parts them are told apart as before."""
    rule = next(r for r in catalog("urn:") if r.mint_apart)
    for bar in ("", "|"):
        alarms = [(f"a{bar}{k}", f"t{j}") for k in range(3) for j in (0, k % 2)]
        rows = [(n, p, o) for n, tool in alarms for p, o in (("type", "AlarmEvent"), ("affectsEquipment", tool))]
        rows += [(n, p, o) for k in range(4) for n, tool in ((f"d{k}", f"t{k % 2}"), (f"d{k}", "t1")) for p, o in (("type", "EquipmentDowntimeAnomaly"), ("affectsEquipment", tool))]
        rows += [(f"r{k}", p, o) for k in range(4) for p, o in (("type", "CorrectiveMaintenanceEvent"), ("affectsEquipment", f"t{k % 2}"), ("affectsEquipment", "t1"), ("correlatesMaintenanceLogEvidence", "l0"), ("correlatesMaintenanceLogEvidence", f"l{k}"))]
        triples = stored(spark.createDataFrame([(f"urn:{s}", TYPE if p == "type" else f"urn:{p}", f"urn:{o}", "iri", "", "") for s, p, o in dict.fromkeys(rows)], TRIPLE), "triples")
        made = rules.constructed(triples, rule, "urn:")
        want = set()
        of = lambda p: {(s, o) for s, q, o in rows if q == p}
        tools, logs = of("affectsEquipment"), of("correlatesMaintenanceLogEvidence")
        for a, t in tools:
            for d, r in ((d, r) for d, x in tools for r, y in tools if a[0] == "a" and d[0] == "d" and r[0] == "r" and t == x == y):
                for log in (o for s, o in logs if s == r):
                    chain = "urn:derived:eqp-correlation:" + sha256("|".join(f"urn:{x}" for x in (a, d, r, log)).encode()).hexdigest()
                    want |= {(chain, TYPE, "urn:EQPAlarmMaintenanceCorrelationRecord"), (chain, "urn:aboutEntity", f"urn:{t}"), (chain, "urn:integratesEvidenceFrom", f"urn:{log}")}
        found = [(r["s"], r["p"], r["o"]) for r in made.collect()]
        assert len(found) == len(set(found)) and set(found) == want
        assert _made_once(made) == (not bar)


def test_triples_of_new_nodes_are_not_told_apart(spark):
    """A new node names its solution: equal triples are of one solution alone; edges that solutions share are told apart."""
    rows = [("a", "p", "b", "iri"), ("a", "p", "a", "iri"), ("c", "p", "b", "iri"), ("b", "q", "x", "iri"), ("b", "q", "y", "iri"), ("a", "q", "x", "iri")]
    where, heads = [("?s", "p", "?o"), ("?o", "q", "?v")], [("_:n", "of", "?s"), ("_:n", "of", "?o"), ("_:n", "a", "Thing"), ("?s", "knows", "?o")]
    for more in ([], [("b", "q", "x", "literal")]):  # a node and a literal of one text name one node
        triples = stored(spark.createDataFrame([(f"urn:{s}", f"urn:{p}", f"urn:{o}", kind, "", "") for s, p, o, kind in rows + more], TRIPLE), "triples")
        made = rules.constructed(triples, Rule("R-N", heads, where), "urn:")
        found = [tuple(r) for r in made.collect()]
        assert len(found) == len(set(found)) == 5 * 2 + 4 + 3
        assert _made_once(made) == (not more)


def test_pairs_of_chains_are_not_stored(spark, monkeypatch):
    """Pairs of chains come as they are read, in parts that follow their number; rings and forks are closed by paths."""
    names = []

    def seen(df, name):
        out = stored(df, name)
        names.append((name, out.count()))
        return out

    monkeypatch.setattr(graph, "stored", seen)
    monkeypatch.setattr(graph, "BLOCK", 8, raising=False)
    monkeypatch.setattr(graph, "PAIRS", 100, raising=False)
    chains = [("a", k, k + 1) for k in range(60)] + [("b", k, k + 1) for k in range(17)] + [("b", 100, 101)]
    want = {("a", i, j) for i in range(61) for j in range(i + 1, 61)} | {("b", i, j) for i in range(18) for j in range(i + 1, 18)} | {("b", 100, 101)}
    schema = "g string, src long, dst long"
    found = graph.transitive_closure(spark.createDataFrame([*chains, *chains[:3], ("a", None, 5)], schema), within=["g"])
    assert found.columns == ["g", "src", "dst"] and found.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert not {"closure", "power"} & {name for name, _ in names} and max(n for _, n in names) <= 81
    ring = [("b", 7, 7), ("c", 1, 2), ("c", 2, 3), ("c", 3, 1)]
    rings = {("c", i, j) for i in (1, 2, 3) for j in (1, 2, 3)}
    assert sorted(map(tuple, graph.transitive_closure(spark.createDataFrame(chains + ring[1:], schema), within=["g"]).collect())) == sorted(want | rings)
    forked = {tuple(r) for r in graph.transitive_closure(spark.createDataFrame(chains + ring, schema), within=["g"], reflexive=True).collect()}
    assert {r for r in forked if r[1] != r[2]} == {r for r in want | rings if r[1] != r[2]}


def test_errors_meet_agents_in_blocks(spark, monkeypatch):
    """One key of many rows on both sides is dealt to many parts, and each row meets each of its key once."""
    monkeypatch.setattr(candidates, "BLOCK", 4)
    monkeypatch.setattr(candidates, "PAIRS", 100)
    left = spark.createDataFrame([(k % 3 if k % 3 else 1, k % 50) for k in range(60)], "ask long, error_id int")
    right = spark.createDataFrame([(k % 2, f"a{k}") for k in range(40)], "ask long, agent string")
    found = candidates.crossed(left, right)
    want = [(e["error_id"], a["agent"]) for e in left.collect() for a in right.collect() if e["ask"] == a["ask"]]
    assert sorted(map(tuple, found.collect())) == sorted(want) and found.rdd.getNumPartitions() >= 8
    assert sum(1 for n in found.rdd.glom().map(len).collect() if n) >= 4
    assert candidates.crossed(left.limit(0), right).count() == 0
