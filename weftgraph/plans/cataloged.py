"""The rule catalogue over triples made of parts; the SQL joins the same patterns in DuckDB.

Every variable of a rule stands for an id made of a part's key, and every pattern holds for most parts only, so that some
solutions lack a triple, and what a rule must not find is there for a fourth of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import rules
from weftgraph.operators.reasoner import TYPE
from weftgraph.operators.rule_catalog import SYSTEMATIC, SYSTEMATIC_TEXT, catalog
from weftgraph.operators.rules import STATEMENT, Iri, Lit, Rule
from weftgraph.plans.registry import ORACLES, QUERIES, table
from weftgraph.storage import stored

NS = "urn:fab:"
#: Values of variables that filters read, by part key; the rest are ids.
VALUES = {
    "?flag": ["TRUE", "false", "1", "0"], "?conforms": ["False", "true"], "?warnings": ["0", "3", "none"], "?code": ["Edge ring", "random", "CENTER"], "?words": ["am 边缘", "nothing", "reticle"],
    "?source": ["urn:fab:sixsense", "urn:fab:Telemetry9", "urn:fab:mes"],
    "?from1": ["2024-01-01T00:00:00", "2024-01-01T01:00:00", "2024-01-01T02:30:00", "2024-01-01T02:00:00", "2024-01-01T06:30:00"],
    "?to1": ["2024-01-01T02:00:00", "2024-01-01T01:30:00", "2024-01-01T05:00:00", "2024-01-01T02:00:00", "9999-12-31T00:00:00"],
    "?from2": ["2024-01-01T01:45:00", "2024-01-01T06:00:00", "2024-01-01T03:00:00"], "?to2": ["2024-01-01T03:00:00", "9999-12-31T00:00:00", "2024-01-01T03:00:00"],
}
#: The filters of rules in SQL.
FILTERS = {
    "R-INF-003": "v_from1::TIMESTAMP < v_to2::TIMESTAMP AND v_from2::TIMESTAMP < v_to1::TIMESTAMP",
    "R-AUTO-RELEASE-GATE-BLOCKING-FINDING-ROUND1": "lower(v_flag) IN ('true', '1')", "R-AUTO-VALIDATION-NONCONFORMING-REPORT-BLOCK-R1": "lower(v_conforms) = 'false'", "R-AUTO-VALIDATION-WARNING-REVIEW-R1": "try_cast(v_warnings AS BIGINT) > 0",
    "R-AUTO-FAB-RCA-TELEMETRY-ANOMALY-REPAIR3": "contains(lower(v_source), 'sixsense') OR contains(lower(v_source), 'telemetry')",
}
EITHER = {"?code": f"regexp_matches(lower(v_code), '{SYSTEMATIC}')", "?words": f"regexp_matches(lower(v_words), '{SYSTEMATIC_TEXT}')"}
MINTS = {
    "R-AUTO-EQP-ALARM-DOWNTIME-MAINTENANCE-EVIDENCE-001": f"'{NS}derived:eqp-correlation:' || sha256(concat_ws('|', v_alarm, v_down, v_repair, v_log))",
    "R-AUTO-FAC-SIGNAL-CONTEXT-r2a08": "v_twin || '/evidence-bundle/' || replace(v_map, ':', '%3A')",
}
RULES: list[Rule] = catalog(NS)


def _variables(patterns: list) -> list[str]:
    return list(dict.fromkeys(t for p in patterns for t in p if isinstance(t, str) and t.startswith("?")))


def _text(term: object) -> str:
    """A fixed term as text."""
    if isinstance(term, (Lit, Iri)):
        return term.text
    return TYPE if term == "a" else STATEMENT.get(term, NS + str(term))


def _parts_of(rule: Rule) -> list[list]:
    return [list(rule.where), *[list(p) for p, _ in rule.either], list(rule.unless)]


def _sources(number: int, rule: Rule) -> list[tuple[str, str, str, str, str]]:
    """(condition, s, p, o, kind) in SQL that both engines read, one for each pattern."""
    first = _variables([p for part in _parts_of(rule) for p in part])
    sizes = [100_000, 997, 499, 251, 101]

    def value(term: object) -> str:
        if not (isinstance(term, str) and term.startswith("?")):
            return f"'{_text(term)}'"
        if term in VALUES:
            wide = [f"WHEN {k} THEN '{v}'" for k, v in enumerate(VALUES[term])]
            return f"CASE p_partkey % {len(wide)} {' '.join(wide)} END"
        # a few parts share the ids of the later variables; one rule combines all twins with all maps
        size = 7 if term == "?twin" else sizes[min(first.index(term), len(sizes) - 1)]
        return f"concat('r{number}:{term[1:]}:', p_partkey % {size})"

    out = []
    for at, part in enumerate(_parts_of(rule)):
        unless = at == len(rule.either) + 1
        for k, (s, p, o) in enumerate(part):
            literal = isinstance(o, Lit) or isinstance(o, str) and o in VALUES and o != "?source"
            out.append(("p_partkey % 4 = 0" if unless else f"(p_partkey + {k}) % 6 <> 0", value(s), value(p), value(o), "literal" if literal else "iri"))
    return out


def _solved(name: str, patterns: list, triples: str = "triples") -> str:
    """SQL of the solutions of patterns: a column v_x for each variable ?x."""
    seen: dict[str, str] = {}
    where = []
    for k, pattern in enumerate(patterns):
        for place, term in zip("spo", pattern, strict=True):
            if isinstance(term, str) and term.startswith("?"):
                if term in seen:
                    where.append(f"t{k}.{place} = {seen[term]}")
                else:
                    seen[term] = f"t{k}.{place}"
            else:
                where.append(f"t{k}.{place} = '{_text(term)}'")
                if place == "o":
                    where.append(f"t{k}.kind = '{'literal' if isinstance(term, Lit) else 'iri'}'")
    columns = ", ".join(f"{c} AS v_{v[1:]}" for v, c in seen.items())
    return f"{name} AS (SELECT DISTINCT {columns} FROM {', '.join(f'{triples} t{k}' for k in range(len(patterns)))} WHERE {' AND '.join(where)})"


def _sql(chosen: list[tuple[int, Rule]]) -> str:
    rows = [f"SELECT {s} AS s, {p} AS p, {o} AS o, '{kind}' AS kind FROM part WHERE {condition}" for n, rule in chosen for condition, s, p, o, kind in _sources(n, rule)]
    with_, selects = ["triples AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(rows) + "))"], []
    for n, rule in chosen:
        with_.append(_solved(f"a{n}", list(rule.where)))
        found = f"SELECT * FROM a{n}" + (f" WHERE {FILTERS[rule.id]}" if rule.id in FILTERS else "")
        known = _variables(list(rule.where))
        if rule.either:
            parts = []
            for k, (patterns, _) in enumerate(rule.either):
                with_.append(_solved(f"e{n}_{k}", [*rule.where, *patterns]))
                test = next(EITHER[v] for v in _variables(list(patterns)) if v in EITHER)
                parts.append(f"SELECT {', '.join(f'v_{v[1:]}' for v in known)} FROM e{n}_{k} WHERE {test}")
            found = " UNION ".join(parts)
        if rule.unless:
            with_.append(_solved(f"u{n}", list(rule.unless)))
            shared = [v for v in _variables(list(rule.unless)) if v in known]
            found = f"SELECT * FROM ({found}) x WHERE NOT EXISTS (SELECT 1 FROM u{n} WHERE {' AND '.join(f'u{n}.v_{v[1:]} = x.v_{v[1:]}' for v in shared)})"
        if rule.mint:
            found = f"SELECT *, {MINTS[rule.id]} AS v_{rule.mint[0][1:]} FROM ({found})"
            known = [*known, rule.mint[0]]
        with_.append(f"f{n} AS ({found})")
        node = f"substr(sha256(concat_ws('|', '{rule.id}', {', '.join(f'v_{v[1:]}' for v in sorted(known))})), 1, 24)"

        def term(t: object, node: str = node) -> str:
            if isinstance(t, str) and t.startswith("?"):
                return f"v_{t[1:]}"
            return f"'{t}:' || {node}" if isinstance(t, str) and t.startswith("_:") else f"'{_text(t)}'"

        selects += [f"SELECT '{rule.id}' AS rule, {term(s)} AS s, {term(p)} AS p, {term(o)} AS o FROM f{n}" for s, p, o in rule.construct]
    return f"WITH {', '.join(with_)} {' UNION '.join(selects)}"


def _register(name: str, numbers: list[int]) -> None:
    chosen = [(n, RULES[n]) for n in numbers]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = table(spark, sf_dir, "part")
        rows = [parts.where(c).selectExpr(f"{s} as s", f"{p} as p", f"{o} as o", f"'{kind}' as o_kind", "'' as o_dt", "'' as o_lang") for n, rule in chosen for c, s, p, o, kind in _sources(n, rule)]
        triples = stored(reduce(DataFrame.unionAll, rows).distinct(), "triples")
        made = [rules.constructed(triples, rule, NS).select(F.lit(rule.id).alias("rule"), "s", "p", "o") for _, rule in chosen]
        return reduce(DataFrame.unionAll, made)

    QUERIES[name] = run
    ORACLES[name] = _sql(chosen)


for _k in range(0, len(RULES), 4):
    _register(f"catalog_rules_{_k // 4 + 1}", list(range(_k, min(_k + 4, len(RULES)))))
