"""Conjunctive rules over triples: patterns joined on their variables, filters, anti-joins, and triples to construct.

A term of a pattern is a variable (`?x`), a name of the rule's namespace (`affectsEquipment`), `a` for rdf:type, or a
literal (`Lit("true")`).  Rules run once each, in order, and see what earlier rules added.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cache, reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.joins import interval_overlap
from weftgraph.operators.reasoner import RDF, TYPE
from weftgraph.schemas import TRIPLE_COLUMNS
from weftgraph.storage import dealt, stored

XSD = "http://www.w3.org/2001/XMLSchema#"
#: Triples in a part where they are told apart.
EACH = 200_000
STATEMENT = {"subject": RDF + "subject", "predicate": RDF + "predicate", "object": RDF + "object", "Statement": RDF + "Statement"}


@dataclass(frozen=True)
class Lit:
    text: str
    datatype: str = ""
    lang: str = ""


@dataclass(frozen=True)
class Iri:
    text: str


Term = str | Lit | Iri
Pattern = tuple[Term, Term, Term]
#: Takes a function from variable name to its text column.
Filter = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Rule:
    """where: patterns, or several groups of (patterns, filter) that are alternatives in `either` on top of them.

    overlap: two intervals of variables (start, end) of text timestamps that have to overlap.  The patterns that share a
    variable with the first interval are joined with the others over nodes of time, not on their common variable alone.
    mint: (variable, function from variables to the text of a new IRI); mint_apart: whether other values of the variables that
    it reads give another IRI, if no text holds a `|`.  `_:name` in construct is a node made anew for
    each solution, named by the rule and the solution so that a second run names it the same.
    """

    id: str
    construct: Sequence[Pattern]
    where: Sequence[Pattern]
    filter: Filter | None = None
    either: Sequence[tuple[Sequence[Pattern], Filter | None]] = ()
    unless: Sequence[Pattern] = ()
    mint: tuple[str, Filter] | None = None
    mint_apart: bool = False
    overlap: tuple[tuple[str, str], tuple[str, str]] | None = None
    note: str = field(default="", compare=False)


def _resolve(term: Term, namespace: str) -> tuple[str, str, str, str]:
    if isinstance(term, Lit):
        return term.text, "literal", term.datatype, term.lang
    if isinstance(term, Iri):
        return term.text, "iri", "", ""
    if term == "a":
        return TYPE, "iri", "", ""
    if term in STATEMENT:
        return STATEMENT[term], "iri", "", ""
    return namespace + term, "iri", "", ""


def _is_variable(term: Term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def _node(column: str) -> Column:
    """A subject or predicate as a term."""
    kind = F.when(F.col(column).startswith("_:"), "bnode").otherwise("iri")
    return F.struct(F.col(column).alias("v"), kind.alias("k"), F.lit("").alias("d"), F.lit("").alias("l"))


_OBJECT = F.struct


def _match(triples: DataFrame, pattern: Pattern, namespace: str) -> DataFrame:
    """Solutions of one pattern: a column (a term struct) for each of its variables."""
    rows, columns = triples, {}
    for place, term in zip("spo", pattern, strict=True):
        if _is_variable(term):
            value = _node(place) if place != "o" else F.struct(F.col("o").alias("v"), F.col("o_kind").alias("k"), F.col("o_dt").alias("d"), F.col("o_lang").alias("l"))
            if term in columns:
                rows = rows.where(columns[term] == value)
            columns[term] = value
        else:
            text, kind, datatype, lang = _resolve(term, namespace)
            rows = rows.where(F.col(place) == text)
            if place == "o":
                rows = rows.where((F.col("o_kind") == kind) & (F.col("o_dt") == datatype) & (F.col("o_lang") == lang)) if kind == "literal" else rows.where("o_kind <> 'literal'")
    return rows.select(*[value.alias(name) for name, value in columns.items()]).distinct()


def _join(left: DataFrame | None, right: DataFrame) -> DataFrame:
    if left is None:
        return right
    shared = [c for c in left.columns if c in right.columns]
    if shared:
        # of the session's number, which stays: by the bytes of its sides, which are few, a join of many rows went to one task
        left = left.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *shared)
    # terms repeat, so that files of a few MB hold more rows than a driver does: neither side is sent to all tasks.
    # patterns without a common variable combine freely: that is what such a rule says
    return left.join(right.hint("merge"), shared) if shared else left.crossJoin(right)


def _without(relations: list[DataFrame], keep: set[str]) -> list[DataFrame]:
    """Relations (variables as columns) with the same solutions of the variables in keep, and no other variables.

    Terms are numbers while variables are taken out; what is left is turned back into terms.
    """
    if all(set(r.columns) <= keep for r in relations):
        return relations
    whole = [r for r in relations if not r.columns]
    relations = [stored(r, "relation") for r in relations if r.columns]
    terms = stored(reduce(DataFrame.unionAll, [r.select(F.col(c).alias("term")) for r in relations for c in r.columns]).distinct().select(F.xxhash64("term").alias("id"), "term"), "terms")
    if terms.count() != terms.select("id").distinct().count():
        return whole + _eliminated(relations, keep)  # two terms of one number
    left = _eliminated([r.select(*[F.xxhash64(c).alias(c) for c in r.columns]) for r in relations], keep)
    out = whole
    for relation in left:
        for name in relation.columns:
            relation = _join(relation, terms.select(F.col("id").alias(name), F.col("term").alias("_term"))).drop(name).withColumnRenamed("_term", name)
        out.append(relation)
    return out


def _reduced(relations: list[DataFrame]) -> list[DataFrame]:
    """The same solutions without those relations of one variable that others hold too."""
    for relation in [r for r in relations if len(r.columns) == 1]:
        name = relation.columns[0]
        if any(name in r.columns for r in relations if r is not relation):
            relations = [r.join(relation.hint("merge"), name, "left_semi") if name in r.columns else r for r in relations if r is not relation]
    return [stored(r, "relation") for r in relations]


def _alike(held: list[DataFrame], gone: str) -> list[DataFrame]:
    """Two relations of `gone` and one other variable each, with one value of `gone` for all that have the same others in the smaller relation."""
    small, large = sorted(held, key=lambda r: r.count())
    other = next(c for c in small.columns if c != gone)
    digest = F.sha2(F.col(other).cast("string"), 256)
    # a set is told by its size and the sums of parts of its members' digests, exact whatever the order
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"_p{k}") for k in range(8)]
    sets = stored(small.groupBy(gone).agg(F.count("*").alias("_n"), *parts), "sets")
    key = [c for c in sets.columns if c != gone]
    first = sets.groupBy(*key).agg(F.min(gone).alias("_first"))
    named = stored(sets.join(first.hint("merge"), key).select(gone, "_first"), "sets")
    large = large.join(named.hint("merge"), gone).drop(gone).withColumnRenamed("_first", gone).distinct()
    small = small.join(named.where(F.col(gone) == F.col("_first")).select(gone).hint("merge"), gone, "left_semi")
    return [stored(small, "relation"), stored(large, "relation")]


def _joined(relations: list[DataFrame]) -> DataFrame:
    """All relations joined: first the two whose join has fewest rows, counted by the rows of each value, then those that share most variables."""
    rest = list(relations)
    if len(rest) > 2:

        def rows(a: DataFrame, b: DataFrame) -> int:
            shared = [c for c in a.columns if c in b.columns]
            met = a.groupBy(*shared).agg(F.count("*").alias("_a")).join(b.groupBy(*shared).agg(F.count("*").alias("_b")).hint("merge"), shared)
            return met.agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0

        pairs = [(a, b) for k, a in enumerate(rest) for b in rest[k + 1 :] if set(a.columns) & set(b.columns)]
        first = min(pairs, key=lambda pair: rows(*pair))
        rest = [*first, *(r for r in rest if all(r is not f for f in first))]
    left = rest.pop(0)
    while rest:
        pick = max(range(len(rest)), key=lambda k: (len(set(left.columns) & set(rest[k].columns)), -k))
        left = _join(left, rest.pop(pick))
    return left


def _eliminated(relations: list[DataFrame], keep: set[str]) -> list[DataFrame]:
    """Relations with the variables of keep alone.

    One variable after the other is taken out: the relations that hold it are joined on it, and with those that hold none but
    its neighbours, so that no more pairs of neighbours are made than these allow; they give their other variables,
    each solution once.  The one that leaves fewest variables goes first, of several that which can leave fewest rows by the values of those variables.
    A variable stays if it is all that its relations have.
    """
    relations = _reduced(relations)
    while True:
        others: dict[str, set[str]] = {}
        for relation in relations:
            for name in set(relation.columns) - keep:
                others.setdefault(name, set()).update(set(relation.columns) - {name})
        sizes = {name: len(rest) for name, rest in others.items() if rest}
        if not sizes:
            return relations
        least = sorted(name for name, n in sizes.items() if n == min(sizes.values()))
        if len(least) > 1:
            # each variable has no more values than the relation with fewest of them
            found: dict[str, int] = {}
            for relation in relations:
                counts = relation.agg(*[F.approx_count_distinct(c).alias(c) for c in relation.columns]).first()
                found |= {c: min(found.get(c, counts[c]), counts[c]) for c in relation.columns}
            least.sort(key=lambda name: (prod(found[c] for c in others[name]), name))
        gone = least[0]
        held = sorted((r for r in relations if gone in r.columns), key=lambda r: len(r.columns))
        bounds = [r for r in relations if gone not in r.columns and len(r.columns) > 1 and set(r.columns) <= others[gone]]
        rest = [r for r in relations if gone not in r.columns and all(r is not b for b in bounds)]
        if len(held) == 2 and not bounds and all(len(r.columns) == 2 and r.schema[gone].dataType.typeName() == "long" for r in held):
            held = _alike(held, gone)
        relations = [*rest, stored(_joined([*held, *bounds]).drop(gone).distinct(), "relation")]


def solve(triples: DataFrame, patterns: Sequence[Pattern], namespace: str, start: DataFrame | None = None, keep: set[str] | None = None) -> DataFrame:
    """Solutions of patterns.  Those about one subject are joined on it first; then what is solved of each subject is joined
    on all variables that it shares with the rest, the one that shares most first.

    keep: the variables that are asked for, all if it is None; others need only exist, and most of them don't come back.
    """
    known = set(start.columns) if start is not None else set()
    relations = [_match(triples, p, namespace) for p in patterns]
    if keep is not None:
        relations = _without(relations, keep | known)
    stars: dict[object, list[DataFrame]] = {}
    for k, relation in enumerate(relations):
        stars.setdefault(relation.columns[0] if relation.columns else k, []).append(relation)
    rest = [reduce(_join, star) for star in stars.values()]
    left = start
    while rest:
        known = set(left.columns) if left is not None else set()
        pick = max(range(len(rest)), key=lambda k: (len(known & set(rest[k].columns)), -k))
        left = _join(left, rest.pop(pick))
    return left


def _text(name: str) -> Column:
    return F.col(f"`{name}`.v")


def _overlapping(triples: DataFrame, rule: Rule, namespace: str) -> DataFrame:
    """Solutions of rule.where with overlapping intervals: each interval's subject is solved by itself."""
    sides = []
    for interval in rule.overlap:
        subject = next(p[0] for p in rule.where if p[2] == interval[0])
        side = solve(triples, [p for p in rule.where if p[0] == subject], namespace)
        # stored, as the join reads a side for its bounds, its intervals and its points
        sides.append(stored(side.withColumns({"start": F.try_to_timestamp(_text(interval[0])), "end": F.try_to_timestamp(_text(interval[1]))}), "side"))
    subjects = {next(p[0] for p in rule.where if p[2] == i[0]) for i in rule.overlap}
    shared = [c for c in sides[0].columns if c in sides[1].columns and c not in ("start", "end")]
    pairs = interval_overlap(sides[0], sides[1], shared)
    pairs = pairs.drop("start", "end", "r_start", "r_end").withColumnsRenamed({c: c[2:] for c in pairs.columns if c.startswith("r_?")})
    rest = [p for p in rule.where if p[0] not in subjects]
    return solve(triples, rest, namespace, pairs) if rest else pairs


def _read(*functions: Filter | None) -> set[str]:
    """The variables that filters and texts of new IRIs ask for."""
    names: set[str] = set()

    def note(name: str) -> Column:
        names.add(name)
        return _text(name)

    for function in functions:
        if function is not None:
            function(note)
    return names


def _asked(rule: Rule) -> set[str] | None:
    """The variables of rule.where that something else of the rule reads; None if all, as a node made anew is named by its whole solution."""
    if rule.overlap or any(isinstance(t, str) and t.startswith("_:") for triple in rule.construct for t in triple):
        return None
    later = [*rule.construct, *rule.unless, *(p for patterns, _ in rule.either for p in patterns)]
    return {t for triple in later for t in triple if _is_variable(t)} | _read(rule.filter, *(condition for _, condition in rule.either), rule.mint and rule.mint[1])


def solutions(triples: DataFrame, rule: Rule, namespace: str) -> DataFrame:
    """Solutions of the variables that the rule reads."""
    asked = _asked(rule)
    found = _overlapping(triples, rule, namespace) if rule.overlap else solve(triples, rule.where, namespace, keep=asked)
    if rule.filter is not None:
        found = found.where(F.coalesce(rule.filter(_text), F.lit(False)))
    if rule.either:
        base, parts = found.columns, []
        for patterns, condition in rule.either:
            part = solve(triples, patterns, namespace, found, _read(condition))
            if condition is not None:
                part = part.where(F.coalesce(condition(_text), F.lit(False)))
            parts.append(part.select(*[f"`{c}`" for c in base]))
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        found = found.distinct()
    if rule.unless:
        there = solve(triples, rule.unless, namespace, keep=set(found.columns))
        shared = [c for c in there.columns if c in found.columns]
        there = there.select(*[f"`{c}`" for c in shared]).distinct()
        found = found.join(there.hint("merge"), shared, "left_anti")
    if rule.mint is not None:
        name, text = rule.mint
        found = found.withColumn(name, F.struct(text(_text).alias("v"), F.lit("iri").alias("k"), F.lit("").alias("d"), F.lit("").alias("l")))
    return found


def _constant(term: Term, namespace: str) -> str | None:
    """The text of a fixed term, or what the text of a node made anew begins with; None for a variable."""
    if isinstance(term, str) and term.startswith("_:"):
        return term
    return None if _is_variable(term) else _resolve(term, namespace)[0]


def _apart(a: Pattern, b: Pattern, namespace: str) -> bool:
    """Whether no triple of a is one of b, as fixed terms of one place differ."""
    fixed = [(_constant(x, namespace), _constant(y, namespace)) for x, y in zip(a, b, strict=True)]
    return any(None not in pair and pair[0] != pair[1] for pair in fixed)


def _new(head: Pattern) -> list[tuple[str, Term]]:
    """The nodes made anew in a triple, with their places."""
    return [(place, t) for place, t in zip("spo", head, strict=True) if isinstance(t, str) and t.startswith("_:")]


def _told(triples: DataFrame, rule: Rule, namespace: str) -> bool:
    """Whether the texts of terms, and texts joined by `|`, tell all terms of the rule's patterns apart."""
    relations = [_match(triples, p, namespace) for p in rule.where]
    terms = [r.select(F.col(c).alias("term")) for r in relations for c in r.columns]
    if not terms:
        return False
    row = reduce(DataFrame.unionAll, terms).distinct().agg(F.count("*").alias("n"), F.count_distinct("term.v").alias("texts"), F.max(F.col("term.v").contains("|")).alias("parted")).first()
    return row["n"] == row["texts"] and not row["parted"]


def _triples(found: DataFrame, rule: Rule, heads: Sequence[Pattern], namespace: str) -> DataFrame:
    """The triples `heads` of each solution; equal ones of one solution and one new node once."""
    identity = F.sha2(F.concat_ws("|", F.lit(rule.id), *[F.col(f"`{c}`.v") for c in sorted(found.columns)]), 256)

    def term(t: Term) -> Column:
        if _is_variable(t):
            return F.col(f"`{t}`")
        if isinstance(t, str) and t.startswith("_:"):
            values = (F.concat(F.lit(t + ":"), F.substring(F.col("_identity"), 1, 24)), F.lit("bnode"), F.lit(""), F.lit(""))
        else:
            values = tuple(map(F.lit, _resolve(t, namespace)))
        return F.struct(*[v.alias(n) for v, n in zip(values, "vkdl", strict=True)])

    if any(map(_new, heads)):
        found = found.withColumn("_identity", identity)
    rows = []
    for k, head in enumerate(heads):
        row = F.struct(*[term(t).alias(place) for place, t in zip("spo", head, strict=True)])
        for other in heads[:k]:
            if not _apart(head, other, namespace) and _new(head) and _new(head) == _new(other):
                row = F.when(~reduce(Column.__and__, [term(x) == term(y) for x, y in zip(head, other, strict=True) if x != y], F.lit(True)), row)
        rows.append(row)
    made = found.select(F.explode(F.array(*rows)).alias("t")).where("t is not null")
    return made.select(F.col("t.s.v").alias("s"), F.col("t.p.v").alias("p"), F.col("t.o.v").alias("o"), F.col("t.o.k").alias("o_kind"), F.col("t.o.d").alias("o_dt"), F.col("t.o.l").alias("o_lang"))


def constructed(triples: DataFrame, rule: Rule, namespace: str) -> DataFrame:
    """The distinct triples that the rule makes.

    Triples that no two solutions share are made without being told apart, which would shuffle all of them: those that name
    all variables of their solution, in a new node if not one by one.  What is named by the variables of `mint` alone is solved for these.
    """
    heads = list(dict.fromkeys(rule.construct))
    told = cache(lambda: _told(triples, rule, namespace))
    minted, read = (rule.mint[0], _read(rule.mint[1])) if rule.mint is not None else ("", set())
    apart = rule.mint_apart and told()

    def named(head: Pattern) -> set[str]:
        """The variables whose values a triple tells."""
        return set().union(*[read if apart and t == minted else {t} for t in head if _is_variable(t)])

    of_mint = [h for h in heads if apart and minted in h and named(h) == read]
    groups = [g for g in (of_mint, [h for h in heads if h not in of_mint]) if g]
    parts, repeated = [], []
    for group in groups:
        found = solutions(triples, replace(rule, construct=group), namespace)
        if _once(replace(rule, construct=heads), found.columns):
            return _triples(found, rule, heads, namespace)
        values = set(found.columns) - {minted}

        def once(head: Pattern, values: set[str] = values) -> bool:
            others = [h for h in heads if h is not head and not _apart(h, head, namespace)]
            return told() and (bool(_new(head)) or named(head) - {minted} >= values) and all(_new(h) and _new(h) == _new(head) for h in others)

        single = [h for h in group if once(h)]
        if single:
            parts.append(_triples(found, rule, single, namespace))
        for head in (h for h in group if h not in single):
            needed = found if _new(head) else found.select(*[f"`{t}`" for t in dict.fromkeys(head) if _is_variable(t)]).distinct()
            repeated.append(_triples(needed, rule, [head], namespace))
    if repeated:
        parts.append(reduce(DataFrame.unionAll, repeated).distinct())
    return reduce(DataFrame.unionAll, parts)


def _once(rule: Rule, names: Sequence[str]) -> bool:
    """Whether no two solutions of these variables make one triple: it is the only one, has all of them, and what is not its object is a node by the rule's patterns."""
    if len(rule.construct) > 1 or rule.overlap:
        return False
    nodes = {p[0] for p in rule.where}
    return set(names) <= {t for place, t in zip("spo", rule.construct[0], strict=True) if place == "o" or t in nodes}


def run(triples: DataFrame, rules: Sequence[Rule], namespace: str) -> tuple[DataFrame, dict[str, int]]:
    """(triples with all that the rules add, number of triples each added that were not there)."""
    triples, fired = stored(dealt(stored(triples.select(*TRIPLE_COLUMNS), "triples"), *TRIPLE_COLUMNS, each=EACH).distinct(), "rules"), {}
    for rule in rules:
        made = stored(constructed(triples, rule, namespace), "made")
        heads = [p for _, p, _ in rule.construct]
        # only triples of the predicates that the rule makes can be there already
        there = triples if any(map(_is_variable, heads)) else triples.where(F.col("p").isin(*{_resolve(p, namespace)[0] for p in heads}))
        parts = max(1, -(-(made.count() + there.count()) // EACH))
        new = stored(made.repartition(parts, *TRIPLE_COLUMNS).join(there.hint("merge"), TRIPLE_COLUMNS, "left_anti"), "rules")
        fired[rule.id] = new.count()
        if fired[rule.id]:
            triples = triples.unionByName(new)
    return triples, fired


def admissible(rules: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """(id, reason) of registry rows (id, kind, path, text, has_test) that may not run; no rows when all may.

    Ids match `R-` with capitals, digits and dashes, and are unique; texts construct and hold no update keyword.
    """
    text = F.upper(F.coalesce("text", F.lit("")))
    checks = F.array(
        F.when(F.col("id").isNull() | ~F.col("id").rlike(r"^R-[A-Za-z0-9-]+$"), "id"),
        F.when(F.col("text").isNull(), "missing text"),
        F.when(F.col("text").isNotNull() & ~text.rlike(r"\bCONSTRUCT\b"), "not a construct"),
        F.when(text.rlike(r"\b(INSERT|DELETE|LOAD|CLEAR|DROP|CREATE|COPY|MOVE|ADD|SERVICE)\b"), "update keyword"),
        F.when(~F.coalesce("has_test", F.lit(False)), "missing test"),
    )
    found = rules.select("id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("reason"))
    twice = rules.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("reason"))
    if known_ids is not None:
        twice = twice.union(rules.join(known_ids.select("id"), "id", "left_semi").select("id", F.lit("known id").alias("reason")))
    return found.union(twice).distinct()
