"""Forward-chaining closure of triples under a subset of RDFS and OWL-RL, with the schema read once into small tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import fixpoint, reach_counts, transitive_closure
from weftgraph.schemas import TRIPLE_COLUMNS
from weftgraph.storage import stored

# The vocabulary of RDF, RDFS and OWL.
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
TYPE, FIRST, REST, NIL = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"
INVERSE, TRANSITIVE, CHAIN = OWL + "inverseOf", OWL + "TransitiveProperty", OWL + "propertyChainAxiom"
#: Terms whose meaning this closure does not cover; a schema that uses one is refused.
NOT_COVERED = [OWL + x for x in ("sameAs", "equivalentClass", "equivalentProperty", "disjointWith", "unionOf", "intersectionOf", "complementOf", "oneOf", "hasKey")]


@dataclass
class Schema:
    """Axioms by kind, each a table of (a, b), chains of (a, first, second), and the rules made of them.

    alone: what one triple gives, (a, p, flip, o): with predicate a it gives predicate p, with its ends swapped where flip
    is 1; o, where it isn't null, is the object (a type) instead.  The table is closed: what its rows give together is in
    it too.  pairs: (p1, p2, q), x p1 y and y p2 z give x q z.
    """

    subproperty: DataFrame
    domain: DataFrame
    range: DataFrame
    inverse: DataFrame
    transitive: DataFrame
    chain: DataFrame
    oversized_chains: DataFrame
    alone: DataFrame
    pairs: DataFrame

    def repeated(self) -> DataFrame:
        """(p): predicates that go on from themselves, x p y and y p z give x p z."""
        return self.pairs.where("p1 = p2 and p2 = q").select(F.col("q").alias("p"))


def read_schema(triples: DataFrame) -> Schema:
    """The axioms of a schema's triples.  Sub-properties are closed; chains of two properties are kept, others listed."""

    def pairs(p: str) -> DataFrame:
        return triples.where(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()

    sub = transitive_closure(pairs(SUBPROPERTY).toDF("src", "dst")).where("src <> dst").toDF("a", "b")
    inverse = pairs(INVERSE)
    first, rest = pairs(FIRST).toDF("node", "item"), pairs(REST).toDF("node", "next")
    heads = pairs(CHAIN).toDF("p", "node")
    one = heads.join(first, "node").join(rest, "node").select("p", F.col("node").alias("head"), F.col("item").alias("first"), F.col("next").alias("node"))
    two = one.join(first, "node", "left").join(rest, "node", "left").select("p", "head", "first", F.col("item").alias("second"), F.col("next").alias("end"))
    good = (F.col("end") == NIL) & F.col("second").isNotNull()
    inverse = stored(inverse.union(inverse.select("b", "a")).distinct(), "schema")
    sub, domain, range_ = stored(sub, "schema"), stored(pairs(DOMAIN), "schema"), stored(pairs(RANGE), "schema")
    transitive = stored(triples.where((F.col("p") == TYPE) & (F.col("o") == TRANSITIVE)).select(F.col("s").alias("a")).distinct(), "schema")
    chain = stored(two.where(good).select(F.col("p").alias("a"), "first", "second").distinct(), "schema")
    oversized = stored(heads.join(two.where(good).select(F.col("head").alias("node")), "node", "left_anti").select("p").distinct(), "schema")

    # predicates that follow from a predicate, by steps up and over to inverses
    move = sub.select(F.col("a").alias("p"), F.col("b").alias("to"), F.lit(0).alias("turn")).unionByName(inverse.select(F.col("a").alias("p"), F.col("b").alias("to"), F.lit(1).alias("turn")))
    known = [d.select("a") for d in (sub, inverse, domain, range_)]
    start = known[0].union(known[1]).union(known[2]).union(known[3]).distinct().select("a", F.col("a").alias("p"), F.lit(0).alias("flip"))
    moved = fixpoint(start, lambda new, _: new.join(move, "p").select("a", F.col("to").alias("p"), ((F.col("flip") + F.col("turn")) % 2).alias("flip")))
    # the subject of a triple is typed by the domain, or the range where the ends are swapped, of what follows
    typed = [moved.join(d.select(F.col("a").alias("p"), F.col("b").alias("o")), "p").select("a", F.lit(TYPE).alias("p"), (F.col("flip") if side == 0 else 1 - F.col("flip")).alias("flip"), "o") for side, d in ((0, domain), (1, range_))]
    alone = moved.where("a <> p or flip = 1").select("a", "p", "flip", F.lit(None).cast("string").alias("o")).unionByName(typed[0]).unionByName(typed[1]).distinct()
    through = transitive.select(F.col("a").alias("p1"), F.col("a").alias("p2"), F.col("a").alias("q"))
    upward = triples.sparkSession.createDataFrame([(TYPE, SUBCLASS, TYPE), (SUBCLASS, SUBCLASS, SUBCLASS)], "p1 string, p2 string, q string")
    both = through.unionByName(chain.select(F.col("first").alias("p1"), F.col("second").alias("p2"), F.col("a").alias("q"))).unionByName(upward).distinct()
    return Schema(sub, domain, range_, inverse, transitive, chain, oversized, stored(alone, "schema"), stored(both, "schema"))


def blockers(schema: DataFrame, rule_texts: list[str] = (), shape_predicates: DataFrame | None = None, covered: list[str] = ()) -> list[str]:
    """Why the closure would not be sound for this schema: terms that are not covered, in it or in rules, chains of
    more than two, and predicates of shapes (column p) beyond `covered`.  Empty when it is."""
    found = [f"term {r['p']}" for r in schema.where(F.col("p").isin(*NOT_COVERED)).select("p").distinct().collect()]
    found += [f"chain {r['p']}" for r in read_schema(schema).oversized_chains.collect()]  # of the schema
    found += [f"rule uses {t}" for t in NOT_COVERED if any(t in text or t.replace(OWL, "owl:") in text for text in rule_texts)]
    if shape_predicates is not None:
        found += [f"shape uses {r['p']}" for r in shape_predicates.select("p").distinct().where(~F.col("p").isin(*covered)).collect()]
    return sorted(found)


def expanded(schema: Schema, triples: DataFrame) -> DataFrame:
    """triples with what each of them gives by itself; a second run adds nothing."""
    made = triples.withColumnsRenamed({"p": "a", "o": "_o"}).join(schema.alone.withColumnRenamed("o", "type"), "a").where("o_kind <> 'literal' or flip = 0")
    subject = F.when(F.col("flip") == 1, F.col("_o")).otherwise(F.col("s"))
    object_ = F.when(F.col("type").isNotNull(), F.col("type")).when(F.col("flip") == 1, F.col("s")).otherwise(F.col("_o"))
    as_is = F.col("type").isNull() & (F.col("flip") == 0)
    kind = F.when(as_is, F.col("o_kind")).when(F.col("type").isNull() & F.col("s").startswith("_:"), "bnode").otherwise("iri")
    same = [F.when(as_is, F.col(c)).otherwise("").alias(c) for c in ("o_dt", "o_lang")]
    return triples.select(*TRIPLE_COLUMNS).unionByName(made.select(subject.alias("s"), "p", object_.alias("o"), kind.alias("o_kind"), *same))


def step(schema: Schema, new: DataFrame, every: DataFrame, repeated: bool = True) -> DataFrame:
    """What two triples, at least one of them new, give together, expanded; without `repeated`, by other rules than those of repeated predicates."""
    pairs = schema.pairs if repeated else schema.pairs.where("p1 <> p2 or p2 <> q")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        one = left.where("o_kind <> 'literal'").select(F.col("s").alias("x"), F.col("p").alias("p1"), F.col("o").alias("y")).join(pairs, "p1")
        two = right.where("o_kind <> 'literal'").join(pairs.select(F.col("p2").alias("p")).distinct(), "p", "left_semi").select(F.col("s").alias("y"), F.col("p").alias("p2"), F.col("o").alias("z"))
        kind = F.when(F.col("z").startswith("_:"), "bnode").otherwise("iri")
        return one.join(two, ["y", "p2"]).select(F.col("x").alias("s"), F.col("q").alias("p"), F.col("z").alias("o"), kind.alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))

    return expanded(schema, met(new, every).unionByName(met(every, new)).distinct())


def closure(triples: DataFrame, schema: Schema, start: DataFrame | None = None) -> DataFrame:
    """All triples that follow, the given ones among them.

    start: a table that is closed already; then only what the given triples add is derived, with the same result.
    Blank nodes are named `_:...`.
    """
    triples = triples.select(*TRIPLE_COLUMNS)
    triples = expanded(schema, triples)
    # types that a domain or range gives have predicate type; only a schema about type itself has more to say of them
    again = not schema.alone.where(F.col("a") == TYPE).isEmpty()

    def grow(new: DataFrame, every: DataFrame) -> DataFrame:
        return step(schema, new, every).unionByName(expanded(schema, new)) if again else step(schema, new, every)

    if start is None:
        return _closed(schema, triples, again)
    start = stored(start.select(*TRIPLE_COLUMNS), "closed")
    fresh = triples.join(start, TRIPLE_COLUMNS, "left_anti")
    grown = fixpoint(fresh, lambda new, every: grow(new, every.unionByName(start)).join(start, TRIPLE_COLUMNS, "left_anti"))
    return start.unionByName(grown)


def counted(triples: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """The closure, with the triples of predicates that go on from themselves, and of their inverses, only counted.

    (all other triples that follow, (s, p, n): how many follow of such a predicate p for each subject).  No triple is made
    of those that are counted where such a predicate gives nothing but itself, its inverse, equals of these, and types,
    and no other rule joins two triples; with other schemas all are made and counted.
    """
    made = stored(expanded(schema, triples.select(*TRIPLE_COLUMNS)).distinct(), "closure")
    repeated, present = schema.repeated(), made.select("p").distinct()
    gives = schema.alone.where("o is null").join(F.broadcast(repeated.withColumnRenamed("p", "a")), "a", "left_semi").select("a", "p", "flip")
    back = schema.alone.where("o is null").select(F.col("p").alias("a"), F.col("a").alias("p"), "flip")
    others = schema.pairs.where("p1 <> p2 or p2 <> q")
    fires = others.join(present.withColumnRenamed("p", "p1"), "p1", "left_semi").join(present.withColumnRenamed("p", "p2"), "p2", "left_semi")
    tangled = gives.join(back, ["a", "p", "flip"], "left_anti").unionByName(gives.join(repeated, "p", "left_semi").select("a", "p", "flip"))
    plain = tangled.isEmpty() and fires.isEmpty() and schema.alone.where(F.col("a") == TYPE).isEmpty()
    ways = stored(gives.unionByName(repeated.select(F.col("p").alias("a"), "p", F.lit(0).alias("flip"))).distinct(), "schema")
    wide = F.broadcast(ways.select("p").distinct())  # of the schema
    if not plain:
        every = stored(closure(triples, schema), "closure")
        return every.join(wide, "p", "left_anti").select(*TRIPLE_COLUMNS), every.join(wide, "p", "left_semi").groupBy("s", "p").agg(F.count("*").alias("n"))
    hops = made.where("o_kind <> 'literal'").join(F.broadcast(repeated), "p", "left_semi").select("p", F.col("s").alias("src"), F.col("o").alias("dst"))
    reached = reach_counts(hops, within=["p"]).withColumnsRenamed({"p": "a", "node": "s"}).join(F.broadcast(ways), "a")
    texts = made.where("o_kind = 'literal'").join(wide, "p", "left_semi").select("s", "p", F.lit(1).cast("long").alias("n"))
    counts = reached.select("s", "p", F.when(F.col("flip") == 0, F.col("after")).otherwise(F.col("before")).alias("n")).where("n > 0").unionByName(texts)
    return made.join(wide, "p", "left_anti").select(*TRIPLE_COLUMNS), counts.groupBy("s", "p").agg(F.sum("n").alias("n"))


def _closed(schema: Schema, triples: DataFrame, again: bool) -> DataFrame:
    """The closure of expanded triples.  Predicates that go on from themselves are closed by doubling paths, the other rules run in rounds."""
    repeated = F.broadcast(schema.repeated())  # of the schema

    def hops(of: DataFrame) -> DataFrame:
        return of.where("o_kind <> 'literal'").join(repeated, "p", "left_semi").select("p", F.col("s").alias("src"), F.col("o").alias("dst"))

    new = stored(triples.distinct(), "closure")
    parts, direct = [new], []
    pending = stored(hops(new), "direct")  # triples of repeated predicates that no path has made
    while True:
        extra = None
        if not pending.isEmpty():
            direct.append(pending)
            touched = _all(direct).join(pending.select("p").distinct(), "p", "left_semi") if len(direct) > 1 else pending
            kind = F.when(F.col("dst").startswith("_:"), "bnode").otherwise("iri")
            paths = transitive_closure(touched, within=["p"]).select(F.col("src").alias("s"), "p", F.col("dst").alias("o"), kind.alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
            made = stored(expanded(schema, paths).distinct().join(_all(parts), TRIPLE_COLUMNS, "left_anti"), "closure")
            if not made.isEmpty():
                parts.append(made)
                new = new.unionByName(made)
                # what a path gives by itself may belong to another repeated predicate
                extra = made.join(paths, TRIPLE_COLUMNS, "left_anti")
        total = _all(parts)
        grown = step(schema, new, total, repeated=False)
        grown = stored((grown.unionByName(expanded(schema, new)) if again else grown).distinct().join(total, TRIPLE_COLUMNS, "left_anti"), "closure")
        pending = stored(hops(grown) if extra is None else hops(grown).unionByName(hops(extra)), "direct")
        if grown.isEmpty() and pending.isEmpty():
            return total
        parts.append(grown)
        new = grown


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def added(triples: DataFrame, closed: DataFrame) -> int:
    """How many triples the closure added."""
    return closed.join(triples.select(*TRIPLE_COLUMNS), TRIPLE_COLUMNS, "left_anti").count()


def affected(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node): subjects and node objects of triples that are new after a change; the shapes to check again target these."""
    new = after.join(before.select(*TRIPLE_COLUMNS), TRIPLE_COLUMNS, "left_anti")
    return new.select(F.col("s").alias("node")).union(new.where("o_kind <> 'literal'").select("o")).distinct()
