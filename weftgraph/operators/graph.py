"""Graph operators on edge tables: walks, closure, ancestors, components, trees, extraction.

Edges are rows (src, rel_type, dst).  Iterations run as Spark jobs over tables written to the shared folder, each round
on the rows that are new, and stop when none are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import discard, stored

#: Tables that a fixpoint keeps before it writes them as one.
MOST_PARTS = 12
#: Triples in a part where they are told apart.
EACH = 500_000
#: Nodes of a chain that others meet at once, and pairs that a part of a chain's closure has about.
BLOCK, PAIRS = 1024, 50_000_000


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: Sequence[str] | None = None) -> DataFrame:
    """The least table that holds seed and all that step(new, all) gives; rows are the same if their keys are.

    Columns must not be null.  Of several candidates for one key in a round any one is kept, so keys should be all
    columns unless step gives one row a key.  It ends when a round gives nothing new; a step that keeps making new keys
    has no such table.
    """
    keys = list(keys or seed.columns)
    parts = [stored(seed.dropDuplicates(keys), "fixpoint")]
    while True:
        if len(parts) > MOST_PARTS:  # so that later rounds read few tables
            older = parts
            parts = [stored(_union(older[:-1]), "fixpoint"), older[-1]]
            for part in older[:-1]:
                discard(part)
        total = _union(parts)
        new = step(parts[-1], total).select(*seed.columns).dropDuplicates(keys).join(total.select(*keys), keys, "left_anti")
        new = stored(new, "fixpoint")
        if new.isEmpty():
            return total
        parts.append(new)


def derived_edges(entities: DataFrame, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Edges implied by entity fields.  specs: (field, rel_type, direction), direction `entity -> value` or `value -> entity`.

    A field is a string or an array of strings; nulls give no edge.
    """
    parts = []
    for field, rel_type, direction in specs:
        is_array = entities.schema[field].dataType.typeName() == "array"
        value = F.explode(field) if is_array else F.col(field)
        rows = entities.select(F.col("id").alias("_entity"), value.alias("_value")).where("_value is not null and _entity is not null")
        src, dst = ("_value", "_entity") if direction.replace(" ", "").startswith("value") else ("_entity", "_value")
        parts.append(rows.select(F.col(src).alias("src"), F.lit(rel_type).alias("rel_type"), F.col(dst).alias("dst"), F.lit(True).alias("derived"), F.lit(field).alias("field")))
    return _union(parts)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def all_edges(edges: DataFrame, derived: DataFrame) -> DataFrame:
    """Explicit edges with derived ones; explicit rows have derived = false."""
    explicit = edges if "derived" in edges.columns else edges.withColumn("derived", F.lit(False))
    return explicit.withColumn("derived", F.coalesce("derived", F.lit(False))).unionByName(derived, allowMissingColumns=True)


def entity_refs(entities: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(id, field, ref) of every reference in scalar or array fields."""
    parts = []
    for field in fields:
        value = F.explode(field) if entities.schema[field].dataType.typeName() == "array" else F.col(field)
        parts.append(entities.select("id", F.lit(field).alias("field"), value.alias("ref")).where("ref is not null"))
    return _union(parts)


@dataclass(frozen=True)
class Step:
    """One hop: along edges of rel_type, `out` or `in`, to entities of to_type if given."""

    rel_type: str
    direction: str = "out"
    to_type: str | None = None


def walk(edges: DataFrame, start: DataFrame, steps: Sequence[Step], types: DataFrame | None = None) -> DataFrame:
    """(start, node): nodes that a path of the steps reaches from each start node (column id), each once.

    types: (id, type), needed where a step names a type.
    """
    front = start.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    for step in steps:
        a, b = ("src", "dst") if step.direction == "out" else ("dst", "src")
        hop = edges.where(F.col("rel_type") == step.rel_type).select(F.col(a).alias("node"), F.col(b).alias("_to"))
        front = front.join(hop, "node").select("start", F.col("_to").alias("node")).distinct()
        if step.to_type is not None:
            front = front.join(types.where(F.col("type") == step.to_type).select(F.col("id").alias("node")), "node", "left_semi")
    return front.select("start", "node")


def transitive_closure(edges: DataFrame, reflexive: bool = False, within: Sequence[str] = (), each_round: Callable[[int], object] = lambda n: None) -> DataFrame:
    """(src, dst) pairs joined by a path of one edge or more; with reflexive, also each node with itself.

    within: columns that all edges of a path share; they come first in the result.  Paths double: after round k all
    pairs at a distance of up to 2**k are known, and a farther pair is a pair at a distance of 2**k and a known one, so
    the rounds are the log of the longest distance and a pair on a single path is made once.  Where no node has two edges
    out or in, pointers double instead, and the pairs of a chain are made as they are read and never stored.  each_round
    is told the number of each round.
    """
    g = list(within)
    edges = stored(edges.select(*g, "src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    if all(edges.groupBy(*g, c).count().where("count > 1").isEmpty() for c in ("src", "dst")):
        places, rings = _places(edges, g, each_round)
        found = _chain_pairs(places, g)
        if not rings.isEmpty():
            found = found.unionByName(_path_pairs(rings, g, each_round))
    else:
        found = _path_pairs(edges, g, each_round)
    if reflexive:
        nodes = edges.select(*g, "src").union(edges.select(*g, "dst")).distinct()
        found = found.union(nodes.select(*g, "src", F.col("src").alias("dst"))).distinct()
    return found


def _path_pairs(edges: DataFrame, g: list[str], each_round: Callable[[int], object]) -> DataFrame:
    """The pairs of distinct stored edges, by doubling paths."""
    keys = [*g, "src", "dst"]
    power = edges
    parts, rounds = [power], 0
    while True:
        rounds += 1
        each_round(rounds)
        total = _union(parts)
        hop = power.select(*g, "src", F.col("dst").alias("_mid"))

        def met(right: DataFrame, hop: DataFrame = hop) -> DataFrame:
            return hop.join(right.select(*g, F.col("src").alias("_mid"), "dst"), [*g, "_mid"]).select(*keys).distinct()

        new = stored(met(total).join(total, keys, "left_anti"), "closure")
        if new.isEmpty():
            break
        parts.append(new)
        # of the pairs that two paths of this length make, those that are not nearer
        power = stored(met(power).join(new, keys, "left_semi"), "power")
    return _union(parts)


def _places(chains: DataFrame, g: list[str], each_round: Callable[[int], object] = lambda n: None) -> tuple[DataFrame, DataFrame]:
    """((node, to, after): the last node of each node's chain and how many edges it is away, edges of rings), of stored edges without forks."""
    key = [*g, "node"]
    last = chains.select(*g, F.col("dst").alias("node")).join(chains.select(*g, F.col("src").alias("node")), key, "left_anti")
    ahead = chains.select(*g, F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(1).cast("long").alias("after"), F.lit(False).alias("ended"))
    # the last node of a chain leads to itself, 0 edges away
    ahead = stored(ahead.unionByName(last.select(*key, F.col("node").alias("to"), F.lit(0).cast("long").alias("after"), F.lit(True).alias("ended"))), "ahead")
    nodes, length, rounds = ahead.count(), 1, 0
    while length < nodes and not (moving := ahead.where("not ended")).isEmpty():
        rounds += 1
        each_round(rounds)
        hop = ahead.select(*g, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("after").alias("_after"), F.col("ended").alias("_ended"))
        moved = moving.join(hop, [*g, "to"]).select(*key, F.col("_to").alias("to"), (F.col("after") + F.col("_after")).alias("after"), F.col("_ended").alias("ended"))
        old, ahead = ahead, stored(ahead.where("ended").unionByName(moved), "ahead")
        discard(old)
        length *= 2
    done = ahead.where("ended").select(*key, "to", "after")
    # what no last node ends is a ring, whose nodes all lead to all
    return done, chains.join(done.select(*g, F.col("node").alias("src")), [*g, "src"], "left_anti")


def _chain_pairs(places: DataFrame, g: list[str]) -> DataFrame:
    """The pairs of nodes of each chain: a node meets the rest of its chain in blocks of `BLOCK` nodes, dealt to parts by the number of pairs.

    A part has few blocks and repeats them for each node, so that files of them are small.
    """
    key = [*g, "to", "_block"]
    parts = max(1, -(-(places.agg(F.sum("after")).first()[0] or 0) // PAIRS))
    above = places.where("after > 0").withColumnRenamed("node", "src").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("after") - 1) / BLOCK))))
    below = places.select(*g, "to", F.floor(F.col("after") / BLOCK).alias("_block"), F.col("node").alias("dst"), F.col("after").alias("_after"))
    met = above.repartition(parts, *key).join(below.repartition(parts, *key).hint("shuffle_hash"), key)
    return met.where("_after < after").select(*g, "src", "dst")


def reach_counts(edges: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(node, after, before): to how many nodes a path leads from each node of an edge, and from how many one leads to it.

    What transitive_closure() has a pair for each of is counted without pairs where no node has two edges out or in: along
    such chains pointers double, so that the rounds are the log of the longest chain and each has a row for a node.  Only
    components in which a chain forks or meets another are closed.  within: as there; its columns come first.
    """
    g = list(within)
    key = [*g, "node"]
    edges = stored(edges.select(*g, "src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    forks = stored(_union([edges.groupBy(*g, F.col(c).alias("node")).agg(F.count("*").alias("_n")).where("_n > 1").select(*key) for c in ("src", "dst")]).distinct(), "forks")
    parts, chains = [], edges
    if not forks.isEmpty():
        ends = [F.struct(*g, F.col(c).alias("node")).alias(to) for c, to in (("src", "a"), ("dst", "b"))]
        root = contracted(edges.select(*ends))
        # a loop has no edge to another node
        loops = edges.where("src = dst").select(F.struct(*g, F.col("src").alias("node")).alias("node"), F.struct(*g, F.col("src").alias("node")).alias("root"))
        root = stored(root.unionByName(loops.join(root.select("node"), "node", "left_anti")), "roots")
        mixed = root.join(forks.select(F.struct(*key).alias("node")), "node", "left_semi").select("root").distinct()
        inside = root.join(mixed, "root", "left_semi").select(*[F.col(f"node.{c}").alias(c) for c in key]).withColumnRenamed("node", "src")
        closed = stored(transitive_closure(edges.join(inside, [*g, "src"], "left_semi"), within=g), "closure")
        counts = [closed.groupBy(*g, F.col(c).alias("node")).agg(F.count("*").alias(to)) for c, to in (("src", "after"), ("dst", "before"))]
        parts.append(counts[0].join(counts[1], key, "full").select(*key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("after", "before")]))
        chains = stored(edges.join(inside, [*g, "src"], "left_anti"), "chains")
    done, rings = _places(chains, g)
    sizes = done.groupBy(*g, "to").agg(F.count("*").alias("_size"))
    parts.append(done.join(sizes, [*g, "to"]).select(*key, "after", (F.col("_size") - 1 - F.col("after")).alias("before")))
    ring = connected_components(rings.select(*[F.struct(*g, F.col(c).alias("node")).alias(c) for c in ("src", "dst")]))
    whole = ring.join(ring.groupBy("component").agg(F.count("*").alias("after")), "component")
    parts.append(whole.select(*[F.col(f"node.{c}").alias(c) for c in key], "after", F.col("after").alias("before")))
    return _union(parts)


def transitive_subjects(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the roots (column node) and all that reach one along src -> dst."""
    hop = edges.select(F.col("dst").alias("node"), F.col("src").alias("_to")).where("_to is not null")
    return fixpoint(roots.select("node").distinct(), lambda new, _: new.join(hop, "node").select(F.col("_to").alias("node")))


def peeled(edges: DataFrame) -> DataFrame:
    """(src, dst): the edges left when those from a node without incoming, or to one without outgoing edges are taken off again and again.

    No edges are left if there is no cycle; self loops are cycles.
    """
    left = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    count = left.count()
    while count:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        old, left = left, stored(inner.select("src", "dst"), "edges")
        discard(old)
        before, count = count, left.count()
        if count == before:
            break
    return left


def least_above(edges: DataFrame) -> DataFrame:
    """(node, least): the smallest of the nodes that a path leads from to each node of an edge, itself among them.

    In each round a node takes the least of its predecessors, and what the node it has taken has, so that the rounds grow
    with the log of a path's length where numbers along it are in no order.
    """
    edges = edges.select("src", "dst")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    label = stored(nodes.select("node", F.col("node").alias("least"), F.lit(True).alias("moved")), "least")
    while not (new := label.where("moved").select("node", "least")).isEmpty():
        along = new.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), F.col("least").alias("_new"))
        jump = label.select("node", F.col("least").alias("_via")).join(new.select(F.col("node").alias("_via"), F.col("least").alias("_new")), "_via").select("node", "_new")
        best = along.unionAll(jump).groupBy("node").agg(F.min("_new").alias("_new"))
        lower = F.coalesce(F.col("_new") < F.col("least"), F.lit(False))
        old, label = label, stored(label.drop("moved").join(best, "node", "left").select("node", F.when(lower, F.col("_new")).otherwise(F.col("least")).alias("least"), lower.alias("moved")), "least")
        discard(old)
    return label.select("node", "least")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the nodes that lie on a cycle, a self loop among them; component is the smallest node that each shares a cycle with.

    Peeling takes off what is on no path between cycles, a layer a round.  Then nodes are coloured by the least node that
    leads to them, in the order of a hash, so that colours split a chain of components evenly; within a colour, the nodes
    from which that node can be reached are its component.  They go, edges between colours go too, and what is left is
    peeled and coloured again.
    """
    plain = edges.select("src", "dst").where("src is not null and dst is not null")
    loops = stored(plain.where("src = dst").select(F.col("src").alias("node")).distinct(), "loops")
    left, parts = peeled(plain.where("src <> dst").select(*[F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("node")).alias(c) for c in ("src", "dst")])), []
    while not left.isEmpty():
        colour = least_above(left)
        inner = left.join(colour.toDF("src", "colour"), "src").join(colour.toDF("dst", "_other"), "dst").where("colour = _other").select("src", "dst")
        inner = stored(inner, "inner")
        back = least_above(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("least", "_back")
        found = stored(colour.join(back, "node").where("least = _back").select("node", "least"), "components")
        parts.append(found)
        left = peeled(inner.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"))
    alone = loops.select("node", F.col("node").alias("component"))
    if not parts:
        return alone
    # a node by itself between two cycles is no component
    every = _union(parts).select("node.node", "least")
    named = every.groupBy("least").agg(F.min("node").alias("component"), F.count("*").alias("_n")).where("_n > 1")
    sized = stored(every.join(named, "least").select("node", "component"), "components")
    return sized.unionByName(alone.join(sized.select("node"), "node", "left_anti"))


def cycles(edges: DataFrame) -> DataFrame:
    """(node): nodes that lie on a cycle."""
    return strong_components(edges).select("node")


def witness_cycles(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(component, path): a shortest cycle through the smallest node of each strong component, from that node back to it.

    components: what strong_components() gives, if it is there already.  Of several nodes before a node on equally short
    ways the smallest is taken.  All components are searched together, one step a round, and a component leaves the
    search when its cycle is closed, so the rounds are as many as the longest of the cycles has edges.
    """
    node = stored(components if components is not None else strong_components(edges), "components")
    ends = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    inner = ends.join(node.toDF("src", "component"), "src").join(node.toDF("dst", "_other"), "dst").where("component = _other").select("component", "src", "dst")
    inner = stored(inner, "inner")
    front = stored(node.select("component").distinct().select("component", F.col("component").alias("node"), F.array("component").alias("path")), "front")
    seen, closed = [], []
    while not front.isEmpty():
        step = front.withColumnRenamed("node", "src").join(inner, ["component", "src"])
        # paths of one length that end in one node: by the node before
        best = step.groupBy("component", F.col("dst").alias("node")).agg(F.min_by("path", "src").alias("path"))
        reached = stored(best.select("component", "node", F.concat("path", F.array("node")).alias("path")), "reached")
        done = reached.where("node = component").select("component", "path")
        closed.append(done)
        seen.append(reached.select("component", "node"))
        ahead = reached.join(done.select("component"), "component", "left_anti")
        for old in seen[:-1]:
            ahead = ahead.join(old, ["component", "node"], "left_anti")
        front = stored(ahead, "front")
    return _union(closed) if closed else front.select("component", "path")


def ancestors_with_depth(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): the least number of edges from src to each node above it; depth 0 is src itself."""
    hop = stored(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct(), "edges")
    nodes = hop.select("src").union(hop.select("dst")).distinct()
    seed = nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("depth"))
    up = hop.select(F.col("src").alias("dst"), F.col("dst").alias("_to"))
    return fixpoint(seed, lambda new, _: new.join(up, "dst").select("src", F.col("_to").alias("dst"), (F.col("depth") + 1).alias("depth")), ["src", "dst"])


def nearest_marked(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, nearest, depth): the marked node (column node) fewest edges above each node, ties by name; nodes without one are left out.

    The search goes down from the marked nodes, and each node is reached once.
    """
    hop = stored(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct(), "edges")
    nodes = hop.select(F.col("src").alias("node")).union(hop.select("dst")).distinct()
    seed = marked.select("node").distinct().join(nodes, "node", "left_semi").select("node", F.col("node").alias("nearest"), F.lit(0).alias("depth"))
    down = hop.select(F.col("dst").alias("node"), F.col("src").alias("_to"))

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        reached = new.join(down, "node").groupBy(F.col("_to").alias("node")).agg(F.min("nearest").alias("nearest"), F.min("depth").alias("depth"))
        return reached.select("node", "nearest", (F.col("depth") + 1).alias("depth"))

    return fixpoint(seed, step, ["node"])


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b), for each node with an edge; root is one of its nodes.

    Each round moves every node to its smallest neighbour and contracts the graph, so at least half of the nodes that
    still have edges disappear a round.  Only map-side combined minima and equi-joins are shuffled; every round's
    tables are written to the shared folder.  Self loops, nulls and repeated edges are ignored; no edges give no rows.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    label = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        least = stored(least, "least")
        if least.isEmpty():
            return label if label is not None else least.select("node", F.col("to").alias("root"))
        first, second = (least.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        old = edges
        edges = stored(edges.join(first, "a").join(second, "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).where("a <> b").distinct(), "edges")
        discard(old)
        if label is None:
            label = least.select("node", F.col("to").alias("root"))
        else:
            moved = least.select(F.col("node").alias("root"), "to")
            old = label
            label = stored(label.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "label")
            discard(old)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node of it; edges count both ways, self loops make a node known."""
    edges = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null")
    rooted = contracted(edges)
    # stored, so that the nodes of a large component can be split among tasks
    names = stored(rooted.groupBy("root").agg(F.min("node").alias("component")), "components")
    alone = edges.select(F.col("a").alias("node")).where("a = b").distinct().join(rooted.select("node"), "node", "left_anti")
    return rooted.join(names, "root").select("node", "component").unionByName(alone.select("node", F.col("node").alias("component")))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): edges that leave or enter, parallel ones each."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Rows of nodes (column id) on no edge; with refs (id, ref), also in no reference either way."""
    touched = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    if refs is not None:
        touched = touched.union(refs.select("id")).union(refs.select("ref"))
    return nodes.join(touched.distinct(), "id", "left_anti")


def coverage_gap(nodes: DataFrame, covered: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) that covered (id) lacks, with their degree, highest first, ties by id."""
    ranked = nodes.select("id").join(covered.select("id"), "id", "left_anti").join(degree(edges).withColumnRenamed("node", "id"), "id", "left")
    return ranked.select("id", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "id")


def one_sided(entities: DataFrame, edges: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Nodes all of whose neighbours are of one domain though a note of an edge has a keyword of cross-domain analogy."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "note").unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "note"))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.coalesce(F.col("note").contains(word), F.lit(False))
    sides = ends.join(entities.select(F.col("id").alias("other"), F.col("domain").alias("_domain")), "other")
    return sides.groupBy("id").agg(F.countDistinct("_domain").alias("domains"), F.max(hit).alias("hinted")).where("domains = 1 and hinted").select("id")


def path_counts(edges: DataFrame) -> DataFrame:
    """(node, paths): number of downward paths from each node along src -> dst, so a diamond's end counts twice.

    Self loops are left out; a cycle raises an error.  Counts go up from the leaves: a node is done when all below it
    are, so only nodes and edges are joined, never pairs of a node and its descendants.
    """
    hop = stored(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    if not peeled(hop).isEmpty():
        raise ValueError("the edges have a cycle")
    nodes = hop.select(F.col("src").alias("node"))
    done = hop.select(F.col("dst").alias("node")).distinct().join(nodes, "node", "left_anti").withColumn("paths", F.lit(0).cast("long"))
    parts, left = [stored(done, "paths")], hop
    while not left.isEmpty():
        total = _union(parts)
        waiting = left.join(total.select(F.col("node").alias("dst")), "dst", "left_anti").select("src").distinct()
        ready = left.join(waiting, "src", "left_anti").join(total.withColumnRenamed("node", "dst"), "dst")
        parts.append(stored(ready.groupBy(F.col("src").alias("node")).agg(F.sum(F.col("paths") + 1).alias("paths")), "paths"))
        left = stored(left.join(parts[-1].select(F.col("node").alias("src")), "src", "left_anti"), "edges")
    return _union(parts).join(nodes.distinct(), "node", "left_semi").select("node", "paths")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) without a known parent other than themselves; edges go child (src) -> parent (dst)."""
    known = edges.where("src <> dst").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(known.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def with_ancestors(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the hits and everything above them, child (src) -> parent (dst)."""
    up = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")).where("_to is not null")
    return fixpoint(hits.select("node").distinct(), lambda new, _: new.join(up, "node").select(F.col("_to").alias("node")))


def neighbours(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the hits and what is one edge away either way."""
    a = edges.join(hits.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    b = edges.join(hits.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    return hits.select("node").union(a).union(b).distinct()


def accepted_in_order(items: DataFrame, parents: DataFrame, known: DataFrame) -> DataFrame:
    """(id): items all of whose parents are known or accepted themselves, to a fixpoint.

    items: id; parents: (id, parent); known: id.  Items without parents are accepted at once.
    """
    items, parents = stored(items.select("id").distinct(), "items"), stored(parents.select("id", "parent").distinct(), "parents")

    def ready(have: DataFrame) -> DataFrame:
        missing = parents.join(have.select(F.col("id").alias("parent")), "parent", "left_anti").select("id")
        return items.join(missing, "id", "left_anti")

    base = known.select("id").distinct()
    grown = fixpoint(base.union(ready(base)).distinct(), lambda _, have: ready(have))
    return items.join(grown, "id", "left_semi")


def pruned(triples: DataFrame, subjects: DataFrame, required: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples kept, subjects pruned): new subjects that lack required values go, with every triple that touches them.

    subjects: (s, type), the new individuals; required: (type, p, least), distinct objects needed.  Losing a triple may
    leave another subject short, so the search repeats until no subject is short.
    """
    subjects, gone = stored(subjects.distinct(), "subjects"), []
    kept = stored(triples, "triples")
    asked = F.broadcast(required.select("p").distinct())  # of the schema
    while True:
        # dealt by rows, as partitions that are joined by their compressed bytes hold too many for a task's memory
        parts = max(1, -(-kept.count() // EACH))
        need = subjects.join(required, "type").select("s", "p", "least")
        have = kept.join(asked, "p", "left_semi").select("s", "p", "o").repartition(parts, "s", "p").groupBy("s", "p").agg(F.countDistinct("o").alias("n"))
        short = need.join(have, ["s", "p"], "left").where(F.coalesce("n", F.lit(0)) < F.col("least")).select("s").distinct()
        short = stored(short, "short")
        if short.isEmpty():
            break
        gone.append(short)
        subjects = stored(subjects.join(short, "s", "left_anti"), "subjects")
        left = kept.repartition(parts, "s").join(short, "s", "left_anti")
        kept = stored(left.repartition(parts, "o").join(short.withColumnRenamed("s", "o"), "o", "left_anti").select(*triples.columns), "triples")
    return kept, _union(gone) if gone else subjects.limit(0).select("s")


def class_graph(triples: DataFrame, type_p: str, subclass_p: str, domain_p: str, range_p: str, class_types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an ontology: classes with subclass and property edges, individuals with their relations.

    No self edges; an edge is listed once for each (src, dst, kind, label).  An individual's primary type is the
    smallest of its types.
    """
    types = triples.where(F.col("p") == type_p)
    classes = types.where(F.col("o").isin(*class_types)).select(F.col("s").alias("id")).distinct()
    individuals = types.where(~F.col("o").isin(*class_types)).join(classes.withColumnRenamed("id", "o"), "o", "left_semi").groupBy(F.col("s").alias("id")).agg(F.min("o").alias("type"))
    sub = triples.where(F.col("p") == subclass_p).select(F.col("s").alias("src"), F.col("o").alias("dst"), F.lit("subclass").alias("kind"), F.lit("").alias("label"))
    domain = triples.where(F.col("p") == domain_p).select(F.col("s").alias("label"), F.col("o").alias("src"))
    range_ = triples.where(F.col("p") == range_p).select(F.col("s").alias("label"), F.col("o").alias("dst"))
    relation = domain.join(range_, "label").select("src", "dst", F.lit("relation").alias("kind"), "label")
    ends = classes.select(F.col("id").alias("src"))
    class_edges = sub.union(relation).join(ends, "src", "left_semi").join(ends.withColumnRenamed("src", "dst"), "dst", "left_semi")
    objects = domain.select(F.col("label").alias("p")).union(range_.select("label")).distinct()
    known = individuals.select(F.col("id").alias("s"))
    linked = triples.where("o_kind <> 'literal'").join(objects, "p", "left_semi").join(known, "s", "left_semi").join(known.withColumnRenamed("s", "o"), "o", "left_semi")
    instance_edges = linked.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.lit("instance").alias("kind"), F.col("p").alias("label"))
    edges = class_edges.select("src", "dst", "kind", "label").union(instance_edges).where("src <> dst").distinct()
    nodes = classes.select("id", F.lit("class").alias("kind"), F.lit(None).cast("string").alias("type")).union(individuals.select("id", F.lit("instance"), "type"))
    return nodes, edges


def adjacent_pairs(rows: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """(group, src, dst): each value with the next one of its group in order; the last of a group has no pair."""
    window = Window.partitionBy(group).orderBy(*order)
    return rows.select(group, F.col(value).alias("src"), F.lead(value).over(window).alias("dst")).where("dst is not null")
