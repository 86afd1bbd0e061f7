"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, then exact intersection of sorted arrays.

A document's set holds the 64-bit hashes of its distinct word n-grams, sorted.  Equal sets are one class, and only one
set of each class takes part.  The join works in four steps, each of them linear in what it ships:

1. *Tiles.*  Sets that are similar enough share one of their first `n - ceil(threshold * n) + 1` hashes, in hash order with
   the corpus's frequent shingles last.  Tasks send these hashes, packed, to key ranges; a frequent one that is still in a
   prefix goes out under a key for each pair of blocks of its sets, so no task gets all of them.  Each key held by two
   sets or more gives a tile of its sets, cut into size bands that no similar pair can straddle.  Tiles with the same
   members count once; a tile beyond TILE members is dealt into blocks, and each pair of blocks whose sizes are
   compatible is a tile of its own.
2. *Bitmaps.*  In a tile, popcount(xor) of two parity bitmaps bounds the symmetric difference from below and so the
   overlap from above.  A spanning forest of the pairs that pass keeps their connectivity with fewer rows than members.
3. *Clusters.*  Components of that forest gather the sets that have to meet; each set travels once, not once a pair.
4. *Exact intersection.*  In a cluster (in pairs of blocks, if it is beyond CLUSTER sets or SHINGLES hashes), pairs not
   yet connected that pass a wider bitmap are intersected as sorted arrays.  Components of the links are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import jobs, textkit

#: Sets in a tile, and sets or hashes in a cluster, before they are dealt into blocks (all pairs of blocks are joined).
TILE, CLUSTER, SHINGLES = 2048, 16384, 4_000_000
#: Shingles among which frequent ones are looked for at once, and frequent ones known to all tasks (16 bytes each).
COUNTED, FREQUENT = 1_000_000, 100_000
#: Prefix hashes of a key range, about (20 bytes each): ranges are as many as the corpus needs, whatever the session's partitions.
RANGE = 2_000_000


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def width(n: np.ndarray | int, bits: int) -> np.ndarray | int:
    """Bits of the signature of a set of n: the size band's power of two, at least `bits` for each member."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(n * bits, 64))).astype(np.int64))


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the members that fall on each bit, as 64-bit words."""
    parity = np.bincount((values & textkit.U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view(np.uint64)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)


def linked(sizes: np.ndarray, maps: list[np.ndarray], percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the similar pairs; without sets, of the pairs whose bitmaps allow it.

    sizes ascend.  Sets are compared with earlier ones of their own size band and of the band below it.
    """
    n, forest, edges = len(sizes), Forest(len(sizes)), []
    labels = np.arange(n)  # of the component, renewed where components meet
    bands: dict[int, tuple[int, int, np.ndarray]] = {}
    words = np.array([len(m) for m in maps])
    for w in np.unique(words):
        rows = np.flatnonzero(words == w)
        bands[int(w)] = (int(rows[0]), int(rows[-1]) + 1, np.stack([maps[k] for k in rows]))
    for i in range(1, n):
        size, own = int(sizes[i]), maps[i]
        low = int(np.searchsorted(sizes[:i], -(-percent * size // 100)))
        for w, probe in ((len(own), own), (len(own) // 2, None)):
            if w not in bands:
                continue
            first, last, stack = bands[w]
            a, b = max(first, low), min(last, i)
            if a >= b:
                continue
            if probe is None:
                probe = own[:w] ^ own[w:]
            total = sizes[a:b] + size
            apart = np.bitwise_count(stack[a - first : b - first] ^ probe).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero((100 + percent) * ((total - apart) // 2) >= percent * total)
            while len(near):
                j = a + int(near[0])
                mine = labels[i]
                near = near[labels[a + near] != mine]
                if not len(near):
                    break
                j = a + int(near[0])
                if sets is None or overlaps(sets[i], sets[j], percent):
                    edges.append((j, i))
                    labels[labels == mine] = labels[j]
                else:
                    near = near[1:]
    return edges


def overlaps(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on sorted arrays of distinct hashes: 100 * intersection >= percent * union."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _set_hash(values: np.ndarray) -> int:
    mixed = textkit.mix(values + textkit.U(0x5851F42D4C957F2D))
    both = np.array([mixed.sum(dtype=np.uint64) ^ textkit.mix(np.array([np.bitwise_xor.reduce(mixed)], np.uint64))[0] + textkit.U(len(values))], np.uint64)
    return int(textkit.mix(both).view(np.int64)[0])


def text_key() -> Column:
    """Stands for a row's text where doc_ids repeat or are null."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _frequent(sets: list[np.ndarray]) -> bytes:
    """(shingle, sets that have it) of the shingles that at least 8 and a 128th of the sets have."""
    keys, times = np.unique(np.concatenate(sets), return_counts=True)
    often = times >= max(8, len(sets) // 128)
    return np.stack([keys[often], times[often].astype(np.uint64)], axis=1).tobytes()


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, set_id, n, bitmap, frequent) of each row; set_id is null for an empty set.

    frequent has the shingles that many of the different sets of neighbouring rows have, with their counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, maps, frequent = [], [], [], [None] * batch.num_rows
            held: dict[int, np.ndarray] = {}
            total = 0
            for row, values in textkit.shingle_sets(batch.column("text"), shingle):
                sizes.append(len(values))
                ids.append(_set_hash(values) if len(values) else None)
                maps.append(bitmap(values, int(width(len(values), 2))).tobytes() if len(values) else b"")
                if len(values) and ids[-1] not in held:
                    held[ids[-1]] = values
                    total += len(values)
                if held and (total > COUNTED or row == batch.num_rows - 1):
                    frequent[row] = _frequent(list(held.values())) or None
                    held, total = {}, 0
            columns = zip((ids, sizes, maps, frequent), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(c, t) for c, t in columns)], names=["doc_id", "text_key", "set_id", "n", "bitmap", "frequent"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, set_id long, n long, bitmap binary, frequent binary"
    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(run, schema)


def frequent_shingles(signs: DataFrame) -> np.ndarray:
    """Rows (shingle, times), by shingle, of the FREQUENT most frequent ones among those that signatures() met often.

    They go last in the order of shingles, so that a passage of many documents is in few prefixes.  Any list gives the
    same links, as every task has the same one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column("frequent").to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "times"])

    counts = signs.where("frequent is not null").select("frequent").mapInArrow(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    rows = counts.orderBy(F.desc("times"), "key").limit(FREQUENT).collect()
    found = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 2).view(np.uint64)
    return found[np.argsort(found[:, 0])]


def key_ranges(sizes: DataFrame, percent: int, least: int) -> int:
    """Ranges that hold about RANGE prefix hashes each of sets of the given sizes (column n), `least` or more."""
    total = sizes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    return max(least, -(-int(total) // RANGE))


def tiles(docs: DataFrame, shingle: int, percent: int, frequent: np.ndarray, ranges: int) -> DataFrame:
    """(tile, members): sets that share a prefix hash, in size bands; members are set_ids.  `ranges` groups of keys are handled one by one."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)
    half = TILE // 2

    def prefix(values: np.ndarray, own: int) -> np.ndarray:
        """The first hashes of a set, the frequent ones last; one that blocks of sets share is a key for each pair of blocks."""
        count, known = prefix_length(len(values), percent), shared.value
        if not len(known):
            return values[:count]
        at = np.searchsorted(known[:, 0], values)
        at[at == len(known)] = 0
        often = known[at, 0] == values
        first = values[~often][:count]
        if len(first) == count:
            return first
        keys, times = values[often], known[at[often], 1]
        order = np.argsort(times, kind="stable")[: count - len(first)]
        parts = [first]
        for key, blocks in zip(keys[order], -(-times[order].astype(np.int64) // half), strict=True):
            mine, each = own % int(blocks), np.arange(blocks)
            pairs = np.minimum(each, mine) * blocks + np.maximum(each, mine)
            parts.append(textkit.mix(key + textkit.U(0x9E3779B97F4A7C15) * (pairs.astype(np.uint64) + textkit.U(1))) if blocks > 1 else np.array([key]))
        return np.concatenate(parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, ids, sizes, seen = [], [], [], [], set()
            for _, values in textkit.shingle_sets(batch.column("text"), shingle):
                if not len(values) or (own := _set_hash(values)) in seen:
                    continue
                seen.add(own)
                keys.append(prefix(values, own))
                owner.append(np.full(len(keys[-1]), len(ids), np.int32))
                ids.append(own)
                sizes.append(len(values))
            if not ids:
                continue
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            ids, sizes = np.array(ids, np.int64), np.array(sizes, np.int32)
            # the smallest hashes of a set are its prefix, so ranges of the value would be uneven
            place = (textkit.mix(keys) % textkit.U(ranges)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            place, keys, owner = place[order], keys[order], owner[order]
            cut = np.flatnonzero(np.diff(place)) + 1
            rows = [(int(p[0]), k.tobytes(), ids[o].tobytes(), sizes[o].tobytes()) for p, k, o in zip(np.split(place, cut), np.split(keys, cut), np.split(owner, cut), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["place", "keys", "ids", "sizes"])

    def meet(table: pa.Table) -> pa.Table:
        def joined(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        keys, ids, sizes = joined("keys", np.uint64), joined("ids", np.int64), joined("sizes", np.int32)
        order = np.lexsort((ids, sizes, keys))
        keys, ids, sizes = keys[order], ids[order], sizes[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids, sizes = keys[fresh], ids[fresh], sizes[fresh].astype(np.int64)
        # a new band where the key changes or the next size is beyond what any similar pair can have
        new = np.ones(len(keys) + 1, bool)
        new[1:-1] = (keys[1:] != keys[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])
        start = np.flatnonzero(new)
        long = np.flatnonzero(np.diff(start) > 1)
        found: dict[int, np.ndarray] = {}

        def add(members: np.ndarray) -> None:
            values = textkit.mix(np.sort(members).view(np.uint64) * textkit._STEP[: len(members)] if len(members) <= 4096 else members.view(np.uint64))
            found[int((values.sum(dtype=np.uint64) + textkit.U(len(members))).view(np.int64))] = members

        for k in long:
            a, b = int(start[k]), int(start[k + 1])
            if b - a <= TILE:
                add(ids[a:b])
                continue
            blocks = [(x, min(x + half, b)) for x in range(a, b, half)]
            for p, (x, y) in enumerate(blocks):
                for u, v in blocks[p:]:
                    if 100 * sizes[y - 1] < percent * sizes[u]:
                        break
                    add(ids[x:y] if u == x else np.concatenate([ids[x:y], ids[u:v]]))
        return pa.table({"tile": pa.array(list(found), pa.int64()), "members": pa.array([m.tolist() for m in found.values()], pa.list_(pa.int64()))})

    packed = docs.select("text").mapInArrow(pack, "place int, keys binary, ids binary, sizes binary")
    return packed.groupBy("place").applyInArrow(meet, "tile long, members array<long>").dropDuplicates(["tile"])


def plausible(tiled: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Spanning forests (a, b) of the pairs in each tile whose bitmaps allow the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for members in batch.column("sets"):
                rows = sorted(members.as_py(), key=lambda x: (x["n"], x["set_id"]))
                maps = [np.frombuffer(x["bitmap"], np.uint64) for x in rows]
                for i, j in linked(np.array([x["n"] for x in rows]), maps, percent):
                    left.append(rows[i]["set_id"])
                    right.append(rows[j]["set_id"])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    rows = tiled.select("tile", F.explode("members").alias("set_id")).join(signs, "set_id")
    return rows.groupBy("tile").agg(F.collect_list(F.struct("set_id", "n", "bitmap")).alias("sets")).select("sets").mapInArrow(compare, "a long, b long")


def verified(docs: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of spanning forests of the truly similar pairs in each cluster.

    members: (doc_id, text_key, set_id, root, n), one row of docs for each set of a cluster.
    """
    spark = docs.sparkSession
    counts = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CLUSTER, F.sum("n") / SHINGLES)).cast("int").alias("parts"))
    # stored, as are other sides of joins here, so that the rows of one key can be split among tasks
    counts = jobs.stored(counts.select("root", F.when(F.col("parts") <= 1, 1).otherwise(2 * F.col("parts")).alias("parts")), "parts")
    dealt = members.join(counts, "root").withColumn("part", F.expr("cast(pmod(xxhash64(set_id), parts) as int)"))
    # a set goes to the pairs of its block with each block, its own among them where there is only one
    pairs = F.expr("transform(sequence(0, parts - 1), p -> struct(least(p, part) as i, greatest(p, part) as j))")
    dealt = dealt.withColumn("pair", F.explode(pairs)).where("parts = 1 or pair.i <> pair.j")
    dealt = dealt.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), "set_id", F.xxhash64("root", "pair.i", "pair.j").alias("block"), "n")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                sizes, sets = np.array([len(x[1]) for x in held]), [x[1] for x in held]
                wide = width(sizes, 8)
                found = linked(sizes, [bitmap(x, int(w)) for x, w in zip(sets, wide, strict=True)], percent, sets)
                yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([held[j][0] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            ids, blocks = batch.column("set_id").to_pylist(), batch.column("block").to_pylist()
            for row, values in textkit.shingle_sets(batch.column("text"), shingle):
                if blocks[row] != block:
                    yield from links()
                    block, held = blocks[row], []
                if not held or held[-1][0] != ids[row]:  # rows may repeat
                    held.append((ids[row], values))
        yield from links()

    keyed = docs.select("doc_id", "text", text_key().alias("text_key"))
    sized = dealt.hint("shuffle_hash").join(keyed, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text")))
    sized = sized.repartition(jobs.partitions(spark), "block").sortWithinPartitions("block", "n", "set_id")
    return sized.select("block", "set_id", "text").mapInArrow(intersect, "a long, b long")


def classified(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, set_id, n) of each row, and (set_id, component_id, keeper) of each set that isn't empty; both stored.

    keeper is the first row (doc_id, nulls last, then text_key) of the set's component.
    """
    jobs.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signs = jobs.stored(signatures(docs, shingle), "signatures")
    full = signs.where("set_id is not null")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = jobs.stored(full.groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), F.min(row).alias("first"), F.max("n").alias("n"), F.max("bitmap").alias("bitmap")), "classes")
    ranges = key_ranges(classes, percent, 4 * jobs.partitions(docs.sparkSession))
    clusters = jobs.components(plausible(tiles(docs, shingle, percent, frequent_shingles(signs), ranges), classes.select("set_id", "n", "bitmap"), percent))
    members = jobs.stored(classes.join(clusters.withColumnRenamed("node", "set_id"), "set_id").select("first.doc_id", "first.text_key", "set_id", "root", "n"), "members")
    jobs.discard(clusters)
    links = jobs.components(verified(docs, members, shingle, percent))
    jobs.discard(members)
    rooted = jobs.stored(classes.join(links.withColumnRenamed("node", "set_id"), "set_id").select("set_id", "root", "first_doc", "first"), "rooted")
    names = jobs.stored(rooted.groupBy("root").agg(F.min("first_doc").alias("component"), F.min("first").alias("keeper")), "names")
    named = rooted.join(names, "root").select("set_id", "component", "keeper")
    home = classes.join(named, "set_id", "left").select("set_id", F.coalesce("component", "first_doc").alias("component_id"), F.coalesce("keeper", "first").alias("keeper"))
    home = jobs.stored(home, "homes")
    for done in (links, rooted, names, classes):
        jobs.discard(done)
    return signs.select("doc_id", "text_key", "set_id", "n"), home


def join(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs, by links of Jaccard similarity >= percent / 100.

    docs has doc_id and text; other columns are not read.  A text of fewer than `shingle` words is one shingle; a null
    text, an empty one or one of white space has the empty set, links with nothing and is its own component.  Rows of
    equal sets are one class, so repeated rows and exact copies share a component.  component_id is the smallest
    doc_id reachable by links, nulls apart.  Rows that share a doc_id but not their text are judged each by its own text.
    An empty table gives an empty table.
    """
    signs, home = classified(docs, shingle, percent)
    return signs.join(home.drop("keeper"), "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs less near copies: of each component the row of the smallest doc_id, null last.

    Where rows of a component share that doc_id, one of them stays, even if they are equal.  Rows of an empty set stay.
    """
    signs, home = classified(docs, shingle, percent)
    keeps = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key") == F.col("keeper")
    judged = signs.join(home, "set_id").select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text"), keeps.alias("__keeps"))
    judged = jobs.stored(judged, "judged")
    jobs.discard(home)
    same = text_key() == F.col("__text")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & same
    rest = docs.join(judged.where("not __keeps").select("__doc", "__text").distinct(), same, "left_anti")
    twins = judged.where("__keeps").groupBy("__doc", "__text").agg(F.count("*").alias("n")).where("n > 1").select("__doc", "__text")
    twins = jobs.stored(twins, "twins")
    if twins.isEmpty():
        return rest
    # equal rows are numbered when they are written, so a second run of a task can't choose another
    equal = jobs.stored(rest.join(twins, same).withColumn("__n", F.monotonically_increasing_id()), "equal")
    one = equal.groupBy("__doc", "__text").agg(F.min("__n").alias("__first")).select("__first")
    return rest.join(twins, same, "left_anti").unionByName(equal.join(one, F.col("__n") == F.col("__first")).select(*[F.col(f"`{c}`") for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: the components of five-word shingle similarity of 0.8 or more."""
    return join(jobs.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(doc_id, other) AS (
  SELECT DISTINCT x, x FROM both_ways UNION SELECT doc_id, y FROM reach JOIN both_ways ON other = x
), least_id AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""
