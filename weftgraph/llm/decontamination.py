"""Benchmark decontamination by a distributed positional inverted index.

The index is a stored table dealt by document: a segment holds all postings (term, positions) of a few hundred documents,
so that it is built and searched where its documents are, and no posting list of a frequent term ever has to travel or to
fit in one task.  A phrase is found by taking the postings of its rarest term in the segment, shifting them by the term's
place in the phrase, and intersecting them with the shifted postings of the other terms from the rarer to the more
frequent.  With a slop, a posting up to that many words beside its place counts too, which gives proximity matches: there
is a place for the phrase, which may be up to the slop away from where the rarest term puts it, such that each word stands
at most the slop beside its own place.  They don't depend on which documents share a segment.

Test items are a table as well.  Their words are dealt into passes of about PASS_WORDS words.  A pass is sent to all tasks,
searches the index and writes its matches before the next one is read, so the driver holds one pass at a time, however
large the benchmark is; then the matches of all passes meet by document.  Words are equal where their 64-bit hashes are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import jobs, textkit
from weftgraph.storage import exists, remove

#: Words of a window, words between two documents in a segment's numbering, and phrase candidates handled at once.
WINDOW, GAP, CANDIDATES = 13, 64, 1_000_000
#: Words of items searched in one pass, and of one piece of an item.
PASS_WORDS, PIECE_WORDS = 200_000, 50_000
#: Bytes of text in a segment, about.
SEGMENT = 1 << 19


@dataclass
class Windows:
    """Test phrases: distinct word hashes, the words side by side as numbers of them, first word, length, item_id number."""

    vocabulary: np.ndarray
    words: np.ndarray
    first: np.ndarray
    length: np.ndarray
    item: np.ndarray
    names: list[str]
    size: int

    @classmethod
    def of(cls, items: list[tuple[str, np.ndarray]], size: int) -> Windows:
        """Every `size` consecutive words of each item; an item of fewer words, but not none, is one window."""
        items = [(name, words) for name, words in items if len(words)]
        counts = np.array([len(w) for _, w in items], np.int64)
        begins = np.cumsum(counts) - counts
        windows = np.maximum(counts - size, 0) + 1
        item = np.repeat(np.arange(len(items)), windows)
        first = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows - begins, windows)
        vocabulary, words = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in items)]), return_inverse=True)
        return cls(vocabulary, words, first, np.minimum(counts, size)[item], item, [name for name, _ in items], size)


def segments(texts: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(first row, end row, segment): word counts of the documents, sorted terms, their offsets, their positions."""
    for row, end, data, at in textkit.chunks(texts, SEGMENT):
        start, _, hashed = textkit.words(data, textkit.ALNUM)
        first = np.searchsorted(start, at)
        counts = np.diff(np.append(first, len(start)))
        position = np.arange(len(start)) + np.repeat(_begins(counts) - first, counts)
        order = np.argsort(hashed, kind="stable")
        hashed, position = hashed[order], position[order]
        new = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1])) if len(hashed) else np.zeros(0, np.int64)
        yield row, end, {"n_words": counts, "terms": hashed[new], "offsets": np.append(new, len(hashed)), "positions": position}


def _begins(counts: np.ndarray) -> np.ndarray:
    """Position of the first word of each document."""
    return np.cumsum(np.append(0, counts[:-1] + GAP)) if len(counts) else counts


def find(segment: dict[str, np.ndarray], windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its first word) of every occurrence in the segment.

    With a slop, a window is found at every position from which each of its words has a posting at most slop words beside
    its place; repeated words may share one.
    """
    terms, offsets, positions = segment["terms"], segment["offsets"], segment["positions"]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(windows.length):
        return none
    place = np.searchsorted(terms, windows.vocabulary)
    place[place == len(terms)] = 0
    known = terms[place] == windows.vocabulary
    # windows all of whose words have postings
    have = np.concatenate([[0], np.cumsum(known[windows.words])])
    able = np.flatnonzero(have[windows.first + windows.length] - have[windows.first] == windows.length)
    if not len(able):
        return none
    length = windows.length[able]
    column = np.arange(windows.size)
    place = place[windows.words[windows.first[able][:, None] + np.minimum(column, length[:, None] - 1)]]
    # places beyond the window's length go last
    counts = np.where(column < length[:, None], offsets[place + 1] - offsets[place], np.iinfo(np.int64).max)
    rank = np.argsort(counts, axis=1, kind="stable")
    span = int(positions.max()) + 2 * GAP + 2
    posted = np.repeat(np.arange(len(terms)), np.diff(offsets)) * span + positions  # ascending

    def beside(want: np.ndarray, width: int) -> np.ndarray:
        at = np.searchsorted(posted, want - width)
        at[at == len(posted)] = len(posted) - 1
        return (posted[at] >= want - width) & (posted[at] <= want + width)

    rarest = rank[:, 0]
    lists = place[np.arange(len(able)), rarest]
    sizes = offsets[lists + 1] - offsets[lists]
    found_window, found_start = [], []
    cut, total = 0, np.cumsum(sizes)
    while cut < len(able):
        stop = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + CANDIDATES)))
        n = sizes[cut:stop]
        window = np.repeat(np.arange(cut, stop), n)
        within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        start = positions[offsets[lists[window]] + within] - rarest[window]
        for k in range(1, rank.shape[1]):
            if not len(window):
                break
            more = k < length[window]
            column = rank[window, k]
            # the rarest term may itself stand beside its place
            held = ~more | beside(place[window, column] * span + start + column, 2 * slop)
            window, start = window[held], start[held]
        for shift in range(-slop, slop + 1) if slop else ():
            at_window, at_start = window, start + shift
            for k in range(1, rank.shape[1]):
                column = rank[at_window, k]
                held = (k >= length[at_window]) | beside(place[at_window, column] * span + at_start + column, slop)
                at_window, at_start = at_window[held], at_start[held]
            found_window.append(able[at_window])
            found_start.append(at_start)
        if not slop:
            found_window.append(able[window])
            found_start.append(start)
        cut = stop
    return np.concatenate(found_window), np.concatenate(found_start)


def matches(segment: dict[str, np.ndarray], windows: Windows, slop: int) -> Iterator[tuple[int, np.ndarray, list[str], list[str]]]:
    """(document of the segment, its hit words, item_ids of phrases, item_ids of near phrases), documents with any."""
    counts = segment["n_words"]
    begins = _begins(counts)

    def by_document(window: np.ndarray, start: np.ndarray, width: int) -> dict[int, list[str]]:
        # the first word stands at most width words beside start, so start may lie before its document
        doc = np.searchsorted(begins, start + width, side="right") - 1
        found: dict[int, list[str]] = {}
        for d, k in np.unique(np.stack([doc, windows.item[window]]), axis=1).T.tolist():
            found.setdefault(d, []).append(windows.names[k])
        return found

    window, start = find(segment, windows)
    items = by_document(window, start, 0)
    near = by_document(*find(segment, windows, slop), slop) if slop else {}
    hit = np.zeros((int(begins[-1] + counts[-1]) if len(begins) else 0) + GAP + 1, np.int32)
    np.add.at(hit, start, 1)
    np.add.at(hit, start + windows.length[window], -1)
    inside = np.cumsum(hit) > 0
    for d in sorted({*items, *near}):
        yield d, np.flatnonzero(inside[begins[d] : begins[d] + counts[d]]), sorted(set(items.get(d, ()))), sorted(set(near.get(d, ())))


def item_words(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words, n): word hashes of each item of items (item_id, text), long ones in pieces that share size - 1 words.

    Null item_ids count as the empty string; null and wordless texts and repeated items add nothing.
    """
    jobs.small_batches(items.sparkSession)
    if size > PIECE_WORDS // 2:
        raise ValueError(f"a window of {size} words is too long for pieces of {PIECE_WORDS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hashes, counts = [], [], []
            for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = textkit.word_hashes([text], textkit.ALNUM)[0]
                for a in range(0, max(1, len(words) - size + 1) if len(words) else 0, PIECE_WORDS - size + 1):
                    piece = words[a : a + PIECE_WORDS]
                    names.append(name)
                    hashes.append(piece.tobytes())
                    counts.append(len(piece))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hashes, pa.binary()), pa.array(counts, pa.int64())], names=["item_id", "words", "n"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id string, words binary, n long").distinct()


_ARRAYS = {"terms": np.uint64, "offsets": np.int32, "positions": np.int32}


def index(docs: DataFrame) -> DataFrame:
    """Segments of a positional index of docs (doc_id, text), ready to be written: (segment, doc_ids, n_words, arrays as binary).

    offsets and positions are written as steps from the value before, which compress well.
    """
    jobs.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, end, segment in segments(batch.column("text")):
                one = pa.array([0, end - row], pa.int32())
                lists = [pa.ListArray.from_arrays(one, x) for x in (ids.slice(row, end - row), pa.array(segment["n_words"], pa.int64()))]
                steps = {"terms": segment["terms"], "offsets": np.diff(segment["offsets"], prepend=0), "positions": np.diff(segment["positions"], prepend=0)}
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([steps[k].astype(t).tobytes()], pa.binary()) for k, t in _ARRAYS.items())], names=["doc_ids", "n_words", *_ARRAYS])

    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_words", T.ArrayType(T.LongType()))] + [T.StructField(k, T.BinaryType()) for k in _ARRAYS])
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("segment", F.monotonically_increasing_id())


MATCHES = "segment long, nth int, hits array<int>, items array<string>, near array<string>"


def occurrences(indexed: DataFrame, shared: Broadcast[Windows], slop: int) -> DataFrame:
    """(segment, nth, hits, items, near) of each document of a stored index that has matches; nth counts in its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                segment = {name: np.frombuffer(batch.column(name)[k].as_py(), t) for name, t in _ARRAYS.items()}
                for name in ("offsets", "positions"):
                    segment[name] = np.cumsum(segment[name], dtype=np.int64)
                segment["n_words"] = np.array(batch.column("n_words")[k].as_py(), np.int64)
                number = batch.column("segment")[k].as_py()
                rows += [(number, d, hits.tolist(), items, near) for d, hits, items, near in matches(segment, shared.value, slop)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["segment", "nth", "hits", "items", "near"])

    return indexed.select("segment", "n_words", *_ARRAYS).mapInArrow(run, MATCHES)


def search(indexed: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 2) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, n_near_items, contaminated) of each document of a stored index(), stored.

    items: (item_id, text).  A document is contaminated if occurrences of windows cover a twentieth of its words or more.
    n_near_items counts the items with a window whose words all stand at most `slop` words beside their place; 0 leaves
    that search out.
    """
    if size + 2 * slop > GAP:
        raise ValueError(f"a window of {size} words with a slop of {slop} reaches over the gap of {GAP} words between documents")
    spark = indexed.sparkSession
    words = jobs.stored(item_words(items, size), "items")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passes = max(1, -(-total // PASS_WORDS))
    folder = f"{jobs.shared_folder(spark)}/weft-passes-{uuid.uuid4().hex}"
    number = F.pmod(F.xxhash64("item_id", "words"), F.lit(passes)).cast("int")
    words.withColumn("pass", number).repartition("pass").write.partitionBy("pass").parquet(f"{folder}/items")
    jobs.discard(words)
    for k in range(passes):
        place = f"{folder}/items/pass={k}"
        held = spark.read.schema(words.schema).parquet(place).orderBy("item_id", "words").collect() if exists(spark, place) else []  # about PASS_WORDS words
        shared = spark.sparkContext.broadcast(Windows.of([(r["item_id"], np.frombuffer(r["words"], np.uint64)) for r in held], size))
        del held
        occurrences(indexed, shared, slop).write.parquet(f"{folder}/matches/pass={k}")
        shared.destroy()
    every = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hits", "items", "near")]
    met = spark.read.schema(MATCHES).parquet(f"{folder}/matches").groupBy("segment", "nth").agg(*every)
    base = indexed.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("nth", "doc")).select("segment", "nth", "doc.doc_ids", "doc.n_words")
    size_of = {c: F.coalesce(F.size(c), F.lit(0)).cast("long") for c in ("hits", "items", "near")}
    digest = F.sha2(F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit("")).cast("binary"), 256)
    contaminated = (size_of["hits"] > 0) & (20 * size_of["hits"] >= F.col("n_words"))
    judged = base.join(met, ["segment", "nth"], "left").select(
        F.col("doc_ids").alias("doc_id"), "n_words", size_of["hits"].alias("n_hit"), size_of["items"].alias("n_items"), digest.alias("items_sha256"), size_of["near"].alias("n_near_items"), contaminated.alias("contaminated")
    )
    found = jobs.stored(judged, "contamination")
    remove(spark, folder)
    return found


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 2) -> DataFrame:
    """search() over a stored index of docs, which is removed afterwards; the result is a stored table.

    docs has doc_id and text; a null or empty text has no words and is clean.  Repeated rows are judged each; items
    that are null, empty or repeated add nothing.  Without items or documents nothing is contaminated.
    """
    indexed = jobs.stored(index(docs), "index", compression="zstd")
    found = search(indexed, items, size, slop)
    jobs.discard(indexed)
    return found


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    The text alone decides, so texts stand for their rows.  Proximity matches don't make a document contaminated, so they
    are not searched here.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length("text"))
    found = contamination(docs.select(key.alias("doc_id"), "text"), items, size, 0)
    lost = found.where("contaminated").select(F.col("doc_id").alias("__text")).distinct()
    return docs.join(lost, key == F.col("__text"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` against all of `benchmark`."""
    return contamination(jobs.table(spark, sf_dir, "documents"), jobs.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), test_window AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase, w[i:i + least(len(w), 13) - 1] AS words
  FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
), doc_window AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM doc, (SELECT DISTINCT size FROM test_window), unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size
), found AS (
  SELECT DISTINCT doc_id, i, size, item_id FROM doc_window JOIN test_window USING (size, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), posting AS (
  SELECT doc_id, w[p] AS word, p FROM doc, unnest(range(1, len(w) + 1)) AS t(p)
), term AS (
  SELECT item_id, phrase, size, k, words[k + 1] AS word FROM test_window, unnest(range(size)) AS t(k)
), rarest AS (
  SELECT item_id, phrase, size, arg_min(word, (coalesce(n, 0), k)) AS word, min_by(k, (coalesce(n, 0), k)) AS k
  FROM term LEFT JOIN (SELECT word, count(*) AS n FROM posting GROUP BY word) USING (word) GROUP BY ALL
), place AS (
  -- where the rarest word lets the phrase begin
  SELECT DISTINCT doc_id, item_id, phrase, size, p - k + o AS s FROM rarest JOIN posting USING (word), unnest(range(-2, 3)) AS t(o)
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT doc_id, item_id, phrase, size, s
    FROM (SELECT place.*, k, word, s + k + o AS p FROM place JOIN term USING (item_id, phrase, size), unnest(range(-2, 3)) AS t(o)) JOIN posting USING (doc_id, word, p)
    GROUP BY ALL HAVING count(DISTINCT k) = size
  ) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_near, 0)::BIGINT AS n_near_items, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""
