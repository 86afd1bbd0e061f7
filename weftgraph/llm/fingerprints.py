"""Document fingerprints by improbable features.

A feature is a window of 32 bytes.  A window starts at every byte and has the entropy of its bytes, folded to 32
classes.  How rare an entropy is among all windows of the corpus ranks the windows; the one of lowest rank among its
neighbours is selected.  Distinct features go in order into a chain of Bloom filters of 256 bytes, 160 features each.
Two filters are compared by their common bits beyond those expected by chance, over the most there
could be; two chains by the mean, over the filters of the shorter one by their bits, of the best match in the other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import jobs, textkit
from weftgraph.llm.textkit import U

#: Bytes of a window, entropy levels, windows on either side of a feature, bits and features of a filter, bits of a feature.
WINDOW, LEVELS, NEIGHBOURS, BITS, FEATURES, HASHES = 32, 1000, 12, 2048, 160, 5
#: Bytes of text handled at once; their counters stay in a core's cache.
PART = 1 << 16

# letters regardless of case, white space, digits, punctuation, control bytes, lead and continuation bytes of UTF-8
_CLASS = np.full(256, 28, np.int64)
_CLASS[:32] = 29
_CLASS[[9, 10, 11, 12, 13, 32]] = 26
_CLASS[48:58] = 27
_CLASS[65:91] = _CLASS[97:123] = np.arange(26)
_CLASS[0x80:0xC0] = 31
_CLASS[0xC0:] = 30
#: Four words of eight 8-bit counters: what a byte adds to each.
_COUNTER = [np.where(_CLASS // 8 == k, U(1) << (8 * (_CLASS % 8)).astype(np.uint64), U(0)) for k in range(4)]
_FOLDED = _CLASS.astype(np.uint8)
#: Terms of the entropy as whole numbers, so that running sums are exact wherever a text lies.
_ONE = 1 << 32
_TERM = np.array([round(c * np.log2(c) * _ONE) if c else 0 for c in range(WINDOW + 2)], np.int64)
#: What the c-th byte of a class adds to the sum of terms.
_GAIN = np.diff(_TERM, prepend=0)


def terms(data: np.ndarray) -> np.ndarray:
    """The sum of _TERM over the classes' counts in the WINDOW bytes from each position on."""
    n = len(data) - WINDOW + 1
    running = np.zeros((4, len(data) + 1), np.uint64)
    for k in range(4):
        np.cumsum(_COUNTER[k][data], out=running[k, 1:])
    counts = (running[:, WINDOW:] - running[:, :-WINDOW]).astype("<u8").view(np.uint8).ravel()
    folded = _FOLDED[data]
    out = np.empty(n, np.int64)
    out[0] = _TERM[np.bincount(folded[:WINDOW])].sum()
    gone, new = folded[: n - 1], folded[WINDOW:]
    byte = np.arange(32) // 8 * (8 * n) + np.arange(32) % 8  # of the first window's count of each class
    here = np.arange(0, 8 * (n - 1), 8)
    step = _GAIN[counts[byte[new] + here] + 1] - _GAIN[counts[byte[gone] + here]]
    step[gone == new] = 0
    np.cumsum(step, out=out[1:])
    out[1:] += out[0]
    return out


def levels(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, entropy level) of the windows of texts that lie in data from `at` up to `ends`, in order."""
    none = np.zeros(0, np.int64)
    if len(data) <= WINDOW:
        return none, none, none
    sizes = np.maximum(0, ends - at - WINDOW + 1)
    text = np.repeat(np.arange(len(at)), sizes)
    start = np.arange(len(text)) + np.repeat(at - np.cumsum(sizes) + sizes, sizes)
    scale = LEVELS / np.log2(WINDOW)
    return text, start, np.clip((LEVELS - terms(data)[start] * (scale / (_ONE * WINDOW))).astype(np.int64), 0, LEVELS - 1)


def windows(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, entropy level, hash) of the windows."""
    text, start, level = levels(data, at, ends)
    up, down = textkit._powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(textkit._BYTE[data] * up[:-1], out=sums[1:])
    return text, level, textkit.mix((sums[start + WINDOW] - sums[start]) * down[start])


def selected(text: np.ndarray, level: np.ndarray, hashed: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows have the lowest rank, ties by hash, among NEIGHBOURS on either side in their text."""
    key = (rank[level].astype(np.uint64) << U(48)) | (hashed >> U(16))
    # texts lie farther apart than neighbours
    place = np.arange(NEIGHBOURS, NEIGHBOURS + len(key)) + (NEIGHBOURS * text if len(key) else 0)
    least = np.full((int(place[-1]) if len(key) else 0) + NEIGHBOURS + 1, ~U(0))
    least[place] = key
    width = 1
    while width < 2 * NEIGHBOURS + 1:
        step = min(width, 2 * NEIGHBOURS + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return key == least[place - NEIGHBOURS]


def chain(features: np.ndarray) -> np.ndarray:
    """Filters (rows of BITS bits, packed) of the features in order."""
    filters = -(-len(features) // FEATURES)
    bits = np.zeros((filters, BITS), bool)
    row = np.arange(len(features)) // FEATURES
    for k in range(HASHES):
        bits[row, ((features >> U(11 * k)) & U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def chains(texts: Iterable[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The chain of each text; a text without a whole window is one feature, an empty one has no filter."""
    out: list[np.ndarray] = []
    for row, _, data, at in textkit.chunks(pa.array(list(texts), pa.binary()).cast(pa.large_binary()).view(pa.large_string()), PART):
        ends = np.append(at[1:], len(data)) - 1
        text, level, hashed = windows(data, at, ends)
        keep = selected(text, level, hashed, rank)
        text, hashed = text[keep], hashed[keep]
        first = np.searchsorted(text, np.arange(len(at) + 1))
        for k in range(len(at)):
            features = hashed[first[k] : first[k + 1]]
            features = features[np.sort(np.unique(features, return_index=True)[1])]
            if not len(features) and ends[k] > at[k]:
                features = np.array([int.from_bytes(hashlib.sha256(data[at[k] : ends[k]].tobytes()).digest()[:8], "big")], np.uint64)
            out.append(chain(features))
        assert len(out) == row + len(at)
    return out


def written(filters: np.ndarray) -> str:
    """A chain as text: the filters in base64, colon-joined."""
    return ":".join(base64.b64encode(f.tobytes()).decode() for f in filters)


def read(fingerprint: str) -> np.ndarray:
    rows = [np.frombuffer(base64.b64decode(f), np.uint8) for f in fingerprint.split(":") if f]
    return np.stack(rows) if rows else np.zeros((0, BITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for two empty chains, 0 for an empty one and another."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    ones_a, ones_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    score = 0.0
    for f, n in zip(a, ones_a, strict=True):
        common = np.bitwise_count(b & f).sum(axis=1, dtype=np.int64)
        chance = n * ones_b / BITS
        score += int(n) * float(np.clip((common - chance) / np.maximum(np.maximum(n, ones_b) - chance, 1e-9), 0.0, 1.0).max())
    return min(1.0, score / int(ones_a.sum()))


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level, rarest first, by the counts of all windows of all texts."""
    jobs.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for _, _, data, at in textkit.chunks(batch.column("text"), PART):
                total += np.bincount(levels(data, at, np.append(at[1:], len(data)) - 1)[2], minlength=LEVELS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["level", "n"])

    found = docs.select("text").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for row in found:  # LEVELS rows at most
        counts[row["level"]] = row["n"]
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return rank


def fingerprints(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint) of each row of docs, under the ranks of rarity()."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(written, chains(texts, shared.value)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def neighbours(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows (place, tail, doc_id, packed text) dealt into ranges of doc_id; each range ends with the first row of the next.

    The ranges follow approximate quantiles of doc_id; null doc_ids come last.  Only the bounds of the ranges and the
    first doc_id of each pass through the driver.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = 4 * jobs.partitions(spark)
    bounds = sorted(set(docs.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)))
    cuts = np.array(bounds, np.float64)

    def places(ids: pa.Array) -> np.ndarray:
        values = ids.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
        return np.searchsorted(cuts, values, side="right")  # nan goes last

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(batch.column("doc_id")), pa.int32()), batch.column("doc_id")], names=["place", "doc_id"])

    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))
    first = docs.select("doc_id").mapInArrow(numbers, f"place int, doc_id {kind}").groupBy("place").agg(F.min(order).alias("f")).orderBy("place").collect()
    # the first doc_id of a range also goes to the end of the range before it, that of the first to the last
    before = {first[k]["f"]["d"]: first[k - 1]["place"] for k in range(len(first))}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            place, ids = places(batch.column("doc_id")), batch.column("doc_id").to_pylist()
            packed = [packer.compress((x.as_py() or "").encode()) for x in batch.column("text")]
            extra = [k for k, d in enumerate(ids) if d in before]
            rows = [*range(len(ids)), *extra]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*place.tolist(), *(before[ids[k]] for k in extra)], pa.int32()),
                    pa.array([0] * len(ids) + [1] * len(extra), pa.int32()),
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array([packed[k] for k in rows], pa.binary()),
                ],
                names=["place", "tail", "doc_id", "packed"],
            )

    dealt = docs.select("doc_id", "text").mapInArrow(deal, f"place int, tail int, doc_id {kind}, packed binary")
    return dealt.repartition(jobs.partitions(spark), "place").sortWithinPartitions("place", "tail", F.col("doc_id").asc_nulls_last(), "packed"), kind


def compared(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """Each row of docs against its edited text and the next document, see query().

    docs has doc_id (a number) and text; a null text is as empty.  Rows go by doc_id, null last, and by packed text
    where doc_ids repeat.  Equal texts have equal fingerprints.  An empty table gives an empty result.
    """
    jobs.small_batches(docs.sparkSession)
    rows, kind = neighbours(docs)
    shared = docs.sparkSession.sparkContext.broadcast(rank)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        held = None  # place, tail, doc_id, text, chain of the row that still lacks its next
        for batch in batches:
            for cut in range(0, batch.num_rows, 200):
                part = batch.slice(cut, 200)
                texts = [unpacker.decompress(x) for x in part.column("packed").to_pylist()]
                have = list(zip(part.column("place").to_pylist(), part.column("tail").to_pylist(), part.column("doc_id").to_pylist(), (t.decode() for t in texts), chains(texts, shared.value), strict=True))
                have = have if held is None else [held, *have]
                pairs = [(a, b) for a, b in zip(have, have[1:], strict=False) if a[0] == b[0] and not a[1]]
                held = have[-1]
                edited = []
                for a, b in pairs:
                    quarter = len(a[3]) // 4
                    edited.append((a[3][: len(a[3]) - quarter] + b[3][:quarter]).encode())
                altered = chains(edited, shared.value)
                columns = [
                    [a[2] for a, _ in pairs],
                    [len(a[3]) for a, _ in pairs],
                    [hashlib.sha256(e).hexdigest() for e in edited],
                    [written(a[4]) for a, _ in pairs],
                    [written(c) for c in altered],
                    [likeness(a[4], c) for (a, _), c in zip(pairs, altered, strict=True)],
                    [likeness(a[4], b[4]) for a, b in pairs],
                ]
                kinds = [part.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: fingerprints, and likeness to the edited text and to the next document."""
    docs = jobs.table(spark, sf_dir, "documents").select("doc_id", "text")
    return compared(docs, rarity(docs))
