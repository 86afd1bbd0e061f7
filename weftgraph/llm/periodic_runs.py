"""Periodic runs of words, by the LPF-based form of Main's algorithm.

A run is a longest stretch of smallest period q and of length at least max(LEAST, EXPONENT * q), EXPONENT being 2 or more.
The texts of a part lie side by side as word numbers, ranked by (text, word).  Prefix doubling refines the ranks to the
suffix array; the ranks of every level, which name all stretches of 1, 2, 4, ... words, give the LCP of neighbours and
extensions to the left and right.  One pass over suffix array and LCP gives the longest previous factor of each position,
and these give the Lempel-Ziv blocks.

A run that touches a boundary of blocks (one of its words or the word after it begins a block) has a period below the length of
the two blocks there, so extensions at each boundary for each such period find it; these are in all no more than twice the
words.  Every other run lies strictly inside a block, and is the copy of a run that lies strictly inside the block's
earlier occurrence; blocks are copied from left to right, runs by buckets of their starts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import jobs

#: Least exponent and least length of a run; words of texts that are handled together (a longer text is handled alone).
EXPONENT, LEAST, PART = 4, 6, 1 << 16


class Ranks:
    """Ranks of all stretches of 2**k words by level k, and from them suffix array and extensions.

    symbols: a number for each word; end: for each position, where its text ends.  Stretches of different texts differ,
    and so do stretches that a text's end cuts short.
    """

    def __init__(self, symbols: np.ndarray, text: np.ndarray, end: np.ndarray):
        n = self.n = len(symbols)
        key = text * np.int64(symbols.max(initial=0) + 1) + symbols
        order = np.argsort(key)
        fresh = np.diff(key[order], prepend=-1) != 0
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.levels = [rank]
        width = 1
        open_ = order[~(fresh & np.append(fresh[1:], True))]
        while len(open_):
            there = open_ + width
            second = np.where(there < end[open_], rank[np.minimum(there, n)], -1)
            key = rank[open_] * np.int64(n + 1) + second + 1
            by = np.argsort(key)
            key, open_ = key[by], open_[by]
            index = np.arange(len(key))
            fresh = np.diff(key, prepend=-1) != 0
            first = np.diff(key // (n + 1), prepend=-1) != 0
            rank = rank.copy()
            rank[open_] += np.maximum.accumulate(np.where(fresh, index, 0)) - np.maximum.accumulate(np.where(first, index, 0))
            self.levels.append(rank)
            open_ = open_[~(fresh & np.append(fresh[1:], True))]
            width *= 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank[:n]] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretches that begin at a and b, which differ."""
        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
            a += step
            b += step
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretches that end with a and b, which differ; -1 is no position."""
        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.levels) - 1, -1, -1):
            low = (1 << k) - 1
            x, y = a - low, b - low
            same = (self.levels[k][np.maximum(x, 0)] == self.levels[k][np.maximum(y, 0)]) & (x >= 0) & (y >= 0)
            step = same.astype(np.int64) << k
            a -= step
            b -= step
        return start - a


def previous_factors(ranks: Ranks) -> tuple[list[int], list[int]]:
    """(length, place) of the longest earlier occurrence of what begins at each position; it may overlap the position."""
    n, suffixes, first = ranks.n, ranks.suffixes, ranks.levels[0]
    same = first[suffixes[1:]] == first[suffixes[:-1]]
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(same)
    lcp[at + 1] = ranks.forward(suffixes[at], suffixes[at + 1])
    length, place = [0] * n, [-1] * n
    some = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False)) if n else at
    positions: list[int] = []
    shared: list[int] = []  # with the position below
    for i, common in zip(suffixes[some].tolist(), lcp[some].tolist(), strict=True):
        while positions and positions[-1] > i:
            top, left = positions.pop(), shared.pop()
            if left >= common:
                length[top], place[top] = left, positions[-1] if positions else -1
            else:
                length[top], place[top] = common, i
            common = min(common, left)
        positions.append(i)
        shared.append(common)
    while positions:
        top, left = positions.pop(), shared.pop()
        if left:
            length[top], place[top] = left, positions[-1]
    return length, place


def touching(ranks: Ranks, bound: np.ndarray, most: np.ndarray, end: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs that touch a bound, found with periods up to its `most`; end: of the bound's text."""
    n, first = ranks.n, ranks.levels[0]
    s, stop = np.repeat(bound, most), np.repeat(end, most)
    p = np.arange(len(s)) - np.repeat(np.cumsum(most) - most, most) + 1
    found = []
    for low in (s, s - p):  # a whole period lies behind the bound, or before it
        high = low + p
        inside = (low >= 0) & (high <= stop)
        ahead = inside & (high < stop)
        ahead &= first[np.minimum(low, n)] == first[np.minimum(high, n)]
        behind = inside & (low > 0)
        behind &= first[np.clip(low - 1, 0, n)] == first[np.clip(high - 1, 0, n)]
        at = np.flatnonzero(ahead | behind)
        a, b, q = low[at], high[at], p[at]
        x, y = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        some = np.flatnonzero(ahead[at])
        x[some] = ranks.forward(a[some], b[some])
        some = np.flatnonzero(behind[at])
        y[some] = ranks.backward(a[some] - 1, b[some] - 1)
        keep = x + y + q >= np.maximum(least, exponent * q)
        found.append((a - y)[keep])
        found.append((x + y + q)[keep])
        found.append(q[keep])
    start, length, period = (np.concatenate(found[k::3]) for k in range(3))
    order = np.lexsort((period, length, start))  # of periods of one stretch the smallest is first
    start, length, period = start[order], length[order], period[order]
    keep = (np.diff(start, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0)
    return start[keep], length[keep], period[keep]


def runs_of_texts(texts: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period. A text is an array of word numbers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not total:
        return out
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    ranks = Ranks(np.concatenate(texts).astype(np.int64), text, ends[text])
    length, place = previous_factors(ranks)
    blocks = []
    at = 0
    while at < total:  # a text's first word has no earlier occurrence, so each text begins a block
        blocks.append(at)
        at += length[at] or 1
    block = np.array(blocks)
    size = np.diff(block, append=total)
    of = text[block]
    opens = np.diff(of, prepend=-1) != 0
    before = np.where(opens, 0, np.insert(size[:-1], 0, 0))
    closes = np.append(np.flatnonzero(opens)[1:] - 1, len(block) - 1)  # last block of each text that has words
    bound = np.concatenate((block, ends[of[closes]]))
    most = np.concatenate((before + size, size[closes])) - 1
    start, stretch, period = touching(ranks, bound, most, np.concatenate((ends[of], ends[of[closes]])), exponent, least)
    if not len(start):
        return out
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, l, q in zip(start.tolist(), stretch.tolist(), period.tolist(), strict=True):
        buckets[i].append((l, q))
    some = np.zeros(len(texts), bool)
    some[text[start]] = True
    for k in np.flatnonzero(some[of] & (size >= least + 2)).tolist():
        here = blocks[k]
        last, shift = place[here] + int(size[k]) - 1, here - place[here]
        for i in range(place[here] + 1, last):
            if i in buckets:
                for l, q in buckets[i]:
                    if i + l <= last:
                        buckets[i + shift].append((l, q))
    for i in sorted(buckets):
        k = int(text[i])
        shift = int(ends[k] - sizes[k])
        out[k].extend((i - shift, l, q) for q, l in sorted((q, l) for l, q in buckets[i]))
    return out


def word_numbers(words: list[list[bytes]]) -> list[np.ndarray]:
    """Numbers of the words of some texts; equal words have equal numbers."""
    flat = pa.array([w for text in words for w in text], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.cumsum([len(text) for text in words])
    return np.split(flat, cuts[:-1])


def parts(sizes: list[int], most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` words."""
    row = 0
    while row < len(sizes):
        end, total = row + 1, sizes[row]
        while end < len(sizes) and total + sizes[end] <= most:
            total += sizes[end]
            end += 1
        yield row, end
        row = end


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space; null has none."""
    return (text or "").encode().split()


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def repeated_tail(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words as the query takes them: for one doc_id in ten, by its CRC, the words from a place on repeat with a period; a null doc_id counts as an empty one."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length over period; ties go by start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(doc_id, start, length, period) of each run of each row of docs; start counts words from 0.

    docs has doc_id and text; other columns are not read.  Null, empty and blank texts have no runs; rows of one doc_id
    each give theirs.  A text is handled whole, in memory that grows with its words times the log of its longest repeat.
    """
    if exponent < 2:
        raise ValueError("runs of less than two periods can't be enumerated")
    jobs.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split(t.as_py()) for t in batch.column("text")]
            for row, end in parts([len(w) for w in words]):
                found = [(row + k, *r) for k, rs in enumerate(runs_of_texts(word_numbers(words[row:end]), exponent, least)) for r in rs]
                ids = batch.column("doc_id").take(pa.array([r[0] for r in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in found], pa.int64()) for k in (1, 2, 3))], names=["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, period long")


def collapsed(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """docs with each run of each text cut to its first period: its words are joined by one space; null stays null."""
    jobs.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            words = [split(t.as_py()) for t in batch.column("text")]
            texts: list[str | None] = []
            for row, end in parts([len(w) for w in words]):
                for ws, rs in zip(words[row:end], runs_of_texts(word_numbers(words[row:end]), exponent, least), strict=True):
                    texts.append(b" ".join(np.array(ws, object)[kept(len(ws), rs)] if rs else ws).decode())
            column = pa.array([t if v else None for t, v in zip(texts, batch.column("text").is_valid().to_pylist(), strict=True)], pa.string())
            yield batch.set_column(at, "text", column)

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of docs: runs of its words, their tail repeated where the doc_id says so."""
    jobs.small_batches(docs.sparkSession)
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, whole.num_rows, 200):
                batch = whole.slice(cut, 200)
                words = [repeated_tail(split(t.as_py()), d) for t, d in zip(batch.column("text"), batch.column("doc_id").to_pylist(), strict=True)]
                rows = []
                for row, end in parts([len(w) for w in words]):
                    for ws, rs in zip(words[row:end], runs_of_texts(word_numbers(words[row:end])), strict=True):
                        best = greatest(rs)
                        listed = "".join(f"{a},{b},{c}\n" for a, b, c in rs).encode()
                        stay = b" ".join(np.array(ws, object)[kept(len(ws), rs)] if rs else ws)
                        rows.append((len(rs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(stay).hexdigest()))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", *numbers, "runs_sha256", "collapsed_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in numbers)}, runs_sha256 string, collapsed_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return digests(jobs.table(spark, sf_dir, "documents"))
