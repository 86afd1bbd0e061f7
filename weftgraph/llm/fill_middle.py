"""Fill-in-the-middle: texts cut at unit boundaries and put in prefix, suffix, middle order, by a table-driven byte DFA.

A unit is a run of white space with the word after it, or white space at the end.  One scan of the bytes runs a DFA whose
states tell apart the start of a text, white space, words, how many UTF-8 continuation bytes are still due, and how much
of a sentinel `<P>`, `<S>` or `<M>` is read.  Its transitions emit code points, ends of units and whole sentinels, and the
scan keeps only their counts for every stretch of STRETCH bytes.  A second pass takes a cut to the stretch whose counts
hold it and runs the DFA there again, from the state the first pass met, to find the byte.

Texts of an Arrow batch lie side by side, a byte 0xFF, which UTF-8 never has, after each.  All stretches are scanned at
once: from each state they could begin in first, then, when the states are known, from the right one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import jobs, textkit

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a stretch of the scan; bytes of texts that are scanned together.
STRETCH, PART = 256, 1 << 19
#: Percent of texts that are transformed, and of those the percent in suffix-first order.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42

START, SPACE, WORD, OPEN, NAMED, DUE1, DUE2, DUE3 = range(8)
STATES = 8
POINT, UNIT, SENTINEL = 1, 2, 4
_END, _BLANK, _LESS, _LETTER, _MORE, _CONTINUED, _LEAD2, _LEAD3, _LEAD4, _OTHER = range(10)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and byte."""
    kind = np.full(256, _OTHER)
    kind[[0x20, *range(9, 14)]] = _BLANK
    kind[ord("<")], kind[ord(">")], kind[[ord(s[1]) for s in SENTINELS]] = _LESS, _MORE, _LETTER
    kind[0x80:0xC0], kind[0xC0:0xE0], kind[0xE0:0xF0], kind[0xF0:0xFF], kind[0xFF] = _CONTINUED, _LEAD2, _LEAD3, _LEAD4, _END
    to, emits = np.full((STATES, 10), WORD, np.uint8), np.full((STATES, 10), POINT, np.uint8)
    to[:, _END], emits[:, _END] = START, UNIT
    emits[START, _END] = 0
    to[:, _BLANK] = SPACE
    emits[WORD:, _BLANK] |= UNIT
    to[:, _LESS], to[OPEN, _LETTER] = OPEN, NAMED
    emits[NAMED, _MORE] |= SENTINEL
    to[:, _LEAD2], to[:, _LEAD3], to[:, _LEAD4] = DUE1, DUE2, DUE3
    for state, after in ((DUE3, DUE2), (DUE2, DUE1), (DUE1, WORD)):
        to[state, _CONTINUED], emits[state, _CONTINUED] = after, 0
    return to[:, kind], emits[:, kind]


TO, EMITS = _tables()
_TO, _EMITS = TO.ravel(), EMITS.ravel()


class Scan(NamedTuple):
    """A scanned buffer: bytes in stretches (one row a column), the state each begins in, and emissions before each."""

    data: np.ndarray
    entry: np.ndarray
    points: np.ndarray
    units: np.ndarray
    sentinels: np.ndarray


def scanned(data: np.ndarray) -> Scan:
    """First pass over bytes that begin at the start of a text."""
    stretches = -(-len(data) // STRETCH)
    padded = np.full(stretches * STRETCH, 0xFF, np.uint8)
    padded[: len(data)] = data
    columns = np.ascontiguousarray(padded.reshape(stretches, STRETCH).T)
    ends = np.broadcast_to(np.arange(STATES, dtype=np.uint8)[:, None], (STATES, stretches))
    for column in columns:
        ends = _TO[ends.astype(np.intp) * 256 + column]
    entry = np.zeros(stretches, np.intp)
    state = START
    for k, after in enumerate(ends.T.tolist()):
        entry[k] = state
        state = after[state]
    counts = np.zeros((3, stretches), np.int64)
    state = entry.astype(np.uint8)
    for column in columns:
        at = state.astype(np.intp) * 256 + column
        emitted = _EMITS[at]
        counts[0] += emitted & POINT
        counts[1] += (emitted & UNIT) >> 1
        counts[2] += (emitted & SENTINEL) >> 2
        state = _TO[at]
    before = np.zeros((3, stretches + 1), np.int64)
    np.cumsum(counts, axis=1, out=before[:, 1:])
    return Scan(columns, entry, *before)


def emissions(scan: Scan, which: np.ndarray) -> np.ndarray:
    """What each byte of some stretches emits: a row for each stretch."""
    out = np.empty((len(which), STRETCH), np.uint8)
    state = scan.entry[which]
    for k in range(STRETCH):
        at = state * 256 + scan.data[k, which]
        out[:, k] = _EMITS[at]
        state = _TO[at].astype(np.intp)
    return out


def counts_before(scan: Scan, at: np.ndarray) -> np.ndarray:
    """Rows (points, units, sentinels): emissions of the bytes before each position."""
    which, rest = np.minimum(at // STRETCH, len(scan.entry) - 1), at % STRETCH
    rest = np.where(at // STRETCH >= len(scan.entry), STRETCH, rest)
    stretch, back = np.unique(which, return_inverse=True)
    found = emissions(scan, stretch)
    out = np.empty((3, len(at)), np.int64)
    for k, (bit, before) in enumerate(((POINT, scan.points), (UNIT, scan.units), (SENTINEL, scan.sentinels))):
        running = np.zeros((len(stretch), STRETCH + 1), np.int64)
        np.cumsum((found & bit) > 0, axis=1, out=running[:, 1:])
        out[k] = before[which] + running[back, rest]
    return out


def places(scan: Scan, before: np.ndarray, bit: int, number: np.ndarray) -> np.ndarray:
    """Second pass: position of the byte that emits the number-th (from 1) of a kind in the buffer; before is that kind's counts."""
    which = np.searchsorted(before, number, side="left") - 1
    stretch, back = np.unique(which, return_inverse=True)
    running = np.cumsum((emissions(scan, stretch) & bit) > 0, axis=1)
    return which * STRETCH + (running[back] < (number - before[which])[:, None]).sum(axis=1)


def draws(doc_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of a document, by its decimal doc_id; null has none."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(found[8 * k : 8 * k + 8], 16) for k in range(4))


class Cut(NamedTuple):
    """A transformed text; bytes. middle_chars and prefix_chars are None where the form is plain."""

    units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def transformed(texts: pa.Array, ids: list[object], rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> Iterator[Cut]:
    """The transformation of each text, in order."""
    for row, end, data, at in textkit.chunks(texts, PART):
        ends = np.append(at[1:], len(data)) - 1  # of the byte after each text
        data[ends] = 0xFF
        scan = scanned(data)
        # a text's last unit ends on its 0xFF
        first, last = counts_before(scan, at), counts_before(scan, ends + 1)
        units, named = last[1] - first[1], last[2] - first[2]
        drawn = [draws(ids[k], seed) for k in range(row, end)]
        forms = ["plain" if not n or s or d[2] % 100 >= rate else "spm" if d[3] % 100 < suffix_first else "psm" for n, s, d in zip(units.tolist(), named.tolist(), drawn, strict=True)]
        cut = [k for k, form in enumerate(forms) if form != "plain"]
        number = np.array([sorted((drawn[k][0] % (n + 1), drawn[k][1] % (n + 1))) for k in cut for n in [int(units[k])]], np.int64).reshape(-1, 2)
        start, stop = at[cut][:, None], ends[cut][:, None]
        # the byte that ends a unit is the first of the next, so it stands where the cut is
        spot = np.where(number > 0, places(scan, scan.units, UNIT, np.maximum(first[1][cut][:, None] + number, 1).ravel()).reshape(-1, 2), start) if cut else number
        points = counts_before(scan, spot.ravel())[0].reshape(-1, 2) - first[0][cut][:, None] if cut else number
        where = {k: j for j, k in enumerate(cut)}
        for k, form in enumerate(forms):
            text = data[at[k] : ends[k]].tobytes()
            if form == "plain":
                yield Cut(int(units[k]), form, None, None, text)
                continue
            j = where[k]
            a, b = (spot[j] - start[j]).tolist()
            parts = {"P": text[:a], "M": text[a:b], "S": text[b : int(stop[j, 0] - start[j, 0])]}
            yield Cut(int(units[k]), form, int(points[j, 0]), int(points[j, 1] - points[j, 0]), b"".join(f"<{p}>".encode() + parts[p] for p in ("SPM" if form == "spm" else "PSM")))


def restored(outputs: list[bytes], forms: list[str]) -> Iterator[bytes]:
    """The texts that outputs of transformed() were made from: one scan finds the sentinels, which no part holds."""
    for row, end, data, at in textkit.chunks(pa.array(outputs, pa.binary()).cast(pa.large_binary()).view(pa.large_string()), PART):
        ends = np.append(at[1:], len(data)) - 1
        data[ends] = 0xFF
        scan = scanned(data)
        cut = [k for k in range(end - row) if forms[row + k] != "plain"]
        number = counts_before(scan, at[cut])[2][:, None] + np.arange(1, 4) if cut else np.zeros((0, 3), np.int64)
        closed = places(scan, scan.sentinels, SENTINEL, number.ravel()).reshape(-1, 3) if cut else number
        where = {k: j for j, k in enumerate(cut)}
        for k in range(end - row):
            output = data[at[k] : ends[k]].tobytes()
            if k not in where:
                yield output
                continue
            x, y, z = (closed[where[k]] - at[k] + 1).tolist()
            parts = {chr(output[e - 2]): output[e:f] for e, f in ((x, y - 3), (y, z - 3), (z, len(output)))}
            yield parts["P"] + parts["M"] + parts["S"]


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output of each row; docs has doc_id and text.

    A null text is as empty: no units, form plain, an empty output.  A null doc_id draws as an empty one; rows of one
    doc_id draw alike.  Columns of docs that have one of the five names are replaced, others stay.
    """
    jobs.small_batches(docs.sparkSession)
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(transformed(batch.column("text"), batch.column("doc_id").to_pylist(), rate, suffix_first, seed))
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns, pa.array([x.output.decode() for x in found], pa.string())], names=[*kept, *names])

    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{held}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """made, which has output and form of transform(), with the text they were made from as `restored`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = restored([(x.as_py() or "").encode() for x in batch.column("output")], batch.column("form").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.decode() for x in texts], pa.string())], names=[*batch.schema.names, "restored"])

    jobs.small_batches(made.sparkSession)
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return made.mapInArrow(run, f"{held}, restored string")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): transform() and restore() in one pass over the rows."""
    jobs.small_batches(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, whole.num_rows, 200):
                batch = whole.slice(cut, 200)
                found = list(transformed(batch.column("text"), batch.column("doc_id").to_pylist()))
                columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                back = restored([x.output for x in found], [x.form for x in found])
                shas = [pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()) for texts in ((x.output for x in found), back)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *shas], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return digests(jobs.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS unit FROM d),
k AS (SELECT *, len(unit) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM u),
f AS (SELECT *, CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
p AS (SELECT *, coalesce(array_to_string(unit[1:a], ''), '') AS prefix, coalesce(array_to_string(unit[a + 1:b], ''), '') AS middle, coalesce(array_to_string(unit[b + 1:], ''), '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM p
"""
