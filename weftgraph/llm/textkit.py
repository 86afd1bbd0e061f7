"""Byte-level text helpers for tasks: word boundaries, word hashes and shingles of a whole Arrow batch at once.

Texts of a batch are laid side by side in one UTF-8 buffer with a separator between them, so that one pass of numpy
finds the words of all of them.  Two words, or two runs of words, count as equal when their 64-bit hashes are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` over text whose A-Z are lower-cased.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = True
ALNUM[0x80:] = True
#: Bytes of text handled at once in a task.
CHUNK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each text, byte length of each text) of a string column; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def chunks(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column of about `most` bytes, else CHUNK: (first row, end row, bytes with a space after each text, text starts)."""
    most = most or CHUNK
    data, starts, lengths = buffers(column)
    row, n = 0, len(starts)
    while row < n:
        end = row + 1
        total = int(lengths[row]) + 1
        while end < n and total + lengths[end] + 1 <= most:
            total += int(lengths[end]) + 1
            end += 1
        out = np.full(total, 0x20, dtype=np.uint8)
        at = np.zeros(end - row, dtype=np.int64)
        position = 0
        for k in range(row, end):
            at[k - row] = position
            out[position : position + lengths[k]] = data[starts[k] : starts[k] + lengths[k]]
            position += int(lengths[k]) + 1
        yield row, end, out, at
        row = end


def words(data: np.ndarray, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word of the bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = is_word[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[LOWER[data] if lower else data] * up[:-1], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * down[start])


def word_hashes(texts: list[str], is_word: np.ndarray) -> list[np.ndarray]:
    """Word hashes of a few texts, one array each."""
    out = []
    for text in texts:
        data = np.frombuffer((text or "").encode() + b" ", dtype=np.uint8)
        out.append(words(data, is_word)[2])
    return out


def run_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    if len(word) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(word) - n + 1, dtype=np.uint64)
    for j in range(n):
        total += word[j : j + len(total)] * _STEP[j]
    return mix(total + U(n))


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; a text of fewer than n words has its whole sequence as one."""
    for row, end, data, at in chunks(column):
        start, _, hashed = words(data, NOT_SPACE)
        first = np.searchsorted(start, at)
        last = np.append(first[1:], len(start))
        runs = run_hashes(hashed, n)
        for k in range(end - row):
            a, b = int(first[k]), int(last[k])
            if b - a >= n:
                yield row + k, np.unique(runs[a : b - n + 1])
            elif b > a:
                yield row + k, run_hashes(hashed[a:b], b - a)
            else:
                yield row + k, np.zeros(0, dtype=np.uint64)
