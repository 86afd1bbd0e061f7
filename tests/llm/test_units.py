"""Periodic runs, fill-in-the-middle and exact duplicates against brute force, with nulls, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, fill_middle, periodic_runs

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, n string, form int, row string, kept string, start string"
TEXTS = [None, "", " ", "one", "One", "ONE", "a b " * 3000, "A b " * 3000, "x y z\n" * 40 + "end", "été 漢字 😀 <P> in it", "é " * 5000, "É " * 5000, "w " * 6, "w " * 5, "\t lead and tail \x0b", "no\x1cbreak no\x1cbreak", "<P", "a<S", "M>b " * 9]


def rows() -> list[tuple]:
    found = [(k, t, "n", 1, "r", "k", "s") for k, t in enumerate(TEXTS * 3)]
    return [*found, found[4], (None, "one", "n", 1, "r", "k", "s"), (None, "only here", "n", 1, "r", "k", "s"), (None, "only here", "n", 1, "r", "k", "s"), (4, "oNe", "n", 1, "r", "k", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11


def brute_runs(words: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    found: dict = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((i, l, p) for (i, l), p in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n: int) -> list[int]:
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7)), max_size=6), min_size=1, max_size=4), st.sampled_from([(2, 2), (2, 6), (3, 1), (4, 6)]), st.integers(1, 3))
def test_runs_of_texts(pieces, bounds, times):
    texts = [[w for unit, n in text for w in unit * n] * times for text in pieces]
    got = periodic_runs.runs_of_texts([np.array(t, np.int64) for t in texts], *bounds)
    assert got == [brute_runs(t, *bounds) for t in texts]


def test_runs_of_regular_texts():
    texts = [fibonacci(600), [7] * 500, [1, 2] * 300 + [1], list(range(300)), [*range(20)] * 30, [0] * 5, [0] * 6, [*([1] * 50 + [2]) * 8]]
    for bounds in ((2, 2), (4, 6)):
        assert periodic_runs.runs_of_texts([np.array(t, np.int64) for t in texts], *bounds) == [brute_runs(t, *bounds) for t in texts]


def test_run_digests(spark, docs, empty):
    for row in periodic_runs.digests(docs).collect():
        texts = [r[1] for r in rows() if r[0] == row["doc_id"]]
        want = []
        for text in texts:
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            h = zlib.crc32(b"" if row["doc_id"] is None else str(row["doc_id"]).encode())
            n, g = len(words), h // 10
            if h % 10 == 0 and n:
                a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            found = brute_runs(words) if n < 2000 else periodic_runs.runs_of_texts(periodic_runs.word_numbers([[w.encode() for w in words]]))[0]
            best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
            stay = [w for i, w in enumerate(words) if not any(s + p <= i < s + l for s, l, p in found)]
            listed = "".join(f"{s},{l},{p}\n" for s, l, p in found)
            want.append((len(found), *best, 1000 * best[1] // best[2] if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, " ".join(stay)))))
        assert tuple(row)[1:] in want, row
    assert periodic_runs.digests(docs).count() == len(rows())
    assert periodic_runs.digests(empty).count() == periodic_runs.runs(empty).count() == periodic_runs.collapsed(empty).count() == 0


def test_runs_and_collapsed(spark, docs):
    found = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in periodic_runs.runs(docs.where("doc_id in (6, 8, 12, 13)")).collect()}
    assert found == {(6, 0, 6000, 2), (8, 0, 120, 3), (12, 0, 6, 1)}
    texts = {r["doc_id"]: r for r in periodic_runs.collapsed(docs.where("doc_id < 19")).collect()}
    assert texts[0]["text"] is None and texts[1]["text"] == "" and texts[6]["text"] == "a b" and texts[8]["text"] == "x y z end" and texts[6]["start"] == "s"
    assert periodic_runs.collapsed(docs).columns == docs.columns
    with pytest.raises(ValueError):
        periodic_runs.runs(docs, exponent=1)


def test_long_text_of_runs():
    words = np.array([1, 2, 3, 4, 5] * 60_000)
    assert periodic_runs.runs_of_texts([words]) == [[(0, 300_000, 5)]]


# 12


def brute_middle(doc_id, text: str | None, rate: int) -> tuple:
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["<", "P", "S", "M", ">", " ", "\t", "\r", "a", "é", "漢", "😀", "\x00", "\x1c", "word", "x" * 300]), max_size=400).map("".join)), min_size=1, max_size=6), st.integers(0, 10**6))
def test_middles(texts, first):
    ids = list(range(first, first + len(texts)))
    got = list(fill_middle.transformed(pa.array(texts, pa.string()), ids, rate=90))
    assert [(*x[:4], x.output.decode()) for x in got] == [brute_middle(d, t, 90) for d, t in zip(ids, texts, strict=True)]
    assert [x.decode() for x in fill_middle.restored([x.output for x in got], [x.form for x in got])] == [t or "" for t in texts]


def test_middle_frames(spark, docs, empty):
    made = fill_middle.transform(docs)
    want = sorted((repr((r[0], *brute_middle(r[0], r[1], 50))) for r in rows()))
    assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in made.collect()) == want
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"} and made.where("kept = 'k'").count() == len(rows())
    assert all(r["restored"] == (r["text"] or "") for r in fill_middle.restore(made).collect())
    for r in fill_middle.digests(docs).collect():
        texts = [x[1] for x in rows() if x[0] == r["doc_id"]]
        found = [(*brute_middle(r["doc_id"], t, 50), t or "") for t in texts]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) in [(*f[:4], *(hashlib.sha256(x.encode()).hexdigest() for x in f[4:])) for f in found]
    assert fill_middle.transform(empty).count() == fill_middle.restore(fill_middle.transform(empty)).count() == fill_middle.digests(empty).count() == 0


# 13


def brute_groups(found: list[tuple]) -> dict[str, tuple]:
    groups: dict = {}
    for r in found:
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    return {hashlib.sha256(k.encode()).hexdigest(): (max((d for d in v if d is not None), default=None), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize(("size", "bits"), [(4096, 128), (3, 128), (64, 2)])
def test_exact_groups(spark, docs, empty, size, bits):
    """With blocks of three bytes texts take many rounds; with digests of two bits blocks meet in one digest and are named again."""
    held = docs.where("length(text) < 400 or text is null") if size == 3 else docs
    numbered = held.withColumn("__row", F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/numbered-{size}-{bits}")
    got = exact_dedup.judged(spark.read.parquet(path), "__row", size, bits).collect()
    want = brute_groups([tuple(r) for r in held.collect()])
    assert len(got) == held.count()
    assert {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in got} == want and all(want[r["text_sha256"]] == (r["keep_id"], r["group_size"]) for r in got)
    stay = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in stay) == sorted(want) and all(r["doc_id"] == r["keep_id"] for r in stay)
    none = empty.withColumn("__row", F.monotonically_increasing_id())
    assert exact_dedup.judged(none, "__row", size, bits).count() == 0


def test_exact_dedup_keeps_rows(spark, docs, empty):
    found = exact_dedup.deduplicated(docs.withColumn("__row", F.lit("theirs")))
    kept = found.collect()
    assert found.columns == [*docs.columns, "__row"] and {r["__row"] for r in kept} == {"theirs"}
    want = brute_groups(rows())
    assert sorted(hashlib.sha256((r["text"] or "").translate(LOWER).encode()).hexdigest() for r in kept) == sorted(want)
    assert exact_dedup.deduplicated(empty).count() == 0


def test_hot_names_and_long_texts(spark):
    """A third of the rows are one text of many blocks; near copies of it differ in one byte anywhere."""
    rng = random.Random(3)
    long = "".join(rng.choice("abcdef ") for _ in range(9000))
    found = [(k, long) for k in range(60)] + [(100 + k, long[:at] + "#" + long[at + 1 :]) for k, at in enumerate(range(0, 9000, 150))] + [(300 + k, long[: 128 * k]) for k in range(60)]
    spark.createDataFrame(found, "doc_id long, text string").withColumn("__row", F.monotonically_increasing_id()).write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/hot")
    got = exact_dedup.judged(spark.read.parquet(path), "__row", 128).collect()
    assert {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in got} == brute_groups(found) and sum(r["kept"] for r in got) == len({t for _, t in found})
