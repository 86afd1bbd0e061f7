"""Many words in many texts: one pass of an Aho-Corasick automaton over each text, whatever the number of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import stored

#: Characters of words in one automaton; more words are looked for in further passes, one after the other.
PASS = 4_000_000

_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, words: list[str]) -> ahocorasick.Automaton:
    """Built once in each Python worker; the last few are kept."""
    if name not in _AUTOMATA:
        if len(_AUTOMATA) >= 4:
            _AUTOMATA.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(words):
            made.add_word(word, k)
        made.make_automaton()
        _AUTOMATA[name] = made
    return _AUTOMATA[name]


def hits(texts: DataFrame, key: str, text: Column, words: DataFrame, word: str = "word", most: int = PASS) -> DataFrame:
    """(key, word) of each word that a text holds, once for each row of texts and word.

    words has a column `word`; null and empty words and null texts hold nothing.  Letters count as they are.  The words of
    a pass travel to every task: `most` characters of them at a time.  With more than one pass the texts are read again
    for each, and the hits of a pass are written before the next begins, so memory does not grow with the words.
    """
    spark = texts.sparkSession
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), text.alias("text")).where("text is not null")
    distinct = words.select(F.col(word).alias("word")).where("word <> ''").distinct()
    total = distinct.agg(F.sum(F.char_length("word"))).first()[0] or 0
    passes = -(-total // most)
    if passes > 1:
        distinct = stored(distinct.withColumn("pass", F.pmod(F.xxhash64("word"), F.lit(passes))), "words")
    parts = []
    for k in range(passes):
        chosen = distinct.where(F.col("pass") == k) if passes > 1 else distinct
        listed = sorted(r["word"] for r in chosen.select("word").collect())  # about `most` characters
        if not listed:
            continue
        shared, name = spark.sparkContext.broadcast(listed), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            names = shared.value
            for batch in batches:
                automaton = _automaton(name, names)
                places, found = [], []
                for row, body in enumerate(batch.column("text").to_pylist()):
                    mine = {w for _, w in automaton.iter(body)}
                    places += [row] * len(mine)
                    found += [names[w] for w in sorted(mine)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(places, pa.int64())), pa.array(found, pa.string())], names=["key", "word"])

        made = rows.mapInArrow(run, f"key {kind}, word string")
        if passes > 1:
            made = stored(made, "hits")
            shared.destroy()
        parts.append(made)
    if not parts:
        return rows.limit(0).select(F.col("key").alias(key), F.col("text").alias(word))
    return reduce(DataFrame.unionByName, parts).select(F.col("key").alias(key), F.col("word").alias(word))


def marker_counts(texts: DataFrame, key: str, text: Column, markers: DataFrame) -> DataFrame:
    """(key, n): the distinct markers (column word) that each text holds; texts without one are left out."""
    return hits(texts, key, text, markers).groupBy(key).agg(F.countDistinct("word").alias("n"))


def first_classes(texts: DataFrame, key: str, text: Column, classes: DataFrame) -> DataFrame:
    """(key, class): of the classes one of whose words a text holds the one of lowest `ord`, ties by name; texts without one are left out.

    classes: (word, class, ord); a blocked word is one of a class of low order that the caller takes for none.
    """
    found = hits(texts, key, text, classes).join(classes.where("word <> ''").select("word", F.struct("ord", "class").alias("c")), "word")
    return found.groupBy(key).agg(F.min("c").alias("c")).select(key, F.col("c.class").alias("class"))


def first_hits(texts: DataFrame, key: str, text: Column, words: DataFrame, group: str, most: int) -> DataFrame:
    """(group, key): for each group of words (word, group) the first `most` texts by key that hold one of its words."""
    found = hits(texts, key, text, words).join(words.where("word <> ''").select("word", group), "word").select(group, key).distinct()
    return found.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_nth") <= most).select(group, key)
