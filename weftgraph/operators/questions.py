"""Routing questions to competency queries by scores, and probing the graph along the route.

Questions are (qid, question), competency items (id, bucket, match_terms array, entity_types array, relations array).
Items and names may be as many as questions: one automaton over intent words, relation names and entity names finds what a
question holds, and an inverted index of the terms of intent words finds those that share half of their terms with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import normalised, terms
from weftgraph.operators.graph import Step, walk
from weftgraph.operators.matching import hits
from weftgraph.operators.predicates import instance_signals
from weftgraph.operators.windows import first_values
from weftgraph.storage import stored

# Weights of intent words and of named entities, and the least score of a match.
INTENT, ENTITY, LEAST = 10.0, 3.0, 6.0


def entity_names(entities: DataFrame) -> DataFrame:
    """(type, name, id): normalised names and aliases of two characters or more."""
    every = F.concat(F.array("name_zh", "name_en"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.select("type", "id", F.explode(every).alias("raw")).where("raw is not null")
    return rows.select("type", normalised(F.col("raw")).alias("name"), "id").where(F.char_length("name") >= 2).distinct()


def _half_shared(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(qid, word_id) of the intent words of three terms or more at least half of whose terms a question (qid, terms) has.

    A question that has half of a word's k terms has one of any k - ceil(k / 2) + 1 of them, so only that many, the ones
    that fewest questions have, are put into the index.
    """
    long = words.where(F.size("terms") >= 3).select("word_id", "terms")
    if long.isEmpty():
        return long.select(F.lit(None).cast(asked.schema["qid"].dataType).alias("qid"), "word_id").limit(0)
    often = asked.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    ranked = long.select("word_id", F.size("terms").alias("k"), F.explode("terms").alias("term")).join(often, "term", "left")
    by_rarity = ranked.groupBy("word_id", "k").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("by"))
    postings = by_rarity.select("word_id", F.explode(F.expr("slice(by, 1, k - cast(ceil(k / 2) as int) + 1)")).alias("p")).where("p.n > 0").select("word_id", F.col("p.term").alias("term"))
    pairs = asked.select("qid", F.explode("terms").alias("term")).join(postings, "term").select("qid", "word_id").distinct()
    whole = pairs.join(long, "word_id").join(asked.select("qid", F.col("terms").alias("_asked")), "qid")
    return whole.where(2 * F.size(F.array_intersect("terms", "_asked")) >= F.size("terms")).select("qid", "word_id")


def scored(questions: DataFrame, items: DataFrame, names: DataFrame, every: bool = True) -> DataFrame:
    """(qid, id, bucket, score, intent array, anchors array) of the pairs with a score above 0; ids of items are distinct.

    An intent word in the question counts INTENT; one that is not, but shares at least half of its three or more terms
    with the question, half of that.  Each entity of a needed type named in the question counts ENTITY, a relation
    name in it INTENT.  Empty words are in no question.

    An item without a word in the question scores by its types alone, so without `every` only one of those that need the
    same types is scored: the one that best() prefers.  The best item of each question is among the pairs all the same.
    """
    none = F.array().cast("array<string>")
    asked = stored(questions.select("qid", normalised(F.col("question")).alias("q"), F.array_distinct(terms(F.col("question"))).alias("terms")), "asked")
    listed = stored(items.select("id", "bucket", F.array_sort(F.array_distinct(F.coalesce("entity_types", none))).alias("types"), F.coalesce("relations", none).alias("relations"), F.coalesce("match_terms", none).alias("words")), "items")
    exploded = listed.select("id", F.posexplode("words").alias("ord", "raw")).select("id", "ord", "raw", normalised(F.col("raw")).alias("word"), terms(F.col("raw")).alias("terms"))
    words = stored(exploded.where("word <> ''").withColumn("word_id", F.struct("id", "ord")), "words")
    relations = listed.select("id", F.posexplode("relations").alias("ord", "raw")).where("raw <> ''")
    patterns = words.select("word").union(relations.select("raw")).union(names.select("name"))
    held = stored(hits(asked, "qid", F.col("q"), patterns).distinct(), "hits")

    whole = held.join(words, "word").select("qid", "id", "word_id", F.lit(0).alias("kind"), "ord", "raw", F.lit(INTENT).alias("s"))
    halves = _half_shared(asked, words).join(whole.select("qid", "word_id"), ["qid", "word_id"], "left_anti")
    part = halves.select("qid", F.col("word_id.id").alias("id"), F.lit(2).alias("kind"), F.col("word_id.ord").alias("ord"), F.lit(None).cast("string").alias("raw"), F.lit(0.5 * INTENT).alias("s"))
    named = held.join(relations.withColumnRenamed("raw", "word"), "word").select("qid", "id", F.lit(1).alias("kind"), "ord", F.col("word").alias("raw"), F.lit(INTENT).alias("s"))
    each = whole.drop("word_id").unionByName(named).unionByName(part)
    intents = each.groupBy("qid", "id").agg(F.sum("s").alias("_s"), F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("kind", "ord", "raw")))).alias("_intent"))
    intents = stored(intents.select("qid", "id", "_s", F.col("_intent.raw").alias("intent")), "intents")

    entities = held.join(names.select(F.col("name").alias("word"), "type", F.col("id").alias("entity")), "word").select("qid", "type", "entity").distinct()
    preferred = listed if every else listed.withColumn("_nth", F.row_number().over(Window.partitionBy("types").orderBy(F.col("bucket") != "out_of_scope", "id"))).where("_nth = 1")
    by_type = entities.join(preferred.select("id", F.explode("types").alias("type")), "type").select("qid", "id", "entity")
    if not every:
        # items that have a word in the question, with their entities too
        own = intents.select("qid", "id").join(listed.select("id", F.explode("types").alias("type")), "id").join(entities, ["qid", "type"]).select("qid", "id", "entity")
        by_type = by_type.unionByName(own)
    anchors = by_type.groupBy("qid", "id").agg(F.array_sort(F.collect_set("entity")).alias("anchors"))
    out = intents.join(anchors, ["qid", "id"], "full").join(listed.select("id", "bucket"), "id")
    out = out.withColumns({"anchors": F.coalesce("anchors", none), "intent": F.coalesce("intent", none)}).withColumn("score", F.coalesce("_s", F.lit(0.0)) + ENTITY * F.size("anchors"))
    return out.select("qid", "id", "bucket", "score", "intent", "anchors")


def best(scores: DataFrame) -> DataFrame:
    """The highest score of each question; on ties items out of scope go first, then the smaller id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("bucket") != "out_of_scope", "id")
    return scores.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def verdicts(questions: DataFrame, items: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, verdict, item, score, signals): instance_level, answerable, out_of_scope or unlisted."""
    top = best(scored(questions, items, names, every=False)).where(F.col("score") >= LEAST).select("qid", F.col("id").alias("item"), "bucket", "score")
    rows = questions.select("qid", instance_signals(F.col("question")).alias("signals")).join(top, "qid", "left")
    verdict = F.when(F.size("signals") > 0, "instance_level").when(F.col("item").isNull(), "unlisted").when(F.col("bucket") == "out_of_scope", "out_of_scope").otherwise("answerable")
    return rows.select("qid", verdict.alias("verdict"), "item", "score", "signals")


def probe_edges(edges: DataFrame, starts: DataFrame, steps: Sequence[Step], types: DataFrame, samples: int = 5) -> DataFrame:
    """(start, n, sample) of what the steps reach from each start (id); starts that reach nothing have 0."""
    nodes = walk(edges, starts, steps, types)
    reached = nodes.groupBy("start").agg(F.count("*").alias("n")).join(first_values(nodes, ["start"], "node", samples, "sample"), "start", "left")
    return starts.select(F.col("id").alias("start")).distinct().join(reached, "start", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "sample": F.coalesce("sample", F.array().cast("array<string>"))})


def probe_field(rows: DataFrame, value: Column, samples: int = 3) -> DataFrame:
    """One row: total, non_empty and a sample of ids whose array `value` holds something."""
    found = rows.select("id", F.filter(value, lambda v: v.isNotNull() & (v.cast("string") != "")).alias("v"))
    sample = found.where(F.size("v") > 0).select("id").distinct().orderBy("id").limit(samples).agg(F.array_sort(F.collect_list("id")).alias("sample"))
    return found.agg(F.count("*").alias("total"), F.count(F.when(F.size("v") > 0, 1)).alias("non_empty")).join(F.broadcast(sample), F.lit(True))


def regression(expected: DataFrame, verdict: DataFrame) -> DataFrame:
    """(file, total, failed) of (file, qid, expect answerable|refuse)."""
    joined = expected.join(verdict.select("qid", "verdict"), "qid", "left")
    failed = (F.col("expect") == "answerable") != (F.col("verdict") == "answerable")
    return joined.groupBy("file").agg(F.count("*").alias("total"), F.count(F.when(F.coalesce(failed, F.lit(True)), 1)).alias("failed"))
