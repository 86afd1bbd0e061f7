"""Language ID by a linear-chain conditional random field over words.

Each word has a score for each language: the sum of learned weights of its prefixes and suffixes (1 to 4 bytes), of its
byte 2- and 3-grams with the word's ends, and of the learned lexicon's entry for it.  Learned transitions tie the
languages of neighbouring words, so that a text that switches languages is labelled in stretches.  Forward-backward
gives each word's probability of each language; a document gets the language with the largest sum.

The model is fitted on the driver on SAMPLE documents of SAMPLE_CHARS characters together at most, spread evenly over
the languages (one document of each language is taken in any case).  Training sequences are stretches of 6 to 40 words of
different documents put in a row, so that switches occur in them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import jobs, textkit
from weftgraph.llm.textkit import U

#: Labelled documents, and their characters together, to fit on at most; hashed weights, entries of the lexicon, words
#: of a training sequence, passes.
SAMPLE, SAMPLE_CHARS, BUCKETS, LEXICON, LENGTH, PASSES = 1200, 3_000_000, 1 << 16, 20_000, 48, 3
#: Steps of a block in forward-backward, and bytes handled at once.
BLOCK, CHUNK = 64, 1 << 18
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    lexicon: np.ndarray  # sorted word hashes
    entry: np.ndarray  # label of each word of the lexicon
    entries: np.ndarray  # labels + 1 x labels: score of an entry's label, last of no entry
    transition: np.ndarray  # labels x labels, log
    start: np.ndarray  # labels, log


def parsed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, text of each word) of lower-cased texts, all but letters as spaces."""
    encoded = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(encoded) + b"    ", np.uint8)
    data = np.where(LETTER[data], data, np.uint8(0x20))
    edge = np.diff(LETTER[data].astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    begins = np.cumsum([1, *(len(e) + 1 for e in encoded)])[:-1] if encoded else np.zeros(0, np.int64)
    return data, start, end, np.searchsorted(begins, start, side="right") - 1


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(affix buckets by word, n-gram buckets by byte for n = 2 and 3, word hashes)."""
    up, down = textkit._powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(textkit._BYTE[data] * up[:-1], out=sums[1:])

    def bucket(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return (textkit.mix((sums[b] - sums[a]) * down[a] + textkit._STEP[salt]) & U(BUCKETS - 1)).astype(np.int64)

    affixes = [bucket(start - 1, np.minimum(start + k, end + 1), k) for k in range(1, 5)]
    affixes += [bucket(np.maximum(end - k, start - 1), end + 1, 8 + k) for k in range(1, 5)]
    grams = []
    for n in (2, 3):
        at = np.arange(len(data) - n + 1)
        grams.append(bucket(at, at + n, 16 + n))
    return affixes, grams, textkit.mix((sums[end] - sums[start]) * down[start])


def looked_up(model: Model, hashed: np.ndarray) -> np.ndarray:
    if not len(model.lexicon):
        return np.full(len(hashed), len(model.labels))
    at = np.searchsorted(model.lexicon, hashed)
    at[at == len(model.lexicon)] = 0
    return np.where(model.lexicon[at] == hashed, model.entry[at], len(model.labels))


def emissions(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Score of each word for each label."""
    affixes, grams, hashed = features(data, start, end)
    score = model.entries[looked_up(model, hashed)].copy()
    for bucket in affixes:
        score += model.weights[bucket]
    for n, bucket in zip((2, 3), grams, strict=True):
        running = np.zeros((len(bucket) + 1, len(model.labels)))
        np.cumsum(model.weights[bucket], axis=0, out=running[1:])
        score += running[end + 2 - n] - running[start - 1]
    return score


def marginals(model: Model, score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of each label for each word, by forward-backward; first marks the first words of texts.

    The words are cut into blocks that all advance together: the products of the steps of each block give the messages
    at the blocks' ends, from which each block fills in its own words.  A text's first word forgets what came before.
    """
    n, k = score.shape
    blocks = -(-n // BLOCK)
    chance = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30.0))
    chance = np.concatenate([chance, np.ones((blocks * BLOCK - n, k))]).reshape(blocks, BLOCK, k)
    reset = np.concatenate([first, np.ones(blocks * BLOCK - n, bool)]).reshape(blocks, BLOCK)
    move = np.exp(model.transition - model.transition.max())
    prior = np.exp(model.start - model.start.max())

    def step(message: np.ndarray, s: int) -> np.ndarray:
        """Rows of messages (blocks, m, labels) after step s."""
        moved = message @ move
        cut = reset[:, s]
        if cut.any():
            moved[cut] = message[cut].sum(axis=2, keepdims=True) * prior
        moved *= chance[:, s, None, :]
        return moved / moved.max(axis=(1, 2), keepdims=True)

    whole = np.broadcast_to(np.eye(k), (blocks, k, k))
    for s in range(BLOCK):
        whole = step(whole, s)
    into = np.empty((blocks, k))
    message = np.ones(k)
    for b in range(blocks):
        into[b] = message
        message = message @ whole[b]
        message /= message.max()
    back = np.empty((blocks, k))
    message = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        back[b] = message
        message = whole[b] @ message
        message /= message.max()
    forward = np.empty_like(chance)
    message = into[:, None, :]
    for s in range(BLOCK):
        message = step(message, s)
        forward[:, s] = message[:, 0]
    for s in range(BLOCK - 1, -1, -1):
        forward[:, s] *= back
        ahead = chance[:, s] * back
        back = ahead @ move.T
        cut = reset[:, s]
        back[cut] = (ahead[cut] @ prior)[:, None]
        back /= back.max(axis=1, keepdims=True)
    out = forward.reshape(-1, k)[:n]
    return out / out.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """The model of (text, label) rows, by stochastic ascent of the conditional likelihood with adaptive steps."""
    labels = sorted({label for _, label in rows})
    k = len(labels)
    rng = np.random.default_rng(seed)
    data, start, end, text = parsed([t for t, _ in rows])
    truth = np.array([labels.index(label) for _, label in rows], np.int64)[text] if len(rows) else np.zeros(0, np.int64)
    model = Model(labels, np.zeros((BUCKETS, k)), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((k + 1, k)), np.zeros((k, k)), np.zeros(k))
    if not k or not len(start):
        return model
    affixes, grams, hashed = features(data, start, end)
    # the lexicon: words that one label has nine tenths of, the most frequent first
    words, inverse = np.unique(hashed, return_inverse=True)
    counts = np.stack([np.bincount(inverse[truth == c], minlength=len(words)) for c in range(k)], axis=1)
    total = counts.sum(axis=1)
    sure = np.flatnonzero((total >= 3) & (10 * counts.max(axis=1) >= 9 * total))
    sure = np.sort(sure[np.argsort(-total[sure], kind="stable")[:LEXICON]])
    model.lexicon, model.entry = words[sure], counts[sure].argmax(axis=1)
    entry = looked_up(model, hashed)
    squares = {name: np.full(getattr(model, name).shape, 1e-2) for name in ("weights", "entries", "transition", "start")}
    for _ in range(PASSES):
        # stretches of documents in random order
        cuts = np.cumsum(rng.integers(6, 41, size=len(start) // 6 + 1))
        cuts = np.unique(np.concatenate([[0], cuts[cuts < len(start)], np.flatnonzero(np.diff(text)) + 1]))
        pieces = np.split(np.arange(len(start)), cuts[1:])
        order = np.concatenate([pieces[p] for p in rng.permutation(len(pieces))])
        usable = len(order) // LENGTH * LENGTH
        sequences = order[:usable].reshape(-1, LENGTH) if usable else order[None, :]
        for batch in np.array_split(sequences, max(1, len(sequences) // 400)):
            flat = batch.ravel()
            word = np.arange(len(flat))
            score = model.entries[entry[flat]].copy()
            parts = [(a[flat], word) for a in affixes]
            for n, bucket in zip((2, 3), grams, strict=True):
                size = end[flat] + 3 - n - start[flat]
                owner = np.repeat(word, np.maximum(size, 0))
                at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
                parts.append((bucket[start[flat][owner] - 1 + at], owner))
            for bucket, owner in parts:
                got = model.weights[bucket]
                for c in range(k):
                    score[:, c] += np.bincount(owner, got[:, c], minlength=len(flat))
            posterior, pairs = _expected(model, score.reshape(*batch.shape, k))
            gold = np.eye(k)[truth[batch]]
            wrong = (gold - posterior).reshape(-1, k)
            slope = {"entries": np.zeros((k + 1, k)), "weights": np.zeros((BUCKETS, k))}
            for bucket, owner in parts:
                for c in range(k):
                    slope["weights"][:, c] += np.bincount(bucket, wrong[owner, c], minlength=BUCKETS)
            np.add.at(slope["entries"], entry[flat], wrong)
            slope["transition"] = np.einsum("sta,stb->ab", gold[:, :-1], gold[:, 1:]) - pairs
            slope["start"] = (gold[:, 0] - posterior[:, 0]).sum(axis=0)
            for name, value in slope.items():
                value /= len(batch)
                squares[name] += value**2
                getattr(model, name)[...] += 0.1 * value / np.sqrt(squares[name])
    return model


def _expected(model: Model, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each label in each place, and expected transitions, of sequences of one length."""
    m, length, k = score.shape
    chance = np.exp(score - score.max(axis=2, keepdims=True))
    move, prior = np.exp(model.transition), np.exp(model.start)
    forward, backward = np.empty_like(chance), np.empty_like(chance)
    message = chance[:, 0] * prior
    for t in range(length):
        if t:
            message = (message @ move) * chance[:, t]
        message /= message.sum(axis=1, keepdims=True)
        forward[:, t] = message
    message = np.ones((m, k))
    for t in range(length - 1, -1, -1):
        backward[:, t] = message
        message = (message * chance[:, t]) @ move.T
        message /= message.sum(axis=1, keepdims=True)
    posterior = forward * backward
    posterior /= posterior.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(1, length):
        joint = forward[:, t - 1, :, None] * move * (chance[:, t] * backward[:, t])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return posterior, pairs


def label(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, share of the words' probability it has) of each text; `und` and 0 for a text without letters."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    able = [k for k, t in enumerate(texts) if t and model.labels and (t.isascii() or any(c.isalpha() for c in t))]
    while able:
        size, take = 0, 0
        while take < len(able) and (not take or size + len(texts[able[take]]) <= CHUNK):
            size += len(texts[able[take]])
            take += 1
        now, able = able[:take], able[take:]
        data, start, end, text = parsed([texts[k] for k in now])
        if not len(start):
            continue
        found = marginals(model, emissions(model, data, start, end), np.append(True, np.diff(text) > 0))
        cut = np.flatnonzero(np.append(True, np.diff(text) > 0))
        sums = np.add.reduceat(found, cut, axis=0)
        for k, row in zip(text[cut], sums, strict=True):
            best = int(row.argmax())
            out[now[k]] = (model.labels[best], float(min(1.0, row[best] / row.sum())))
    return out


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def trained(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of docs (doc_id, text, lang), held-out rows left aside: `sample` documents at most, by hash of doc_id and text.

    Languages share the sample, and SAMPLE_CHARS characters, evenly; where a language has more characters, its longest
    documents go until it fits, but one stays.  With more than `sample` languages, those of the least names are learned.
    The same rows give the same model, however they are dealt.  Rows with a null doc_id count as those of an empty one.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    hashed = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")))
    known = known.select("text", "lang", F.char_length("text").alias("chars"), hashed.alias("hash"))
    # a row for each of the first languages
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(sample).collect()}
    if not counts:
        return fit([])
    need = sample // len(counts)
    room = SAMPLE_CHARS // len(counts)

    def least(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang").orderBy("hash")
        return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= need)

    # hashes above a share that leaves several times the needed rows are not among the least; so a language's task gets few rows
    shares = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, (8 * need + 1000) / n)))))
    sized = known.select("lang", "chars", "hash").where(F.col("lang").isin(*counts))
    picked = least(sized.where(F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") < shares[F.col("lang")] * 2.0**32)).select("lang", "chars", "hash").collect()
    had = Counter(r["lang"] for r in picked)
    if any(had[lang] < min(need, n) for lang, n in counts.items()):
        picked = least(sized).select("lang", "chars", "hash").collect()  # many equal rows
    picked.sort(key=lambda r: (r["lang"], r["chars"], r["hash"]))
    chosen: Counter[tuple[str, str]] = Counter()
    for _, rows in groupby(picked, key=lambda r: r["lang"]):
        left = room
        for k, r in enumerate(rows):
            left -= r["chars"]
            if k and left < 0:
                break
            chosen[r["lang"], r["hash"]] += 1
    ids = docs.sparkSession.createDataFrame(list(chosen), "picked_lang string, picked_hash string")
    texts = known.join(F.broadcast(ids), (F.col("lang") == F.col("picked_lang")) & (F.col("hash") == F.col("picked_hash"))).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    rows = [(r["text"], r["lang"]) for r in texts.collect() for _ in range(chosen[r["lang"], r["hash"]])]
    return fit(sorted(rows, key=lambda r: (r[1], r[0])))


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the columns lang_pred and score, which replace columns of these names.

    The text alone decides.  A null text, or one without a letter, is `und` with score 0.  Texts are read whole.
    """
    jobs.small_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema)


def words(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, word_no, word, lang, score): each word of code-switched texts, lower-cased, with its own language.

    A word is a run of letters; score is its probability under the whole text.  Texts without letters have no rows.
    """
    jobs.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text")):
                data, start, end, _ = parsed([text.as_py() or ""])
                if not len(start) or not shared.value.labels:
                    continue
                found = marginals(shared.value, emissions(shared.value, data, start, end), np.arange(len(start)) == 0)
                best = found.argmax(axis=1)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(np.full(len(start), k))),
                        pa.array(np.arange(len(start)), pa.int64()),
                        pa.array([raw[a:b].decode() for a, b in zip(start, end, strict=True)], pa.string()),
                        pa.array([shared.value.labels[c] for c in best], pa.string()),
                        pa.array(found[np.arange(len(start)), best], pa.float64()),
                    ],
                    names=["doc_id", "word_no", "word", "lang", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, word_no long, word string, lang string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    docs = jobs.table(spark, sf_dir, "documents")
    return predictions(docs.select("doc_id", "text"), trained(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
