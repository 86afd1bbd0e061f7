"""A training corpus from `documents`: five stages, each by an operator of weftgraph.llm, each written and read again.

Every stage takes (spark, docs, sf_dir) and judges all rows that the stage before it kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontamination, jobs, language_id, mixing, ngram_join, sharding
from weftgraph.storage import Round


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows to which the model, fitted on the labelled rows of docs, gives a language; null and letterless texts go.

    Without labelled rows there is no model, and rows with a letter stay.
    """
    model = language_id.trained(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predictions(docs.withColumnsRenamed({c: f"__{c}" for c in ("lang_pred", "score")}), model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.drop("lang_pred", "score").withColumnsRenamed({f"__{c}": c for c in ("lang_pred", "score")}).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row of the smallest doc_id, null last; one row where rows are equal."""
    return ngram_join.without_near_copies(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that `benchmark` does not contaminate."""
    return decontamination.decontaminated(docs, jobs.table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and slot."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", in_a_language),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmarks),
    ("mixing", mixed_sources),
    ("sharding", in_shards),
]

#: A conditional random field has no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages over all of `documents`; with a folder that an earlier run was given, they go on after its last whole stage."""
    stages = [(name, lambda docs, stage=stage: stage(spark, docs, sf_dir)) for name, stage in STAGES[:-1]]
    docs = Round(spark, folder or f"{jobs.shared_folder(spark)}/weft-corpus-{uuid.uuid4().hex}", sf_dir).run(lambda: jobs.table(spark, sf_dir, "documents"), stages)
    return STAGES[-1][1](spark, docs, sf_dir)
