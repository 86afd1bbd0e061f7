"""The pipeline's stages on small documents."""

from __future__ import annotations

import corpus_pipeline
import pytest
from weftgraph.llm import language_id
from tests.llm.test_operators import brute_components, language_rows


def test_stages(spark, tmp_path, monkeypatch):
    rows = [(k, t, lang, f"s{k % 4}", len(t)) for k, t, lang in language_rows(90)]
    rows += [(1000 + k, rows[k][1].upper() + " tail", "en", "s1", 1) for k in range(10)]
    rows += [(2000, None, "en", "s0", None), (2001, "12 34", "de", None, 5), (2002, "the " * 12 + "benchmark phrase of many words", "en", None, 5), (2003, "", None, "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", "the " * 12 + "benchmark phrase of many words")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            assert ids == {r[0] for r in rows} - {2000, 2001, 2003}
        if name == "ngram_join":
            want = brute_components([tuple(r) for r in before.collect()])
            assert ids == {d for d, (_, c) in want.items() if c == d} and len(ids) < before.count()
        if name == "decontamination":
            assert ids == {r["doc_id"] for r in before.collect()} - {2002}
        sizes.append(docs.count())
    assert {"shard", "slot"} <= set(docs.columns) and sizes[-1] == sizes[-2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]
    # a run that is lost in stage three goes on there
    folder, calls, stages = str(tmp_path / "round"), [], list(corpus_pipeline.STAGES)

    def counted(name, stage, fails=False):
        def call(spark, docs, sf_dir):
            calls.append(name)
            if fails:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return name, call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(n, s, n == "decontamination") for n, s in stages])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, str(tmp_path), folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(n, s) for n, s in stages])
    assert corpus_pipeline.run(spark, str(tmp_path), folder).count() == sizes[-1]
    assert calls == ["language_id", "ngram_join", "decontamination", "decontamination", "mixing", "sharding"]
    assert [n for n, _ in stages] == ["language_id", "ngram_join", "decontamination", "mixing", "sharding"]
    assert language_id.UNKNOWN == "und"


def test_no_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
