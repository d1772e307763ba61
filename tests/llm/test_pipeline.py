"""The pipeline's stages one by one, and the registered queries."""

from __future__ import annotations

import corpus_pipeline
from weftwork.llm import queries


def test_stages_keep_what_they_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "encode":
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2


def test_run_and_empty_table(spark, sf, tmp_path):
    assert set(corpus_pipeline.run(spark, sf).columns) == {"doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"}
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
