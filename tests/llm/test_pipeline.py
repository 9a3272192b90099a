"""The pipeline's stages against what the tables and simple versions say."""

from __future__ import annotations

import importlib.util
from collections import Counter

import edges
import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline
from test_jaccard import brute
from test_packing import check_layout

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == columns
    judged = kept.join(labels, "doc_id", "right").select("quality", "text", "doc_id").join(labels.select("doc_id"), "doc_id").collect()
    lost = [r for r in judged if r["text"] is None and r["quality"] == 1]
    assert len(lost) <= 0.05 * sum(r["quality"] == 1 for r in judged)

    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    groups = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    assert single.columns == columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, root) in groups.items() if root == i)

    masked = corpus_pipeline.redact_secrets(spark, docs, SF)
    assert masked.columns == columns and masked.count() == docs.count()

    mixed = corpus_pipeline.mix_to_weights(spark, docs, SF)
    assert mixed.columns == columns and max(Counter(r["doc_id"] for r in mixed.select("doc_id").collect()).values()) <= 3
    check_layout(corpus_pipeline.pack_sequences(spark, docs, SF).collect(), 2048)


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    rows = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert rows == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_awkward_rows(spark):
    for docs in (edges.awkward(spark), edges.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
