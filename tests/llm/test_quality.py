from __future__ import annotations

import zlib

import edges
import numpy as np
import pytest

from eventloom.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    assert np.mean(np.array(good) >= 0.7) > 0.95


def test_gradients():
    rng = np.random.default_rng(2)
    bags = [rng.random((n, quality.WIDTH)).astype(np.float32) for n in (1, 3, 2)]
    weights = {"w": rng.standard_normal((quality.WIDTH, 4)) / 9, "b": rng.standard_normal(4), "v": rng.standard_normal((4, 3)), "u": rng.standard_normal((4, 3)), "a": rng.standard_normal(3), "c": rng.standard_normal(4), "d": rng.standard_normal(1)}
    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), weights)
    x, starts, y, weight = np.concatenate(bags).astype(float), np.array([0, 1, 4, 6]), np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        p = model.forward(x, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = quality.gradients(model, model.forward(x, starts), starts[:-1], y, weight)
    for k, g in found.items():
        at = tuple(rng.integers(0, s) for s in weights[k].shape)
        kept = weights[k][at]
        weights[k][at] = kept + 1e-5
        up = loss()
        weights[k][at] = kept - 1e-5
        down = loss()
        weights[k][at] = kept
        assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-6), k


def test_a_texts_features_do_not_depend_on_the_batch():
    texts = ["one two three", "", "x" * 5_000, "naïve 東京 " * 100]
    together, starts = quality.encoded(texts)
    for i, t in enumerate(texts):
        alone, _ = quality.encoded([t])
        assert np.array_equal(alone, together[starts[i] : starts[i + 1]])


def test_awkward_rows(spark):
    docs = edges.awkward(spark)
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 0), (99, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[0] == by[1] and by[2] == by[3]
    assert quality.accepted(docs, labels).columns == docs.columns
    # Without labels every document scores the same; empty tables stay empty.
    assert quality.quality_scores(docs, labels.where("false")).select("score").distinct().count() == 1
    assert quality.quality_scores(edges.empty(spark), labels).count() == 0
