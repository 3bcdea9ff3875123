"""The byte network against plain code, its gradient, and held-out labels."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import byte_cnn as C

rng = random.Random(11)
SMALL = C.Shape(width=3, embedding=2, filters=4, hidden=3, half=5)


def plain_score(net, data):
    """By loops over windows, chunks and filters."""
    s, p = net.shape, net.part
    x = [C._PAD] * (s.width - 1) + list(data) + [C._PAD] * (s.width - 1)
    windows = [np.concatenate([p["embedding"][c] for c in x[i : i + s.width]]) for i in range(len(x) - s.width + 1)]
    halves = [windows[i : i + s.half] for i in range(0, len(windows), s.half)]
    chunks = [a + b for a, b in zip(halves, halves[1:], strict=False)] if len(halves) > 1 else halves
    seen = [[max(0.0, max(float(w @ p["filters"][:, f]) + p["filter_bias"][f] for w in c)) for f in range(s.filters)] + [len(c) / (2 * s.half)] for c in chunks]
    hidden = [[max(0.0, float(np.dot(row, p["hidden"][:, u])) + p["hidden_bias"][u]) for u in range(s.hidden)] for row in seen]
    pooled = [max(h[u] for h in hidden) for u in range(s.hidden)] + [max(r[f] for r in seen) for f in range(s.filters)]
    return 1 / (1 + np.exp(-(np.dot(pooled, p["out"]) + p["out_bias"][0])))


def _net(shape=SMALL):
    net = C.Network.new(shape, 3)
    net.vector[:] = np.random.default_rng(5).normal(0, 0.6, net.vector.shape)
    return net


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 11, 57, 400])
def test_scores_equal_plain_loops(n):
    data = bytes(rng.randrange(256) for _ in range(n))
    assert abs(_net().score(data) - plain_score(_net(), data)) < 1e-5


def test_blocks_make_no_difference(monkeypatch):
    data = bytes(rng.randrange(256) for _ in range(5000))
    whole = _net().score(data)
    monkeypatch.setattr(C, "_BLOCK", SMALL.half * 7)
    assert abs(_net().score(data) - whole) < 1e-6


@pytest.mark.parametrize("label", [0, 1])
@pytest.mark.parametrize("n", [0, 6, 90])
def test_gradient(n, label):
    net = C.Network(SMALL, _net().vector.astype(np.float64))
    data = bytes(rng.randrange(20) for _ in range(n))
    got = np.zeros_like(net.vector)
    net.gradient(data, label, got)

    def loss(vector):
        s = C.Network(SMALL, vector).score(data)
        return -np.log(s if label else 1 - s)

    for i in np.flatnonzero(np.abs(got) > 1e-4)[:: 1 + n // 30]:
        e = np.zeros_like(net.vector)
        e[i] = 1e-5
        assert abs((loss(net.vector + e) - loss(net.vector - e)) / 2e-5 - got[i]) < 1e-3 * max(1, abs(got[i]))


def test_rows_of_any_kind(spark):
    texts = [None, "", "a", "wörter " * 40, "x" * 300_000, "same", "same"]
    docs = spark.createDataFrame([(None if i == 2 else i, t, 1, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, quality int, _text double")
    rows = C.scored(docs, C.Network.new(), into="p").collect()
    assert len(rows) == len(texts) and all(0 <= r["p"] <= 1 for r in rows)
    assert rows[0]["p"] == rows[1]["p"] and rows[5]["p"] == rows[6]["p"]
    assert C.scored(docs.limit(0), C.Network.new(), into="p").collect() == []
    with pytest.raises(ValueError):
        C.scored(docs, C.Network.new(), into="QUALITY")


def test_training_takes_any_table(spark):
    docs = spark.createDataFrame([(i % 50 if i else None, f"text {i % 50}" if i % 7 else None, 1) for i in range(90)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i % 45 if i else None, i % 2 if i % 5 else None, 0) for i in range(99)], "doc_id long, quality int, toxic int")
    once, again = (C.train(docs.repartition(n), labels.repartition(n), rounds=2, slots=3) for n in (1, 5))
    assert np.allclose(once.vector, again.vector, atol=1e-5) and not np.allclose(once.vector, C.Network.new(seed=11).vector)
    for none in (C.train(docs, labels.limit(0)), C.train(docs.limit(0), labels), C.train(docs, labels.where("quality is null"))):
        assert np.array_equal(none.vector, C.Network.new(seed=11).vector)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the tables")
def test_held_out_labels(spark, tmp_path):
    d = "/root/testdata/sf0.1"
    found = C.op11_quality_classifier(spark, d)
    found.write.parquet(f"{tmp_path}/found")
    rows = spark.read.parquet(f"{tmp_path}/found")
    assert rows.count() == spark.read.parquet(f"{d}/documents.parquet").count() and rows.where("score is null or score < 0 or score > 1").count() == 0
    labelled = rows.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["p"] for r in labelled.groupBy("quality").agg(F.avg("predicted").alias("p")).collect()}
    assert share[1] >= 0.98 and share[0] <= 0.15
