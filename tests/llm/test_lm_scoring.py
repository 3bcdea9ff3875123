"""Scores by deleted interpolation against a plain reimplementation."""

from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm.lm_scoring import BUCKETS, Plan, _Block, _requests, learn, lm_scores

TEXTS = ["the cat sat on the mat", "the cat sat", "The dog sat on the cat", None, "", "  a\tb\x0bc\n", "the the the the", "é ü ß the", "cat sat on", "dog sat on the mat the cat"]


def _grams(text):
    t = ["<s>", "<s>", *(text or "").encode().lower().split(), "</s>"]
    return [(tuple(t[i - 2 : i + 1]), tuple(t[i - 1 : i + 1]), t[i], tuple(t[i - 2 : i]), t[i - 1]) for i in range(2, len(t))]


def _brute(rows, lambdas):
    three, two, one, c3, c2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for _, text, held, _ in rows:
        if not held:
            for a, b, c, d, e in _grams(text):
                three[a] += 1
                two[b] += 1
                one[c] += 1
                c3[d] += 1
                c2[e] += 1
    n, v = sum(one.values()), len(one)
    at = lambda lam, c: lam[min(1 + int(math.log2(c)), BUCKETS - 1)] if c else 0.0
    out = {}
    for key, text, held, _ in rows:
        base = score = 0.0
        known = 0
        for a, b, c, d, e in _grams(text):
            base += math.log10((one[c] + 1) / (n + v + 1))
            p = lambdas[0][0] * one[c] / n + (1 - lambdas[0][0]) / (v + 1)
            w = at(lambdas[1], c2[e])
            p = w * (two[b] / c2[e] if c2[e] else 0) + (1 - w) * p
            w = at(lambdas[2], c3[d])
            p = w * (three[a] / c3[d] if c3[d] else 0) + (1 - w) * p
            score += math.log10(p)
            known += one[c] > 0
        out[key] = (held, len(_grams(text)), known, n, base, score)
    return out


@pytest.mark.parametrize("plan", [Plan(), Plan(block_bytes=40, range_tokens=3)])
def test_scores_match_plain_counting(spark, plan):
    rows = [(i, t, i % 7 == 2, i % 7 == 3) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean, d boolean").withColumn("score", F.lit("clash"))
    found, weights = lm_scores(docs, F.col("h"), F.col("d"), plan=plan)
    want = _brute(rows, weights.lambdas)
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:4] == w[:4]
        assert got[k][4:] == pytest.approx(w[4:], rel=1e-9)
    assert any(x not in (0.0, 0.5) for lam in weights.lambdas for x in lam)


def test_probabilities_sum_to_one(spark):
    """Over all continuations of one context, the unseen word included."""
    base = [(i, t, False, i % 5 == 0) for i, t in enumerate(TEXTS * 2)]
    words = {w for t in TEXTS for w in (t or "").lower().split()} - {""}
    asked = [(1000 + i, f"on {w}", True, False) for i, w in enumerate(sorted(words | {"unheardof"}))]
    docs = spark.createDataFrame([*base, *asked, (999, "on", True, False)], "doc_id long, text string, h boolean, d boolean")
    got = {r["doc_id"]: r["score"] for r in lm_scores(docs, F.col("h"), F.col("d"))[0].collect()}
    # P(on | start) once, then P(w | on) P(end | on w): only that each is a probability can be read off here.
    assert all(s < 0 for s in got.values())
    assert sum(10 ** got[i] for i in got if i >= 1000) < 1


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scores(empty, F.lit(False), F.lit(False))[0].collect() == []
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    rows = lm_scores(docs, F.lit(True), F.lit(False))[0].collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def _plain_em(events, n_tokens, n_types, rounds):
    bucket = lambda c: min(1 + int(math.log2(c)), BUCKETS - 1) if c > 0 else 0
    l1, l2, l3 = 0.5, [0.0] + [0.5] * (BUCKETS - 1), [0.0] + [0.5] * (BUCKETS - 1)
    for _ in range(rounds):
        own, rest = Counter(), Counter()
        for d3, c3, d2, c2, d1, n in events:
            b3, b2 = bucket(c3), bucket(c2)
            a3, a2 = l3[b3] * (d3 / c3 if c3 else 0), (1 - l3[b3]) * l2[b2] * (d2 / c2 if c2 else 0)
            left = (1 - l3[b3]) * (1 - l2[b2])
            a1, a0 = left * l1 * d1 / n_tokens, left * (1 - l1) / (n_types + 1)
            p = a3 + a2 + a1 + a0
            for key, x, y in (((3, b3), a3, a2 + a1 + a0), ((2, b2), a2, a1 + a0), ((1, 0), a1, a0)):
                own[key] += n * x / p
                rest[key] += n * y / p
        new = lambda key, old: min(own[key] / (own[key] + rest[key]), 0.9999) if own[key] + rest[key] > 0 and old > 0 else old
        l1, l2, l3 = new((1, 0), l1), [new((2, b), x) for b, x in enumerate(l2)], [new((3, b), x) for b, x in enumerate(l3)]
    return (l1,), tuple(l2), tuple(l3)


def test_weights_are_those_of_plain_expectation_maximisation(spark):
    rng = random.Random(6)
    events = []
    for _ in range(300):
        c3, c2 = rng.choice([0, 1, 3, 9, 70]), rng.choice([0, 2, 5, 40, 900])
        events.append((rng.randint(0, c3), c3, rng.randint(0, c2), c2, rng.randint(1, 50), rng.randint(1, 4)))
    frame = spark.createDataFrame(events, "deleted3 long, context3 long, deleted2 long, context2 long, deleted1 long, n long")
    got = learn(frame, 5000, 300, rounds=5, tolerance=0.0)
    for x, y in zip(got, _plain_em(events, 5000, 300, 5), strict=True):
        assert x == pytest.approx(y, rel=1e-9)


def test_requests_grow_with_n_grams_not_with_blocks_times_ranges(spark):
    rows = [(f"w{i % 50} x{i % 70} y{i % 90} " * 4, True, False) for i in range(60)]
    docs = pa.Table.from_pylist([{"text": t, "trained": a, "deleted": b} for t, a, b in rows])
    few, many = (_requests(n)((pa.scalar(0),), docs).num_rows for n in (100, 100_000))
    grams = sum(len(d) for d in _Block([r[0] for r in rows]).distinct)
    assert few <= 300 and many <= grams
    assert Plan().at(1 << 30) == (4 << 20, 1_000_000) and Plan().at(1 << 50) == (32 << 20, 8_000_000)
