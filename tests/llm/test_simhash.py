"""SimHash groups against all pairs."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gleaner.llm.components import connected_components
from gleaner.llm.simhash import anchors, fingerprint, near_duplicates, one_of_each

SCHEMA = "doc_id long, text string, fp string, component string"


def _plain(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(rows, t=2):
    prints = {k: _plain(x) for k, x in rows}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= t:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (prints[k], find(k)) for k in prints}


def _docs(n=150):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(50)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            if len(w) > 40 and rng.random() < 0.8:
                w[rng.randrange(len(w))] = "edit"
            rows.append((k, " ".join(w)))
        else:
            rows.append((k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 300, 2000])))))
    return rows


def test_equals_all_pairs(spark):
    rows = [*_docs(), (900, ""), (901, None), (902, " \n\t"), (903, "É È A"), (904, "é è a"), (905, "one"), (906, "ONE")]
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()}
    assert got == _groups(rows)


def test_close_fingerprints_meet_at_an_anchor():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a = rng.integers(0, 1 << 63, dtype=np.uint64)
        b = a
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        at, row, home = anchors(np.array([a, b]), 2)
        homes = {int(x) for x, h, r in zip(at, home, row, strict=True) if h and r == 0}
        assert homes & {int(x) for x, r in zip(at, row, strict=True) if r == 1}
        assert fingerprint("a b c") == fingerprint("A B C")


def test_stage_keeps_one_of_each(spark):
    rows = [(5, "the same text of a few words"), (3, "the same text of a few words"), (3, "the same text of a few words"), (7, ""), (8, None), (None, "the same text of a few words"), (9, "quite another text with other words in it")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, 3, 7, 8, 9]
    assert one_of_each(docs.limit(0)).collect() == []
    assert near_duplicates(docs.limit(0)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (201, 200), (200, 201), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_third_of_all_rows_without_words_or_of_one_text(spark):
    texts = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "the very same text for all of these rows").otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256), F.lit(" and more of it"))).alias("text"), F.lit(1).alias("N"), F.lit("x").alias("component_id"))
    rows = near_duplicates(texts).groupBy("component_id").count().orderBy(F.desc("count"), "component_id").limit(2).collect()
    assert [tuple(r) for r in rows] == [(0, 3000), (1, 3000)]
