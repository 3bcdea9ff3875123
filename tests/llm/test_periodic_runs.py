"""Periodic runs against plain code."""

from __future__ import annotations

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from gleaner.llm import periodic_runs as P

rng = random.Random(13)


def plain_runs(words, least=6, times=4):
    """All maximal stretches by definition: every period, every stretch of equalities."""
    n, found = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - s
            block = words[s : s + length]
            smallest = next(q for q in range(1, p + 1) if all(block[k] == block[k + q] for k in range(length - q)))
            if smallest == p and length >= max(least, times * p):
                found.append((s, length, p))
    return sorted(found)


def cases():
    yield from ([], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 500, list("ab") * 4, list("ab") * 3, list("aab") * 9 + list("ab") * 9)
    for _ in range(250):
        words = []
        while len(words) < rng.randint(1, 160):
            block = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words += block * rng.choice([1, 1, 3, 4, 5, 9]) + block[: rng.randint(0, len(block))]
        yield words
    for _ in range(60):
        yield [rng.choice("ab") for _ in range(rng.randint(5, 200))]


def test_runs_equal_the_definition():
    n = 0
    for words in cases():
        want = plain_runs(words)
        assert P.runs_of(P._numbered(words)) == want
        n += len(want)
    assert n > 300


@pytest.mark.parametrize("least,times", [(3, 3), (10, 5), (6, 4)])
def test_other_limits(least, times):
    for words in list(cases())[::7]:
        assert P.runs_of(P._numbered(words), least, times) == plain_runs(words, least, times)
    with pytest.raises(ValueError):
        P.runs_of(np.zeros(9), 2, 2)


def test_long_texts_are_quick():
    a = np.zeros(300_000, np.int32)
    assert P.runs_of(a) == [(0, 300_000, 1)]
    b = np.tile(np.arange(40_000, dtype=np.int32), 7)
    assert P.runs_of(b) == [(0, 280_000, 40_000)]
    c = np.repeat(np.arange(20_000, dtype=np.int32), 7)
    assert P.runs_of(c) == [(7 * i, 7, 1) for i in range(20_000)]


TEXTS = [None, "", " \n\t", "one", "so so so so so so it is", "a b a b a b a b c", "\x0bwörter\x0cwörter " * 30 + "ende", "x y " * 8, "to be or not to be " * 9 + "fin"]


def _frame(spark):
    texts = TEXTS + [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 90))) for _ in range(120)] + ["lang " + "wort und satz " * 20_000]
    rows = [(i, t, "r", 1, "f") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, TEXTS[4], "r", 1, "f"), rows[4], rows[4]], "doc_id long, text string, runs string, found int, kept string")


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_equals_plain_code(spark, tmp_path):
    docs = _frame(spark).where("length(text) < 5000 or text is null")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in P.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(crc32(str(w[0]).encode()) % 10 == 0 and w[1] > 0 for w in want) > 3


def test_operator_keeps_rows_and_columns(spark):
    docs = _frame(spark)
    out = P.periodic_runs(docs, into="spans", collapsed="short")
    rows = out.collect()
    assert out.columns == [*docs.columns, "spans", "short"] and len(rows) == docs.count()
    assert {r["short"] for r in rows if r["doc_id"] == 4} == {"so it is"}
    assert [tuple(s) for s in rows[-4]["spans"]] == [(1, 60_000, 3)] and rows[-4]["short"] == "lang wort und satz"
    with pytest.raises(ValueError):
        P.periodic_runs(docs, into="RUNS")
    assert P.periodic_runs(docs.limit(0), into="spans").collect() == []
    assert "short" not in P.periodic_runs(docs, into="spans", collapsed=None).columns
