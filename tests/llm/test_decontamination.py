"""Decontamination against alignment of everything with everything."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gleaner.llm.decontamination import Index, Limits, contaminations, find, normalised, without_contamination

rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def _prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize()


def _edits(pattern, text):
    """Least edits of pattern against any stretch of text, by the whole table."""
    row = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text])
    steps = np.arange(len(text) + 1)
    for c in pattern:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def _spoilt(s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        s[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
    return "".join(s)


@pytest.mark.parametrize("limits", [Limits(), Limits(window=60, step=25, rate=0.08)])
def test_finds_exactly_what_alignment_finds(limits):
    items = [(k, _prose(rng.randint(12, 60))) for k in range(12)]
    index = Index(items, limits)
    for _ in range(60):
        item, start, window = rng.choice(index.windows)
        text = f"{_prose(40)} {_spoilt(''.join(map(chr, window)), rng.randrange(int(limits.edits(len(window))) + 3))} {_prose(30)}"
        plain = "".join(map(chr, normalised(text)[0]))
        hits = {}
        for i, s, _, _, e in find(index, [text])[0]:
            hits[i, s] = min(e, hits.get((i, s), e))
        want = {}
        for i, s, w in index.windows:
            e = _edits("".join(map(chr, w)), plain)
            if e <= limits.edits(len(w)):
                want[i, s] = e
        assert hits == want


def test_places_and_stages(spark):
    item = _prose(30)
    docs = [(1, f"before  {item.upper()} after"), (2, _prose(200)), (3, None), (4, ""), (5, item.replace(" ", "\n\t")), (5, item.replace(" ", "\n\t")), (6, (_prose(500) + " ") * 20)]
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, item, "x"), (9, item, "x"), (10, None, "x"), (11, "short", "x")], "item_id long, text string, doc_id string")
    rows = contaminations(frame.drop("item_id"), bench).collect()
    assert sorted({(r["doc_id"], r["item_id"]) for r in rows}) == [(1, 9), (5, 9)]
    one = [r for r in rows if r["doc_id"] == 1]
    assert min(r["start"] for r in one) == 8 and max(r["stop"] for r in one) == 8 + len(item) and {r["edits"] for r in one} == {0}
    assert sum(r["doc_id"] == 5 for r in rows) == 2 * len(one)
    kept = without_contamination(frame, bench)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 6]
    sliced = contaminations(frame.drop("item_id"), bench, Limits(slice_chars=50))
    assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, rows))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert contaminations(docs, none).collect() == []
    assert contaminations(docs.limit(0), none).collect() == []
    assert without_contamination(docs, none).count() == 1


def test_excerpts_and_short_items_are_found():
    item = _prose(60)
    index = Index([(1, item), (2, "Who wrote it?"), (3, "tiny")], Limits())
    assert all({h[0] for h in find(index, [f"{_prose(20)} {item[a : a + 79]} {_prose(20)}"])[0]} == {1} for a in range(0, len(item) - 79, 7))
    assert [h[0] for h in find(index, ["So: who  wrote IT? Nobody."])[0]] == [2]
    assert find(index, ["mywho wrote it? tiny", "who wrote its?", None]) == [[], [], []]


def test_q_grams_counted_stretch_by_stretch_find_the_same():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, "the common start of it " + " ".join(word() for _ in range(30))) for i in range(30)]
    index = Index(items, Limits())
    texts = [" ".join(word() for _ in range(80)) for _ in range(5)] + [f"{items[3][1]} {' '.join(word() for _ in range(20))} {items[4][1][40:160]}", "the common start of it " * 40, "x" * 50, ""]
    plain = [index.regions(normalised(t)[0]) for t in texts]
    whole = index.shared
    index.shared = lambda codes, most_held=50: whole(codes, most_held)
    assert [index.regions(normalised(t)[0]) for t in texts] == plain and plain[5]
