"""Components of links against plain union."""

from __future__ import annotations

import random

import pytest

from gleaner.llm.components import connected_components


@pytest.mark.parametrize("hub", [100_000, 10])
def test_hubs_joined_apart_give_the_same(spark, monkeypatch, hub):
    rng = random.Random(2)
    edges = [(1, k) for k in range(100, 1600)] + [(k, k + 1) for k in range(2000, 2012)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)] + [(1500, 2006), (5, 5), (None, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), hub=hub).collect()}
    assert got == {x: find(x) for x in root}
