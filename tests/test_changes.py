"""Fields kept up batch by batch against the whole history, update by update."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gleaner.operators.upserts import ORIGIN_RANK
from gleaner.streaming import changes as C
from gleaner.streaming.store import Store

rng = random.Random(15)


def _batches():
    seq = 0
    for _ in range(4):
        rows = []
        for _ in range(120):
            seq += 1
            rows.append((rng.choice([None, *range(12)]), rng.choice([None, "stage", "city", "site"]), rng.choice([None, "a", "b", "c"]), rng.choice([*ORIGIN_RANK, "odd", None]), rng.choice("xyz"), seq, rng.random() < 0.1))
        yield rows


def plain(rows, state):
    for record, field, value, origin, source, seq, manual in rows:
        if record is None or field is None:
            continue
        rank = ORIGIN_RANK.get(origin, 0)
        now = state.get((record, field))
        if now is None or manual or rank >= ORIGIN_RANK.get(now[1], 0):
            state[record, field] = (value, origin, source, seq)


def test_batches_equal_the_whole_history(spark, tmp_path):
    store, state = Store(spark, f"{tmp_path}/store"), {}
    everything = lambda: {t: sorted(map(repr, spark.read.parquet(f"{tmp_path}/store/{t}").collect())) for t in ("fields", "feed", "scores")}
    score = lambda v: v.select("record_id", (F.length(F.coalesce(F.col("fields")["stage"]["value"], F.lit(""))) + F.length(F.coalesce(F.col("fields")["city"]["value"], F.lit("")))).alias("score"))
    for k, rows in enumerate(_batches()):
        before = dict(state)
        plain(rows, state)
        updates = spark.createDataFrame(rows, C.UPDATE)
        feed = C.write_back(store, updates, k)
        C.rescored(store, feed, k, ("stage", "city"), score)
        standing = {(r["record_id"], r["field"]): (r["value"], r["origin"], r["source"], r["seq"]) for r in C.standing(store).collect()}
        assert standing == state
        want = {}
        for key, now in state.items():
            was = before.get(key)
            if was != now:
                want[key] = (was and was[0], now[0], "added" if was is None else "confirmed" if was[0] == now[0] else "changed")
        assert {(r["record_id"], r["field"]): (r["before"], r["after"], r["change"]) for r in feed.collect()} == want
        again = {r for (r, f), w in want.items() if f in ("stage", "city") and w[2] != "confirmed"}
        assert {r["record_id"] for r in spark.read.parquet(f"{tmp_path}/store/scores/batch={k}").collect()} == again
        if k == 2:
            once = everything()
            C.rescored(store, C.write_back(store, updates, k), k, ("stage", "city"), score)
            assert everything() == once
    latest = {r["record_id"]: r["score"] for r in spark.read.parquet(f"{tmp_path}/store/scores").groupBy("record_id").agg(F.max_by("score", "batch").alias("score")).collect()}
    for record, points in latest.items():
        assert points == sum(len(state.get((record, f), ("",))[0] or "") for f in ("stage", "city"))
    none = C.write_back(store, spark.createDataFrame([], C.UPDATE), 9)
    assert none.count() == 0
