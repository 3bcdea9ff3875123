"""Merged announcements: links, components and heads against plain code, and the stream against the batch."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.operators import event_merge as M
from gleaner.operators.graph import components
from gleaner.streaming.merges import streamed_heads

rng = random.Random(21)
NAMES = ["spur", "spur intelligence", "spurr", "multiverse", "multiverse computing", "multiverze computing", "ramp", "rampart", "acme robotics", "acme robotiks", "acmee robotiks", "acne", "", None, "spur intelligence labs", "solar", "solar wind"]
DAY0 = date(2001, 1, 1)


def _rows(n):
    return [(i, rng.choice(NAMES), DAY0 + timedelta(days=rng.randint(0, 160)) if rng.random() < 0.97 else None) for i in range(n)]


def plain_heads(rows):
    """The sequential fold over every announcement."""
    heads, out = [], {}
    for seq, key, day in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[2], r[0])):
        head = next((h for h in heads if M.same_company(h[0], key) and abs((day - h[1]).days) <= 21), None)
        if head is None:
            head = (key, day)
            heads.append(head)
        out[seq] = head
    return out


def test_components_equal_plain_union(spark):
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(300)] + [(5, 5), (None, 3), (3, None)]
    root = {n: n for e in edges for n in e if n is not None and None not in e and e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_links_are_all_pairs_that_may_be_one_company(spark):
    names = sorted({n for n in NAMES if n} | {"".join(rng.choice("abc") for _ in range(rng.randint(4, 14))) for _ in range(60)})
    got = {tuple(sorted(r)) for r in M.key_links(spark.createDataFrame([(n,) for n in [*names, *names[:9], "", None]], "key string")).collect()}
    assert got == {(a, b) for a in names for b in names if a < b and M.same_company(a, b)}


@pytest.mark.parametrize("n", [3, 120, 900])
def test_heads_equal_the_sequential_fold(spark, n):
    rows = _rows(n)
    events = spark.createDataFrame(rows, "seq long, name string, at date").withColumn("key", F.lit("mine"))
    placed = M.with_heads(events, M.heads_of(events, "name", "at", "seq"), "name", "at").collect()
    want = plain_heads(rows)
    assert len(placed) == n
    assert {r["seq"]: (r["head_key"], r["head_at"]) for r in placed if r["head_key"]} == want


def test_no_rows_and_one_hot_name(spark):
    none = spark.createDataFrame([], "seq long, name string, at date")
    assert M.heads_of(none, "name", "at", "seq").collect() == []
    hot = spark.range(30_000).select(F.col("id").alias("seq"), F.lit("one name").alias("name"), F.date_add(F.lit(DAY0), (F.col("id") % 60).cast("int")).alias("at"))
    heads = M.with_heads(hot, M.heads_of(hot, "name", "at", "seq"), "name", "at").groupBy("head_at").count().collect()
    assert {r["head_at"]: r["count"] for r in heads} == {DAY0: 11_000, DAY0 + timedelta(days=22): 11_000, DAY0 + timedelta(days=44): 8_000}


def plain_merge(rows):
    """(n, sources, amount, text, round, investors, city, conflicts) by head, article by article."""
    out = {}
    heads = plain_heads([(r["seq"], r["name"], r["at"]) for r in rows])
    for r in sorted((r for r in rows if r["seq"] in heads), key=lambda r: (r["at"], r["seq"])):
        e = out.get(heads[r["seq"]])
        if e is None:
            out[heads[r["seq"]]] = {"n": 1, "urls": {r["url"]}, "amount": r["amount_usd"], "text": r["amount_text"], "round": r["round_type"], "investors": list(r["investors"]), "city": r["hq_city"], "by": r["publisher"], "url": r["url"], "conflicts": set()}
            continue
        e["n"] += 1
        e["urls"].add(r["url"])
        if r["amount_usd"] is not None and e["amount"] is not None and r["amount_usd"] != e["amount"]:
            e["conflicts"] |= {("amount", f"{e['text']} ({e['by']})", e["url"]), ("amount", f"{r['amount_text']} ({r['publisher']})", r["url"])}
        elif e["amount"] is None and r["amount_usd"] is not None:
            e["amount"], e["text"] = r["amount_usd"], r["amount_text"]
        if r["round_type"] and e["round"] and r["round_type"] != e["round"]:
            e["conflicts"] |= {("round", f"{e['round']} ({e['by']})", e["url"]), ("round", f"{r['round_type']} ({r['publisher']})", r["url"])}
        elif not e["round"] and r["round_type"]:
            e["round"] = r["round_type"]
        e["investors"] = list(dict.fromkeys(e["investors"] + r["investors"]))[:8]
        e["city"] = e["city"] if e["city"] is not None else r["hq_city"]
    return {k: (e["n"], len(e["urls"]), e["amount"], e["text"] if e["amount"] is not None else None, e["round"] or None, e["investors"][:8], e["city"], frozenset(e["conflicts"])) for k, e in out.items()}


def test_merged_facts_and_conflicts(spark):
    rows = []
    for seq, name, at in _rows(700):
        usd = rng.choice([None, 1e6, 1e6, 2e6])
        rows.append({"seq": seq, "name": name, "at": at, "url": f"https://p{rng.randint(0, 300)}", "publisher": rng.choice("xyz"), "amount_usd": usd, "amount_text": None if usd is None else f"${int(usd / 1e6)}M",
                     "round_type": rng.choice([None, "", "Seed", "Series A"]), "investors": rng.sample("ABCDEFGHIJKL", rng.randint(0, 5)), "hq_city": rng.choice([None, "Austin", "Boston"]), "hq_state": None, "sector": None})
    schema = "seq long, name string, at date, url string, publisher string, amount_usd double, amount_text string, round_type string, investors array<string>, hq_city string, hq_state string, sector string"
    events = spark.createDataFrame(rows, schema)
    placed = M.with_heads(events, M.heads_of(events, "name", "at", "seq"), "name", "at")
    merged = M.merged_announcements(placed, "at", "seq")
    said = {}
    for r in M.conflicts(placed, merged).collect():
        said.setdefault((r["head_key"], r["head_at"]), set()).add((r["field"], r["value"], r["url"]))
    got = {}
    for r in merged.collect():
        k = (r["head_key"], r["head_at"])
        got[k] = (r["n_articles"], r["n_sources"], r["amount_usd"], r["amount_text"], r["round_type"], r["investors"], r["hq_city"], frozenset(said.get(k, ())))
        assert r["needs_review"] == bool(said.get(k)) == (r["amount_conflict"] or r["round_conflict"])
    assert got == plain_merge(rows) and any(v[-1] for v in got.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_gives_the_heads_of_the_batch_for_any_arrival_order(spark, tmp_path, seed):
    rows = [r for r in _rows(160) if r[2]]
    known = M.identities(spark.createDataFrame(rows, "seq long, name string, at date").where("name <> ''"), "name").select(F.col("name").alias("key"), "identity")
    known.write.parquet(f"{tmp_path}/known")
    shuffled = random.Random(seed).sample(rows, len(rows))
    late = [(9000 + i, "end of time", DAY0 + timedelta(days=2000 + 100 * i)) for i in range(2)]
    for i, part in enumerate([shuffled[:50], shuffled[50:110], shuffled[110:], late[:1], late[1:]]):
        spark.createDataFrame([(s, k, datetime(d.year, d.month, d.day, 9)) for s, k, d in part], "seq long, name string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (tmp_path / "landing").mkdir()
        for i in range(5):
            for f in (tmp_path / f"in{i}").glob("*.parquet"):
                f.rename(tmp_path / "landing" / f"{i}-{f.name}")
            stream = spark.readStream.schema("seq long, name string, at timestamp").parquet(f"{tmp_path}/landing")
            found = streamed_heads(stream, spark.read.parquet(f"{tmp_path}/known"), "name", "at", "seq", delay="400 days")
            found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["key"], r["day"]): (r["head_key"], r["head_day"]) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["key"] != "end of time"}
    epoch = date(1970, 1, 1)
    want = {}
    heads = plain_heads(rows)
    for s, k, d in rows:
        if k:
            want[k, (d - epoch).days] = (heads[s][0], (heads[s][1] - epoch).days)
    assert got == want


def test_a_name_is_compared_with_few_heads(monkeypatch):
    monkeypatch.setattr(M, "same_company", lambda a, b: pytest.fail("compared with every head"))
    anchors = M.Anchors()
    for i in range(2000):
        anchors.place(f"name{i} labs", i // 100, ())
    assert anchors.place("name7", 20, ()) == ("name7 labs", 0)
    assert anchors.place("name8 labs inc", 20, ["name7 labs"]) == ("name7 labs", 0)
    assert anchors.place("name7 labs", 22, ()) == ("name7 labs", 22)
    assert list(anchors.heads)[0] == ("name100 labs", 1)


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    order = random.Random(1).sample(range(400), 400)
    links, rounds = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long"), []
    checkpoint = type(links).checkpoint
    monkeypatch.setattr(type(links), "checkpoint", lambda df: rounds.append(1) or checkpoint(df))
    found = components(links).collect()
    assert len(found) == 400 and {r["component"] for r in found} == {0}
    assert len(rounds) <= 35
