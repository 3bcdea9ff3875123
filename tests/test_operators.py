"""Operators against plain code, and golden cases."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import classify, dates, entities, money, names, quality, urls
from gleaner.operators import aggregates, decisions, filters, latest, matching, upserts
from gleaner.operators.aggregates import independent_sources
from gleaner.plans import QUERIES
from gleaner.sources import feeds, writers
from gleaner.streaming import events


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (names.company_key, "AT&T Intl Labs, Inc.", "at and t international"),
        (names.company_key, "Pacific  Rim Energy, Inc.", "pacific rim energy"),
        (names.company_key, "Inc", "inc"),
        (names.company_name, "Foo Labs, Inc.", "foo"),
        (names.person_key, "José Núñez-Díaz", "jose nunez-diaz"),
        (urls.domain_key, "HTTPS://WWW.Foo.com/a/", "foo.com"),
        (urls.domain_key, "localhost", None),
        (urls.normal_url, " www.Foo.com/a/b/?q=1#x ", "foo.com/a/b"),
        (urls.url_problem, "https://u:p@a.com/", "credentials-in-url"),
        (money.amount_usd, "$2.1M", 2_100_000.0),
        (money.amount_usd, "raised 5", None),
        (money.raise_bucket, "$4M seed", "$1,000,000-5,000,000"),
        (money.raise_bucket, "$2 billion", "$0-1,000,000"),
        (dates.batch_date, "W25", datetime.date(2025, 1, 1)),
        (dates.batch_date, "S24", datetime.date(2024, 6, 1)),
        (dates.batch_date, "X", None),
        (dates.iso_date, "Tue, 5 Mar 2024 10:00:00 GMT", datetime.date(2024, 3, 5)),
        (dates.iso_date, "no date", None),
        (writers.csv_cell, "=SUM(A1)", "'=SUM(A1)"),
        (writers.csv_cell, "a,b", '"a,b"'),
        (classify.stage_of, "a pre-seed round", "Pre-seed"),
        (urls.decoded, "<![CDATA[a &lt;b&gt; &#233;&#x41;&amp;]]>", "a <b> éA&"),
    ],
)
def test_scalar_golden_cases(spark, make, text, want):
    assert one(spark, make(F.col("s")), s=text) == want


def test_confidence_and_week(spark):
    assert one(spark, money.tier_confidence(F.col("t"), F.col("c")), t=1, c=1) == 0.75
    assert one(spark, money.tier_confidence(F.col("t"), F.col("c")), t=2, c=3) == 0.4
    assert one(spark, dates.week_start(F.col("d").cast("timestamp")).cast("date"), d="2024-01-07") == datetime.date(2024, 1, 1)


def test_edit_distance_and_fuzzy_pairs(spark):
    assert matching.edit_distance("ab", "ba") == 1 and matching.edit_distance("ca", "abc") == 3 and matching.edit_distance("", "ab") == 2
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdef") for _ in range(rng.randint(5, 18))) for _ in range(40)]
    near = []
    for w in base:
        s = list(w)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(s) - 1)
            kind = rng.random()
            if kind < 0.3:
                s[i], s[i + 1] = s[i + 1], s[i]
            elif kind < 0.6:
                del s[i]
            else:
                s.insert(i, rng.choice("abcdef"))
        near.append("".join(s))
    keys = sorted({*base, *near})
    want = {
        (a, b) for a in keys for b in keys
        if a != b and min(len(a), len(b)) >= 5 and (d := matching.edit_distance(a, b)) <= 2 and 1 - d / max(len(a), len(b)) >= 0.85
    }
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert {(r["key"], r["other"]) for r in matching.fuzzy_pairs(df, df, "key").collect()} == want


def _greedy_shortlist(pool, caps, size):
    used, families, picked = {}, set(), []
    met = set()
    for turn in (1, 2):
        for c in pool:
            if len(picked) >= size:
                break
            if c in picked or (turn == 1 and c[1] in families):
                continue
            if used.get(c[2], 0) >= caps.get(c[2], 1 << 30):
                met.add(c)
                continue
            picked.append(c)
            families.add(c[1])
            used[c[2]] = used.get(c[2], 0) + 1
    out = {}
    for rank, c in enumerate(pool, 1):
        out[c[0]] = "selected" if c in picked else "source-family-cap" if c in met else "ranked-below-cutoff" if rank > size else "sector-limit"
    return out


def test_shortlist_equals_the_greedy_passes(spark):
    """Sources belong to one family each, as they do in practice."""
    rng = random.Random(2)
    family = {"yc": "acc", "sec": "reg", "news": "press", "blog": "press", "git": "code"}
    rows, want = [], {}
    for g in range(150):
        pool = []
        for k in range(rng.randint(0, 14)):
            source = rng.choice(list(family))
            pool.append((g * 100 + k, family[source], source))
        rows += [(g, i, f, s, k) for k, (i, f, s) in enumerate(pool)]
        want |= _greedy_shortlist(pool, {"yc": 2, "sec": 2}, 5)
    df = spark.createDataFrame(rows, "g long, id long, family string, source string, place int")
    got = latest.shortlist(df, "g", "family", "source", [F.col("place")], {"yc": 2, "sec": 2}, 5)
    assert {r["id"]: r["verdict"] for r in got.collect()} == want


def test_anchored_merge_and_classes(spark):
    rows = [("k", f"2024-01-{d:02d}") for d in (1, 21)] + [("k", "2024-02-10"), ("j", None)]
    df = spark.createDataFrame(rows, "key string, at string").withColumn("at", F.col("at").cast("date"))
    got = sorted((r["at"].isoformat(), r["head_at"].isoformat()) for r in decisions.merged_events(df, "key", "at").collect())
    assert got == [("2024-01-01", "2024-01-01"), ("2024-01-21", "2024-01-01"), ("2024-02-10", "2024-02-10")]
    cases = {1: ("funding-announcement", 30), 2: ("product-launch", 30), 3: ("funding-announcement", 366), 4: ("funding-announcement", -1)}
    ev = spark.createDataFrame([(k, t, "funding-news", 2, d) for k, (t, d) in cases.items()], "company_id long, opportunity_type string, source_id string, tier int, age int")
    ev = ev.withColumn("published_at", F.date_sub(F.lit("2024-06-01").cast("date"), F.col("age")))
    classes = {r["company_id"]: r["classification"] for r in decisions.classify(ev, F.lit("2024-06-01").cast("date")).collect()}
    assert classes == {1: "recent-financing-signal", 2: "unverified-opportunity", 3: "company-lead", 4: "company-lead"}


@pytest.mark.parametrize(
    ("name", "want"),
    [("Acme Fund III, L.P.", "numbered fund"), ("Acme Robotics, Inc.", None), ("Solar 12 LLC", "single-project vehicle"), ("Solar LLC", None), ("", "no-name")],
)
def test_issuers(spark, name, want):
    assert one(spark, entities.issuer_problem(F.col("s"), F.lit(False)), s=name) == want


def test_quotes_and_reviews(spark):
    say = lambda s: one(spark, entities.traction_state(F.col("s")), s=s)
    assert (say("We have 40 paying customers"), say("Our ARR doubled"), say("GMV is up"), say("a paid pilot"), say("nothing")) == ("multiple-deployments", "recurring-revenue", None, "paid-pilot", None)
    errors = one(spark, decisions.traction_review_errors(F.lit(True), F.col("u"), F.col("n"), F.lit("5M"), F.lit(True), F.lit(None)), u="", n="a longer note")
    assert errors == ["figure-needs-source", "confirmation-needs-source"]


def test_quality_priority(spark):
    say = [("It is trusted by Acme. Reportedly revolutionizing all.", False), ("We have 40 paying customers and a PhD", True)]
    df = spark.createDataFrame([(say, 10, 2), ([], None, 0)], "s array<struct<text:string,claimed:boolean>>, age int, n int")
    got = df.select(quality.quality(F.col("s"), F.col("age"), F.col("n")).alias("q")).select("q.*").collect()
    # 25 + 14 + half_up(14 * 0.6) + half_up(9 * 0.6) - 6 - 6 + 7 + 6
    assert (got[0]["priority"], got[0]["band"]) == (25 + 14 + 8 + 5 - 6 - 6 + 7 + 6, "medium")
    assert (got[1]["priority"], got[1]["band"], got[1]["signals"]) == (17, "low", ["no-buyer"])


def test_independent_sources(spark):
    long = "x" * 40
    items = [("a", long), ("a", "other"), ("b", long), ("c", "")]
    df = spark.createDataFrame([(items,), ([],)], "e array<struct<host:string,fingerprint:string>>")
    assert [r["n"] for r in df.select(independent_sources(F.col("e")).alias("n")).collect()] == [2, 0]


def test_provenance_with_and_without_override(spark):
    rows = [("a", "v", "verified", 1, False), ("a", "w", "extracted", 2, False), ("b", "v", "extracted", 1, False), ("b", "w", "extracted", 2, False), ("c", "v", "verified", 1, False), ("c", "w", "ai", 2, True), ("c", "x", "missing", 3, False), ("c", "y", "ai", 4, False)]
    df = spark.createDataFrame(rows, "k string, value string, origin string, seq int, manual boolean")
    assert {r["k"]: r["value"] for r in upserts.current_fields(df.drop("manual"), ["k"]).collect()} == {"a": "v", "b": "w", "c": "v"}
    assert {r["k"]: r["value"] for r in upserts.current_fields(df, ["k"], manual="manual").collect()} == {"a": "v", "b": "w", "c": "y"}


def test_feeds_filings_awards_and_csv(spark, tmp_path):
    rss = """<rss><channel><item><title><![CDATA[Acme &amp; Co raises]]></title><link>https://news.example.com/a</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate>
    <description>short</description><content:encoded><![CDATA[A much longer body <a href="https://acme.example.org/x">x</a> <a href="https://twitter.com/acme">t</a>]]></content:encoded></item>
    <item><title></title><link>https://news.example.com/b</link></item><item><title>c</title><link>ftp://x.example.com/</link></item></channel></rss>"""
    items = feeds.feed_items(spark.createDataFrame([("f", rss)], "feed string, xml string"))
    got = {r["link"]: r for r in items.collect()}
    first = got["https://news.example.com/a"]
    assert first["title"] == "Acme & Co raises" and first["body"].startswith("A much longer") and first["links"] == ["https://acme.example.org/x"] and first["published_at"].year == 2024
    assert {r["rejection"] for r in got.values()} == {None, "no-title", "not-http"}
    report = feeds.feed_report(items).first()
    assert (report["items"], report["kept"], report["failure_rate"]) == (3, 1, 0.67)
    xml = "<x><entityName>Acme Inc</entityName><totalOfferingAmount>$2,000</totalOfferingAmount><industryGroupType>Pooled Investment Fund</industryGroupType><relatedPersonInfo><firstName>Al</firstName><lastName>Li</lastName><relationship>Executive Officer</relationship></relatedPersonInfo><relatedPersonInfo><firstName>AL</firstName><lastName>LI</lastName></relatedPersonInfo></x>"
    f = feeds.filings(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (f["issuer"], f["offering_usd"], f["is_pooled_fund"], [p["name"] for p in f["people"]]) == ("Acme Inc", 2000.0, True, ["Al Li"])
    js = [('[{"firm":"A","award_amount":"$5","proposal_award_date":"2024-01-02","state":"ca"}]',), ('{"results":[{"firm":"B","award_amount":"x","proposal_award_date":"soon","state":"California"}]}',)]
    aw = {r["firm"]: r for r in feeds.awards(spark.createDataFrame(js, "json string")).collect()}
    assert (aw["A"]["amount_usd"], aw["A"]["state"], aw["B"]["amount_usd"], aw["B"]["awarded_on"]) == (5.0, "CA", None, None)
    path = tmp_path / "a.csv"
    path.write_text('name,city\n "Acme ""x""" , LA \n')
    assert [tuple(r) for r in feeds.csv_rows(spark, str(path), ["name", "city"]).collect()] == [('Acme "x"', "LA")]
    path.write_text("name,gender\na,b\n")
    with pytest.raises(ValueError, match="demographic"):
        feeds.csv_rows(spark, str(path), ["name", "gender"])
    good, bad = feeds.validated_json(spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":2}',), ("nonsense",)], "j string"), "j", "a int, b string", ["b"])
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["invalid-response", "missing: b"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, "=x")], "k long, s string")
    writers.write_csv(df, ["k", "s"], str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "1-rows")).collect()]
    assert sorted(x.strip() for x in lines) == ['1,"a,b"', "2,'=x"]
    writers.replace_partitions(df, str(tmp_path / "p"), ["k"])
    writers.replace_partitions(spark.createDataFrame([(2, "new")], df.schema), str(tmp_path / "p"), ["k"])
    assert {(r["k"], r["s"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "a,b"), (2, "new")}


def test_streams_equal_batches(spark, tmp_path):
    src = spark.createDataFrame([(i, f"2024-01-{1 + i % 20:02d} 00:{i % 60:02d}:00", "ab"[i % 2], i % 7) for i in range(200)], "id long, ts string, kind string, key long").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = events.landed(spark, str(tmp_path / "in"), src.schema)
    counts = {}

    def step(batch, _):
        for r in batch.groupBy("kind").count().collect():
            counts[r["kind"]] = counts.get(r["kind"], 0) + r["count"]

    events.run_in_batches(stream, step, str(tmp_path / "cp")).awaitTermination(120)
    assert counts == {"a": 100, "b": 100}
    week = events.weekly_activity(events.landed(spark, str(tmp_path / "in"), src.schema), "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("weeks").trigger(availableNow=True).start()
    week.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from weeks").collect())) == sorted(map(tuple, events.weekly_activity(src, "ts", "kind").collect()))
    once = events.once_per_key(events.landed(spark, str(tmp_path / "in"), src.schema), "id", "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.sql("select * from once").count() == 200


def test_edges_portfolio_and_filters(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "a", "a")], "edge_id int, from_id string, to_id string")
    assert sorted(r["edge_id"] for r in matching.edges_of(edges, spark.createDataFrame([("a",), ("c",)], "node string")).collect()) == [1, 2, 3, 4]
    records = spark.createDataFrame([(1, "fin", "payment rails for banks"), (2, "fin", "soil"), (3, "bio", "payment")], "id int, vertical string, about string")
    kept = records.where(filters.all_of(F.col("vertical") == "fin", None, filters.has_text(" SOIL ", "about")))
    assert [r["id"] for r in kept.collect()] == [2]
    said = records.select(filters.published_text(["vertical", "about"], []).alias("t")).first()["t"]
    assert said == "fin \n payment rails for banks"


def test_audit_view_and_market_days(spark):
    log = spark.createDataFrame([(i, f"entry {i} token=abc{i}") for i in range(600)], "at int, text string")
    rows = writers.audit_view(log, "at", "text").collect()
    assert len(rows) == 500 and rows[0]["at"] == 599 and all("[redacted]" in r["text"] for r in rows)


def test_independent_hosts_by_whole_pages(spark, tmp_path):
    head = '<html lang="en"><head>' + '<meta name="generator" content="one template">' * 6 + "</head><body>"
    body = lambda x: f"{head}<p>{x} and so on, in words enough to be told apart</p></body></html>"
    rows = [(1, "https://a.com/1", body("one story")), (2, "https://b.com/2", body("another story")), (3, "https://c.com/3", body("one story")), (53, "https://a.com/4", body("a third story")), (4, "no url", head), (5, "no url", head)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in QUERIES["independent_hosts"](spark, str(tmp_path)).collect()] == [("en", 4)]


def test_contained_texts_and_portfolios(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(120)] + [None, "", "a", "payment rails", "Ärzte"]
    a, b = (spark.createDataFrame([(w,) for w in some + some[:5]], "t string") for some in (words[:70], words[40:]))
    got = {tuple(r) for r in matching.contained(a, b, "t", "t").collect()}
    assert got == {(x, y) for x in words[:70] for y in words[40:] if x and y and x in y} and got
    assert matching.contained(a.limit(0), b, "t", "t").collect() == [] == matching.contained(a, b.limit(0), "t", "t").collect()
    records = spark.createDataFrame([(1, "Fin", "Payment rails for banks"), (2, "fin", "soil"), (3, "bio", "pay"), (4, None, None), (5, "x", "")], "id int, vertical string, subcategory string")
    ours = spark.createDataFrame([("A", "FIN", ["payment", "Banks"], ["soil"], []), ("B", "fin", ["paying"], [], ["pay"]), ("C", "gov", [], [], None)], "name string, vertical string, themes array<string>, partnership_themes array<string>, competitive_themes array<string>")
    rows = {r["id"]: tuple(r)[1:] for r in matching.portfolio_comparison(records, ours).collect()}
    assert rows[1] == (2, "high", 1, 0, 1, ["Banks", "payment"], "Medium") and rows[2] == (2, "high", 0, 1, 0, [], "Medium")
    assert rows[3] == (0, "none", 2, 0, 1, ["paying", "payment"], "Medium") and rows[4] == rows[5] == (0, "none", 0, 0, 0, [], "Low")


@pytest.mark.parametrize("most,cells", [(100_000, 1024), (5, 3), (1, 2)])
def test_floor_quantiles_of_groups_of_any_size(spark, most, cells):
    rng = random.Random(most)
    rows = [(g, rng.choice([rng.randint(0, 9), rng.random() * 10 ** rng.randint(-3, 9), -rng.random()])) for g in ["a"] * 400 + ["b"] * 7 + [None] * 60 + ["c"]] + [("a", None), ("none", None), ("a", float("nan"))]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    want = {}
    for g in ("a", "b", "c", None):
        values = sorted(v for k, v in rows if k == g and v is not None and v == v)
        want[g] = tuple(values[min(len(values) - 1, int(len(values) * p))] for p in (0.0, 0.5, 0.75, 1.0))
    got = {r["g"]: tuple(r)[1:] for r in aggregates.floor_quantiles(df, ["g"], "v", {"least": 0.0, "half": 0.5, "top": 0.75, "most": 1.0}, most, cells).collect()}
    assert got == want
    every = sorted(v for _, v in rows if v is not None and v == v)
    assert [tuple(r) for r in aggregates.floor_quantiles(df, [], "v", {"half": 0.5}, most, cells).collect()] == [(every[int(len(every) * 0.5)],)]


def test_independent_counts_of_groups_of_any_size(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *(f"h{k}" for k in range(25))]), rng.choice([None, "", *(f"f{k}" for k in range(60))])) for i in range(600)]
    want = {}
    for _, g, h, f in rows:
        hosts, prints, n = want.setdefault(g, [set(), set(), 0])
        if (h is None or h not in hosts) and (not f or f not in prints):
            want[g] = [hosts | {h} - {None}, prints | ({f} if f else set()), n + 1]
    got = {r["g"]: r["n_independent"] for r in aggregates.independent_counts(spark.createDataFrame(rows, "i long, g string, h string, f string"), "g", "i", "h", "f").collect()}
    assert got == {g: w[2] for g, w in want.items()}


def test_uses_of_a_frequent_model_stay_where_they_are(spark, capsys):
    from gleaner.functions.money import token_cost

    prices = spark.sparkContext.parallelize([("A", None, 1.0)]).toDF("model string, valid_to date, input double")
    prices = prices.select("model", F.lit("1990-01-01").cast("date").alias("valid_from"), "valid_to", "input", *(F.col("input").alias(c) for c in ("output", "cache_read", "cache_write", "web_search")))
    usage = spark.range(10).select(F.lit("A").alias("model"), F.lit("2001-01-01").alias("at"), *(F.col("id").alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens", "cache_write_tokens", "web_searches")))
    token_cost(usage, prices).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
