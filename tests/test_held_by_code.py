"""Queries without SQL against plain code over the same tables."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleaner.functions import classify, site_evidence
from gleaner.operators.matching import edit_distance

SF = "/root/testdata/sf0.001"


def _table(sql):
    found = duckdb.sql(re.sub(r"\{(\w+)\}", rf"'{SF}/\1.parquet'", sql))
    return [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]


def _collected(spark, name):
    return [r.asDict(True) for r in entry.queries()[name](spark, SF).collect()]


def _plain_fuzzy(a, b):
    if a == b or min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 2:
        return None
    d = edit_distance(a, b)
    s = 1 - d / max(len(a), len(b))
    return (d, s) if d <= 2 and s >= 0.85 else None


def test_fuzzy_names(spark):
    names = sorted({r["k"] for r in _table("SELECT lower(p_name || ' ' || p_brand) AS k FROM {part}")})
    want = {(a, b, *hit) for i, a in enumerate(names) for b in names[i + 1 :] if (hit := _plain_fuzzy(a, b))}
    assert {(r["key"], r["other"], r["edits"], r["similarity"]) for r in _collected(spark, "fuzzy_names")} == want and want


def test_sanitised_texts(spark):
    cases = {
        None: "", "": "", "two  words\t here": "two words here", "a\n\n\n\nb": "a\n\nb", "x<!-- no -->y": "x y", "<div hidden>secret</div>seen": "seen", '<p style="display: none">gone</p>here': "here", "<b>bold</b> &amp; &lt;i&gt;": "bold & <i>",
        "in\u200bvis\u2060ible\u00ad": "invisible", "<script>if (a < b) {}</script>code": "code", "É\u202eÊ": "ÉÊ",
    }
    got = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in cases] + [("w" * 9000,)], "t string").select("t", classify.sanitised(F.col("t")).alias("s")).collect()}
    assert {t: got[t]["text"] for t in cases} == cases
    assert got["w" * 9000]["truncated"] and got["w" * 9000]["text"] == "w" * 8000 + "\n[truncated at 8000 characters]"


def test_model_answers(spark):
    cases = {'{"a": 1}': '{"a": 1}', 'Sure: {"a": {"b": 2}} done': '{"a": {"b": 2}}', '```json\n[1, 2]\n```': "[1, 2]", "no": None, "": None, None: None, '{"a": 1': None, "```{broken```": None, '{"a": 1} and {"b": 2}': None, "1, 2": None, '{"a": [1, 2]} ': '{"a": [1, 2]}'}
    got = {r["t"]: r["m"] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", classify.model_json(F.col("t")).alias("m")).collect()}
    assert {t: m["json"] for t, m in got.items()} == cases
    assert (got[""]["error"], got[None]["error"], got["no"]["error"], got['{"a": 1}']["error"]) == ("empty", "empty", "not-json", None)


def test_component_extremes(spark):
    from gleaner.operators import scoring
    from gleaner.plans import entities
    from gleaner.plans.registry import Tables

    t = Tables(spark, SF)
    parts = {r["id"]: r["components"] for r in scoring.fit_score(entities._companies(t), entities._today(), {"BUILDING": "core", "MACHINERY": "exception"}, ["CA", "TX"]).select("id", "components").collect()}
    got = _collected(spark, "component_extremes")
    assert len(got) == len(parts)
    for r in got:
        judged = [c for c in parts[r["id"]] if c["assessable"]] or parts[r["id"]]
        shares = [c["points"] / c["most"] for c in judged]
        assert (r["strongest"], r["weakest"]) == (judged[shares.index(max(shares))]["key"], judged[shares.index(min(shares))]["key"])


def test_match_possible_tiers(spark):
    from gleaner.functions.names import company_key, founder_key
    from gleaner.operators import matching
    from gleaner.plans import entities
    from gleaner.plans.registry import Tables

    t = Tables(spark, SF)
    plain = lambda odd: [r.asDict() for r in matching.prepared(entities._records(t, odd)).withColumn("people", F.transform("founders", founder_key)).withColumn("key", company_key(F.col("name"))).collect()]
    inputs, pool = plain(1), sorted(plain(0), key=lambda r: (r["position"], r["id"]))
    words = lambda k: {w for w in k.split(" ") if len(w) > 2}
    want = {}
    for a in inputs:
        exact = any((a["_domain_key"] and a["_domain_key"] == b["_domain_key"]) or set(a["external_ids"] or ()) & set(b["external_ids"] or ()) or (a["crm_id"] and a["crm_id"] == b["crm_id"]) or (a["key"] and a["key"] == b["key"]) for b in pool)
        if exact:
            continue
        fuzzy = [(-hit[1], i) for i, b in enumerate(pool) if (hit := _plain_fuzzy(a["key"], b["key"]))]
        if fuzzy:
            s, i = min(fuzzy)
            want[a["id"]] = ("possible", "fuzzy-name", pool[i]["id"], round(-s, 9))
            continue
        for b in pool:
            x, y = words(a["key"]), words(b["key"])
            j = len(x & y) / len(x | y) if x | y else 0
            if j >= 0.4 and {p for p in a["people"] or () if len(p) > 3} & {p for p in b["people"] or () if len(p) > 3}:
                want[a["id"]] = ("possible", "founder-evidence", b["id"], round(j, 9))
                break
        else:
            want[a["id"]] = ("none", None, None, 0.0)
    got = {r["id"]: (r["kind"], r["matched_by"], r["match_id"], round(r["similarity"], 9)) for r in _collected(spark, "match_possible_tiers")}
    assert got == want and {w[1] for w in want.values()} >= {"fuzzy-name"}


def test_independent_hosts(spark):
    from gleaner.functions.names import claim_fingerprint
    from gleaner.functions.urls import host, readable_text

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", host(F.col("url")).alias("h"), claim_fingerprint(readable_text(F.col("html"))).alias("f"), F.regexp_extract("html", 'lang="(\\w+)"', 1).alias("lang")).orderBy("page_id").collect()
    want = {}
    for r in pages:
        hosts, prints, n = want.get(r["lang"], (set(), set(), 0))
        new = (r["h"] is None or r["h"] not in hosts) and (not r["f"] or r["f"] not in prints)
        want[r["lang"]] = (hosts | {r["h"]} if new and r["h"] is not None else hosts, prints | {r["f"]} if new and r["f"] else prints, n + new)
    assert {r["lang"]: r["n_independent"] for r in _collected(spark, "independent_hosts")} == {k: v[2] for k, v in want.items()}


@pytest.mark.parametrize(
    "html,name,url,level",
    [
        (None, "Acme", "https://acme.com", None),
        ("<title>acme.com</title>" + "word " * 200, "Acme", "https://acme.com", "parked"),
        ("This domain is for sale" + " word" * 200, "Acme", "https://acme.com", "parked"),
        ("<p>Acme</p>", "Acme", "https://acme.com", "thin"),
        ("Acme makes fine things. " * 40, "Acme", "https://other.com", "unrelated"),
        ("Nobody makes fine things. " * 40, "Acme", "https://acme.com", "unrelated"),
        ("Our product is the widget that Acme engineers built for hospitals in nine countries. " * 12, "Acme, Inc.", "https://www.acme.com", "substantive"),
        ("Die Firma Acme baut seit zehn Jahren feine Lampen und Lupen für Kliniken in aller Welt. " * 12, "Acme", "https://acme.de", "undetermined"),
        ("Acme • product • pricing • " * 40, "Acme", "https://acme.com", "undetermined"),
        ("Acme is a holding company for the interests of a family and of those who are near to it. " * 12, "Acme", "https://acme.com", "identity-only"),
        ("Acme is coming back later on and will tell all of you more when the time for that is right, says our team here at Acme. " * 2, "Acme", "https://acme.com", "identity-only"),
    ],
)
def test_site_evidence(spark, html, name, url, level):
    e = spark.createDataFrame([(html, name, url)], "html string, name string, url string").select(site_evidence.site_evidence(F.col("html"), F.col("name"), F.col("url")).alias("e")).first()["e"]
    assert (e and e["level"]) == level
