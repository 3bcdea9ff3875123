"""The table of companies against a plain filter."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from gleaner.operators import company_table as T
from gleaner.operators.decisions import LIVE_CLASSES

rng = random.Random(24)
TODAY = date(2001, 8, 1)
SCHEMA = (
    "id long, name string, one_liner string, subcategory string, city string, state string, website string, founder_names array<string>, vertical string, stage string, possible_duplicate boolean, missing_info boolean, evidence_confidence double, provisional boolean, needs_diligence boolean, eligible boolean, "
    "last_refreshed date, discovered_at date, quarantined boolean, classification string, primary_source string, primary_tier int, amount_usd double, round_type string, n_sources int, operating_level string, qualification string, publicly_traded boolean, fund_or_spv boolean, evidence_published_at date, newest_evidence date, score double"
)
FLAG = (True, False, None)


def _row(i):
    day = lambda: rng.choice([None, TODAY - timedelta(days=rng.randint(0, 90))])
    return (
        i, rng.choice(["Acme", "Bolt É"]), rng.choice(["robots", None]), rng.choice(["x", None]), "Austin", rng.choice(["TX", "NY", None]), rng.choice([None, "a.com"]), rng.choice([None, [], ["Ann Lee", "Bo"]]), rng.choice(["health", "fow", None]), rng.choice(["Seed", "Series A", None]), rng.choice(FLAG), rng.choice(FLAG),
        rng.choice([None, 0.2, 0.5, 0.9]), rng.choice([True, False]), rng.choice(FLAG), rng.choice(FLAG), day(), day(), rng.choice(FLAG), rng.choice([None, *LIVE_CLASSES, "company-lead"]), rng.choice([None, "sec", "yc"]), rng.choice([None, 1, 2]), rng.choice([None, 5.0]), rng.choice([None, "", "Seed"]),
        rng.choice([None, 0, 2]), rng.choice([None, "substantive", "thin"]), rng.choice([None, "human-review-required"]), rng.choice(FLAG), rng.choice(FLAG), day(), day(), rng.choice([1.0, 7.5]),
    )


def plain(r, w):
    live = (r["classification"] or "company-lead") in LIVE_CLASSES
    touched = r["last_refreshed"] or r["discovered_at"]
    hay = " ".join(str(x) for x in (r["name"], r["one_liner"], r["subcategory"], r["city"], r["state"], r["website"], *(r["founder_names"] or [])) if x is not None).lower()
    return not (
        (w.verticals and r["vertical"] not in w.verticals) or (w.stage and r["stage"] != w.stage) or (w.state and r["state"] != w.state) or (w.possible_duplicates and not r["possible_duplicate"]) or (w.missing_info and not r["missing_info"])
        or (w.least_evidence_confidence > 0 and (r["evidence_confidence"] is None or r["evidence_confidence"] < w.least_evidence_confidence)) or (w.assessed and r["provisional"]) or (w.needs_diligence and not r["needs_diligence"]) or (w.promising and not r["eligible"])
        or (w.untouched_days is not None and (touched is None or (TODAY - touched).days < w.untouched_days)) or (not w.quarantined_too and r["quarantined"]) or (w.classification and (r["classification"] or "company-lead") != w.classification) or (w.live and not live) or (w.leads and live)
        or (w.primary_source and (r["primary_source"] or "none") != w.primary_source) or (w.tier and r["primary_tier"] != w.tier) or (w.with_amount and r["amount_usd"] is None) or (w.with_round and not r["round_type"])
        or (w.uncorroborated and (r["n_sources"] or 0) >= 1 and r["operating_level"] == "substantive") or (w.for_review and r["qualification"] != "human-review-required") or (w.public_warning and not r["publicly_traded"]) or (w.fund_warning and not r["fund_or_spv"])
        or (w.evidence_since and (r["evidence_published_at"] is None or r["evidence_published_at"].isoformat() < w.evidence_since)) or w.text.strip().lower() not in hay
    )


def _wanted():
    yes = lambda: rng.random() < 0.12
    some = lambda *values: rng.choice(values) if rng.random() < 0.15 else None
    flags = ("possible_duplicates", "missing_info", "assessed", "needs_diligence", "promising", "quarantined_too", "live", "leads", "with_amount", "with_round", "uncorroborated", "for_review", "public_warning", "fund_warning")
    return T.Wanted(
        verticals=some(("health",), ("health", "fow")) or (), stage=some("Seed"), state=some("TX", "NY"), least_evidence_confidence=some(0.3, 0.9) or 0.0, untouched_days=some(0, 30), classification=some("company-lead"), primary_source=some("sec", "none"), tier=some(1, 2),
        evidence_since=some("2001-07-01"), text=some(" ACME ", "ann", "É", "zzz") or "", **{f: yes() for f in flags},
    )


def test_every_predicate_equals_the_plain_filter(spark):
    df = spark.createDataFrame([_row(i) for i in range(400)], SCHEMA)
    rows = df.collect()
    wanted = [_wanted() for _ in range(50)] + [T.Wanted()]
    marks = df.select("id", F.array(*(T.passes(w, F.lit(TODAY)) for w in wanted)).alias("m")).collect()
    for k, w in enumerate(wanted):
        assert {r["id"] for r in marks if r["m"][k]} == {r["id"] for r in rows if plain(r, w)}, w
    assert sum(any(r["m"][k] for r in marks) for k in range(51)) > 25
    assert T.company_table(df.limit(0), T.Wanted(text="x"), F.lit(TODAY)).collect() == []
    old = date(1970, 1, 1)
    keys = {"evidence-recency": lambda r: (-((r["newest_evidence"] or old) - old).days, r["id"]), "discovery-date": lambda r: (-((r["discovered_at"] or old) - old).days, r["id"]), "score": lambda r: (r["provisional"], -r["score"], r["id"])}
    for mode, key in keys.items():
        assert [r["id"] for r in df.orderBy(*T.order_of(mode)).collect()] == [r["id"] for r in sorted(rows, key=key)]
