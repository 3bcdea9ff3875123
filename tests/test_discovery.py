"""Discovery runs against a sequential one, candidate by candidate, and runs that are repeated."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from gleaner.operators import discovery as D
from gleaner.streaming import discovery as S

rng = random.Random(41)
NAMES = ["Acme", "Acme Inc", "Bolt", "Bolt Labs", "Civic", "Delta", "Echo", "Foxtrot"]
SITES = ["Unknown", None, "https://acme.example.com", "https://www.acme.example.com/x", "bolt.example.com", "https://civic.example.com", "https://d.example.com"]
COMPANIES = "id long, name string, domain string, external_ids array<string>, crm_id string, founders array<string>, position long, last_refreshed date"
QUERY = D.Query("2001-08-01", verticals=("health", "fow"), states=("NY", "CA"), least_confidence=0.2, most_evidence_days=400)


def _rows(n, start=0, **fixed):
    out = []
    for i in range(start, start + n):
        r = {f: rng.choice(["Unknown", f"{f} of {rng.randint(0, 3)}", None]) for f in D.FILLED}
        r |= {"seq": i, "source_id": rng.choice(["yc", "sec"]), "company_name": rng.choice(NAMES), "website": rng.choice(SITES), "vertical": rng.choice(["Unknown", "health", "other"]), "stage": "Unknown", "hq_state": rng.choice(["NY", "Unknown", "TX"]), "pitch": rng.choice(["Unknown", "A digital agency for all", "Software for clinics"])}
        r |= {"confidence": rng.choice([0.1, 0.5, 0.9, 2.0]), "founding_year": rng.choice([None, 1999]), "funding_date": None, "founder_names": rng.choice([None, ["Ann Lee"]]), "signals": None}
        r["evidence"] = [(f"claim {k}", f"https://e.example.com/{rng.randint(0, 6)}", date(2001, 7, rng.randint(1, 28)) if rng.random() < 0.8 else date(1999, 1, 1)) for k in range(rng.randint(0, 3))]
        out.append(r | fixed)
    return out


def _frame(spark, rows):
    names = [f.split(" ", 1)[0] for f in D.CANDIDATE.replace("array<struct<claim:string,url:string,accessed:date>>", "evidence").split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], D.CANDIDATE)


def _domain(site):
    if site in (None, "Unknown"):
        return ""
    h = site.replace("https://", "").removeprefix("www.").split("/")[0]
    return h if "." in h else ""


def _name(name):
    return " ".join(w for w in name.lower().split() if w not in ("inc", "labs"))


def plain_merge(rows, pending):
    """What becomes of each candidate that passed, one after the other: {seq: (outcome, target)}."""
    run, old, out = [], [[_domain(p["website"]), _name(p["company_name"]), p["seq"]] for p in pending], {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        d, n = _domain(r["website"]), _name(r["company_name"])
        for kind, targets in (("merged-in-run", run), ("merged-into-pending", old)):
            hit = next((t for t in targets if (t[0] == d if t[0] and d else t[1] == n)), None)
            if hit:
                hit[0] = hit[0] or d
                out[r["seq"]] = (kind, hit[2])
                break
        else:
            run.append([d, n, r["seq"]])
            out[r["seq"]] = ("accepted", r["seq"])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_places_equal_the_sequential_merge(spark, seed):
    rng.seed(seed)
    fixed = {"confidence": 0.5, "vertical": "health", "hq_state": "NY", "pitch": "Software for clinics", "evidence": []}
    pending, rows = _rows(6, **fixed), _rows(140, 100, **fixed)
    old = _frame(spark, pending).select("seq", "website", "company_name")
    got = D.decided(_frame(spark, rows), spark.createDataFrame([], COMPANIES), old, QUERY).collect()
    assert {r["seq"]: (r["outcome"], r["target"]) for r in got} == plain_merge(rows, pending)


def test_every_gate_and_the_budget(spark):
    rows = _rows(300)
    companies = spark.createDataFrame([(1, "Bolt", "bolt.example.com", [], None, [], 0, date(2001, 7, 30)), (2, "Civic", "civic.example.com", [], None, [], 1, date(2000, 1, 1))], COMPANIES)
    none = spark.createDataFrame([], "seq long, website string, company_name string")

    def early(r):
        dated = [e[2] for e in r["evidence"]]
        if not 0 <= r["confidence"] <= 1:
            return "invalid"
        if r["confidence"] < 0.2 or r["hq_state"] == "TX":
            return "not-asked"
        if dated and (date(2001, 8, 1) - max(dated)).days > 400:
            return "filtered-by-policy"
        if _domain(r["website"]) in ("bolt.example.com", "civic.example.com"):
            return "duplicate-skipped"
        return None

    got = {r["seq"]: r for r in D.decided(_frame(spark, rows), companies, none, QUERY).collect()}
    for r in rows:
        if early(r):
            assert got[r["seq"]]["outcome"] == early(r), r
    late = [r for r in rows if not early(r)]
    thesis = {r["seq"] for r in late if got[r["seq"]]["outcome"] == "filtered-by-thesis"}
    assert {r["seq"] for r in late if r["pitch"] == "A digital agency for all" or r["vertical"] == "other"} <= thesis
    fit = [r for r in late if r["seq"] not in thesis]
    assert {r["seq"]: (got[r["seq"]]["outcome"], got[r["seq"]]["target"]) for r in fit} == plain_merge(fit, [])
    accepted = sorted(s for s, r in got.items() if r["outcome"] == "accepted")
    budget = {r["seq"]: r["outcome"] for r in D.decided(_frame(spark, rows), companies, none, D.Query(**{**QUERY.__dict__, "most_results": 2})).collect()}
    assert budget == {s: r["outcome"] if s <= accepted[1] else "not-reached" for s, r in got.items()}
    stale = {r["seq"]: r["outcome"] for r in D.decided(_frame(spark, rows), companies, none, D.Query(**{**QUERY.__dict__, "mode": "stale-only", "enforce_thesis": False})).collect()}
    for r in rows:
        if not early(r) or early(r) == "duplicate-skipped":
            known = _domain(r["website"]) == "civic.example.com" or (_domain(r["website"]) != "bolt.example.com" and _name(r["company_name"]) == "civic")
            assert (stale[r["seq"]] == "filtered-by-policy") != known, r


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    store = S.Store(spark, f"{tmp_path}/store")
    companies = spark.createDataFrame([(1, "Bolt", "bolt.example.com", [], None, [], 0, None)], COMPANIES)
    batches = [_rows(60, 0), _rows(60, 60)]
    tables = lambda: {t: sorted(map(repr, spark.read.parquet(f"{tmp_path}/store/{t}").collect())) for t in ("decisions", "candidates", "evidence", "runs")}
    counts = [S.run_once(store, _frame(spark, b), k, companies, QUERY) for k, b in enumerate(batches)]
    once = tables()
    assert S.run_once(store, _frame(spark, batches[1]), 1, companies, QUERY) == counts[1] and tables() == once
    decisions = spark.read.parquet(f"{tmp_path}/store/decisions").collect()
    for k in (0, 1):
        mine = [r for r in decisions if r["batch"] == k]
        recount = Counter(r["outcome"].replace("-", "_") for r in mine)
        assert {o: counts[k][o] for o in (x.replace("-", "_") for x in D.OUTCOMES)} == {o: recount[o] for o in (x.replace("-", "_") for x in D.OUTCOMES)}
        assert counts[k]["seen"] == len(mine) == 60
        assert counts[k]["duplicates_identified"] == sum(r["outcome"] not in ("invalid", "not-asked") and r["duplicate_status"] != "none" for r in mine)
    assert counts[1]["merged_into_pending"] > 0
    taken = [r for r in decisions if r["target"] is not None]
    final = {r["target"]: r for r in S.candidates(store).collect()}
    assert set(final) == {r["target"] for r in taken}
    for target, row in final.items():
        mine = sorted((r for r in taken if r["target"] == target), key=lambda r: r["seq"])
        assert row["n_sources"] == len(mine) and row["confidence"] == max(r["confidence"] for r in mine)
        for f in D.FILLED:
            assert row[f] == next((r[f] for r in mine if r[f] != "Unknown"), "Unknown")
    cited = {(r["target"], r["url"]): r["claim"] for r in spark.read.parquet(f"{tmp_path}/store/evidence").collect()}
    want = {}
    for r in sorted(taken, key=lambda r: r["seq"]):
        for e in r["evidence"]:
            want.setdefault((r["target"], e["url"]), e["claim"])
    assert cited == want


def test_runs_over_what_lands(spark, tmp_path):
    for k in range(2):
        _frame(spark, _rows(20, 20 * k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landing")
    stream = spark.readStream.schema(D.CANDIDATE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/landing")
    for _ in range(2):  # started again, there is nothing left to do
        S.discover(stream, f"{tmp_path}/store", lambda: spark.createDataFrame([], COMPANIES), QUERY, f"{tmp_path}/checkpoint").awaitTermination()
        runs = spark.read.parquet(f"{tmp_path}/store/runs").orderBy("batch").collect()
        assert [r["seen"] for r in runs] == [20, 20]
    assert spark.read.parquet(f"{tmp_path}/store/decisions").select(F.count_distinct("seq").alias("n")).first()["n"] == 40
