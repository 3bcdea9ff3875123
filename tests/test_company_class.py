"""Sectors of companies against a plain reading."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from gleaner.functions import company_class as K
from gleaner.functions.sectors import SUBVERTICALS

rng = random.Random(7)
SIGNALS = {"health": (["clinical", "patient", "Telehealth"], ["hospital", "clinic"]), "fintech": (["payment", "lending", "ledger"], ["bank", "merchant"]), "fow": (["hiring", "agents", "payroll"], ["recruiter", "employer", "hr team"])}
WORDS = ["clinical", "PATIENT", "telehealth", "hospital", "clinic", "payments", "lending", "ledger", "banks", "merchant", "hiring", "agents", "payroll", "recruiter", "employer", "hr\nteam", "robots", "the", "É"]
LISTS = [None, "", "Unknown", "B2B, Fintech", "Robotics; Health", "Data / Education", "N/A", "Consumer", "Climate, Healthcare"]


def plain(text, resolved, own, listed):
    if not resolved:
        return None, None, None, 0.0, "inferred", "identity-unresolved"
    text = text or ""
    low = f" {re.sub(r'\s+', ' ', text.lower())} "
    scores = []
    for k, (s, (does, pays)) in enumerate(SIGNALS.items()):
        d, p = [w for w in does if w.lower() in low], [w for w in pays if w.lower() in low]
        scores.append((-len(d) * (len(p) + 1), k, s, d, p))
    scores.sort(key=lambda x: x[:2])
    directory = None
    if listed and not re.search(K.NO_CATEGORY, listed):
        parts = [p.strip() for p in re.split("[,;/]", listed) if p.strip()]
        directory = next((s for s, p in K.DIRECTORY if any(re.search(p, x) for x in parts)), None)
    sub = lambda s: next((label for label, p in SUBVERTICALS[s] if re.search(p, text.lower())), None)
    (score, _, top, does, pays), second = scores[0], scores[1]
    if -score < 2:
        return (directory, None, sub(directory), 0.4, "inferred", None) if directory else (None, None, None, 0.0, "inferred", "no-product-or-buyer-stated")
    other = second[2] if second[0] < 0 and -second[0] >= -score * 0.5 else None
    sure = 0.35 * min(1, len(does) / 4) + 0.45 * min(1, len(pays) / 3) + (0.2 if own else 0.05) + (0 if directory is None else 0.1 if directory == top else -0.1) - (0.15 if other else 0)
    return top, other, sub(top), max(0.1, min(0.95, sure)), "explicit" if own and pays else "inferred", None


def test_classes_equal_the_plain_reading(spark):
    rows = [(i, rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))]), rng.choice([True, True, True, False, None]), rng.choice([True, False, None]), rng.choice(LISTS)) for i in range(500)]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i long, t string, resolved boolean, own boolean, listed string").select("i", K.company_class(F.col("t"), F.col("resolved"), F.col("own"), F.col("listed"), SIGNALS).alias("c")).collect()}
    for i, *row in rows:
        want = plain(*row)
        assert tuple(got[i])[:3] == want[:3] and tuple(got[i])[4:] == want[4:] and abs(got[i]["confidence"] - want[3]) <= 0.0051, row
    assert {g["basis"] for g in got.values()} == {"explicit", "inferred"} and sum(g["secondary"] is not None for g in got.values()) > 20
