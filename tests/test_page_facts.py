"""Facts of pages against a plain reading."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from gleaner.functions import page_facts as P
from gleaner.functions.places import CITY_STATES, STATE_CODES

rng = random.Random(22)
CAP = "[A-ZÀ-ɏ]"


def _py(p):
    return p.replace(r"\x{00C0}-\x{024F}", "À-ɏ").replace(r"\z", r"\Z")


def plain_person(s):
    s = " ".join(s.split())
    tokens = s.split(" ")
    if not 4 <= len(s) <= 60 or re.search(r"[0-9@/\\|<>{}()\[\]]", s) or not 2 <= len(tokens) <= 4:
        return False
    for t in tokens:
        bare = re.sub("[.,'’-]", "", t)
        if not bare or bare.lower() in P.NOT_NAMES:
            return False
        if not (tokens.index(t) > 0 and bare.lower() in P.PARTICLES) and not re.match(CAP, t):
            return False
        if len(bare) > 3 and bare == bare.upper():
            return False
    return True


def plain_title(raw):
    t = re.split("[:•·|]", " ".join(raw.split()))[0]
    t = re.sub(r"(?i)\s+(?:Categories|Category|Position|Team|Leadership|About|Bio|Biography)\b.*$", "", t, flags=re.ASCII)
    t = re.sub(r"[,;\-–—\s]+\Z", "", t).strip()
    low = re.sub(r"[.,;]+\Z", "", t.lower()).strip()
    return t if 2 <= len(t) <= 80 and not any(w in low for w in P.OTHER_TITLES) and any(w in low for w in P.TITLES) else None


def plain_people(text):
    found = {}
    for p, n, k in ((P.NAME_THEN_TITLE, 1, 2), (P.TITLE_THEN_NAME, 2, 1)):
        for m in re.finditer(_py(p), text, re.ASCII):
            tokens = m[n].split()
            name = next((" ".join(tokens[-size:]) for size in (4, 3, 2) if len(tokens) >= size and plain_person(" ".join(tokens[-size:]))), None)
            title = plain_title(m[k])
            if name and title and name.lower() not in found:
                s = " ".join(text[max(0, m.start() - 60) : m.end() + 60].split())
                found[name.lower()] = (name, title, s if len(s) <= 280 else s[:279] + "…")
    return list(found.values())[:8]


BITS = [
    "Jane Okonkwo, Co-Founder & CEO", "Priya Raman — Chief Technology Officer Categories: Leadership", "Founder and CEO José Díaz de la Cruz joined", "Aidan Ng Co-Founder", "Meet Our Team: Sam Lee - Founder", "Advisor to the Founder Bob Ray", "JOHN SMITH, CEO",
    "Alex Fisher | President.", "the ceo Maria Silva said", "President Ann Lee", "Walt Disney Studios Co, Founder", "and nothing else at all", "Éva Nagy: Managing Director of Acme;", "x" * 80, "Cto Kim Park Jr, cofounder", "Jane Okonkwo, Founder.",
]


def test_people_equal_the_plain_reading(spark):
    texts = ["", *BITS] + [" ".join(rng.choice(BITS) for _ in range(rng.randint(2, 12))) for _ in range(150)]
    got = {r["t"]: [tuple(p) for p in r["p"]] for r in spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string").select("t", P.people(F.col("t")).alias("p")).collect()}
    for t in texts:
        assert got[t] == plain_people(t), t
    assert max(map(len, got.values())) == 8 or sum(map(len, got.values())) > 100


def test_places_and_financings(spark):
    cases = {
        "We are headquartered in Austin, Texas and more": ("Austin", "TX"), "located in Salem, or": ("Salem", "OR"), "located in Salem, or. Nothing": None, "Visit 1 Main St, San Jose, CA 95110 today": ("San Jose", "CA"), "Boston-based firm": ("Boston", "MA"), "a Boston-based firm": None, "offices in nyc and Rome": ("New York", "NY"),
        "based in Barcelona, Spain": None, "nothing": None, "": None, "HQ in palo alto": ("Palo Alto", "CA"), "Foo, ZZ 12345": None,
    }
    got = {r["t"]: r["p"] and tuple(r["p"])[:2] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", P.location(F.col("t")).alias("p")).collect()}
    assert got == cases and set(CITY_STATES.values()) and len(STATE_CODES) == 51
    raised = {
        "Acme Robotics raised $ 12.5 million Series A. More.": ("$12.5M Series A", "Series A"), "Other raised $5M. Robotics closed $7 billion in all.": ("$7B", None), "Acme Robotics saves $5M a year and raised $2M.": None, "In May $3M was raised by acme for seed": ("$3M Seed", "Seed"),
        "They raised $4M.": None, "": None, "Acme raised €4M.": None, "Acme has grown. The market is worth $9B. Acme secured a $9M bridge round!": ("$9M Bridge", "Bridge"),
    }
    got = {r["t"]: r["p"] and tuple(r["p"])[:2] for r in spark.createDataFrame([(t,) for t in raised], "t string").select("t", P.raised(F.col("t"), F.lit("Acme Robotics, Inc.")).alias("p")).collect()}
    assert got == raised
    none = spark.createDataFrame([("Acme raised $5M.",)], "t string").select(P.raised(F.col("t"), F.lit("The Co")).alias("p")).first()["p"]
    assert none is None


def test_descriptions_and_pages(spark):
    said = {
        "Home. Sign in. Acme Robotics builds arms that pack boxes in warehouses. More of the same sort of thing here.": "Acme Robotics builds arms that pack boxes in warehouses.",
        "We use cookies on this site to make it better for you and others. Short one.": None, "": None, "Acme. " * 20: None, ("word " * 50).strip() + ". And this is then a line that says something useful.": "And this is then a line that says something useful.",
    }
    got = {r["t"]: r["d"] for r in spark.createDataFrame([(t,) for t in said], "t string").select("t", P.description(F.col("t"), F.lit("Acme")).alias("d")).collect()}
    assert got == said
    pages = spark.createDataFrame([(1, "<p>Jane Okonkwo, Founder.</p><p>Acme is based in Austin, TX and packs boxes.</p>", "Acme"), (2, None, None), (3, "", "Acme")], "id long, html string, name string")
    rows = {r["id"]: r for r in P.facts_of(pages, "id", "name").collect()}
    assert rows[1]["people"][0]["full_name"] == "Jane Okonkwo" and rows[1]["location"]["state"] == "TX" and rows[2]["people"] == [] == rows[3]["people"] and rows[2]["location"] is None


def test_a_long_word_costs_its_length(spark):
    text = "x" * 100_000 + "; Ann Lee, CEO. Rob3rt Ray Éa Bé - Founder"
    start = time.monotonic()
    got = spark.createDataFrame([(text,)], "text string").select(P.people(F.col("text"))).first()[0]
    assert [(p["full_name"], p["title"]) for p in got] == [("Ann Lee", "CEO")]
    assert time.monotonic() - start < 10
