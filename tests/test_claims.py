"""Traction claims against a plain reading, sentence by sentence."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from gleaner.functions import claims as C

rng = random.Random(28)
BITS = [
    "Before Grade, we built, scaled, and exited 4 mobile AI apps.", "Creators were our main growth channel, and they helped us reach millions of users.", "Today we handle payouts for 40 customers", "Our CEO, Sam Oberly, ran a pilot with two hospitals.",
    "In the last 30 days, companies used Grade to pay out $380k+ to creators, up 120% MoM", "We like blue.", "At my last company, I managed $10M+ in contractor payouts!", "Ana Diaz Luna integrated payments for ten departments of GEICO.",
    "Acme (x) is deployed at twelve hospitals across Ohio.", "users", "Prior to starting this we had 5 million users in Ohio and beyond.", "The founder Luna signed contracts with nine clinics last spring.", "ÉGrade has customers in nine countries already.",
    "revenue grew to $3.5 million in a year of steady work", "They were acquired by Foo. Our customers are happy with the new product.", "x" * 400 + " customers", "a.b.customers of ours like what they see.c", "we (now) have 12 letters of intent from banks",
]


def plain(text, section, company, founders):
    now = lambda p: re.compile(p, re.ASCII)
    out, prior_story = [], False
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", text or "")):
        if not s:
            continue
        named = bool(company) and re.search(r"(?i)\b" + re.escape(company) + r"\b", s, re.ASCII)
        if named or now(C.SPEAKS_NOW).search(s):
            prior_story = False
        office = now(C.OFFICE).search(s)
        parts = [[p for p in n.split() if len(p) > 2] for n in founders]
        person = any(n in s or (len(p) > 1 and p[-1] in s and office) for n, p in zip(founders, parts, strict=True))
        if person or any(now(p).search(s) for p in C.PRIOR_COMPANY):
            prior_story = True
        for m in now(rf"(?i)[^.!?\n]*(?:{C.TRACTION_CUE})[^.!?\n]*[.!?\n]?").finditer(s):
            q = re.sub(r"\s+", " ", m[0].strip())
            if 25 <= len(q) <= 320:
                effective = section if section == "founder-bio" else "prior-company" if prior_story else section
                out.append((q, effective, effective in C.OWN_SECTIONS))
    return out


def _texts(n):
    yield from (None, "", " \n ", "no claims at all here")
    for _ in range(n):
        yield "".join(rng.choice(BITS) + rng.choice([" ", "\n", "  \n", ". "]) for _ in range(rng.randint(1, 12)))


def test_claims_equal_the_plain_reading(spark):
    rows = [(i, t, rng.choice([None, "Grade", "Acme (x)", ""]), rng.choice([None, [], ["Sam Oberly", "Ana Diaz Luna"]])) for i, t in enumerate(_texts(150))]
    df = spark.createDataFrame(rows, "id long, t string, company string, founders array<string>")
    for section in ("launch-post", "founder-bio"):
        got = {r["id"]: [tuple(c) for c in r["c"]] for r in df.select("id", C.claims(F.col("t"), section, F.coalesce("company", F.lit("")), F.coalesce("founders", F.array().cast("array<string>"))).alias("c")).collect()}
        assert got == {i: plain(t, section, c, f or []) for i, t, c, f in rows}
    assert {c[1] for v in got.values() for c in v} == {"founder-bio"}


def test_the_cautious_reading_of_a_repeated_sentence_wins(spark):
    rows = [(1, BITS[4] + "\n" + BITS[0] + "\n" + BITS[4], BITS[4], None), (2, BITS[4], BITS[4].upper() + "!", "x"), (3, None, None, None), (4, BITS[2], BITS[2], None)]
    pages = spark.createDataFrame([(k, a, b, n, ["Sam Oberly"], 1) for k, a, b, n in rows], "id long, post string, about string, name string, people array<string>, place int")
    found = C.claims_of(pages, "id", {"launch-post": "post", "description": "about"}, "name", "people").collect()
    got = {(r["id"], re.sub("[^a-z0-9]+", " ", r["quote"].lower()).strip()): (r["place"], r["section"]) for r in found}
    claim = lambda b: re.sub("[^a-z0-9]+", " ", b.lower()).strip()
    assert got == {(1, claim(BITS[4])): (0, "prior-company"), (2, claim(BITS[4])): (0, "launch-post"), (4, claim(BITS[2])): (0, "launch-post")}
    assert C.claims_of(pages.limit(0), "id", {"launch-post": "post"}, "name", "people").collect() == []


def test_a_long_text_without_marks_is_linear(spark):
    text = "customers say so. " + "word " * 200_000 + "a.b." + "word " * 100_000
    df = spark.createDataFrame([(1, text)], "id long, t string")
    assert df.select(F.size(C.claims(F.col("t"), "description", F.lit(""), F.array().cast("array<string>"))).alias("n")).first()["n"] == 0


def test_names_are_sought_once_a_text_and_patterns_where_they_can_match(spark):
    founders = ["Ann Smith5", "Bob Smith7", "Solo"]
    text = " ".join(f"This is sentence {i} of a long text on nothing." for i in range(500)) + " Our CEO Smith7 left. AΣ B is here."
    frame = spark.createDataFrame([(text, "AΣ B", founders)], "text string, company string, founders array<string>")
    got = frame.select(C.narrative(C.told_sentences(F.col("text")), F.col("company"), F.col("founders"))).first()[0]
    assert got == [False] * 500 + [True, False]
