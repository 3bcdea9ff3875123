"""Boundaries of rules beside accented letters, and issuers of any number."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import classify, entities, funding, names, quality, sectors
from gleaner.functions.rules import java, literal_of
from gleaner.operators import filters, qualification

TABLES = {
    "sectors": [p for strong, weak in sectors.SECTOR_RULES.values() for p in strong + weak],
    "stages": [p for _, p in classify.STATED_STAGES],
    "roles": [p for _, p in classify.SINGULAR_ROLES],
    "injections": [p for _, p in classify.INJECTION_FLAGS] + [classify.SECRET],
    "non-companies": [p for _, p in entities.NON_COMPANY],
    "fund names": [p for _, p in entities.FUND_NAMES],
    "traction": [p for _, p in entities.TRACTION] + [entities.DESCRIPTOR],
    "disqualifiers": [p for _, p in funding.DISQUALIFIERS],
    "funding": [funding.RAISE, funding.RAISE_NO_AMOUNT, funding.ROUND, funding.HEADQUARTERS, funding.EQUITY_LANGUAGE, funding.FINANCING_LANGUAGE, funding.DESCRIPTOR_TAIL, funding.DESCRIPTOR_HEAD, funding.CLAUSE_WORD, funding.LEGAL_SUFFIX, funding.NEXT_CLAUSE],
    "quality": [p for _, _, p in quality.SIGNALS],
    "eligibility": [p for rules in (filters.EXCLUDED_BUSINESS, filters.MATURE_STAGE, filters.INACTIVE) for _, p in rules],
    "aliases": list(names.ALIASES),
}


def _samples(pattern):
    """Texts with the pattern's own words beside accented letters, other marks and nothing."""
    words = re.findall(r"[A-Za-z]{2,}(?:[ -][A-Za-z]{2,})*", re.sub(r"\\[a-zA-Z]|\(\?[a-z]+\)|[?+*^$]", lambda m: " " if m[0] == r"\s" else "", pattern))[:12]
    return [f"{a}{w} 12 {x}{b}" for w in words for x in (w, "of fund II LLC") for a, b in (("", ""), ("É", ""), ("", "é"), ("ß ", " Ü"), ("_", "1"))]


@pytest.mark.parametrize("table", TABLES)
def test_boundaries_are_those_of_ascii_words(spark, table):
    patterns = TABLES[table]
    texts = sorted({t for p in patterns for t in _samples(p)})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array(*(F.col("t").rlike(java(p)) for p in patterns)).alias("hits"), F.lower("t").alias("low")).collect()
    beside = 0
    for r in rows:
        for p, hit in zip(patterns, r["hits"], strict=True):
            assert hit == bool(re.search(p.replace(r"\z", r"\Z"), r["t"], re.ASCII)), (p, r["t"])
            assert not hit or literal_of(p) in r["low"]
            beside += hit != bool(re.search(p.replace(r"\z", r"\Z"), r["t"]))
    assert beside > 0 or table in ("aliases", "funding", "traction", "roles", "injections")


def test_project_numbers_of_any_length(spark):
    rows = [(k, f"Solar Project {k} LLC") for k in (1, 7, 999, 1000, 1005, 123456)] + [(0, "Solar LLC"), (-1, "Wind LC"), (-2, "Storage XIV, LLC")]
    found = spark.createDataFrame(rows, "k long, name string").select("k", qualification.name_problem(F.col("name")).alias("kind")).collect()
    assert {r["k"]: r["kind"] for r in found} == {1: "spv", 7: "spv", 999: "spv", 1000: None, 1005: None, 123456: None, 0: None, -1: None, -2: "spv"}


def test_sectors_beside_accents(spark):
    texts = {"AIÊ!! for hiring LLM": ("fow", 7), "AI for hiring LLM": ("fow", 7), "AIX hiring": ("fow", 3), "ÉAI hiring": ("fow", 4), "": (None, 0)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", sectors.sector_of(F.col("t"))).collect()
    assert {r["t"]: (r["c"]["label"], r["c"]["score"]) for r in rows} == texts


def test_literals_that_a_match_must_hold():
    from gleaner.functions.rules import literals_of

    assert literals_of(r"(?i)\b(?:IPO|went public)\b") == ("ipo", "went public")
    assert literals_of(r"(?i)\b(?:was )?acquired by\b") == ("acquired by",)
    assert literals_of(r"(?i)\bare\s+now\b|\bnew\s+rules?\b") == ("are", "rule")
    assert literals_of(r"\ba?b*(?:x|\d)\b") == ()


def test_alternatives_are_tried_where_their_literals_are_held(spark):
    from gleaner.functions.rules import literals_of, parts_of, shown_in

    assert literals_of(r"(?i)\bF\d{3}\b")[:2] == ("f0", "f1") and literals_of(r"(?i)\$\s?\d*(?:k|m)? (?:ARR|net (?:sales|income))\b") == ("arr", "sales", "income")
    assert parts_of(r"(?i)\b(?:a|b(?:c|d)?)\s(?:e|f)") == (r"(?i)\b(?:a)\s(?:e|f)", r"(?i)\b(?:b(?:c|d)?)\s(?:e|f)")
    assert parts_of(r"(?:a|b)+c") == (r"(?:a|b)+c",) and parts_of("(?i)ab|c") == ("(?i)ab", "(?i)c")
    # Every signal of quality has literals, so that no text is searched that holds none.
    patterns = TABLES["quality"]
    assert all(literals_of(x) for p in patterns for x in parts_of(p))
    numbers = ["at F500 firms", "F50", "xF500", "grew to $12.5k ARR", "a $900 million", "$2bn", "12,000 active users", "7 paying customers", "Serving Acme", "serving acme", "IT leader", "it led", "Ph.D.", "Ex-Google", "25x faster", None, ""]
    texts = sorted({t for p in [*patterns, *TABLES["eligibility"]] for t in _samples(p)}) + numbers
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    pairs = rows.select("t", *(F.struct(F.col("t").rlike(java(p)).alias("plain"), shown_in(F.col("t"), F.col("low"), p).alias("held")).alias(f"p{k}") for k, p in enumerate(patterns + TABLES["eligibility"]))).collect()
    assert all(x["plain"] == x["held"] for r in pairs for x in r[1:])
    assert sum(bool(x["held"]) for r in pairs for x in r[1:]) > 300
