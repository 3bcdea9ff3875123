"""Investors' own announcements: worked cases, and mentions against plain patterns."""

from __future__ import annotations

import random
import re
import time
from datetime import date

from pyspark.sql import functions as F

from gleaner.operators import investors as V

rng = random.Random(19)
FIRMS = [("Menlo Ventures", "menlo.example.com", ["Menlo Ventures", "Menlo"]), ("ARCH (Venture)", "arch.example.com", ["ARCH (Venture)", "ARCH", "ARC"]), ("News Arm", "news.menlo.example.com", ["News Arm"])]
TODAY = date(2001, 8, 1)


def _firms(spark):
    return spark.createDataFrame(FIRMS, "name string, domain string, aliases array<string>")


def test_the_firm_of_a_link(spark):
    links = {"https://www.menlo.example.com/a": "Menlo Ventures", "https://blog.menlo.example.com/a": "Menlo Ventures", "https://x.news.menlo.example.com/": "News Arm", "https://notmenlo.example.com/": None, "https://example.com": None, None: None, "nonsense": None}
    got = V.investor_of(spark.createDataFrame([(u, 1) for u in links], "link string, _x int"), _firms(spark)).collect()
    assert {r["link"]: r["investor"] for r in got} == links


def plain_participation(text, aliases):
    """(how, quote, span) by the rules, one after the other."""
    r = lambda p: re.compile(p, re.ASCII)
    for p in V.NAMES_COMPANY:
        if m := r(p).search(text):
            return "first-person", m[0].strip()[:160], m[1]
    long = [a for a in aliases if len(a) >= 4]
    for a in long:
        if m := r(rf"(?i)\b{re.escape(a)}['’]s\s+(?:latest\s+|newest\s+|first\s+)?investment\s+in\s+(.{{2,70}})").search(text):
            return "first-person", m[0].strip()[:160], m[1]
    for a in long:
        if m := r(rf"(?i)(.{{0,90}})\b{re.escape(a)}\b(.{{0,60}})").search(text):
            window = m[1] + a + m[2]
            if r(V.PARTICIPATION).search(window):
                return "named-as-participant", window.strip()[:160], None
    for p in V.STATES_ONLY:
        if m := r(p).search(text):
            return "first-person", m[0].strip()[:160], None
    return None


BITS = [
    "Why we invested in Acme", "we've invested in Foo Bar, Inc", "Our latest investment in Cheiron. Drug", "Menlo's first investment in Fireworks to go", "ARCH-backed Sono raises", "a round led by Menlo Ventures", "About Menlo Ventures", "ÉMenlo from", "from a friend", "we led their $12M Seed",
    "Leading Acme's seed", "welcoming Pangram to our portfolio", "ARC from here", "nothing", "joined by ARCH (Venture) and more", "we have just invested",
]


def test_participation_equals_the_rules(spark):
    texts = [" ".join(rng.sample(BITS, rng.randint(1, 4))) + rng.choice(["", ".", "\n", " x" * 60 + " Menlo " + "y " * 50]) for _ in range(200)] + BITS + ["", "word " * 2000 + "from Menlo Ventures"]
    rows = [(i, t, rng.choice(FIRMS)[2]) for i, t in enumerate(texts)]
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, "i long, t string, a array<string>").select("i", V.participation(F.col("t"), F.col("a")).alias("p")).collect()}
    for i, t, a in rows:
        assert (tuple(got[i]) if got[i] else None) == plain_participation(t, a), t
    assert len({g["how"] for g in got.values() if g}) == 2


def test_mentions_equal_one_pattern_per_alias(spark):
    names = [f"{a} {b}" for a in ("Alpha", "Beta", "Gam-ma", "Delta & Co") for b in ("Ventures", "Capital", "Labs (US)")] + ["Solo", "abc", "É"]
    texts = [" ".join(rng.choice([*names, "from", "led by", "ventures", "capital of", "Alpha", "\n", "Betaé", "word"]) for _ in range(rng.randint(0, 40))) for _ in range(120)] + ["", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    aliases = spark.createDataFrame([(n.upper(), n) for n in names], "investor string, alias string")
    want = set()
    for i, t in enumerate(texts):
        for n in names:
            if t and len(n) >= 4 and (m := re.search(rf"(?i)(.{{0,90}})\b{re.escape(n)}\b(.{{0,60}})", t, re.ASCII)):
                window = m[1] + n + m[2]
                want.add((i, n.upper(), n, window, bool(re.search(V.PARTICIPATION, window, re.ASCII))))
    for most in (100_000, 2):
        assert {tuple(r) for r in V.mentions(frame, aliases, most_broadcast=most).collect()} == want
    assert len(want) > 100 and V.mentions(frame.limit(0), aliases).collect() == [] == V.mentions(frame, aliases.limit(0)).collect()


def test_company_spans(spark):
    want = {
        "Pangram to Stop AI Slop": "Pangram", "Bespoke Labs: Building the Infrastructure": "Bespoke Labs", "Suno, the Platform": "Suno", "Cheiron. Drug discovery": "Cheiron", "TytoCare Names Adam Pellegrini": "TytoCare",
        "AI Fabrik From Inception": "AI Fabrik", "Foo - the bar": "Foo", "The Company": "The Company", "One Two Three Four Five Six": "One Two Three Four Five", "  Acme!? ": "Acme", "": "",
    }
    got = {r["s"]: r["c"] for r in spark.createDataFrame([(s,) for s in want], "s string").select("s", V.company_span(F.col("s")).alias("c")).collect()}
    assert got == want


def test_events_of_firms(spark):
    day = date(2001, 7, 4)
    cases = [
        ("Our Investment in Cheiron", "We led their $12M Seed. Drug discovery.", "https://menlo.example.com/1", day, None, "Cheiron", "Seed"),
        ("ARCH-backed SonoThera secures $17.5M Series B", None, "https://arch.example.com/2", day, None, "SonoThera", "Series B"),
        ("Acme raises $5M", "A round by others.", "https://menlo.example.com/3", day, "investor-not-participant", None, None),
        ("Acme raises $5M Series A led by Menlo Ventures", "", "https://menlo.example.com/4", day, None, "Acme", "Series A"),
        ("Acme raises $5M", "", "https://press.example.com/5", day, "investor-page-off-domain", None, None),
        ("Jane Doe joins Menlo as a Partner", "", "https://menlo.example.com/6", day, "not-a-financing-announcement", None, None),
        ("Welcoming Pangram to our portfolio", "", "https://menlo.example.com/7", day, "portfolio-listing-no-event", None, None),
        ("Welcoming Pangram to our portfolio: we led the round", "", "https://menlo.example.com/8", day, None, "Pangram", None),
        ("Why we invested in Menlo", "", "https://menlo.example.com/9", day, "fund-launch", None, None),
        ("Why we invested in Acme", "", "https://menlo.example.com/10", None, "no-announcement-date", None, None),
        ("Why we invested in Acme", "", "https://menlo.example.com/11", date(1999, 1, 1), "event-too-old", None, None),
        ("Menlo Ventures closes $200M Fund III", "", "https://menlo.example.com/12", day, "fund-launch", None, None),
        (None, None, "https://menlo.example.com/13", day, "investor-not-participant", None, None),
        ("We invested in the platform", "", "https://menlo.example.com/14", day, "company-name-is-descriptor", None, None),
    ]
    items = spark.createDataFrame([c[:4] for c in cases], "title string, description string, link string, published_at date")
    got = {r["link"]: r for r in V.investor_events(items, _firms(spark), F.lit(TODAY)).collect()}
    for _, _, link, _, code, name, round_type in cases:
        assert (got[link]["rejection"], got[link]["company_name"], got[link]["round_type"]) == (code, name, round_type), link
    first = got["https://menlo.example.com/1"]
    assert first["amount_usd"] is None and first["investors"][0] == "Menlo Ventures" and first["publisher"] == "menlo.example.com" and first["participation"] == "Our Investment in Cheiron"
    assert got["https://arch.example.com/2"]["amount_text"] == "$17.5M (as stated by ARCH (Venture))" and got["https://arch.example.com/2"]["participation"] == "ARCH-backed SonoThera secures $17.5M Series B"


def test_patterns_are_tried_where_a_text_holds_their_words(spark):
    """A long text that begins every pattern at every word, and holds none of what they must go on with."""
    text = "we led co-we have just co- our latest newest leading we are the " * 120_000
    start = time.monotonic()
    frame = spark.createDataFrame([(text, ["Menlo Ventures"]), ("We LED it", None)], "text string, aliases array<string>")
    assert [r[0] for r in frame.select(V.participation(F.col("text"), F.col("aliases"))["quote"]).collect()] == ["we led", "We LED"]
    assert time.monotonic() - start < 10
