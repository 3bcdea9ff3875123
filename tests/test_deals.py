"""Worked cases of headlines, names, investors, leads and verdicts."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.functions import funding as E
from gleaner.functions.names import note_body
from gleaner.operators import qualification as Q
from gleaner.sources import leads as S

TODAY = "2001-08-01"
DAY = datetime.date(2001, 7, 20)


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("subject", "name", "place"),
    [
        ("Antares", "Antares", "subject"),
        ("Inference startup Infinity", "Infinity", "after-descriptor"),
        ("AI-powered travel agency Fora hits unicorn status", "Fora", "after-descriptor"),
        ("AegisAI, founded by former Google security execs", "AegisAI", "before-comma"),
        ("As AI content floods the internet, Pangram", "Pangram", "after-comma"),
        ("Exclusive: Bluecore Energy", "Bluecore Energy", "subject"),
        ("Berlin-based Acme Robotics", "Acme Robotics", "after-descriptor"),
    ],
)
def test_names_in_subjects(spark, subject, name, place):
    got = _one(spark, E.company_of(F.col("s")), s=subject)
    assert (got["name"], got["place"], got["code"]) == (name, place, None)


@pytest.mark.parametrize(
    ("subject", "code"),
    [
        ("Edtech platform", "company-name-is-descriptor"),
        ("Travis Kalanick's robotics company", "company-name-is-person"),
        ("The company", "company-name-is-descriptor"),
        ("AI", "company-name-not-extractable"),
        ("Inc.", "company-name-not-extractable"),
        ("a small firm", "company-name-is-descriptor"),
        ("", "company-name-not-extractable"),
    ],
)
def test_subjects_without_a_name(spark, subject, code):
    assert _one(spark, E.company_of(F.col("s")), s=subject)["code"] == code


def test_investors_places_and_amounts(spark):
    text = "The round was led by Index Ventures, with participation from Sarah Guo's Conviction Partners, Slauson & Co. and existing investors. It is based in New York, NY."
    assert _one(spark, E.investors_of(F.col("s")), s=text) == ["Index Ventures", "Conviction Partners", "Slauson Co"]
    assert tuple(_one(spark, E.headquarters(F.col("s")), s=text)) == ("New York", "NY")
    assert _one(spark, E.stated_raise(F.col("s")), s="Acme raises $4.5") is None
    assert _one(spark, E.stated_raise(F.col("s")), s="Acme raises €4M")["amount"].asDict() == {"usd": None, "text": "€4M"}
    assert _one(spark, note_body(F.col("s")), s="a \r\n\r\n\r\n\r\nb\x00\x9f\t") == "a\n\nb"


def test_events_and_reasons(spark):
    rows = [
        (1, "Bluecore Energy raises $5M pre-seed", "Led by Foo Capital. Its investor closed its $100M Fund II.", "https://www.a.example.com/1", DAY, None),
        (2, "Old Firm closes $200M Fund III", "", "https://a.example.com/2", DAY, "fund-launch"),
        (3, "A new way to pay", "Fora raised $12 million today. More follows.", "https://a.example.com/3", DAY, None),
        (4, "Nothing to see", "", "https://a.example.com/4", DAY, "no-financing-language"),
        (5, "A round for someone", None, "https://a.example.com/5", DAY, "financing-not-attributed"),
        (6, "Edtech platform raises $4.5M", "", "https://a.example.com/6", DAY, "company-name-is-descriptor"),
        (7, "Fora raises $4.5M", "", "https://a.example.com/7", None, "no-announcement-date"),
        (8, "Fora raises $4.5M", "", "https://a.example.com/8", datetime.date(1999, 1, 1), "event-too-old"),
        (9, None, None, None, None, "no-financing-language"),
        (10, "Fora raises $40M debt facility and a Series B", "", "https://a.example.com/10", DAY, None),
        (11, "Fora raises $40M and acquires Foo", "", "https://a.example.com/11", DAY, None),
    ]
    frame = spark.createDataFrame([r[:5] for r in rows], "id int, title string, description string, link string, published_at date")
    events = E.funding_events(frame, F.lit(TODAY).cast("date"))
    got = {r["id"]: r for r in events.collect()}
    assert {k: r["rejection"] for k, r in got.items()} == {r[0]: r[5] for r in rows}
    assert (got[1]["company_name"], got[1]["amount_usd"], got[1]["round_type"], got[1]["investors"], got[1]["publisher"]) == ("Bluecore Energy", 5e6, "Pre-seed", ["Foo Capital"], "a.example.com")
    assert (got[3]["company_name"], got[3]["amount_text"]) == ("Fora", "$12M (as stated by a.example.com)")
    leads = S.event_leads(events, "2001-08-01T00:00:00Z").orderBy("source_url").collect()
    assert [r["company_name"] for r in leads] == ["Fora", "Fora", "Fora", "Bluecore Energy"] and leads[-1]["stage"] == "Pre-seed"


def test_landed_answers_become_leads(spark):
    now = "2001-08-01T00:00:00Z"
    companies = spark.createDataFrame(
        [
            ("Acme", "acme", None, "https://acme.example.com", "Robots for clinics", None, "S21", "Active", ["Robotics"], ["satellites"], ["San Francisco"]),
            ("Old", "old", "https://d.example.com/old", "no url", None, None, "W09", "Active", None, None, None),
            ("Odd", None, None, None, None, None, "?", None, None, None, ["London"]),
            ("Gone", "gone", None, None, None, None, "S21", "Inactive", None, None, None),
        ],
        "name string, slug string, url string, website string, oneLiner string, longDescription string, batch string, status string, industries array<string>, tags array<string>, locations array<string>",
    )
    got = {r["company_name"]: r for r in S.directory_leads(companies, now, "2015-01-01", "https://d.example.com/").collect()}
    assert set(got) == {"Acme", "Odd"}
    a = got["Acme"]
    assert (a["source_url"], a["hq_city"], a["hq_state"], a["vertical"], a["subcategory"], a["published_at"], a["accelerator"]) == ("https://d.example.com/acme", "San Francisco", "CA", "frontier", "Robotics, satellites", "2021-06-01", "Y Combinator (S21)")
    assert a["evidence_text"] == "Listed in the public YC directory, batch S21. YC categories: Robotics, satellites. YC one-liner: Robots for clinics"
    assert (got["Odd"]["source_url"], got["Odd"]["hq_city"], got["Odd"]["hq_state"], got["Odd"]["description"]) == ("https://d.example.com/?q=Odd", "London", None, None)
    papers = spark.createDataFrame([("u1", "T", "2001-01-02T00:00:00Z", [("Ann", "Acme Lab"), ("Bob", " "), ("Cy", None)])], "id string, title string, published string, authors array<struct<name string, affiliation string>>".replace("name string", "name:string").replace("affiliation string", "affiliation:string"))
    (p,) = S.paper_leads(papers, now).collect()
    assert (p["company_name"], p["founder_names"], p["published_at"]) == ("Acme Lab", ["Ann"], "2001-01-02")
    repos = spark.createDataFrame([("r", "https://h/r", None, "2001-01-02", ("Org", "Organization"), "Hi"), ("q", "https://h/q", None, "2001-01-02", ("me", "User"), None)], "name string, html_url string, description string, pushed_at string, owner struct<login:string,type:string>, readme string")
    (r,) = S.repository_leads(repos, now).collect()
    assert r["external_id"] == "Org/r" and r["evidence_text"].endswith("repository r. README: Hi")
    posts = spark.createDataFrame([("1", "N", "https://p/1", None, "Tag", 5, now, ["Ann"]), ("2", "M", "https://p/2", None, None, 0, now, None)], "id string, name string, url string, website string, tagline string, votes int, created_at string, makers array<string>")
    x, y = S.launch_leads(posts, now).orderBy("external_id").collect()
    assert x["traction_signals"] == ["5 Product Hunt upvotes"] and y["traction_signals"] == [] and y["evidence_text"] == "Launched on Product Hunt."


def test_companies_without_evidence_and_edges_of_verdicts(spark):
    companies = spark.createDataFrame(
        [(1, "Acme", "https://acme.example.com", "substantive", True, "Software for clinics", "NY", "yc", None, None), (2, "Beta", None, None, None, None, None, None, None, None), (3, "Gamma", "https://g.example.com", "thin", False, None, "??", "sec", None, None)],
        "company_id int, name string, website string, level string, verified boolean, one_liner string, state string, source_id string, tickers array<string>, forms array<string>",
    )
    evidence = spark.createDataFrame(
        [(1, "funding-news", "Paper x.example.com", "https://x.example.com/1", 2, "funding-announcement", DAY), (1, "funding-news", "X.example.com", "https://x.example.com/2", 2, "funding-announcement", DAY), (1, "funding-news", "y", "https://www.acme.example.com/p", 2, "funding-announcement", DAY), (3, "sec", "s", "https://s.example.com", 1, "form-d-filing", DAY)],
        "company_id int, source_id string, source_name string, url string, tier int, opportunity_type string, published_at date",
    )
    corr = {r["company_id"]: r for r in Q.corroborations(evidence, companies).collect()}
    assert (corr[1]["n_sources"], corr[1]["self_published"], corr[1]["only_regulatory"], corr[1]["sources"][0]["url"]) == (1, 1, False, "https://x.example.com/1")
    assert (corr[2]["n_sources"], corr[2]["newest"], corr[3]["only_regulatory"]) == (0, None, True)
    got = {r["company_id"]: r for r in Q.qualify(companies, Q.corroborations(evidence, companies), F.lit(TODAY).cast("date")).collect()}
    assert [got[k]["result"] for k in (1, 2, 3)] == ["qualified-operating-company", "company-lead-requires-corroboration", "unverified-foreign-entity"]
    assert "website-absent" in got[2]["reasons"] and "foreign-address-no-website" in got[3]["reasons"]
