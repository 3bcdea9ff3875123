"""Profiles against a plain reading, part by part."""

from __future__ import annotations

import html as H
import random
import re

from gleaner.functions import profiles as P
from gleaner.functions.page_facts import OTHER_TITLES, TITLES

rng = random.Random(18)


def strip(s):
    return " ".join(H.unescape(re.sub("<[^>]*>", " ", s)).split())


def of_class(s, needle):
    return [t for m in re.finditer(rf'(?is)<(\w+)[^>]*class="[^"]*{needle}[^"]*"[^>]*>(.*?)</\1>', s) if (t := strip(m[2]))]


def meta(s, label):
    m = re.search(rf"(?is){label}\s*:?\s*</[^>]+>(.{{0,300}}?)</div>", s)
    if m and strip(m[1]):
        return strip(m[1])
    m = re.search(rf"{label}\s*:\s*([^:]{{1,60}}?)(?=\s{{2,}}|\s+[A-Z][a-z]+\s*:|$)", strip(s))
    return m[1].strip() if m else None


def lined(s):
    s = re.sub(r"(?i)<\s*/?\s*(?:div|p|li|ul|ol|br|h[1-6]|section|tr|td|table|blockquote)\b[^>]*>", "\n", s)
    s = re.sub(r"https?://\S+", " ", H.unescape(re.sub("<[^>]*>", " ", s)))
    return re.sub(r"\n{2,}", "\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", s))).strip()


def plain(h):
    at = re.search(r"(?i)Active\s+Founders", h)
    section = None
    if at:
        rest = h[at.start() :]
        end = re.search(r"(?i)Company\s+Launches|Jobs at|Similar Companies|<footer", rest)
        section = rest[: end.start()] if end else rest[:40_000]
    founders = {}
    for part in re.split(r'(?i)<div[^>]*class="[^"]*text-xl font-bold[^"]*"[^>]*>', section or "")[1:]:
        name, role, bio = strip(part.split("</div>")[0]), (of_class(part, "text-gray-600") or [None])[0], (of_class(part, "whitespace-pre-line") or [None])[0]
        title = re.sub(r"[.,;]+\Z", "", " ".join((role or "").lower().split())).strip()
        if not re.match(r"[A-ZÉ][^\W\d_'’.-]*[\w'’.-]*(?:\s+[^\W\d_'’.-][\w'’.-]*){1,3}\Z", name) or not role or any(w in title for w in OTHER_TITLES) or not any(w in title for w in TITLES):
            continue
        link = re.search(r'(?i)href="(https://(?:www\.)?linkedin\.com/in/[^"]+)"', part)
        founders.setdefault(name.lower(), (name, role if len(role) <= 80 else None, bio and bio[:1200], link and link[1]))
    people = list(founders.values())
    outside = of_class(h[: at.start()] if at else h, "prose") + (of_class(h[at.start() + len(section) :], "prose") if at else [])
    launch = re.search(r"(?i)Company\s+Launches", h)
    post = None
    if launch and launch.start() > 0:
        slab = h[launch.start() : launch.start() + 12_000]
        stop = re.search(r"(?i)Similar\s+Companies|Jobs at|Active\s+Founders|<footer", slab[1:])
        post = lined(slab[: stop.start() + 1] if stop and stop.start() > 0 else slab[:6000])[:4000]
    card = re.search(r"(?i)Primary\s+Partner", h)
    links = re.findall(r'(?i)href="(https?://[^"]+)"', h[card.start() : card.start() + 4000]) if card and card.start() > 0 else []
    size, year = meta(h, "Team Size"), meta(h, "Founded")
    return (
        (of_class(h, "text-xl font-medium") or [None])[0], next((u for u in links if not re.search(P.NOT_OWN, u)), None), meta(h, "Batch"), meta(h, "Status"), meta(h, "Location"), int(size) if size and re.fullmatch(r"\d+", size) else None,
        int(year) if year and re.fullmatch(r"\d{4}", year) else None, next((t for t in outside if len(t) > 60 and t not in [p[2] for p in people]), None), post, people, list(dict.fromkeys(of_class(h, "ycdc-badge"))),
    )


PEOPLE = [("Sam Oberly", "Founder &amp; CEO"), ("Ana D&#237;az", "CTO"), ("Bob", "Founder"), ("Kim Lee", "Head of Sales"), ("Éva Nagy", "Co-Founder"), ("Jo Poe", "Advisor to the Founder")]


def page():
    bio = lambda n: f"At my last company, {n} managed $10M+ in contractor payouts for many customers &amp; friends of the house."
    cards = [f'<div class="x text-xl font-bold">{n}</div><div class="text-gray-600">{r}</div><div class="prose whitespace-pre-line">{bio(n)}</div>' + (f'<a href="https://www.linkedin.com/in/{n.split()[0]}">in</a>' if rng.random() < 0.5 else "") for n, r in rng.choices(PEOPLE, k=rng.randint(0, 4))]
    sections = [
        '<h3 class="text-xl font-medium">Grade <b>Inc</b></h3>', '<div class="prose">Grade pays creators on time, wherever they are &amp; whatever they make for others.</div>', "<h2>Active  Founders</h2>" + "".join(cards * 2), '<a class="ycdc-badge">B2B</a><a class="ycdc-badge">Fintech</a><a class="ycdc-badge">B2B</a>',
        "<h2>Company Launches</h2><p>Today we handle payouts for 40 customers in Ohio</p><h3>Traction</h3><p>companies used Grade to pay out $380k+ to creators, see https://x.y/z<br>ask</p>", "<h2>Similar Companies</h2><p>Other has 90 customers in all of Ohio</p>",
        '<div><div>Batch:</div><div>W21</div></div><div><span>Team Size:</span> <span>12</span></div><div><span>Founded</span><b>2020</b></div>', "Status: Active  Location: Austin, TX", '<div>Primary Partner</div><a href="https://www.ycombinator.com/p">p</a><a href="https://grade.example.com">site</a>', "<footer>Jobs at Grade</footer>",
    ]
    return "<html>" + "".join(rng.sample(sections, rng.randint(1, len(sections)))) + "</html>"


def test_profiles_equal_the_plain_reading(spark):
    pages = [page() for _ in range(120)] + ["", "Active Founders", "no profile " * 500]
    rows = [(i, f"https://www.ycombinator.com/companies/grade-{i}/", h, "x") for i, h in enumerate(pages)] + [(-1, "https://www.ycombinator.com/companies", page(), "x"), (-2, "https://www.ycombinator.com/companies/a", None, "x"), (-3, None, page(), "x")]
    found = P.profiles(spark.createDataFrame(rows, "id long, url string, html string, slug string"), "id").collect()
    assert sorted(r["id"] for r in found) == list(range(len(pages)))
    for r in found:
        got = (*tuple(r)[2:11], [tuple(f) for f in r["founders"]], r["tags"])
        assert r["slug"] == f"grade-{r['id']}" and got == plain(pages[r["id"]]), pages[r["id"]]
    assert sum(len(r["founders"]) for r in found) > 40 and sum(r["launch_post"] is not None for r in found) > 20


def test_claims_of_a_profile(spark):
    h = '<html><h3 class="text-xl font-medium">Grade</h3><h2>Active Founders</h2><div class="text-xl font-bold">Sam Oberly</div><div class="text-gray-600">CEO</div><div class="whitespace-pre-line">Sam signed contracts with nine clinics elsewhere.</div><h2>Company Launches</h2><p>Today we handle payouts for 40 customers</p><p>Our CEO, Sam Oberly, ran a pilot with two large hospitals</p><footer>'
    found = P.profiles(spark.createDataFrame([(1, "https://ycombinator.com/companies/grade", h)], "id long, url string, html string"), "id")
    got = {(r["quote"], r["section"], r["about_company"]) for r in P.profile_claims(found, "id").collect()}
    assert got == {("Today we handle payouts for 40 customers", "launch-post", True), ("Our CEO, Sam Oberly, ran a pilot with two large hospitals", "prior-company", False), ("Sam signed contracts with nine clinics elsewhere.", "founder-bio", False)}


def test_long_parts_are_read_whole(spark):
    long = lambda word, n: " ".join(f"{word}{k}" for k in range(n))
    person = lambda name, bio: f'<div class="text-xl font-bold">{name}</div><div class="text-gray-600">Founder</div><div class="prose whitespace-pre-line">{bio}</div>'
    bio, post, prose = long("bio", 9000), long("told", 3000), long("own", 400)
    card = '<div>Primary Partner</div><i>' + long("row", 2000) + '</i><a href="https://grade.example.com">site</a>'
    launch, others = f"<h2>Company Launches</h2><p>{post}</p>", '<h2>Similar Companies</h2><a href="https://other.example.com">o</a>'
    people = "<h2>Active Founders</h2>" + person("Ana Lee", bio) + person("Sam Oberly", "short")
    ends = "<h2>Active Founders</h2>" + person("Ana Lee", prose)
    pages = [
        f"<html>{card}{launch}{others}{people}", f"<html>{ends}{launch}", f'<html><div class="prose">{prose}</div>{ends}<footer>', f"<html><div>Primary Partner</div>{others}", f"<html>{launch}<b>{long('more', 3000)}</b><footer>gone",
    ]
    rows = [(i, f"https://www.ycombinator.com/companies/grade-{i}", h) for i, h in enumerate(pages)]
    got = {r["id"]: r for r in P.profiles(spark.createDataFrame(rows, "id long, url string, html string"), "id").collect()}
    whole = f"Company Launches\n{post}"
    assert [(f["full_name"], f["bio"]) for f in got[0]["founders"]] == [("Ana Lee", bio), ("Sam Oberly", "short")]
    assert [got[i]["launch_post"] for i in range(5)] == [whole, whole, None, None, f"{whole}\n{long('more', 3000)}"]
    assert [got[i]["website"] for i in range(5)] == ["https://grade.example.com", None, None, None, None]
    # A bio is no description, however long.
    assert got[2]["description"] is None and got[1]["founders"][0]["bio"] == prose
