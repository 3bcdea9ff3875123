"""People, places, descriptions and financings that a page's text states, each with the words it was read from."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import shortened, title_case
from .places import CITY_STATES, STATE_CODES, state_code
from .rules import collapsed, java, lookup, matches, once, trimmed
from .site_evidence import telling_words
from .urls import readable_text

# Titles of founders and officers, words that make a title another's, and words that no person's name has.
TITLES = (
    "co-founder & ceo", "co-founder and ceo", "cofounder & ceo", "cofounder and ceo", "founder & ceo", "founder and ceo", "founder, ceo", "founder & cto", "founder and cto", "co-founder & cto", "co-founder and cto", "founder & coo",
    "co-founder & coo", "co-founder", "cofounder", "founding partner", "founding engineer", "founder", "chief executive officer", "chief technology officer", "chief operating officer", "chief scientific officer",
    "chief medical officer", "chief financial officer", "chief product officer", "managing director", "president", "ceo", "cto", "coo", "cso", "cmo", "cfo",
)
# Of these every title holds one.
TITLE_WORDS = ("found", "chief", "director", "president", "ceo", "cto", "coo", "cso", "cmo", "cfo")
OTHER_TITLES = ("advisor", "adviser", "board member", "board observer", "investor", "mentor", "intern", "contractor", "consultant", "emeritus", "former", "ex-", "alumni")
NOT_NAMES = (
    "our", "team", "about", "us", "the", "and", "meet", "leadership", "contact", "careers", "privacy", "policy", "terms", "service", "cookie", "learn", "more", "read", "get", "started", "sign", "up", "log", "in", "home", "blog",
    "news", "press", "company", "product", "products", "platform", "solutions", "pricing", "features", "resources", "support", "help", "docs", "documentation", "api", "inc", "llc", "ltd", "corp", "all", "rights", "reserved",
    "copyright", "follow", "subscribe", "newsletter", "view", "see", "join", "book", "demo", "request", "schedule", "talk", "sales", "new", "york", "san", "francisco", "los", "angeles", "united", "states", "america",
    "founder", "founders", "cofounder", "co-founder", "officer", "chief", "president", "ceo", "cto", "coo", "cfo", "cmo", "cso", "director", "manager", "head", "vp", "partner", "position", "categories", "category", "role",
    "title", "bio", "biography", "advisor", "board", "staff", "people", "executive", "management", "officers", "co", "lp", "plc", "gmbh", "corporation", "ventures", "venture", "capital", "partners", "holdings", "studios",
    "systems", "labs", "lab", "technologies", "technology", "industries", "enterprises", "associates", "agency", "foundation", "institute", "university", "college", "school", "startup", "startups",
)
PARTICLES = ("van", "von", "de", "del", "della", "da", "di", "du", "la", "le", "bin", "ibn", "al", "el", "mac", "mc", "st")
# Cues of places and of money raised, what a sentence with money speaks of instead, and lines that are no description.
PLACE_CUE = r"(?:head[- ]?quarter(?:ed|s)?(?:\s+in)?|based\s+in|located\s+in|offices?\s+in|hq(?:\s+in)?)"
# Of these every cue of a place holds one.
PLACE_WORDS = ("quarter", "based", "located", "office", "hq")
RAISING = r"(?:rais(?:e[sd]?|ing)|secur(?:e[sd]|ing)|clos(?:e[sd]|ing)|land(?:e[sd]|ing)|nett(?:e[sd])|announc(?:e[sd]|ing)\s+(?:a|an|its))"
MONEY = r"\$\s?\d[\d.,]*\s*(?:million|billion|[MBK])\b"
NOT_RAISED = (
    r"(?i)\bannually\b", r"(?i)\ba year\b", r"(?i)\bmarket\b", r"\bTAM\b", r"(?i)\bindustry\b", r"(?i)\bcontracts?\b", r"(?i)\brevenue\b", r"\bARR\b", r"(?i)\bsaves?\b", r"(?i)\bsavings\b", r"(?i)\bspend(?:ing|s)?\b", r"(?i)\bcosts?\b",
    r"(?i)\bvalu(?:ation|ed)\b", r"(?i)\bassets under management\b", r"(?i)\bAUM\b", r"(?i)\bfund\s+(?:size|of)\b", r"(?i)\bmanages?\b", r"(?i)\bportfolio of\b", r"(?i)\bworth\b", r"(?i)\bdeal size\b",
)
ROUND_NAME = r"(?i)\b(pre-?seed|seed|series\s+[a-e](?:-\d)?|bridge|growth|strategic)\b"
BOILERPLATE = r"(?i)cookie|privacy policy|terms of service|all rights reserved|sign in|log in|subscribe"

_CAPITAL = r"[A-Z\x{00C0}-\x{024F}]"
# What follows a word of a name is never of that word's characters, so words are taken whole or not at all.
_NAME = rf"{_CAPITAL}[\w'’.-]++(?:\s++{_CAPITAL}[\w'’.-]++){{1,3}}"
_TITLE = "|".join(re.sub(r"[-\s&]", lambda _: r"[-\s&]+", t) for t in sorted(TITLES, key=lambda t: -len(t)))
# With letters of either case, a name that begins within a word begins with it too; words of plain letters are tried once.
NAME_THEN_TITLE = rf"(?i)(?:(?<!{_CAPITAL})|(?![A-Z]))({_NAME})(?:\s*[,–—|·:]\s*|\s+[-–—]\s+)((?:{_TITLE})[^.;|\n]{{0,40}}?)(?=\s+{_CAPITAL}|[.;|\n]|\z)"
# What a name and its title have between them, and the title: far quicker to look for than the name before.
MARK_THEN_TITLE = rf"(?i)(?:[,–—|·:]\s*|\s[-–—]\s+)(?:{_TITLE})"
TITLE_THEN_NAME = rf"\b((?:{_TITLE})(?:\s+(?:and|&)\s+\w+)?)\s*[,:]?\s+({_NAME})"
AROUND = 60
_PERSON = "array<struct<full_name:string,title:string,support:string>>"


def is_founder_title(title: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"\s+", " "), r"[.,;]+\z", ""))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    return ~holds(OTHER_TITLES) & holds(TITLES)


def is_person(name: Column) -> Column:
    """Whether a text reads as a person's name: two to four capitalised words, none of them a page's or a company's."""
    s = collapsed(name)
    tokens = F.split(s, " ")

    def fits(t: Column) -> Column:
        bare = F.regexp_replace(t, "[.,'’-]", "")
        particle = (F.array_position(tokens, t) > 1) & F.lower(bare).isin(*PARTICLES)
        heading = (F.length(bare) > 3) & (bare == F.upper(bare))
        return (bare != "") & ~F.lower(bare).isin(*NOT_NAMES) & (particle | t.rlike(rf"^{_CAPITAL}")) & ~heading

    return F.length(s).between(4, 60) & ~s.rlike(r"[0-9@/\\|<>{}()\[\]]") & F.size(tokens).between(2, 4) & F.forall(tokens, fits)


def name_at_end(run: Column) -> Column:
    """The name with which a run of capitalised words ends, the longest that reads as one; null if none does."""
    tokens = F.filter(F.split(collapsed(run), " "), lambda t: t != "")
    tail = lambda n: F.array_join(F.slice(tokens, -n, n), " ")
    return F.coalesce(*(F.when(F.size(tokens) >= n, F.when(is_person(tail(n)), tail(n))) for n in (4, 3, 2)))


def clean_title(raw: Column) -> Column:
    """A title without what the page runs on with; null for what is no founder's or officer's."""
    t = F.get(F.split(collapsed(raw), "[:•·|]"), F.lit(0))
    t = F.regexp_replace(t, java(r"(?i)\s+(?:Categories|Category|Position|Team|Leadership|About|Bio|Biography)\b.*$"), "")
    t = trimmed(F.regexp_replace(t, r"[,;\-–—\s]+\z", ""))
    return F.when(F.length(t).between(2, 80) & is_founder_title(t), t)


def _found(text: Column, pattern: str, name: int, title: int) -> Column:
    """Matches of a pattern with the text around them."""
    p = java(pattern)

    def persons(whole: Column) -> Column:
        # A match is what it is without the text around it, so names and titles are read from matches.
        both = F.arrays_zip(F.split(text, p, -1).alias("between"), whole.alias("whole"))

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.length(x["between"])
            part = lambda k: F.regexp_extract(x["whole"], p, k)
            person = F.struct(name_at_end(part(name)).alias("full_name"), clean_title(part(title)).alias("title"), shortened(F.substring(text, F.greatest(at - AROUND, F.lit(0)) + 1, F.least(at, F.lit(AROUND)) + F.length(x["whole"]) + AROUND)).alias("support"))
            return F.struct((at + F.length(x["whole"])).alias("at"), F.when(x["whole"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(person))).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(_PERSON).alias("out"))
        found = F.filter(F.aggregate(both, start, step, lambda acc: acc["out"]), lambda p: p["full_name"].isNotNull() & p["title"].isNotNull())
        return F.when(F.size(whole) == 0, F.array().cast(_PERSON)).otherwise(found)

    return once(F.regexp_extract_all(text, F.lit(p), F.lit(0)), persons)


def people(text: Column, most: int = 8) -> Column:
    """array<struct<full_name, title, support>>: those whom a readable text names with a founder's or officer's title.

    Names before titles are read first, then titles before names; each name
    counts once, at its first mention.
    """

    def first_each(every: Column) -> Column:
        keys = F.transform(every, lambda p: F.lower(p["full_name"]))
        return F.slice(F.filter(every, lambda p, i: F.array_position(keys, F.lower(p["full_name"])) == i + 1), 1, most)

    before = F.when(text.rlike(MARK_THEN_TITLE), _found(text, NAME_THEN_TITLE, 1, 2)).otherwise(F.array().cast(_PERSON))
    found = once(F.concat(before, _found(text, TITLE_THEN_NAME, 2, 1)), first_each)
    # Most texts hold no title, and looking for one's words is far quicker than matching around it.
    titled = once(F.lower(text), lambda low: reduce(or_, (low.contains(w) for w in TITLE_WORDS)))
    return F.when(titled, found).when(text.isNotNull(), F.array().cast(_PERSON))


def location(text: Column) -> Column:
    """struct<city, state, evidence>: where a text says that a company is, by a cue with a state, an address, or a city that tells its state."""
    clean = F.regexp_replace(text, r"(?U)\s+", " ")
    part = lambda p, k: F.regexp_extract(clean, java(p), k)
    place = lambda city, state, said: F.struct(city.alias("city"), state.alias("state"), trimmed(said).alias("evidence"))
    city = r"[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,2}"
    cued, postal, based, alone = rf"(?i){PLACE_CUE}\s+({city}),\s*([A-Za-z .]{{2,20}})\b", rf"({city}),\s*([A-Z]{{2}})\s+\d{{5}}(?:-\d{{4}})?", r"(?i)\b([A-Za-z][A-Za-z .]{1,22}?)[-\s]based\b", rf"(?i){PLACE_CUE}\s+([A-Za-z][A-Za-z .]{{1,22}}?)(?:[.,;]|\s+and\b|$)"
    known = lambda p, i: lookup(F.lower(F.trim(part(p, 1))), {k: v[i] for k, v in CITY_STATES.items()})
    cue = once(F.lower(text), lambda low: reduce(or_, (low.contains(w) for w in PLACE_WORDS)))
    says_based = F.lower(text).contains("based")
    return F.coalesce(
        F.when(cue & state_code(part(cued, 2)).isNotNull(), place(title_case(collapsed(part(cued, 1))), state_code(part(cued, 2)), part(cued, 0))),
        F.when(clean.rlike(r"[A-Z]{2} [0-9]{5}") & part(postal, 2).isin(*STATE_CODES.values()), place(title_case(collapsed(part(postal, 1))), part(postal, 2), part(postal, 0))),
        F.when(says_based & known(based, 0).isNotNull(), place(known(based, 0), known(based, 1), part(based, 0))),
        F.when(cue & known(alone, 0).isNotNull(), place(known(alone, 0), known(alone, 1), part(alone, 0))),
    )


def description(text: Column, name: Column) -> Column:
    """The first sentence that says what a company is: six to 45 words, no boilerplate, and more than the name."""
    clean = collapsed(text)
    stem = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")

    def tells(s: Column) -> Column:
        letters = F.regexp_replace(F.lower(s), "[^a-z0-9]", "")
        rest = F.length(letters) - F.when(F.contains(letters, stem), F.length(stem)).otherwise(0)
        # White space is single spaces by then.
        return F.size(F.split(F.trim(s), " ")).between(6, 45) & (F.length(F.trim(s)) <= 300) & ~s.rlike(BOILERPLATE) & (rest >= 30)

    return F.when(F.length(clean) >= 40, F.trim(F.get(F.filter(F.split(clean, r"(?<=[.!?])\s+"), tells), F.lit(0))))


def raised(text: Column, name: Column) -> Column:
    """struct<amount_text, round_type, evidence> of the first sentence that names the company beside money it raised."""
    words = telling_words(name)
    forward, backward = rf"(?i){RAISING}[^.]{{0,40}}?({MONEY})", rf"(?i)({MONEY})[^.]{{0,30}}?{RAISING}"
    other = lambda s: F.exists(F.array(*(matches(s, p) for p in NOT_RAISED)), lambda x: x)
    says = lambda s: (F.length(s) <= 400) & (matches(s, forward) | matches(s, backward)) & F.exists(words, lambda w: F.contains(F.lower(s), w)) & ~other(s)

    def fact(s: Column) -> Column:
        money = F.when(matches(s, forward), F.regexp_extract(s, java(forward), 1)).otherwise(F.regexp_extract(s, java(backward), 1))
        for p, r in ((r"(?i)\s*million\b", "M"), (r"(?i)\s*billion\b", "B"), (r"\$\s+", r"\$")):
            money = F.regexp_replace(money, java(p), r) if p[0] == "(" else F.regexp_replace(collapsed(money), p, r)
        found = F.regexp_extract(s, java(ROUND_NAME), 1)
        kind = F.when(found != "", title_case(collapsed(found)))
        return F.struct(F.concat_ws(" ", money, kind).alias("amount_text"), kind.alias("round_type"), F.substring(trimmed(s), 1, 240).alias("evidence"))

    first = F.get(F.filter(F.split(F.regexp_replace(text, r"(?U)\s+", " "), r"(?<=[.!?])\s+"), says), F.lit(0))
    return once(first, lambda s: F.when(s.isNotNull(), fact(s)))


def facts_of(pages: DataFrame, key: str, name: str, html: str = "html") -> DataFrame:
    """``key`` with people, location, description and financing of each page's readable text; null pages tell nothing."""
    read = pages.withColumn("_text", readable_text(F.coalesce(html, F.lit(""))))
    company = F.coalesce(F.col(name), F.lit(""))
    return read.select(key, people(F.col("_text")).alias("people"), location(F.col("_text")).alias("location"), description(F.col("_text"), company).alias("description"), raised(F.col("_text"), company).alias("financing"))
