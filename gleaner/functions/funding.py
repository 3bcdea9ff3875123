"""Financing events in headlines and openings of articles: what is stated, and why an article is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entities import possessive
from .names import company_key
from .rules import collapsed, java, matches, trimmed
from .urls import host

# Verbs that state a raise, amounts, and rounds.
RAISE_VERBS = "raises|raised|lands|landed|secures|secured|closes|closed|nabs|nabbed|banks|banked|snags|snagged|picks up|picked up|pulls in|pulled in|scores|scored|gets|got|nets|netted"
STATED_AMOUNT = r"([$€£¥])\s?([\d.,]+)\s*(k|m|b|bn|thousand|million|billion)?"
RAISE = rf"(?i)^(.{{2,70}}?)\s+(?:has\s+|have\s+|just\s+)?(?:{RAISE_VERBS})\s+(?:an?\s+|its\s+|another\s+)?(?:additional\s+)?{STATED_AMOUNT}"
RAISE_NO_AMOUNT = rf"(?i)^(.{{2,70}}?)\s+(?:has\s+|have\s+|just\s+)?(?:{RAISE_VERBS})\s+(?:an?\s+|its\s+)?(?:undisclosed\s+)?(pre-?seed|seed|series\s+[a-f])\b"
FINANCING_LANGUAGE = rf"(?i)\b(?:{RAISE_VERBS})\b|\bfunding\b|\bfinancing\b|\binvestment\b|\bround\b"
EQUITY_LANGUAGE = r"(?i)\b(?:pre-?seed|seed|series\s+[a-f]|equity\s+round|equity\s+financing|priced\s+round|valuation\s+of|post-money|led\s+by)\b"
ROUND = r"(?i)\b(pre-?seed|seed|series\s+([a-f])|bridge|angel|growth)\s*(?:round|funding|financing|investment)?\b"

# What an article is if not a company's raise; the first that matches tells.
DISQUALIFIERS = (
    ("fund-launch", r"(?i)\b(?:fund|vehicle)\s+(?:[IVXL]+|\d+)\b"),
    ("fund-launch", r"(?i)\b(?:debut|first|second|third|new|inaugural|maiden|flagship|oversubscribed)\s+(?:\$[\d.,]+\s*[kmb]\w*\s+)?fund\b"),
    ("fund-launch", r"(?i)\b(?:raises|raised|closes|closed|launches|launched|announces|unveils)\s+(?:an?\s+)?(?:\$[\d.,]+\s*(?:k|m|b|bn|million|billion)?\s+)?(?:venture|growth|seed|opportunity|evergreen|early-stage|late-stage|debt|crypto|climate|AI)?\s*fund\b"),
    ("fund-launch", r"(?i)\bfund\s+to\s+(?:back|invest|bet|double\s+down)\b"),
    ("fund-launch", r"(?i)\b(?:VC|venture\s+(?:capital|firm)|PE|private\s+equity)\s+(?:firm|fund)\b.{0,40}\b(?:closes|closed|raises|raised)\b"),
    ("public-offering", r"(?i)\b(?:initial\s+public\s+offering|IPO\b|direct\s+listing|SPAC\b|goes?\s+public|files?\s+(?:to|for)\s+(?:an?\s+)?IPO|secondary\s+offering|follow-?on\s+offering|public\s+offering\s+of|share\s+sale|stock\s+offering)\b"),
    ("debt-or-project-finance", r"(?i)\b(?:debt\s+facility|credit\s+facility|term\s+loan|revolving\s+credit|warehouse\s+facility|asset-?backed|project\s+financ\w*|bond\s+(?:sale|offering|issue)|convertible\s+note\s+facility|loan\s+from)\b"),
    ("grant-or-public-award", r"(?i)\b(?:grant\s+(?:from|of|award)|awarded\s+(?:a\s+)?\$|SBIR|STTR|NSF\s+(?:grant|award)|NIH\s+(?:grant|award)|DARPA\s+(?:contract|award)|DOE\s+(?:grant|loan|award)|EU\s+grant|Horizon\s+Europe|research\s+grant)\b"),
    ("grant-or-public-award", r"(?i)\b(?:university|universities|college)\b.{0,30}\b(?:receives?|awarded|wins?)\b"),
    ("acquisition-without-financing", r"(?i)\b(?:acquires?|acquired|acquiring|acquisition\s+of|buys?\s+\w|bought|to\s+buy|merges?\s+with|merger\s+with|takeover\s+of|snaps?\s+up)\b"),
    ("investor-or-fund-profile", r"(?i)\b(?:limited\s+partners?|LPs\b|general\s+partner|joins?\s+as\s+(?:a\s+)?partner|(?:new|next)\s+partner\s+at|our\s+(?:thesis|portfolio)|portfolio\s+construction|anchor\s+investor\s+in\s+the\s+fund)\b"),
    ("financing-rumored-or-pending", r"(?i)\b(?:in\s+talks\s+to\s+raise|reportedly\s+(?:raising|in\s+talks)|is\s+raising|are\s+raising|(?:plans|planning|seeking|looking|aiming|set)\s+to\s+raise|seeks?\s+\$|hopes\s+to\s+raise|would\s+raise|could\s+raise|nearing\s+a\s+deal)\b"),
    ("company-name-is-person", r"(?i)\b(?:raises?|raised|closes?|closed|lands?|landed|secures?|secured)\s+(?:an?\s+)?\$[\d.,]+\s*\w*\s+(?:\w+\s+){0,3}?(?:for|to\s+(?:fund|build|launch|start))\s+(?:his|her|their)\b"),
    ("market-commentary", r"(?i)\b(?:state\s+of\s+(?:venture|the\s+market)|funding\s+(?:dropped|fell|rose|slowed|rebounded|dipped|surged)|Q[1-4]\s+\d{4}\s+(?:funding|venture|data|report)|year\s+in\s+(?:review|venture)|(?:weekly|monthly)\s+(?:funding\s+)?roundup|here(?:'|’)s\s+every|deal\s+flow\s+(?:data|trends)|these\s+\d+\s+startups|list\s+of\s+startups)\b"),
)

# Words that describe a company instead of naming it, and what is no name by itself.
DESCRIPTOR_TAIL = r"(?i)\b(?:platform|startup|startups|company|companies|firm|firms|maker|makers|provider|providers|business|businesses|venture|unicorn|giant|app|tool|marketplace|service|competitor|rival|challenger|player|outfit|brand|chain|operator|developer|team)\z"
DESCRIPTOR_HEAD = r"(?i)^(?:this|that|these|those|the|a|an|another|former|ex|one|two|three|several|some|its|his|her|their|my|our|yet)\b"
DESCRIPTOR_MID = r"(?i)(?:\b(?:startup|startups|platform|company|agency|firm|app|maker|provider|marketplace|business|brand|studio|outfit|competitor|rival|challenger|spinout|spin-?off|subsidiary)\s+|[\w.]+-based\s+)"
CLAUSE_WORD = r"(?i)\b(?:and|with|after|before|amid|despite|while|says|said|plans|wants|founded|backed|led|reportedly|which|whose|that|to|from|for|of|in|on|as|its|his|her|their)\b"
BARE_ABBREVIATION = r"(?i)^(?:AI|ML|IT|US|USA|UK|EU|VC|PE|CEO|CTO|IPO|SaaS|API|GPU|LLM|B2B|B2C|HR|SEC|FDA|NHS)\z"
LEGAL_SUFFIX_ONLY = r"(?i)^(?:Inc\.?|LLC|L\.?L\.?C\.?|Ltd\.?|Limited|Corp\.?|Corporation|Co\.?|Company|LP|L\.?P\.?|PLC|GmbH|S\.?A\.?|B\.?V\.?|AB|Oy|AS|N\.?V\.?)\z"

# How investors and places are told, and codes of states.
INVESTOR_LEAD = r"(?i)\b(?:led\s+by|co-?led\s+by|backed\s+by|from\s+lead\s+investor)\s+([^.;]{2,120})"
INVESTOR_ALSO = r"(?i)\b(?:with\s+participation\s+from|joined\s+by|participation\s+by|also\s+(?:invested|participated)[^,.]*?:?)\s+([^.;]{2,160})"
NEXT_CLAUSE = r"(?i)\bwith\s+participation\s+from\b|\bjoined\s+by\b|\balongside\b|\bwith\s+support\s+from\b"
LEGAL_SUFFIX = r"(?i)\s*(?:,|&|\band\b)\s*(Co|Co\.|Company|Inc|Inc\.|LLC|Ltd|LP|Partners|Capital|Ventures)\b"
NOT_AN_INVESTOR = r"(?i)^(?:a|an|the|its|their|new|existing|several|multiple|other|various|angel|strategic)?\s*(?:investors?|backers?|funds?|firms?|others?)\z"
HEADQUARTERS = r"\b(?:based\s+in|headquartered\s+in|out\s+of)\s+([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,2})(?:\s*,\s*([A-Z]{2})\b)?"
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
)
MOST_AGE_DAYS = 365
#: Characters of a body in which a publisher says what the article is about; reading no more is the rule.
OPENING = 600


def stated_amount(digits: Column, unit: Column, symbol: Column) -> Column:
    """struct<usd, text> of an amount as written; null for none, and for a small number without a unit.

    Only dollars count as dollars; other currencies keep their text.
    """
    plain = F.regexp_replace(digits, ",", "")
    base = F.when(plain.rlike(r"^(?:\d+\.?\d*|\.\d+)\z"), plain).cast("double")
    key = F.lower(F.substring(unit, 1, 1))
    times = F.when(key.isin("k", "t"), 1e3).when(key == "m", 1e6).when(key == "b", 1e9).otherwise(1.0)
    usd = F.when(symbol == "$", F.floor(base * times + 0.5).cast("double"))
    ok = (base > 0) & ((times > 1) | (base >= 1000))
    return F.when(ok, F.struct(usd.alias("usd"), F.concat(symbol, digits, F.upper(key)).alias("text")))


def _amount_of(text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, java(RAISE), k)
    return F.when(text.rlike(java(RAISE)), stated_amount(part(3), part(4), part(2)))


_RAISE = "struct<subject:string,amount:struct<usd:double,text:string>>"


def stated_raise(text: Column) -> Column:
    """struct<subject, amount> of "<subject> raises <amount or round>"; null if the text says no such thing."""
    amount = _amount_of(text)
    with_amount = F.struct(F.regexp_extract(text, java(RAISE), 1).alias("subject"), amount.alias("amount")).cast(_RAISE)
    without = F.struct(F.regexp_extract(text, java(RAISE_NO_AMOUNT), 1).alias("subject"), F.lit(None).alias("amount")).cast(_RAISE)
    return F.when(amount.isNotNull(), with_amount).when(text.rlike(java(RAISE_NO_AMOUNT)), without)


def disqualified(scope: Column, has_equity: Column, has_subject: Column, skip: tuple[str, ...] = ()) -> Column:
    """The code of the first rule that makes a text no raise; debt beside equity and deals of a named raiser are none.

    Rules of the codes in ``skip`` don't apply.
    """
    spared = {"debt-or-project-finance": has_equity, "acquisition-without-financing": has_subject}
    return F.coalesce(*(F.when(matches(scope, p) & ~spared.get(code, F.lit(False)), F.lit(code)) for code, p in DISQUALIFIERS if code not in skip))


def round_of(text: Column) -> Column:
    raw = F.lower(F.regexp_extract(text, java(ROUND), 1))
    return F.when(raw == "", None).when(raw.startswith("pre"), "Pre-seed").when(raw.startswith("series"), F.concat(F.lit("Series "), F.upper(F.regexp_extract(text, java(ROUND), 2)))).otherwise(F.initcap(raw))


def investors_of(text: Column, most: int = 8) -> Column:
    """Investors where they are named: leads first, then others."""

    def named(pattern: str) -> Column:
        said = F.get(F.split(collapsed(F.regexp_extract(text, java(pattern), 1)), java(NEXT_CLAUSE)), F.lit(0))
        said = F.regexp_replace(said, java(r"\b[A-Z][\w.-]*(?:\s+[A-Z][\w.-]*)?[’']s\s+"), "")
        parts = F.split(F.regexp_replace(said, java(LEGAL_SUFFIX), " $1"), r",\s*|\s+and\s+|\s*&\s*")
        parts = F.transform(parts, lambda p: trimmed(F.regexp_replace(trimmed(F.regexp_replace(p, r"(?i)^(?:existing\s+investors?\s+)", "")), java(r"(?i)\s+(?:which|who|that)\b.*\z"), "")))
        return F.filter(parts, lambda p: F.length(p).between(2, 60) & ~p.rlike(java(NOT_AN_INVESTOR)) & p.rlike("[A-Z]"))

    return F.slice(F.array_distinct(F.concat(named(INVESTOR_LEAD), named(INVESTOR_ALSO))), 1, most)


def headquarters(text: Column) -> Column:
    """struct<city, state>, where the text says so."""
    state = F.regexp_extract(text, java(HEADQUARTERS), 2)
    return F.struct(F.nullif(trimmed(F.regexp_extract(text, java(HEADQUARTERS), 1)), F.lit("")).alias("city"), F.when(state.isin(*US_STATES), state).alias("state"))


def _tidy(span: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(span), r"^[-–—]\s*", ""), r"[,;:.]\z", ""))


def name_in(candidate: Column) -> Column:
    """struct<name, code>: the name that a span begins with, or why it has none (then ``code`` is set)."""
    span = _tidy(candidate)
    name = F.regexp_replace(F.regexp_extract(span, r"^[A-Z0-9]\S*(?:\s+[A-Z0-9]\S*)*", 0), r"\s+", " ")
    n_words = F.size(F.split(name, " "))
    code = (
        F.when(F.length(span) < 2, "company-name-not-extractable")
        .when(possessive(span)["kind"] != "none", "company-name-is-person")
        .when(span.rlike(java(DESCRIPTOR_HEAD)) | span.rlike(java(DESCRIPTOR_TAIL)) | (F.length(name) < 2), "company-name-is-descriptor")
        .when(name.rlike(java(LEGAL_SUFFIX_ONLY)), "company-name-not-extractable")
        .when(matches(name, r"(?i)^\w+ing\b") & name.contains(" "), "company-name-is-descriptor")
        .when(name.rlike(java(CLAUSE_WORD)) | name.rlike(java(DESCRIPTOR_TAIL)) | (n_words > 4), "company-name-is-descriptor")
        .when((n_words == 1) & ((F.length(name) < 3) | name.rlike(java(BARE_ABBREVIATION))), "company-name-not-extractable")
    )
    return F.struct(name.alias("name"), code.alias("code"))


def company_of(subject: Column) -> Column:
    """struct<name, place, code> of the company that a headline's subject names.

    Tried in turn: what follows a word like "startup" (the last such word
    first), what follows the last comma, what precedes the first, and all of
    it. ``code`` tells why the first of these failed, if all do.
    """
    s = F.regexp_replace(collapsed(F.regexp_replace(subject, r"(?i)^(?:exclusive|breaking|report|scoop|update)\s*[:,-]\s*", "")), r"[,;:]\z", "")
    marks = F.regexp_extract_all(s, F.lit(java(DESCRIPTOR_MID)), F.lit(0))
    pieces = F.split(s, java(DESCRIPTOR_MID), -1)
    n = F.size(marks)
    # After the k-th mark: the pieces from there, with the marks between them.
    rest = F.zip_with(F.slice(pieces, F.lit(2), n), F.concat(F.slice(marks, F.lit(2), n), F.array(F.lit(""))), lambda p, m: F.concat(p, m))
    tails = F.when(n > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.struct(F.array_join(F.slice(rest, k, n), "").alias("text"), F.lit("after-descriptor").alias("place")))).otherwise(F.array())
    one = lambda text, place: F.struct(text.alias("text"), F.lit(place).alias("place"))
    commas = F.when(s.contains(","), F.array(one(F.substring_index(s, ",", -1), "after-comma"), one(F.substring_index(s, ",", 1), "before-comma"))).otherwise(F.array())
    kind = "array<struct<text:string,place:string>>"
    tried = F.transform(F.concat(tails.cast(kind), commas.cast(kind), F.array(one(s, "subject")).cast(kind)), lambda a: F.struct(name_in(a["text"]).alias("v"), a["place"].alias("place")))
    good = F.get(F.filter(tried, lambda a: a["v"]["code"].isNull()), F.lit(0))
    bad = F.get(tried, F.lit(0))["v"]["code"]
    return F.struct(F.coalesce(good["v"]["name"], s).alias("name"), F.coalesce(good["place"], F.lit("subject")).alias("place"), F.when(good.isNull(), bad).alias("code"))


def funding_events(items: DataFrame, today: Column) -> DataFrame:
    """``items`` (title, description, link, published_at) with the event that each states, or ``rejection``.

    Null titles and descriptions count as empty. The headline decides who
    raised; if it doesn't say, the first two sentences of the body may. With
    a subject only the headline can disqualify, else the opening of the body
    can too. Step by step, as each is used by the next more than once.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = items.withColumns({"_title": trimmed(text("title")), "_body": text("description")})
    first_two = F.array_join(F.slice(F.split(F.col("_body"), r"(?<=[.!?])\s"), 1, 2), " ")
    d = d.withColumns({"_lead": F.concat("_title", F.lit(". "), F.substring("_body", 1, OPENING)), "_said": stated_raise(F.col("_title")), "_first": first_two})
    d = d.withColumn("_late", F.when(F.col("_said").isNull(), _amount_of(F.col("_first"))))
    d = d.withColumns({"_subject": F.coalesce("_said.subject", F.when(F.col("_late").isNotNull(), F.regexp_extract("_first", java(RAISE), 1))), "_amount": F.coalesce("_said.amount", "_late")})
    has_subject = F.col("_subject").isNotNull()
    scope = F.when(has_subject, F.col("_title")).otherwise(F.col("_lead"))
    d = d.withColumns({"_scope": scope, "_equity": F.col("_lead").rlike(java(EQUITY_LANGUAGE)), "_company": company_of(F.coalesce("_subject", F.lit(""))), "_round": round_of(F.col("_lead"))})
    age = F.date_diff(today, F.col("published_at").cast("date"))
    rejection = F.coalesce(
        disqualified(F.col("_scope"), F.col("_equity"), has_subject),
        F.when(~has_subject, F.when(F.col("_lead").rlike(java(FINANCING_LANGUAGE)), "financing-not-attributed").otherwise("no-financing-language")),
        F.col("_company.code"),
        F.when(F.col("_amount").isNull() & F.col("_round").isNull(), "no-amount-or-round-stated"),
        F.when(F.col("published_at").isNull(), "no-announcement-date"),
        F.when(age > MOST_AGE_DAYS, "event-too-old"),
    )
    d = d.withColumns({"rejection": rejection, "_hq": headquarters(F.col("_lead"))})
    fine = F.col("rejection").isNull()
    publisher = host(F.col("link"))
    return d.select(
        *items.columns,
        "rejection",
        F.when(fine, F.col("_company.name")).alias("company_name"),
        F.when(fine, company_key(F.col("_company.name"))).alias("company_key"),
        F.when(fine, F.col("_company.place")).alias("name_from"),
        F.when(fine, F.col("published_at").cast("date")).alias("announced_at"),
        F.when(fine, F.col("_amount.usd")).alias("amount_usd"),
        F.when(fine, F.concat("_amount.text", F.lit(" (as stated by "), publisher, F.lit(")"))).alias("amount_text"),
        F.when(fine, F.col("_round")).alias("round_type"),
        F.when(fine, investors_of(F.col("_lead"))).alias("investors"),
        F.when(fine, F.col("_hq.city")).alias("hq_city"),
        F.when(fine, F.col("_hq.state")).alias("hq_state"),
        F.when(fine, publisher).alias("publisher"),
        F.when(fine, F.concat_ws(" — ", "_title", F.nullif(F.substring("_body", 1, 300), F.lit("")))).alias("excerpt"),
    )
