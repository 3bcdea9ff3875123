"""Investors' own announcements: which firm a page is of, which firms a text names, and the event that a firm states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.funding import EQUITY_LANGUAGE, MOST_AGE_DAYS, company_of, disqualified, headquarters, investors_of, round_of, stated_raise
from ..functions.names import company_key
from ..functions.rules import found_in, java, matches, once, trimmed, with_low
from ..functions.urls import host

LEAST_ALIAS = 4
#: Characters of a body in which a firm says what its page is about; reading no more is the rule.
OPENING = 1200
# How a firm says that it invested; those of the first group name the company.
NAMES_COMPANY = (
    r"(?i)\bwhy\s+we\s+invested\s*(?:in\b|:)\s*(.{2,70})",
    r"(?i)\bwe(?:'ve|’ve|\s+have)?\s+(?:just\s+)?(?:invested|co-?invested)\s+in\s+(.{2,70})",
    r"(?i)\bour\s+(?:latest\s+|newest\s+|first\s+)?investment\s+in\s+(.{2,70})",
    r"(?i)^\s*(?:announcing\s+)?investing\s+in\s+(.{2,70})",
    r"(?i)\bannouncing\s+our\s+(?:investment|partnership)\s+(?:in|with)\s+(.{2,70})",
    r"(?i)\b(?:backing|we\s+are\s+backing)\s+(.{2,70})",
    r"(?i)\bdoubling\s+down\s+on\s+(.{2,70})",
    r"(?i)\b(?:leading|we\s+(?:led|co-?led))\s+(?:the\s+)?(.{2,70}?)['’]s\s+(?:pre-?seed|seed|series\s+[a-f]|round)",
    r"(?i)\bwelcom(?:e|ing)\s+(.{2,70}?)\s+to\s+(?:our|the)\s+portfolio\b",
)
STATES_ONLY = (r"(?i)\bwe\s+(?:led|co-?led)\b", r"(?i)\bwe(?:'ve|’ve|\s+have)?\s+(?:just\s+)?invested\b")
# Words beside a firm's name that make it a participant.
PARTICIPATION = r"(?i)\b(?:led\s+by|co-?led\s+by|backed\s+by|funded\s+by|from|with\s+participation\s+from|joined\s+by|investors?\s+include|participation\s+by|investment\s+from|-backed)\b"
# A firm's news that is no financing, portfolio pages, and words of financing.
NOT_FINANCING = (
    r"(?i)\b(?:joins?|joining|welcom(?:e|ing))\b[^.]{0,60}\bas\s+(?:an?\s+)?(?:\w+\s+){0,2}(?:partner|principal|associate|advisor|adviser|director|fellow)\b",
    r"(?i)\b(?:joins?|joining|welcom(?:e|ing))\b[^.]{0,60}\bto\s+the\s+team\b",
    r"(?i)\bnames?\b[^.]{0,60}\b(?:general\s+partner|managing\s+director|chief\s+\w+\s+officer|partner)\b",
    r"(?i)\b(?:our\s+new|new)\s+(?:senior\s+)?(?:associate|principal|partner|analyst)\b",
    r"(?i)\b(?:impact|annual|prognosis|state\s+of|market|industry)\s+report\b",
    r"(?i)\b(?:podcast|webinar|summit|conference|fireside|roundtable|demo\s+day|cohort|programme|program)\b",
    r"(?i)\b(?:news\s+roundup|roundup\s*[–—-]|weekly\s+(?:digest|roundup)|index\s+Q[1-4])\b",
    r"(?i)\bpredictions\b",
    r"(?i)\b(?:launches?|launched|introduces?|unveils?|releases?|announces?)\s+(?:its\s+|the\s+|a\s+|new\s+)?(?:[A-Z][\w™®-]*\s+)?(?:product|platform|feature|update|version|partnership|collaboration|programme|program|system|tool)\b",
    r"(?i)\bFDA\s+(?:clearance|approval|designation)\b",
    r"(?i)\b(?:partners?\s+with|partnership\s+with|collaborat\w+\s+with|selected\s+by|honors?|honou?red|award(?:ed)?\s+(?:to|for)\s+(?!\$))",
    r"(?i)\b(?:test\s+flight|completes?\s+\w+\s+(?:test|mission)|sets?\s+\w+\s+record)\b",
)
PORTFOLIO = (r"(?i)\bwelcom(?:e|ing)\b[^.]{0,60}\bto\s+(?:our|the)\s+portfolio\b", r"(?i)^\s*portfolio\s+(?:spotlight|update|company)\b", r"(?i)^\s*(?:meet|introducing)\s+our\s+portfolio\b")
FINANCING = r"(?i)\b(?:invest(?:ed|ing|ment)|raise[sd]?|raising|round|financing|funding|seed|series\s+[a-f]|pre-?seed|led\s+the|co-?led|back(?:ed|ing)\s+\w)\b"
# Words at which a company's name is over.
ENDS_NAME = r"(?i)^(?:to|for|from|and|with|as|at|in|on|the|a|an|its|their|our|that|which|who|why|how|so|because|after|before|while|amid|by|into|toward|towards|across|beyond|is|are|was|were|will|can|could)\z"
ACTS = (
    r"(?i)^(?:names?|named|appoints?|hires?|promotes?|launch(?:es|ed)?|announces?|announced|unveils?|introduces?|releases?|expands?|adds?|brings?|partners?|selects?|selected|welcomes?|joins?|acquires?|acquired|reaches?|sets?|completes?|"
    r"wins?|receives?|opens?|closes?|secures?|raises?|lands?|nabs?|banks?|debuts?|files?|signs?|delivers?|ships?|reports?|shares?|talks?|discusses?)\z"
)

_END = java(r"\b")
_TOOK_PART = "struct<how:string,quote:string,span:string>"


def _literally(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.*+?^${}()|\[\]])", r"\\$1")


def _group(text: Column, pattern: Column, k: int) -> Column:
    """A group of a pattern that differs from row to row; null without a match."""
    return F.when(F.regexp_like(text, pattern), F.call_function("regexp_extract", text, pattern, F.lit(k)))


def _quoted(text: Column) -> Column:
    return F.substring(trimmed(text), 1, 160)


def investor_of(items: DataFrame, investors: DataFrame, link: str = "link") -> DataFrame:
    """``items`` with ``investor``, ``domain`` and ``aliases`` of the firm whose site the link is on; others have nulls.

    Investors have name, domain and aliases array<string>, domains once each.
    A domain below a registered one is the firm's too, the longest
    registered one counts. Links join by each ending of their host, an
    equi-join however many firms there are.
    """
    found = host(F.col(link))
    labels = F.split(found, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = items.select(found.alias("_host")).where("_host is not null and _host <> ''").distinct()
    below = hosts.select("_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("_host", r"\."))), lambda k: F.array_join(F.slice(F.split(F.col("_host"), r"\."), k, F.size(F.split(F.col("_host"), r"\."))), "."))).alias("_domain"))
    own = below.join(investors.select(F.col("domain").alias("_domain"), F.col("name").alias("investor"), F.col("domain").alias("domain"), "aliases"), "_domain")
    best = own.groupBy("_host").agg(F.max_by(F.struct("investor", "domain", "aliases"), F.length("_domain")).alias("_of"))
    return items.withColumn("_host", found).join(best, "_host", "left").select(*items.columns, "_of.investor", "_of.domain", "_of.aliases")


def participation(text: Column, aliases: Column) -> Column:
    """struct<how, quote, span>: how a firm with these aliases says that it took part; null if it doesn't.

    First-person language that names the company goes before the firm's own
    name as its owner, then its name within language of participation, then
    first-person language that names nobody.
    """
    return once(with_low(text), lambda x: _participation(x, aliases))


def _participation(x: Column, aliases: Column) -> Column:
    """As :func:`participation`, of a struct of the text and its lower case."""
    text, low = x["text"], x["low"]
    took = lambda how, quote, span: F.struct(F.lit(how).alias("how"), _quoted(quote).alias("quote"), span.alias("span")).cast(_TOOK_PART)
    named = [F.when(found_in(text, low, p), took("first-person", F.regexp_extract(text, java(p), 0), F.regexp_extract(text, java(p), 1))) for p in NAMES_COMPANY]
    stated = [F.when(found_in(text, low, p), took("first-person", F.regexp_extract(text, java(p), 0), F.lit(None).cast("string"))) for p in STATES_ONLY]
    known = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.length(a) >= LEAST_ALIAS)

    def owner(alias: Column) -> Column:
        pattern = F.concat(F.lit(f"(?i){_END}"), _literally(alias), F.lit(r"['’]s\s+(?:latest\s+|newest\s+|first\s+)?investment\s+in\s+(.{2,70})"))
        return F.when(low.contains("investment") & F.regexp_like(text, pattern), took("first-person", _group(text, pattern, 0), _group(text, pattern, 1)))

    def participant(alias: Column) -> Column:
        window = _context(text, low, alias)
        return F.when(matches(window, PARTICIPATION), took("named-as-participant", window, F.lit(None).cast("string")))

    first = lambda use: F.get(F.filter(F.transform(known, use), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(*named, first(owner), first(participant), *stated)


def context_of(text: Column, alias: Column) -> Column:
    """The first mention of ``alias`` with up to 90 characters before and 60 after it on its line; null without one."""
    return _context(text, F.lower(text), alias)


def _context(text: Column, low: Column, alias: Column) -> Column:
    pattern = F.concat(F.lit(f"(?i)(.{{0,90}}){_END}"), _literally(alias), F.lit(f"{_END}(.{{0,60}})"))
    return F.when(F.contains(low, F.lower(alias)) & F.regexp_like(text, pattern), F.concat(_group(text, pattern, 1), alias, _group(text, pattern, 2)))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z_]+"), F.lit(0)))


def mentions(texts: DataFrame, aliases: DataFrame, id_col: str = "id", text: str = "text", most_broadcast: int = 100_000) -> DataFrame:
    """(id, investor, alias, context, took_part): every registered name that a text holds, at its first mention.

    Aliases have investor and alias, of four characters or more. Each is
    looked for by its rarest word in the registry: texts meet an alias only
    if they hold that word, and all others of it, so the cost grows with what
    is found and not with the registry. A registry of up to ``most_broadcast``
    names goes to all tasks and texts don't move; a larger one is joined by
    word, then back to the texts.
    """
    named = aliases.where(F.length("alias") >= LEAST_ALIAS).select("investor", "alias", _words(F.col("alias")).alias("_all")).where(F.size("_all") > 0).distinct()
    counted = named.select(F.explode("_all").alias("_word")).groupBy("_word").count()
    anchored = named.select("investor", "alias", "_all", F.explode("_all").alias("_word")).join(counted, "_word").groupBy("investor", "alias", "_all").agg(F.min(F.struct("count", (-F.length("_word")).alias("n"), "_word"))["_word"].alias("_anchor"))
    if named.count() <= most_broadcast:
        met = texts.select(F.col(id_col), F.col(text).alias("_text"), _words(F.col(text)).alias("_held")).withColumn("_anchor", F.explode("_held")).join(F.broadcast(anchored), "_anchor").where(F.size(F.array_except("_all", "_held")) == 0)
    else:
        held = texts.select(F.col(id_col), F.explode(_words(F.col(text))).alias("_anchor"))
        pairs = held.join(anchored, "_anchor").select(id_col, "investor", "alias")
        met = texts.select(F.col(id_col), F.col(text).alias("_text")).join(pairs, id_col)
    found = met.select(id_col, "investor", "alias", context_of(F.col("_text"), F.col("alias")).alias("context")).where("context is not null")
    return found.withColumn("took_part", matches(F.col("context"), PARTICIPATION))


def company_span(raw: Column) -> Column:
    """The company's name in what a firm wrote: up to a sentence's end, a break, a comma, or a word that goes on; five words at most."""
    span = F.get(F.split(trimmed(raw), r"[.!?](?:\s|\z)"), F.lit(0))
    span = F.get(F.split(span, r"\s*[:—–|]\s*|\s+[-]\s+"), F.lit(0))
    tokens = F.slice(F.split(F.get(F.split(span, ","), F.lit(0)), r"(?U)\s+"), 1, 5)
    bare = lambda t: F.regexp_replace(t, r"[^\w'’&.-]", "")
    over = F.transform(tokens, lambda t, i: F.when((i > 0) & (bare(t).rlike(ENDS_NAME) | bare(t).rlike(ACTS)), i))
    upto = F.coalesce(F.array_min(over), F.size(tokens))
    return trimmed(F.regexp_replace(F.array_join(F.slice(tokens, F.lit(1), upto), " "), r"[.?!]+\z", ""))


def _squashed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def investor_events(items: DataFrame, investors: DataFrame, today: Column) -> DataFrame:
    """``items`` (title, description, link, published_at) with the event that a firm states on its own site, or ``rejection``.

    The page must be the firm's, tell of a financing, and say that the firm
    took part; the company is the one it names, never a firm. Null titles
    and descriptions are empty. ``investors`` as in :func:`investor_of`.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = investor_of(items, investors).withColumns({"_title": trimmed(text("title")), "_body": F.substring(text("description"), 1, OPENING)})
    d = d.withColumn("_lead", F.concat("_title", F.lit(". "), "_body"))
    prefix = lambda a: F.concat(F.lit(r"(?i)^\s*"), _literally(F.regexp_replace(a, "(?i)-backed$", "")), F.lit(r"-backed\s+"))
    backed = F.get(F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: _group(F.col("_title"), prefix(a), 0)), lambda x: x.isNotNull()), F.lit(0))
    d = d.withColumn("_backed", backed)
    stripped = F.when(F.col("_backed").isNull(), F.col("_title")).otherwise(F.expr("substring(_title, length(_backed) + 1)"))
    first_two = F.array_join(F.slice(F.split(F.col("_body"), r"(?<=[.!?])\s"), 1, 2), " ")
    d = d.withColumns({"_said": F.coalesce(stated_raise(stripped), stated_raise(first_two)), "_own": participation(F.col("_title"), F.col("aliases"))})
    d = d.withColumn("_page", F.coalesce("_own", participation(F.col("_lead"), F.col("aliases"))))
    has_subject = F.col("_said").isNotNull() | F.col("_own.span").isNotNull()
    listing = F.coalesce(*(F.when(matches(F.col("_title"), p), matches(F.regexp_replace("_title", java(p), " "), FINANCING)) for p in PORTFOLIO))
    news = F.lit(False)
    for p in NOT_FINANCING:
        news = news | matches(F.col("_title"), p)
    spans = F.filter(F.array(company_span(F.col("_own.span")), company_span(F.col("_said.subject"))), lambda s: F.length(s) >= 2)
    d = d.withColumns({"_spans": spans, "_round": round_of(F.col("_lead")), "_hq": headquarters(F.col("_lead"))})
    d = d.withColumn("_names", F.transform("_spans", company_of))
    good = F.get(F.filter("_names", lambda n: n["code"].isNull()), F.lit(0))
    d = d.withColumns({"_name": good["name"], "_from": good["place"], "_failed": F.get("_names", F.lit(0))["code"]})
    firms = investors.select(F.explode(F.array_append("aliases", F.col("name"))).alias("_firm")).select(_squashed(F.col("_firm")).alias("_firm")).where(F.length("_firm") >= LEAST_ALIAS).distinct().withColumn("_is_firm", F.lit(True))
    d = d.withColumn("_firm", _squashed(F.col("_name"))).join(firms, "_firm", "left")
    lead_or_title = F.when(has_subject, F.col("_title")).otherwise(F.col("_lead"))
    age = F.date_diff(today, F.col("published_at").cast("date"))
    rejection = F.coalesce(
        F.when(F.col("investor").isNull(), "investor-page-off-domain"),
        F.when(news, "not-a-financing-announcement"),
        F.when(~listing, "portfolio-listing-no-event"),
        disqualified(lead_or_title, matches(F.col("_lead"), EQUITY_LANGUAGE), has_subject, skip=("investor-or-fund-profile",)),
        F.when(F.col("_page").isNull() & F.col("_backed").isNull(), "investor-not-participant"),
        F.when(F.size("_spans") == 0, "company-name-not-extractable"),
        F.when(F.col("_name").isNull(), F.col("_failed")),
        F.when(F.coalesce("_is_firm", F.lit(False)), "fund-launch"),
        F.when(F.col("published_at").isNull(), "no-announcement-date"),
        F.when(age > MOST_AGE_DAYS, "event-too-old"),
    )
    d = d.withColumn("rejection", rejection)
    fine = lambda c: F.when(F.col("rejection").isNull(), c)
    return d.select(
        *items.columns, "investor", "rejection",
        fine(F.col("_name")).alias("company_name"), fine(company_key(F.col("_name"))).alias("company_key"), fine(F.concat(F.lit("investor-announcement:"), "_from")).alias("name_from"),
        fine(F.col("published_at").cast("date")).alias("announced_at"), fine(F.col("_said.amount.usd")).alias("amount_usd"),
        fine(F.concat("_said.amount.text", F.lit(" (as stated by "), "investor", F.lit(")"))).alias("amount_text"), fine(F.col("_round")).alias("round_type"),
        fine(F.slice(F.array_distinct(F.concat(F.array("investor"), investors_of(F.col("_lead")))), 1, 8)).alias("investors"),
        fine(F.col("_hq.city")).alias("hq_city"), fine(F.col("_hq.state")).alias("hq_state"), fine(F.col("domain")).alias("publisher"),
        fine(F.coalesce("_page.quote", F.concat(trimmed(F.col("_backed")), F.lit(" — "), "investor", F.lit(" named as an existing backer")))).alias("participation"),
        fine(F.concat_ws(" — ", "_title", F.nullif(F.substring("_body", 1, 300), F.lit("")))).alias("excerpt"),
    )
