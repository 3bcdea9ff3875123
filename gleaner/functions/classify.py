"""Rule sets over text: labels, signals, guards and clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_match, found_in, half_up, java, once, trimmed, with_low

# How sources name a round, in the order in which they are tried.
STATED_STAGES = (
    ("Pre-seed", r"(?i)\bpre-?seed\b"),
    ("Series B+", r"(?i)\bseries\s+[c-z]\b"),
    ("Series B+", r"(?i)\bseries\s+b\b"),
    ("Series A", r"(?i)\bseries\s+a(?:-\d)?\b"),
    ("Seed", r"(?i)\bseed\s+(?:round|funding|financing|extension)\b"),
    ("Seed", r"(?i)\braises?\s+\$?[\d.]+\s*[mk]?\s+seed\b"),
    ("Seed", r"(?i)\bseed\b"),
    ("Bootstrapped", r"(?i)\bbootstrapp?ed\b"),
    ("Grant-funded", r"(?i)\b(?:grant[- ]funded|sbir|sttr|nsf\s+award|darpa\s+award)\b"),
    ("Pre-launch", r"(?i)\b(?:pre-?launch|not\s+yet\s+launched|coming\s+soon|in\s+stealth)\b"),
)
# Roles that one person holds.
SINGULAR_ROLES = (
    ("CEO", r"(?i)\b(?:ceo|chief executive(?: officer)?)\b"),
    ("CTO", r"(?i)\b(?:cto|chief technology officer)\b"),
    ("COO", r"(?i)\b(?:coo|chief operating officer)\b"),
    ("CFO", r"(?i)\b(?:cfo|chief financial officer)\b"),
    ("President", r"(?i)\bpresident\b"),
)
# Phrases by which a text tries to instruct its reader.
INJECTION_FLAGS = (
    ("ignore-previous-instructions", r"(?i)ignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instruction|prompt|direction|rule)"),
    ("disregard-previous", r"(?i)disregard\s+(all\s+|any\s+)?(previous|prior|above|the)\s+"),
    ("role-reassignment", r"(?i)\byou\s+are\s+now\b|\bnew\s+instructions?\b|\bsystem\s*(prompt|message)\s*:"),
    ("secret-exfiltration", r"(?i)\b(reveal|print|output|repeat|show)\b[^.]{0,40}\b(system\s*prompt|instructions|api[_\s-]?key|secret|token|password)"),
    ("fake-role-tag", r"(?i)<\s*\/?\s*(system|assistant|human)\s*>"),
    ("action-injection", r"(?i)\bmark\s+(this|it)\b[^.]{0,30}\b(approved|verified|passed)\b"),
    ("concealment-instruction", r"(?i)\bdo\s+not\s+(mention|tell|report|disclose)\b"),
)
SECRET = r"(?i)\b(?:sk-[A-Za-z0-9_-]{8,}|bearer\s+[A-Za-z0-9._-]{8,}|(?:api[_-]?key|token|secret|password)\s*[=:]\s*\S+)"


def scored_labels(text: Column, rules: Mapping[str, Sequence[tuple[str, int]]]) -> Column:
    """array<struct<score, rank, label>>, best first: the sum of the weights of each label's patterns that match.

    Equal scores keep the order of ``rules``.
    """

    def scores(x: Column) -> Column:
        hit = lambda p: found_in(x["text"], x["low"], p)
        each = [F.struct(sum((F.when(hit(p), w).otherwise(0) for p, w in patterns), F.lit(0)).alias("score"), F.lit(-rank).alias("rank"), F.lit(label).alias("label")) for rank, (label, patterns) in enumerate(rules.items())]
        return F.sort_array(F.array(*each), asc=False)

    return once(with_low(text), scores)


def classified(text: Column, rules: Mapping[str, Sequence[tuple[str, int]]], least: int = 3) -> Column:
    """struct<label, score, confidence>: the best label, if it scores enough, and how far it is ahead."""

    def best(ranked: Column) -> Column:
        top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))["score"]
        ahead = F.when(top["score"] > 0, (top["score"] - F.coalesce(second, F.lit(0))) / top["score"]).otherwise(0.0)
        confidence = half_up(0.5 * F.least(F.lit(1.0), top["score"] / 6) + 0.5 * ahead, 2)
        enough = top["score"] >= least
        return F.struct(F.when(enough, top["label"]).alias("label"), top["score"].alias("score"), F.when(enough, confidence).otherwise(0.0).alias("confidence"))

    return once(scored_labels(text, rules), best)


def does_and_pays(text: Column, does: Sequence[str], pays: Sequence[str]) -> Column:
    """What a sector's words count for: those of its work times those of its buyers and one, or nothing without work."""
    low = F.lower(text)
    hits = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return hits(does) * (hits(pays) + 1)


def flags(text: Column, rules: Sequence[tuple[str, str]] = INJECTION_FLAGS) -> Column:
    """Labels of all rules that match, in order."""
    return once(with_low(text), lambda x: F.array_compact(F.array(*(F.when(found_in(x["text"], x["low"], p), F.lit(label)) for label, p in rules))))


def without_secrets(text: Column) -> Column:
    return F.regexp_replace(text, java(SECRET), "[redacted]")


# What a reader doesn't see of a page, in the order in which it is taken out; entities; and characters without width.
UNSEEN = (
    r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->", r"(?is)<[^>]*\b(?:hidden|aria-hidden\s*=\s*[\"']?true)\b[^>]*>.*?</[^>]+>",
    r"(?is)<[^>]*style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0)[^\"']*[\"'][^>]*>.*?</[^>]+>", r"(?i)</?[a-z][^>]*>",
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))
NO_WIDTH = r"[\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}-\x{2064}\x{FEFF}\x{180E}\x{00AD}]"


def sanitised(text: Column, most: int = 8000) -> Column:
    """struct<text, flags, truncated> of a text that a model may be shown: what is unseen gone, entities decoded, blanks narrowed.

    The cut is the feature: it bounds what is shown, and says so. Null is
    the empty text.
    """
    s = F.coalesce(text, F.lit(""))
    for p in UNSEEN:
        s = F.regexp_replace(s, java(p), " ")
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    s = trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, NO_WIDTH, ""), r"[ \t\r\f\x0B]+", " "), r"\n{3,}", "\n\n"))
    cut = lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(f"\n[truncated at {most} characters]"))).otherwise(x)
    return once(s, lambda x: F.struct(cut(x).alias("text"), flags(x).alias("flags"), (F.length(x) > most).alias("truncated")))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; the parser itself overlooks what follows a value."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.try_parse_json(text).isNotNull() & alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()


def model_json(raw: Column) -> Column:
    """struct<json, error> of what a model answered: the JSON text in it, fenced or within prose, or why there is none."""
    text = trimmed(F.coalesce(raw, F.lit("")))
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(text.rlike(r"(?is)```(?:json)?\s*.*?```"), trimmed(fenced)).otherwise(text)

    def found(x: Column) -> Column:
        outer = F.regexp_extract(x, r"(?s)\{.*\}", 0)
        return F.coalesce(F.when(is_json(x), x), F.when((outer != "") & is_json(outer), outer))

    json = once(body, found)
    return once(F.struct(json.alias("json"), (text == "").alias("empty")), lambda j: F.struct(j["json"].alias("json"), F.when(j["empty"], "empty").when(j["json"].isNull(), "not-json").alias("error")))


def stage_of(text: Column) -> Column:
    return first_match(text, STATED_STAGES)


def role_of(title: Column) -> Column:
    return first_match(title, SINGULAR_ROLES)


def unsupported(output: Column, allowed: Column, patterns: Sequence[str] = (r"\$[\d,.]+[kKmMbB]?", r"\d+(?:\.\d+)?%")) -> Column:
    """Amounts and percentages of ``output`` that ``allowed`` doesn't hold."""
    found = F.concat(*(F.regexp_extract_all(output, F.lit(p), F.lit(0)) for p in patterns))
    return F.filter(F.array_distinct(found), lambda x: ~F.contains(allowed, x))


def sentences(text: Column) -> Column:
    """Split after closing marks and at line breaks."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")
