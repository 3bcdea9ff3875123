"""Evidence-gated decisions per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import half_up, lookup, matches

# How strong each source is; others are third tier.
SOURCE_TIER = {"sec": 1, "grants": 1, "yc": 1, "funding-news": 2, "investor-news": 2, "producthunt": 2, "upload": 2, "github": 3, "research": 3, "websites": 3}
# Sources that are of one kind.
SOURCE_FAMILY = {
    "sec": "regulatory", "grants": "government", "yc": "accelerator", "funding-news": "press",
    "investor-news": "investor-primary", "producthunt": "launch-platform", "github": "code",
    "research": "academic", "upload": "manual", "websites": "web",
}
# Names of the families.
FAMILY_LABEL = {
    "regulatory": "Regulatory filing", "government": "Government award", "accelerator": "Accelerator directory",
    "press": "Funding press", "investor-primary": "Investor (primary)", "launch-platform": "Launch platform",
    "code": "Code repository", "academic": "Academic preprint", "manual": "Human-curated import",
    "web": "Company website", "other": "Other",
}
LIVE_CLASSES = ("recent-financing-signal", "credible-fundraising-signal", "verified-current-opportunity")
FINANCING = ("form-d-filing", "funding-announcement", "institutional-investment")
COMMERCIAL = ("government-award", "product-launch")
CURRENT_DAYS = 365


def tier_of(source: Column) -> Column:
    return lookup(source, SOURCE_TIER, 3)


def family_of(source: Column) -> Column:
    return lookup(source, SOURCE_FAMILY, "other")


def family_label(family: Column) -> Column:
    return F.coalesce(lookup(family, FAMILY_LABEL), family)


def is_live(classification: Column) -> Column:
    return classification.isin(*LIVE_CLASSES)


def classify(evidence: DataFrame, today: Column, key: str = "company_id", operating: Column | None = None) -> DataFrame:
    """(key, classification, primary_source, primary_tier, primary_date, sources): one row per entity.

    Evidence has opportunity_type, source_id, tier and published_at. Only what
    is dated within a year up to today counts as current, and only tiers 1
    and 2 show financing, fundraising or commercialization; an accelerator
    batch counts as fundraising where ``operating`` holds. The primary item
    is the strongest, then newest, of the kind that decided. One aggregate,
    combined on the map side: an entity may have any number of items.
    """
    age = F.date_diff(today, F.col("published_at"))
    strong = age.between(0, CURRENT_DAYS) & (F.col("tier") <= 2)
    kind = F.col("opportunity_type")
    kinds = {
        "financing": strong & kind.isin(*FINANCING),
        "raising": strong & ((kind == "explicit-raising-statement") | ((kind == "accelerator-batch") & (F.lit(False) if operating is None else operating))),
        "commercial": strong & kind.isin(*COMMERCIAL),
    }
    item = F.struct(F.col("tier"), (-F.unix_date("published_at")).alias("newest"), F.col("source_id"), F.col("published_at"))
    best = evidence.groupBy(key).agg(
        *(F.min(F.when(c, item)).alias(k) for k, c in kinds.items()),
        F.collect_set(F.when(age.between(0, CURRENT_DAYS), F.col("source_id"))).alias("sources"),
    )
    has = {k: F.col(k).isNotNull() for k in kinds}
    label = (
        F.when(has["financing"] & has["raising"], "verified-current-opportunity")
        .when(has["financing"], "recent-financing-signal")
        .when(has["raising"], "credible-fundraising-signal")
        .when(has["commercial"], "unverified-opportunity")
        .otherwise("company-lead")
    )
    primary = F.coalesce("financing", "raising", "commercial")
    return best.select(key, label.alias("classification"), primary["source_id"].alias("primary_source"), primary["tier"].alias("primary_tier"), primary["published_at"].alias("primary_date"), F.size("sources").alias("n_sources"))


def gated(classification: Column, verdict: Column, corroborated: Column, needs_review: Column) -> Column:
    """A classification after the qualification verdict had its say."""
    return (
        F.when(verdict.isNull(), "unverified-opportunity")
        .when(verdict.isin("disqualified", "insufficient-evidence") | ~corroborated, "company-lead")
        .when(needs_review, "unverified-opportunity")
        .otherwise(classification)
    )


def resolve_stage(evidence: DataFrame, key: str = "company_id") -> DataFrame:
    """(key, stage, confidence, n_sources): what authoritative sources say, or that they disagree.

    Evidence has stage (null: not named), authoritative and family.
    """
    named = F.col("stage").isNotNull() & F.col("authoritative")
    per = evidence.groupBy(key).agg(F.collect_set(F.when(named, F.col("stage"))).alias("stages"), F.count_distinct(F.when(named, F.col("family"))).alias("n"), F.count_distinct("family").alias("searched"))
    stage = F.when(F.size("stages") > 1, "Stage conflict").when(F.size("stages") == 1, F.get("stages", F.lit(0))).otherwise("Unknown")
    confidence = F.when(F.size("stages") == 1, F.least(F.lit(0.95), 0.75 + 0.1 * F.col("n"))).when(F.size("stages") > 1, 0.15).otherwise(F.least(F.lit(0.55), 0.2 + 0.08 * F.col("searched")))
    return per.select(key, stage.alias("stage"), F.round(confidence, 2).alias("confidence"), F.col("n").alias("n_sources"))


def founder_status(candidates: DataFrame, key: str = "company_id") -> DataFrame:
    """(key, status, best_person): conflict, verified, probable, manual or exhausted.

    Candidates have person_key, title, authoritative, match_score and
    director. Two people in one singular role of authoritative sources
    conflict; a titled, authoritative, well matched person is verified.
    """
    sure = F.col("authoritative") & F.col("title").isNotNull() & (F.col("match_score") >= 7) & ~F.col("director")
    likely = F.col("match_score") >= 5
    roles = candidates.where(sure & matches(F.lower("title"), r"\b(ceo|chief executive|cto|chief technology)\b")).groupBy(key, F.lower("title").alias("role")).agg(F.count_distinct("person_key").alias("n"))
    clashes = roles.where("n > 1").select(key).distinct().withColumn("clash", F.lit(True))
    order = F.struct("match_score", F.col("person_key"))
    per = candidates.groupBy(key).agg(F.count_if(sure).alias("sure"), F.count_if(likely).alias("likely"), F.count(F.lit(1)).alias("n"), F.max_by("person_key", order).alias("best_person"))
    status = F.when(F.col("clash"), "conflict").when(F.col("sure") > 0, "verified").when(F.col("likely") > 0, "probable").when(F.col("n") > 0, "manual-review").otherwise("exhausted")
    return per.join(clashes, key, "left").select(key, status.alias("status"), "best_person")


def next_action(status: Column, exceptions: Column, stale: Column, provisional: Column, score: Column) -> Column:
    """What to do next with an entity; the first that applies."""
    return (
        F.when(status.isin("Passed", "Archived"), "inactive")
        .when(exceptions > 0, "partner-review")
        .when(stale, "refresh")
        .when(status.isNull() | (status == "new"), "first-review")
        .when(provisional, "needs-data")
        .when(score >= 8, "prioritize")
        .when(score >= 6.5, "track")
        .otherwise("monitor")
    )


def merged_events(events: DataFrame, key: str, at: str, days: int = 21) -> DataFrame:
    """Events with ``head_at``: an event joins the first event of its key up to ``days`` before it.

    Anchored, not chained: what lies over ``days`` after the head starts a new
    event even if something lies between. The fold over a key's distinct
    days is sequential; it runs over days, not rows.
    """
    distinct = events.groupBy(key).agg(F.array_sort(F.collect_set(F.unix_date(F.col(at).cast("date")))).alias("_days"))
    start = F.array().cast("array<struct<day:int,head:int>>")

    def step(acc: Column, day: Column) -> Column:
        last = F.element_at(acc, -1)["head"]
        head = F.when(day - last <= days, last).otherwise(day)
        return F.concat(acc, F.array(F.struct(day.alias("day"), head.alias("head"))))

    fold = lambda a, d: F.when(F.size(a) == 0, F.array(F.struct(d.alias("day"), d.alias("head")))).otherwise(step(a, d))
    folded = distinct.withColumn("_heads", F.aggregate("_days", start, lambda a, d: fold(a, d).cast("array<struct<day:int,head:int>>")))
    heads = folded.select(key, F.explode("_heads").alias("h")).select(key, F.date_from_unix_date("h.day").alias("_day"), F.date_from_unix_date("h.head").alias("head_at"))
    return events.withColumn("_day", F.col(at).cast("date")).join(heads, [key, "_day"]).drop("_day")


def operating_confidence(level: Column, identity_confirmed: Column, n_independent: Column, described: Column, excluded: Column, within_year: Column) -> Column:
    """Confidence that an issuer operates; none for public companies, funds and what isn't a company."""
    points = F.when(level == "substantive", 0.4).when(identity_confirmed, 0.1).otherwise(0.0) + F.when(described, 0.15).otherwise(0.0) + F.least(F.lit(0.3), n_independent * 0.15) + F.when(within_year, 0.05).otherwise(0.0)
    return F.when(excluded, 0.0).otherwise(half_up(F.least(F.lit(1.0), points), 2))


# Signals that tell a record from others of its sector.
SUBSTANTIVE_SIGNALS = ("named-customers", "commercial-proof", "enterprise-buyer", "technical-moat", "data-moat", "founder-market-fit")


def promising(records: DataFrame, today: Column, terminal: tuple[str, ...] = ("Passed", "Archived"), most_batch_years: int = 3) -> DataFrame:
    """Records with needs_diligence and eligible (the narrower), from what excludes and what distinguishes them.

    Needs thesis_eligible, n_flags, inactive, duplicate, review_status,
    provisional, missing_critical array, score, quality_band, signals
    array<string> and batch_year.
    """
    excluded = [
        ("thesis", ~F.coalesce(F.col("thesis_eligible"), F.lit(True))),
        ("policy-exception", F.col("n_flags") > 0),
        ("inactive", F.col("inactive")),
        ("duplicate", F.col("duplicate")),
        ("terminal-status", F.coalesce(F.col("review_status").isin(*terminal), F.lit(False))),
        ("fully-assessed", ~F.col("provisional")),
        ("nothing-missing", F.size("missing_critical") == 0),
    ]
    out = records.withColumn("exclusions", F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in excluded)))).withColumn("needs_diligence", F.size("exclusions") == 0)
    substantive = F.size(F.array_intersect("signals", F.array(*map(F.lit, SUBSTANTIVE_SIGNALS)))) > 0
    old = F.coalesce(F.year(today) - F.col("batch_year") > most_batch_years, F.lit(False))
    band = F.coalesce(F.col("quality_band").isin("high", "medium"), F.lit(False))
    return out.withColumn("eligible", F.col("needs_diligence") & (F.col("score") >= 6.5) & band & substantive & ~old)


def import_decision(found: Column, status: Column, duplicate: Column, entity_ok: Column, sector_ok: Column, valid: Column) -> Column:
    """What becomes of a candidate that is to be imported; the first that applies."""
    return (
        F.when(~found, "not-found")
        .when(status.isin("imported", "rejected", "dismissed"), "terminal")
        .when(duplicate == "exact", "duplicate")
        .when(~entity_ok, "not-operating-company")
        .when(~sector_ok, "outside-sector")
        .when(~valid, "validation-failed")
        .otherwise("imported")
    )


def vertical_of(stated: Column, classified: Column, confidence: Column, least: float = 0.5) -> Column:
    """struct<vertical, reason>: what the source states, else a confident class, else nothing."""
    sure = classified.isNotNull() & (confidence >= least)
    return F.struct(
        F.coalesce(stated, F.when(sure, classified)).alias("vertical"),
        F.when(stated.isNotNull(), "source").when(sure, "classifier").when(classified.isNotNull(), "low-confidence").otherwise("no-signal").alias("reason"),
    )


def traction_review_errors(scores: Column, url: Column, note: Column, metric: Column, confirmed: Column, customer: Column) -> Column:
    """What is missing from a review: scoring states, figures, confirmations and names need their source."""
    has_url, has_note = F.coalesce(url, F.lit("")) != "", F.length(F.trim(F.coalesce(note, F.lit("")))) >= 10
    return F.array_compact(
        F.array(
            F.when(scores & ~has_url & ~has_note, F.lit("state-needs-source-or-note")),
            F.when(metric.isNotNull() & ~has_url, F.lit("figure-needs-source")),
            F.when(confirmed & ~has_url, F.lit("confirmation-needs-source")),
            F.when(customer.isNotNull() & ~has_url & ~has_note, F.lit("customer-needs-source-or-note")),
        )
    )
