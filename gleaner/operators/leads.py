"""Leads to candidates, candidates to records and dated evidence: what sources leave out stays unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import batch_year
from ..functions.money import amount_usd
from ..functions.names import is_full_name
from ..functions.rules import clamp, collapsed, known, lookup, matches
from ..functions.urls import normal_domain
from .decisions import tier_of

UNKNOWN = "Unknown"
# What kind of opportunity each source shows; others show none.
OPPORTUNITY = {"sec": "form-d-filing", "funding-news": "funding-announcement", "investor-news": "funding-announcement", "grants": "government-award", "yc": "accelerator-batch", "producthunt": "product-launch"}
# Why evidence of a kind counts as current; {} is its date.
WHY_CURRENT = {
    "form-d-filing": "Form D filed {} — a dated regulatory record of an exempt offering.",
    "funding-announcement": "Funding reported {} by a named publication.",
    "government-award": "Government award dated {}. Non-dilutive: a commercialization signal, not an equity round.",
    "accelerator-batch": "Accelerator batch beginning approximately {}. Indicates a cohort actively raising; the date is a batch season, not an exact day.",
    "product-launch": "Public product launch on {} — commercialization progress, not financing.",
}
UNDATED = "No publication date on this evidence, so it cannot establish that the opportunity is current."
OTHER_KIND = "Dated {}, but this source type cannot establish a financing event."
DAY = r"^\d{4}-\d{2}-\d{2}\z"


def opportunity_of(source: Column) -> Column:
    return lookup(source, OPPORTUNITY, "none")


def normal_leads(leads: DataFrame) -> DataFrame:
    """``leads`` with names trimmed (empty: null), a domain from the site where none is given, and confidence in 0 to 1."""
    name = F.nullif(collapsed(F.col("company_name")), F.lit(""))
    return leads.withColumns({"company_name": name, "company_domain": F.coalesce("company_domain", normal_domain(F.col("company_website"))), "confidence": clamp(F.col("confidence"), 0.0, 1.0)})


def lead_evidence() -> Column:
    """One citable item of a lead: what the source printed, verbatim, with its own date if it has one."""
    published = F.to_date(F.regexp_extract(F.coalesce("published_at", F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))
    notes = F.concat_ws("; ", F.concat(F.lit("Published "), F.substring("published_at", 1, 10)), F.concat(F.lit("Source record "), F.col("external_id")))
    return F.struct(
        F.col("evidence_text").alias("claim"),
        F.col("source_name").alias("source"),
        F.col("source_url").alias("url"),
        F.substring("discovered_at", 1, 10).alias("accessed"),
        published.alias("published_at"),
        F.lit("Not verified").alias("status"),
        F.lit("fact").alias("assertion"),
        "confidence",
        notes.alias("notes"),
    )


def candidates_of(leads: DataFrame) -> DataFrame:
    """Normal leads with a name as candidates: unknowns are named so, lists are empty, and the next step is said.

    Leads without a name can't be reviewed and go; counting them is
    ``leads.count() - candidates.count()`` or :func:`nameless`.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(UNKNOWN))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    amount = F.concat(F.lit("$"), F.format_number(F.col("funding_amount"), 0))
    site = F.concat(F.lit("Verify the pitch and team on "), F.col("company_website"), F.lit(", then classify vertical/stage."))
    found = normal_leads(leads).where(F.col("company_name").isNotNull())
    return found.select(
        F.sha2(F.concat_ws("\n", "source_id", "source_url", "company_name"), 256).alias("id"),
        "source_id",
        "external_id",
        "company_name",
        text("company_website").alias("website"),
        text("description").alias("pitch"),
        text("vertical").alias("vertical"),
        text("subcategory").alias("subcategory"),
        text("stage").alias("stage"),
        text("hq_city").alias("hq_city"),
        text("hq_state").alias("hq_state"),
        some("founder_names").alias("founder_names"),
        F.when(F.size(some("founder_names")) > 0, F.size("founder_names")).alias("founder_count"),
        text("accelerator").alias("accelerator"),
        F.coalesce("funding_amount_text", amount, F.lit(UNKNOWN)).alias("public_funding"),
        F.col("last_funding_date").alias("funding_date"),
        some("traction_signals").alias("traction_signals"),
        F.array(lead_evidence()).alias("evidence"),
        "confidence",
        F.substring("discovered_at", 1, 10).alias("discovered_at"),
        F.coalesce(site, F.lit("Requires manual review — locate an official website or filing before classifying.")).alias("next_step"),
        F.lit("pending").alias("status"),
    )


def nameless(leads: DataFrame) -> DataFrame:
    """(source_id, dropped): leads that no candidate can come from."""
    return normal_leads(leads).groupBy("source_id").agg(F.count_if(F.col("company_name").isNull()).alias("dropped"))


def company_rows(candidates: DataFrame, vertical: Column) -> DataFrame:
    """Candidates as records with honest defaults; ``founded_known`` is false where no year could be told."""
    year = batch_year(F.col("accelerator"))
    names = F.when(F.size("founder_names") > 0, F.col("founder_names")).otherwise(F.array(F.lit("Unknown founder")))
    role, background = F.lit(UNKNOWN).alias("role"), F.lit("Unknown — requires manual research").alias("background")
    note = F.when(F.size("traction_signals") > 0, F.concat(F.lit("Signals only: "), F.array_join("traction_signals", "; "), F.lit(" (unrated — needs analyst review)"))).otherwise("Unknown — not yet researched")
    return candidates.select(
        F.concat(F.lit("disc-"), F.col("id")).alias("id"),
        F.col("company_name").alias("name"),
        F.coalesce(known(F.col("pitch")), F.lit("Unknown — pitch not yet verified")).alias("one_liner"),
        vertical.alias("vertical"),
        F.coalesce(known(F.col("subcategory")), F.lit("Unclassified — requires manual review")).alias("subcategory"),
        "stage",
        F.col("hq_city").alias("city"),
        F.coalesce(known(F.col("hq_state")), F.lit("??")).alias("state"),
        year.alias("founded_year"),
        year.isNotNull().alias("founded_known"),
        F.greatest(F.lit(1), F.coalesce("founder_count", F.lit(1))).alias("team_size"),
        known(F.col("website")).alias("website"),
        known(F.col("public_funding")).alias("raising"),
        known(F.col("accelerator")).alias("accelerator"),
        F.when(F.col("funding_date").rlike(DAY), F.col("funding_date")).alias("last_funding_date"),
        F.struct(F.lit(0).alias("level"), note.alias("note")).alias("traction"),
        F.transform(names, lambda n: F.struct(n.alias("name"), role, background)).alias("founders"),
        F.transform("evidence", lambda e: F.struct(e["claim"].alias("claim"), e["source"].alias("source"), e["url"].alias("url"), e["accessed"].alias("date"), F.lit("Database record").alias("type"))).alias("evidence"),
    )


def why_current(kind: Column, date: Column) -> Column:
    said = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in WHY_CURRENT.items()), F.lit(OTHER_KIND))
    return F.when(date.isNull(), UNDATED).otherwise(F.replace(said, F.lit("{}"), date))


def deal_evidence(candidates: DataFrame) -> DataFrame:
    """One dated row for each item of a candidate's evidence.

    The source's own date counts first, then the day of access if it isn't
    the day of retrieval, then the funding date. Sources of the third tier
    may assert no amount.
    """
    rows = candidates.select("id", "source_id", "public_funding", "funding_date", F.col("discovered_at").alias("retrieved_at"), F.explode("evidence").alias("e"))
    own = F.coalesce(F.col("e.published_at").cast("string"), F.when(F.col("e.accessed").rlike(DAY) & (F.col("e.accessed") != F.col("retrieved_at")), F.col("e.accessed")))
    dated = F.coalesce(own, F.when(F.col("funding_date").rlike(DAY), F.col("funding_date")))
    tier, kind = tier_of(F.col("source_id")), opportunity_of(F.col("source_id"))
    sure, amount = tier <= 2, known(F.col("public_funding"))
    return rows.select(
        F.col("id").alias("candidate_id"),
        kind.alias("opportunity_type"),
        "source_id",
        F.col("e.source").alias("source_name"),
        tier.alias("tier"),
        F.col("e.url").alias("url"),
        dated.alias("published_at"),
        "retrieved_at",
        F.col("e.claim").alias("summary"),
        why_current(kind, F.coalesce(own, "funding_date")).alias("why_current"),
        F.when(sure, amount_usd(amount)).alias("amount_usd"),
        F.when(sure, amount).alias("amount_text"),
    )


def founder_slots(founders: Column, most: int = 5) -> Column:
    """The first ``most`` founders with a full name, without roles that say nothing; more than that has no slot."""
    fits = F.filter(founders, lambda f: is_full_name(f["name"]) & ~matches(f["name"], r"(?i)\bunknown\b"))
    return F.slice(F.transform(fits, lambda f: F.struct(f["name"].alias("name"), job_title(f["role"]).alias("job_title"))), 1, most)


def job_title(role: Column) -> Column:
    """Empty for the word that importers write where no role was stated."""
    return F.when(F.trim(F.coalesce(role, F.lit(""))).rlike(r"(?i)^unknown\z"), "").otherwise(role)


def missing_info(website: Column, raising: Column, accelerator: Column, city: Column, state: Column, any_email: Column, any_identity: Column) -> Column:
    """Whether a record lacks something that a reader looks for."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return empty(website) | empty(raising) | empty(accelerator) | F.coalesce((city == UNKNOWN) & (state == "??"), F.lit(False)) | ~F.coalesce(any_email, F.lit(False)) | ~F.coalesce(any_identity, F.lit(False))
