"""Whether an issuer is an operating company: corroboration by independent sources, and a verdict with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import FUND_NAMES, entity_problem
from ..functions.rules import first_match, trimmed
from ..functions.urls import domain_key
from .decisions import FINANCING, family_of, operating_confidence

#: Independent accounts that count as corroboration; one is enough beside a page that shows the business.
LEAST_SOURCES = 2
# What results and levels of a page mean.
DISQUALIFYING = ("public-company", "investment-fund", "spv-or-project-entity", "corporate-subsidiary", "unverified-foreign-entity", "not-a-company-name")
DURABLE = ("not-a-company-name", "investment-fund", "spv-or-project-entity")
INCONCLUSIVE = ("thin", "unreachable", "not-checked", "undetermined", "unrelated")
LEVEL_REASONS = {
    "absent": "website-absent", "not-checked": "website-not-checked", "unreachable": "website-unreachable", "parked": "website-parked-or-placeholder",
    "thin": "website-thin-or-client-rendered", "unrelated": "website-unrelated-to-issuer", "undetermined": "website-not-interpretable",
    "identity-only": "website-identity-only", "substantive": "website-substantive-operating-evidence",
}
#: Sources whose records always carry an address.
WITH_ADDRESS = ("sec", "grants")


def is_disqualified(result: Column) -> Column:
    return result.isin(*DISQUALIFYING)


def is_durable(result: Column) -> Column:
    """Findings about the entity itself, which no later evidence revises."""
    return result.isin(*DURABLE)


def is_inconclusive(level: Column) -> Column:
    return level.isin(*INCONCLUSIVE)


def is_operating(n_sources: Column, level: Column) -> Column:
    return (n_sources >= 1) & (level == "substantive")


def corroboration_key(source: Column, name: Column) -> Column:
    """Whose account an item is: its family; for the press, the publisher that its name holds."""
    publisher = F.lower(F.regexp_extract(name, r"(?i)([a-z0-9-]+(?:\.[a-z0-9-]+)+)", 1))
    family = family_of(source)
    return F.when((family == "press") & (publisher != ""), F.concat(F.lit("press:"), publisher)).otherwise(family)


def own_words(source: Column, url: Column, site: Column) -> Column:
    """Why an item is no independent account; null if it may be one."""
    return F.when(family_of(source) == "web", "company-website").when(F.coalesce(domain_key(url) == domain_key(site), F.lit(False)), "own-domain")


def corroborations(evidence: DataFrame, companies: DataFrame, key: str = "company_id") -> DataFrame:
    """One row per company of ``companies`` (key, website): independent accounts and what was left out.

    Evidence has key, source_id, source_name, url, tier, opportunity_type and
    published_at. Of each account the strongest item speaks (then the first by
    url). Two aggregates, both combined before the shuffle; a company with a
    third of all items sends a row per account and task.
    """
    # The site travels to the evidence, not the evidence to one task per company.
    sited = evidence.join(companies.select(key, F.col("website").alias("_site")), key)
    marked = sited.select("*", own_words(F.col("source_id"), F.col("url"), F.col("_site")).alias("_own"), corroboration_key(F.col("source_id"), F.col("source_name")).alias("account"))
    strong = F.col("opportunity_type").isin(*FINANCING) & (F.col("tier") <= 2) & F.col("_own").isNull()
    per = marked.groupBy(key, F.when(F.col("_own").isNull(), F.col("account")).alias("account")).agg(
        F.min(F.struct("tier", "url", "source_id", "published_at")).alias("best"), F.count(F.lit(1)).alias("n"), F.max(strong.cast("int")).alias("strong"), F.max("published_at").alias("newest")
    )
    there = F.col("account").isNotNull()
    found = per.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(there, F.struct("account", F.col("best.source_id").alias("source_id"), F.col("best.url").alias("url"))))).alias("sources"),
        F.sum(F.when(~there, F.col("n")).otherwise(0)).alias("self_published"),
        (F.max("strong") == 1).alias("strong_financing"),
        F.max("newest").alias("newest"),
    )
    n = F.coalesce(F.size("sources"), F.lit(0))
    only = (n > 0) & F.forall("sources", lambda s: s["account"] == "regulatory")
    out = companies.select(key).join(found, key, "left")
    return out.select(
        key,
        F.coalesce("sources", F.array().cast(found.schema["sources"].dataType)).alias("sources"),
        F.greatest(n, F.lit(0)).alias("n_sources"),
        F.coalesce(only, F.lit(False)).alias("only_regulatory"),
        F.coalesce("self_published", F.lit(0)).cast("long").alias("self_published"),
        F.coalesce("strong_financing", F.lit(False)).alias("strong_financing"),
        "newest",
    )


def name_problem(name: Column) -> Column:
    """fund, spv or subsidiary where a filer's name is one's; null for others."""
    kind = first_match(trimmed(F.coalesce(name, F.lit(""))), FUND_NAMES)
    return F.when(kind.isNull(), None).when(kind.rlike("(?i)fund|partnership|asset|lending|manager"), "fund").when(kind.rlike("(?i)project|series|capacity|numbered"), "spv").otherwise("subsidiary")


def public_check(tickers: Column, forms: Column) -> Column:
    """struct<traded, ticker, periodic>: public means a ticker or periodic reports; a registration alone doesn't."""
    real = F.filter(F.coalesce(tickers, F.array().cast("array<string>")), lambda t: t != "")
    periodic = F.array_distinct(F.filter(F.coalesce(forms, F.array().cast("array<string>")), lambda f: f.rlike(r"^10-[KQ]\z")))
    return F.struct(((F.size(real) > 0) | (F.size(periodic) > 0)).alias("traded"), F.get(real, F.lit(0)).alias("ticker"), periodic.alias("periodic"))


def qualify(companies: DataFrame, corroboration: DataFrame, today: Column, key: str = "company_id") -> DataFrame:
    """(key, result, confidence, reasons): the first finding that applies, and all reasons in order.

    Companies have key, name, website, level, verified, one_liner, state,
    source_id, tickers and forms; ``corroboration`` is of
    :func:`corroborations`. A company without evidence has no account.
    """
    c = companies.join(corroboration, key, "left").select("*", name_problem(F.col("name")).alias("_kind"), (entity_problem(F.col("name")) == "person-possessive").alias("_possessive"), public_check(F.col("tickers"), F.col("forms")).alias("_public"))
    c = c.withColumns({
        "_nameless": F.coalesce("_possessive", F.lit(False)),
        "_n": F.coalesce("n_sources", F.lit(0)),
        "_strong": F.coalesce("strong_financing", F.lit(False)),
        "_year": F.coalesce(F.date_diff(today, F.col("newest").cast("date")) <= 365, F.lit(False)),
        "_level": F.coalesce("level", F.when(F.col("website").isNull(), "absent").otherwise("not-checked")),
        "_told": F.coalesce((F.length(F.trim("one_liner")) > 12) & ~F.col("one_liner").rlike("(?i)^unknown"), F.lit(False)),
        "_nowhere": F.coalesce(F.col("state") == "??", F.lit(False)),
        "_verified": F.coalesce("verified", F.lit(False)),
    })
    foreign = F.col("_nowhere") & F.coalesce(F.col("source_id").isin(*WITH_ADDRESS), F.lit(False)) & ~F.col("_verified")
    few = F.col("_n") < LEAST_SOURCES
    traded = F.col("_public.traded")
    result = (
        F.when(F.col("_nameless"), "not-a-company-name")
        .when(traded, "public-company")
        .when(F.col("_kind") == "fund", "investment-fund")
        .when(F.col("_kind") == "spv", "spv-or-project-entity")
        .when(F.col("_kind").isNotNull(), "corporate-subsidiary")
        .when(~F.col("_year"), "company-lead-requires-corroboration")
        .when(foreign & few, "unverified-foreign-entity")
        .when(~F.col("_verified") & ~F.col("_told") & few, "insufficient-evidence")
        .when(is_operating(F.col("_n"), F.col("_level")), "qualified-operating-company")
        .when(is_inconclusive(F.col("_level")) & (F.col("_strong") | ~few), "human-review-required")
        .otherwise("company-lead-requires-corroboration")
    )
    one = lambda yes, a, b=None: F.when(yes, a) if b is None else F.when(yes, a).otherwise(b)
    reasons = (
        one(F.col("_nameless"), "name-is-not-a-company"),
        F.when(F.col("_kind").isNotNull(), F.concat(F.lit("name-matches-"), F.col("_kind"), F.lit("-pattern"))),
        one(F.col("_year"), "filing-within-12-months", "filing-older-than-12-months"),
        one(F.col("_public.ticker").isNotNull(), "has-exchange-ticker"),
        one(F.size("_public.periodic") > 0, "files-periodic-reports"),
        one(F.coalesce("only_regulatory", F.lit(False)), "only-evidence-is-form-d"),
        one(F.coalesce(F.col("self_published") > 0, F.lit(False)), "self-published-evidence-excluded"),
        one(~few, "has-independent-corroboration", "no-independent-corroboration"),
        one(F.col("_strong"), "strong-financing-evidence", "no-strong-financing-evidence"),
        one(F.col("_verified"), "website-verified"),
        F.coalesce(*(F.when(F.col("_level") == k, v) for k, v in LEVEL_REASONS.items())),
        one(F.col("_level") == "substantive", "operating-evidence-confirmed", "operating-evidence-unconfirmed"),
        one(F.col("_told"), "product-or-service-described", "no-product-description"),
        one(foreign, "foreign-address-no-website"),
        one(F.col("_nowhere") & ~foreign, "jurisdiction-not-stated"),
    )
    confidence = operating_confidence(F.col("_level"), F.col("_verified"), F.col("_n"), F.col("_told"), traded | F.col("_kind").isNotNull() | F.col("_nameless"), F.col("_year"))
    return c.select(key, result.alias("result"), confidence.alias("confidence"), F.array_compact(F.array(*reasons)).alias("reasons"))
