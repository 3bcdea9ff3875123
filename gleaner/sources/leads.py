"""Landed answers of directories, papers, code hosts and launch sites as leads of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import batch_date, iso_date
from ..functions.places import city_and_state
from ..functions.sectors import sector_of

#: Columns of a lead and their types; what a source doesn't tell is null.
LEAD = (
    "source_id string, source_name string, source_url string, external_id string, company_name string, company_website string, company_domain string, "
    "description string, vertical string, subcategory string, stage string, hq_city string, hq_state string, founder_names array<string>, accelerator string, "
    "funding_amount double, funding_amount_text string, last_funding_date string, traction_signals array<string>, evidence_text string, published_at string, "
    "discovered_at string, confidence double"
)
URL = r"(?i)^https?://[^\s/?#]+\S*\z"


def _leads(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*(columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (x.split(" ", 1) for x in LEAD.split(", "))))


def _site(url: Column) -> Column:
    return F.when(url.rlike(URL), url)


def directory_leads(companies: DataFrame, now: str, date_from: str | None = None, directory: str = "https://www.ycombinator.com/companies/") -> DataFrame:
    """Leads of an accelerator's directory: name, slug, url, website, oneLiner, longDescription, batch, status, industries, tags, locations.

    Inactive companies go, and those of batches before ``date_from``; a
    batch that can't be read is a gap of the listing, not a sign of age.
    """
    batch = batch_date(F.col("batch"))
    rows = companies.where(F.coalesce("status", F.lit("Active")) != "Inactive")
    if date_from is not None:
        rows = rows.where(batch.isNull() | (batch >= F.lit(date_from).cast("date")))
    labels = F.concat(F.coalesce("industries", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>")))
    some = F.size(labels) > 0
    sector = sector_of(F.array_join(labels, ", "))
    place = city_and_state(F.coalesce(F.get("locations", F.lit(0)), F.lit("")))
    in_batch = F.coalesce(F.concat(F.lit(", batch "), F.col("batch")), F.lit(""))
    told = F.concat_ws(" — ", F.nullif("oneLiner", F.lit("")), F.nullif("longDescription", F.lit("")))
    return _leads(
        rows,
        source_id=F.lit("yc"),
        source_name=F.lit("Y Combinator public directory"),
        source_url=F.coalesce(_site(F.col("url")), F.concat(F.lit(directory), F.coalesce("slug", F.concat(F.lit("?q="), F.url_encode("name"))))),
        company_name=F.col("name"),
        company_website=_site(F.col("website")),
        description=F.nullif(F.substring(told, 1, 500), F.lit("")),
        vertical=F.when(sector["confidence"] >= 0.5, sector["label"]),
        subcategory=F.when(some, F.array_join(F.slice(labels, 1, 3), ", ")),
        hq_city=place["city"],
        hq_state=place["state"],
        accelerator=F.concat(F.lit("Y Combinator"), F.coalesce(F.concat(F.lit(" ("), F.col("batch"), F.lit(")")), F.lit(""))),
        evidence_text=F.concat_ws(
            " ",
            F.concat(F.lit("Listed in the public YC directory"), in_batch, F.lit(".")),
            F.when(some, F.concat(F.lit("YC categories: "), F.array_join(labels, ", "), F.lit("."))),
            F.concat(F.lit("YC one-liner: "), F.nullif("oneLiner", F.lit(""))),
        ),
        published_at=batch.cast("string"),
        discovered_at=F.lit(now),
        confidence=F.lit(0.7),
    )


def paper_leads(papers: DataFrame, now: str) -> DataFrame:
    """One lead for each author with an affiliation: id, title, published, authors array<struct<name, affiliation>>."""
    rows = papers.select("id", "title", "published", F.explode("authors").alias("a")).where(F.trim(F.coalesce("a.affiliation", F.lit(""))) != "")
    said = F.concat(F.lit('arXiv submission "'), F.col("title"), F.lit('" lists author "'), F.col("a.name"), F.lit('"\'s affiliation as "'), F.col("a.affiliation"), F.lit('".'))
    return _leads(
        rows, source_id=F.lit("research"), source_name=F.lit("arXiv (public research publications)"), source_url=F.col("id"), external_id=F.col("id"), company_name=F.col("a.affiliation"),
        founder_names=F.array("a.name"), description=F.col("title"), evidence_text=said, published_at=iso_date(F.col("published")).cast("string"), discovered_at=F.lit(now), confidence=F.lit(0.3),
    )


def repository_leads(repositories: DataFrame, now: str) -> DataFrame:
    """Leads of repositories that organizations own: name, html_url, description, pushed_at, owner struct<login, type>, readme."""
    rows = repositories.where(F.col("owner.type") == "Organization")
    said = F.concat(F.lit('Public GitHub organization "'), F.col("owner.login"), F.lit('" has recent activity on repository '), F.col("name"), F.lit("."), F.coalesce(F.concat(F.lit(" README: "), F.nullif("readme", F.lit(""))), F.lit("")))
    return _leads(
        rows, source_id=F.lit("github"), source_name=F.lit("GitHub public API"), source_url=F.col("html_url"), external_id=F.concat_ws("/", "owner.login", "name"), company_name=F.col("owner.login"),
        description=F.col("description"), traction_signals=F.array(F.concat(F.lit("Active public repository: "), F.col("name"))), evidence_text=said, published_at=F.col("pushed_at"), discovered_at=F.lit(now), confidence=F.lit(0.4),
    )


def launch_leads(launches: DataFrame, now: str) -> DataFrame:
    """Leads of product launches: id, name, url, website, tagline, votes, created_at, makers array<string>."""
    upvotes = F.concat(F.col("votes").cast("string"), F.lit(" Product Hunt upvotes"))
    return _leads(
        launches, source_id=F.lit("producthunt"), source_name=F.lit("Product Hunt"), source_url=F.col("url"), external_id=F.col("id"), company_name=F.col("name"), company_website=_site(F.col("website")),
        founder_names=F.col("makers"), description=F.col("tagline"), traction_signals=F.when(F.col("votes") > 0, F.array(upvotes)).otherwise(F.array().cast("array<string>")),
        evidence_text=F.concat(F.lit("Launched on Product Hunt"), F.coalesce(F.concat(F.lit(': "'), F.col("tagline"), F.lit('"')), F.lit("")), F.lit(".")), published_at=F.col("created_at"), discovered_at=F.lit(now), confidence=F.lit(0.5),
    )


def event_leads(events: DataFrame, now: str) -> DataFrame:
    """Leads of accepted financing events (see ``functions.funding``)."""
    rows = events.where("rejection is null")
    return _leads(
        rows, source_id=F.lit("funding-news"), source_name=F.concat(F.col("publisher"), F.lit(" (public RSS)")), source_url=F.col("link"), external_id=F.col("link"), company_name=F.col("company_name"),
        stage=F.when(F.col("round_type").isin("Pre-seed", "Seed", "Series A"), F.col("round_type")), hq_city=F.col("hq_city"), hq_state=F.col("hq_state"), funding_amount=F.col("amount_usd"), funding_amount_text=F.col("amount_text"),
        last_funding_date=F.col("announced_at").cast("string"), evidence_text=F.col("excerpt"), published_at=F.col("announced_at").cast("string"), discovered_at=F.lit(now), confidence=F.lit(0.55),
    )
