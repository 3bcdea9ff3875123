"""The table of companies as a reader narrows and orders it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decisions import is_live
from .filters import has_text
from .qualification import is_operating

UNCLASSIFIED = "company-lead"


@dataclass(frozen=True)
class Wanted:
    """What a reader asks for; what isn't set lets all pass, but for quarantined records."""

    verticals: tuple[str, ...] = ()
    stage: str | None = None
    state: str | None = None
    possible_duplicates: bool = False
    missing_info: bool = False
    least_evidence_confidence: float = 0.0
    assessed: bool = False
    needs_diligence: bool = False
    promising: bool = False
    untouched_days: int | None = None
    quarantined_too: bool = False
    classification: str | None = None
    live: bool = False
    leads: bool = False
    primary_source: str | None = None
    tier: int | None = None
    with_amount: bool = False
    with_round: bool = False
    uncorroborated: bool = False
    for_review: bool = False
    public_warning: bool = False
    fund_warning: bool = False
    evidence_since: str | None = None
    text: str = ""


def passes(wanted: Wanted, today: Column) -> Column:
    """Whether a row of :func:`company_table` is what a reader wants; what a row doesn't know fails what asks for it."""
    c = F.col
    sure = lambda x: F.coalesce(x, F.lit(False))
    kind = F.coalesce("classification", F.lit(UNCLASSIFIED))
    asked = [
        (bool(wanted.verticals), c("vertical").isin(*wanted.verticals)),
        (wanted.stage is not None, c("stage") == wanted.stage),
        (wanted.state is not None, c("state") == wanted.state),
        (wanted.possible_duplicates, c("possible_duplicate")),
        (wanted.missing_info, c("missing_info")),
        (wanted.least_evidence_confidence > 0, c("evidence_confidence") >= wanted.least_evidence_confidence),
        (wanted.assessed, ~c("provisional")),
        (wanted.needs_diligence, c("needs_diligence")),
        (wanted.promising, c("eligible")),
        (wanted.untouched_days is not None, F.date_diff(today, F.coalesce("last_refreshed", "discovered_at").cast("date")) >= (wanted.untouched_days or 0)),
        (not wanted.quarantined_too, ~sure(c("quarantined"))),
        (wanted.classification is not None, kind == wanted.classification),
        (wanted.live, is_live(kind)),
        (wanted.leads, ~is_live(kind)),
        (wanted.primary_source is not None, F.coalesce("primary_source", F.lit("none")) == wanted.primary_source),
        (wanted.tier is not None, c("primary_tier") == wanted.tier),
        (wanted.with_amount, c("amount_usd").isNotNull()),
        (wanted.with_round, F.coalesce("round_type", F.lit("")) != ""),
        (wanted.uncorroborated, ~sure(is_operating(F.coalesce("n_sources", F.lit(0)), F.coalesce("operating_level", F.lit("not-checked"))))),
        (wanted.for_review, c("qualification") == "human-review-required"),
        (wanted.public_warning, c("publicly_traded")),
        (wanted.fund_warning, c("fund_or_spv")),
        (wanted.evidence_since is not None, c("evidence_published_at") >= F.lit(wanted.evidence_since).cast("date")),
        (wanted.text.strip() != "", has_text(wanted.text, "name", "one_liner", "subcategory", "city", "state", "website", "founder_names")),
    ]
    out = F.lit(True)
    for on, condition in asked:
        out = out & sure(condition) if on else out
    return out


def company_table(rows: DataFrame, wanted: Wanted, today: Column) -> DataFrame:
    """The rows that a reader wants. One filter over a row of each company; nothing is joined or sorted."""
    return rows.where(passes(wanted, today))


def order_of(mode: str, id_col: str = "id") -> list[Column]:
    """Columns to order a table by: its newest evidence or discovery first, or the best scores, assessed ones before provisional; ties by id."""
    newest = {"evidence-recency": F.coalesce(F.col("newest_evidence").cast("date"), F.lit("1970-01-01").cast("date")), "discovery-date": F.coalesce(F.col("discovered_at").cast("date"), F.lit("1970-01-01").cast("date"))}
    if mode in newest:
        return [newest[mode].desc(), F.col(id_col)]
    return [F.col("provisional").asc(), F.col("score").desc(), F.col(id_col)]
