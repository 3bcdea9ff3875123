"""How widely a pipeline is sourced: breakdowns with shares, sectors with shortfalls, and the funnel of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import half_up, lookup
from .aggregates import floor_quantiles, grouping_counts
from .decisions import SOURCE_FAMILY, is_live

WARN_PERCENT, FAMILIES = 40.0, 3


def family_of(source: Column) -> Column:
    return lookup(source, SOURCE_FAMILY, "other")


def pipeline_diversity(companies: DataFrame) -> DataFrame:
    """(dimension, key, n, share, warns) of all companies by class and qualification, and of opportunities by source, family, tier and corroboration.

    Companies have classification (null: a lead), qualification,
    primary_source, primary_tier, n_sources and quarantined. An opportunity
    is live and not quarantined. Shares are per cent of all opportunities, to
    a tenth; a source or family with over 40 warns. Dimension ``total`` has
    companies, opportunities, leads, quarantined and those for review. One
    pass, combined before the shuffle.
    """
    kind = F.coalesce("classification", F.lit("company-lead"))
    hidden = F.coalesce("quarantined", F.lit(False))
    live = is_live(kind) & ~hidden
    marked = companies.select(
        kind.alias("classification"), "qualification", live.alias("_live"), hidden.alias("_hidden"), F.coalesce("primary_source", F.lit("none")).alias("source"), family_of(F.coalesce("primary_source", F.lit("none"))).alias("family"),
        F.concat(F.lit("tier"), F.coalesce(F.col("primary_tier").cast("string"), F.lit("-"))).alias("tier"), F.when(F.coalesce("n_sources", F.lit(0)) >= 2, "multi-source").otherwise("single-source").alias("corroboration"),
    )
    every, dealt = ("classification", "qualification"), ("source", "family", "tier", "corroboration")
    counts = grouping_counts(marked.where("qualification is not null"), every[1:], [F.count(F.lit(1)).alias("n")]).unionByName(grouping_counts(marked, every[:1], [F.count(F.lit(1)).alias("n")])).unionByName(grouping_counts(marked.where("_live"), dealt, [F.count(F.lit(1)).alias("n")]))
    sums = {"companies": F.count(F.lit(1)), "opportunities": F.count_if("_live"), "leads": F.count_if(~F.col("_live")), "quarantined": F.count_if("_hidden"), "for-review": F.count_if(F.col("qualification") == "human-review-required")}
    total = marked.agg(*(c.alias(k) for k, c in sums.items()))
    rows = total.select(F.explode(F.array(*(F.struct(F.lit("total").alias("dimension"), F.lit(k).alias("key"), F.col(f"`{k}`").alias("n")) for k in sums))).alias("r")).select("r.*")
    # One row.
    out = counts.unionByName(rows).crossJoin(F.broadcast(total.select(F.col("opportunities").alias("_of"))))
    share = F.when(F.col("dimension").isin(*dealt), F.when(F.col("_of") > 0, half_up(F.col("n") / F.col("_of") * 1000) / 10).otherwise(0.0))
    return out.select("dimension", "key", "n", share.alias("share"), (F.col("dimension").isin("source", "family") & (share > WARN_PERCENT)).alias("warns"))


def sector_diversity(shortlisted: DataFrame, sectors: DataFrame, target: int, sector: str = "vertical", source: str = "primary_source") -> DataFrame:
    """(sector, qualified, families, shortfall, warnings) of every one of ``sectors``: what is shortlisted, from how many families, and how many are missing."""
    found = shortlisted.select(sector, family_of(F.coalesce(source, F.lit("none"))).alias("_family")).groupBy(sector, "_family").agg(F.count(F.lit(1)).alias("_n")).groupBy(sector).agg(F.sum("_n").alias("qualified"), F.array_sort(F.collect_list("_family")).alias("families"))
    out = sectors.select(sector).distinct().join(found, sector, "left").select(sector, F.coalesce("qualified", F.lit(0)).alias("qualified"), F.coalesce("families", F.array().cast("array<string>")).alias("families"))
    out = out.withColumn("shortfall", F.greatest(F.lit(target) - F.col("qualified"), F.lit(0)))
    narrow = F.size("families").between(1, FAMILIES - 1)
    return out.withColumn("warnings", F.array_compact(F.array(F.when(narrow, F.lit("few-families")), F.when(F.col("shortfall") > 0, F.lit("short")))))


def funnel(assessed: DataFrame, runs: DataFrame, label: Sequence[str], hot: float = 8.0) -> DataFrame:
    """One row for each ``label`` of what runs fetched and dropped, and of what came through: counts, medians and quartiles.

    ``assessed`` has the labels, score (null if it can't be scored), eligible,
    provisional, n_evidence and n_sources; ``runs`` the labels and counters as
    ``discovery.counters`` has them. Labels without anything assessed have
    zeros and nulls. Quantiles are exact, for groups of any size.
    """
    label = list(label)
    summed = runs.groupBy(*label).agg(
        F.sum(F.col("accepted") + F.col("filtered_by_thesis") + F.col("filtered_by_quality")).alias("fetched"), *(F.sum(c).alias(c) for c in ("duplicates_identified", "filtered_by_thesis", "filtered_by_quality", "invalid"))
    )
    counted = assessed.groupBy(*label).agg(
        F.count(F.lit(1)).alias("surviving"), F.count_if(F.coalesce("eligible", F.lit(True))).alias("eligible"), F.count("score").alias("scorable"), F.count_if(F.coalesce("provisional", F.lit(False))).alias("provisional"),
        F.max("score").alias("max_score"), F.count_if(F.coalesce(F.col("score") >= hot, F.lit(False))).alias("hot"),
    )
    scores = floor_quantiles(assessed, label, "score", {"median_score": 0.5, "top_quartile_score": 0.75})
    medians = [floor_quantiles(assessed, label, c, {f"median_{c}": 0.5}) for c in ("n_evidence", "n_sources")]
    out = summed
    for part in (counted, scores, *medians):
        out = out.join(part, label, "left")
    return out.fillna(0, ["surviving", "eligible", "scorable", "provisional", "hot", "median_n_evidence", "median_n_sources"])
