"""Views and patches of records: status counts, ranking views, links by domain, founders and fixed options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import matches
from ..functions.urls import domain_key, host

# Outcomes of research that answer the question asked.
ANSWERED = ("found-candidate", "reached-no-founder-stated", "source-not-applicable")
# Options of a fixed list by stage, and names of accelerators on it.
ROUND_OPTIONS = {"Pre-seed": "Pre-Seed / Pre-Seed+", "Seed": "Seed / Seed+", "Series A": "Series A / Series A+", "Series B+": "Series B / Series B+"}
ACCELERATOR_OPTIONS = ("Techstars", "500 Global", "Y Combinator", "Plug & Play", "MassChallenge", "SOSV", "ERA", "Alchemist", "AngelPad", "StartX", "IndieBio", "Betaworks", "DreamIt", "Startupbootcamp", "HAX")


def is_answered(outcome: Column) -> Column:
    return outcome.isin(*ANSWERED)


def run_warnings(runs: DataFrame, results: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, is_partial, warning_count, affected_sources) of runs (key, status); only runs with warnings are partial."""
    bad = results.where(F.col("mode").isin("failed", "skipped")).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set("source_id")).alias("_s"))
    partial = F.col("status") == "Completed with warnings"
    none = F.array().cast("array<string>")
    return runs.join(bad, key, "left").select(key, partial.alias("is_partial"), F.when(partial, F.coalesce("_n", F.lit(0))).otherwise(0).cast("long").alias("warning_count"), F.when(partial, F.coalesce("_s", none)).otherwise(none).alias("affected_sources"))


def counts_by_status(entries: DataFrame, status: str, statuses: Sequence[str]) -> DataFrame:
    """(status, n) of every one of ``statuses``, zeros included, and of all; one aggregate row is unpivoted."""
    row = entries.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col(status) == s).alias(s) for s in statuses))
    return row.unpivot([], ["all", *statuses], status, "n")


def rescore_status(records: DataFrame, latest: DataFrame, version: str, key: str = "company_id") -> DataFrame:
    """One row: how many records have a score, of the current version or an older one, and old ones by version."""
    joined = records.select(key).join(latest.select(key, F.col("version").alias("_v")), key, "left")
    per = joined.groupBy("_v").agg(F.count(F.lit(1)).alias("n"))
    old = F.col("_v").isNotNull() & (F.col("_v") != version)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return per.agg(
        total(F.lit(True)).alias("total"), total(F.col("_v").isNotNull()).alias("scored"), total(F.col("_v").isNull()).alias("unscored"), total(F.col("_v") == version).alias("up_to_date"), total(old).alias("needs_rescore"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(old, F.struct("_v", "n"))))).alias("stale_by_version"),
    )


def note_counts(notes: DataFrame, key: str = "company_id") -> DataFrame:
    return notes.groupBy(key).agg(F.count_if(~F.col("archived")).alias("active"), F.count_if(F.col("archived")).alias("archived"))


def history_lost(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of ``before`` that ``after`` no longer has: none, if history is preserved."""
    return before.select(key).join(after.select(key), key, "left_anti")


def ranking_view(records: DataFrame, search: str = "", equal: Mapping[str, object] | None = None, show: str = "all", columns: Sequence[str] = ("name",), with_disqualified: bool = False, hot: float = 8.0) -> DataFrame:
    """Records that match, final scores before provisional ones, best first; ``show`` is all, top10 or highFit."""
    out = records if with_disqualified else records.where(~F.coalesce("quarantined", F.lit(False)))
    for c, value in (equal or {}).items():
        out = out.where(F.col(c) == F.lit(value))
    out = out.where(F.lower(F.concat_ws(" ", *columns)).contains(search.strip().lower()))
    if show == "highFit":
        out = out.where(~F.col("provisional") & (F.col("score") >= hot))
    out = out.orderBy("provisional", F.col("score").desc())
    return out.limit(10) if show == "top10" else out


def owner_of_url(pages: DataFrame, registry: DataFrame, url: str = "url", domain: str = "domain") -> DataFrame:
    """``pages`` with the entry of ``registry`` whose domain a page's host is on or below; the nearest domain counts.

    A host is joined by each of its endings, so the join is by equality.
    """
    h = host(F.col(url))
    hosts = pages.select(h.alias("_host")).where("_host is not null").distinct().withColumn("_labels", F.split("_host", r"\."))
    spread = hosts.select("_host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), "."))).alias("_far", domain))
    near = spread.join(registry, domain).groupBy("_host").agg(F.min_by(F.struct(*registry.columns), "_far").alias("owner"))
    return pages.withColumn("_host", h).join(near, "_host", "left").drop("_host")


def profile_match(slug: Column, website: Column, profile_slug: Column, profile_website: Column) -> Column:
    """slug, domain or none: how a directory's profile and a candidate are one; names never tell."""
    return F.when(F.coalesce(F.lower(slug) == profile_slug, F.lit(False)), "slug").when(F.coalesce(domain_key(website) == domain_key(profile_website), F.lit(False)), "domain").otherwise("none")


def is_placeholder(name: Column) -> Column:
    return (F.trim(F.coalesce(name, F.lit(""))) == "") | matches(F.coalesce(name, F.lit("")), r"(?i)\bunknown\b")


def resolved_founders(existing: Column, found: Column) -> Column:
    """``found`` people in place of ``existing`` ones, if these are only placeholders; each name once, letters decide."""
    key = lambda f: F.trim(F.regexp_replace(F.regexp_replace(F.lower(f["name"]), r"[^\p{L}\s]", ""), r"\s+", " "))
    keys = F.transform(found, key)
    first = F.filter(found, lambda f, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))
    real = F.exists(existing, lambda f: ~is_placeholder(f["name"]))
    return F.when(~F.coalesce(real, F.lit(False)) & (F.size(first) > 0), first).otherwise(existing)


def patched(records: DataFrame, patches: DataFrame, key: str, fields: Sequence[str], at: str) -> DataFrame:
    """``records`` with the last stated value of each field; what no patch states stays."""
    last = patches.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(at))).alias(f"_{f}") for f in fields))
    joined = records.join(last, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in records.columns))


def without_empty(values: Column) -> Column:
    """A map without keys whose value is null or empty."""
    return F.map_filter(values, lambda k, v: v.isNotNull() & (v != ""))


def accelerator_option(name: Column) -> Column:
    """The option that a free-text name holds, or that holds it; null for none."""
    n = F.lower(F.trim(name))
    return F.coalesce(*(F.when((n != "") & (n.contains(o.lower()) | F.lit(o.lower()).contains(n)), F.lit(o)) for o in ACCELERATOR_OPTIONS))


def round_option(stage: Column) -> Column:
    return F.coalesce(*(F.when(stage == k, F.lit(v)) for k, v in ROUND_OPTIONS.items()))


def caveats(provisional: Column, unassessed: Column, policy_flags: Column) -> Column:
    """What a reader of an exported row must know, joined."""
    return F.concat_ws(
        " | ",
        F.when(provisional, "PROVISIONAL: no company-descriptive component could be judged, so this score reflects only our own sourcing quality, not the company"),
        F.when(F.size(unassessed) > 0, F.concat(F.lit("Not assessed (excluded from the score, not scored zero): "), F.array_join(unassessed, ", "))),
        F.when(F.size(policy_flags) > 0, F.concat(F.lit("Policy flags for partner review: "), F.array_join(policy_flags, ", "))),
    )
