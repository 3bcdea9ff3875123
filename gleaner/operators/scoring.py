"""The fit score: ten components, normalised over what could be judged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import clamp, half_up, lookup, matches

# Points by stage.
STAGE_POINTS = {
    "Seed": 15, "Pre-seed": 12, "Series A": 9, "Stealth": 7, "Pre-launch": 11, "Bootstrapped": 8, "Grant-funded": 8,
    "Early-stage — round not publicly disclosed": 9, "Series B+": 3, "Stage conflict — manual review required": 5, "Unknown": 5,
}
UNKNOWABLE_STAGES = ("Unknown", "Stage conflict — manual review required")
# Components in order, and the most points of each.
COMPONENTS = {"thesis": 20, "stage": 15, "mission": 15, "traction": 10, "founder": 10, "geo": 10, "funding": 5, "validation": 5, "evidence": 5, "recency": 5}
REQUIRED = ("thesis", "stage", "traction", "founder", "geo")
HOT, TRACK = 8.0, 6.5
PRIOR_FOUNDER = r"found(ed|er)|co-found|started a|built .{0,24}(startup|company)|exited"
RELEVANT_PAST = r"engineer|research|phd|clinic|director|operator|led |head of|scientist|product|ex-|veteran of|big tech|google|meta|amazon|microsoft|stripe"


def component(key: str, points: Column, assessable: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), points.cast("int").alias("points"), F.lit(COMPONENTS[key]).alias("most"), F.coalesce(assessable, F.lit(False)).alias("assessable"))


def components(today: Column, subcategories: Mapping[str, str], preferred_states: Sequence[str]) -> Column:
    """The ten components of a company row; ``subcategories`` maps names to "core" or "exception".

    The row has subcategory, stage, traction struct<level, note>, founders
    array<struct<name, background, identity struct<latino_led, female_led,
    other>>>, state, raising, last_funding_date, accelerator and evidence
    array<struct<source, url, date, type>>. Identity counts only where it is
    recorded, never inferred.
    """
    sub = lookup(F.col("subcategory"), subcategories)
    researched = sub.isNull() & (F.col("subcategory") != "") & ~F.lower("subcategory").rlike("unclassified|unknown")
    thesis = F.when(sub == "core", 20).when(sub == "exception", 12).when(researched, 16).otherwise(5)
    identity = F.filter(F.transform("founders", lambda f: f["identity"]), lambda i: i.isNotNull())
    any_of = lambda field: F.coalesce(F.exists(identity, lambda i: i[field]), F.lit(False))
    mission = F.when(any_of("latino_led"), 8).otherwise(0) + F.when(any_of("female_led"), 4).otherwise(0) + F.when(any_of("other"), 3).otherwise(0)
    note = F.trim("traction.note")
    n = F.size("founders")
    past = F.filter(F.transform("founders", lambda f: F.trim(F.coalesce(f["background"], F.lit("")))), lambda b: (b != "") & ~b.rlike("(?i)^unknown"))
    said = F.lower(F.array_join(past, " "))
    founder = F.when(n.between(2, 5), 4).when(n >= 1, 1).otherwise(0) + F.when(said.rlike(PRIOR_FOUNDER), 4).otherwise(0) + F.when(said.rlike(RELEVANT_PAST), 2).otherwise(0)
    named = F.exists("founders", lambda f: ~F.lower(f["name"]).contains("unknown"))
    funded, funded_at = F.coalesce(F.col("raising"), F.lit("")) != "", F.col("last_funding_date")
    funding = F.when(funded, 3).otherwise(0) + F.when(F.date_diff(today, funded_at) <= 365, 2).when(funded_at.isNotNull(), 1).otherwise(0)
    of_type = lambda *types: F.size(F.filter("evidence", lambda e: e["type"].isin(*types)))
    validation = F.when(F.coalesce(F.col("accelerator"), F.lit("")) != "", 3).otherwise(0) + F.when(of_type("Accelerator") > 0, 1).otherwise(0) + F.when(of_type("Filing") > 0, 1).otherwise(0)
    newest = F.array_max(F.transform("evidence", lambda e: e["date"]))
    age = F.date_diff(today, newest)
    recency = F.when(newest.isNull(), 0).when(age <= 30, 5).when(age <= 90, 4).when(age <= 180, 3).when(age <= 365, 2).otherwise(1)
    return F.array(
        component("thesis", thesis, sub.isNotNull() | researched),
        component("stage", lookup(F.col("stage"), STAGE_POINTS, 5), ~F.col("stage").isin(*UNKNOWABLE_STAGES)),
        component("mission", F.least(mission, F.lit(15)), F.size(identity) > 0),
        component("traction", clamp(half_up(F.col("traction.level")), 0, 10), (F.col("traction.level") > 0) | ~matches(note, r"(?i)^unknown|not yet researched|\bunrated\b")),
        component("founder", F.least(founder, F.lit(10)), named | (F.size(past) > 0)),
        component("geo", F.when(F.col("state").isin(*preferred_states), 10).when(F.col("state") == "??", 2).otherwise(4), F.col("state") != "??"),
        component("funding", F.least(funding, F.lit(5)), funded | funded_at.isNotNull()),
        component("validation", F.least(validation, F.lit(5)), F.lit(True)),
        component("evidence", F.least(F.size("evidence") + of_type("Filing", "Founder statement"), F.lit(5)), F.lit(True)),
        component("recency", recency, newest.isNotNull()),
    )


def evidence_confidence(today: Column) -> Column:
    """How well sourced a record is: breadth, primary share, distinct sources and freshness."""
    n = F.size("evidence")
    primary = F.size(F.filter("evidence", lambda e: e["type"].isin("Filing", "Founder statement")))
    sources = F.size(F.array_distinct(F.transform("evidence", lambda e: e["source"])))
    newest = F.array_max(F.transform("evidence", lambda e: e["date"]))
    fresh = F.coalesce(F.greatest(F.lit(0.0), 1 - F.date_diff(today, newest) / 365.0), F.lit(0.0))
    share = F.when(n > 0, primary / n).otherwise(0.0)
    return half_up(0.4 * F.least(n, F.lit(4)) / 4 + 0.2 * share + 0.2 * F.least(sources, F.lit(3)) / 3 + 0.2 * fresh, 2)


def normalised(parts: Column) -> dict[str, Column]:
    """Score and completeness from an array of components: only what could be judged counts."""
    judged = F.filter(parts, lambda c: c["assessable"])
    total = lambda field: F.aggregate(judged, F.lit(0), lambda a, c: a + c[field])
    missing = F.filter(F.array(*map(F.lit, REQUIRED)), lambda k: ~F.exists(judged, lambda c: c["key"] == k))
    return {
        "assessable_points": total("most"),
        "earned": total("points"),
        "completeness": half_up(total("most") / 100.0, 2),
        "score": F.when(total("most") > 0, F.greatest(F.lit(1.0), half_up(total("points") / total("most") * 100.0) / 10.0)).otherwise(1.0),
        "missing_critical": missing,
    }


def fit_score(companies: DataFrame, today: Column, subcategories: Mapping[str, str], preferred_states: Sequence[str]) -> DataFrame:
    """Companies with components, score, completeness, provisional and evidence_confidence."""
    with_parts = companies.withColumn("components", components(today, subcategories, preferred_states))
    scored = with_parts.withColumns(normalised(F.col("components")))
    cited = F.size(F.array_distinct(F.filter(F.transform("evidence", lambda e: F.trim(e["url"])), lambda u: u != "")))
    provisional = (F.size("missing_critical") > 0) | (F.col("completeness") < 0.6) | (cited < 1)
    return scored.withColumn("provisional", provisional).withColumn("evidence_confidence", evidence_confidence(today))


def strongest_and_weakest(parts: Column) -> tuple[Column, Column]:
    """Keys of the components with the highest and the lowest share of their points; the first of equals."""
    judged = F.filter(parts, lambda c: c["assessable"])
    shares = F.transform(F.when(F.size(judged) > 0, judged).otherwise(parts), lambda c, i: F.struct((c["points"] / c["most"]).alias("s"), (-i).alias("i"), c["key"].alias("k")))
    low = F.transform(shares, lambda x: F.struct(x["s"].alias("s"), (-x["i"]).alias("i"), x["k"].alias("k")))
    return F.array_max(shares)["k"], F.array_min(low)["k"]
