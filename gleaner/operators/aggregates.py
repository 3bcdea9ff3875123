"""Breakdowns, KPIs and ledgers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import in_period, week_start
from ..functions.money import share
from .graph import components, with_checkpoints


def breakdown(rows: DataFrame, key: str, dimension: DataFrame, dim_key: str, other: str = "unassigned") -> DataFrame:
    """Counts for every key of the dimension, zeros included; keys outside it count as ``other``."""
    counts = rows.groupBy(F.col(key).alias(dim_key)).agg(F.count(F.lit(1)).alias("n"))
    inside = dimension.select(dim_key).join(counts, dim_key, "left").select(dim_key, F.coalesce("n", F.lit(0)).alias("n"))
    outside = counts.join(dimension.select(dim_key), dim_key, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(other).alias(dim_key), "n")
    return inside.unionByName(outside)


def entity_kpis(entities: DataFrame, now: Column, created: str, touched: str, status: str, score: str, provisional: str, terminal: Sequence[str], stale_days: int = 7, hot: float = 8.0) -> DataFrame:
    """One row: found this week, awaiting review, all, stale and hot, in a single pass."""
    day = F.lit(86_400_000_000)
    stale = (F.unix_micros(now) - F.unix_micros(F.col(touched).cast("timestamp")) >= stale_days * day) & ~F.col(status).isin(*terminal)
    return entities.agg(
        F.count_if((F.col(created) >= week_start(now)) & (F.col(created) < week_start(now) + F.expr("interval 7 days"))).alias("this_week"),
        F.count_if(F.col(status) == "new").alias("awaiting_review"),
        F.count(F.lit(1)).alias("cumulative"),
        F.count_if(stale).alias("stale"),
        F.count_if((F.col(score) >= hot) & ~F.col(provisional)).alias("hot"),
    )


def count_by_period(rows: DataFrame, at: str, now: Column, periods: Sequence[str] = ("all-time", "this-month", "last-month", "this-year", "last-year")) -> DataFrame:
    """One row per period; all in a single pass."""
    one = rows.agg(*(F.count_if(in_period(F.col(at), p, now)).alias(p) for p in periods))
    return one.select(F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.col(f"`{p}`").alias("n")) for p in periods))).alias("x")).select("x.*")


def source_analytics(results: DataFrame, source: str, outcome: str, duration: str, found: str, at: str, dimension: DataFrame) -> DataFrame:
    """Per registered source: runs by outcome, failure rate without skips, mean duration, finds, last success and failure.

    Outcomes: success, failed, skipped. Sources that never ran have zeros and nulls.
    """
    is_ = lambda x: F.col(outcome) == x
    agg = results.groupBy(source).agg(
        F.count(F.lit(1)).alias("appearances"),
        F.count_if(is_("success")).alias("success"),
        F.count_if(is_("failed")).alias("failed"),
        F.count_if(is_("skipped")).alias("skipped"),
        F.floor(F.avg(duration) + 0.5).alias("avg_duration"),
        F.sum(F.when(is_("success"), F.col(found))).alias("found"),
        F.max(F.when(is_("success"), F.col(at))).alias("last_success"),
        F.max(F.when(is_("failed"), F.col(at))).alias("last_failure"),
    )
    joined = dimension.select(source).join(agg, source, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("appearances", "success", "failed", "skipped", "found")]
    return joined.select(source, *counts, share(F.col("failed"), F.col("success") + F.col("failed")).alias("failure_rate"), "avg_duration", "last_success", "last_failure")


def health(state: Column, appearances: Column, failure_rate: Column, last_failed: Column) -> Column:
    """A source's health from its registration and its record."""
    return (
        F.when(state == "unavailable", "blocked")
        .when(state.isin("planned", "credentials-required"), "disabled")
        .when(appearances == 0, "enabled")
        .when(failure_rate >= 1, "failed")
        .when((failure_rate > 0) | last_failed, "degraded")
        .otherwise("healthy")
    )


def grouping_counts(rows: DataFrame, keys: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """All single-key breakdowns in one pass: (dimension, key, measures)."""
    stacked = rows.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.coalesce(F.col(k).cast("string"), F.lit("none")).alias("key")) for k in keys))).alias("_g"))
    return stacked.groupBy(F.col("_g.dimension").alias("dimension"), F.col("_g.key").alias("key")).agg(*measures)


def diversity(items: DataFrame, source: str, family: str, tier: str) -> DataFrame:
    """Counts and shares by source, family and tier, with a warning where one source has over 40 %."""
    counts = grouping_counts(items, [source, family, tier], [F.count(F.lit(1)).alias("n")])
    total = items.agg(F.count(F.lit(1)).alias("total"))
    # One row.
    return counts.join(F.broadcast(total)).select("dimension", "key", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), ((F.col("dimension") == source) & (F.col("n") / F.col("total") > 0.4)).alias("warns"))


def usage_breakdown(usage: DataFrame, keys: Sequence[str], sums: Sequence[str], actual: str, estimated: str) -> DataFrame:
    """Calls, sums and cost by each key at once; the actual cost where it is known."""
    cost = F.sum(F.coalesce(F.col(actual), F.col(estimated)))
    return grouping_counts(usage, keys, [F.count(F.lit(1)).alias("calls"), *(F.sum(c).alias(c) for c in sums), F.coalesce(cost, F.lit(0.0)).alias("cost")])


def budget_level(spent: Column, limit: Column, warn: float = 0.75, warn_again: float = 0.9) -> Column:
    return F.when(spent >= limit, "exhausted").when(spent >= limit * warn_again, "warn-again").when(spent >= limit * warn, "warn").otherwise("ok")


def floor_quantiles(rows: DataFrame, groups: Sequence[str], value: str, quantiles: Mapping[str, float], most: int = 100_000, cells: int = 1024) -> DataFrame:
    """sorted[min(n - 1, floor(n p))] of each group, without interpolation, in a column for each of ``quantiles``.

    Values are counted first. A group of up to ``most`` distinct ones is
    sorted; for others the span of values that can hold a quantile is cut into
    ``cells``, whose counts tell which of them does, until few enough values
    are left. So one group may hold all rows, or all distinct values, and no
    task sorts more than ``most``. Nulls and NaN don't count as values, null
    groups do count; groups without values are left out.
    """
    with_checkpoints(rows.sparkSession)
    names = [f"_g{i}" for i in range(len(groups))]
    same = lambda a, b: reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names), F.lit(True))
    keyed = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), F.col(value).cast("double").alias("_x"), F.col(value).alias("_v"))
    counts = keyed.groupBy(*names, "_x", "_v").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("_q"), F.lit(float(p)).alias("_p")) for k, p in quantiles.items())))
    sizes = counts.groupBy(*names).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_left"), F.min("_x").alias("_low"), F.max("_x").alias("_high")).select("*", wanted.alias("_w")).select("*", "_w.*").drop("_w")
    spans = sizes.select(*names, "_q", F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.col("_p"))).alias("_at"), "_left", "_low", "_high", F.lit(0).cast("long").alias("_below")).checkpoint()
    inside = lambda s: counts.alias("c").join(s.alias("s"), same({n: F.col(f"c.{n}") for n in names}, {n: F.col(f"s.{n}") for n in names}) & F.col("c._x").between(F.col("s._low"), F.col("s._high"))).select("s.*", "c._x", "c._v", "c._n")
    while True:
        wide = spans.where((F.col("_left") > most) & (F.col("_low") < F.col("_high")))
        if not wide.limit(1).count():
            break
        cell = F.least(F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * cells), F.lit(cells - 1))
        sums = inside(wide).groupBy(*wide.columns, cell.alias("_cell")).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_in"), F.min("_x").alias("_from"), F.max("_x").alias("_to"))
        run = sums.withColumn("_upto", F.col("_below") + F.sum("_n").over(Window.partitionBy(*names, "_q").orderBy("_cell")))
        hit = run.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
        narrow = hit.select(*names, "_q", "_at", F.col("_in").alias("_left"), F.col("_from").alias("_low"), F.col("_to").alias("_high"), (F.col("_upto") - F.col("_n")).alias("_below"))
        spans = spans.where((F.col("_left") <= most) | (F.col("_low") >= F.col("_high"))).unionByName(narrow).checkpoint()
    last = inside(spans).withColumn("_upto", F.col("_below") + F.sum("_n").over(Window.partitionBy(*names, "_q").orderBy("_x")))
    found = last.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
    one = found.groupBy(*names).agg(*(F.max(F.when(F.col("_q") == k, F.col("_v"))).alias(k) for k in quantiles))
    return one.select(*(F.col(n).alias(g) for g, n in zip(groups, names, strict=True)), *quantiles)


def histogram(rows: DataFrame, code: str) -> DataFrame:
    return rows.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def conflicts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys for which the values disagree, and how many there are."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def independent_counts(items: DataFrame, group: str, order: str, host: str, fingerprint: str) -> DataFrame:
    """(group, n_independent): how many items of a group tell something new, in order.

    As :func:`independent_sources`, for groups of any size. Items meet only
    through hosts and fingerprints, so each component of the graph of both is
    judged by itself, in order, with the hosts and fingerprints seen so far in
    memory; a host and fingerprint that repeat go once. Null hosts and empty
    or null fingerprints are not compared. Null groups are a group.
    """
    with_checkpoints(items.sparkSession)
    h, f, g = F.col(host), F.nullif(F.col(fingerprint), F.lit("")), F.coalesce(F.col(group).cast("string"), F.lit(""))
    rows = items.select(F.col(group).alias("_group"), F.concat(F.lit("h"), g, F.lit("\x00"), h).alias("_h"), F.concat(F.lit("f"), g, F.lit("\x00"), f).alias("_f"), F.col(order).alias("_order"))
    alone = F.col("_h").isNull() & F.col("_f").isNull()
    firsts = rows.where(~alone).groupBy("_group", "_h", "_f").agg(F.min("_order").alias("_order")).checkpoint()
    linked = components(firsts, "_h", "_f")
    placed = firsts.withColumn("node", F.coalesce("_h", "_f")).join(linked, "node", "left").withColumn("_part", F.coalesce("component", "node"))
    sorted_ = placed.repartition("_part").sortWithinPartitions("_part", "_order").select("_group", "_part", "_order", "_h", "_f")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, hosts, prints = None, set(), set()
        for frame in batches:
            out = []
            for now, name, mark in zip(frame["_part"], frame["_h"], frame["_f"], strict=True):
                if now != part:
                    part, hosts, prints = now, set(), set()
                new = name not in hosts and mark not in prints
                if new:
                    hosts.update([name] if name is not None else [])
                    prints.update([mark] if mark is not None else [])
                out.append(new)
            yield pd.DataFrame({"_group": frame["_group"], "_new": out})

    kind = items.schema[group].dataType.simpleString()
    judged = sorted_.mapInPandas(judge, f"_group {kind}, _new boolean")
    every = judged.unionByName(rows.where(alone).select("_group", F.lit(True).alias("_new")))
    return every.groupBy("_group").agg(F.count_if("_new").alias("n_independent")).withColumnRenamed("_group", group)


def independent_sources(evidence: Column) -> Column:
    """How many of an array<struct<host, fingerprint>> tell something new, in order.

    An item is skipped if its host, or its fingerprint where it has one, was
    seen; skipped items are not remembered.
    """
    start = F.struct(F.array().cast("array<string>").alias("hosts"), F.array().cast("array<string>").alias("prints"), F.lit(0).alias("n"))
    kind = "struct<hosts:array<string>,prints:array<string>,n:int>"

    def step(acc: Column, x: Column) -> Column:
        again = F.array_contains(acc["hosts"], x["host"]) | ((x["fingerprint"] != "") & F.array_contains(acc["prints"], x["fingerprint"]))
        grown = F.struct(F.concat(acc["hosts"], F.array(x["host"])).alias("hosts"), F.concat(acc["prints"], F.when(x["fingerprint"] != "", F.array(x["fingerprint"])).otherwise(F.array().cast("array<string>"))).alias("prints"), (acc["n"] + 1).alias("n"))
        return F.when(F.coalesce(again, F.lit(False)), acc).otherwise(grown).cast(kind)

    return F.aggregate(evidence, start.cast(kind), step, lambda a: a["n"])


def founder_kpis(founders: DataFrame, scores: DataFrame, last_run: Column, now: Column, least: float = 8.0, days: int = 7) -> DataFrame:
    """(vertical, last_run, discovered_this_week, awaiting_review, stale, hot, cumulative), one row per vertical.

    Founders have company_id, vertical, run_id, first_seen_at, reviewed_at
    and decision; a score (company_id, score, provisional) is their company's
    latest. Hot leaves out rejected founders and provisional scores. Stale
    counts from the last review, else from the first sight. One aggregate
    over one join: companies are many, scores one row for each.
    """
    week = F.date_trunc("week", now)
    touched = F.coalesce("reviewed_at", "first_seen_at").cast("timestamp")
    hot = (F.col("decision").isNull() | (F.col("decision") != "rejected")) & ~F.col("_p") & (F.col("_s") >= least)
    rows = founders.join(scores.select("company_id", F.col("score").alias("_s"), F.col("provisional").alias("_p")), "company_id", "left")
    seen = F.col("first_seen_at").cast("timestamp")
    return rows.groupBy("vertical").agg(
        F.count_if(F.col("run_id") == last_run).alias("last_run"),
        F.count_if((seen >= week) & (seen < week + F.expr("interval 7 days"))).alias("discovered_this_week"),
        F.count_if(F.col("decision").isNull()).alias("awaiting_review"),
        F.count_if(touched <= now - F.expr(f"interval {days} days")).alias("stale"),
        F.count_if(F.coalesce(hot, F.lit(False))).alias("hot"),
        F.count(F.lit(1)).alias("cumulative"),
    )
