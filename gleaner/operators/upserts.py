"""Upserts, provenance and histories as folds over appended rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import lookup

# How much each origin of a field's value is trusted.
ORIGIN_RANK = {"verified": 5, "user": 4, "extracted": 3, "ai": 2, "unverified": 1, "missing": 0}


def origin_rank(origin: Column) -> Column:
    return lookup(origin, ORIGIN_RANK, 0)


def current_fields(updates: DataFrame, keys: Sequence[str], origin: str = "origin", seq: str = "seq", manual: str | None = None) -> DataFrame:
    """The value that stands for each key after all ``updates`` in order.

    A weaker origin never overwrites a stronger one, an equal one does; a
    manual override always does, and what follows is measured against it.
    So: the last override counts as the start, and after it the strongest
    origin's last value stands. One map-side combined aggregate.
    """
    rest = [c for c in updates.columns if c not in keys]
    if manual is None:
        order = F.struct(origin_rank(F.col(origin)), F.col(seq))
        return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, "_v.*")
    ranked = updates.withColumn("_rank", origin_rank(F.col(origin)))
    # The override itself keeps its own rank for what comes after it.
    start = ranked.groupBy(*keys).agg(F.max(F.when(F.col(manual), F.struct(F.col(seq).alias("at"), "_rank"))).alias("_start"))
    later = ranked.join(start, list(keys)).where(F.col("_start").isNull() | ((F.col(seq) >= F.col("_start.at")) & (F.col("_rank") >= F.col("_start._rank"))))
    return later.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_rank", seq)).alias("_v")).select(*keys, "_v.*")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], preserve: Sequence[str] = ()) -> DataFrame:
    """Incoming rows replace current ones of the same key; columns in ``preserve`` keep their current value.

    ``incoming`` has one row a key. One full outer join; both sides are
    shuffled on the key once.
    """
    cols = [c for c in current.columns if c not in keys]
    a = current.select(*keys, F.struct(*cols).alias("_old"))
    b = incoming.select(*keys, F.struct(*cols).alias("_new"))
    joined = a.join(b, list(keys), "full")
    pick = lambda c: F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).when(F.col("_old").isNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}" if c in preserve else f"_new.{c}"))
    return joined.select(*keys, *(pick(c).alias(c) for c in cols)).select(current.columns)


def insert_new(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current rows and those incoming whose key isn't there yet, the first of each key."""
    fresh = incoming.join(current.select(*keys), list(keys), "left_anti")
    rest = [c for c in fresh.columns if c not in keys]
    firsts = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, "_v.*").select(current.columns)
    return current.unionByName(firsts)


def backfilled(rows: DataFrame, keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """One row a key: the first, with the first value that isn't null; a value once there is never replaced."""
    rest = [c for c in rows.columns if c not in (*keys, value)]
    agg = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_v"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col(seq))).alias(value))
    return agg.select(*keys, "_v.*", value).select(rows.columns)


def first_decision(decisions: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Decisions are written once: the first of each key stands."""
    rest = [c for c in decisions.columns if c not in keys]
    return decisions.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_v")).select(*keys, "_v.*")


def merged_into(rows: DataFrame, merges: DataFrame, key: str, url: str, seq: str) -> DataFrame:
    """Rows of merged entities under their survivor; of rows with one URL the first stays.

    ``merges``: from_id, to_id.
    """
    moved = rows.join(merges, rows[key] == merges["from_id"], "left").select(*(F.coalesce("to_id", key).alias(key) if c == key else F.col(c) for c in rows.columns))
    rest = [c for c in rows.columns if c not in (key, url)]
    return moved.groupBy(key, url).agg(F.min_by(F.struct(*rest), seq).alias("_v")).select(key, url, "_v.*").select(rows.columns)


def with_previous(log: DataFrame, key: str, seq: str, value: str, into: str = "previous", start: object = None) -> DataFrame:
    """Each entry of an append-only log with the value it replaced."""
    w = Window.partitionBy(key).orderBy(seq)
    return log.withColumn(into, F.lag(value, 1, start).over(w))


def bulk_change(requested: DataFrame, current: DataFrame, key: str, status: str, blocked: Sequence[str]) -> DataFrame:
    """What a bulk change does to each requested row: changed, not-found or skipped."""
    joined = requested.select(key).distinct().join(current.select(key, F.col(status).alias("_status"), F.lit(True).alias("_there")), key, "left")
    return joined.select(key, F.when(F.col("_there").isNull(), "not-found").when(F.col("_status").isin(*blocked), "skipped").otherwise("changed").alias("outcome"))


def refresh_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, before, after, change): updated, conflicting or unchanged, for each field of records in both."""
    a = old.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))).alias("a")).select(key, "a.field", F.col("a.v").alias("before"))
    b = new.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))).alias("b")).select(key, "b.field", F.col("b.v").alias("after"))
    change = F.when(F.col("after").isNull() | F.col("before").eqNullSafe(F.col("after")), "unchanged").when(F.col("before").isNull(), "updated").otherwise("conflicting")
    return a.join(b, [key, "field"]).withColumn("change", change)


def merge_within_run(candidates: DataFrame, key: str, seq: str, unknown: Sequence[str], arrays: Sequence[str], best: Sequence[str]) -> DataFrame:
    """One candidate per key: the first, unknown fields filled from later ones, arrays united, the best of ``best``.

    The exact-key form of merging; ``key`` is the domain, or else the name key.
    """
    first_known = lambda c: F.min_by(F.nullif(F.col(c), F.lit("Unknown")), F.when(F.col(c) != "Unknown", F.col(seq)))
    return candidates.groupBy(key).agg(
        F.min(seq).alias(seq),
        *(F.coalesce(first_known(c), F.lit("Unknown")).alias(c) for c in unknown),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in arrays),
        *(F.max(c).alias(c) for c in best),
        F.count(F.lit(1)).alias("n_merged"),
    )
