"""Latest rows, ranks and capped selections per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import half_up


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order``; keys may be null.

    A map-side aggregate of whole rows, so a key with a third of all rows
    sends one row from each task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(df.columns)


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(df.columns)


def latest_if(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Latest rows for which ``condition`` holds; earlier rows of a key never stand in."""
    return latest_per_key(df, keys, order).where(condition)


def latest_run(runs: DataFrame, condition: Column, order: Sequence[str]) -> DataFrame:
    """The one latest row that satisfies ``condition``."""
    return runs.where(condition).orderBy(*(F.col(c).desc() for c in order)).limit(1)


def change_from_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str = "delta") -> DataFrame:
    """The latest row of each key with its difference to the one before; null if there is none."""
    two = F.slice(F.sort_array(F.collect_list(F.struct(*order, value)), asc=False), 1, 2)
    # Two rows a key are enough, and partial results of more are cut per task.
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    top = df.withColumn("_n", F.row_number().over(w)).where("_n <= 2").groupBy(*keys).agg(two.alias("_two"))
    last, before = F.get("_two", 0), F.get("_two", 1)
    return top.select(*keys, *(last[c].alias(c) for c in order), last[value].alias(value), half_up(last[value] - before[value], 1).alias(into))


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[Column], into: str = "rank") -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts each task's groups to n before the shuffle."""
    return ranked(df, groups, order, "_rank").where(F.col("_rank") <= n).drop("_rank")


def shortlist(pool: DataFrame, group: str, family: str, source: str, order: Sequence[Column], caps: Mapping[str, int], size: int = 5) -> DataFrame:
    """Two-pass selection per group with a verdict for every contender.

    The first pass takes the best of each source family, the second fills up
    by rank; sources in ``caps`` get no more places than that. Rows gain
    ``rank``, ``picked`` and ``verdict`` (selected, source-family-cap,
    ranked-below-cutoff or sector-limit).

    In closed form: a contender within its source's cap comes up in the first
    pass if it leads its family, and otherwise in the second; sorting by
    (pass, rank) gives the order of selection.
    """
    w = Window.partitionBy(group)
    rows = pool.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    rows = rows.withColumn("_in_family", F.row_number().over(Window.partitionBy(group, family).orderBy("rank")))
    # Within a source, the family's leader comes first, then rank: the order in which the passes meet them.
    rows = rows.withColumn("_in_source", F.row_number().over(Window.partitionBy(group, source).orderBy((F.col("_in_family") != 1).cast("int"), "rank")))
    cap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col(source)), F.lit(1 << 30)) if caps else F.lit(1 << 30)
    rows = rows.withColumn("_capped", F.col("_in_source") > cap)
    turn = Window.partitionBy(group, "_capped").orderBy((F.col("_in_family") != 1).cast("int"), "rank")
    rows = rows.withColumn("_turn", F.row_number().over(turn)).withColumn("picked", ~F.col("_capped") & (F.col("_turn") <= size))
    # A cap is met only while places are left: before the last pick in the order of the passes.
    ordinal = F.struct((F.col("_in_family") != 1).cast("int").alias("a"), F.col("rank").alias("b"))
    last = F.max(F.when(F.col("picked"), ordinal)).over(w)
    n_picked = F.sum(F.col("picked").cast("int")).over(w)
    # The passes go on to the end while places are left, else they stop at the last pick.
    met = F.col("_capped") & ((n_picked < size) | (F.struct(F.lit(1).alias("a"), F.col("rank").alias("b")) < last) | ((F.col("_in_family") == 1) & (ordinal < last)))
    verdict = F.when(F.col("picked"), "selected").when(met, "source-family-cap").when(F.col("rank") > size, "ranked-below-cutoff").otherwise("sector-limit")
    return rows.withColumn("verdict", verdict).drop("_in_family", "_in_source", "_capped", "_turn")


def running_within(df: DataFrame, groups: Sequence[str], order: Sequence[str], amount: Column, budget: float, into: str = "admitted") -> DataFrame:
    """Whether each row still fits the group's budget when what came before counts, itself included."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(amount).over(w)).withColumn(into, F.col("spent") <= budget)
