"""Sharding by a minimax contiguous partition.

Groups of equal texts are atoms, ordered by content digest. The smallest
capacity for which a greedy left-to-right filling needs no more than the
given number of shards is found by binary search, and the order is cut there.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop_written, read_table, text_or_empty, written


def text_size(text: str | Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.octet_length(text_or_empty(text)) + 8).cast("long")


def _greedy(points: list[int], starts: list[int], capacity: int, n: int, hopeful: bool = False) -> list[int] | None:
    """Ends of at most n shards over the prefix sums ``points``, or None.

    Between ``starts[i]`` and ``points[i]`` there may be prefix sums that
    aren't known; if ``hopeful``, one is taken to lie wherever it would help.
    """
    ends, at = [], 0
    while at < points[-1]:
        reach = at + capacity
        i = bisect_right(points, reach)
        end = reach if hopeful and i < len(points) and starts[i] <= reach else points[i - 1]
        if len(ends) == n or end <= at:
            return None
        at = end
        ends.append(at)
    return ends


def smallest_capacity(points: list[int], starts: list[int], n: int, least: int, hopeful: bool = False) -> int:
    """The least capacity of at least ``least`` with which ``points`` fill n shards."""
    low, high = max(least, -(-points[-1] // n)), points[-1]
    while low < high:
        mid = (low + high) // 2
        if _greedy(points, starts, mid, n, hopeful) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _windows(points: list[int], low: int, high: int, n: int) -> list[tuple[int, int]]:
    """Where the ends of greedy shards can lie for capacities from low to high.

    ``points`` are prefix sums of which some between may be missing, so an
    end may lie anywhere before the point that follows its bound.
    """
    spans, first, last = [], 0, 0
    for _ in range(n):
        first = points[max(0, bisect_right(points, first + low) - 1)]
        reach = last + high
        i = bisect_right(points, reach)
        last = min(reach, points[i] if i < len(points) else points[-1])
        spans.append((first, last))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def minimax_cuts(prefixes: DataFrame, n: int, most_points: int = 100_000) -> tuple[int, list[int]]:
    """Smallest capacity and the prefix sums after which greedy shards end.

    ``prefixes`` has one row per group: ``size`` and ``prefix``, the running
    sum of sizes through it. The driver holds at most about ``most_points``
    prefix sums at a time, the largest of each of as many equal spans. They
    bound the capacity from both sides, hence the places where an end can
    lie; only these are then looked at more closely, until none is unknown.
    """
    top = prefixes.agg(F.max("prefix"), F.max("size")).first()
    if top[0] is None:
        return 0, []
    total, largest = int(top[0]), int(top[1])
    known: dict[int, int] = {0: 0, total: total}
    spans, low, width = [(0, total)], max(largest, -(-total // n)), total
    while True:
        # Always finer than before, and at last every prefix sum by itself.
        width = max(1, min(-(-sum(b - a for a, b in spans) // most_points), width // 2))
        # Of a cell that reaches into a span only what lies beyond it is still in doubt.
        kept = {p: max([q, *(b + 1 for _, b in spans if q <= b < p)]) for p, q in known.items() if not any(a <= p <= b for a, b in spans)}
        known = {0: 0, total: total} | kept | _largest_in_spans(prefixes, spans, width)
        points = sorted(known)
        starts = [known[p] for p in points]
        low = smallest_capacity(points, starts, n, low, hopeful=True)
        high = smallest_capacity(points, starts, n, low)
        if high == low:
            return high, _greedy(points, starts, high, n)
        spans = _windows(points, low, high, n)


def _largest_in_spans(prefixes: DataFrame, spans: list[tuple[int, int]], width: int) -> dict[int, int]:
    """The largest prefix of each cell of ``width`` in ``spans``, and the smallest beside it."""
    inside, cell = F.lit(False), F.lit(None).cast("long")
    p = F.col("prefix")
    for k, (a, b) in enumerate(spans):
        inside = inside | p.between(a, b)
        cell = F.when(p.between(a, b), F.floor((p - a) / F.lit(width)) * len(spans) + k).otherwise(cell)
    rows = prefixes.where(inside).groupBy(cell.alias("cell")).agg(F.max("prefix").alias("p"), F.min("prefix").alias("q")).select("p", "q").collect()
    return {r["p"]: r["q"] for r in rows}


def group_prefixes(docs: DataFrame, key: str, size: str, buckets: int) -> DataFrame:
    """(key, size, prefix) per distinct ``key``, in its order.

    ``key`` is a uniform hex digest: its leading digits deal the groups into
    ordered buckets whose totals give every bucket its offset, so no task
    sorts more than one bucket.
    """
    groups = docs.groupBy(key).agg(F.sum(size).alias("size"))
    digits = max(1, (max(2, buckets) - 1).bit_length() + 3 >> 2)
    groups = written(groups.withColumn("bucket", F.conv(F.substring(key, 1, digits), 16, 10).cast("int")), "groups")
    # At most 16^digits rows, whatever the input.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.groupBy("bucket").agg(F.sum("size").alias("all")).withColumn("offset", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    within = Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    running = groups.withColumn("within", F.sum("size").over(within))
    out = written(running.join(offsets, "bucket").select(key, "size", (F.col("within") + F.col("offset")).alias("prefix")), "prefixes")
    drop_written(groups)
    return out


def shards(docs: DataFrame, n: int = 24, text: str = "text", id_col: str = "doc_id", buckets: int = 1024, slots: int = 256) -> DataFrame:
    """``docs`` with columns size, content_digest, shard and slot.

    Rows with equal texts share a shard; shards are runs of the digest order
    and the largest has the least possible bytes. ``slot`` numbers a shard's
    rows from 0 without gaps. Null texts count as empty. A group larger than
    a fair share fills a shard of its own; fewer groups than shards leave
    the last shards empty. Repeated rows get slots of their own, ties between
    them go either way. A very long text is one size like any other. An empty
    table gives no rows; a column named as a new one is an error.
    """
    clash = {"size", "content_digest", "shard", "slot", "_piece", "_start"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    keyed = docs.withColumn("size", text_size(text)).withColumn("content_digest", F.sha2(text_or_empty(text).cast("binary"), 256))
    prefixes = group_prefixes(keyed.select("content_digest", "size"), "content_digest", "size", buckets)
    _, ends = minimax_cuts(prefixes, n)
    # n - 1 digests at most: the last of each shard.
    cuts = [r[0] for r in prefixes.where(F.col("prefix").isin(ends[:-1])).select("content_digest").collect()] if len(ends) > 1 else []
    drop_written(prefixes)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("content_digest") > c).cast("int")
    keyed = keyed.withColumn("shard", shard)
    # Number in pieces by id: a third of all rows may be one group.
    piece = F.pmod(F.xxhash64(F.col(id_col)), F.lit(slots)).cast("int")
    counts = keyed.groupBy("shard", piece.alias("_piece")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_piece").orderBy(F.col(id_col), "content_digest")
    # starts has at most n * slots rows.
    placed = keyed.withColumn("_piece", piece).join(F.broadcast(starts), ["shard", "_piece"])
    return placed.withColumn("slot", (F.row_number().over(order) - 1 + F.col("_start")).cast("long")).drop("_piece", "_start")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of 24, by the law ``bytes``; nulls, repeats and empty tables as in :func:`shards`."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = docs.withColumn("text_crc32", F.crc32(text_or_empty("text").cast("binary")))
    return shards(crc).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )
