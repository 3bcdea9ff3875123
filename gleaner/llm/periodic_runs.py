"""Periodic runs of words, found by probing a harmonic grid.

A stretch of length l and period p with l >= t * p holds t - 1 neighbouring
multiples jp whose words equal those at (j + 1)p. Probing only these costs
n/p comparisons for a period, hence n log n for all of them; what survives is
extended to both sides by comparing growing slices, and grid points within a
run that is known are skipped.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, read_table

_WORD = re.compile(WORD)
_FOUND = "array<struct<start:bigint,length:bigint,period:bigint>>"
_BATCH_CHARS = 1 << 22


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """Leading places at which both agree, by slices that double."""
    n, at, width = min(len(x), len(y)), 0, 32
    while at < n:
        upto = min(n, at + width)
        differ = x[at:upto] != y[at:upto]
        if differ.any():
            return at + int(differ.argmax())
        at, width = upto, width * 2
    return n


def _candidates(a: np.ndarray, low: int, high: int, chain: int) -> np.ndarray:
    """Periods from low to high for which ``chain`` neighbouring grid points agree.

    Goes along the grid for all periods at a time, so that short grids of
    long periods cost a few array operations and not one each.
    """
    n = len(a)
    streak = np.zeros(high - low + 1, np.int64)
    found = np.zeros(high - low + 1, bool)
    for j in range(n):
        last = min(high, (n - 1) // (j + 1))
        if last < low:
            break
        m = last - low + 1
        here = a[j * low : j * last + 1 : j] if j else np.full(m, a[0])
        there = a[(j + 1) * low : (j + 1) * last + 1 : j + 1]
        streak[:m] = np.where(here == there, streak[:m] + 1, 0)
        found[:m] |= streak[:m] >= chain
    return np.flatnonzero(found) + low


def runs_of(words: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    ``words`` holds a number for each word. A run is a stretch of smallest
    period p and length ``max(least, times * p)`` or more that no neighbour
    extends; ``times`` is 3 or more.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    a, n = words, len(words)
    if n < max(least, times):
        return []
    top, chain = n // times, times - 1
    found: dict[tuple[int, int], int] = {}
    longest: list[tuple[int, int, int]] = []  # (-length, start, period)
    narrow = min(top, int(n**0.5))
    periods = list(range(1, narrow + 1))
    if top > narrow:
        periods += _candidates(a, narrow + 1, top, chain).tolist()
    for p in periods:
        grid = a[::p]
        equal = grid[1:] == grid[:-1]
        if len(equal) < chain:
            continue
        together = equal[chain - 1 :].copy()
        for k in range(chain - 1):
            together &= equal[k : len(equal) - chain + 1 + k]
        at = np.flatnonzero(together) * p
        if not at.size:
            continue
        for minus, start, q in longest:  # what lies in a run whose period divides p is that run
            if -minus <= chain * p:
                break
            if p % q == 0:
                at = at[(at < start) | (at + chain * p >= start - minus)]
        while at.size:
            i = int(at[0])
            begin = i - _agreeing(a[:i][::-1], a[p : i + p][::-1])
            end = i + _agreeing(a[i : n - p], a[i + p :])
            length = end + p - begin
            if length >= max(least, times * p) and (begin, length) not in found:
                found[begin, length] = p
                insort(longest, (-length, begin, p))
            at = at[np.searchsorted(at, end) :]
    return sorted((s, m, p) for (s, m), p in found.items())


def _numbered(words: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _kept(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [w for w, depth in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not depth]


def _short_batches(batches: Iterator, most: int = _BATCH_CHARS) -> Iterator:
    """The same rows, so few at a time that their texts stay under ``most`` bytes, or one by one.

    Each batch holds arrays, the last of them the texts.
    """
    for arrays in batches:
        sizes = np.frombuffer(arrays[-1].cast(pa.large_string()).buffers()[1], np.int64, len(arrays[-1]) + 1, 8 * arrays[-1].offset) if len(arrays[-1]) else np.zeros(1, np.int64)
        at = 0
        while at < len(arrays[-1]):
            upto = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
            yield tuple(x.slice(at, upto - at) for x in arrays)
            at = upto


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4, into: str = "runs", collapsed: str | None = "collapsed") -> DataFrame:
    """``docs`` with its texts' runs, as an array of (start, length, period) in words, and texts without their repeats.

    Words are what lies between spaces and U+0009 to U+000D. ``collapsed`` has
    the words that no run contains after its first period, joined by a space;
    None leaves it out. Null and empty texts have an empty array and an empty
    collapsed text. Rows are read one by one: repeated rows, null keys and
    extra columns are left as they are, while columns with the new names are
    an error. A very long text is one row's work, in memory a few times its
    size. No rows give no rows.
    """
    clash = {x.lower() for x in (into, collapsed) if x} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist")

    @F.arrow_udf(f"runs {_FOUND}, kept string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            runs, kept = [], []
            for (some,) in _short_batches([(texts,)]):
                for t in some.to_pylist():
                    words = _WORD.findall(t or "")
                    runs.append(runs_of(_numbered(words), least, times))
                    kept.append(" ".join(_kept(words, runs[-1])))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
            flat = np.array([r for each in runs for r in each], np.int64).reshape(-1, 3)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts), pa.array(kept, pa.string())], names=["runs", "kept"])

    at = fresh(docs, "found")
    out = docs.withColumn(at, found(F.col(text))).withColumn(into, F.col(f"{at}.runs"))
    return (out.withColumn(collapsed, F.col(f"{at}.kept")) if collapsed else out).drop(at)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` whose texts are made periodic from some word on, for one id in ten.

    With h the id's crc32 and g a tenth of it, texts of n > 0 words and h
    divisible by 10 repeat the p = 1 + (n - a) // (3 + g % 8) words from
    a = g % n to their end; these texts have single spaces then. All others,
    null ids and null texts included, stay as they are.
    """

    @F.arrow_udf("string")
    def repeated(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for arrays in batches:
            out = []
            for ids, texts in _short_batches([arrays]):
                for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
                    h = 1 if i is None else crc32(i.encode())
                    if h % 10 == 0 and t and (words := _WORD.findall(t)):
                        g, n = h // 10, len(words)
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        block = words[a : a + p]
                        t = " ".join(words[:a] + (block * (-(-(n - a) // p)))[: n - a])
                    out.append(t)
            yield pa.array(out, pa.string())

    return docs.withColumn(text, repeated(F.col(id_col).cast("string"), F.col(text)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with the greatest of them and digests of all and of the text without repeats.

    The greatest has the largest exact length over period, then the smallest
    start, then period; four nulls without any. Null and empty texts have
    none; every row of the table gives one row.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = periodic_runs(with_repeats(docs)).drop("text")
    # a/b > c/d by whole numbers: a product of two word counts is far below 2^63.
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])
    greatest = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    best = runs.withColumn("best", greatest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
