"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows. A stretch of text within k
edits of a window of n characters shares at least n + 1 - q(k + 1) of the
window's q-grams with it, all on diagonals that lie at most k apart. So the
q-grams that a text shares with a window are counted in overlapping bands of
diagonals; bands that reach the bound are regions to verify, by an alignment
that is confined to the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, fresh, read_table, written

#: Characters of a q-gram; eight of them fill a word when each is cut to a byte.
Q = 8
_HITS = "item_id long, window_start int, start long, stop long, edits int"


@dataclass(frozen=True)
class Limits:
    """What counts as contamination.

    ``rate``: edits a window may hold, as a share of its characters.
    ``window`` and ``step``: how items are cut; shorter items are one window,
    and the last window ends with the item, so any excerpt of ``window`` +
    ``step`` - 1 characters holds a whole one. ``least_chars``: items that are
    shorter, when normalised, are sought without edits and between word bounds
    only; those under Q characters have no q-gram and are not sought.
    ``slice_chars``: characters of the benchmark that a task holds at once; a
    larger benchmark is sought slice by slice.
    """

    rate: float = 0.1
    window: int = 64
    step: int = 16
    least_chars: int = 40
    slice_chars: int = 4_000_000

    def edits(self, n: int) -> int:
        """Fewer where the bound would otherwise ask for no q-gram at all."""
        return max(0, min(int(self.rate * n), n // Q - 2))


def _lowered(text: str) -> str:
    low = text.lower()
    # A few letters grow when lowered; they stay, so that places can be told.
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_SPACES = np.zeros(0x110000, bool)
_SPACES[[c for c in range(0x3001) if chr(c).isspace()]] = True


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, lowered and with runs of white space as one space, and where each was in ``text``."""
    codes = np.frombuffer(_lowered(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _SPACES[codes]
    keep = ~blank
    if len(codes):
        keep[1:] |= blank[1:] & ~blank[:-1]
        keep[0] = not blank[0]
    at = np.flatnonzero(keep)
    out = codes[at].copy()
    out[blank[at]] = 32
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def _qgrams(codes: np.ndarray) -> np.ndarray:
    """Words of eight characters cut to a byte each: equal q-grams give equal words."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    cut = np.ascontiguousarray((codes ^ (codes >> np.uint32(8))).astype(np.uint8))
    return np.ndarray((len(cut) - Q + 1,), "<u8", cut.data, strides=(1,)).astype(np.uint64)


class Index:
    """Windows of benchmark items by q-gram."""

    def __init__(self, items: list[tuple[int, str]], limits: Limits):
        self.limits = limits
        self.windows: list[tuple[int, int, np.ndarray]] = []
        grams, owner, place = [], [], []
        for item, text in items:
            codes, at = normalised(text or "")
            if len(codes) < Q:
                continue
            last = max(0, len(codes) - limits.window)
            for a in sorted({*range(0, last, limits.step), last}):
                part = codes[a : a + limits.window]
                g = _qgrams(part)
                owner.append(np.full(len(g), len(self.windows), np.int32))
                place.append(np.arange(len(g), dtype=np.int32))
                grams.append(g)
                self.windows.append((item, int(at[a]), part))
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.ends = np.append(self.first[1:], len(every))
        self.owner = np.concatenate(owner)[order] if grams else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, np.int32)
        self.bits = max(16, min(26, 6 + int(len(self.grams)).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.grams)] = True
        n = np.array([len(w[2]) for w in self.windows] or [0])
        self.short = n < limits.least_chars
        self.edits = np.where(self.short, 0, [limits.edits(x) for x in n.tolist()])
        self.needed = n + 1 - Q * (self.edits + 1)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def shared(self, codes: np.ndarray, most_held: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, diagonal, place in the text) of every q-gram shared with a window."""
        found = []
        for a in range(0, len(codes), 1 << 20):
            g = _qgrams(codes[a : a + (1 << 20) + Q - 1])
            at = np.flatnonzero(self.seen[self._slot(g)])
            if len(at):
                k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
                hit = self.grams[k] == g[at]
                found.append((at[hit] + a, k[hit]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        at, k = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(k):
            return (np.zeros(0, np.int64),) * 3
        # Frequent q-grams are in many windows: counted stretch by stretch first, and only windows with enough are kept.
        cuts = np.searchsorted(np.cumsum(self.ends[k] - self.first[k]), np.arange(0, int((self.ends[k] - self.first[k]).sum()), most_held))
        parts = [(at[a:b], k[a:b]) for a, b in zip(cuts, [*cuts[1:], len(k)], strict=True) if b > a]
        keep = None
        if len(parts) > 1:
            per = sum(np.bincount(self.owner[self._places(x)[0]], minlength=len(self.windows)) for _, x in parts)
            keep = per >= self.needed
        out = []
        for places, x in parts:
            flat, n = self._places(x)
            window, where = self.owner[flat].astype(np.int64), np.repeat(places, n)
            diagonal = where - self.place[flat]
            mine = slice(None) if keep is None else keep[window]
            out.append((window[mine], diagonal[mine], where[mine]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries of the q-grams k, entries per q-gram)."""
        n = self.ends[k] - self.first[k]
        return np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum())), n

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, first diagonal, last diagonal) of the bands that reach the bound."""
        window, diagonal, at = self.shared(codes)
        if not len(window):
            return []
        # A window that shares too few in all has no band that shares enough.
        per = np.bincount(window, minlength=len(self.windows))
        keep = per[window] >= self.needed[window]
        window, diagonal, at = window[keep], diagonal[keep], at[keep]
        if not len(window):
            return []
        # Bands are twice as wide as the edits and start every such many diagonals: any spread fits in one.
        width = self.edits[window] + 1
        band = (diagonal + self.limits.window) // width
        wide = np.concatenate([band, band - 1]) + 1
        key = np.concatenate([window, window]) * np.int64(1 << 40) + wide
        keys, inverse = np.unique(key, return_inverse=True)
        # A q-gram that recurs within a band is one shared place of the text.
        pair = np.unique(inverse * np.int64(1 << 32) + np.concatenate([at, at]))
        counts = np.bincount(pair >> 32, minlength=len(keys))
        w = keys >> 40
        good = np.flatnonzero(counts >= self.needed[w])
        if not len(good):
            return []
        # Neighbouring bands of a window become one region, of eight bands at most.
        run = np.cumsum(np.append(True, np.diff(keys[good]) > 1))
        place = np.arange(len(good)) - np.searchsorted(run, run)
        heads = np.flatnonzero(place % 8 == 0)
        tails = np.append(heads[1:], len(good)) - 1
        start = ((keys & ((1 << 40) - 1)) - 1) * (self.edits[w] + 1) - self.limits.window
        return [(int(w[good[i]]), int(start[good[i]]), int(start[good[j]] + 2 * self.edits[w[good[j]]] + 1)) for i, j in zip(heads, tails, strict=True)]


def align(patterns: np.ndarray, stretches: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, stop) of the best place for each pattern in its stretch of text, on ``width`` diagonals.

    Patterns have n characters each and stretches n + width - 1. Cell (i, d)
    is the pattern's first i characters against the text that ends before
    i + d; start and end are free, so the text around the place costs
    nothing. A cell holds its cost above the diagonal on which it began.
    """
    n, one = patterns.shape[1], np.int64(1 << 24)
    steps = np.arange(width, dtype=np.int64) * one
    cell = np.tile(np.arange(width, dtype=np.int64), (len(patterns), 1))
    for i in range(n):
        cost = cell + (stretches[:, i : i + width] != patterns[:, i : i + 1]) * one
        # Leave out the pattern's character: from one diagonal up.
        np.minimum(cost[:, :-1], cell[:, 1:] + one, out=cost[:, :-1])
        # Skip text characters: along the row, each step costs one.
        cell = np.minimum.accumulate(cost - steps, axis=1) + steps
    k = np.argmin(cell, axis=1)
    best = cell[np.arange(len(cell)), k]
    return best >> 24, best & (one - 1), k + n


def _stands(codes: np.ndarray, a: int, pattern: np.ndarray) -> bool:
    """Whether the pattern is at a, with no letter or digit before or after it."""
    b = a + len(pattern)
    ends = [int(codes[i]) for i in (a - 1, b) if 0 <= i < len(codes)]
    return np.array_equal(codes[a:b], pattern) and not any(chr(c).isalnum() for c in ends)


Hit = tuple[int, int, int, int, int]
_OUTSIDE = np.uint32(0xFFFFFFFF)


def find(index: Index, texts: list[str | None], most_jobs: int = 2048) -> list[list[Hit]]:
    """Per text (item, place in the item, start, stop, edits): the best alignment of each window and region."""
    found: list[dict[tuple[int, int], tuple[int, int, int]]] = [{} for _ in texts]
    jobs: dict[tuple[int, int], list[tuple[int, int, int, np.ndarray]]] = {}
    waiting = 0

    def settle() -> None:
        for (n, width), group in jobs.items():
            most = max(1, (1 << 22) // width)
            for g in (group[i : i + most] for i in range(0, len(group), most)):
                patterns = np.stack([index.windows[w][2] for _, w, _, _ in g])
                for (t, w, low, _), e, a, b in zip(g, *(x.tolist() for x in align(patterns, np.stack([x[3] for x in g]), width)), strict=True):
                    if e <= index.edits[w]:
                        _keep(found[t], w, n, (e, low + a, low + b))
        jobs.clear()

    places: list[np.ndarray | None] = []
    for t, text in enumerate(texts):
        codes, at = normalised(text or "")
        regions = index.regions(codes)
        places.append(at if regions else None)
        for w, low, high in regions:
            low, high = low - 1, high + 1
            n, width = len(index.windows[w][2]), high - low + 1
            if index.short[w]:
                for a in range(max(low, 0), min(high, len(codes) - n) + 1):
                    if _stands(codes, a, index.windows[w][2]):
                        _keep(found[t], w, n, (0, a, a + n))
                continue
            # What lies outside the text equals nothing: to meet it costs what leaving the character out costs.
            part = np.full(n + width - 1, _OUTSIDE, np.uint32)
            a, b = max(0, low), min(len(codes), low + len(part))
            part[a - low : b - low] = codes[a:b]
            jobs.setdefault((n, width), []).append((t, w, low, part))
            waiting += 1
        if waiting >= most_jobs:
            settle()
            waiting = 0
    settle()
    out = []
    for at, best in zip(places, found, strict=True):
        # Where the alignment begins or ends outside the text, the text's own ends are meant.
        out.append(sorted((*index.windows[w][:2], int(at[min(max(a, 0), len(at) - 1)]), int(at[min(max(b, 1), len(at)) - 1]) + 1, e) for (w, _), (e, a, b) in best.items()) if best else [])
    return out


def _keep(best: dict, w: int, n: int, got: tuple[int, int, int]) -> None:
    """Of places found twice by overlapping regions, the one with fewer edits stays."""
    at = got[2] // n
    for k in ((w, at), (w, at - 1), (w, at + 1)):
        if k in best and abs(best[k][2] - got[2]) < n // 2:
            best[k] = min(best[k], got)
            return
    best[w, at] = got


def _slices(benchmark: DataFrame, item_col: str, text: str, limits: Limits) -> Iterator[tuple[list[tuple[int, str]], int]]:
    """(items, number of slices): at most about ``slice_chars`` characters of items at a time (or one longer item)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // limits.slice_chars)
    for k in range(n):
        yield [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()], n


def contaminations(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, window_start, start, stop, edits): every window of an item that a text holds.

    Places count characters of the raw texts; ``window_start`` is the
    window's place in its item. Case and the amount of white space don't
    matter. Null and empty texts and items hold nothing; repeated documents
    give repeated rows, repeated items count once; an empty benchmark or
    table gives no rows; other columns are ignored. A very long text is read
    whole, stretch by stretch.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {_HITS}"
    names = [id_col, *(x.split()[0] for x in _HITS.split(", "))]
    picked = docs.select(F.col(id_col), F.col(text).alias("_text"))
    # The driver holds one slice at a time; of several each one's rows are written.
    found: list[DataFrame] = []
    for items, n in _slices(benchmark, item_col, item_text, limits):
        rows = picked.mapInArrow(_seek(items, limits, names), schema)
        found.append(written(rows, "contaminations") if n > 1 else rows)
    return reduce(DataFrame.unionByName, found, docs.sparkSession.createDataFrame([], schema))


def _seek(items: list[tuple[int, str]], limits: Limits, names: list[str]):
    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, limits)
        for batch in batches:
            rows, at = [], []
            for k, hits in enumerate(find(index, batch.column(1).to_pylist())):
                rows += hits
                at += [k] * len(hits)
            item, window, start, stop, edits = zip(*rows, strict=True) if rows else ([],) * 5
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(window, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(edits, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return seek


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of ``benchmark`` in every document; nulls, repeats and empty tables as in :func:`contaminations`."""
    return contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def without_contamination(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that hold no window of any item.

    Null and empty texts hold nothing and stay, as do null ids; repeated rows
    stay or go together, and repeated items count once. A very long text is
    read whole. An empty benchmark takes nothing, an empty table gives no
    rows; other columns stay as they are, whatever their names. Of a benchmark
    beyond one slice each slice reads the documents once more.
    """
    flag = fresh(docs, "clean")
    for items, n in _slices(benchmark, "item_id", "text", limits):
        before, docs = docs, docs.withColumn(flag, _free_of(items, limits)(F.col(text))).where(F.col(flag)).drop(flag)
        if n > 1:
            docs = written(docs, "clean")
            drop_written(before)
    return docs


def _free_of(items: list[tuple[int, str]], limits: Limits):
    @F.arrow_udf("boolean")
    def free(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(items, limits)
        for texts in batches:
            yield pa.array([not hits for hits in find(index, texts.to_pylist())], pa.bool_())

    return free
