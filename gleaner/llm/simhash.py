"""SimHash near-duplicates by anchor points of a covering code.

The anchors are the words of a product code on the 64 fingerprint bits: two
perfect Golay codes (23 bits, covering radius 3), a perfect Hamming code (15
bits, radius 1) and three bits on which the only word is zero. Every
fingerprint is at home at the anchor within the radius in each block. If two
fingerprints differ in at most t bits, e_b of them in block b, the home of
one is within (radius_b + e_b) of the other in every block, and the e_b add
up to t or less. So fingerprints are replicated to every anchor within the
radius plus a share of t, and compared only with those that meet them there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, fresh, join_with_hot_keys, read_table, written
from .components import connected_components

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the lower-cased word shingles, repeats included.

    Fewer words make one shingle; a text without words, or null, has zero.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    h = xxhash.xxh64_digest  # big-endian
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)
        hashes = np.frombuffer(b"".join([h(joined[a:b], SEED) for a, b in part]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 3, into: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(into, prints(F.col(text)))


class Block:
    """One cyclic code of the product, at bits ``shift`` to ``shift + n - 1``."""

    def __init__(self, n: int, generator: int, radius: int, shift: int, most: int):
        degree = generator.bit_length() - 1
        self.n, self.shift = n, shift
        syndrome = np.zeros(1, np.uint16)
        for i in range(n):
            rest = 1 << i
            for k in range(i, degree - 1, -1):
                if rest >> k & 1:
                    rest ^= generator << (k - degree)
            syndrome = np.concatenate([syndrome, syndrome ^ np.uint16(rest)])
        self.syndrome = syndrome
        found: list[list[list[int]]] = [[[] for _ in range(1 << degree)] for _ in range(most + 1)]
        for weight in range(radius + most + 1):
            for bits in combinations(range(n), weight):
                e = sum(1 << b for b in bits)
                found[max(0, weight - radius)][syndrome[e]].append(e)
        #: By how far beyond the radius: differences from a word of the code, padded with -1.
        self.reach = [_padded(f) for f in found]

    def of(self, fps: np.ndarray) -> np.ndarray:
        return self.syndrome[(fps >> np.uint64(self.shift)) & np.uint64((1 << self.n) - 1)]


def _padded(lists: list[list[int]]) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


#: Generator polynomials of the perfect binary Golay code and the Hamming code of 15 bits.
GOLAY, HAMMING = 0xC75, 0x13


@lru_cache(2)
def _blocks(most: int) -> tuple[Block, ...]:
    return Block(23, GOLAY, 3, 0, most), Block(23, GOLAY, 3, 23, most), Block(15, HAMMING, 1, 46, most)


_CODED = np.uint64((1 << 61) - 1)


def anchors(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fps, is the home) for all anchors within the radius plus ``most``."""
    blocks = _blocks(most)
    syndromes = [b.of(fps) for b in blocks]
    found = []
    for spread in product(range(most + 1), repeat=len(blocks)):
        if sum(spread) > most:
            continue
        here, fine = (fps & _CODED)[:, None], np.ones((len(fps), 1), bool)
        for b, s, e in zip(blocks, syndromes, spread, strict=True):
            change = b.reach[e][s]
            moved = np.where(change >= 0, change, 0).astype(np.uint64) << np.uint64(b.shift)
            here = (here[:, :, None] ^ moved[:, None, :]).reshape(len(fps), -1)
            fine = (fine[:, :, None] & (change >= 0)[:, None, :]).reshape(len(fps), -1)
        row, col = np.nonzero(fine)
        found.append((here[row, col], row, np.full(len(row), not any(spread))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _forest(fps: np.ndarray, home: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Links that connect what is within t bits, home against all, without all pairs."""
    label = np.arange(len(fps))
    links = []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= t)
        labels, at = np.unique(label[near], return_index=True)
        if len(labels) > 1:
            links += [(int(fps[i]), int(fps[near[k]])) for k, one in zip(at, labels, strict=True) if one != label[i]]
            label[np.isin(label, labels)] = labels[0]
    return links


def links(distinct: DataFrame, t: int = 2, fp: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints that differ in at most t bits.

    Not every pair: those at one anchor are linked by a spanning forest, so
    components are whole and a large group gives few rows.
    """

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 2048):
                fps = every[at : at + 2048]
                anchor, row, home = anchors(fps, t)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fps[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]
        for batch in _and_none(batches):
            if batch is not None:
                new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            anchor, fps, home = held
            if not len(anchor):
                continue
            starts = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
            if batch is not None:  # the last anchor may go on in the next batch
                held = [x[starts[-1] :] for x in held]
                anchor, fps, home, starts = anchor[: starts[-1]], fps[: starts[-1]], home[: starts[-1]], starts[:-1]
            if not len(starts):
                continue
            sizes = np.diff(np.append(starts, len(anchor)))
            homes = np.add.reduceat(home.astype(np.int64), starts)
            found = [x for k in np.flatnonzero((sizes > 1) & (homes > 0)) for x in _forest(fps[starts[k] : starts[k] + sizes[k]], home[starts[k] : starts[k] + sizes[k]], t)]
            if found:
                pairs = np.array(found, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    spread = distinct.select(F.col(fp).alias("fp")).mapInArrow(replicate, "anchor long, fp long, home boolean")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long").distinct()


def _and_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def near_duplicates(docs: DataFrame, t: int = 2, words: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) per row of ``docs``.

    component_id is the smallest id reachable over links of at most ``t``
    bits. Exact copies share a fingerprint and meet the links once. Texts
    without words, nulls among them, have fingerprint zero and link like
    any other. A very long text counts whole. Repeated rows give repeated
    results; a component whose ids are all null has none. An empty table
    gives no rows; other columns are left out, so none can clash.
    """
    printed = written(with_fingerprint(docs.select(F.col(id_col), F.col(text)), text, words).select(id_col, "fp"), "fingerprints")
    firsts = written(printed.groupBy("fp").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    parts = connected_components(links(firsts.select("fp"), t))
    placed = firsts.join(parts, firsts.fp == parts.node, "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of = written(placed.join(least, "component").select("fp", "n", "component_id"), "components")
    # Empty texts or copies of one may be a third of all rows.
    return join_with_hot_keys(printed, of, "fp", "n", printed.count()).select(id_col, "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; nulls, repeats and empty tables as in :func:`near_duplicates`."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, t: int = 2, words: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pipeline stage: of each component of near copies the rows with its smallest id.

    Texts without words aren't copies of each other and all stay; so do rows
    with a null id, as no id speaks for them. Of repeated rows one stays.
    """
    columns = docs.columns
    blank = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D]", " ")) == ""
    found = near_duplicates(docs.where(~blank & F.col(id_col).isNotNull()), t, words, id_col, text)
    ids = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.where(~blank & F.col(id_col).isNotNull()).join(ids, id_col, "left_semi")
    alone = docs.where(blank | F.col(id_col).isNull())
    return kept.select(columns).dropDuplicates([id_col, text]).unionByName(alone.select(columns))
