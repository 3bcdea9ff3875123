"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of one, two and three tokens are mixed with
weights that depend on how often their context was seen. The weights are
learned by expectation-maximisation on the counts of a fold that is deleted
from the training counts for that purpose.

N-grams are counted by request and answer. Documents are dealt into blocks;
a block sends each of its distinct n-grams once, with its own counts, to the
hash range that the n-gram belongs to; the range adds up what all blocks
sent and answers each of them in the order in which it asked. So an n-gram
that fills a third of the corpus is still one entry per block, and no table
of n-grams is ever broadcast or held by one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, freed_shuffles, read_table, text_or_empty, written

ORDERS = (1, 2, 3)
#: Hash bits that are kept: tokens in full, as their counts are reported; longer n-grams to 48 bits.
_DROPPED_BITS = {1: 0, 2: 16, 3: 16}
_START, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_REQUESTS = "part long, block long, kind int, hashes binary, trained binary, deleted binary"
_ANSWERS = "block long, part long, kind int, distinct long, total long, trained binary, deleted binary"
_EVENT = ("deleted3", "context3", "deleted2", "context2", "deleted1")


@dataclass(frozen=True)
class Plan:
    """How the work is cut. Neither number changes a result.

    ``block_bytes``: text of a block; a task holds the n-grams of one block.
    ``range_tokens``: n-grams of a range; a task holds those of one range.
    From ``grows_from`` bytes of text both grow, ``most_growth`` times at most.
    A block asks a range at most once an order, and never for nothing, so there
    are no more requests than n-grams, however many blocks and ranges there are.
    """

    block_bytes: int = 4 << 20
    range_tokens: int = 1_000_000
    most_growth: float = 8.0
    grows_from: int = 8 << 30

    def at(self, n_bytes: int) -> tuple[int, int]:
        """(block_bytes, range_tokens) for a corpus: both grow with its square root, so that requests don't get too short."""
        grown = min(self.most_growth, max(1.0, (n_bytes / self.grows_from) ** 0.5))
        return int(self.block_bytes * grown), int(self.range_tokens * grown)


@dataclass(frozen=True)
class Weights:
    """What is learned besides the counts: for each order the weight by bucket of context frequency."""

    lambdas: tuple[tuple[float, ...], ...]
    n_tokens: int
    n_types: int
    n_texts: int
    n_texts_deleted: int


#: Contexts seen 2^k to 2^(k+1)-1 times share bucket k+1; bucket 0 is for unseen ones, whose weight is 0.
BUCKETS = 24


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


class _TokenHashes(dict):
    def __missing__(self, token: bytes) -> int:
        self[token] = h = xxhash.xxh64_intdigest(token, 7)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Block:
    """The n-grams of some texts: per order the distinct hashes in order, and which one each token ends."""

    def __init__(self, texts: list[str | None]):
        known = _TokenHashes()
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        self.lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        one = np.empty(int(self.lengths.sum()), np.uint64)
        for w, at, n in zip(words, self.starts.tolist(), self.lengths.tolist(), strict=True):
            one[at : at + n - 1] = np.fromiter(map(known.__getitem__, w), np.uint64, n - 1)
            one[at + n - 1] = _END
        before = self.previous(one, _START)
        two = _mix(before * np.uint64(3) + one)
        three = _mix(self.previous(before, _START) * np.uint64(5) + two)
        self.distinct, self.which = [], []
        for order, h in zip(ORDERS, (one, two, three), strict=True):
            u, inverse = np.unique(h >> np.uint64(_DROPPED_BITS[order]), return_inverse=True)
            self.distinct.append(u)
            self.which.append(inverse)

    def previous(self, values: np.ndarray, first) -> np.ndarray:
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out

    def per_token(self, flags: np.ndarray) -> np.ndarray:
        return np.repeat(flags, self.lengths)


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(values: np.ndarray) -> bytes:
    """Integers by byte planes, as many as the largest needs, compressed: the high ones are nearly empty."""
    n = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)
    return bytes([n]) + _PACK.compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPACK.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _requests(n_ranges: int):
    def ask(key: tuple, docs: pa.Table) -> pa.Table:
        block = _Block(docs.column("text").to_pylist())
        trained = block.per_token(np.array(docs.column("trained").to_pylist(), bool))
        deleted = block.per_token(np.array(docs.column("deleted").to_pylist(), bool))
        rows = []
        for kind, (h, which) in enumerate(zip(block.distinct, block.which, strict=True)):
            n, m = (np.bincount(which[f], minlength=len(h)) for f in (trained, deleted))
            # Equal steps of the hash space: an order's hashes are sorted, so a range is one slice.
            space = 1 << 64 - _DROPPED_BITS[kind + 1]
            # One step for each range that the block has n-grams of, however many ranges there are.
            part = (h / np.float64(space) * n_ranges).astype(np.int64).clip(0, n_ranges - 1)
            first = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for a, b in zip(first, [*first[1:], len(h)], strict=True):
                gaps = np.concatenate([h[a : a + 1], np.diff(h[a:b])])
                rows.append((int(part[a]), key[0].as_py(), kind, _packed(gaps), _packed(n[a:b]), _packed(m[a:b])))
        return _table(rows, _REQUESTS)

    return ask


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [pa.field(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _answer(asked: pa.Table) -> pa.Table:
    """Adds up one range of one order and answers every block that asked."""
    asked = asked.to_pylist()
    hashes = [np.cumsum(_unpacked(x["hashes"]), dtype=np.uint64) for x in asked]
    sizes = np.array([len(h) for h in hashes])
    _, which = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = []
    for name in ("trained", "deleted"):
        own = np.concatenate([_unpacked(x[name]) for x in asked])
        sums.append(np.bincount(which, weights=own).astype(np.int64))
    ends = np.cumsum(sizes)
    distinct, total = int((sums[0] > 0).sum()), int(sums[0].sum())
    rows = []
    for k, (x, b, n) in enumerate(zip(asked, ends.tolist(), sizes.tolist(), strict=True)):
        mine = which[b - n : b]
        # The totals of a range are told once.
        rows.append((x["block"], x["part"], x["kind"], distinct if k == 0 else 0, total if k == 0 else 0, _packed(sums[0][mine]), _packed(sums[1][mine])))
    return _table(rows, _ANSWERS)


class _Counts:
    """Corpus counts at every token of a block: (of the n-gram, of its context) for each order."""

    def __init__(self, block: _Block, answers: pa.Table, name: str, n_texts: int):
        rows = sorted(answers.select(["kind", "part", name]).to_pylist(), key=lambda x: (x["kind"], x["part"]))
        own = []
        for kind, which in enumerate(block.which):
            found = [_unpacked(x[name]) for x in rows if x["kind"] == kind]
            own.append(np.concatenate(found).astype(np.int64)[which] if found else np.zeros(0, np.int64))
        self.of = own
        # A context is the n-gram one shorter that ends at the token before; at a text's start all texts share it.
        self.context = [None, block.previous(own[0], n_texts), block.previous(own[1], n_texts)]


def _events(weights: Weights):
    """Rows of what the deleted fold holds: counts without the fold, and how often."""

    def find(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], ", ".join(f"{c} long" for c in (*_EVENT, "n")))
        block = _Block(docs.column("text").to_pylist())
        every = _Counts(block, answers, "trained", weights.n_texts)
        fold = _Counts(block, answers, "deleted", weights.n_texts_deleted)
        columns = [every.of[2] - fold.of[2], every.context[2] - fold.context[2], every.of[1] - fold.of[1], every.context[1] - fold.context[1], every.of[0] - fold.of[0]]
        rows = np.stack(columns, axis=1)
        order = np.lexsort(rows.T)
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(rows)))
        return pa.table([*(pa.array(rows[at, k]) for k in range(5)), pa.array(n.astype(np.int64))], names=[*_EVENT, "n"])

    return find


def _at(values: tuple[float, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _bucket(c: Column) -> Column:
    return F.when(c > 0, F.least(1 + F.floor(F.log2(c.cast("double"))), F.lit(BUCKETS - 1))).otherwise(0).cast("int")


def learn(events: DataFrame, n_tokens: int, n_types: int, rounds: int = 12, tolerance: float = 1e-4) -> tuple[tuple[float, ...], ...]:
    """Mixture weights by expectation-maximisation over ``events``.

    Each round sums the shares of the estimates over all events, by the
    buckets of both contexts; at most ``BUCKETS`` squared rows come back.
    """
    start = (0.0, *[0.5] * (BUCKETS - 1))
    lambdas = [(0.5,), start, start]
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    data = events.select(
        "n",
        _bucket(F.col("context3")).alias("b3"),
        _bucket(F.col("context2")).alias("b2"),
        ratio("deleted3", "context3").alias("f3"),
        ratio("deleted2", "context2").alias("f2"),
        (F.col("deleted1") / F.lit(max(1, n_tokens))).alias("f1"),
    )
    for _ in range(rounds):
        l3, l2, l1 = _at(lambdas[2], F.col("b3")), _at(lambdas[1], F.col("b2")), lambdas[0][0]
        shares = data.select("n", "b3", "b2", (l3 * F.col("f3")).alias("r3"), ((1 - l3) * l2 * F.col("f2")).alias("r2"), ((1 - l3) * (1 - l2) * l1 * F.col("f1")).alias("r1"), ((1 - l3) * (1 - l2) * (1 - l1) / (n_types + 1)).alias("r0"))
        p = F.col("r3") + F.col("r2") + F.col("r1") + F.col("r0")
        rows = shares.groupBy("b3", "b2").agg(*(F.sum(F.col("n") * F.col(r) / p).alias(r) for r in ("r3", "r2", "r1", "r0"))).collect()
        if not rows:
            break
        rows.sort(key=lambda r: (r["b3"], r["b2"]))
        before = lambdas
        lambdas = [
            (_share([r["r1"] for r in rows], [r["r0"] for r in rows], lambdas[0][0]),),
            tuple(_share([r["r2"] for r in rows if r["b2"] == b], [r["r1"] + r["r0"] for r in rows if r["b2"] == b], x) for b, x in enumerate(lambdas[1])),
            tuple(_share([r["r3"] for r in rows if r["b3"] == b], [r["r2"] + r["r1"] + r["r0"] for r in rows if r["b3"] == b], x) for b, x in enumerate(lambdas[2])),
        ]
        if max(abs(a - b) for x, y in zip(before, lambdas, strict=True) for a, b in zip(x, y, strict=True)) < tolerance:
            break
    return tuple(lambdas)


def _share(own: list[float], rest: list[float], default: float) -> float:
    a, b = math.fsum(own), math.fsum(rest)
    # Never all: an unseen continuation keeps a chance.
    return min(a / (a + b), 0.9999) if a + b > 0 and default > 0 else default


_SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(weights: Weights, id_field: pa.Field):
    def score(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs.column("text").to_pylist())
        if not docs.num_rows:
            block_sum = lambda x: np.zeros(0, x.dtype)
        else:
            block_sum = lambda x: np.add.reduceat(x, block.starts)
        counts = _Counts(block, answers, "trained", weights.n_texts)
        n, v = weights.n_tokens, weights.n_types
        l1, l2, l3 = (np.array(x) for x in weights.lambdas)
        one = l1[0] * counts.of[0] / max(1, n) + (1 - l1[0]) / (v + 1) if n else np.full(len(counts.of[0]), 1 / (v + 1))
        p = one
        for order, lam in ((1, l2), (2, l3)):
            seen = counts.context[order]
            w = lam[bucket(seen)]
            p = w * counts.of[order] / np.maximum(seen, 1) + (1 - w) * p
        base = np.log10((counts.of[0] + 1) / (n + v + 1))
        return pa.table(
            [docs.column("id").cast(id_field.type), docs.column("held_out"), pa.array(block.lengths), pa.array(block_sum((counts.of[0] > 0).astype(np.int64))), pa.array(np.full(len(block.lengths), n, np.int64)), pa.array(block_sum(base)), pa.array(block_sum(np.log10(p)))],
            names=[id_field.name, "held_out", *(c.split()[0] for c in _SCORES.split(", "))],
        )

    return score


def lm_scores(docs: DataFrame, held_out: Column, deleted: Column, id_col: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> tuple[DataFrame, Weights]:
    """Scores of all texts of ``docs``, and the learned weights.

    The model learns from the rows where ``held_out`` is false; of these,
    where ``deleted`` is true are left out of the counts while the weights
    are learned, and counted for scoring. Rows: id, held_out, n_tokens,
    n_known, train_tokens, base_score, score. Both scores are sums of log10
    over the tokens and one end.

    Null and empty texts are a bare end; a very long text is one block's, as a
    whole; null flags count as false; ids may repeat or be null, each row is
    scored; columns beside the two are ignored, so none can clash. An empty
    table gives no rows. No training rows: every token has the share of an
    unknown one. Longer n-grams are told apart by 48 bits: of 10^9 different
    ones, one in 280,000 shares its count with another.
    """
    spark = docs.sparkSession
    id_type = docs.select(id_col).schema[0]
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text"), flag(held_out).alias("held_out"), flag(deleted).alias("in_fold"))
    rows = rows.select("id", "text", "held_out", (~F.col("held_out")).alias("trained"), (F.col("in_fold") & ~F.col("held_out")).alias("deleted"))
    n = F.octet_length("text")
    sizes = rows.agg(F.coalesce(F.sum(n), F.lit(0)).alias("b"), F.coalesce(F.sum(F.when(F.col("deleted"), n)), F.lit(0)).alias("b_fold"), F.count_if("trained").alias("n"), F.count_if("deleted").alias("d")).first()
    block_bytes, range_tokens = plan.at(sizes["b"])
    n_fold = max(1, -(-sizes["b_fold"] // block_bytes))
    n_rest = max(1, -(-(sizes["b"] - sizes["b_fold"]) // block_bytes))
    n_ranges = max(1, sizes["b"] // 6 // range_tokens)
    # The fold has blocks of its own, so that learning reads no others.
    h = F.xxhash64("id", F.crc32(F.col("text").cast("binary")))
    blocks = rows.withColumn("block", F.when(F.col("deleted"), F.pmod(h, F.lit(n_fold))).otherwise(F.pmod(h, F.lit(n_rest)) + n_fold))
    with freed_shuffles(spark):
        asked = blocks.select("block", "text", "trained", "deleted").groupBy("block").applyInArrow(_requests(n_ranges), _REQUESTS)
        answers = written(asked.groupBy("part", "kind").applyInArrow(_answer, _ANSWERS), "lm-answers")
        known = answers.where("kind = 0").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
        weights = Weights(((0.5,), (0.0, *[0.5] * (BUCKETS - 1)), (0.0, *[0.5] * (BUCKETS - 1))), known["n"] or 0, known["v"] or 0, sizes["n"], sizes["d"])
        by_block = answers.select("block", "kind", "part", "trained", "deleted").groupBy("block")
        in_fold = answers.where(F.col("block") < n_fold).select("block", "kind", "part", "trained", "deleted").groupBy("block")
        events = blocks.where("deleted").select("block", "text").groupBy("block").cogroup(in_fold).applyInArrow(_events(weights), ", ".join(f"{c} long" for c in (*_EVENT, "n")))
        events = written(events.groupBy(*_EVENT).agg(F.sum("n").alias("n")), "lm-events")
    deleted_tokens = events.agg(F.sum("n")).first()[0] or 0
    lambdas = learn(events, weights.n_tokens - deleted_tokens, weights.n_types)
    drop_written(events)
    weights = Weights(lambdas, weights.n_tokens, weights.n_types, weights.n_texts, weights.n_texts_deleted)
    scored = blocks.select("block", "id", "text", "held_out").groupBy("block").cogroup(by_block)
    schema = f"`{id_col}` {id_type.dataType.simpleString()}, held_out boolean, {_SCORES}"
    arrow_id = pa.field(id_col, _arrow_type(id_type.dataType))
    return scored.applyInArrow(_scores(weights, arrow_id), schema), weights


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; nulls, repeats and empty tables as in :func:`lm_scores`."""
    docs = read_table(spark, sf_dir, "documents")
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return lm_scores(docs, rest == 2, rest == 3)[0]
