"""Quality classifier: a small byte-level convolutional network in numpy.

Bytes are embedded, filters run over every window of them, and each filter is
max-pooled over overlapping chunks that cover the whole text. A hidden layer
sees a chunk's pooled filters together with how full it is, so it can also
tell what a chunk lacks, as repetitive text does; it and the filters are
max-pooled over the chunks and combined into one probability.

Training is data-parallel: slots of a bounded sample take a pass each from the
same weights, and what they arrive at is averaged, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_written, freed_shuffles, fresh, read_table, written

_PAD = 256
_BLOCK = 1 << 16


@dataclass(frozen=True)
class Shape:
    """Sizes of the network. A chunk has two halves of ``half`` windows and shares one with each neighbour."""

    width: int = 6
    embedding: int = 6
    filters: int = 24
    hidden: int = 16
    half: int = 64

    def parts(self) -> dict[str, tuple[int, ...]]:
        return {
            "embedding": (_PAD + 1, self.embedding), "filters": (self.width * self.embedding, self.filters), "filter_bias": (self.filters,),
            "hidden": (self.filters + 1, self.hidden), "hidden_bias": (self.hidden,), "out": (self.hidden + self.filters,), "out_bias": (1,),
        }


@dataclass
class Network:
    """Weights as one vector, with views of its parts."""

    shape: Shape
    vector: np.ndarray
    part: dict[str, np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        at, self.part = 0, {}
        for name, size in self.shape.parts().items():
            n = int(np.prod(size))
            self.part[name] = self.vector[at : at + n].reshape(size)
            at += n

    @staticmethod
    def new(shape: Shape = Shape(), seed: int = 0) -> Network:
        net = Network(shape, np.zeros(sum(int(np.prod(s)) for s in shape.parts().values()), np.float32))
        rng = np.random.default_rng(seed)
        for name, scale in (("embedding", 0.5), ("filters", (shape.width * shape.embedding) ** -0.5), ("hidden", shape.filters**-0.5), ("out", 0.1)):
            net.part[name][:] = rng.normal(0, scale, net.part[name].shape)
        return net

    def _bytes(self, data: bytes) -> np.ndarray:
        """With padding, so that each byte is in ``width`` windows and an empty text has windows too."""
        pad = self.shape.width - 1
        x = np.full(len(data) + 2 * pad, _PAD, np.intp)
        x[pad : pad + len(data)] = np.frombuffer(data, np.uint8)
        return x

    def _windows(self, x: np.ndarray) -> np.ndarray:
        s = self.shape
        flat = self.part["embedding"][x].ravel()
        return sliding_window_view(flat, s.width * s.embedding)[:: s.embedding]

    def _halves(self, x: np.ndarray) -> np.ndarray:
        """Each filter's maximum over every half of a chunk, block by block."""
        s, n = self.shape, len(x) - self.shape.width + 1
        out = np.empty((-(-n // s.half), s.filters), self.vector.dtype)
        for a in range(0, n, _BLOCK):
            b = min(n, a + _BLOCK)
            seen = np.ascontiguousarray(self._windows(x[a : b + s.width - 1])) @ self.part["filters"]
            whole = (b - a) // s.half * s.half
            at = a // s.half
            if whole:
                out[at : at + whole // s.half] = seen[:whole].reshape(-1, s.half, s.filters).max(1)
            if whole < b - a:
                out[-1] = seen[whole:].max(0)
        return out + self.part["filter_bias"]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features of chunks, their hidden units)."""
        s, n = self.shape, len(x) - self.shape.width + 1
        halves = self._halves(x)
        chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        seen = np.empty((len(chunks), s.filters + 1), self.vector.dtype)
        np.maximum(chunks, 0, out=seen[:, :-1])
        seen[:, -1] = np.minimum(n - np.arange(len(chunks)) * s.half, 2 * s.half) / (2 * s.half)
        return seen, np.maximum(seen @ self.part["hidden"] + self.part["hidden_bias"], 0)

    def score(self, data: bytes) -> float:
        """The probability of label 1."""
        seen, hidden = self._pooled(self._bytes(data))
        z = np.concatenate([hidden.max(0), seen[:, :-1].max(0)]) @ self.part["out"] + self.part["out_bias"][0]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def gradient(self, data: bytes, label: float, into: np.ndarray) -> None:
        """Adds the gradient of the log loss to ``into``, which is shaped like ``vector``."""
        s, p, g = self.shape, self.part, Network(self.shape, into).part
        x = self._bytes(data)
        n = len(x) - s.width + 1
        seen, hidden = self._pooled(x)
        top_hidden, top_seen = hidden.argmax(0), seen[:, :-1].argmax(0)
        units, filters = np.arange(s.hidden), np.arange(s.filters)
        pooled = np.concatenate([hidden[top_hidden, units], seen[top_seen, filters]])
        z = pooled @ p["out"] + p["out_bias"][0]
        loss = self.vector.dtype.type(1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        g["out"] += loss * pooled
        g["out_bias"] += loss
        back = loss * p["out"]
        unit = np.where(pooled[: s.hidden] > 0, back[: s.hidden], 0)
        g["hidden"] += (seen[top_hidden] * unit[:, None]).T
        g["hidden_bias"] += unit
        # What reaches the filters: (chunk, filter, amount), from hidden units and from the pool itself.
        chunks, place = np.unique(np.concatenate([top_hidden, top_seen]), return_inverse=True)
        to = np.zeros((len(chunks), s.filters), self.vector.dtype)
        np.add.at(to, place[: s.hidden], unit[:, None] * p["hidden"][:-1].T)
        np.add.at(to, (place[s.hidden :], filters), back[s.hidden :])
        to[seen[chunks, :-1] <= 0] = 0
        for chunk, amounts in zip(chunks.tolist(), to, strict=True):
            some = np.flatnonzero(amounts)
            if not some.size:
                continue
            a, b = chunk * s.half, min(n, (chunk + 2) * s.half)
            windows = np.ascontiguousarray(self._windows(x[a : b + s.width - 1]))
            at = (windows @ p["filters"][:, some]).argmax(0)
            g["filters"][:, some] += (windows[at] * amounts[some, None]).T
            g["filter_bias"][some] += amounts[some]
            spread = (p["filters"][:, some] * amounts[some]).T.reshape(-1, s.embedding)
            np.add.at(g["embedding"], x[a + at[:, None] + np.arange(s.width)].ravel(), spread)


@dataclass
class Learner:
    """Adam on a network; its state is averaged along with the weights."""

    network: Network
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    @staticmethod
    def new(shape: Shape, seed: int) -> Learner:
        net = Network.new(shape, seed)
        return Learner(net, np.zeros_like(net.vector), np.zeros_like(net.vector))

    def learn(self, rows: list[tuple[bytes, int]], rate: float, batch: int) -> None:
        for at in range(0, len(rows), batch):
            some = rows[at : at + batch]
            g = np.zeros_like(self.network.vector)
            for data, label in some:
                self.network.gradient(data, label, g)
            g /= len(some)
            self.steps += 1
            self.first += 0.1 * (g - self.first)
            self.second += 0.01 * (g * g - self.second)
            self.network.vector -= rate * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.99**self.steps)) + 1e-8)

    def state(self) -> np.ndarray:
        return np.concatenate([self.network.vector, self.first, self.second])

    @staticmethod
    def of(shape: Shape, state: np.ndarray, steps: int) -> Learner:
        vector, first, second = np.split(state.astype(np.float32), 3)
        return Learner(Network(shape, vector.copy()), first.copy(), second.copy(), steps)


def _one_pass(learner: Learner, rate: float, batch: int, seeds: list[int]):
    """What a slot does in a round: one pass over its rows, in an order of its own."""
    shape, state, steps = learner.network.shape, learner.state(), learner.steps

    def run(rows):
        mine = Learner.of(shape, state, steps)
        held = sorted(zip(rows["_hash"].to_pylist(), rows["_id"].to_pylist(), rows["_text"].to_pylist(), rows["_label"].to_pylist(), strict=True), key=lambda r: r[:2])
        order = np.random.default_rng([*seeds, held[0][0] & 0xFFFF]).permutation(len(held))
        mine.learn([(held[i][2].encode(), held[i][3]) for i in order.tolist()], rate, batch)
        return pa.table({"n": pa.array([len(held)], pa.int64()), "steps": pa.array([mine.steps], pa.int64()), "state": pa.array([mine.state().tolist()], pa.list_(pa.float64()))})

    return run


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 3000, id_col: str = "doc_id", text: str = "text", label: str = "quality", shape: Shape = Shape(), rounds: int = 14, slots: int = 8, rate: float = 0.01, batch: int = 16, seed: int = 11) -> Network:
    """A network fitted to a sample of at most ``most_rows`` labelled texts, taken whole.

    The sample is that of the least hashes of ids among all labelled rows, so
    it is the same however the tables are dealt; an id with several labels
    counts with the least, null ids and labels and ids without a text are
    passed over, a null text is empty. In each of ``rounds`` every slot of the
    sample takes one pass from the common weights; the driver sees only the
    slots' weights, whose average is the next start. Without labelled rows the
    weights are those of the start.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label is not null")
    known = known.groupBy("_id").agg(F.min("_label").alias("_label")).withColumn("_hash", F.xxhash64("_id", F.lit(seed)))
    with freed_shuffles(docs.sparkSession):
        picked = written(known.orderBy("_hash", "_id").limit(most_rows), "picked")
        texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(broadcast_if_small(picked), "_id")
        # Rows of one id would weigh more than others, and there may be any number.
        sample = written(texts.groupBy("_id", "_hash", "_label").agg(F.min("_text").alias("_text")).withColumn("_slot", F.pmod("_hash", F.lit(slots))), "sample")
    drop_written(picked)
    learner = Learner.new(shape, seed)
    for k in range(rounds):
        # One row of weights for each slot.
        ends = sample.repartition(4 * slots, "_slot").groupBy("_slot").applyInArrow(_one_pass(learner, rate * (1 - k / rounds), batch, [seed, k]), "n bigint, steps bigint, state array<double>").collect()
        if not ends:
            break
        ends.sort(key=lambda r: (r["n"], r["steps"], r["state"][:8]))
        weights = np.array([r["n"] for r in ends], np.float64)
        learner = Learner.of(shape, np.average([r["state"] for r in ends], 0, weights), max(r["steps"] for r in ends))
    drop_written(sample)
    return learner.network


def scored(docs: DataFrame, network: Network, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the network's probability that a text is good.

    Only the text counts, all of it; a very long one is read block by block.
    Null is read as the empty text, which has a score too. Rows are scored one
    by one, so repeats and other columns stay as they are; a column named as
    ``into`` is an error. No rows give no rows.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {into!r} exists")
    shape, vector = network.shape, network.vector

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = Network(shape, vector)
        for texts in batches:
            yield pa.array([net.score((texts[i].as_py() or "").encode()) for i in range(len(texts))], pa.float64())

    return docs.withColumn(into, score(F.col(text)))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Learns from labels of ids whose crc32 leaves no 2 by 4; a null id is not
    held out. Null and empty texts have the score of the empty text.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    network = train(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    found = scored(docs, network)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
