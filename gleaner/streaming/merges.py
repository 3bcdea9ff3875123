"""Announcements of one financing, merged as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.event_merge import ASSIGNED, WINDOW_DAYS, Anchors

_DAY_MS = 86_400_000


class HeadKeeper(StatefulProcessor):
    """State of an identity: (name, day) pairs whose day isn't over yet, and heads that may still be joined.

    A timer ends each day once the watermark has passed it: its pairs are
    placed in order, so arrival order within the delay makes no difference.
    Another forgets heads when their window is over.
    """

    def __init__(self, days: int = WINDOW_DAYS):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "key string, day int", "seq long")
        self.heads = handle.getListState("heads", "key string, day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for name, day, seq in zip(frame["key"], frame["day"], frame["seq"], strict=True):
                pair, seq = (name, int(day)), int(seq)
                before = self.waiting.getValue(pair) if self.waiting.containsKey(pair) else None
                if before is None or seq < before[0]:
                    self.waiting.updateValue(pair, (seq,))
                self.handle.registerTimer((int(day) + 1) * _DAY_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        today = expiredTimerInfo.getExpiryTimeInMs() // _DAY_MS
        over = sorted((day, seq, name) for (name, day), (seq,) in self.waiting.iterator() if day < today)
        anchors = Anchors(self.days, [(k, d) for k, d in self.heads.get()] if self.heads.exists() else [])
        out = []
        for day, _, name in over:
            out.append((name, day, *anchors.place(name, day)))
            self.waiting.removeKey((name, day))
        kept = [h for h in anchors.heads if today - h[1] <= self.days + 1]
        if kept:
            self.heads.put(kept)
            self.handle.registerTimer((min(h[1] for h in kept) + self.days + 2) * _DAY_MS)
        elif self.heads.exists():
            self.heads.clear()
        yield pd.DataFrame(out, columns=["key", "day", "head_key", "head_day"])

    def close(self) -> None:
        pass


def streamed_heads(stream: DataFrame, known: DataFrame, key: str, at: str, order: str, days: int = WINDOW_DAYS, delay: str = "30 days") -> DataFrame:
    """The table of ``event_merge.heads_of``, row by row as days end.

    ``known`` (key, identity) is the table of names resolved so far; a name
    that isn't in it is an identity by itself until it is. What arrives over
    ``delay`` after newer announcements is late and dropped. State per
    identity is bounded by its names and the days of delay and window. Needs
    the RocksDB state store.
    """
    names = known.select(F.col("key").alias("_key"), "identity")
    rows = stream.where((F.col(key) != "") & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(order).cast("long").alias("seq")).withWatermark("at", delay)
    marked = rows.join(names, F.col("key") == F.col("_key"), "left").select("key", "at", F.unix_date(F.col("at").cast("date")).alias("day"), "seq", F.coalesce("identity", "key").alias("identity"))
    return marked.groupBy("identity").transformWithStateInPandas(HeadKeeper(days), outputStructType=ASSIGNED, outputMode="Append", timeMode="EventTime")
