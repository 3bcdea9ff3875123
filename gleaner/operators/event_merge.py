"""Announcements of one financing, merged: the same company by exact, longer or nearly equal names, within a window of days.

Order matters: announcements go oldest first, and each joins the first head
whose name is the same company's and whose day is near, or becomes a head. It
does not matter how many announcements a company has on a day, so the fold
runs over distinct (name, day) pairs; names that can meet at all are found
first, as components of a graph.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, with_checkpoints
from .matching import edit_distance, fuzzy_pairs

WINDOW_DAYS = 21
LEAST_LENGTH, MOST_EDITS, LEAST_SIMILARITY = 5, 2, 0.85
ASSIGNED = "key string, day int, head_key string, head_day int"


def same_company(a: str, b: str) -> bool:
    """Equal keys, one with more words than the other, or keys within two edits and at least 0.85 alike."""
    if not a or not b:
        return False
    if a == b or a.startswith(f"{b} ") or b.startswith(f"{a} "):
        return True
    longest = max(len(a), len(b))
    if min(len(a), len(b)) < LEAST_LENGTH or abs(len(a) - len(b)) > MOST_EDITS:
        return False
    edits = edit_distance(a, b)
    return edits <= MOST_EDITS and 1 - edits / longest >= LEAST_SIMILARITY


def _begins(key: str) -> list[str]:
    """The names that begin ``key``, word by word, without itself."""
    return [key[:i] for i, c in enumerate(key) if c == " " and i]


class Anchors:
    """Heads that are still near, in the order in which they came; days must not go back.

    Heads are kept by name and by the names that begin them, so that a name
    is compared with none of the others.
    """

    def __init__(self, days: int = WINDOW_DAYS, heads: Iterable[tuple[str, int]] = ()):
        self.days, self.heads, self._gone = days, deque(), 0
        self._named: dict[str, tuple[int, tuple[str, int]]] = {}
        self._begun: dict[str, deque[tuple[int, tuple[str, int]]]] = {}
        for head in heads:
            self._add(*head)

    def _add(self, key: str, day: int) -> None:
        head = (self._gone + len(self.heads), (key, day))
        self.heads.append(head[1])
        self._named.setdefault(key, head)
        for begin in _begins(key):
            self._begun.setdefault(begin, deque()).append(head)

    def _forget(self) -> None:
        key, _ = self.heads.popleft()
        if self._named[key][0] == self._gone:
            del self._named[key]
        for begin in _begins(key):
            self._begun[begin].popleft()
            if not self._begun[begin]:
                del self._begun[begin]
        self._gone += 1

    def place(self, key: str, day: int, near: Iterable[str] | None = None) -> tuple[str, int]:
        """The first head of the same company, or a new one. ``near``: all nearly equal names, if these are known."""
        while self.heads and day - self.heads[0][1] > self.days:
            self._forget()
        found = [self._named[k] for k in (key, *_begins(key), *(near if near is not None else ())) if k in self._named]
        if key in self._begun:
            found.append(self._begun[key][0])
        if near is None:
            found += next(([(self._gone + i, head)] for i, head in enumerate(self.heads) if same_company(head[0], key)), [])
        if found and key:
            return min(found)[1]
        self._add(key, day)
        return key, day


def near_names(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, other), both ways round: names that are nearly, but not quite, the same."""
    distinct = keys.select(F.col(key).alias("b")).where(F.col(key) != "").distinct()
    return fuzzy_pairs(distinct, distinct, "b", LEAST_LENGTH, MOST_EDITS, LEAST_SIMILARITY).select("key", "other")


def key_links(keys: DataFrame, key: str = "key", near: DataFrame | None = None) -> DataFrame:
    """(a, b) of distinct keys that may be one company's: a key and each key that begins it, word by word, and near spellings.

    ``near`` are the :func:`near_names`, if these were found before.
    """
    distinct = keys.select(F.col(key).alias("b")).where(F.col(key) != "").distinct()
    words = F.split("b", " ")
    starts = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " ")))
    longer = distinct.select("b", F.explode(starts).alias("a")).join(distinct.select(F.col("b").alias("a")), "a", "left_semi").select("a", "b")
    near = near_names(keys, key) if near is None else near
    return longer.union(near.where("key < other").select("key", "other"))


def identities(keys: DataFrame, key: str = "key", near: DataFrame | None = None) -> DataFrame:
    """(key, identity) of every distinct key: names that a chain of links joins have one identity, the smallest of them."""
    found = components(key_links(keys, key, near)).select(F.col("node").alias(key), F.col("component").alias("identity"))
    alone = keys.select(key).where(F.col(key).isNotNull()).distinct().join(found, key, "left")
    return alone.select(key, F.coalesce("identity", key).alias("identity"))


def stretches(pairs: DataFrame, by: str = "identity", day: str = "day", days: int = WINDOW_DAYS) -> DataFrame:
    """``pairs`` with ``stretch``, the first day of a stretch of an identity without a gap of over ``days``.

    Nothing can join across such a gap. An identity's distinct days are as
    many as the calendar has.
    """
    listed = pairs.groupBy(by).agg(F.array_sort(F.collect_set(day)).alias("_days"))
    first = lambda d, i: (i == 0) | (d - F.get("_days", i - 1) > days)
    starts = listed.select(by, F.filter("_days", first).alias("_starts"))
    return pairs.join(starts, by).withColumn("stretch", F.array_max(F.filter("_starts", lambda s: s <= F.col(day)))).drop("_starts")


def heads_of(events: DataFrame, key: str, at: str, order: str, days: int = WINDOW_DAYS, known: DataFrame | None = None) -> DataFrame:
    """(key, day, head_key, head_day): the head that announcements of a name and day belong to.

    Within a day announcements go by ``order``. ``known`` gives the
    (key, identity) of names that were resolved before. Null or empty names
    and null days have no head. Each stretch of an identity passes through
    one task in order, which keeps the heads of the last ``days`` only and
    finds the one to join by name: near spellings come along with each name.
    """
    with_checkpoints(events.sparkSession)
    pairs = events.where((F.col(key) != "") & F.col(at).isNotNull()).groupBy(F.col(key).alias("key"), F.unix_date(F.col(at).cast("date")).alias("day")).agg(F.min(order).alias("seq")).checkpoint()
    near = near_names(pairs).checkpoint()
    named = pairs.join(identities(pairs, near=near) if known is None else known, "key").join(near.groupBy("key").agg(F.collect_list("other").alias("near")), "key", "left")
    sorted_ = stretches(named, days=days).repartition("identity", "stretch").sortWithinPartitions("identity", "stretch", "day", "seq", "key")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchors = None, Anchors(days)
        for rows in batches:
            out = []
            for identity, stretch, key_, day, near_ in zip(rows["identity"], rows["stretch"], rows["key"], rows["day"], rows["near"], strict=True):
                if (identity, stretch) != now:
                    now, anchors = (identity, stretch), Anchors(days)
                out.append((key_, day, *anchors.place(key_, int(day), () if near_ is None else near_)))
            yield pd.DataFrame(out, columns=["key", "day", "head_key", "head_day"])

    return sorted_.select("identity", "stretch", "day", "seq", "key", "near").mapInPandas(fold, ASSIGNED)


def with_heads(events: DataFrame, heads: DataFrame, key: str, at: str) -> DataFrame:
    """``events`` with head_key and head_at; those without a head stay, with nulls."""
    day = F.unix_date(F.col(at).cast("date"))
    named = heads.select(F.col("key").alias("_key"), F.col("day").alias("_day"), "head_key", F.date_from_unix_date("head_day").alias("head_at"))
    return events.join(named, (F.col(key) == F.col("_key")) & (day == F.col("_day")), "left").drop("_key", "_day")


def merged_announcements(placed: DataFrame, at: str, order: str, url: str = "url", publisher: str = "publisher", most_investors: int = 8) -> DataFrame:
    """One row per head of ``placed`` (see :func:`with_heads`): first known facts in order, and what sources disagree on.

    Needs amount_usd, amount_text, round_type, investors array<string>,
    hq_city, hq_state and sector. The first announcement is the record;
    gaps are filled by the next that knows, and a different amount or round
    is a conflict for a human, never an update. All are aggregates of one row
    per key and task, in two steps: by url, then by head.
    """
    head = ["head_key", "head_at"]
    rows = placed.where("head_key is not null").withColumn("_order", F.struct(F.col(at).cast("date").alias("at"), F.col(order).alias("seq")))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    facts = {"amount": F.when(F.col("amount_usd").isNotNull(), F.struct("amount_usd", "amount_text")), "round_type": text("round_type"), "hq_city": F.col("hq_city"), "hq_state": F.col("hq_state"), "sector": text("sector")}
    first = lambda c, known: F.min_by(c, F.when(known.isNotNull(), F.col("_order")))
    by_url = rows.groupBy(*head, F.col(url).alias("url")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_order").alias("_first"), F.min_by(publisher, "_order").alias("publisher"),
        *(F.min(F.when(c.isNotNull(), F.struct("_order", c.alias("v")))).alias(name) for name, c in facts.items()),
        F.min("amount_usd").alias("least"), F.max("amount_usd").alias("most"), F.min(text("round_type")).alias("round_a"), F.max(text("round_type")).alias("round_b"),
    )
    found = by_url.groupBy(*head).agg(
        F.sum("n").alias("n_articles"), F.count_if(F.col("url").isNotNull()).alias("n_sources"), F.min_by("publisher", "_first").alias("publisher"), F.min_by("url", "_first").alias("article_url"),
        *(F.min(name)["v"].alias(name) for name in facts),
        F.coalesce(F.min("least") < F.max("most"), F.lit(False)).alias("amount_conflict"), F.coalesce(F.min("round_a") < F.max("round_b"), F.lit(False)).alias("round_conflict"),
    )
    named = rows.select(*head, "_order", F.posexplode("investors").alias("_place", "investor")).groupBy(*head, "investor").agg(F.min(F.struct("_order", "_place")).alias("_seen"))
    listed = named.groupBy(*head).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("_seen", "investor"))), 1, most_investors), lambda x: x["investor"]).alias("investors"))
    out = found.join(listed, head, "left")
    return out.select(
        *head, "n_articles", "n_sources", "publisher", "article_url", F.col("amount.amount_usd").alias("amount_usd"), F.col("amount.amount_text").alias("amount_text"), "round_type", "hq_city", "hq_state", "sector",
        F.coalesce("investors", F.array().cast("array<string>")).alias("investors"), "amount_conflict", "round_conflict", (F.col("amount_conflict") | F.col("round_conflict")).alias("needs_review"),
    )


def conflicts(placed: DataFrame, merged: DataFrame, url: str = "url", publisher: str = "publisher") -> DataFrame:
    """(head_key, head_at, field, value, url), once each: what the record says and what others say instead."""
    head = ["head_key", "head_at"]
    said = lambda text, by: F.concat(text, F.lit(" ("), F.coalesce(by, F.lit("")), F.lit(")"))
    amount = lambda p="": F.coalesce(F.col(f"{p}amount_text"), F.col(f"{p}amount_usd").cast("string"))
    r = merged.where("needs_review").select(*head, F.col("amount_usd").alias("_amount_usd"), F.col("amount_text").alias("_amount_text"), F.col("round_type").alias("_round"), F.col("publisher").alias("_publisher"), F.col("article_url").alias("_url"), "amount_conflict", "round_conflict")
    own = r.select(*head, F.explode(F.array_compact(F.array(
        F.when(F.col("amount_conflict"), F.struct(F.lit("amount").alias("field"), said(amount("_"), F.col("_publisher")).alias("value"), F.col("_url").alias("url"))),
        F.when(F.col("round_conflict"), F.struct(F.lit("round").alias("field"), said(F.col("_round"), F.col("_publisher")).alias("value"), F.col("_url").alias("url"))),
    ))).alias("c"))
    others = placed.join(r, head).select(*head, F.explode(F.array_compact(F.array(
        F.when(F.col("amount_usd") != F.col("_amount_usd"), F.struct(F.lit("amount").alias("field"), said(amount(), F.col(publisher)).alias("value"), F.col(url).alias("url"))),
        F.when((F.col("round_type") != "") & (F.col("round_type") != F.col("_round")), F.struct(F.lit("round").alias("field"), said(F.col("round_type"), F.col(publisher)).alias("value"), F.col(url).alias("url"))),
    ))).alias("c"))
    return own.union(others).select(*head, "c.*").distinct()
