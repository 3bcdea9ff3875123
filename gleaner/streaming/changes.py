"""Field values with their provenance, kept up batch by batch, and the feed of what each batch changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.upserts import current_fields
from .store import Store

UPDATE = "record_id long, field string, value string, origin string, source string, seq long, manual boolean"
_STATE = "record_id long, field string, value string, origin string, source string, seq long"
_KEYS = ["record_id", "field"]


def standing(store: Store, before: int = 1 << 60) -> DataFrame:
    """The value of every field as the last batch that touched it left it."""
    rows = store.before("fields", before, _STATE)
    return rows.groupBy(*_KEYS).agg(F.max_by(F.struct("value", "origin", "source", "seq"), "batch").alias("v")).select(*_KEYS, "v.*")


def write_back(store: Store, updates: DataFrame, batch: int) -> DataFrame:
    """Folds a batch of updates into the fields it touches; returns its feed (record_id, field, before, after, origin, source, change).

    What stands is the start that the batch is measured against, so a batch
    reads the fields of its own keys and no history. Its seqs are above all
    earlier ones. A field is added, changed, or confirmed by another source
    with the same value; updates that lose leave no trace. Running a batch
    again replaces what it wrote. Null values are values; updates without a
    record or field go.
    """
    new = updates.where("record_id is not null and field is not null")
    old = standing(store, batch).join(new.select(*_KEYS).distinct(), _KEYS, "left_semi")
    folded = current_fields(new.unionByName(old.withColumn("manual", F.lit(True))), _KEYS, manual="manual").drop("manual")
    now = store.put("fields", batch, folded.select(*(f.split(" ")[0] for f in _STATE.split(", "))))
    was = old.select(*_KEYS, F.col("value").alias("before"), F.col("seq").alias("_seq"))
    met = now.withColumnRenamed("value", "after").join(was, _KEYS, "left").where(F.col("_seq").isNull() | (F.col("_seq") != F.col("seq")))
    change = F.when(F.col("_seq").isNull(), "added").when(F.col("before").eqNullSafe(F.col("after")), "confirmed").otherwise("changed")
    return store.put("feed", batch, met.select(*_KEYS, "before", "after", "origin", "source", "seq", change.alias("change")))


def view(fields: DataFrame) -> DataFrame:
    """(record_id, fields): what stands for each record, as a map of field to value, origin, source and seq."""
    return fields.groupBy("record_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("value", "origin", "source", "seq").alias("v"))))).alias("fields"))


def rescored(store: Store, feed: DataFrame, batch: int, inputs: tuple[str, ...], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of the records of which the feed changed one of ``inputs``; ``score`` takes their view and keeps record_id.

    Confirmed values change no score. The work grows with what changed.
    """
    touched = feed.where(F.col("field").isin(*inputs) & (F.col("change") != "confirmed")).select("record_id").distinct()
    return store.put("scores", batch, score(view(standing(store, batch + 1).join(touched, "record_id", "left_semi"))))
