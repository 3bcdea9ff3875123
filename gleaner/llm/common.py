"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in the contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session without one that runs on one machine gets a temporary one; on a
    cluster this is an error, as no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = os.path.join(tempfile.gettempdir(), "gleaner-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._gleaner_path = path
    return back


def drop_written(df: DataFrame) -> None:
    """Delete what :func:`written` wrote, once nothing lazy still reads it."""
    path = getattr(df, "_gleaner_path", None)
    if path is not None:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside give their shuffle files back at once.

    For steps whose results are written: what they shuffled isn't read again,
    and would otherwise stay on the executors' disks until the driver happens
    to collect its garbage.
    """
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def broadcast_if_small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df``, of narrow rows and written before, with a broadcast hint if it is small; else Spark shuffles.

    Counting a written table reads file footers only.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


def join_with_hot_keys(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int, share: int = 1000, least: int = 1000, small: int = 1_000_000) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row for each key and tells in ``n`` how many rows have it.

    A key with over a thousandth of the ``total`` rows (and over ``least``)
    would fill one task; there are at most ``share`` such keys, so these are
    broadcast and the rest is shuffled, unless ``per_key`` has at most
    ``small`` rows. ``per_key`` is a written table, as it is read several times.
    """
    least = max(total // share, least)
    hot = F.broadcast(per_key.where(F.col(n) > least).limit(share))
    if not hot.limit(1).count():
        return rows.join(broadcast_if_small(per_key, small), key)
    cold = rows.join(hot.select(key), key, "left_anti").join(broadcast_if_small(per_key.where(F.col(n) <= least), small), key)
    return rows.join(hot, key).unionByName(cold)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, for helpers beside its own columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
