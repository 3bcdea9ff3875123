"""Sinks: CSV exports, append-only tables and replaced partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import java


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: null is empty, line breaks are spaces."""
    s = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")
    s = F.when(s.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(s.rlike('[,;"\t]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One text column ``value``: cells joined by commas, with the carriage return of a CRLF file."""
    return rows.select(F.concat(F.concat_ws(",", *(csv_cell(F.col(c)) for c in columns)), F.lit("\r")).alias("value"))


def write_csv(rows: DataFrame, columns: Sequence[str], path: str) -> None:
    """Parts of a CRLF export; a header line with a byte order mark is in a file of its own, sorted first."""
    spark = rows.sparkSession
    header = spark.range(1).select(F.lit("﻿" + ",".join(columns) + "\r").alias("value"))
    header.coalesce(1).write.text(f"{path}/0-header")
    csv_lines(rows, columns).write.text(f"{path}/1-rows")


def append(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replaces the partitions that ``rows`` has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def audit_view(log: DataFrame, at: str, text: str, most: int = 500) -> DataFrame:
    """The newest entries of an audit log, secrets blacked out."""
    hidden = F.regexp_replace(text, java(r"(?i)\b(sk-[A-Za-z0-9_-]{8,}|Bearer\s+[A-Za-z0-9._-]{8,}|(?:api[_-]?key|token|secret|password)\s*[=:]\s*\S+)"), "[redacted]")
    return log.withColumn(text, hidden).orderBy(F.col(at).desc()).limit(most)
