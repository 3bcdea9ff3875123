"""Snapshots: pointers, integrity and pruning."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from gleaner.sources.snapshots import Snapshots


def test_versions_integrity_and_pruning(spark, tmp_path):
    s = Snapshots(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        s.read()
    assert s.versions() == [] == s.prune(1)
    for k in range(1, 5):
        assert s.take(spark.range(40 * k).select(F.col("id"), F.lit(k).alias("a b"), F.when(F.col("id") > 3, "x").alias("n")).repartition(3), f"v{k}") == 40 * k
    with pytest.raises(ValueError):
        s.take(spark.range(1), "v2")
    assert s.versions() == ["v1", "v2", "v3", "v4"] and s.read().count() == 160 and s.read("v2").count() == 80
    spark.range(3).write.parquet(f"{tmp_path}/t/data/version=v5")  # a run that died before it was pointed to
    assert s.versions()[-1] == "v4" and s.take(spark.range(7), "v5") == 7 and s.read().count() == 7
    assert all(s.problems(v).count() == 0 for v in s.versions())
    files = sorted((tmp_path / "t/data/version=v4").glob("part-*.parquet"))
    files[0].rename(files[0].with_name("part-extra.parquet"))
    shutil.copy(files[1], files[2])
    for crc in (tmp_path / "t/data/version=v4").glob(".*.crc"):
        crc.unlink()
    assert {r["file"]: r["problem"] for r in s.problems("v4").collect()} == {files[0].name: "missing", "part-extra.parquet": "unknown", files[2].name: "changed"}
    assert s.prune(2, pinned=("v1",)) == ["v2", "v3"] and s.versions() == ["v1", "v4", "v5"]
    assert s.prune(0) == ["v1", "v4"] and s.read().count() == 7
    with pytest.raises(ValueError):
        s.read("v1")
    assert s.take(spark.range(0), "empty") == 0 and s.read("empty").count() == 0
