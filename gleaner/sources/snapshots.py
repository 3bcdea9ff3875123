"""Versions of a table with a manifest of their files, a pointer to the one in use, and pruning."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "file string, rows long, checksum decimal(38,0)"
_POINTER = "version string, seq long"


class Snapshots:
    """Snapshots of a table below a folder.

    A version is first written whole, then described, then pointed to, each by
    one commit of Spark's writer: whoever reads through the pointer sees a
    whole version, before or after. Checksums are sums of row hashes, so the
    order of rows in a file doesn't count.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, part: str, version: str = "") -> str:
        return f"{self.root}/{part}" + (f"/version={version}" if version else "")

    def _described(self, version: str) -> DataFrame:
        rows = self.spark.read.parquet(self._path("data", version))
        h = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)).cast("decimal(38,0)")
        files = rows.groupBy(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("checksum"))
        # A version without rows has a line too: that of all files, which has no name.
        return files.where("file <> ''").unionByName(files.agg(F.lit("").alias("file"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("checksum").cast("decimal(38,0)").alias("checksum")))

    def _table(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(part))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def take(self, table: DataFrame, version: str) -> int:
        """Writes, describes and points to ``version``; its rows. A version that is pointed to can't be taken again, a half-written one can."""
        pointers = self._table("pointers", _POINTER).collect()
        if any(r["version"] == version for r in pointers):
            raise ValueError(f"version {version!r} exists")
        table.write.mode("overwrite").parquet(self._path("data", version))
        self._described(version).coalesce(1).write.mode("overwrite").parquet(self._path("manifest", version))
        self.spark.createDataFrame([(version, max((r["seq"] for r in pointers), default=0) + 1)], _POINTER).coalesce(1).write.mode("append").parquet(self._path("pointers"))
        return self.spark.read.parquet(self._path("data", version)).count()

    def versions(self) -> list[str]:
        """Versions that were pointed to and are still there, oldest first."""
        taken = [r["version"] for r in self._table("pointers", _POINTER).orderBy("seq").collect()]
        there = {r["version"] for r in self._table("manifest", f"{_MANIFEST}, version string").select("version").distinct().collect()}
        return [v for v in taken if v in there]

    def read(self, version: str | None = None) -> DataFrame:
        """The table as of ``version``, or of the last one."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"no version {version or ''}".strip())
        return self.spark.read.parquet(self._path("data", version or known[-1]))

    def problems(self, version: str) -> DataFrame:
        """(file, problem): files of a version that are missing, unknown or changed since it was taken; no rows if it is whole."""
        said = self.spark.read.schema(_MANIFEST).parquet(self._path("manifest", version))
        now = self._described(version).select("file", F.col("rows").alias("_rows"), F.col("checksum").alias("_checksum"))
        problem = F.when(F.col("_rows").isNull(), "missing").when(F.col("rows").isNull(), "unknown").when((F.col("rows") != F.col("_rows")) | (F.col("checksum") != F.col("_checksum")), "changed")
        return said.join(now, "file", "full").select("file", problem.alias("problem")).where("problem is not null and file <> ''")

    def prune(self, keep: int, pinned: tuple[str, ...] = ()) -> list[str]:
        """Deletes all but the last ``keep`` versions, of which the one in use is always one, and those ``pinned``; what went.

        The manifest goes first, so a version is never listed without its data.
        """
        known = self.versions()
        gone = [v for v in known[: -max(keep, 1)] if v not in pinned]
        for version in gone:
            for part in ("manifest", "data"):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(part, version))
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return gone
