"""Tables that batches write to, each a partition of its own."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """Tables of runs in a folder, a partition for each batch; a partition is written whole, so a batch that runs again replaces its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, table: str, batch: int, rows: DataFrame) -> DataFrame:
        at = f"{self.path}/{table}/batch={batch}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def before(self, table: str, batch: int, schema: str) -> DataFrame:
        """Rows of earlier batches, with ``batch``; what a failed attempt of this one left is not among them."""
        kind = T.StructType.fromDDL(schema).add("batch", T.LongType())
        try:
            return self.spark.read.schema(kind).parquet(f"{self.path}/{table}").where(F.col("batch") < batch)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], kind)
