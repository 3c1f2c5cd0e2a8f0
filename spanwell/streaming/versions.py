"""State tables of a stream, one version for each batch.

A batch reads the version before it and writes its own under its number; only then is the number listed. A
batch that is repeated after a failure starts from the same version and replaces its own, and readers
see the last version that is whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Versions:
    spark: SparkSession
    path: str

    def begin(self) -> "Versions":
        """Make the list of versions if there is none yet."""
        self._list(self.spark.range(0).select(F.col("id").alias("number")))
        return self

    def _list(self, numbers: DataFrame) -> None:
        numbers.write.mode("append").parquet(f"{self.path}/listed")

    def latest(self, before: int | None = None) -> int | None:
        listed = self.spark.read.schema("number bigint").parquet(f"{self.path}/listed")
        if before is not None:
            listed = listed.where(F.col("number") < before)
        return listed.agg(F.max("number")).first()[0]

    def read(self, name: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/version={number}")

    def write(self, name: str, number: int, table: DataFrame) -> DataFrame:
        """Write a table of a version, and read it back."""
        path = f"{self.path}/{name}/version={number}"
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def list(self, number: int, *names: str) -> None:
        """Make a version the latest one; of those before only the last is kept, for a batch that is repeated."""
        before = self.latest(number)
        self._list(self.spark.range(1).select(F.lit(number).cast("bigint").alias("number")))
        older = None if before is None else self.latest(before)
        if older is not None:
            for name in names:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/version={older}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
