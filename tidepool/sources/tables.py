"""Versioned Parquet tables: every write makes a new version folder, readers take the newest complete one.

Spark writes ``_SUCCESS`` last, so a version cut short by a lost job is never read, and a table can
be rewritten from itself because the path being read is not the path being written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            version = status.getPath().getName()
            if version.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append(int(version[1:]))
        return sorted(found)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str, schema: StructType) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{versions[-1]:08d}")

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        version = (self._versions(name) or [0])[-1] + 1
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}/v{version:08d}")
        return version
