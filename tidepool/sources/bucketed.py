"""A keyed Parquet table in partitions (exchange, bucket of blocks) of which a merge rewrites only those it touches.

Creation logs arrive in the order of their blocks, so a batch falls into one or two buckets, however large the table
has grown. The rewrite is Spark's dynamic partition overwrite; a merge that is cut short is simply run again, because
it is keyed.

``rollups`` are aggregates kept per partition: a merge makes those of the partitions it rewrites anew, from the rows
it has at hand. Replaced and moved rows so need no inverse, and minima and maxima are as good as sums. A reader
combines the partitions' rows, which are few, and never scans the table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tidepool.runtime import stage_table

BUCKET_BLOCKS = 100_000
BUCKET = "block_bucket"


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "pool_address", group: str = "dex", block: str = "block_number", bucket_blocks: int = BUCKET_BLOCKS,
                 rollups: dict[str, Callable[[DataFrame, list[str]], DataFrame]] | None = None):
        """``rollups``: name to a function of the rows and the columns to group by besides its own."""
        self.rollups = rollups or {}
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.group, self.block, self.bucket_blocks = key, group, block, bucket_blocks

    def _bucket(self) -> Column:
        return F.floor(F.col(self.block) / self.bucket_blocks).cast("long")

    def _stored(self) -> DataFrame:
        """Rows with their bucket. A partition whose rows all moved elsewhere holds one row without a key."""
        schema = StructType([*self.schema.fields]).add(BUCKET, LongType())
        try:
            return self.spark.read.schema(schema).parquet(self.path).select(*schema.names)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._stored().filter(F.col(self.key).isNotNull()).select(*self.schema.names)

    def _overwrite(self, rows: DataFrame, emptied: DataFrame, path: str) -> None:
        whole = rows.unionByName(emptied, allowMissingColumns=True)
        whole.repartition(self.group, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.group, BUCKET).parquet(path)

    def rollup(self, name: str) -> DataFrame:
        """The kept rows of a rollup: one per partition and group."""
        like = self.rollups[name](self.spark.createDataFrame([], StructType([*self.schema.fields]).add(BUCKET, LongType())), [self.group, BUCKET])
        try:
            kept = self.spark.read.schema(like.schema).parquet(f"{self.path}-{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return like
        counted = [c for c in like.columns if c not in (self.group, BUCKET)]
        return kept.select(*like.columns).dropna("all", subset=counted)

    def merge(self, rows: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replaces the partitions that ``rows`` touch by ``apply(their old rows, rows)``; how many they are.

        A key found in another partition than its new row (its block has changed) touches that one too: keys and
        partition columns of the whole table are compared with the batch, other columns are read only where touched.
        """
        batch = stage_table(rows.filter(F.col(self.key).isNotNull()), "merge-batch", n=F.count(F.lit(1)))
        if not batch.metrics["n"]:
            return 0
        new = batch.df.select(self.key, F.col(self.group), self._bucket().alias(BUCKET))
        stored = self._stored()
        old = stored.select(self.key, self.group, BUCKET).join(new.select(self.key).distinct(), self.key, "left_semi")
        places = new.select(self.group, BUCKET).unionByName(old.select(self.group, BUCKET)).distinct()
        touched = [(r[self.group], r[BUCKET]) for r in places.collect()]  # at most two per row of the batch
        by_group: dict[str | None, list[int]] = {}
        for group, bucket in touched:
            by_group.setdefault(group, []).append(bucket)
        inside = reduce(or_, [F.col(self.group).eqNullSafe(F.lit(g)) & (F.col(BUCKET).isin([b for b in bs if b is not None]) | (F.col(BUCKET).isNull() if None in bs else F.lit(False))) for g, bs in by_group.items()])
        before = stored.filter(inside).filter(F.col(self.key).isNotNull()).select(*self.schema.names)
        merged = stage_table(apply(before, batch.df).select(*self.schema.names, self._bucket().alias(BUCKET)), "merge-rows")
        emptied = places.join(merged.df.select(self.group, BUCKET).distinct().withColumn("_full", F.lit(True)), [self.group, BUCKET], "left").filter("_full IS NULL")
        emptied = stage_table(emptied.select(self.group, BUCKET), "merge-empty").df
        self._overwrite(merged.df, emptied, self.path)
        for name, rollup in self.rollups.items():
            self._overwrite(rollup(merged.df, [self.group, BUCKET]), emptied, f"{self.path}-{name}")
        batch.drop()
        merged.drop()
        return len(touched)
