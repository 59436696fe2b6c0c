"""Rolling volume without loss: late rows count, and windows still open have their value so far.

Sums add up, so a batch needs no state: it writes its own sums per pool and slide-wide bucket under its batch number
(a batch that runs twice writes the same). Windows are sums over buckets. ``settle`` turns the buckets of all batches
so far into windows once, so that a reader combines finished windows with the few buckets that came since; a late row
is a bucket of a later batch like any other, and adds to windows that were settled long ago.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = "pool_address STRING, bucket TIMESTAMP, volume BIGINT, swaps BIGINT, late_swaps BIGINT, batch_id BIGINT"
WINDOWS = "pool_address STRING, window_start TIMESTAMP, window_end TIMESTAMP, volume BIGINT, swaps BIGINT, upto BIGINT"


class RollingVolume:
    """``out_dir/buckets/batch_id=N`` and ``out_dir/windows/upto=N`` (windows of all batches up to N since the last)."""

    def __init__(self, spark: SparkSession, out_dir: str, window: str = "24 hours", slide: str = "1 hour", lateness: str = "1 hour"):
        self.spark, self.out_dir = spark, out_dir.rstrip("/")
        self.window, self.slide, self.lateness = window, slide, lateness

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.out_dir}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def start(self, swaps: DataFrame, checkpoint: str) -> StreamingQuery:
        """``swaps``: pool_address, amount (BIGINT), ts; rows without a time fall into no window."""

        def save(batch: DataFrame, batch_id: int) -> None:
            newest = self._read("buckets", BUCKETS).filter(F.col("batch_id") < batch_id).agg(F.max("bucket").cast("string")).first()[0]
            rows = batch.filter("ts IS NOT NULL").groupBy("pool_address", F.window("ts", self.slide)["start"].alias("bucket")).agg(F.sum("amount").alias("volume"), F.count("*").alias("swaps"))
            late = F.col("bucket") < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {self.lateness}")
            marked = rows.withColumn("late_swaps", F.when(late, F.col("swaps")).otherwise(0).cast("long"))
            marked.write.mode("overwrite").parquet(f"{self.out_dir}/buckets/batch_id={batch_id}")

        return swaps.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _windows(self, buckets: DataFrame) -> DataFrame:
        """Windows of the given buckets; buckets of one pool and time are added first, so a busy pool costs no more."""
        summed = buckets.groupBy("pool_address", "bucket").agg(F.sum("volume").alias("volume"), F.sum("swaps").alias("swaps"))
        placed = summed.withColumn("w", F.window("bucket", self.window, self.slide))
        return placed.select("pool_address", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "volume", "swaps")

    def _open(self) -> tuple[DataFrame, int]:
        done = self._read("windows", WINDOWS).agg(F.max("upto")).first()[0]
        done = -1 if done is None else int(done)
        return self._read("buckets", BUCKETS).filter(F.col("batch_id") > done), done

    def settle(self) -> None:
        """Turns the buckets since the last call into windows; readers skip those buckets from then on."""
        fresh, done = self._open()
        upto = fresh.agg(F.max("batch_id")).first()[0]
        if upto is not None:
            self._added(self._windows(fresh)).write.mode("overwrite").parquet(f"{self.out_dir}/windows/upto={upto}")

    @staticmethod
    def _added(windows: DataFrame) -> DataFrame:
        return windows.groupBy("pool_address", "window_start", "window_end").agg(F.sum("volume").alias("volume"), F.sum("swaps").alias("swaps"))

    def windows(self) -> DataFrame:
        """Every window that holds a row, finished or open, with all rows that have arrived."""
        fresh, _ = self._open()
        return self._added(self._read("windows", WINDOWS).drop("upto").unionByName(self._windows(fresh)))

    def late(self) -> DataFrame:
        """Per pool: rows that came later than the lateness allowed, and the buckets they belong to."""
        return self._read("buckets", BUCKETS).filter("late_swaps > 0").groupBy("pool_address").agg(F.sum("late_swaps").alias("late_swaps"), F.countDistinct("bucket").alias("late_buckets"))
