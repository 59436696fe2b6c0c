"""First inflows on a stream, with the earliest transfer per (wallet, funder) in Spark's state store.

A batch writes only the pairs it has touched, under its own batch number, so what it writes does not depend on how many
pairs there are, and a batch that runs twice writes the same rows to the same place. Readers take the earliest row per
pair, which is what the state holds. ``spark.sql.streaming.stateStore.providerClass`` chooses the store (RocksDB for
states beyond memory).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

INFLOW_DELTAS = "wallet STRING, other STRING, via STRING, hash STRING, value STRING, ts TIMESTAMP, seq BIGINT"


def _earliest() -> Column:
    row = F.struct("via", "hash", "value", "ts", "seq")
    return F.min_by(row, F.struct("ts", "via", "seq", "hash")).alias("_row")


def first_inflows(transfers: DataFrame) -> DataFrame:
    """Earliest usable transfer per (wallet, other), on a table or (in update mode) on a stream.

    ``transfers``: seq, hash, sender, recipient, value (decimal text of any length), is_error, via, ts. Failed and
    self transfers and those of value zero do not count.
    """
    moved = F.regexp_like("value", F.lit("[1-9]"))
    usable = transfers.filter(~F.coalesce("is_error", F.lit(False)) & moved & (F.lower("sender") != F.lower("recipient")))
    rows = usable.select(F.lower("recipient").alias("wallet"), F.lower("sender").alias("other"), "via", "hash", F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts"), "seq")
    return rows.groupBy("wallet", "other").agg(_earliest()).select("wallet", "other", "_row.*")


def stream_first_inflows(transfers: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Writes every pair a batch has touched, with its earliest transfer so far, to ``out_dir/batch_id=N``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    return first_inflows(transfers).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_first_inflows(spark: SparkSession, out_dir: str) -> DataFrame:
    """The earliest transfer of every pair over all batches."""
    try:
        deltas = spark.read.schema(INFLOW_DELTAS).parquet(out_dir)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INFLOW_DELTAS)
    return deltas.groupBy("wallet", "other").agg(_earliest()).select("wallet", "other", "_row.*")
