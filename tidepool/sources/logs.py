"""Readers for raw event logs and raw value transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import schemas


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw logs from Parquet or JSON lines, with the declared schema (no inference pass)."""
    return spark.read.schema(schemas.RAW_LOGS).format(fmt).load(path)


def read_transfers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.RAW_TRANSFERS).format(fmt).load(path)


def scan_logs(raw_logs: DataFrame, address: str | None, topic0: str, from_block: int, to_block: int | None = None) -> DataFrame:
    """Logs of one event in a block range, all literal predicates so that they reach the scan.

    The order of a log is its (block_number, log_index); rows are left unsorted, and consumers that
    need the order sort or rank by those two columns.
    """
    wanted = (F.get("topics", F.lit(0)) == topic0.lower()) & (F.col("block_number") >= from_block)
    if address is not None:
        wanted = wanted & (F.lower("address") == address.lower())
    if to_block is not None:
        wanted = wanted & (F.col("block_number") <= to_block)
    return raw_logs.filter(wanted)


def scan_transfers(normal: DataFrame, internal: DataFrame) -> DataFrame:
    """Both transfer lists in one table, tagged with where each row came from."""
    return normal.withColumn("via", F.lit("external")).unionByName(internal.withColumn("via", F.lit("internal")))
