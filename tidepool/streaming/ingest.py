"""Structured Streaming jobs: launch ingest, rolling volume, first inflows, and the refresh batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool import schemas
from tidepool.operators import listing, market, upsert
from tidepool.operators.decode import build_launches, decode_launches
from tidepool.operators.funding import dedupe_first_inflow
from tidepool.sources.bucketed import BucketedTable
from tidepool.sources.tables import TableStore


def stream_ingest_launches(spark: SparkSession, in_dir: str, store: TableStore, dims: dict[str, DataFrame], checkpoint: str, fmt: str = "parquet",
                           overwrite_metrics: bool = False, launches: BucketedTable | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """New creation logs in ``in_dir`` are decoded and upserted into ``launches``, or without it into the store's.

    ``launches`` rewrites only the partitions a batch touches; a table in the store is rewritten whole, which
    suits small ones. Rows are written before the block checkpoint, and the upsert is keyed by pool, so a batch
    that runs twice has the effect of one. ``dims``: transactions, tokens, quotes, creations.
    """
    options = {} if files_per_batch is None else {"maxFilesPerTrigger": files_per_batch}
    logs = spark.readStream.schema(schemas.RAW_LOGS).format(fmt).options(**options).load(in_dir)

    def save(batch: DataFrame, _batch_id: int) -> None:
        rows = build_launches(decode_launches(_spread(batch)), dims["transactions"], dims["tokens"], dims["quotes"], dims["creations"])
        if launches is not None:
            launches.merge(rows, lambda old, new: upsert.upsert_launches(old, new, overwrite_metrics))
        else:
            merged = upsert.upsert_launches(store.read("launches", schemas.LAUNCHES), rows, overwrite_metrics)
            store.write("launches", merged, ["dex"])
        tips = batch.join(F.broadcast(_factories(spark)), F.lower("address") == F.col("_factory")).groupBy("dex").agg(F.max("block_number").alias("tip"))
        state = store.read("index_state", schemas.INDEX_STATE)
        fresh = tips.select(F.concat("dex", F.lit("-pools")).alias("id"), F.col("tip").alias("indexed_block"), F.lit(schemas.INDEX_VERSION).alias("version"))
        old = state.select("id", F.col("indexed_block").alias("_old"))
        raised = fresh.join(old, "id", "left").select("id", F.greatest("indexed_block", "_old").alias("indexed_block"), "version")
        store.write("index_state", upsert.upsert(state, raised, ["id"], ["indexed_block", "version"]))

    return logs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _spread(batch: DataFrame) -> DataFrame:
    """A batch of fewer splits than cores (a few files) on all cores: decoding costs far more than moving the logs."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch.repartition(cores) if batch.rdd.getNumPartitions() < cores else batch


def _factories(spark: SparkSession) -> DataFrame:
    from tidepool.sources.dex import dex_catalog

    return dex_catalog(spark).select("dex", F.col("factory").alias("_factory")).distinct()


def rolling_volume(swaps: DataFrame, window: str = "24 hours", slide: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Volume and swaps per pool in sliding windows, on a stream or a table of (pool_address, amount, ts).

    Swaps are first summed per slide-wide bucket; a window combines buckets, so a busy pool's swaps are
    never multiplied by the number of windows they fall into. The watermark bounds the state.
    """
    timed = swaps.withWatermark("ts", lateness) if swaps.isStreaming else swaps
    buckets = timed.groupBy("pool_address", F.window("ts", slide).alias("bucket")).agg(F.sum("amount").alias("amount"), F.count("*").alias("swaps"))
    at = F.window_time("bucket")
    windows = buckets.groupBy("pool_address", F.window(at, window, slide).alias("w")).agg(F.sum("amount").alias("volume"), F.sum("swaps").alias("swaps"))
    return windows.select("pool_address", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "volume", "swaps")


def stream_rolling_volume(swaps: DataFrame, out_dir: str, checkpoint: str, window: str = "24 hours", slide: str = "1 hour", lateness: str = "1 hour") -> StreamingQuery:
    """Appends every finished window to Parquet files."""
    rows = rolling_volume(swaps, window, slide, lateness)
    return rows.writeStream.format("parquet").outputMode("append").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FIRST_INFLOWS = "wallet STRING, other STRING, via STRING, hash STRING, value DOUBLE, ts TIMESTAMP, seq BIGINT"


def stream_first_inflow(transfers: DataFrame, store: TableStore, checkpoint: str, table: str = "first_inflows") -> StreamingQuery:
    """Keeps the earliest transfer per (wallet, funder), whatever order they arrive in.

    State is the table itself: each batch is reduced to its own firsts and merged by the same rule.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(FIRST_INFLOWS)

    def save(batch: DataFrame, _batch_id: int) -> None:
        kept = store.read(table, schema).select(
            F.col("other").alias("sender"), F.col("wallet").alias("recipient"), "value", F.lit(False).alias("is_error"), "ts", "via", "hash", "seq"
        )
        firsts = dedupe_first_inflow(batch.select(*kept.columns).unionByName(kept).withColumn("hash", F.struct("hash", "seq")))
        store.write(table, firsts.select("wallet", "other", "via", F.col("hash.hash").alias("hash"), "value", "ts", F.col("hash.seq").alias("seq")))

    return transfers.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_market_batch(launches: DataFrame, liquidity: DataFrame, volume: DataFrame, pair_aggregates: DataFrame, as_of: Column, limit: int | None = None,
                         window_hours: float = schemas.MONITOR_WINDOW_HOURS, stale_min: float = schemas.MARKET_STALE_MINUTES) -> DataFrame:
    """Launches with fresh market data for every stale one (or the ``limit`` longest-waiting).

    Pools with a liquidity and a volume reading get computed data, the rest pair aggregates.
    """
    due = listing.stale_market_candidates(launches, as_of, limit, window_hours, stale_min)
    computed = market.market_data(due, liquidity.filter("liquidity_usd IS NOT NULL"), volume.filter("volume_usd IS NOT NULL"), as_of)
    done = upsert.save_market_data(launches, computed)
    rest = due.join(computed.select("pool_address"), "pool_address", "left_anti")
    return upsert.save_market_data(done, market.market_data_fallback(rest, pair_aggregates, as_of))


def refresh_intel_batch(launches: DataFrame, analyse_due, as_of: Column, limit: int | None = None,
                        window_hours: float = schemas.MONITOR_WINDOW_HOURS, stale_min: float = schemas.INTEL_STALE_MINUTES) -> DataFrame:
    """Launches with fresh intel columns; ``analyse_due(due_launches)`` returns ``pool_intel`` rows."""
    due = listing.stale_intel_candidates(launches, as_of, limit, window_hours, stale_min)
    intel = analyse_due(due).withColumn("intel_updated_at", as_of)
    return upsert.save_launch_intel(launches, intel)
