"""Real volume of every pool straight from raw logs: one job from 256-bit words to the external/insider split.

Block bounds are literals on the log and the transaction scan, so both prune files and row groups. Amounts stay limbs
until they have been summed, ordered and compared; a double is made once, at the end, of the exact totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.words import limbs_hex, sum_u256
from tidepool.operators import intel
from tidepool.operators.decode import resolve_traders, tag_swaps
from tidepool.runtime import skew_join
from tidepool.schemas import BLOCKS_PER_DAY

POOL = "pool_address"


def in_window(df: DataFrame, tip_block: int, window_blocks: int = BLOCKS_PER_DAY) -> DataFrame:
    """Rows of the blocks from ``tip_block - window_blocks`` to ``tip_block``, both included."""
    return df.filter(F.col("block_number").between(tip_block - window_blocks, tip_block))


def window_logs(logs: DataFrame, pools: DataFrame, tip_block: int, window_blocks: int = BLOCKS_PER_DAY) -> DataFrame:
    """Every log of a pool in the trailing window, never from before the pool's launch.

    ``pools``: pool_address, launch_block and whatever the caller needs next to the log.
    """
    recent = in_window(logs, tip_block, window_blocks).withColumn(POOL, F.lower("address"))
    return skew_join(recent, pools, POOL).filter(F.col("block_number") >= F.col("launch_block"))


def window_traders(logs: DataFrame, transactions: DataFrame, pools: DataFrame, tip_block: int, window_blocks: int = BLOCKS_PER_DAY) -> DataFrame:
    """``trader_activity`` rows of the window's decodable swaps; ``pools`` carries quote_is_token0."""
    seen = window_logs(logs, pools.select(POOL, "launch_block", "quote_is_token0"), tip_block, window_blocks)
    swaps = tag_swaps(seen, F.col("quote_is_token0"), only=True)
    signed = resolve_traders(swaps, in_window(transactions, tip_block, window_blocks))
    return intel.trader_activity(signed.withColumn("ts", F.timestamp_seconds("time_stamp")))


def logs_seen(logs: DataFrame, pools: DataFrame, tip_block: int, window_blocks: int = BLOCKS_PER_DAY) -> DataFrame:
    """Logs per pool in the window, decodable or not. Reads two columns of the log table."""
    narrow = logs.select("address", "block_number")
    return window_logs(narrow, pools.select(POOL, "launch_block"), tip_block, window_blocks).groupBy(POOL).agg(F.count("*").alias("analyzed_trades"))


def exact_totals(classified: DataFrame) -> DataFrame:
    """Exact totals per pool as fixed-width hex: all traders, and the insiders among them."""
    insider = F.col("classification") != "external"
    sums = classified.groupBy(POOL).agg(
        sum_u256(F.col("quote_raw")).alias("_all"),
        sum_u256(F.transform("quote_raw", lambda x: F.when(insider, x).otherwise(F.lit(0)))).alias("_insider"),
    )
    return sums.select(POOL, limbs_hex(F.col("_all")).alias("total_quote_hex"), limbs_hex(F.col("_insider")).alias("insider_quote_hex"))


def pool_intel_from_logs(
    logs: DataFrame, transactions: DataFrame, pools: DataFrame, edges: DataFrame, labels: DataFrame, tip_block: int,
    window_blocks: int = BLOCKS_PER_DAY, **graph: object,
) -> DataFrame:
    """Intel of every pool from its raw logs: ``pool_intel`` columns and the exact totals.

    ``logs``: address, topics, data, block_number, time_stamp, tx_hash, log_index. ``transactions``: hash, from,
    block_number. ``pools``: pool_address (lower case), creator, launch_block, quote_is_token0, quote_decimals,
    price_usd, volume_usd. ``graph``: options of ``attendees.analyse``. Pools without a swap in the window have
    zero counts and no volume of their own.
    """
    from tidepool.plans import attendees
    from tidepool.runtime import stage

    pools = stage(pools, "intel-pools")
    traders = window_traders(logs, transactions, pools, tip_block, window_blocks)
    done = attendees.analyse(pools, traders, edges, labels, **graph)
    rows = intel.pool_intel(done.classified, pools, logs_seen(logs, pools, tip_block, window_blocks))
    zero = F.lit("0" * 72)
    return rows.join(exact_totals(done.classified), POOL, "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("total_quote_hex", "insider_quote_hex")}
    )


def tip_of(blocks: DataFrame, column: str = "block_number") -> int:
    """Newest block of a table."""
    return int(blocks.agg(F.max(column)).first()[0] or 0)


def pool_sides(launches: DataFrame) -> DataFrame:
    """Adds launch_block and quote_is_token0 to launch rows (token_address, quote_address, block_number)."""
    first: Column = F.lower("quote_address") < F.lower("token_address")
    return launches.withColumns({"launch_block": F.col("block_number"), "quote_is_token0": first})
