"""Prices, liquidity, volume and first trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.words import format_units, format_units_limbs, limbs_hex, limbs_number, sum_u256, u256_limbs, units_text
from tidepool.operators.asof import asof_join
from tidepool.runtime import skew_join, top_k
from tidepool.schemas import BLOCKS_PER_DAY, FIRST_TRADES
from tidepool.sources.dex import DEXES, STABLE_QUOTES, VIRTUAL, WETH, DexSpec, per_dex


def _positive(price: Column) -> Column:
    return F.when((price > 0) & (price < float("inf")), price)


def _deepest() -> Column:
    """Aggregate: price of the pair with the most liquidity (unknown = 0) among positive prices."""
    usable = (F.col("source") == "pair") & (F.col("price_usd") > 0)
    rank = F.struct(F.coalesce(F.col("liquidity_usd"), F.lit(0)), F.col("at"), F.col("event_id"))
    return F.max_by("price_usd", F.when(usable, rank))


def deepest_pair_price(observations: DataFrame) -> DataFrame:
    return observations.groupBy("token").agg(_positive(_deepest()).alias("price_usd")).filter("price_usd IS NOT NULL")


def quote_price(observations: DataFrame, as_of: Column | None = None, ttl_s: float | None = None,
                stable: list[str] = STABLE_QUOTES, native: str = WETH, listed: list[str] = [VIRTUAL]) -> DataFrame:
    """USD price per quote token as of a moment.

    Stable tokens are 1. The native token takes the primary feed, then the secondary one; listed
    tokens the primary feed, then the deepest pair; all others the deepest pair. Only finite positive
    prices count. One aggregation: the latest observation of each feed is a max_by.
    """
    seen = observations
    known = seen.sparkSession.createDataFrame([(token,) for token in stable], "token STRING")  # stable without any observation
    if as_of is not None:
        seen = seen.filter(F.col("at") <= as_of)
        if ttl_s is not None:
            seen = seen.filter(F.col("at") > as_of - F.make_dt_interval(secs=F.lit(ttl_s)))

    def latest(source: str) -> Column:
        return _positive(F.max_by("price_usd", F.when(F.col("source") == source, F.struct("at", "event_id"))))

    token = F.lower("token")
    feeds = seen.unionByName(known, allowMissingColumns=True).withColumn("token", token).groupBy("token").agg(
        latest("primary").alias("primary"), latest("secondary").alias("secondary"), _positive(_deepest()).alias("deepest")
    )
    price = (
        F.when(F.col("token").isin(stable), F.lit(1.0))
        .when(F.col("token") == native, F.coalesce("primary", "secondary"))
        .when(F.col("token").isin(listed), F.coalesce("primary", "deepest"))
        .otherwise(F.col("deepest"))
    )
    return feeds.select("token", price.alias("price_usd")).filter("price_usd IS NOT NULL")


def price_snapshots(observations: DataFrame) -> DataFrame:
    """One row per token and moment: primary, secondary and pair readings, as structs whose price_usd is NULL for a failed one.

    The pair reading of a moment is the deepest pair seen then (unknown depth = 0) among those with a positive price.
    """
    def reading(source: str, price: Column) -> Column:
        return F.when(F.count(F.when(F.col("source") == source, 1)) > 0, F.struct(_positive(price).alias("price_usd"))).alias(source)

    def latest(source: str) -> Column:
        return F.max_by("price_usd", F.when(F.col("source") == source, F.col("event_id")))

    deepest = F.max_by("price_usd", F.when((F.col("source") == "pair") & (F.col("price_usd") > 0), F.struct(F.coalesce(F.col("liquidity_usd"), F.lit(0)), F.col("event_id"))))
    return observations.withColumn("token", F.lower("token")).groupBy("token", "at").agg(
        reading("primary", latest("primary")), reading("secondary", latest("secondary")), reading("pair", deepest)
    )


def priced_as_of(rows: DataFrame, observations: DataFrame, quote: str, at: str, ttl: Column | None = None,
                 stable: list[str] = STABLE_QUOTES, native: str = WETH, listed: list[str] = [VIRTUAL]) -> DataFrame:
    """``rows`` with the USD price of their quote token at their own time.

    The same preference as ``quote_price``; a reading counts until ``ttl`` has passed, a failed one as no price
    until the next reading of its feed.
    """
    found = asof_join(rows.withColumn("token", F.lower(quote)), price_snapshots(observations), "token", at, "at", ["primary", "secondary", "pair"], ttl)
    price = (
        F.when(F.col("token").isin(stable), F.lit(1.0))
        .when(F.col("token") == native, F.coalesce("primary.price_usd", "secondary.price_usd"))
        .when(F.col("token").isin(listed), F.coalesce("primary.price_usd", "pair.price_usd"))
        .otherwise(F.col("pair.price_usd"))
    )
    return found.withColumn("price_usd", price).drop("token", "primary", "secondary", "pair")


def latest_reserves(reserves: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Latest quote reserve per pool at or before ``as_of`` from (pool_address, at, quote_reserve_raw)."""
    seen = reserves if as_of is None else reserves.filter(F.col("at") <= as_of)
    return seen.groupBy("pool_address").agg(F.max_by("quote_reserve_raw", "at").alias("quote_reserve_raw"))


def quote_reserves(pools: DataFrame, readings: DataFrame, as_of: Column | None = None, specs: list[DexSpec] | None = None) -> DataFrame:
    """Latest quote reserve per pool at or before ``as_of``, exact, by the rule of the pool's exchange.

    ``pools``: pool_address, dex, quote_is_token0. ``readings``: pool_address, at, seq, kind and two words of 64 hex
    digits: of a ``pair`` reading the reserves of token0 and token1, of a ``balance`` reading the pool's quote balance
    in the first. Pools without a reading of their exchange's kind are left out.
    """
    specs = DEXES if specs is None else specs
    seen = readings if as_of is None else readings.filter(F.col("at") <= as_of)
    last = seen.groupBy("pool_address", "kind").agg(F.max_by(F.struct("word0", "word1"), F.struct("at", "seq")).alias("_words"))
    wanted = pools.select("pool_address", "quote_is_token0", per_dex(specs, F.col("dex"), lambda spec: spec.id, lambda spec: spec.reserve).alias("kind"))
    word = F.when((F.col("kind") == "balance") | F.col("quote_is_token0"), F.col("_words.word0")).otherwise(F.col("_words.word1"))
    return wanted.join(last, ["pool_address", "kind"]).select("pool_address", u256_limbs(word).alias("quote_reserve_limbs"))


def priced(launches: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds the quote token's price_usd (NULL when unpriced); few quote tokens carry most launches."""
    dim = prices.select(F.col("token").alias("_quote"), "price_usd")
    return skew_join(launches.withColumn("_quote", F.lower("quote_address")), dim, "_quote", "left").drop("_quote")


def pool_liquidity(launches: DataFrame, reserves: DataFrame) -> DataFrame:
    """2 x quote reserve x price per pool; ``launches`` carries quote_decimals and price_usd.

    ``reserves``: pool_address and quote_reserve_raw (BIGINT) or quote_reserve_limbs.
    """
    raw = limbs_number(F.col("quote_reserve_limbs")) if "quote_reserve_limbs" in reserves.columns else F.col("quote_reserve_raw")
    usd = format_units(raw, F.col("quote_decimals")) * F.col("price_usd") * 2
    return launches.select("pool_address", "quote_decimals", "price_usd").join(reserves, "pool_address").select("pool_address", usd.alias("liquidity_usd"))


def pools_x_swaps(launches: DataFrame, swaps: DataFrame, tip_block: int, window_blocks: int = BLOCKS_PER_DAY) -> DataFrame:
    """Each launch's swaps of the trailing block window, never from before the launch itself.

    The window bounds are literals on the swap scan; only the per-launch bound needs the join.
    """
    recent = swaps.filter(F.col("block_number").between(tip_block - window_blocks, tip_block))
    return skew_join(recent, launches.withColumnRenamed("block_number", "launch_block"), "pool_address").filter(
        F.col("block_number") >= F.col("launch_block")
    )


def quote_sum(columns: list[str]) -> Column:
    """Aggregate: exact raw quote total, from limbs when the swaps carry them, else from a BIGINT."""
    return sum_u256(F.col("quote_limbs")) if "quote_limbs" in columns else F.sum("quote_raw")


def raw_to_units(raw: Column, decimals: Column, limbs: bool) -> Column:
    return format_units_limbs(raw, decimals) if limbs else format_units(raw, decimals)


def pool_volume(pool_swaps: DataFrame, launches: DataFrame) -> DataFrame:
    """Traded quote volume per pool and its USD value.

    ``launches`` carries quote_decimals and price_usd; pools without swaps have volume 0.
    """
    totals = pool_swaps.groupBy("pool_address").agg(quote_sum(pool_swaps.columns).alias("_raw"))
    units = raw_to_units(F.col("_raw"), F.col("quote_decimals"), "quote_limbs" in pool_swaps.columns)
    return launches.select("pool_address", "quote_decimals", "price_usd").join(totals, "pool_address", "left").select(
        "pool_address", (F.coalesce(units, F.lit(0.0)) * F.col("price_usd")).alias("volume_usd")
    )


def market_data(launches: DataFrame, liquidity: DataFrame, volume: DataFrame, as_of: Column) -> DataFrame:
    """Liquidity and volume with real/insider volume re-derived from the last known insider ratio."""
    ratio = F.col("insider_ratio")
    joined = launches.select("pool_address", "insider_ratio").join(liquidity, "pool_address").join(volume, "pool_address")
    return joined.select(
        "pool_address", "liquidity_usd", "volume_usd",
        (F.col("volume_usd") * (1 - ratio)).alias("external_volume_usd"),
        (F.col("volume_usd") * ratio).alias("insider_volume_usd"),
        as_of.alias("market_data_updated_at"),
    )


def market_data_fallback(launches: DataFrame, pair_aggregates: DataFrame, as_of: Column) -> DataFrame:
    """Market data of pools without usable price or decimals, from third-party pair aggregates.

    ``launches`` holds just those pools. Real and insider volume are not part of the result, so a
    partial update leaves them as they were.
    """
    pairs = pair_aggregates.select(F.lower("pair_address").alias("_pool"), "liquidity_usd", F.col("volume_h24").alias("volume_usd"))
    return launches.select("pool_address").join(pairs, F.lower("pool_address") == F.col("_pool"), "left").select(
        "pool_address", "liquidity_usd", "volume_usd", as_of.alias("market_data_updated_at")
    )


def real_volume_split(total: Column, measured: Column, ratio: Column) -> tuple[Column, Column, Column]:
    """(total, external, insider): the stored total when positive, else the measured one."""
    base = F.when(total > 0, total).otherwise(measured)
    share = F.coalesce(ratio, F.lit(0.0))
    return base, base * (1 - share), base * share


def first_trades(launches: DataFrame, swaps: DataFrame, transactions: DataFrame | None = None, n: int = FIRST_TRADES, tie: list[str] | None = None) -> DataFrame:
    """The first ``n`` swaps of every pool since its launch, ranked in log order.

    ``launches``: pool_address, launch_block and, for USD values, quote_decimals and price_usd.
    Undecodable swaps stay, as a buy of "0". Signers are looked up for the kept rows only.
    """
    order = [F.col(c) for c in ["block_number", "log_index", *(tie or [])]]
    since = skew_join(swaps, launches, "pool_address").filter(F.col("block_number") >= F.col("launch_block"))
    kept = top_k(since, ["pool_address"], order, n, "rank", spread=32)
    limbs = "quote_limbs" in swaps.columns
    raw = F.col("quote_limbs") if limbs else F.col("quote_raw")
    units = raw_to_units(raw, F.col("quote_decimals"), limbs)
    digits = limbs_hex(raw) if limbs else F.hex(raw)
    if transactions is not None:
        senders = transactions.select(F.lower("hash").alias("_hash"), F.lower("from").alias("_signer"))
        kept = kept.join(senders, F.lower("tx_hash") == F.col("_hash"), "left")
        trader = F.coalesce("_signer", F.lower("recipient"), F.lit("unknown"))
    else:
        trader = F.coalesce("trader", F.lit("unknown"))
    return kept.select(
        F.concat_ws("-", "tx_hash", "log_index").alias("id"), "pool_address", F.col("rank").cast("long").alias("rank"),
        F.coalesce("side", F.lit("buy")).alias("side"), trader.alias("trader"),
        (units * F.col("price_usd")).alias("amount_usd"),
        F.coalesce(units_text(digits, F.col("quote_decimals")), F.lit("0")).alias("quote_amount"),
        F.col("ts").alias("timestamp"), "tx_hash",
    )
