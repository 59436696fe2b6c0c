"""Queries over raw logs, tokens, prices and swaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions.text import fee_label, secs_after_launch, token_age_hours
from tidepool.functions.words import format_units_limbs, limbs_hex, sum_u256
from tidepool.operators import decode, market
from tidepool.plans.fixtures import Fixtures, duckdb_cte
from tidepool.plans.registry import query
from tidepool.sources.dex import dex_catalog, is_known_quote, is_quote_token0, quote_dim, quote_token

TOKENS = duckdb_cte("f_pool_tokens")
HEX = "'0x' || lpad(lower(hex({0})), 40, '0')"
WETH_SQL, USDC_SQL = "'0x4200000000000000000000000000000000000006'", "'0x833589fcd6edb6e08f4c7c32d4f71b54bda02913'"
AERO_SQL, VIRTUAL_SQL = "'0x940181a94a35a4569e4529a3cdfb74e38fd98631'", "'0x0b3e328455c4059eeb9e3f84b5543f74e24e7e1b'"
SYMBOL_SQL = f"CASE WHEN lower(token1) = {WETH_SQL} THEN 'WETH' WHEN lower(token1) = {USDC_SQL} THEN 'USDC' WHEN token1 = {VIRTUAL_SQL} THEN 'VIRTUAL' WHEN token1 = {AERO_SQL} AND dex = 'aerodrome' THEN 'AERO' END"


# ---- exchanges and quote tokens

@query("dex_catalog", f"""{TOKENS}, c(dex, label, pool_type) AS (VALUES ('uniswap-v2', 'Uniswap V2', 'volatile'), ('aerodrome', 'Aerodrome', 'volatile'), ('aerodrome', 'Aerodrome', 'stable'),
 ('uniswap-v3', 'Uniswap V3', '100'), ('uniswap-v3', 'Uniswap V3', '500'), ('uniswap-v3', 'Uniswap V3', '3000'), ('uniswap-v3', 'Uniswap V3', '10000'))
 SELECT c.dex, c.label, c.pool_type, n.pools FROM c LEFT JOIN (SELECT dex, count(*) AS pools FROM f_pool_tokens GROUP BY dex) n ON n.dex = c.dex""")
def catalog_usage(fx: Fixtures):
    """Catalogue rows with the number of pools each exchange has."""
    pools = fx.f_pool_tokens.groupBy("dex").agg(F.count("*").alias("pools"))
    return dex_catalog(fx.spark).join(pools, "dex", "left").select("dex", "label", "pool_type", "pools")


@query("quote_dim", f"{TOKENS}, s AS (SELECT dex, {SYMBOL_SQL} AS symbol FROM f_pool_tokens) SELECT dex, symbol, count(*) AS pools FROM s WHERE symbol IS NOT NULL GROUP BY dex, symbol")
def quote_usage(fx: Fixtures):
    """Effective quote tokens per exchange, by the pools that use them."""
    pools = fx.f_pool_tokens.select("dex", F.lower("token1").alias("address"))
    return pools.join(F.broadcast(quote_dim(fx.spark)), ["dex", "address"]).groupBy("dex", "symbol").agg(F.count("*").alias("pools"))


query("is_known_quote", f"{TOKENS} SELECT pool_address, dex, token1, {SYMBOL_SQL} IS NOT NULL AS token1_is_quote FROM f_pool_tokens")(
    lambda fx: is_known_quote(fx.f_pool_tokens, quote_dim(fx.spark), "token1").select("pool_address", "dex", "token1", "token1_is_quote"))
query("quote_token", f"{TOKENS} SELECT pool_address, {SYMBOL_SQL} AS symbol, CASE WHEN {SYMBOL_SQL} = 'USDC' THEN 6 WHEN {SYMBOL_SQL} IS NOT NULL THEN 18 END AS decimals FROM f_pool_tokens")(
    lambda fx: quote_token(fx.f_pool_tokens, quote_dim(fx.spark), "token1").select(
        "pool_address", F.col("token1_symbol").alias("symbol"), F.col("token1_decimals").alias("decimals")))
query("launch_x_quote", f"{TOKENS} SELECT dex, coalesce({SYMBOL_SQL}, '?') AS symbol, count(*) AS pools FROM f_pool_tokens GROUP BY 1, 2")(
    lambda fx: quote_token(fx.f_pool_tokens, quote_dim(fx.spark), "token1").groupBy("dex", F.coalesce("token1_symbol", F.lit("?")).alias("symbol")).agg(F.count("*").alias("pools")))
query("is_quote_token0", f"{TOKENS} SELECT pool_address, lower(token1) < token0 AS quote_first FROM f_pool_tokens")(
    lambda fx: fx.f_pool_tokens.select("pool_address", is_quote_token0(F.col("token1"), F.col("token0")).alias("quote_first")))
query("fee_label", "SELECT DISTINCT l_partkey * 100 + l_linenumber AS fee, printf('%.2f%%', (l_partkey * 100 + l_linenumber) / 10000.0e0) AS label FROM lineitem")(
    lambda fx: fx.lineitem.select((F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("fee")).distinct().withColumn("label", fee_label(F.col("fee"))))


# ---- raw logs

_POOL = HEX.format("l_suppkey")
_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_SWAP = f"{_POOL} AS pool_address, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, lower(hex({_CENTS})) AS amount_hex, {HEX.format('l_partkey')} AS recipient, l_orderkey AS block_number, CAST(l_linenumber AS BIGINT) AS log_index FROM lineitem"


def _printed(df):
    """Amount in units of 2^64, as hex without leading zeros."""
    digits = F.ltrim(F.substring(limbs_hex(F.col("quote_limbs")), 1, 72 - 16), F.lit("0"))
    # A one-element transform, so that the digits are made once.
    shown = F.transform(F.array(digits), lambda d: F.when(d == "", "0").otherwise(d))[0]
    return df.select("pool_address", "side", shown.alias("amount_hex"), "recipient", "block_number", "log_index")


query("decode_swaps_v2", f"SELECT {_SWAP} WHERE l_suppkey % 3 <> 2 AND l_quantity <> 50")(lambda fx: _printed(decode.decode_swaps_v2(fx.swap_logs(), F.col("quote_is_token0"))))
query("decode_swaps_v3", f"SELECT {_SWAP} WHERE l_suppkey % 3 = 2 AND l_quantity <> 50")(lambda fx: _printed(decode.decode_swaps_v3(fx.swap_logs(), F.col("quote_is_token0"))))


_WIDE_AMOUNT = f"CAST({_CENTS} AS HUGEINT) * 18446744073709551616 + (l_partkey + 1) * 4294967311 + l_orderkey"
_WIDE_SWAP = f"{_POOL} AS pool_address, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, lpad(lower(hex({_WIDE_AMOUNT})), 72, '0') AS amount_hex, {HEX.format('l_partkey')} AS recipient, l_orderkey AS block_number, CAST(l_linenumber AS BIGINT) AS log_index FROM lineitem"


def _all_digits(df):
    return df.select("pool_address", "side", limbs_hex(F.col("quote_limbs")).alias("amount_hex"), "recipient", "block_number", "log_index")


query("decode_swaps_v2_wide", f"SELECT {_WIDE_SWAP} WHERE l_suppkey % 3 <> 2 AND l_quantity <> 50")(lambda fx: _all_digits(decode.decode_swaps_v2(fx.swap_logs(wide=True), F.col("quote_is_token0"))))
query("decode_swaps_v3_wide", f"SELECT {_WIDE_SWAP} WHERE l_suppkey % 3 = 2 AND l_quantity <> 50")(lambda fx: _all_digits(decode.decode_swaps_v3(fx.swap_logs(wide=True), F.col("quote_is_token0"))))


@query("sum_u256_wide", f"SELECT {_POOL} AS pool_address, count(*) AS swaps, lpad(lower(hex(sum({_WIDE_AMOUNT}))), 72, '0') AS total_hex FROM lineitem WHERE l_quantity <> 50 GROUP BY l_suppkey")
def summed_wide(fx: Fixtures):
    """Exact 256-bit totals, every digit compared."""
    rows = decode.tag_swaps(fx.swap_logs(wide=True), F.col("quote_is_token0"), only=True).groupBy("pool_address").agg(
        F.count("*").alias("swaps"), sum_u256(F.col("quote_limbs")).alias("limbs"))
    return rows.select("pool_address", "swaps", limbs_hex(F.col("limbs")).alias("total_hex"))


@query("sum_u256", f"""SELECT {_POOL} AS pool_address, count(*) AS swaps, lower(hex(CAST(sum({_CENTS}) AS BIGINT))) AS total_hex FROM lineitem WHERE l_quantity <> 50 GROUP BY l_suppkey""")
def summed(fx: Fixtures):
    """Exact 256-bit totals over all swaps of all exchanges, in units of 2^64."""
    rows = decode.tag_swaps(fx.swap_logs(), F.col("quote_is_token0"), only=True).groupBy("pool_address").agg(
        F.count("*").alias("swaps"), sum_u256(F.col("quote_limbs")).alias("limbs"))
    return rows.select("pool_address", "swaps", F.ltrim(F.substring(limbs_hex(F.col("limbs")), 1, 72 - 16), F.lit("0")).alias("total_hex"))


@query("format_units", f"""SELECT {_POOL} AS pool_address, round(CAST(sum({_CENTS}) AS DOUBLE) * 18446744073709551616.0e0 / 1.0e20, 4) AS units FROM lineitem WHERE l_quantity <> 50 GROUP BY l_suppkey""")
def formatted(fx: Fixtures):
    rows = decode.tag_swaps(fx.swap_logs(), F.col("quote_is_token0"), only=True).groupBy("pool_address").agg(sum_u256(F.col("quote_limbs")).alias("limbs"))
    return rows.select("pool_address", F.round(format_units_limbs(F.col("limbs"), F.lit(20)), 4).alias("units"))


_POOL_HEX = HEX.format("o.o_orderkey")
_CREATED = f"""{TOKENS} SELECT {_POOL_HEX} AS pool_address, t.dex, t.token0, lower(t.token1) AS token1, o.o_orderkey AS block_number,
 CASE WHEN t.dex = 'uniswap-v3' THEN CASE WHEN o.o_orderpriority = '5-LOW' THEN '3000' ELSE '500' END WHEN t.dex = 'aerodrome' AND o.o_orderpriority = '5-LOW' THEN 'stable' ELSE 'volatile' END AS pool_type,
 CASE WHEN t.dex = 'uniswap-v3' THEN CASE WHEN o.o_orderpriority = '5-LOW' THEN '0.30%' ELSE '0.05%' END WHEN t.dex = 'aerodrome' AND o.o_orderpriority = '5-LOW' THEN 'Stable' ELSE 'Volatile' END AS pool_type_label
 FROM orders o JOIN f_pool_tokens t ON t.pool_address = concat('p', o.o_orderkey)"""
query("decode_launches", _CREATED)(lambda fx: decode.decode_launches(fx.creation_logs()).select(
    "pool_address", "dex", "token0", "token1", "block_number", "pool_type", "pool_type_label"))


def _hex_dims(fx: Fixtures):
    """Transactions (no signer for status P), tokens and creations in the hex address space of the logs."""
    address = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("c_custkey")), 40, "0"))
    transactions = fx.orders.filter("o_orderstatus <> 'P'").select(
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("o_orderkey")), 64, "0")).alias("hash"), F.concat(F.lit("W"), "o_custkey").alias("from"))
    tokens = fx.customer.filter("c_nationkey < 20").select(address.alias("address"), F.col("c_name").alias("symbol"), F.col("c_nationkey").alias("decimals"))
    creations = fx.customer.filter("c_nationkey >= 5").select(
        address.alias("address"), F.lit("1995-01-01").cast("timestamp").alias("created_at"), F.col("c_nationkey").cast("long").alias("created_block"))
    return transactions, tokens, creations


_BUILT = f"""{TOKENS}, dim AS (SELECT {HEX.format('c_custkey')} AS address, c_name, c_nationkey FROM customer),
 d AS (SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderstatus, t.dex, t.token0, lower(t.token1) AS token1, {SYMBOL_SQL} AS quote FROM orders o JOIN f_pool_tokens t ON t.pool_address = concat('p', o.o_orderkey)),
 s AS (SELECT d.*, a.c_nationkey AS n0, b.c_nationkey AS n1,
  CASE WHEN quote IS NOT NULL THEN FALSE WHEN coalesce(CASE WHEN b.c_nationkey >= 5 THEN b.c_nationkey END, -1) >= coalesce(CASE WHEN a.c_nationkey >= 5 THEN a.c_nationkey END, -1) THEN TRUE ELSE FALSE END AS second
  FROM d LEFT JOIN dim a ON a.address = d.token0 LEFT JOIN dim b ON b.address = d.token1),
 r AS (SELECT *, CASE WHEN second THEN token1 ELSE token0 END AS token_address, CASE WHEN second THEN token0 ELSE token1 END AS quote_address FROM s)
 SELECT {HEX.format('r.o_orderkey')} AS pool_address, r.dex, r.token_address, r.quote_address,
  coalesce(CASE WHEN x.c_nationkey < 20 THEN x.c_name END, substr(r.token_address, 1, 6) || '...') || ' / ' || coalesce(r.quote, CASE WHEN y.c_nationkey < 20 THEN y.c_name END, substr(r.quote_address, 1, 6) || '...') AS pair,
  CASE WHEN r.o_orderstatus <> 'P' THEN concat('w', r.o_custkey) ELSE 'unknown' END AS creator, r.o_orderdate AS created_at,
  CASE WHEN x.c_nationkey >= 5 THEN CAST(x.c_nationkey AS BIGINT) END AS token_created_block,
  CASE WHEN x.c_nationkey >= 5 THEN round(epoch(r.o_orderdate - TIMESTAMP '1995-01-01') / 3600.0e0, 4) END AS token_age_at_launch_hours
 FROM r LEFT JOIN dim x ON x.address = r.token_address LEFT JOIN dim y ON y.address = r.quote_address"""


@query("build_launches", _BUILT)
def built(fx: Fixtures):
    """Creation logs of three exchanges to complete launch rows."""
    transactions, tokens, creations = _hex_dims(fx)
    rows = decode.build_launches(decode.decode_launches(fx.creation_logs()), transactions, tokens, quote_dim(fx.spark), creations)
    return rows.select("pool_address", "dex", "token_address", "quote_address", "pair", "creator", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                       "token_created_block", F.round("token_age_at_launch_hours", 4).alias("token_age_at_launch_hours"))


# ---- token side, symbols, decimals

def _q(fx: Fixtures):
    return fx.spark.createDataFrame([("q1", "Q1", 18), ("q2", "Q2", 6)], "address STRING, symbol STRING, decimals INT")


_SIDES = f"""{duckdb_cte('f_launch_sides', 'f_token_creations', 'f_tokens')}, s AS (SELECT l.*, l.token0 IN ('q1', 'q2') AS k0, l.token1 IN ('q1', 'q2') AS k1, coalesce(a.created_block, -1) AS b0, coalesce(b.created_block, -1) AS b1
 FROM f_launch_sides l LEFT JOIN f_token_creations a ON a.address = l.token0 LEFT JOIN f_token_creations b ON b.address = l.token1),
 sided AS (SELECT *, CASE WHEN k0 AND NOT k1 THEN token1 WHEN k1 AND NOT k0 THEN token0 WHEN b1 >= b0 THEN token1 ELSE token0 END AS token_address,
 CASE WHEN k0 AND NOT k1 THEN token0 WHEN k1 AND NOT k0 THEN token1 WHEN b1 >= b0 THEN token0 ELSE token1 END AS quote_address FROM s)"""


def _sided(fx: Fixtures):
    return decode.resolve_token_side(fx.f_launch_sides, _q(fx), fx.f_token_creations)


query("resolve_token_side", f"{_SIDES} SELECT pool_address, token_address, quote_address FROM sided")(lambda fx: _sided(fx).select("pool_address", "token_address", "quote_address"))


@query("pool_quote_fallback", f"""{_SIDES} SELECT pool_address, CASE WHEN year(created_at) < 1998 THEN CASE WHEN k0 THEN token0 ELSE token1 END ELSE quote_address END AS quote_address FROM sided""")
def fallback_quote(fx: Fixtures):
    """Launches from before 1998 have lost their quote address; it is recovered from the creation log."""
    old = _sided(fx).withColumn("quote_address", F.when(F.year("created_at") >= 1998, F.col("quote_address")))
    logs = fx.f_launch_sides.withColumn("dex", F.lit("uniswap-v2"))
    return decode.pool_quote_fallback(old.select("pool_address", "quote_address"), logs, _q(fx)).select("pool_address", "quote_address")


query("token_symbol", f"""{_SIDES} SELECT pool_address, CASE WHEN quote_address IN ('q1', 'q2') THEN upper(quote_address) ELSE coalesce(t.symbol, substr(quote_address, 1, 6) || '...') END AS symbol
 FROM sided LEFT JOIN f_tokens t ON t.address = quote_address""")(lambda fx: decode.token_symbol(_sided(fx), _q(fx), fx.f_tokens, "quote_address", "symbol").select("pool_address", "symbol"))
query("token_decimals", f"""{_SIDES} SELECT pool_address, CASE quote_address WHEN 'q1' THEN 18 WHEN 'q2' THEN 6 ELSE coalesce(t.decimals, 18) END AS decimals,
 CASE quote_address WHEN 'q1' THEN 18 WHEN 'q2' THEN 6 ELSE CASE WHEN t.decimals BETWEEN 0 AND 36 THEN t.decimals END END AS market_decimals FROM sided LEFT JOIN f_tokens t ON t.address = quote_address""")(
    lambda fx: decode.token_decimals(decode.token_decimals(_sided(fx), _q(fx), fx.f_tokens, "quote_address", "decimals"), _q(fx), fx.f_tokens, "quote_address", "market_decimals", None).select(
        "pool_address", "decimals", "market_decimals"))
query("token_age_hours", f"""{_SIDES} SELECT pool_address, CASE WHEN c.address IS NOT NULL THEN round(epoch(sided.created_at - c.created_at) / 3600.0e0, 4) END AS age_hours
 FROM sided LEFT JOIN f_token_creations c ON c.address = token_address""")(lambda fx: _sided(fx).join(
    fx.f_token_creations.select(F.col("address").alias("token_address"), F.col("created_at").alias("token_created_at")), "token_address", "left").select(
    "pool_address", F.round(token_age_hours(F.col("created_at"), F.col("token_created_at")), 4).alias("age_hours")))

_TRADED = f"""{duckdb_cte('f_swaps', 'f_tx', 'f_pools')}, signed AS (SELECT s.pool_address, s.tx_hash, s.log_index, s.block_number, s.quote_raw, s.side, s.ts, s.recipient, coalesce(t.sender, s.recipient) AS who FROM f_swaps s LEFT JOIN f_tx t ON t.hash = s.tx_hash)"""


def _transactions(fx: Fixtures):
    return fx.f_tx.withColumnRenamed("sender", "from")


query("resolve_traders", f"{_TRADED} SELECT pool_address, tx_hash, log_index, quote_raw, who AS trader FROM signed")(
    lambda fx: decode.resolve_traders(fx.f_swaps.drop("trader"), _transactions(fx)).select("pool_address", "tx_hash", "log_index", "quote_raw", "trader"))
query("swaps_x_tx", f"{_TRADED} SELECT who AS trader, count(*) AS swaps, count(DISTINCT pool_address) AS pools FROM signed GROUP BY who")(
    lambda fx: decode.resolve_traders(fx.f_swaps.drop("trader"), _transactions(fx)).groupBy("trader").agg(F.count("*").alias("swaps"), F.countDistinct("pool_address").alias("pools")))


# ---- prices

_PRICES = f"""{duckdb_cte('f_prices', 'f_pools', 'f_swaps', 'f_pair_aggregates')}, tk AS (SELECT token FROM f_prices UNION SELECT 't0'),
 lat AS (SELECT token, source, arg_max(price_usd, event_id) AS p FROM f_prices GROUP BY token, source),
 deep AS (SELECT token, price_usd AS p FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY coalesce(liquidity_usd, 0) DESC, "at" DESC, event_id DESC) AS rn FROM f_prices WHERE source = 'pair' AND price_usd > 0) WHERE rn = 1),
 pr AS (SELECT token, a.p AS pri, b.p AS sec, d.p AS dee FROM tk LEFT JOIN (SELECT * FROM lat WHERE source = 'primary' AND p > 0) a USING (token) LEFT JOIN (SELECT * FROM lat WHERE source = 'secondary' AND p > 0) b USING (token) LEFT JOIN deep d USING (token)),
 prices AS (SELECT token, CASE token WHEN 't0' THEN 1.0e0 WHEN 't1' THEN coalesce(pri, sec) WHEN 't2' THEN coalesce(pri, dee) WHEN 't3' THEN coalesce(pri, dee) ELSE dee END AS price_usd FROM pr)"""


def prices(fx: Fixtures):
    return market.quote_price(fx.f_prices, fx.as_of("f_prices", "at"), None, ["t0"], "t1", ["t2", "t3"])


query("quote_price", f"{_PRICES} SELECT token, price_usd FROM prices WHERE price_usd IS NOT NULL")(prices)
query("deepest_pair_price", f"{_PRICES} SELECT token, p AS price_usd FROM deep")(lambda fx: market.deepest_pair_price(fx.f_prices))
query("quote_x_price", f"{_PRICES} SELECT pool_address, price_usd FROM f_pools LEFT JOIN prices ON token = quote_address")(
    lambda fx: market.priced(fx.f_pools, prices(fx)).select("pool_address", "price_usd"))


# ---- prices as of a row's own time

_TTL_HOURS = 2
#: Trades as they come in over 34 days, from before the first reading until after the last has expired.
_TRADES = """trades AS (SELECT l_orderkey AS trade, l_linenumber AS line, l_partkey AS part, concat('t', l_suppkey % 12) AS token, CAST(round(l_extendedprice * 100) AS BIGINT) AS quote_raw,
  CAST(TIMESTAMP '2023-12-30 00:00:00' AS TIMESTAMP) + to_minutes(CAST((l_orderkey * 7919 + l_linenumber * 131 + l_partkey) % 48960 AS INTEGER)) AS traded_at FROM lineitem)"""
#: Feeds are read once an hour, so several pairs of a token share a moment.
_READINGS = """obs AS (SELECT token, source, price_usd, liquidity_usd, date_trunc('hour', "at") AS "at", event_id FROM f_prices),
 pri AS (SELECT token, "at", arg_max(price_usd, event_id) AS p FROM obs WHERE source = 'primary' GROUP BY ALL), sec AS (SELECT token, "at", arg_max(price_usd, event_id) AS p FROM obs WHERE source = 'secondary' GROUP BY ALL),
 par AS (SELECT token, "at", arg_max(price_usd, (coalesce(liquidity_usd, 0), event_id)) FILTER (price_usd > 0) AS p FROM obs WHERE source = 'pair' GROUP BY ALL)"""


def _asof_sql(rows: str, key: str, at: str) -> str:
    def last(feed: str) -> str:
        fresh = f"""{feed}."at" > r.{at} - INTERVAL {_TTL_HOURS} HOUR AND {feed}.p > 0"""
        return f"CASE WHEN {fresh} THEN {feed}.p END"

    joins = " ".join(f"""ASOF LEFT JOIN {feed} ON {feed}.token = r.{key} AND r.{at} >= {feed}."at\"""" for feed in ("pri", "sec", "par"))
    return f"""SELECT r.*, CASE r.{key} WHEN 't0' THEN 1.0e0 WHEN 't1' THEN coalesce({last('pri')}, {last('sec')}) WHEN 't2' THEN coalesce({last('pri')}, {last('par')})
 WHEN 't3' THEN coalesce({last('pri')}, {last('par')}) ELSE {last('par')} END AS price_usd FROM {rows} r {joins}"""


def _readings(fx: Fixtures):
    return fx.f_prices.withColumn("at", F.date_trunc("hour", "at").cast("timestamp_ntz"))


def _trades(fx: Fixtures):
    minutes = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 131 + F.col("l_partkey")) % 48960).cast("int")
    at = F.lit("2023-12-30 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)
    return fx.lineitem.select(
        F.col("l_orderkey").alias("trade"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.concat(F.lit("t"), F.col("l_suppkey") % 12).alias("token"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("quote_raw"), at.alias("traded_at"))


def _priced_trades(fx: Fixtures):
    ttl = F.make_dt_interval(hours=F.lit(_TTL_HOURS))
    return market.priced_as_of(_trades(fx).withColumnRenamed("token", "quote"), _readings(fx), "quote", "traded_at", ttl, ["t0"], "t1", ["t2", "t3"])


query("quote_x_price_as_of", f"{duckdb_cte('f_prices')}, {_TRADES}, {_READINGS}, x AS ({_asof_sql('trades', 'token', 'traded_at')}) SELECT trade, line, part, token AS quote, traded_at, price_usd FROM x")(
    lambda fx: _priced_trades(fx).select("trade", "line", "part", "quote", "traded_at", "price_usd"))
query("volume_at_trade_prices", f"""{duckdb_cte('f_prices')}, {_TRADES}, {_READINGS}, x AS ({_asof_sql('trades', 'token', 'traded_at')})
 SELECT token AS quote, count(*) AS trades, count(price_usd) AS priced, round(sum(quote_raw / 100.0e0 * price_usd), 1) AS volume_usd FROM x GROUP BY token""")(
    lambda fx: _priced_trades(fx).groupBy("quote").agg(F.count("*").alias("trades"), F.count("price_usd").alias("priced"), F.round(F.sum(F.col("quote_raw") / 100.0 * F.col("price_usd")), 1).alias("volume_usd")))
query("deepest_pair_snapshot", f"""{duckdb_cte('f_prices')}, {_READINGS} SELECT token, "at", p AS price_usd FROM par""")(
    lambda fx: market.price_snapshots(_readings(fx)).filter("pair IS NOT NULL").select("token", "at", F.col("pair.price_usd").alias("price_usd")))


@query("quote_price_as_of", f"""{duckdb_cte('f_prices')}, {_READINGS}, asked AS (SELECT concat('t', t) AS token, TIMESTAMP '2024-01-01 00:30:00' + to_hours(CAST(h * 29 AS INTEGER)) AS asked_at FROM range(12) a(t), range(26) b(h)),
 x AS ({_asof_sql('asked', 'token', 'asked_at')}) SELECT token, asked_at, price_usd FROM x""")
def quote_prices_over_time(fx: Fixtures):
    """Every token's price at 26 moments, all from one pass over the readings."""
    asked = fx.spark.range(12 * 26).select(
        F.concat(F.lit("t"), (F.col("id") % 12).cast("string")).alias("quote"),
        (F.lit("2024-01-01 00:30:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.floor(F.col("id") / 12) * 29).cast("int"))).alias("asked_at"))
    rows = market.priced_as_of(asked, _readings(fx), "quote", "asked_at", F.make_dt_interval(hours=F.lit(_TTL_HOURS)), ["t0"], "t1", ["t2", "t3"])
    return rows.select(F.col("quote").alias("token"), "asked_at", "price_usd")


# ---- swaps of a window, volume, liquidity

def _window(fx: Fixtures):
    """All swaps since each pool's launch: the tip is the newest block, the window spans the chain."""
    return market.pools_x_swaps(fx.f_pools.select("pool_address", "block_number"), fx.f_swaps.drop("creator"), 10**12, 10**12)


_WINDOW = "win AS (SELECT s.* FROM f_swaps s JOIN f_pools p ON p.pool_address = s.pool_address WHERE s.block_number >= p.block_number)"
query("pools_x_swaps", f"{duckdb_cte('f_swaps', 'f_pools')}, {_WINDOW} SELECT pool_address, trader, block_number, log_index, quote_raw FROM win")(
    lambda fx: _window(fx).select("pool_address", "trader", "block_number", "log_index", "quote_raw"))


def priced_pools(fx: Fixtures):
    return market.priced(fx.f_pools, prices(fx))


def _volume(fx: Fixtures):
    return market.pool_volume(_window(fx), priced_pools(fx))


def _liquidity(fx: Fixtures):
    reserves = fx.f_pools.filter("quote_reserve_raw IS NOT NULL").select("pool_address", F.col("created_at").alias("at"), "quote_reserve_raw")
    return market.pool_liquidity(priced_pools(fx), market.latest_reserves(reserves, fx.as_of("f_pools", "created_at")))


_VOLUME = f"{_WINDOW}, vol AS (SELECT p.pool_address, CAST(coalesce(sum(w.quote_raw), 0) AS DOUBLE) / 100 * any_value(price_usd) AS volume_usd FROM f_pools p LEFT JOIN win w ON w.pool_address = p.pool_address LEFT JOIN prices ON token = p.quote_address GROUP BY p.pool_address)"
_LIQ = "liq AS (SELECT pool_address, quote_reserve_raw / 100.0e0 * price_usd * 2 AS liquidity_usd FROM f_pools LEFT JOIN prices ON token = quote_address WHERE quote_reserve_raw IS NOT NULL)"
query("pool_volume", f"{_PRICES}, {_VOLUME} SELECT pool_address, round(volume_usd, 4) AS volume_usd FROM vol")(lambda fx: _volume(fx).withColumn("volume_usd", F.round("volume_usd", 4)))
query("pool_liquidity", f"{_PRICES}, {_LIQ} SELECT pool_address, round(liquidity_usd, 4) AS liquidity_usd FROM liq")(lambda fx: _liquidity(fx).withColumn("liquidity_usd", F.round("liquidity_usd", 4)))


_READ_UNTIL = "1998-06-01 00:00:00"
#: Every line is a reading of its pool: reserves of token0 and token1 in 112 bits, and the quote balance.
_RESERVES = f"""{_PRICES}, read AS (SELECT concat('s', l_suppkey) AS pool_address, l_shipdate AS seen_at, l_orderkey * 100000 + l_partkey AS seq, l_linenumber AS line,
  CAST({_CENTS} AS HUGEINT) * 18446744073709551616 + l_partkey AS r0, CAST(l_partkey + 1 AS HUGEINT) * 73786976294838206464 + l_orderkey AS r1, CAST({_CENTS} AS HUGEINT) * 1152921504606846976 + 77 AS bal FROM lineitem WHERE l_shipdate <= TIMESTAMP '{_READ_UNTIL}'),
 last AS (SELECT pool_address, arg_max(struct_pack(r0 := r0, r1 := r1, bal := bal), (seen_at, seq * 10 + line)) AS w FROM read GROUP BY pool_address),
 held AS (SELECT p.pool_address, p.quote_address, CASE WHEN p.dex = 'uniswap-v3' THEN w.bal WHEN CAST(substr(p.pool_address, 2) AS BIGINT) % 2 = 0 THEN w.r0 ELSE w.r1 END AS reserve FROM f_pools p JOIN last l ON l.pool_address = p.pool_address)"""


def _held(fx: Fixtures):
    def word(high, low, digits=16):
        """high x 16^digits + low."""
        return F.lpad(F.concat(F.lower(F.hex(high)), F.lpad(F.lower(F.hex(low)), digits, "0")), 64, "0")

    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = fx.lineitem.select(
        F.concat(F.lit("s"), "l_suppkey").alias("pool_address"), F.col("l_shipdate").alias("at"), ((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10 + F.col("l_linenumber")).alias("seq"),
        F.explode(F.array(
            F.struct(F.lit("pair").alias("kind"), word(cents, F.col("l_partkey")).alias("word0"), word((F.col("l_partkey") + 1) * 4, F.col("l_orderkey")).alias("word1")),
            F.struct(F.lit("balance").alias("kind"), word(cents, F.lit(77), 15).alias("word0"), F.lit(None).cast("string").alias("word1")),
        )).alias("r")).select("pool_address", "at", "seq", "r.*")
    pools = fx.f_pools.withColumn("quote_is_token0", F.substring("pool_address", 2, 18).cast("long") % 2 == 0)
    return market.quote_reserves(pools, rows, F.lit(_READ_UNTIL).cast("timestamp_ntz"))


query("quote_reserves", f"{_RESERVES} SELECT pool_address, lpad(lower(hex(reserve)), 72, '0') AS reserve_hex FROM held")(
    lambda fx: _held(fx).select("pool_address", limbs_hex(F.col("quote_reserve_limbs")).alias("reserve_hex")))
query("pool_liquidity_from_reserves", f"{_RESERVES} SELECT pool_address, round(CAST(reserve AS DOUBLE) / 1.0e20 * price_usd * 2, 6) AS liquidity_usd FROM held LEFT JOIN prices ON token = quote_address")(
    lambda fx: market.pool_liquidity(priced_pools(fx).withColumn("quote_decimals", F.lit(20)), _held(fx)).withColumn("liquidity_usd", F.round("liquidity_usd", 6)))


def _market(fx: Fixtures):
    """Pools with a priced quote token and a reserve reading."""
    good = priced_pools(fx).filter("price_usd IS NOT NULL")
    return market.market_data(good, _liquidity(fx), _volume(fx), F.lit("2001-08-01").cast("timestamp_ntz"))


def _round5(df, *cols):
    return df.withColumns({c: F.round(c, 5) for c in cols})


query("market_data", f"""{_PRICES}, {_VOLUME}, {_LIQ} SELECT p.pool_address, round(l.liquidity_usd, 5) AS liquidity_usd, round(v.volume_usd, 5) AS volume_usd,
 round(v.volume_usd * (1 - p.insider_ratio), 5) AS external_volume_usd, round(v.volume_usd * p.insider_ratio, 5) AS insider_volume_usd
 FROM f_pools p JOIN prices ON token = p.quote_address AND price_usd IS NOT NULL JOIN liq l ON l.pool_address = p.pool_address JOIN vol v ON v.pool_address = p.pool_address""")(
    lambda fx: _round5(_market(fx).drop("market_data_updated_at"), "liquidity_usd", "volume_usd", "external_volume_usd", "insider_volume_usd"))


def _unpriced(fx: Fixtures):
    return priced_pools(fx).filter("price_usd IS NULL OR quote_reserve_raw IS NULL")


_FALLBACK = f"""{_PRICES} SELECT p.pool_address, a.liquidity_usd, a.volume_h24 AS volume_usd FROM f_pools p LEFT JOIN prices ON token = p.quote_address
 LEFT JOIN f_pair_aggregates a ON a.pair_address = p.pool_address WHERE price_usd IS NULL OR quote_reserve_raw IS NULL"""
query("market_data_fallback", _FALLBACK)(lambda fx: market.market_data_fallback(_unpriced(fx), fx.f_pair_aggregates, F.lit("2001-08-01").cast("timestamp_ntz")).drop("market_data_updated_at"))
query("pair_fallback", f"WITH b AS ({_FALLBACK}) SELECT count(*) AS pools, count(volume_usd) AS with_pair, round(sum(volume_usd), 2) AS volume_usd FROM b")(
    lambda fx: market.market_data_fallback(_unpriced(fx), fx.f_pair_aggregates, F.lit("2001-08-01").cast("timestamp_ntz")).agg(
        F.count("*").alias("pools"), F.count("volume_usd").alias("with_pair"), F.round(F.sum("volume_usd"), 2).alias("volume_usd")))


@query("real_volume_split", f"""{_PRICES}, {_VOLUME}, x AS (SELECT p.pool_address, CASE WHEN p.volume_usd > 0 THEN p.volume_usd ELSE v.volume_usd END AS total, coalesce(p.insider_ratio, 0) AS r FROM f_pools p JOIN vol v ON v.pool_address = p.pool_address)
 SELECT pool_address, round(total, 5) AS total_volume_usd, round(total * (1 - r), 5) AS external_volume_usd, round(total * r, 5) AS insider_volume_usd FROM x""")
def split(fx: Fixtures):
    joined = fx.f_pools.join(_volume(fx).withColumnRenamed("volume_usd", "measured"), "pool_address")
    total, external, insider = market.real_volume_split(F.col("volume_usd"), F.col("measured"), F.col("insider_ratio"))
    return joined.select("pool_address", F.round(total, 5).alias("total_volume_usd"), F.round(external, 5).alias("external_volume_usd"), F.round(insider, 5).alias("insider_volume_usd"))


@query("first_trades", f"""{_PRICES}, tx AS (SELECT concat('h', o_orderkey) AS hash, concat('w', o_custkey) AS sender FROM orders WHERE o_orderstatus <> 'P'), {_WINDOW},
 ranked AS (SELECT *, row_number() OVER (PARTITION BY pool_address ORDER BY block_number, log_index, l_partkey, ts, quote_raw) AS rank FROM win)
 SELECT r.pool_address, r.rank, concat(r.tx_hash, '-', r.log_index) AS id, r.side, coalesce(t.sender, r.recipient) AS trader, r.tx_hash, r.ts AS "timestamp", round(r.quote_raw / 100.0e0 * price_usd, 4) AS amount_usd,
 CASE WHEN r.quote_raw % 10 = 0 THEN printf('%.1f', r.quote_raw / 100.0e0) ELSE printf('%.2f', r.quote_raw / 100.0e0) END AS quote_amount
 FROM ranked r JOIN f_pools p ON p.pool_address = r.pool_address LEFT JOIN prices ON token = p.quote_address LEFT JOIN tx t ON t.hash = r.tx_hash WHERE rank <= 100""")
def first_hundred(fx: Fixtures):
    pools = priced_pools(fx).select("pool_address", F.col("block_number").alias("launch_block"), "quote_decimals", "price_usd")
    rows = market.first_trades(pools, fx.f_swaps.drop("trader", "creator"), _transactions(fx), 100, ["l_partkey", "ts", "quote_raw"])
    return rows.withColumn("amount_usd", F.round("amount_usd", 4))


query("secs_after_launch", f"""{duckdb_cte('f_swaps', 'f_pools')} SELECT s.pool_address, s.trader, CAST(greatest(0, floor(epoch(min(s.ts) - any_value(p.created_at)) + 0.5)) AS BIGINT) AS seconds
 FROM f_swaps s JOIN f_pools p ON p.pool_address = s.pool_address GROUP BY 1, 2""")(
    lambda fx: fx.f_swaps.groupBy("pool_address", "trader").agg(F.min("ts").alias("first")).join(fx.f_pools.select("pool_address", "created_at"), "pool_address").select(
        "pool_address", "trader", secs_after_launch(F.col("first"), F.col("created_at")).alias("seconds")))
