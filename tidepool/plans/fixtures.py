"""The driver tables seen as domain tables.

Each projection is one SQL text that runs in Spark and in DuckDB; ``{name}`` stands for a table or for
an earlier projection. The modulo expressions plant NULLs, labels and edges in the domain data; no
projection is a sample of its source.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.sources.dex import DEXES, SWAP_AERODROME, SWAP_V2, SWAP_V3

SQL = {
    "f_launches": """
SELECT concat('p', o.o_orderkey) AS id, concat('p', o.o_orderkey) AS pool_address, o.o_orderstatus AS dex, concat('w', o.o_custkey) AS creator,
 concat(o.o_orderpriority, ' / ', o.o_orderstatus) AS pair, o.o_orderdate AS created_at,
 CAST(year(o.o_orderdate) * 366 + dayofyear(o.o_orderdate) AS BIGINT) AS block_number, o.o_orderpriority AS pool_type,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_totalprice END AS liquidity_usd, l.vol AS volume_usd,
 round(l.vol - l.ins, 2) AS external_volume_usd, l.ins AS insider_volume_usd,
 CASE WHEN o.o_orderkey % 5 <> 0 THEN o.o_orderdate END AS intel_updated_at,
 CASE WHEN o.o_orderkey % 7 <> 0 THEN o.o_orderdate END AS market_data_updated_at
 FROM {orders} o LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS vol,
   round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS ins FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "f_pools": """
SELECT concat('s', s_suppkey) AS pool_address, CASE s_suppkey % 3 WHEN 0 THEN 'uniswap-v2' WHEN 1 THEN 'aerodrome' ELSE 'uniswap-v3' END AS dex,
 concat('w', s_suppkey) AS creator, concat('t', s_suppkey % 12) AS quote_address, 2 AS quote_decimals, s_nationkey AS nation,
 (SELECT min(o_orderdate) FROM {orders}) AS created_at, CAST(s_suppkey AS BIGINT) AS block_number,
 CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(round(s_acctbal * 100) AS BIGINT) END AS quote_reserve_raw,
 CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 10) / 10.0e0 END AS insider_ratio,
 CASE WHEN s_suppkey % 5 = 1 THEN 1000.0e0 * s_suppkey WHEN s_suppkey % 5 = 2 THEN 0.0e0 END AS volume_usd FROM {supplier}""",
    "f_swaps": """
SELECT concat('s', l_suppkey) AS pool_address, concat('w', l_suppkey) AS creator, concat('w', l_partkey) AS trader,
 CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, CAST(round(l_extendedprice * 100) AS BIGINT) AS quote_raw, l_shipdate AS ts,
 l_orderkey AS block_number, CAST(l_linenumber AS BIGINT) AS log_index, l_partkey, concat('h', l_orderkey) AS tx_hash, concat('w', l_partkey) AS recipient FROM {lineitem}""",
    "f_tx": "SELECT concat('h', o_orderkey) AS hash, concat('w', o_custkey) AS sender FROM {orders} WHERE o_orderstatus <> 'P'",
    "f_transfers": """
SELECT event_id AS seq, concat('e', event_id) AS hash, concat('u', {k}) AS sender, concat('u', user_id) AS recipient, value, event_type = 'error' AS is_error,
 CASE WHEN event_type = 'purchase' THEN 'internal' ELSE 'external' END AS via, ts FROM {events}""",
    "f_edge_pairs": """
SELECT concat('w', p_partkey) AS wallet, concat('g', p_brand, '/', p_type) AS funder FROM {part} WHERE p_partkey % 4 = 0
 UNION SELECT concat('w', p_partkey), concat('t', p_type) FROM {part} WHERE p_partkey % 2 = 0
 UNION SELECT concat('w', p_partkey), concat('w', CAST(floor(p_partkey / 3) AS BIGINT)) FROM {part} WHERE p_partkey % 6 IN (3, 5)""",
    "f_edges": """
SELECT wallet, funder, CASE WHEN substr(funder, 1, 1) = 'g' THEN 'internal' ELSE 'external' END AS via, concat(wallet, '<', funder) AS tx_hash,
 row_number() OVER (PARTITION BY wallet ORDER BY funder) AS position FROM {f_edge_pairs} WHERE wallet <> funder""",
    "f_labels": """
SELECT concat('w', p_partkey) AS address, CASE WHEN p_partkey % 2 = 1 THEN 'rug-bot' ELSE 'watch' END AS kind, p_name AS note,
 CAST('2001-01-01' AS TIMESTAMP) AS created_at FROM {part} WHERE p_partkey % 97 = 13""",
    "f_prices": """
SELECT concat('t', user_id % 10) AS token, CASE WHEN event_type IN ('view','click') THEN 'primary' WHEN event_type = 'signup' THEN 'secondary' ELSE 'pair' END AS source,
 CASE WHEN event_type = 'error' THEN 0.0e0 ELSE value END AS price_usd, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 100 END AS liquidity_usd, ts AS at, event_id FROM {events}""",
    "f_pair_aggregates": "SELECT concat('s', s_suppkey) AS pair_address, s_acctbal * 2 AS liquidity_usd, s_acctbal * 10 AS volume_h24 FROM {supplier} WHERE s_suppkey % 5 = 0",
    "f_token_creations": "SELECT concat('a', p_partkey) AS address, CAST('1995-01-01' AS TIMESTAMP) AS created_at, CAST(p_size AS BIGINT) AS created_block FROM {part} WHERE p_partkey % 3 <> 0",
    "f_tokens": "SELECT concat('a', p_partkey) AS address, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS symbol, p_size AS decimals FROM {part} WHERE p_partkey % 4 <> 0",
    "f_launch_sides": """
SELECT concat('p', o_orderkey) AS pool_address, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'q1' ELSE concat('a', o_custkey) END AS token0,
 CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'q2' ELSE concat('a', o_custkey + 1) END AS token1, o_orderdate AS created_at FROM {orders}""",
    "f_pool_tokens": """
SELECT concat('p', o_orderkey) AS pool_address, CASE o_orderstatus WHEN 'F' THEN 'uniswap-v2' WHEN 'O' THEN 'aerodrome' ELSE 'uniswap-v3' END AS dex,
 concat('0x', lpad(lower(hex(o_custkey)), 40, '0')) AS token0,
 CASE o_orderpriority WHEN '1-URGENT' THEN '0x4200000000000000000000000000000000000006' WHEN '2-HIGH' THEN upper('0x833589fcd6edb6e08f4c7c32d4f71b54bda02913')
  WHEN '3-MEDIUM' THEN '0x940181a94a35a4569e4529a3cdfb74e38fd98631' WHEN '4-NOT SPECIFIED' THEN '0x0b3e328455c4059eeb9e3f84b5543f74e24e7e1b'
  ELSE concat('0x', lpad(lower(hex(o_orderkey)), 40, '0')) END AS token1 FROM {orders}""",
    "f_api_calls": "SELECT event_type AS method, ts AS called_at, value < 1.0 AS is_error FROM {events}",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
_KEY = {"spark": "get_json_object(props, '$.k')", "duckdb": "json_extract_string(props, '$.k')"}


def duckdb_cte(*names: str) -> str:
    """WITH clause that defines the given projections (and those they use) for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        for used in re.findall(r"\{(f_\w+)\}", SQL[name]):
            visit(used)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    marks = {t: t for t in [*TABLES, *SQL]} | {"k": _KEY["duckdb"]}
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({SQL[name].strip().format(**marks)})" for name in order)


class Fixtures:
    """``Fixtures(spark, sf_dir).f_swaps`` and so on; driver tables by their own name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in SQL:
            raise AttributeError(name)
        used = set(re.findall(r"\{(\w+)\}", SQL[name]))
        text = SQL[name].replace("{k}", _KEY["spark"])
        return self.spark.sql(text, **{table: getattr(self, table) for table in used - {"k"}})

    def as_of(self, table: str, col: str):
        """Latest time in a table, as a literal."""
        latest = getattr(self, table).agg(F.max(col).cast("string")).head()[0]
        return F.lit(latest).cast("timestamp_ntz")

    def _spread(self, df: DataFrame) -> DataFrame:
        """Uses all cores when a table has fewer splits than there are cores (one file, one row group)."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def swap_logs(self, wide: bool = False) -> DataFrame:
        """Line items as raw hex swap logs of the three exchanges (supplier = pool, part = trader).

        The quote amount is cents x 2^64, so that it needs more than 64 bits; ``wide`` amounts add
        (l_partkey + 1) * 4294967311 + l_orderkey in the low bits. Even pools have the quote token first.
        Lines of quantity 50 are cut short and cannot be decoded.
        """
        zero = F.lit("0" * 64)
        rows = self._spread(self.lineitem).withColumns({
            "cents": F.round(F.col("l_extendedprice") * 100).cast("long"), "buy": F.col("l_linestatus") == "O",
            "quote_is_token0": F.col("l_suppkey") % 2 == 0, "kind": F.col("l_suppkey") % 3,
        })
        signed_sell = (F.col("kind") == 2) & ~F.col("buy") & (F.col("cents") != 0)
        top = F.when(signed_sell, F.lit("f" * 32)).otherwise(F.lit("0" * 32))
        low = (F.col("l_partkey") + 1) * 4294967311 + F.col("l_orderkey") if wide else F.lit(0).cast("long")
        borrow = F.when(signed_sell & (low != 0), 1).otherwise(0)  # the two's complement of a low part takes one from above

        def half(value):
            return F.lpad(F.lower(F.hex(F.when(signed_sell, -value).otherwise(value))), 16, "0")

        rows = rows.withColumn("amount", F.concat(top, half(F.col("cents") + borrow), half(low)))
        # Where the amount goes: its word index among the event's words.
        slot = F.when(F.col("quote_is_token0"), 0).otherwise(1) + F.when((F.col("kind") != 2) & ~F.col("buy"), 2).otherwise(0)
        rows = rows.withColumns({"slot": slot, "words": F.when(F.col("kind") == 2, 5).otherwise(4)})
        data = F.concat(
            F.lit("0x"), F.repeat(zero, F.col("slot")), F.col("amount"), F.repeat(zero, F.col("words") - F.col("slot") - 1)
        )
        rows = rows.withColumn("data", data)
        topic = F.when(F.col("kind") == 0, SWAP_V2).when(F.col("kind") == 1, SWAP_AERODROME).otherwise(SWAP_V3)

        def padded(key, width):
            return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(key)), width, "0"))

        return rows.select(
            padded(F.col("l_suppkey"), 40).alias("address"),
            F.array(topic, padded(F.col("l_orderkey"), 64), padded(F.col("l_partkey"), 64)).alias("topics"),
            F.when(F.col("l_quantity") == 50, F.substring("data", 1, 100)).otherwise(F.col("data")).alias("data"),
            F.col("l_orderkey").alias("block_number"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("time_stamp"),
            padded(F.col("l_orderkey"), 64).alias("tx_hash"), F.col("l_linenumber").cast("long").alias("log_index"),
            "quote_is_token0",
        )

    def creation_logs(self) -> DataFrame:
        """Orders as raw pool-creation logs of the three exchanges (order = pool, customer = token)."""
        tokens = self.f_pool_tokens
        keyed = self._spread(self.orders).withColumn("pool_address", F.concat(F.lit("p"), F.col("o_orderkey"))).join(tokens, "pool_address")

        def word(value):
            return F.lpad(F.lower(value), 64, "0")

        pool = word(F.hex("o_orderkey"))
        fee = F.when(F.col("o_orderpriority") == "5-LOW", 3000).otherwise(500)
        spec = {d.id: d for d in DEXES}

        def per_dex(pick):
            return F.when(F.col("dex") == "uniswap-v2", pick("uniswap-v2")).when(F.col("dex") == "aerodrome", pick("aerodrome")).otherwise(pick("uniswap-v3"))

        third = {
            "uniswap-v2": F.lit(None).cast("string"),
            "aerodrome": F.concat(F.lit("0x"), word(F.when(F.col("o_orderpriority") == "5-LOW", "1").otherwise("0"))),
            "uniswap-v3": F.concat(F.lit("0x"), word(F.hex(fee))),
        }
        body = {
            "uniswap-v2": F.concat(pool, F.lit("0" * 64)),
            "aerodrome": F.concat(pool, F.lit("0" * 64)),
            "uniswap-v3": F.concat(F.lit("0" * 64), pool),
        }
        address_word = lambda c: F.concat(F.lit("0x"), word(F.substring(F.col(c), 3, 40)))
        return keyed.select(
            per_dex(lambda d: F.lit(spec[d].factory)).alias("address"),
            F.array(per_dex(lambda d: F.lit(spec[d].launch_topic)), address_word("token0"), address_word("token1"), per_dex(third.get)).alias("topics"),
            F.concat(F.lit("0x"), per_dex(body.get)).alias("data"),
            F.col("o_orderkey").alias("block_number"),
            F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time_stamp"),
            F.concat(F.lit("0x"), word(F.hex("o_orderkey"))).alias("tx_hash"), F.lit(0).cast("long").alias("log_index"),
        )
