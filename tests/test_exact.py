"""Exact 256-bit totals, the trailing window, and the as-of join."""

import bisect
import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidepool.functions.words import exact_total, limbs_hex, limbs_number, u256_limbs
from tidepool.operators import intel, market, realvolume, research
from tidepool.operators.asof import asof_join
from tidepool.operators.decode import decode_launches, tag_swaps
from tidepool.sources.dex import DEXES, SWAP_V2, SWAP_V3, DexSpec

T0 = dt.datetime(2024, 1, 1)


def hex_word(n):
    return f"{n % (1 << 256):064x}"


def test_limbs_number_rounds_like_the_exact_integer(spark):
    rng = random.Random(3)
    numbers = [0, 1, 2**53, 2**53 + 1, 2**53 + 2, 2**54 + 2, 2**54 + 6, 2**256 - 1, 2**255 + 2**202, 2**255 + 2**202 + 1, (2**53 + 1) << 100, ((2**53 + 1) << 100) + 1]
    numbers += [rng.getrandbits(rng.randrange(1, 257)) for _ in range(300)] + [((rng.getrandbits(53) * 2 + 1) << k) + rng.randrange(2) for k in range(0, 200, 7)]
    rows = spark.createDataFrame([(i, hex_word(n)) for i, n in enumerate(numbers)], "i INT, w STRING")
    got = {r["i"]: r["x"] for r in rows.select("i", limbs_number(u256_limbs(F.col("w"))).alias("x")).collect()}
    assert [got[i] for i in range(len(numbers))] == [float(n) for n in numbers]


def test_exact_total_of_limbs_and_longs(spark):
    numbers = [2**200 + 1, 2**200 - 1, 5, 2**64 + 3]
    rows = spark.createDataFrame([(hex_word(n), n % 2**60, n % 3 == 0) for n in numbers], "w STRING, n BIGINT, own BOOLEAN").withColumn("limbs", u256_limbs(F.col("w")))
    got = rows.agg(exact_total(rows, "limbs").alias("a"), exact_total(rows, "limbs", F.col("own")).alias("b"), exact_total(rows, "n").alias("c")).first()
    assert got["a"] == float(sum(numbers)) and got["b"] == float(sum(n for n in numbers if n % 3 == 0)) and got["c"] == float(sum(n % 2**60 for n in numbers))
    empty = rows.limit(0)
    assert tuple(empty.agg(exact_total(empty, "limbs"), exact_total(empty, "n")).first()) == (0.0, 0.0)


def test_intel_from_logs_counts_the_window_exactly(spark, tmp_path):
    pool, other = "0x" + "aa" * 20, "0x" + "bb" * 20
    buy = lambda n: "0x" + hex_word(n) + hex_word(0) * 3
    signed = lambda n: "0x" + hex_word(n) + hex_word(0) * 4
    topic = lambda k: "0x" + hex_word(k)
    logs = [
        (pool.upper().replace("0X", "0x"), [SWAP_V2, topic(1), topic(7)], buy(2**70 + 1), 100, 0, "0xt1", 0),  # by signer
        (pool, [SWAP_V3, topic(1), topic(7)], signed(-(2**65)), 101, 1, "0xt2", 0),  # by recipient 7
        (pool, [SWAP_V2, topic(1), topic(7)], buy(3), 101, 1, "0xt2", 1),
        (pool, [SWAP_V2, topic(1), topic(7)], "0x00", 102, 2, "0xt3", 0),  # cannot be decoded, is counted
        (pool, [SWAP_V2, topic(1), topic(7)], buy(2**90), 89, 0, "0xt4", 0),  # before the window
        (pool, [SWAP_V2, topic(1), topic(7)], buy(2**90), 111, 0, "0xt5", 0),  # after the tip
        (other, [SWAP_V2, topic(1), topic(9)], buy(11), 104, 0, "0xt6", 0),  # before its launch
    ]
    spark.createDataFrame(logs, "address STRING, topics ARRAY<STRING>, data STRING, block_number BIGINT, time_stamp BIGINT, tx_hash STRING, log_index BIGINT").write.parquet(str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    transactions = spark.createDataFrame([("0xT1", "0xSigner", 100), ("0xt2", "0xold", 12)], "hash STRING, `from` STRING, block_number BIGINT")
    pools = spark.createDataFrame(
        [(pool, "0xsigner", 95, True, 18, 2.0, None), (other, "0xc", 105, True, 18, None, 50.0)],
        "pool_address STRING, creator STRING, launch_block BIGINT, quote_is_token0 BOOLEAN, quote_decimals INT, price_usd DOUBLE, volume_usd DOUBLE")
    edges = spark.createDataFrame([], "wallet STRING, funder STRING, via STRING, tx_hash STRING, position BIGINT")
    labels = spark.createDataFrame([], "address STRING, kind STRING")
    rows = {r["pool_address"]: r for r in realvolume.pool_intel_from_logs(logs, transactions, pools, edges, labels, 110, 20).collect()}
    first, second = rows[pool], rows[other]
    assert int(first["total_quote_hex"], 16) == 2**70 + 1 + 2**65 + 3 and int(first["insider_quote_hex"], 16) == 2**70 + 1
    assert (first["analyzed_trades"], first["buyer_count"], first["insider_buyer_count"]) == (4, 2, 1)
    assert first["insider_ratio"] == float(2**70 + 1) / float(2**70 + 2**65 + 4)
    assert (second["analyzed_trades"], second["buyer_count"], second["total_volume_usd"], second["external_volume_usd"]) == (0, 0, 50.0, 50.0)
    assert int(second["total_quote_hex"], 16) == 0
    top = intel.rank_buyers(realvolume.window_traders(logs, transactions, pools, 110, 20)).orderBy("rank").select("trader", "trade_count").collect()
    assert [tuple(r) for r in top] == [("0xsigner", 1), ("0x" + f"{7:040x}", 2)]


def test_block_bounds_reach_both_scans(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("block_number"), F.lit("0xa").alias("address"), F.lit("h").alias("hash"), F.lit("f").alias("from")).write.parquet(str(tmp_path / "t"))
    plan = realvolume.in_window(spark.read.parquet(str(tmp_path / "t")), 9, 3)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(block_number,6)" in plan and "LessThanOrEqual(block_number,9)" in plan


@pytest.mark.parametrize("ttl", [None, 50])
def test_asof_join_equals_a_search(spark, skewed, ttl):
    rng = random.Random(5)
    keys = ["hot"] * 8 + ["a", "b", None]
    seen = [(rng.choice(keys), rng.randrange(400), rng.choice([None, rng.randrange(99)]), rng.choice([None, "x", "y"])) for _ in range(300)]
    facts = [(i, rng.choice([*keys, "unseen"]), rng.choice([None, *range(-20, 500, 3)])) for i in range(600)] + [(1000 + i, "hot", 77) for i in range(200)]
    minute = lambda m: None if m is None else T0 + dt.timedelta(minutes=m)
    left = spark.createDataFrame([(i, k, minute(m)) for i, k, m in facts], "id INT, key STRING, ts TIMESTAMP_NTZ").repartition(5)
    right = spark.createDataFrame([(k, minute(m), p, q) for k, m, p, q in seen], "key STRING, at TIMESTAMP_NTZ, p INT, q STRING")
    interval = None if ttl is None else F.make_dt_interval(mins=F.lit(ttl))
    got = {r["id"]: (r["p"], r["q"]) for r in asof_join(left, right, "key", "ts", "at", ["p", "q"], interval).collect()}
    held = [defaultdict(dict), defaultdict(dict)]
    for k, m, *values in seen:
        for col, v in zip(held, values, strict=True):
            if v is not None:
                col[k][m] = max(v, col[k].get(m, v))

    def last(col, k, m):
        times = sorted(col[k]) if k is not None and k in col else []
        at = bisect.bisect_right(times, m) - 1 if m is not None else -1
        return col[k][times[at]] if at >= 0 and (ttl is None or times[at] > m - ttl) else None

    assert len(got) == len(facts)
    assert got == {i: tuple(last(col, k, m) for col in held) for i, k, m in facts}
    assert asof_join(left.limit(0), right, "key", "ts", "at", ["p"]).count() == 0
    assert asof_join(left, right.limit(0), "key", "ts", "at", ["p"]).filter("p IS NOT NULL").count() == 0


def test_prices_as_of_fall_back_and_expire(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    seen = spark.createDataFrame(
        [("n", "primary", 10.0, None, at(0), 1), ("n", "primary", 0.0, None, at(10), 2), ("n", "secondary", 9.0, None, at(5), 3),
         ("x", "pair", 1.0, 5.0, at(0), 4), ("x", "pair", 2.0, 50.0, at(0), 5), ("x", "pair", 3.0, 1.0, at(10), 6), ("x", "pair", 0.0, 999.0, at(10), 7)],
        "token STRING, source STRING, price_usd DOUBLE, liquidity_usd DOUBLE, at TIMESTAMP_NTZ, event_id BIGINT")
    asked = spark.createDataFrame([(k, at(m)) for k in ("N", "x", "s") for m in (-1, 0, 9, 10, 31, 40)], "quote STRING, t TIMESTAMP_NTZ")
    rows = market.priced_as_of(asked, seen, "quote", "t", F.make_dt_interval(mins=F.lit(30)), ["s"], "n", [])
    got = {(r["quote"], int((r["t"] - T0).total_seconds() // 60)): r["price_usd"] for r in rows.collect()}
    assert [got["N", m] for m in (-1, 0, 9, 10, 31, 40)] == [None, 10.0, 10.0, 9.0, 9.0, None]
    assert [got["x", m] for m in (-1, 0, 9, 10, 31, 40)] == [None, 2.0, 2.0, 3.0, 3.0, None]
    assert {got["s", m] for m in (-1, 40)} == {1.0}


def test_a_fourth_exchange_is_one_list_entry(spark):
    """Another order of words, another recipient topic, the pool in the third word, balances instead of reserves."""
    new = DexSpec(
        id="fourth", label="Fourth", factory="0x" + "44" * 20, launch_topic="0x" + "4a" * 32, swap_topic="0x" + "4b" * 32, signed_swaps=False,
        pool_types=(("volatile", "Volatile"),), pool_word=2, pool_kind="flag", swap_in=(1, 3), swap_out=(0, 2), swap_words=6, recipient_topic=1, reserve="balance",
    )
    specs = [*DEXES, new]
    log = "address STRING, topics ARRAY<STRING>, data STRING, block_number BIGINT, time_stamp BIGINT, tx_hash STRING, log_index BIGINT"
    words = lambda *n: "0x" + "".join(map(hex_word, n))
    topic = lambda k: "0x" + hex_word(k)
    made = spark.createDataFrame([
        (new.factory, [new.launch_topic, topic(1), topic(2), topic(1)], words(0, 0, 77), 5, 0, "0xT", 0), (new.factory, [new.launch_topic, topic(1), topic(2), topic(0)], words(0, 0), 6, 0, "0xT", 1),
        (DEXES[0].factory, [DEXES[0].launch_topic, topic(1), topic(2)], words(88, 0), 7, 0, "0xT", 2),
    ], log)
    rows = decode_launches(made, specs).orderBy("log_index").select("dex", "pool_address", "pool_type").collect()
    assert [tuple(r) for r in rows] == [("fourth", f"0x{77:040x}", "stable"), ("fourth", None, "volatile"), ("uniswap-v2", f"0x{88:040x}", "volatile")]
    swaps = spark.createDataFrame([
        ("0xp", [new.swap_topic, topic(9)], words(0, 2**100, 5, 0, 0, 0), 1, 0, "0xa", 0),  # token0 in
        ("0xp", [new.swap_topic, topic(9)], words(3, 0, 0, 6, 0, 0), 1, 0, "0xb", 1),  # token0 out
        ("0xp", [new.swap_topic, topic(9)], words(3, 0, 0, 6, 0), 1, 0, "0xc", 2),  # a word short
        ("0xp", [SWAP_V2, topic(1), topic(7)], words(4, 0, 0, 6), 1, 0, "0xd", 3), ("0xp", [SWAP_V3, topic(1), topic(7)], words(-4, 9, 0, 0, 0), 1, 0, "0xe", 4),
    ], log)

    def tagged(first):
        done = tag_swaps(swaps, F.lit(first), specs).orderBy("log_index").select("side", limbs_hex(F.col("quote_limbs")).alias("q"), "recipient").collect()
        return [(r["side"], r["q"] and int(r["q"], 16), r["recipient"] and int(r["recipient"], 16)) for r in done]

    assert tagged(True) == [("buy", 2**100, 9), ("sell", 3, 9), (None, None, None), ("buy", 4, 7), ("sell", 4, 7)]
    assert tagged(False) == [("sell", 5, 9), ("buy", 6, 9), (None, None, None), ("sell", 6, 7), ("buy", 9, 7)]
    pools = spark.createDataFrame([("a", "fourth", False), ("b", "uniswap-v2", False), ("c", "uniswap-v2", True), ("d", "uniswap-v3", True), ("e", "aerodrome", True)], "pool_address STRING, dex STRING, quote_is_token0 BOOLEAN")
    readings = spark.createDataFrame(
        [(p, at, 0, kind, hex_word(2**111 + at), hex_word(2**100 + at) if kind == "pair" else None) for p in "abcd" for kind in ("pair", "balance") for at in (1, 2, 3)],
        "pool_address STRING, at INT, seq INT, kind STRING, word0 STRING, word1 STRING")
    got = {r["pool_address"]: int(r["q"], 16) for r in market.quote_reserves(pools, readings, F.lit(2), specs).select("pool_address", limbs_hex(F.col("quote_reserve_limbs")).alias("q")).collect()}
    assert got == {"a": 2**111 + 2, "b": 2**100 + 2, "c": 2**111 + 2, "d": 2**111 + 2}


def test_research_counts_see_past_the_rows_shown(spark):
    """A tagged bot behind 400 closer connections still counts."""
    edges = [(f"w{i:03d}", "seed", "external", f"h{i}", 1) for i in range(400)] + [("zz", "w399", "external", "hz", 1)]
    edges = spark.createDataFrame(edges, "wallet STRING, funder STRING, via STRING, tx_hash STRING, position BIGINT")
    labels = spark.createDataFrame([("zz", "rug-bot"), ("w001", "watch")], "address STRING, kind STRING")
    bots = labels.filter("kind = 'rug-bot'").select("address")
    walk = research.research_walk(spark.createDataFrame([("SEED",)], "seed STRING"), edges, 3)
    clustered = research.research_components(walk, edges, bots, 10_000, [])
    row = research.research_counts(clustered, walk, labels).first()
    assert (row["connection_count"], row["cluster_members"], row["linked_rug_bot_count"], row["rug_connected"], row["wallets_explored"], row["label"]) == (401, 401, 1, True, 402, None)
    assert [tuple(r) for r in research.linked_bots(clustered, labels).collect()] == [("seed", "zz", 2, True)]
