from pyspark.sql import functions as F

from tidepool.functions.text import fee_label
from tidepool.functions.words import format_units_limbs, i256_abs, limbs_hex, sum_u256, u256_limbs, units_text
from tidepool.operators import decode
from tidepool.operators.upsert import upsert_launches
from tidepool.sources.dex import AERO, DEXES, SWAP_AERODROME, SWAP_V2, SWAP_V3, USDC, WETH, dex_by_id, is_quote_token0, quote_dim, quote_token
from tidepool.sources.logs import scan_logs

TOP = 2**256


def word(value: int) -> str:
    return format(value % TOP, "064x")


def address(n: int) -> str:
    return "0x" + format(n, "040x")


def topic(n: int) -> str:
    return "0x" + format(n, "064x")


def swap_log(event, words, n=1, quote_first=True):
    return (address(7), [event, topic(1), topic(0xAB)], "0x" + "".join(map(word, words)), n, 1000 + n, f"0xH{n}", n, quote_first)


LOG = "address STRING, topics ARRAY<STRING>, data STRING, block_number BIGINT, time_stamp BIGINT, tx_hash STRING, log_index BIGINT"


def decoded(spark, logs, decoder):
    df = spark.createDataFrame(logs, LOG + ", q0 BOOLEAN")
    out = decoder(df, F.col("q0")).select("log_index", "side", limbs_hex(F.col("quote_limbs")).alias("h"), "recipient", "pool_address", "tx_hash")
    return {r["log_index"]: (r["side"], int(r["h"], 16), r["recipient"]) for r in out.collect()}


def test_unsigned_edges_and_exact_sum(spark):
    values = [0, 1, TOP - 1, 10**29 + 7, 2**128]
    df = spark.createDataFrame([(word(v),) for v in values], "w STRING")
    each = [int(r[0], 16) for r in df.select(limbs_hex(u256_limbs(F.col("w")))).collect()]
    assert each == values
    total = df.agg(sum_u256(u256_limbs(F.col("w"))).alias("l")).select(limbs_hex(F.col("l"))).head()[0]
    assert int(total, 16) == sum(values)


def test_signed_edges(spark):
    values = [-1, -(10**24), 2**255 - 1, 0, -(2**255), -(2**24), 5]
    df = spark.createDataFrame([(word(v),) for v in values], "w STRING")
    assert [int(r[0], 16) for r in df.select(limbs_hex(i256_abs(F.col("w")))).collect()] == [abs(v) for v in values]
    total = df.agg(sum_u256(i256_abs(F.col("w"))).alias("l")).select(limbs_hex(F.col("l"))).head()[0]
    assert int(total, 16) == sum(map(abs, values))


def test_units(spark):
    raw = 123456789012345678901234567890
    df = spark.createDataFrame([(word(raw), 18), (word(0), 6), (word(5), 0), (word(15 * 10**17), 18)], "w STRING, d INT")
    limbs = u256_limbs(F.col("w"))
    texts = [r[0] for r in df.select(units_text(limbs_hex(limbs), F.col("d"))).collect()]
    assert texts == ["123456789012.34567890123456789", "0.0", "5", "1.5"]
    assert abs(df.select(format_units_limbs(limbs, F.col("d"))).head()[0] - raw / 1e18) < 1e-3


def test_constant_product_swaps(spark):
    logs = [
        swap_log(SWAP_V2, [50, 0, 0, 9], 1), swap_log(SWAP_V2, [0, 9, 70, 0], 2), swap_log(SWAP_V2, [3, 1, 4, 1], 3),
        swap_log(SWAP_AERODROME, [0, 8, 1, 0], 4, False), swap_log(SWAP_AERODROME, [8, 0, 0, 6], 5, False),
        swap_log(SWAP_V2, [1, 2, 3], 6), swap_log("0x" + "9" * 64, [1, 2, 3, 4], 7), swap_log(SWAP_V3, [1, 2, 3, 4, 5], 8),
    ]
    to = address(0xAB)
    assert decoded(spark, logs, decode.decode_swaps_v2) == {
        1: ("buy", 50, to), 2: ("sell", 70, to), 3: ("buy", 3, to), 4: ("buy", 8, to), 5: ("sell", 6, to)
    }


def test_signed_delta_swaps(spark):
    logs = [
        swap_log(SWAP_V3, [10**24, -5, 0, 0, 0], 1), swap_log(SWAP_V3, [-(10**24), 5, 0, 0, 0], 2),
        swap_log(SWAP_V3, [0, 5, 0, 0, 0], 3), swap_log(SWAP_V3, [1, -7, 0, 0, 0], 4, False), swap_log(SWAP_V3, [1, 2, 3, 4], 5),
    ]
    to = address(0xAB)
    assert decoded(spark, logs, decode.decode_swaps_v3) == {1: ("buy", 10**24, to), 2: ("sell", 10**24, to), 3: ("sell", 0, to), 4: ("sell", 7, to)}


def test_undecodable_swaps_stay_in_tag_swaps(spark):
    df = spark.createDataFrame([swap_log(SWAP_V2, [1, 2], 1), swap_log(SWAP_V2, [1, 0, 0, 2], 2)], LOG + ", q0 BOOLEAN")
    rows = {r["log_index"]: r["side"] for r in decode.tag_swaps(df, F.col("q0")).collect()}
    assert rows == {1: None, 2: "buy"}


def test_fee_labels_round_like_the_nearest_double(spark):
    expected = {100: "0.01%", 500: "0.05%", 3000: "0.30%", 10000: "1.00%", 50: "0.01%", 150: "0.01%", 250: "0.03%", 1250: "0.13%", 12345: "1.23%", 0: "0.00%"}
    df = spark.createDataFrame([(fee,) for fee in expected], "fee BIGINT")
    assert {r[0]: r[1] for r in df.select("fee", fee_label(F.col("fee"))).collect()} == expected


def creation_logs():
    v2, aero, v3 = (dex_by_id(d) for d in ("uniswap-v2", "aerodrome", "uniswap-v3"))
    weth, token, other = int(WETH, 16), 0xF00D, 0xBEEF
    return [
        (v2.factory.upper().replace("0X", "0x"), [v2.launch_topic, topic(token), topic(weth)], "0x" + word(1) + word(9), 10, 3600, "0xT1", 0),
        (aero.factory, [aero.launch_topic, topic(token), topic(other), topic(1)], "0x" + word(2) + word(9), 11, 7200, "0xT2", 0),
        (v3.factory, [v3.launch_topic, topic(int(USDC, 16)), topic(weth), topic(10000)], "0x" + word(60) + word(3), 12, 7200, "0xT3", 1),
        (address(5), [v3.launch_topic, topic(1), topic(2), topic(500)], "0x" + word(60) + word(4), 13, 7200, "0xT4", 1),
    ]


def test_launches_from_creation_logs(spark):
    logs = spark.createDataFrame(creation_logs(), LOG)
    rows = {r["pool_address"]: (r["dex"], r["token0"], r["pool_type"], r["pool_type_label"]) for r in decode.decode_launches(logs).collect()}
    assert rows == {
        address(1): ("uniswap-v2", address(0xF00D), "volatile", "Volatile"),
        address(2): ("aerodrome", address(0xF00D), "stable", "Stable"),
        address(3): ("uniswap-v3", USDC, "10000", "1.00%"),
    }


def test_built_launch_rows(spark):
    logs = spark.createDataFrame(creation_logs(), LOG)
    transactions = spark.createDataFrame([("0xt1", "0xCreator")], "hash STRING, `from` STRING")
    tokens = spark.createDataFrame([(address(0xF00D), "FOOD", 9)], "address STRING, symbol STRING, decimals INT")
    creations = spark.createDataFrame([(address(0xF00D), 0, 5), (address(0xBEEF), 0, 5)], "address STRING, s BIGINT, created_block BIGINT").selectExpr(
        "address", "timestamp_seconds(s) AS created_at", "created_block")
    rows = {r["pool_address"]: r for r in decode.build_launches(decode.decode_launches(logs), transactions, tokens, quote_dim(spark), creations).collect()}
    first = rows[address(1)]
    assert (first["pair"], first["creator"], first["token_age_at_launch_hours"], first["risk"]) == ("FOOD / WETH", "0xcreator", 1.0, "unrated")
    assert first["liquidity_usd"] is None and first["first_trades"] is None
    # Equal creation blocks: token1 is the token; its symbol falls back to the short address.
    tie = rows[address(2)]
    assert (tie["token_address"], tie["pair"], tie["creator"]) == (address(0xBEEF), "0x0000... / FOOD", "unknown")
    # Two known quotes: both count as created at -1, so again token1; no creation is looked up for it.
    both = rows[address(3)]
    assert (both["token_address"], both["quote_address"], both["token_created_block"]) == (WETH, USDC, None)


def test_quote_lookup_is_per_exchange_and_case_blind(spark):
    df = spark.createDataFrame([("aerodrome", AERO.upper().replace("0X", "0x")), ("uniswap-v2", AERO)], "dex STRING, q STRING")
    assert [r["q_symbol"] for r in quote_token(df, quote_dim(spark), "q").orderBy("dex").collect()] == ["AERO", None]
    assert quote_dim(spark, "nowhere").count() == 4 and len(DEXES) == 3
    order = spark.createDataFrame([("0xA" + "0" * 39, "0xb" + "0" * 39)], "a STRING, b STRING").select(is_quote_token0(F.col("a"), F.col("b"))).head()[0]
    assert order is True


def test_trader_is_signer_then_recipient(spark):
    swaps = spark.createDataFrame([("0xA", "R1"), ("0xB", "R2"), ("0xC", None)], "tx_hash STRING, recipient STRING")
    transactions = spark.createDataFrame([("0xa", "S1")], "hash STRING, `from` STRING")
    assert {(r["tx_hash"], r["trader"]) for r in decode.resolve_traders(swaps, transactions).collect()} == {("0xA", "s1"), ("0xB", "r2")}


def test_logs_of_any_shape_are_passed_over(spark):
    """Anonymous events, missing topics and data must not end a job."""
    odd = [(address(7), t, d, 1, 1, "0xh", i) for i, (t, d) in enumerate([([], "0x"), (None, None), ([SWAP_V2], None), ([SWAP_V3, topic(1)], "0x"), ([DEXES[0].launch_topic], "0x"), ([None], "")])]
    logs = spark.createDataFrame([*odd, (*swap_log(SWAP_V2, [5, 0, 0, 7])[:6], 99)], LOG)
    assert [r["log_index"] for r in decode.decode_swaps_v2(logs, F.lit(True)).collect()] == [99]
    assert decode.decode_swaps_v3(logs, F.lit(True)).count() == 0
    assert decode.decode_launches(logs).count() == 0
    assert scan_logs(logs, None, SWAP_V2, 0).count() == 2
    assert decode.tag_swaps(logs, F.lit(True)).count() == 7


def test_pools_of_two_known_quotes_look_up_both_creations(spark):
    """WETH created at block 900, USDC at 100: WETH is the token."""
    decoded_pools = spark.createDataFrame([("p", "aerodrome", WETH, USDC), ("q", "aerodrome", address(5), USDC)], "pool_address STRING, dex STRING, token0 STRING, token1 STRING")
    made = spark.createDataFrame([(WETH, 900), (USDC, 100)], "address STRING, created_block BIGINT")
    got = {r["pool_address"]: (r["token_address"], r["quote_address"]) for r in decode.resolve_token_side(decoded_pools, quote_dim(spark), made).collect()}
    assert got == {"p": (WETH, USDC), "q": (address(5), USDC)}


def test_upsert_takes_the_last_log_of_a_pool(spark):
    launches = spark.createDataFrame([("p", "old", 0, 0)], "pool_address STRING, pair STRING, block_number BIGINT, log_index BIGINT")
    updates = spark.createDataFrame([("p", f"pair{(i * 7) % 10}", i // 4, i % 4) for i in range(8)], launches.schema)
    for parts in (1, 3, 8):
        assert [r["pair"] for r in upsert_launches(launches, updates.repartition(parts)).collect()] == ["pair9"]
