"""Raw logs to launches and swaps, as column expressions over whole log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import fee_label, token_age_hours
from tidepool.functions.words import ZERO_WORD, is_negative, magnitude_limbs, magnitude_word, word_address, word_chunks
from tidepool.runtime import skew_join
from tidepool.sources.dex import DEXES, DexSpec, is_known_quote, per_dex, quote_token


def decode_launches(logs: DataFrame, specs: list[DexSpec] | DexSpec | None = None) -> DataFrame:
    """Pool-creation logs of the given exchanges (all by default) in one pass over the log table."""
    specs = DEXES if specs is None else [specs] if isinstance(specs, DexSpec) else specs
    topics, data = [F.get("topics", F.lit(i)) for i in range(4)], F.col("data")
    dex = F.lit(None).cast("string")
    for spec in specs:
        dex = F.when((F.lower("address") == spec.factory) & (topics[0] == spec.launch_topic), F.lit(spec.id)).otherwise(dex)
    fee = F.conv(F.right(topics[3], F.lit(8)), 16, 10).cast("long")
    stable = F.right(topics[3], F.lit(64)) != ZERO_WORD
    known = F.col("dex")
    kind = per_dex(specs, known, lambda spec: spec.id, lambda spec: spec.pool_kind)
    by_fee, curved = kind == "fee", (kind == "flag") & stable
    word_at = per_dex(specs, known, lambda spec: spec.id, lambda spec: 3 + 64 * spec.pool_word)
    pool = F.when(F.length(data) >= word_at + 63, word_address(F.substr(data, word_at, F.lit(64))))
    return logs.filter(topics[0].isin([spec.launch_topic for spec in specs])).withColumn("dex", dex).filter("dex IS NOT NULL").select(
        "dex",
        word_address(topics[1]).alias("token0"),
        word_address(topics[2]).alias("token1"),
        F.when(by_fee, fee.cast("string")).when(curved, F.lit("stable")).otherwise(F.lit("volatile")).alias("pool_type"),
        F.when(by_fee, fee_label(fee)).when(curved, F.lit("Stable")).otherwise(F.lit("Volatile")).alias("pool_type_label"),
        "block_number", "time_stamp", F.lower("tx_hash").alias("tx_hash"), "log_index",
        pool.alias("pool_address"),
    )


def tag_swaps(logs: DataFrame, quote_is_token0: Column, specs: list[DexSpec] | None = None, only: bool = False) -> DataFrame:
    """Every swap log of every exchange with side, quote limbs and recipient; NULL when undecodable.

    Constant-product swaps hold amount-in and amount-out of either token, signed-delta swaps a single
    signed amount, which stands where the amount-in would. Layouts come from ``specs``. ``only`` keeps the
    decodable logs: a filter on the result would be pushed below it and decode every log once more.
    """
    specs = DEXES if specs is None else specs
    data, topic = F.col("data"), F.get("topics", F.lit(0))

    def own(value):
        return per_dex(specs, topic, lambda spec: spec.swap_topic, value)

    def word_of(words):
        """The quote token's own word: one of two places."""
        return F.substr(data, F.when(quote_is_token0, own(lambda spec: 3 + 64 * words(spec)[0])).otherwise(own(lambda spec: 3 + 64 * words(spec)[1])), F.lit(64))

    signed = topic.isin([spec.swap_topic for spec in specs if spec.signed_swaps])
    usable = topic.isin([spec.swap_topic for spec in specs]) & (F.size("topics") > own(lambda spec: spec.recipient_topic)) & (
        F.length(data) >= own(lambda spec: 2 + 64 * spec.swap_words)
    )
    kept = logs.filter(usable) if only else logs
    words = kept.withColumns({
        "_ok": F.lit(True) if only else F.coalesce(usable, F.lit(False)),
        "_first": word_of(lambda spec: spec.swap_in),
        "_out": word_of(lambda spec: spec.swap_out),
        "_signed": signed,
    })
    first = F.col("_first")
    negative = F.col("_signed") & is_negative(first)
    chosen = words.withColumns({"_negative": negative, "_bought": ~negative & (first != ZERO_WORD)})
    amount = F.when(F.col("_signed") | F.col("_bought"), first).otherwise(F.col("_out"))
    sized = chosen.withColumn("_word", F.when(F.col("_ok"), magnitude_word(amount, F.col("_negative"))))
    # Own columns, so that each of the six conversions runs once per row.
    chunked = sized.withColumns({f"_c{i}": chunk for i, chunk in enumerate(word_chunks(F.col("_word")))})
    chunks = [F.col(f"_c{i}") for i in range(6)]
    return chunked.withColumns({
        "pool_address": F.lower("address"),
        "tx_hash": F.lower("tx_hash"),
        "side": F.when(F.col("_ok"), F.when(F.col("_bought"), F.lit("buy")).otherwise(F.lit("sell"))),
        "quote_limbs": F.when(F.col("_ok"), magnitude_limbs(chunks, F.col("_negative"))),
        "recipient": F.when(F.col("_ok"), word_address(F.get("topics", own(lambda spec: spec.recipient_topic)))),
    }).drop("_ok", "_first", "_out", "_signed", "_negative", "_bought", "_word", *[f"_c{i}" for i in range(6)])


def decode_swaps_v2(logs: DataFrame, quote_is_token0: Column) -> DataFrame:
    """Constant-product swaps: quote paid in is a buy, otherwise a sell of the amount paid out."""
    wanted = logs.filter(F.get("topics", F.lit(0)).isin([spec.swap_topic for spec in DEXES if not spec.signed_swaps]))
    return tag_swaps(wanted, quote_is_token0, only=True)


def decode_swaps_v3(logs: DataFrame, quote_is_token0: Column) -> DataFrame:
    """Signed-delta swaps: a positive quote delta is a buy, anything else (zero too) a sell."""
    wanted = logs.filter(F.get("topics", F.lit(0)).isin([spec.swap_topic for spec in DEXES if spec.signed_swaps]))
    return tag_swaps(wanted, quote_is_token0, only=True)


def resolve_token_side(decoded: DataFrame, quotes: DataFrame, creations: DataFrame) -> DataFrame:
    """Adds token_address and quote_address.

    Exactly one known quote decides. Otherwise the later-created side is the token (unknown creation
    counts as block -1, a tie goes to token1); that holds for pools of two known quotes too. Rows that
    one known quote decides need no look-up and get a private join key.
    """
    tagged = is_known_quote(is_known_quote(decoded, quotes, "token0"), quotes, "token1")
    open_row = F.col("token0_is_quote") == F.col("token1_is_quote")
    private = F.concat(F.lit("~"), F.col("pool_address"))

    def with_block(df: DataFrame, side: str) -> DataFrame:
        keyed = df.withColumn("_key", F.when(open_row, F.lower(side)).otherwise(private))
        dim = creations.select(F.col("address").alias("_key"), F.col("created_block").alias(f"_{side}_block"))
        return skew_join(keyed, dim, "_key", "left").drop("_key")

    sided = with_block(with_block(tagged, "token0"), "token1")
    block0, block1 = (F.coalesce(F.col(f"_{side}_block"), F.lit(-1)) for side in ("token0", "token1"))
    token1_is_token = (F.col("token0_is_quote") & ~F.col("token1_is_quote")) | (open_row & (block1 >= block0))
    return sided.select(
        *decoded.columns,
        F.when(token1_is_token, F.col("token1")).otherwise(F.col("token0")).alias("token_address"),
        F.when(token1_is_token, F.col("token0")).otherwise(F.col("token1")).alias("quote_address"),
    )


def pool_quote_fallback(launches: DataFrame, decoded: DataFrame, quotes: DataFrame) -> DataFrame:
    """Fills quote_address of old rows from the creation log: token0 if it is a known quote, else token1."""
    origin = is_known_quote(decoded.select("dex", "pool_address", "token0", "token1"), quotes, "token0").select(
        F.lower("pool_address").alias("pool_address"),
        F.when(F.col("token0_is_quote"), F.col("token0")).otherwise(F.col("token1")).alias("_quote"),
    )
    return launches.join(origin, "pool_address", "left").withColumn(
        "quote_address", F.coalesce("quote_address", "_quote")
    ).drop("_quote")


def _with_token_dim(df: DataFrame, tokens: DataFrame, col: str) -> DataFrame:
    """Token symbol/decimals for addresses that are no known quote (those keep a private key)."""
    dim = tokens.select(F.lower("address").alias("_key"), F.col("symbol").alias("_symbol"), F.col("decimals").alias("_decimals"))
    # A function of the row, so that a recomputed task routes it to the same place.
    private = F.concat(F.lit("~"), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string"))
    key = F.when(F.col(f"{col}_symbol").isNull() & F.col(col).isNotNull(), F.lower(col)).otherwise(private)
    return skew_join(df.withColumn("_key", key), dim, "_key", "left").drop("_key")


def token_symbol(df: DataFrame, quotes: DataFrame, tokens: DataFrame, col: str, name: str) -> DataFrame:
    """Symbol from the quote dimension, then the token dimension, then the shortened address."""
    joined = _with_token_dim(quote_token(df, quotes, col), tokens, col)
    short = F.concat(F.substring(F.col(col), 1, 6), F.lit("..."))
    return joined.withColumn(name, F.coalesce(f"{col}_symbol", "_symbol", short)).drop(
        f"{col}_symbol", f"{col}_decimals", "_symbol", "_decimals"
    )


def token_decimals(df: DataFrame, quotes: DataFrame, tokens: DataFrame, col: str, name: str, default: int | None = 18) -> DataFrame:
    """Decimals from the quote dimension, then the token dimension, then ``default``.

    With ``default=None`` (market data) anything outside 0..36 is unresolved.
    """
    joined = _with_token_dim(quote_token(df, quotes, col), tokens, col)
    known = F.coalesce(F.col(f"{col}_decimals"), F.col("_decimals"))
    value = F.when(known.between(0, 36), known) if default is None else F.coalesce(known, F.lit(default))
    return joined.withColumn(name, value).drop(f"{col}_symbol", f"{col}_decimals", "_symbol", "_decimals")


def build_launches(
    decoded: DataFrame, transactions: DataFrame, tokens: DataFrame, quotes: DataFrame, creations: DataFrame,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Full launch rows; market and intel metrics stay NULL until their own jobs run.

    The log's own timestamp is used unless ``blocks`` (block_number, time_stamp) is given.
    """
    rows = resolve_token_side(decoded, quotes, creations)
    if blocks is not None:
        stamps = blocks.select("block_number", F.col("time_stamp").alias("_block_ts"))
        rows = rows.join(stamps, "block_number", "left").withColumn("time_stamp", F.coalesce("_block_ts", "time_stamp")).drop("_block_ts")
    senders = transactions.select(F.lower("hash").alias("tx_hash"), F.lower("from").alias("_sender"))
    rows = rows.join(senders, "tx_hash", "left")
    made = creations.select(F.col("address").alias("token_address"), F.col("created_at").alias("token_created_at"), F.col("created_block").alias("token_created_block"))
    rows = skew_join(rows, made, "token_address", "left")
    rows = token_symbol(rows, quotes, tokens, "token_address", "token_symbol")
    rows = token_symbol(rows, quotes, tokens, "quote_address", "quote_symbol")
    created = F.timestamp_seconds("time_stamp")
    empty_double, empty_ts, empty_long = (F.lit(None).cast(kind) for kind in ("double", "timestamp", "long"))
    return rows.select(
        F.col("pool_address").alias("id"), "dex", "pool_address", "token_address", "token_symbol",
        "token_created_at", "token_created_block",
        token_age_hours(created, F.col("token_created_at")).alias("token_age_at_launch_hours"),
        "quote_symbol", "quote_address",
        F.concat_ws(" / ", "token_symbol", "quote_symbol").alias("pair"),
        F.coalesce("_sender", F.lit("unknown")).alias("creator"),
        created.alias("created_at"), "block_number", "pool_type", "pool_type_label",
        empty_double.alias("liquidity_usd"), empty_double.alias("volume_usd"),
        empty_double.alias("external_volume_usd"), empty_double.alias("insider_volume_usd"),
        empty_double.alias("insider_ratio"), empty_long.alias("insider_buyer_count"), empty_long.alias("external_buyer_count"),
        empty_ts.alias("intel_updated_at"), empty_ts.alias("market_data_updated_at"),
        empty_long.alias("first_trades"), F.lit("unrated").alias("risk"),
    )


def resolve_traders(swaps: DataFrame, transactions: DataFrame) -> DataFrame:
    """Adds trader: the transaction's signer, else the swap's recipient; rows with neither are dropped.

    A transaction holds a bounded number of swaps, so the join key is even.
    """
    senders = transactions.select(F.lower("hash").alias("_hash"), F.lower("from").alias("_signer"))
    return swaps.join(senders, F.lower("tx_hash") == F.col("_hash"), "left").withColumn(
        "trader", F.coalesce("_signer", F.lower("recipient"))
    ).drop("_hash", "_signer").filter("trader IS NOT NULL")
