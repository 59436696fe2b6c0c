"""Table schemas and the numeric parameters that carry meaning."""

from pyspark.sql import types as T

# Thresholds and caps that must equal the published behaviour.
STATS_MIN_VOLUME_USD = 100.0
INDEX_VERSION = 6
PUBLIC_FUNDER_THRESHOLD = 75
MIN_RING_SIZE = 3
GRAPH_MAX_TRADERS = 60
GRAPH_MAX_NODES = 140
MAX_FUNDERS_PER_WALLET = 12
MAX_FUNDING_HOPS = 3
RESEARCH_HOPS = 4
RESEARCH_OUT_FANOUT = 25
RESEARCH_GRAPH_MAX_NODES = 160
RESEARCH_MAX_CONNECTIONS = 300
MAX_REPORT_BUYERS = 100
BLOCKS_PER_DAY = 43_200
FIRST_TRADES = 100
MARKET_STALE_MINUTES = 5
INTEL_STALE_MINUTES = 30
MONITOR_WINDOW_HOURS = 24
PUBLIC_FUNDER_SEEDS = [
    "0x0000000000000000000000000000000000000000",
    "0x4200000000000000000000000000000000000010",
]
LABEL_KINDS = ["rug-bot", "watch"]


_TYPES = {
    "STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.TimestampType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name.rstrip("_"), _TYPES[kind]) for name, kind in columns.items()])


RAW_LOGS = _schema(
    address="STRING", topics="ARRAY<STRING>", data="STRING", block_number="BIGINT",
    time_stamp="BIGINT", tx_hash="STRING", log_index="BIGINT",
)
RAW_TRANSFERS = _schema(hash="STRING", from_="STRING", to="STRING", value="STRING", is_error="STRING", time_stamp="BIGINT")
LAUNCHES = _schema(
    id="STRING", dex="STRING", pool_address="STRING", token_address="STRING", token_symbol="STRING",
    token_created_at="TIMESTAMP", token_created_block="BIGINT", token_age_at_launch_hours="DOUBLE",
    quote_symbol="STRING", quote_address="STRING", pair="STRING", creator="STRING",
    created_at="TIMESTAMP", block_number="BIGINT", pool_type="STRING", pool_type_label="STRING",
    liquidity_usd="DOUBLE", volume_usd="DOUBLE", external_volume_usd="DOUBLE",
    insider_volume_usd="DOUBLE", insider_ratio="DOUBLE", insider_buyer_count="BIGINT",
    external_buyer_count="BIGINT", intel_updated_at="TIMESTAMP", market_data_updated_at="TIMESTAMP",
    first_trades="BIGINT", risk="STRING",
)
TOKEN_CREATIONS = _schema(address="STRING", created_at="TIMESTAMP", created_block="BIGINT")
TX_SENDERS = _schema(tx_hash="STRING", from_="STRING")
FUNDER = _schema(from_="STRING", via="STRING", tx_hash="STRING", value="STRING", time_stamp="BIGINT")
WALLET_FUNDING = T.StructType([
    T.StructField("address", T.StringType()),
    T.StructField("funders", T.ArrayType(FUNDER)),
    *_schema(
        funding_source="STRING", funding_tx_hash="STRING", first_funded_at="TIMESTAMP", funding_amount="STRING", fetched_at="TIMESTAMP"
    ).fields,
])
WALLET_LABELS = _schema(address="STRING", kind="STRING", note="STRING", created_at="TIMESTAMP")
INDEX_STATE = _schema(id="STRING", indexed_block="BIGINT", version="INT")
QUOTE_TOKENS = _schema(dex="STRING", address="STRING", symbol="STRING", decimals="INT")
TOKENS = _schema(address="STRING", symbol="STRING", decimals="INT")
