"""Launch and creator lists: filters, literal search, keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import decode_cursor, encode_cursor, optional_number
from tidepool.operators.stats import creator_rollup
from tidepool.schemas import INTEL_STALE_MINUTES, MARKET_STALE_MINUTES, MONITOR_WINDOW_HOURS

# sort name -> (column, ascending)
LAUNCH_SORTS = {
    "newest": ("block_number", False),
    "oldest": ("block_number", True),
    "liquidity": ("liquidity_usd", False),
    "volume": ("volume_usd", False),
    "realVolume": ("external_volume_usd", False),
}
CREATOR_SORTS = {
    "launchCount": ("launch_count", False),
    "newest": ("last_launch_at", False),
    "oldest": ("first_launch_at", True),
}


def filter_dex(df: DataFrame, dex: str) -> DataFrame:
    return df.filter(F.col("dex") == dex)


def filter_pool_type(df: DataFrame, pool_type: str | None) -> DataFrame:
    return df if not pool_type or pool_type == "all" else df.filter(F.col("pool_type") == pool_type)


def _at_least(df: DataFrame, col: str, value) -> DataFrame:
    number = optional_number(value)
    return df if number is None else df.filter(F.col(col) >= number)


def filter_min_liquidity(df: DataFrame, value) -> DataFrame:
    return _at_least(df, "liquidity_usd", value)


def filter_min_volume(df: DataFrame, value) -> DataFrame:
    return _at_least(df, "volume_usd", value)


def filter_real_volume(df: DataFrame) -> DataFrame:
    """Only pools whose real volume has been computed."""
    return df.filter(F.col("intel_updated_at").isNotNull() & F.col("external_volume_usd").isNotNull())


def _contains(col: str, text: str) -> Column:
    return F.lower(col).contains(F.lower(F.lit(text)))


def search_launches(df: DataFrame, text: str | None) -> DataFrame:
    """Literal, case-insensitive substring of pair, creator or pool address."""
    text = (text or "").strip()
    return df.filter(_contains("pair", text) | _contains("creator", text) | _contains("pool_address", text)) if text else df


def search_creators(df: DataFrame, text: str | None) -> DataFrame:
    text = (text or "").strip()
    return df.filter(_contains("creator", text)) if text else df


def launch_by_pool(df: DataFrame, dex: str, pool: str) -> DataFrame:
    return filter_dex(df, dex).filter(F.col("pool_address") == pool.lower())


def launches_by_creator(df: DataFrame, dex: str, creator: str) -> DataFrame:
    return filter_dex(df, dex).filter(F.col("creator") == creator.lower()).orderBy(F.desc("block_number"), F.desc("pool_address"))


def monitor_window(df: DataFrame, as_of: Column, hours: float = MONITOR_WINDOW_HOURS) -> DataFrame:
    """Launches created in the last ``hours``."""
    return df.filter(F.col("created_at") >= as_of - F.make_dt_interval(secs=F.lit(hours * 3600)))


def _stale(df: DataFrame, col: str, as_of: Column, minutes: float) -> DataFrame:
    return df.filter(F.col(col).isNull() | (F.col(col) < as_of - F.make_dt_interval(secs=F.lit(minutes * 60))))


def stale_market_candidates(df: DataFrame, as_of: Column, limit: int | None = 20, window_hours: float = MONITOR_WINDOW_HOURS, stale_min: float = MARKET_STALE_MINUTES) -> DataFrame:
    """Launches whose market data is missing or old, longest-waiting first."""
    rows = _stale(monitor_window(df, as_of, window_hours), "market_data_updated_at", as_of, stale_min)
    rows = rows.orderBy(F.asc_nulls_first("market_data_updated_at"), F.desc_nulls_last("block_number"), F.desc("pool_address"))
    return rows if limit is None else rows.limit(limit)


def stale_intel_candidates(df: DataFrame, as_of: Column, limit: int | None = 4, window_hours: float = MONITOR_WINDOW_HOURS, stale_min: float = INTEL_STALE_MINUTES) -> DataFrame:
    """Traded launches whose analysis is missing or old, never-analysed first, then by volume."""
    rows = _stale(monitor_window(df, as_of, window_hours).filter(F.col("volume_usd") > 0), "intel_updated_at", as_of, stale_min)
    rows = rows.orderBy(F.asc_nulls_first("intel_updated_at"), F.desc_nulls_last("volume_usd"), F.desc("pool_address"))
    return rows if limit is None else rows.limit(limit)


def launch_filters(df: DataFrame, sort: str = "newest", dex: str | None = None, pool_type: str | None = None, min_liquidity=None, min_volume=None, search: str | None = None) -> DataFrame:
    """The list filter without cursor: what the page total counts."""
    rows = df if dex is None else filter_dex(df, dex)
    rows = filter_min_volume(filter_min_liquidity(filter_pool_type(rows, pool_type), min_liquidity), min_volume)
    rows = filter_real_volume(rows) if sort == "realVolume" else rows
    return search_launches(rows, search)


def _after(col: str, ascending: bool, id_col: str, value, row_id: str, null_tail: bool) -> Column:
    past_null = F.col(col).isNull() & (F.col(id_col) < row_id)
    if null_tail and value == -1:
        return past_null
    bound = F.lit(value) if not isinstance(value, str) else F.lit(value).cast("timestamp")
    beyond = F.col(col) > bound if ascending else F.col(col) < bound
    beyond = beyond | ((F.col(col) == bound) & (F.col(id_col) < row_id))
    return beyond | F.col(col).isNull() if null_tail else beyond


def _ordering(col: str, ascending: bool, id_col: str) -> list[Column]:
    return [F.asc_nulls_first(col) if ascending else F.desc_nulls_last(col), F.desc(id_col)]


def launch_page(df: DataFrame, sort: str = "newest", limit: int = 30, cursor: str | None = None, null_tail: bool = False, **filters) -> DataFrame:
    """``limit`` + 1 launches in page order; the extra row only tells that there is a next page.

    The id tie-break is descending for every sort. Rows with a NULL metric are reachable on the first
    page only, unless ``null_tail`` pages through them as well.
    """
    col, ascending = LAUNCH_SORTS[sort]
    rows = launch_filters(df, sort, **filters)
    if cursor:
        value, row_id = decode_cursor(cursor)
        rows = rows.filter(_after(col, ascending, "id", value, row_id, null_tail))
    return rows.orderBy(*_ordering(col, ascending, "id")).limit(limit + 1)


def creator_page(df: DataFrame, sort: str = "launchCount", limit: int = 30, cursor: str | None = None, search: str | None = None) -> DataFrame:
    """``limit`` + 1 creators in page order over the creator rollup."""
    col, ascending = CREATOR_SORTS[sort]
    rows = creator_rollup(search_creators(df, search))
    if cursor:
        value, address = decode_cursor(cursor, "address", text_values=True)
        rows = rows.filter(_after(col, ascending, "address", value, address, False))
    return rows.orderBy(*_ordering(col, ascending, "address")).limit(limit + 1)


def next_cursor(page: list, sort: str, limit: int, creators: bool = False) -> str | None:
    """Cursor after the page's last row, or None on the last page (``page`` = collected rows, <= limit + 1)."""
    if len(page) <= limit:
        return None
    col, id_field = (CREATOR_SORTS[sort][0], "address") if creators else (LAUNCH_SORTS[sort][0], "id")
    value = page[limit - 1][col]
    return encode_cursor(value.isoformat() if hasattr(value, "isoformat") else value, page[limit - 1][id_field], id_field)


def filter_trade_side(trades: DataFrame, side: str | None) -> DataFrame:
    return trades if side in (None, "", "all") else trades.filter(F.col("side") == side)


def cache_lookups(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Stored rows of a key set."""
    return table.join(keys.select(key).distinct(), key, "left_semi")
