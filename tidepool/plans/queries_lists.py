"""Queries over launches: filters, lists, rollups, daily numbers, labels and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepool.functions.text import insider_tag, valid_address
from tidepool.operators import listing, stats, upsert
from tidepool.plans.fixtures import Fixtures, duckdb_cte
from tidepool.plans.registry import query
from tidepool.runtime import stage_root
from tidepool.sources.bucketed import BucketedTable
from tidepool.sources.logs import scan_logs, scan_transfers
from tidepool.sources.snapshot import export_snapshot, import_snapshot

LAUNCH = duckdb_cte("f_launches")
LABELS = duckdb_cte("f_labels")
AS_OF = "2001-08-01 00:00:00"
ROW = "id, dex, creator, pair, block_number, pool_type, liquidity_usd, volume_usd"
COLUMNS = ROW.split(", ")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# ---- filters and lookups

def _simple(name: str, apply, where: str, columns: str = ROW):
    query(name, f"{LAUNCH} SELECT {columns} FROM f_launches WHERE {where}")(lambda fx: apply(fx.f_launches).select(*columns.split(", ")))


_simple("filter_dex", lambda df: listing.filter_dex(df, "F"), "dex = 'F'")
_simple("filter_pool_type", lambda df: listing.filter_pool_type(df, "2-HIGH"), "pool_type = '2-HIGH'")
_simple("filter_min_liquidity", lambda df: listing.filter_min_liquidity(df, "250000"), "liquidity_usd >= 250000")
_simple("filter_min_volume", lambda df: listing.filter_min_volume(df, 200000), "volume_usd >= 200000")
_simple("filter_real_volume", listing.filter_real_volume, "intel_updated_at IS NOT NULL AND external_volume_usd IS NOT NULL")
_simple("search_launches", lambda df: listing.search_launches(df, " HIGH / f "), "lower(pair) LIKE '%high / f%' OR creator LIKE '%high / f%' OR pool_address LIKE '%high / f%'")
_simple("search_creators", lambda df: listing.search_creators(df, "W12"), "creator LIKE '%w12%'")
_simple("launch_by_pool", lambda df: listing.launch_by_pool(df, "P", "P0"), "dex = 'P' AND pool_address = 'p0'")
_simple("launches_by_creator", lambda df: listing.launches_by_creator(df, "O", "W7"), "dex = 'O' AND creator = 'w7'")
_simple("monitor_window", lambda df: listing.monitor_window(df, as_of(), 24 * 60), f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY")


@query("stale_market_candidates", f"""{LAUNCH} SELECT {ROW}, market_data_updated_at FROM f_launches
 WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND (market_data_updated_at IS NULL OR market_data_updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 7200 MINUTE)
 ORDER BY market_data_updated_at ASC NULLS FIRST, block_number DESC, pool_address DESC LIMIT 20""")
def stale_market(fx: Fixtures):
    return listing.stale_market_candidates(fx.f_launches, as_of(), 20, 24 * 60, 7200).select(*COLUMNS, "market_data_updated_at")


@query("stale_intel_candidates", f"""{LAUNCH} SELECT {ROW}, intel_updated_at FROM f_launches
 WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND volume_usd > 0 AND (intel_updated_at IS NULL OR intel_updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 7200 MINUTE)
 ORDER BY intel_updated_at ASC NULLS FIRST, volume_usd DESC, pool_address DESC LIMIT 20""")
def stale_intel(fx: Fixtures):
    return listing.stale_intel_candidates(fx.f_launches, as_of(), 20, 24 * 60, 7200).select(*COLUMNS, "intel_updated_at")


@query("valid_address", """SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN '0x' || lpad(hex(c_custkey), 40, '0') ELSE '0x' || c_name END AS address,
 c_nationkey < 12 AS is_valid FROM customer""")
def valid_addresses(fx: Fixtures):
    address = F.concat(F.lit("0x"), F.when(F.col("c_nationkey") < 12, F.lpad(F.hex("c_custkey"), 40, "0")).otherwise(F.col("c_name")))
    return fx.customer.select("c_custkey", address.alias("address"), valid_address(address).alias("is_valid"))


@query("cache_lookups", f"{duckdb_cte('f_edges', 'f_labels')} SELECT wallet, funder FROM f_edges WHERE wallet IN (SELECT address FROM f_labels)")
def cache_lookup(fx: Fixtures):
    keys = fx.f_labels.select(F.col("address").alias("wallet"))
    return listing.cache_lookups(fx.f_edges, keys, "wallet").select("wallet", "funder")


@query("insider_tag", f"""{LAUNCH}, r AS (SELECT id, insider_volume_usd / volume_usd AS ratio, intel_updated_at FROM f_launches)
 SELECT id, CASE WHEN intel_updated_at IS NULL THEN 'pending' WHEN ratio >= 0.4 THEN concat(CAST(floor(ratio * 100 + 0.5) AS BIGINT), '% insider high')
  WHEN ratio >= 0.05 THEN concat(CAST(floor(ratio * 100 + 0.5) AS BIGINT), '% insider') ELSE '' END AS tag FROM r""")
def insider_tags(fx: Fixtures):
    ratio = F.col("insider_volume_usd") / F.col("volume_usd")
    return fx.f_launches.select("id", insider_tag(ratio, F.col("intel_updated_at").isNotNull()).alias("tag"))


@query("clamp_param", f"{LAUNCH} SELECT {ROW} FROM f_launches ORDER BY block_number DESC, id DESC LIMIT 30")
def clamped_page(fx: Fixtures):
    """A page with limit '0' and an unknown sort falls back to 30 newest launches."""
    from tidepool.functions.text import choice_param, clamp_param

    limit, sort = clamp_param("0", 30, 1, 100), choice_param("cheapest", list(listing.LAUNCH_SORTS), "newest")
    return listing.launch_page(fx.f_launches, sort, limit - 1).select(*COLUMNS)


@query("filter_trade_side", f"{duckdb_cte('f_swaps')} SELECT pool_address, trader, side, quote_raw, block_number, log_index FROM f_swaps WHERE side = 'sell'")
def trade_side(fx: Fixtures):
    return listing.filter_trade_side(fx.f_swaps, "sell").select("pool_address", "trader", "side", "quote_raw", "block_number", "log_index")


# ---- pages

_ORDER = {
    "newest": ("block_number DESC", "TRUE"), "oldest": ("block_number ASC", "TRUE"),
    "liquidity": ("liquidity_usd DESC NULLS LAST", "TRUE"), "volume": ("volume_usd DESC NULLS LAST", "TRUE"),
    "realVolume": ("external_volume_usd DESC NULLS LAST", "intel_updated_at IS NOT NULL AND external_volume_usd IS NOT NULL"),
}


def _pages(sort: str, suffix: str):
    order, where = _ORDER[sort]
    body = f"{LAUNCH} SELECT {ROW}, external_volume_usd FROM f_launches WHERE dex = 'O' AND {where} ORDER BY {order}, id DESC"

    @query(f"launch_page{suffix}", f"{body} LIMIT 31")
    def first(fx: Fixtures):
        return listing.launch_page(fx.f_launches, sort, 30, dex="O").select(*COLUMNS, "external_volume_usd")

    @query(f"launch_page{suffix}_next", f"{body} LIMIT 31 OFFSET 30")
    def following(fx: Fixtures):
        page = listing.launch_page(fx.f_launches, sort, 30, dex="O").collect()
        cursor = listing.next_cursor(page, sort, 30)
        return listing.launch_page(fx.f_launches, sort, 30, cursor, dex="O").select(*COLUMNS, "external_volume_usd")


for _sort, _suffix in [("newest", ""), ("oldest", "_oldest"), ("liquidity", "_liquidity"), ("volume", "_volume"), ("realVolume", "_real_volume")]:
    _pages(_sort, _suffix)


@query("launch_page_filtered", f"""{LAUNCH} SELECT {ROW} FROM f_launches WHERE dex = 'F' AND pool_type = '5-LOW' AND liquidity_usd >= 100000 AND volume_usd >= 50000
 AND (lower(pair) LIKE '%w1%' OR creator LIKE '%w1%' OR pool_address LIKE '%w1%') ORDER BY volume_usd DESC, id DESC LIMIT 101""")
def filtered_page(fx: Fixtures):
    return listing.launch_page(fx.f_launches, "volume", 100, dex="F", pool_type="5-LOW", min_liquidity=100000, min_volume=50000, search="w1").select(*COLUMNS)


_CREATORS = f"{LAUNCH}, c AS (SELECT creator AS address, count(*) AS launch_count, min(created_at) AS first_launch_at, max(created_at) AS last_launch_at FROM f_launches GROUP BY creator)"
for _sort, _key, _order in [("launchCount", "creator_page", "launch_count DESC"), ("newest", "creator_page_newest", "last_launch_at DESC"), ("oldest", "creator_page_oldest", "first_launch_at ASC")]:
    def _creators(fx: Fixtures, sort=_sort):
        return listing.creator_page(fx.f_launches, sort, 30)

    def _creators_next(fx: Fixtures, sort=_sort):
        page = listing.creator_page(fx.f_launches, sort, 30).collect()
        return listing.creator_page(fx.f_launches, sort, 30, listing.next_cursor(page, sort, 30, creators=True))

    query(_key, f"{_CREATORS} SELECT * FROM c ORDER BY {_order}, address DESC LIMIT 31")(_creators)
    query(f"{_key}_next", f"{_CREATORS} SELECT * FROM c ORDER BY {_order}, address DESC LIMIT 31 OFFSET 30")(_creators_next)


@query("encode_cursor", f"{LAUNCH}, p AS (SELECT * FROM f_launches ORDER BY volume_usd DESC NULLS LAST, id DESC LIMIT 31 OFFSET 60) SELECT {ROW} FROM p")
def third_page(fx: Fixtures):
    """Third page by walking two cursors."""
    cursor = None
    for _ in range(2):
        cursor = listing.next_cursor(listing.launch_page(fx.f_launches, "volume", 30, cursor).collect(), "volume", 30)
    return listing.launch_page(fx.f_launches, "volume", 30, cursor).select(*COLUMNS)


# ---- statistics

query("launch_count", f"{LAUNCH} SELECT count(*) AS total FROM f_launches WHERE dex = 'O' AND volume_usd >= 100000")(
    lambda fx: stats.launch_count(listing.launch_filters(fx.f_launches, dex="O", min_volume=100000)))
query("creator_rollup", f"{_CREATORS} SELECT * FROM c")(lambda fx: stats.creator_rollup(fx.f_launches))
query("creator_count", f"{LAUNCH} SELECT count(DISTINCT creator) AS total FROM f_launches WHERE creator LIKE '%w1%'")(
    lambda fx: stats.creator_count(listing.search_creators(fx.f_launches, "w1")))
query("creator_page_summary", f"""{_CREATORS}, p AS (SELECT * FROM c ORDER BY launch_count DESC, address DESC LIMIT 100)
 SELECT CAST(sum(launch_count) AS BIGINT) AS launches, count(*) FILTER (launch_count > 1) AS repeat_creators, max(launch_count) AS top_count FROM p""")(
    lambda fx: stats.creator_page_summary(listing.creator_page(fx.f_launches, "launchCount", 99)))

_DAY = f"""{LAUNCH}, s AS (SELECT count(*) AS day_launch_count, coalesce(sum(volume_usd), 0) AS total, coalesce(sum(CASE WHEN intel_updated_at IS NOT NULL THEN external_volume_usd END), 0) AS re,
 coalesce(sum(CASE WHEN intel_updated_at IS NULL THEN volume_usd END), 0) AS an, count(*) FILTER (intel_updated_at IS NOT NULL AND external_volume_usd >= 50000) AS day_launch_count_min_volume,
 count(DISTINCT creator) AS day_active_creators FROM f_launches WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)"""


def _day(fx: Fixtures):
    return stats.day_stats(fx.f_launches, as_of(), 24 * 30, 50000.0)


def _rounded(df, *cols: str):
    return df.withColumns({c: F.round(c, 2) for c in cols})


query("day_stats", f"""{_DAY} SELECT day_launch_count, round(total, 2) AS day_volume_usd, round(re, 2) AS day_real_volume_usd, round(an, 2) AS day_analyzing_volume_usd,
 day_launch_count_min_volume, day_active_creators, CAST(50000 AS DOUBLE) AS min_volume_usd FROM s""")(
    lambda fx: _rounded(_day(fx), "day_volume_usd", "day_real_volume_usd", "day_analyzing_volume_usd"))
query("day_fake_volume", f"""{_DAY} SELECT round(greatest(0, total - re - an), 2) AS day_fake_volume_usd,
 CAST(CASE WHEN total > 0 THEN floor(greatest(0, total - re - an) / total * 100 + 0.5) ELSE 0 END AS BIGINT) AS day_fake_pct FROM s""")(
    lambda fx: _rounded(stats.day_fake_volume(_day(fx)).select("day_fake_volume_usd", "day_fake_pct"), "day_fake_volume_usd"))

_DAILY = f"""{LAUNCH}, cal AS (SELECT CAST(d AS DATE) AS date FROM unnest(generate_series(TIMESTAMP '{AS_OF}' - INTERVAL 89 DAY, TIMESTAMP '{AS_OF}', INTERVAL 1 DAY)) t(d)),
 pts AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS n, sum(coalesce(volume_usd, 0)) AS v FROM f_launches WHERE dex = 'O' GROUP BY 1),
 days AS (SELECT cal.date, coalesce(n, 0) AS launch_count, round(coalesce(v, 0), 2) AS volume_usd FROM cal LEFT JOIN pts ON pts.date = cal.date)"""


def _daily(fx: Fixtures):
    return _rounded(stats.daily_analytics(listing.filter_dex(fx.f_launches, "O"), as_of(), 90), "volume_usd")


query("daily_analytics", f"{_DAILY} SELECT * FROM days")(_daily)


def _kept(fx: Fixtures) -> BucketedTable:
    """Launches merged in three batches: the older ones, some with values that are later replaced; all newer ones; those again."""
    rows = fx.f_launches
    table = BucketedTable(fx.spark, f"{stage_root(fx.spark)}/kept-{uuid.uuid4().hex}", rows.schema, bucket_blocks=366, rollups={"creators": stats.creator_parts, "days": stats.daily_parts})
    wrong = F.col("block_number") % 5 == 0
    early = rows.filter(F.year("created_at") < 1999).withColumns({
        "volume_usd": F.when(wrong, 1.0).otherwise(F.col("volume_usd")), "created_at": F.when(wrong, F.col("created_at") - F.expr("INTERVAL 400 DAYS")).otherwise(F.col("created_at")),
        "block_number": F.when(wrong, F.col("block_number") - 400).otherwise(F.col("block_number")),
    })
    for batch in (early, rows.filter(wrong | (F.year("created_at") >= 1999)), rows.filter(F.year("created_at") == 2000)):
        table.merge(batch, lambda old, new: upsert.upsert(old, new, ["pool_address"], [c for c in new.columns if c != "pool_address"]))
    return table


query("creator_rollup_kept", f"{_CREATORS} SELECT * FROM c")(lambda fx: stats.creator_rollup_of(_kept(fx).rollup("creators")))
query("daily_analytics_kept", f"{_DAILY} SELECT * FROM days")(
    lambda fx: _rounded(stats.daily_analytics_of(_kept(fx).rollup("days").filter("dex = 'O'"), F.lit(AS_OF).cast("timestamp_ntz"), 90), "volume_usd"))
query("days_x_points", f"{_DAILY} SELECT count(*) AS days, count(*) FILTER (launch_count = 0) AS empty_days FROM days")(
    lambda fx: _daily(fx).agg(F.count("*").alias("days"), F.count(F.when(F.col("launch_count") == 0, 1)).alias("empty_days")))
query("daily_summary", f"""{_DAILY} SELECT CAST(sum(launch_count) AS BIGINT) AS total_launches, round(sum(volume_usd), 2) AS total_volume_usd, max(launch_count) AS peak_launches,
 max(volume_usd) AS peak_volume_usd, round(CAST(sum(launch_count) AS DOUBLE) / 90, 1) AS avg_launches, (SELECT date FROM days ORDER BY launch_count DESC, date LIMIT 1) AS busiest_day FROM days""")(
    lambda fx: _rounded(stats.daily_summary(_daily(fx)), "total_volume_usd"))
query("trade_side_counts", f"""{duckdb_cte('f_swaps')} SELECT pool_address, count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side <> 'buy') AS sells FROM f_swaps GROUP BY 1""")(
    lambda fx: stats.trade_side_counts(fx.f_swaps, ["pool_address"]))
query("api_usage", f"""{duckdb_cte('f_api_calls')}, m AS (SELECT method, count(*) AS calls, count(*) FILTER (is_error) AS errors, max(called_at) AS last_called_at FROM f_api_calls GROUP BY method)
 SELECT *, CAST(sum(calls) OVER () AS BIGINT) AS total_calls, CAST(sum(errors) OVER () AS BIGINT) AS total_errors FROM m""")(lambda fx: stats.api_usage(fx.f_api_calls))


# ---- scans

@query("scan_logs", "SELECT '0x' || lpad(lower(hex(l_suppkey)), 40, '0') AS address, l_orderkey AS block_number, CAST(l_linenumber AS BIGINT) AS log_index FROM lineitem WHERE l_suppkey % 3 = 1 AND l_orderkey >= 100")
def scanned_logs(fx: Fixtures):
    from tidepool.sources.dex import SWAP_AERODROME

    return scan_logs(fx.swap_logs(), None, SWAP_AERODROME, 100).select("address", "block_number", "log_index")


@query("scan_transfers", f"{duckdb_cte('f_transfers')} SELECT seq, sender, recipient, via FROM f_transfers")
def scanned_transfers(fx: Fixtures):
    rows = fx.f_transfers
    parts = [rows.filter(F.col("via") == via).drop("via") for via in ("external", "internal")]
    return scan_transfers(*parts).select("seq", "sender", "recipient", "via")


# ---- table maintenance

@query("upsert_launches", f"""{LAUNCH} SELECT id, dex, CASE WHEN dex = 'F' THEN pair ELSE concat(pair, ' v2') END AS pair, liquidity_usd, volume_usd FROM f_launches
 WHERE dex IN ('F', 'O') UNION ALL SELECT id, dex, concat(pair, ' v2'), NULL, NULL FROM f_launches WHERE dex = 'P'""")
def upserted_launches(fx: Fixtures):
    """Known pools keep their metrics, new pools start without any."""
    rows = fx.f_launches
    target = rows.filter("dex IN ('F', 'O')")
    again = rows.filter("dex IN ('O', 'P')").withColumn("pair", F.concat("pair", F.lit(" v2")))
    return upsert.upsert_launches(target, again).select("id", "dex", "pair", "liquidity_usd", "volume_usd")


@query("save_market_data", f"""{LAUNCH} SELECT id, CASE WHEN dex = 'O' THEN 1.5 * volume_usd ELSE volume_usd END AS volume_usd,
 CASE WHEN dex = 'O' THEN volume_usd ELSE liquidity_usd END AS liquidity_usd, external_volume_usd FROM f_launches WHERE dex <> 'P'""")
def saved_market(fx: Fixtures):
    """Update only: rows of unknown pools are ignored, real volume stays."""
    rows = fx.f_launches
    data = rows.filter("dex IN ('O', 'P')").select("pool_address", F.col("volume_usd").alias("liquidity_usd"), (F.col("volume_usd") * 1.5).alias("volume_usd"))
    return upsert.save_market_data(rows.filter("dex <> 'P'"), data).select("id", "volume_usd", "liquidity_usd", "external_volume_usd")


@query("save_launch_intel", f"""{LAUNCH} SELECT id, CASE WHEN pool_type = '1-URGENT' THEN round(volume_usd * 0.75, 4) ELSE external_volume_usd END AS external_volume_usd,
 CASE WHEN pool_type = '1-URGENT' THEN 0.25e0 END AS insider_ratio, volume_usd FROM f_launches""")
def saved_intel(fx: Fixtures):
    rows = fx.f_launches.withColumns({c: F.lit(None).cast("double") for c in ("insider_ratio", "insider_buyer_count", "external_buyer_count")})
    intel = rows.filter("pool_type = '1-URGENT'").select(
        "pool_address", F.round(F.col("volume_usd") * 0.75, 4).alias("external_volume_usd"), (F.col("volume_usd") * 0.25).alias("insider_volume_usd"),
        F.lit(0.25).alias("insider_ratio"), F.lit(1.0).alias("insider_buyer_count"), F.lit(2.0).alias("external_buyer_count"), as_of().alias("intel_updated_at"))
    return upsert.save_launch_intel(rows, intel).select("id", "external_volume_usd", "insider_ratio", "volume_usd")


@query("upsert_wallet_funding", f"""{duckdb_cte('f_edges')} SELECT wallet AS address, arg_min(funder, position) AS funding_source FROM f_edges WHERE via = 'external' GROUP BY wallet
 UNION ALL SELECT wallet, arg_min(funder, position) FROM f_edges GROUP BY wallet HAVING count(*) FILTER (via = 'external') = 0""")
def upserted_funding(fx: Fixtures):
    def records(rows):
        return rows.groupBy(F.col("wallet").alias("address")).agg(F.min_by("funder", "position").alias("funding_source"))

    edges = fx.f_edges
    return upsert.upsert(records(edges), records(edges.filter("via = 'external'")), ["address"], ["funding_source"])


@query("upsert_tx_senders", """SELECT concat('h', o_orderkey) AS tx_hash, concat('w', CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_custkey + 1 END) AS "from" FROM orders""")
def upserted_senders(fx: Fixtures):
    rows = fx.orders.select(F.concat(F.lit("h"), "o_orderkey").alias("tx_hash"), F.concat(F.lit("w"), "o_custkey").alias("from"), "o_orderstatus", "o_custkey")
    target = rows.filter("o_orderstatus IN ('F', 'O')").select("tx_hash", "from")
    changed = rows.filter("o_orderstatus IN ('O', 'P')").select("tx_hash", F.concat(F.lit("w"), F.col("o_custkey") + 1).alias("from"))
    return upsert.upsert(target, changed, ["tx_hash"], ["from"])


@query("upsert_token_creations", f"{duckdb_cte('f_token_creations')} SELECT address, CASE WHEN created_block > 25 THEN created_block + 1000 ELSE created_block END AS created_block FROM f_token_creations")
def upserted_creations(fx: Fixtures):
    rows = fx.f_token_creations.select("address", "created_block")
    return upsert.upsert(rows, rows.filter("created_block > 25").withColumn("created_block", F.col("created_block") + 1000), ["address"], ["created_block"])


@query("upsert_attendee_reports", f"""{duckdb_cte('f_swaps')} SELECT pool_address, count(DISTINCT trader) FILTER (side = 'buy') AS buyer_count, count(*) FILTER (side = 'buy') AS analyzed_trades FROM f_swaps
 GROUP BY pool_address HAVING count(*) FILTER (side = 'buy') > 0 UNION ALL SELECT pool_address, count(DISTINCT trader), count(*) FROM f_swaps GROUP BY pool_address HAVING count(*) FILTER (side = 'buy') = 0""")
def upserted_reports(fx: Fixtures):
    def report(swaps):
        return swaps.groupBy("pool_address").agg(F.countDistinct("trader").alias("buyer_count"), F.count("*").alias("analyzed_trades"))

    return upsert.upsert(report(fx.f_swaps), report(fx.f_swaps.filter("side = 'buy'")), ["pool_address"], ["buyer_count", "analyzed_trades"])


def _label_updates(fx: Fixtures):
    """Every wallet labelled again or for the first time, upper-case, with a blank note for even sizes."""
    note = F.when(F.col("p_size") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name"))
    return fx.part.filter("p_brand = 'Brand#13'").select(F.concat(F.lit("W"), "p_partkey").alias("address"), F.lit("watch").alias("kind"), note.alias("note"))


@query("set_wallet_labels", f"""{LABELS}, u AS (SELECT concat('w', p_partkey) AS address, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_name END AS note FROM part WHERE p_brand = 'Brand#13')
 SELECT coalesce(l.address, u.address) AS address, CASE WHEN u.address IS NOT NULL THEN 'watch' ELSE l.kind END AS kind, CASE WHEN u.address IS NOT NULL THEN u.note ELSE l.note END AS note,
 coalesce(l.created_at, TIMESTAMP '{AS_OF}') AS created_at FROM f_labels l FULL OUTER JOIN u ON u.address = l.address""")
def set_labels(fx: Fixtures):
    return upsert.set_labels(fx.f_labels, _label_updates(fx), as_of()).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


query("remove_wallet_labels", f"{LABELS} SELECT address, kind FROM f_labels WHERE address NOT IN (SELECT concat('w', p_partkey) FROM part WHERE p_brand = 'Brand#13' OR p_size > 25)")(
    lambda fx: upsert.remove_labels(fx.f_labels, fx.part.filter("p_brand = 'Brand#13' OR p_size > 25").select(F.concat(F.lit("W"), "p_partkey").alias("address"))).select("address", "kind"))
query("list_wallet_labels", f"{LABELS} SELECT address, kind, note FROM f_labels")(lambda fx: upsert.list_labels(fx.f_labels).select("address", "kind", "note"))
query("label_addresses", f"{LABELS} SELECT address FROM f_labels WHERE kind = 'rug-bot'")(lambda fx: upsert.label_addresses(fx.f_labels, "rug-bot"))


def _state(fx: Fixtures):
    """One checkpoint per exchange, at its newest launch."""
    return fx.f_launches.groupBy("dex").agg(F.max("block_number").alias("indexed_block")).select(
        F.concat("dex", F.lit("-pools")).alias("id"), "indexed_block", F.lit(6).alias("version"))


@query("prepare_index", f"{LAUNCH} SELECT id, dex, block_number FROM f_launches WHERE NOT (dex = 'F' AND block_number < 731000)")
def prepared(fx: Fixtures):
    launches, _ = upsert.prepare_index(fx.f_launches, _state(fx), "F", 731000, 6)
    return launches.select("id", "dex", "block_number")


@query("prepare_index_reset", f"""{LAUNCH} SELECT CASE dex WHEN 'F' THEN 730999 ELSE max(block_number) END AS indexed_block, CAST(CASE dex WHEN 'F' THEN 7 ELSE 6 END AS INTEGER) AS version,
 concat(dex, '-pools') AS id, CASE WHEN dex <> 'F' THEN count(*) END AS launches FROM f_launches GROUP BY dex""")
def prepared_reset(fx: Fixtures):
    """A new index version drops the exchange's launches and resets its checkpoint."""
    launches, state = upsert.prepare_index(fx.f_launches, _state(fx), "F", 731000, 7)
    left = launches.groupBy(F.concat("dex", F.lit("-pools")).alias("id")).agg(F.count("*").alias("launches"))
    return state.join(left, "id", "left").select("indexed_block", "version", "id", "launches")


query("indexed_block", f"{LAUNCH} SELECT max(block_number) AS indexed_block FROM f_launches WHERE dex = 'P'")(lambda fx: upsert.indexed_block(_state(fx), "P", 0))


def _round_trip(fx: Fixtures, fmt: str):
    import uuid

    path = f"{stage_root(fx.spark)}/snapshot-{uuid.uuid4().hex}"
    tables = {"launches": fx.f_launches, "labels": fx.f_labels, "system.profile": fx.f_labels}
    export_snapshot(tables, path, AS_OF, fmt)
    return import_snapshot(fx.spark, path, {name: df.schema for name, df in tables.items()})


@query("export_snapshot", f"{LAUNCH} SELECT {ROW}, created_at FROM f_launches")
def exported(fx: Fixtures):
    """Launches after a trip through a JSON-lines snapshot."""
    return _round_trip(fx, "json")[0]["launches"].select(*COLUMNS, "created_at")


@query("import_snapshot", f"""{duckdb_cte('f_launches', 'f_labels')} SELECT 'launches' AS "table", count(*) AS "rows" FROM f_launches UNION ALL SELECT 'labels', count(*) FROM f_labels""")
def imported(fx: Fixtures):
    return _round_trip(fx, "parquet")[1]
