"""Queries of the research walk and of the streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepool import schemas
from tidepool.operators import funding, intel, research
from tidepool.plans import attendees
from tidepool.plans.fixtures import Fixtures, duckdb_cte
from tidepool.plans.oracle_parts import BALL, CLASSIFIED, PUBLIC_AT, ROOTS, TRADERS
from tidepool.plans.queries_intel import _INTEL, _merge, once
from tidepool.plans.queries_market import _BUILT, _LIQ, _PRICES, _VOLUME, _hex_dims, _liquidity, _volume, priced_pools
from tidepool.plans.registry import query
from tidepool.runtime import stage, stage_root, stage_table
from tidepool.sources.bucketed import BucketedTable
from tidepool.sources.dex import quote_dim
from tidepool.sources.tables import TableStore
from tidepool.streaming import inflows, ingest, rolling


def _hop(n: int) -> str:
    seen = " UNION ".join(f"SELECT seed, address FROM n{i}" for i in range(n))
    return f"""d{n} AS (SELECT n.seed, e.funder AS address, 'funder' AS step, e.wallet AS child, e.funder, e.via, e.tx_hash, e.position, e.wallet AS parent, {n} AS hops FROM n{n - 1} n JOIN f_edges e ON e.wallet = n.address
 UNION ALL SELECT n.seed, e.wallet, 'funded', e.wallet, e.funder, e.via, e.tx_hash, e.position, e.funder, {n} FROM n{n - 1} n JOIN f_edges e ON e.funder = n.address),
 n{n} AS (SELECT DISTINCT seed, address FROM d{n} EXCEPT ({seen}))"""


_WALK = f"""{duckdb_cte('f_edges', 'f_labels')}, n0 AS (SELECT address AS seed, address FROM f_labels WHERE kind = 'rug-bot'), {', '.join(_hop(n) for n in range(1, 5))},
 found AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY seed, address ORDER BY hops, step DESC, parent, position, child) AS rn FROM found WHERE address <> seed),
 dirs AS (SELECT seed, address, CASE WHEN min(step) = max(step) THEN min(step) ELSE 'both' END AS direction FROM found WHERE address <> seed GROUP BY 1, 2),
 walked AS (SELECT f.seed, f.address, d.direction, CAST(f.hops AS BIGINT) AS hops, f.via, f.tx_hash FROM firsts f JOIN dirs d ON d.seed = f.seed AND d.address = f.address WHERE f.rn = 1
  UNION ALL SELECT seed, address, 'seed', 0, NULL, NULL FROM n0)"""
_CLUSTER = f"""{_WALK}, pub AS (SELECT funder FROM f_edges WHERE funder NOT IN (SELECT address FROM f_labels WHERE kind = 'rug-bot') GROUP BY funder HAVING count(DISTINCT wallet) >= {PUBLIC_AT}),
 pv AS (SELECT DISTINCT seed, child, funder FROM found WHERE funder = seed OR funder NOT IN (SELECT funder FROM pub)),
 und AS (SELECT seed, child AS u, funder AS v FROM pv UNION SELECT seed, funder, child FROM pv),
 inside(seed, address) AS (SELECT seed, seed FROM n0 UNION SELECT u.seed, u.v FROM inside i JOIN und u ON u.seed = i.seed AND u.u = i.address),
 nodes AS (SELECT w.*, i.address IS NOT NULL AS in_cluster FROM walked w LEFT JOIN inside i ON i.seed = w.seed AND i.address = w.address),
 conns AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY in_cluster DESC, hops, address) AS rank FROM nodes WHERE address <> seed),
 top AS (SELECT c.*, l.kind AS label FROM conns c LEFT JOIN f_labels l ON l.address = c.address WHERE rank <= 300)"""


def _seeds(fx: Fixtures):
    return fx.f_labels.filter("kind = 'rug-bot'").select(F.col("address").alias("seed"))


def _walk(fx: Fixtures) -> research.Walk:
    return once(fx, "research-walk", lambda: research.research_walk(_seeds(fx), fx.f_edges))


def _clustered(fx: Fixtures):
    def build():
        bots = fx.f_labels.filter("kind = 'rug-bot'").select("address")
        return stage(research.research_components(_walk(fx), fx.f_edges, bots, PUBLIC_AT, []), "clustered-nodes")

    return once(fx, "research-clustered", build)


def _report(fx: Fixtures) -> research.ResearchReport:
    return once(fx, "research-report", lambda: research.research_report(_seeds(fx), fx.f_edges, fx.f_labels, threshold=PUBLIC_AT, public_seeds=[], counted=schemas.RESEARCH_MAX_CONNECTIONS))


query("research_walk", f"{_WALK} SELECT * FROM walked")(lambda fx: _walk(fx).nodes)
query("research_components", f"{_CLUSTER} SELECT seed, address, in_cluster FROM nodes")(lambda fx: _clustered(fx).select("seed", "address", "in_cluster"))
query("top_connections", f"{_CLUSTER} SELECT seed, address, in_cluster, hops, rank FROM conns WHERE rank <= 300")(
    lambda fx: research.top_connections(_clustered(fx)).select("seed", "address", "in_cluster", "hops", F.col("rank").cast("long").alias("rank")))
query("connections_x_labels", f"{_CLUSTER} SELECT seed, address, direction, hops, in_cluster, via, tx_hash, label FROM top")(
    lambda fx: _report(fx).connections.select("seed", "address", "direction", "hops", "in_cluster", "via", "tx_hash", "label"))
_DRAWN = f"""{_CLUSTER}, pick AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY coalesce(label = 'rug-bot', FALSE) DESC, in_cluster DESC, hops, rank) AS place FROM top),
 drawn AS (SELECT seed, address, CASE WHEN label = 'rug-bot' THEN 'rug' WHEN in_cluster THEN 'insider' ELSE 'funder' END AS role FROM pick WHERE place <= 159 UNION ALL SELECT seed, address, 'seed' FROM n0)"""
query("research_graph", f"{_DRAWN} SELECT * FROM drawn")(lambda fx: _report(fx).nodes)
query("research_graph_edges", f"""{_DRAWN} SELECT DISTINCT f.seed, f.child AS from_address, f.funder AS to_address FROM found f JOIN drawn a ON a.seed = f.seed AND a.address = f.child JOIN drawn b ON b.seed = f.seed AND b.address = f.funder""")(
    lambda fx: _report(fx).edges)
_SUMMARY = f"""{_CLUSTER}, s AS (SELECT seed, count(*) AS connection_count, count(*) FILTER (in_cluster) AS cluster_members, count(*) FILTER (label = 'rug-bot') AS linked_rug_bot_count, coalesce(string_agg(address, ',' ORDER BY address) FILTER (label = 'rug-bot'), '') AS linked_rug_bots FROM top GROUP BY seed),
 w AS (SELECT seed, count(*) AS wallets_explored FROM walked GROUP BY seed)
 SELECT n0.seed, 'rug-bot' AS label, TRUE AS rug_connected, coalesce(connection_count, 0) AS connection_count, coalesce(cluster_members, 0) AS cluster_members, coalesce(linked_rug_bot_count, 0) AS linked_rug_bot_count,
 coalesce(linked_rug_bots, '') AS linked_rug_bots, wallets_explored, n0.seed NOT IN (SELECT seed FROM n4) AS complete FROM n0 JOIN w ON w.seed = n0.seed LEFT JOIN s ON s.seed = n0.seed"""
query("research_summary", _SUMMARY)(lambda fx: _report(fx).summary.withColumn("linked_rug_bots", F.array_join("linked_rug_bots", ",")))
query("research_report", _SUMMARY)(lambda fx: research.research_report(_seeds(fx), fx.f_edges, fx.f_labels, threshold=PUBLIC_AT, public_seeds=[], counted=schemas.RESEARCH_MAX_CONNECTIONS).summary.withColumn(
    "linked_rug_bots", F.array_join("linked_rug_bots", ",")))


# ---- all connections, and both fan-outs

_EVERY = f"""{_CLUSTER}, named AS (SELECT c.*, l.kind AS label FROM nodes c LEFT JOIN f_labels l ON l.address = c.address WHERE c.address <> c.seed)"""
query("research_summary_all", f"""{_EVERY}, s AS (SELECT seed, count(*) AS connection_count, count(*) FILTER (in_cluster) AS cluster_members, count(*) FILTER (label = 'rug-bot') AS linked_rug_bot_count FROM named GROUP BY seed),
 w AS (SELECT seed, count(*) AS wallets_explored FROM walked GROUP BY seed)
 SELECT n0.seed, 'rug-bot' AS label, TRUE AS rug_connected, coalesce(connection_count, 0) AS connection_count, coalesce(cluster_members, 0) AS cluster_members, coalesce(linked_rug_bot_count, 0) AS linked_rug_bot_count,
 wallets_explored, n0.seed NOT IN (SELECT seed FROM n4) AS complete FROM n0 JOIN w ON w.seed = n0.seed LEFT JOIN s ON s.seed = n0.seed""")(
    lambda fx: research.research_counts(_clustered(fx), _walk(fx), fx.f_labels))
#: Funder lists cut to the first four, recipients to the first 30: some edges only the second list has.
_CUT_IN, _CUT_OUT = 4, 30
_TWO_WAY = f"""{duckdb_cte('f_transfers')}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recipient, sender ORDER BY ts, via, seq) AS rn FROM f_transfers
  WHERE NOT is_error AND value <> 0 AND sender <> recipient) WHERE rn = 1),
 up AS (SELECT recipient AS wallet, sender AS funder, via, hash AS tx_hash, row_number() OVER (PARTITION BY recipient ORDER BY ts, via, seq, sender) AS position FROM firsts QUALIFY position <= {_CUT_IN}),
 out AS (SELECT recipient AS wallet, sender AS funder, via, hash AS tx_hash, row_number() OVER (PARTITION BY sender ORDER BY ts, via, seq, recipient) AS position FROM firsts QUALIFY position <= {_CUT_OUT}),
 down AS (SELECT * FROM up UNION ALL SELECT * FROM out WHERE (wallet, funder) NOT IN (SELECT (wallet, funder) FROM up)),
 n0 AS (SELECT DISTINCT recipient AS seed, recipient AS address FROM firsts WHERE CAST(substr(recipient, 2) AS BIGINT) >= 100)"""


def _two_way_hop(n: int) -> str:
    return _hop(n).replace("JOIN f_edges e ON e.wallet", "JOIN up e ON e.wallet").replace("JOIN f_edges e ON e.funder", "JOIN down e ON e.funder")


@query("research_walk_two_way", f"""{_TWO_WAY}, {_two_way_hop(1)}, {_two_way_hop(2)}, found AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2),
 firsts_met AS (SELECT *, row_number() OVER (PARTITION BY seed, address ORDER BY hops, step DESC, parent, position, child) AS rn FROM found WHERE address <> seed),
 dirs AS (SELECT seed, address, CASE WHEN min(step) = max(step) THEN min(step) ELSE 'both' END AS direction FROM found WHERE address <> seed GROUP BY 1, 2)
 SELECT f.seed, f.address, d.direction, CAST(f.hops AS BIGINT) AS hops, f.via, f.tx_hash FROM firsts_met f JOIN dirs d ON d.seed = f.seed AND d.address = f.address WHERE f.rn = 1
 UNION ALL SELECT seed, address, 'seed', 0, NULL, NULL FROM n0""")
def two_way_walk(fx: Fixtures):
    """Two hops around every wallet from u100 on, with the sender's own recipient list next to the wallets' funder lists."""
    inflows_ = funding.funding_inflows(fx.f_transfers, _CUT_IN).withColumnRenamed("hash", "tx_hash")
    outflows = funding.funding_outflows(fx.f_transfers, _CUT_OUT)
    every = funding.dedupe_first_inflow(fx.f_transfers)
    seeds = every.filter(F.substring("wallet", 2, 18).cast("long") >= 100).select(F.col("wallet").alias("seed"))
    return research.research_walk(seeds, inflows_, 2, outflows, written=False).nodes


# ---- streaming jobs over the whole tables, run until their input is exhausted

def _fresh(fx: Fixtures, name: str) -> str:
    return f"{stage_root(fx.spark)}/{name}-{uuid.uuid4().hex}"


INGEST_FILES = 4


def _in_files(df, late, order: str, path: str, files: int = INGEST_FILES) -> None:
    """Writes ``df`` as ``files`` files in the order of ``order``; the rows that ``late`` holds come in a last one.

    The rows are made once, not for the ranges, their files and the last file each, and by all tasks: ``coalesce`` would
    make them in one.
    """
    held = stage_table(df, "in-files")
    held.df.filter(~late).repartitionByRange(files, order).write.parquet(path)
    held.df.filter(late).repartition(1).write.mode("append").parquet(path)
    held.drop()


def _ingested(fx: Fixtures) -> tuple[BucketedTable, TableStore]:
    """Creation logs land as several files, some of them late, and are streamed into the launch table."""
    folder = _fresh(fx, "ingest")
    logs = fx.creation_logs().select(*schemas.RAW_LOGS.fieldNames())
    _in_files(logs, F.col("block_number") % 50 == 0, "block_number", f"{folder}/in")
    transactions, tokens, creations = _hex_dims(fx)
    dims = {"transactions": transactions, "tokens": tokens, "quotes": quote_dim(fx.spark), "creations": creations}
    store = TableStore(fx.spark, f"{folder}/tables")
    launches = BucketedTable(fx.spark, f"{folder}/launches", schemas.LAUNCHES, bucket_blocks=10_000)
    ingest.stream_ingest_launches(fx.spark, f"{folder}/in", store, dims, f"{folder}/checkpoint", launches=launches, files_per_batch=2).awaitTermination()
    return launches, store


@query("stream_ingest_launches", _BUILT)
def streamed_launches(fx: Fixtures):
    rows = _ingested(fx)[0].read()
    return rows.select("pool_address", "dex", "token_address", "quote_address", "pair", "creator", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                       "token_created_block", F.round("token_age_at_launch_hours", 4).alias("token_age_at_launch_hours"))


query("incremental_ingest", f"{duckdb_cte('f_pool_tokens')} SELECT concat(t.dex, '-pools') AS id, max(o.o_orderkey) AS indexed_block, 6 AS version FROM orders o JOIN f_pool_tokens t ON t.pool_address = concat('p', o.o_orderkey) GROUP BY t.dex")(
    lambda fx: _ingested(fx)[1].read("index_state", schemas.INDEX_STATE))


@query("stream_rolling_volume", """WITH b AS (SELECT concat('u', user_id) AS pool_address, time_bucket(INTERVAL 1 HOUR, ts) AS h, sum(CAST(round(value * 100) AS BIGINT)) AS v, count(*) AS n FROM events GROUP BY 1, 2),
 x AS (SELECT pool_address, h - (i * INTERVAL 1 HOUR) AS window_start, v, n FROM b CROSS JOIN range(24) t(i))
 SELECT pool_address, window_start, window_start + INTERVAL 24 HOUR AS window_end, CAST(sum(v) AS BIGINT) AS volume, CAST(sum(n) AS BIGINT) AS swaps FROM x
 WHERE window_start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def streamed_volume(fx: Fixtures):
    """Purchases and views of a user stand for a pool's swaps; windows still open at the end are not emitted."""
    folder = _fresh(fx, "rolling")
    events = fx.spark.readStream.schema(fx.events.schema).parquet(f"{fx.sf_dir}/event[s].parquet")
    swaps = events.select(F.concat(F.lit("u"), "user_id").alias("pool_address"), F.round(F.col("value") * 100).cast("long").alias("amount"), F.col("ts").cast("timestamp").alias("ts"))
    ingest.stream_rolling_volume(swaps, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    rows = fx.spark.read.schema("pool_address STRING, window_start TIMESTAMP, window_end TIMESTAMP, volume BIGINT, swaps BIGINT").parquet(f"{folder}/out")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_first_inflow", f"""{duckdb_cte('f_transfers')} SELECT recipient AS wallet, sender AS other, via, hash, value, ts FROM
 (SELECT *, row_number() OVER (PARTITION BY recipient, sender ORDER BY ts, via, seq) AS rn FROM f_transfers WHERE NOT is_error AND value <> 0 AND sender <> recipient) WHERE rn = 1""")
def streamed_inflows(fx: Fixtures):
    """Transfers arrive in several files, late ones last; the earliest per pair is kept in the state store."""
    folder = _fresh(fx, "inflows")
    _in_files(fx.events, F.col("event_id") % 7 == 3, "ts", f"{folder}/in")
    events = fx.spark.readStream.schema(fx.events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    transfers = events.select(
        F.concat(F.lit("u"), F.get_json_object("props", "$.k")).alias("sender"), F.concat(F.lit("u"), "user_id").alias("recipient"), F.col("value").cast("string").alias("value"),
        (F.col("event_type") == "error").alias("is_error"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "purchase", "internal").otherwise("external").alias("via"), F.concat(F.lit("e"), "event_id").alias("hash"), F.col("event_id").alias("seq"))
    inflows.stream_first_inflows(transfers, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    rows = inflows.read_first_inflows(fx.spark, f"{folder}/out")
    return rows.select("wallet", "other", "via", "hash", F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp_ntz").alias("ts"))


_HOURLY = """b AS (SELECT concat('u', user_id) AS pool_address, time_bucket(INTERVAL 1 HOUR, ts) AS h, sum(CAST(round(value * 100) AS BIGINT)) AS v, count(*) AS n FROM events GROUP BY 1, 2),
 x AS (SELECT pool_address, h - (i * INTERVAL 1 HOUR) AS window_start, v, n FROM b CROSS JOIN range(24) t(i))"""


def _rolled(fx: Fixtures) -> rolling.RollingVolume:
    """Events arrive in several files, every 50th of them in a last, late one; windows are settled half-way."""
    folder = _fresh(fx, "rolled")
    _in_files(fx.events, F.col("event_id") % 50 == 0, "ts", f"{folder}/in")
    events = fx.spark.readStream.schema(fx.events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    swaps = events.select(F.concat(F.lit("u"), "user_id").alias("pool_address"), F.round(F.col("value") * 100).cast("long").alias("amount"), F.col("ts").cast("timestamp").alias("ts"))
    volume = rolling.RollingVolume(fx.spark, f"{folder}/out")
    volume.start(swaps, f"{folder}/checkpoint").awaitTermination()
    volume.settle()
    return volume


@query("stream_rolling_volume_complete", f"WITH {_HOURLY} SELECT pool_address, window_start, window_start + INTERVAL 24 HOUR AS window_end, CAST(sum(v) AS BIGINT) AS volume, CAST(sum(n) AS BIGINT) AS swaps FROM x GROUP BY 1, 2")
def rolled_volume(fx: Fixtures):
    """Every window, with late rows and the windows still open at the end."""
    rows = _rolled(fx).windows()
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


# ---- refresh batches

_TARGET = "2001-08-01 00:00:00"


def _refreshable(fx: Fixtures):
    """Pools as launch rows whose market data and intel were never computed."""
    empty = {c: F.lit(None).cast("double") for c in ("liquidity_usd", "external_volume_usd", "insider_volume_usd")}
    stamps = {c: F.lit(None).cast("timestamp_ntz") for c in ("market_data_updated_at", "intel_updated_at")}
    counts = {c: F.lit(None).cast("long") for c in ("insider_buyer_count", "external_buyer_count")}
    return fx.f_pools.withColumns({**empty, **stamps, **counts})


@query("refresh_market_batch", f"""{_PRICES}, {_VOLUME}, {_LIQ}, ok AS (SELECT p.pool_address, p.insider_ratio, l.liquidity_usd, v.volume_usd FROM f_pools p JOIN liq l ON l.pool_address = p.pool_address AND l.liquidity_usd IS NOT NULL JOIN vol v ON v.pool_address = p.pool_address AND v.volume_usd IS NOT NULL)
 SELECT p.pool_address, round(CASE WHEN ok.pool_address IS NOT NULL THEN ok.liquidity_usd ELSE a.liquidity_usd END, 5) AS liquidity_usd, round(CASE WHEN ok.pool_address IS NOT NULL THEN ok.volume_usd ELSE a.volume_h24 END, 5) AS volume_usd,
 round(ok.volume_usd * (1 - ok.insider_ratio), 5) AS external_volume_usd, round(ok.volume_usd * ok.insider_ratio, 5) AS insider_volume_usd, TIMESTAMP '{_TARGET}' AS market_data_updated_at
 FROM f_pools p LEFT JOIN ok ON ok.pool_address = p.pool_address LEFT JOIN f_pair_aggregates a ON a.pair_address = p.pool_address""")
def refreshed_market(fx: Fixtures):
    rows = ingest.refresh_market_batch(_refreshable(fx), _liquidity(fx), _volume(fx), fx.f_pair_aggregates, F.lit(_TARGET).cast("timestamp_ntz"), window_hours=24 * 365 * 20)
    return rows.select("pool_address", *[F.round(c, 5).alias(c) for c in ("liquidity_usd", "volume_usd", "external_volume_usd", "insider_volume_usd")], "market_data_updated_at")


@query("refresh_intel_batch", f"""{_merge(TRADERS, BALL, ROOTS, CLASSIFIED, _INTEL)} SELECT p.pool_address, CASE WHEN p.volume_usd > 0 THEN round(i.insider_ratio, 6) ELSE p.insider_ratio END AS insider_ratio,
 CASE WHEN p.volume_usd > 0 THEN round(i.total_volume_usd * (1 - i.insider_ratio), 4) END AS external_volume_usd, CASE WHEN p.volume_usd > 0 THEN i.insider_buyer_count END AS insider_buyer_count,
 CASE WHEN p.volume_usd > 0 THEN i.external_buyer_count END AS external_buyer_count FROM f_pools p JOIN intel i ON i.pool_address = p.pool_address""")
def refreshed_intel(fx: Fixtures):
    """Only pools with a known volume are due."""
    def analyse_due(due):
        pools = priced_pools(fx).join(due.select("pool_address"), "pool_address", "left_semi")
        traders = intel.trader_activity(fx.f_swaps.join(due.select("pool_address"), "pool_address", "left_semi"))
        done = attendees.analyse(pools, traders, fx.f_edges, fx.f_labels, PUBLIC_AT, [])
        return intel.pool_intel(done.classified, pools)

    rows = ingest.refresh_intel_batch(_refreshable(fx), analyse_due, F.lit(_TARGET).cast("timestamp_ntz"), window_hours=24 * 365 * 20)
    return rows.select("pool_address", F.round("insider_ratio", 6).alias("insider_ratio"), F.round("external_volume_usd", 4).alias("external_volume_usd"), "insider_buyer_count", "external_buyer_count")
