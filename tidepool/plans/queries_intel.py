"""Queries over the funding graph: inflows, walks, components, classes, rings, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import funding, intel, realvolume
from tidepool.plans import attendees
from tidepool.plans.fixtures import Fixtures, duckdb_cte
from tidepool.plans.oracle_parts import BALL, CLASSIFIED, PUBLIC_AT, RINGS, ROOTS, TRADERS, intel_cte
from tidepool.plans.queries_market import _PRICES, priced_pools
from tidepool.plans.registry import query
from tidepool.runtime import stage

TRANSFERS = duckdb_cte("f_transfers")
EDGES = duckdb_cte("f_edges")

_shared: dict[tuple, object] = {}


def once(fx: Fixtures, name: str, build):
    """Results several queries start from, computed once per session and data folder."""
    key = (fx.spark.sparkContext.applicationId, fx.sf_dir, name)
    if key not in _shared:
        _shared[key] = build()
    return _shared[key]


def forget() -> None:
    """Drops shared results, so that the next query computes everything itself."""
    _shared.clear()


# ---- transfers to funding records

_FIRST = f"""{TRANSFERS}, ok AS (SELECT * FROM f_transfers WHERE NOT is_error AND value <> 0 AND sender <> recipient),
 firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recipient, sender ORDER BY ts, via, seq) AS rn FROM ok) WHERE rn = 1),
 inflow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recipient ORDER BY ts, via, seq, sender) AS position FROM firsts) WHERE position <= 12),
 outflow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY ts, via, seq, recipient) AS position FROM firsts) WHERE position <= 25)"""
query("dedupe_first_inflow", f"{_FIRST} SELECT recipient AS wallet, sender AS other, via, hash, value, ts FROM firsts")(lambda fx: funding.dedupe_first_inflow(fx.f_transfers))
query("funding_inflows", f"{_FIRST} SELECT recipient AS wallet, sender AS funder, via, hash, value, ts, position FROM inflow")(
    lambda fx: funding.funding_inflows(fx.f_transfers).withColumn("position", F.col("position").cast("long")))
query("funding_outflows", f"{_FIRST} SELECT recipient AS wallet, sender AS funder, via, hash, value, ts, position FROM outflow")(
    lambda fx: funding.funding_outflows(fx.f_transfers).withColumn("position", F.col("position").cast("long")))


_ALL = f"""{TRANSFERS}, ok AS (SELECT * FROM f_transfers WHERE NOT is_error AND value <> 0 AND sender <> recipient),
 firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recipient, sender ORDER BY ts, via, seq) AS rn FROM ok) WHERE rn = 1)"""
query("funding_inflows_all", f"{_ALL} SELECT recipient AS wallet, sender AS funder, via, hash, value, ts, row_number() OVER (PARTITION BY recipient ORDER BY ts, via, seq, sender) AS position FROM firsts")(
    lambda fx: funding.funding_inflows(fx.f_transfers, None))
query("funding_outflows_all", f"{_ALL} SELECT recipient AS wallet, sender AS funder, via, hash, value, ts, row_number() OVER (PARTITION BY sender ORDER BY ts, via, seq, recipient) AS position FROM firsts")(
    lambda fx: funding.funding_outflows(fx.f_transfers, None))


def _records(fx: Fixtures):
    return funding.wallet_funding_build(funding.funding_inflows(fx.f_transfers), F.lit("2024-02-01").cast("timestamp"), decimals=0)


_RECORD = f"""{_FIRST}, rec AS (SELECT recipient AS address, count(*) AS funder_count, arg_min(sender, position) AS funding_source, arg_min(hash, position) AS funding_tx_hash,
 min(ts) AS first_funded_at, printf('%.4f ETH', arg_min(value, position)) AS funding_amount FROM inflow GROUP BY recipient)"""
query("wallet_funding_build", f"{_RECORD} SELECT * FROM rec")(lambda fx: _records(fx).select(
    "address", F.size("funders").cast("long").alias("funder_count"), "funding_source", "funding_tx_hash", "first_funded_at", "funding_amount"))


@query("funders_of", f"""{_FIRST}, rec AS (SELECT recipient AS wallet, sender AS funder, via, hash AS tx_hash, position FROM inflow)
 SELECT wallet, funder, CASE WHEN legacy THEN 'external' ELSE via END AS via, tx_hash, position FROM (SELECT *, CAST(substr(wallet, 2) AS BIGINT) >= 100 AS legacy FROM rec) WHERE NOT legacy OR position = 1""")
def edges_of_records(fx: Fixtures):
    """Edges of stored records; wallets from u100 on are kept in the old single-funder form."""
    old = F.substring("address", 2, 9).cast("long") >= 100
    rows = _records(fx)
    stored = rows.withColumn("funders", F.when(~old, F.col("funders")))
    return funding.funders_of(stored).select("wallet", "funder", "via", "tx_hash", F.col("position").cast("long").alias("position"))


# ---- the funding graph

query("funder_out_degree", f"{EDGES} SELECT funder, count(DISTINCT wallet) AS wallets FROM f_edges GROUP BY funder")(lambda fx: funding.funder_out_degree(fx.f_edges))
query("funder_x_wallets", f"{EDGES} SELECT funder, wallet FROM f_edges WHERE funder IN (SELECT concat('w', s_suppkey) FROM supplier)")(
    lambda fx: funding.funder_x_wallets(fx.f_edges, fx.f_pools.select(F.col("creator").alias("funder"))).select("funder", "wallet"))
query("public_funders", f"""{duckdb_cte('f_edges', 'f_labels')} SELECT funder FROM f_edges WHERE funder NOT IN (SELECT address FROM f_labels WHERE kind = 'rug-bot') AND funder <> 'tSMALL'
 GROUP BY funder HAVING count(DISTINCT wallet) >= {PUBLIC_AT} UNION SELECT funder FROM f_edges WHERE funder = 'w7'""")(
    lambda fx: funding.public_funders(fx.f_edges, fx.f_labels.filter("kind = 'rug-bot'").select("address").unionByName(
        fx.spark.createDataFrame([("tSMALL",)], "address STRING")), PUBLIC_AT, ["w7"]))


def _traders(fx: Fixtures):
    return once(fx, "traders", lambda: stage(intel.trader_activity(fx.f_swaps), "traders"))


def _start(fx: Fixtures):
    return _traders(fx).select("pool_address", F.col("trader").alias("wallet")).unionByName(fx.f_pools.select("pool_address", F.col("creator").alias("wallet")))


def _walked(fx: Fixtures):
    def build():
        flagged = funding.flag_public(fx.f_edges.select("wallet", "funder", "position"), None, PUBLIC_AT, [])
        return stage(funding.funding_walk(_start(fx), flagged, ["pool_address"]), "walked")

    return once(fx, "walked", build)


_WALK = f"""{intel_cte(TRADERS)}, own AS (SELECT pool_address, trader AS wallet FROM traders UNION SELECT pool_address, creator FROM f_pools),
 s0 AS (SELECT o.pool_address, e.wallet, e.funder FROM own o JOIN f_edges e ON e.wallet = o.wallet),
 n1 AS (SELECT DISTINCT pool_address, funder AS wallet FROM s0 EXCEPT SELECT pool_address, wallet FROM own),
 s1 AS (SELECT n.pool_address, e.wallet, e.funder FROM n1 n JOIN f_edges e ON e.wallet = n.wallet),
 n2 AS (SELECT DISTINCT pool_address, funder AS wallet FROM s1 EXCEPT (SELECT pool_address, wallet FROM own UNION SELECT pool_address, wallet FROM n1)),
 s2 AS (SELECT n.pool_address, e.wallet, e.funder FROM n2 n JOIN f_edges e ON e.wallet = n.wallet),
 walk AS (SELECT *, 0 AS hop FROM s0 UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2)"""
query("funding_walk", f"{_WALK} SELECT pool_address, wallet, funder, CAST(hop AS INTEGER) AS hop FROM walk")(lambda fx: _walked(fx).select("pool_address", "wallet", "funder", "hop"))
query("unseen_nodes", f"{_WALK} SELECT pool_address, wallet FROM n1")(lambda fx: funding.unseen_nodes(
    _walked(fx).filter("hop = 0").select("pool_address", F.col("funder").alias("wallet")), _start(fx), ["pool_address", "wallet"]))
query("funding_components", f"""{_WALK}, d AS (SELECT funder, count(DISTINCT wallet) AS n FROM f_edges GROUP BY funder), pv AS (SELECT w.pool_address, w.wallet, w.funder FROM walk w JOIN d ON d.funder = w.funder AND d.n < {PUBLIC_AT}),
 und AS (SELECT pool_address, wallet AS u, funder AS v FROM pv UNION SELECT pool_address, funder, wallet FROM pv),
 cl(pool_address, node, label) AS (SELECT DISTINCT pool_address, u, u FROM und UNION SELECT e.pool_address, e.v, c.label FROM cl c JOIN und e ON e.pool_address = c.pool_address AND e.u = c.node)
 SELECT pool_address, node, min(label) AS root FROM cl GROUP BY pool_address, node""")(
    lambda fx: funding.funding_components(_walked(fx).filter("NOT is_public")))
query("wallet_x_funding", f"""{intel_cte(TRADERS)} SELECT t.pool_address, t.trader, e.funder FROM traders t LEFT JOIN f_edges e ON e.wallet = t.trader""")(
    lambda fx: _traders(fx).select("pool_address", "trader").join(fx.f_edges.select(F.col("wallet").alias("trader"), "funder"), "trader", "left").select("pool_address", "trader", "funder"))
query("creator_funding_source", f"""{intel_cte()} SELECT p.pool_address, p.creator, (SELECT arg_min(e.funder, e.position) FROM f_edges e WHERE e.wallet = p.creator) AS creator_funding_source FROM f_pools p""")(
    lambda fx: funding.creator_funding_source(fx.f_pools, fx.f_edges))


# ---- traders and classes

query("trader_activity", f"{intel_cte(TRADERS)} SELECT pool_address, trader, quote_raw, trade_count, first_trade_at, seen.b AS first_block, seen.l AS first_log_index FROM traders")(
    lambda fx: intel.trader_activity(fx.f_swaps).select("pool_address", "trader", "quote_raw", "trade_count", "first_trade_at", "first_block", "first_log_index"))
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY pool_address ORDER BY quote_raw DESC, seen.b, seen.l, trader) AS rank FROM {0})"
query("rank_buyers", f"{intel_cte(TRADERS)}, {_RANKED.format('traders')} SELECT pool_address, trader, quote_raw, rank FROM ranked WHERE rank <= 100")(
    lambda fx: intel.rank_buyers(_traders(fx)).select("pool_address", "trader", "quote_raw", F.col("rank").cast("long").alias("rank")))


def analysis(fx: Fixtures) -> attendees.Analysis:
    def build():
        return attendees.analyse(priced_pools(fx), _traders(fx), fx.f_edges, fx.f_labels, PUBLIC_AT, [])

    return once(fx, "analysis", build)


def full_report(fx: Fixtures) -> intel.AttendeeReport:
    def build():
        funded = fx.part.filter("p_size < 50 OR p_brand <> 'Brand#7'").select(F.concat(F.lit("w"), "p_partkey").alias("address"))
        return attendees.report(analysis(fx), fx.f_edges, funded, F.lit("2001-08-01").cast("timestamp_ntz"))

    return once(fx, "report", build)


def _rings(fx: Fixtures):
    return once(fx, "rings", lambda: stage(intel.coordinated_rings(analysis(fx).classified, analysis(fx).graph.edges), "rings-all"))


_CLASS = intel_cte(TRADERS, BALL, ROOTS, CLASSIFIED)
query("classify_attendees", f"{_CLASS} SELECT pool_address, trader, classification, root FROM classified")(
    lambda fx: analysis(fx).classified.select("pool_address", "trader", "classification", "root"))
query("buyers_x_funding", f"{_CLASS} SELECT pool_address, trader, funding_source, funder_count FROM classified")(
    lambda fx: analysis(fx).classified.select("pool_address", "trader", "funding_source", "funder_count"))
query("insider_cluster", f"{_CLASS} SELECT pool_address, CAST(0 AS BIGINT) AS cluster_id, count(*) AS members FROM classified WHERE classification <> 'external' GROUP BY pool_address")(
    lambda fx: intel.insider_cluster(analysis(fx).classified).filter("cluster_id = 0").groupBy("pool_address", "cluster_id").agg(F.count("*").alias("members")))
query("analysis_complete", f"""{intel_cte(TRADERS)}, funded AS (SELECT concat('w', p_partkey) AS address FROM part WHERE p_size < 50 OR p_brand <> 'Brand#7'),
 core AS (SELECT pool_address, trader AS wallet FROM traders UNION SELECT pool_address, creator FROM f_pools UNION SELECT pool_address, address FROM f_pools CROSS JOIN f_labels WHERE kind = 'rug-bot')
 SELECT pool_address, bool_and(wallet IN (SELECT address FROM funded)) AS complete FROM core GROUP BY pool_address""")(
    lambda fx: intel.analysis_complete(fx.f_pools, _traders(fx), fx.f_labels.filter("kind = 'rug-bot'"),
                                       fx.part.filter("p_size < 50 OR p_brand <> 'Brand#7'").select(F.concat(F.lit("w"), "p_partkey").alias("address"))))


# ---- volume split

_INTEL = f"""sums AS (SELECT pool_address, CAST(sum(quote_raw) AS DOUBLE) AS total_quote, CAST(coalesce(sum(quote_raw) FILTER (classification <> 'external'), 0) AS DOUBLE) AS insider_quote,
  count(*) FILTER (classification <> 'external') AS insider_buyer_count, count(*) FILTER (classification = 'external') AS external_buyer_count, CAST(sum(trade_count) AS BIGINT) AS analyzed_trades FROM classified GROUP BY pool_address),
 intel AS (SELECT p.pool_address, p.dex, p.creator, s.insider_buyer_count, s.external_buyer_count, s.analyzed_trades, s.insider_quote / s.total_quote AS insider_ratio,
  CASE WHEN p.volume_usd > 0 THEN p.volume_usd ELSE s.total_quote / 100 * pr.price_usd END AS total_volume_usd FROM f_pools p JOIN sums s ON s.pool_address = p.pool_address LEFT JOIN prices pr ON pr.token = p.quote_address)"""


def _merge(*parts: str) -> str:
    """One WITH clause with the projections, the prices and the given parts."""
    domain = duckdb_cte("f_swaps", "f_pools", "f_edges", "f_labels", "f_prices")
    return ", ".join([domain, _PRICES[_PRICES.index("tk AS ("):], *parts])


_FULL = _merge(TRADERS, BALL, ROOTS, CLASSIFIED, _INTEL)
query("pool_intel", f"""{_FULL} SELECT pool_address, analyzed_trades, insider_buyer_count, external_buyer_count, insider_buyer_count + external_buyer_count AS buyer_count, round(insider_ratio, 6) AS insider_ratio,
 round(total_volume_usd, 4) AS total_volume_usd, round(total_volume_usd * (1 - insider_ratio), 4) AS external_volume_usd, round(total_volume_usd * insider_ratio, 4) AS insider_volume_usd FROM intel""")(
    lambda fx: _round(intel.pool_intel(analysis(fx).classified, analysis(fx).launches)))


def _round(df, digits=6):
    money = {c: F.round(c, 4) for c in ("total_volume_usd", "external_volume_usd", "insider_volume_usd")}
    return df.withColumns({**money, "insider_ratio": F.round("insider_ratio", digits)})


# ---- volume split from raw logs

_WIDE = """f_swaps AS (SELECT concat('s', l_suppkey) AS pool_address, coalesce(t.sender, concat('w', l_partkey)) AS trader,
  CAST(round(l_extendedprice * 100) AS HUGEINT) * 18446744073709551616 + (l_partkey + 1) * 4294967311 + l_orderkey AS quote_raw, l_shipdate AS ts, l_orderkey AS block_number,
  CAST(l_linenumber AS BIGINT) AS log_index, l_quantity = 50 AS unread FROM lineitem LEFT JOIN f_tx t ON t.hash = concat('h', l_orderkey)),
 tip AS (SELECT max(l_orderkey) AS tip_block FROM lineitem),
 win AS (SELECT s.* FROM f_swaps s JOIN f_pools p ON p.pool_address = s.pool_address, tip WHERE s.block_number BETWEEN tip_block - tip_block // 2 AND tip_block AND s.block_number >= p.block_number),
 traders AS (SELECT pool_address, trader, sum(quote_raw) AS quote_raw, count(*) AS trade_count FROM win WHERE NOT unread GROUP BY pool_address, trader)"""
_FROM_LOGS = ", ".join([duckdb_cte("f_tx", "f_pools", "f_edges", "f_labels", "f_prices"), _PRICES[_PRICES.index("tk AS ("):], _WIDE, BALL, ROOTS, CLASSIFIED]) + """,
 seen AS (SELECT pool_address, count(*) AS analyzed_trades FROM win GROUP BY pool_address),
 sums AS (SELECT pool_address, sum(quote_raw) AS total, coalesce(sum(quote_raw) FILTER (classification <> 'external'), 0) AS insider, count(*) FILTER (classification <> 'external') AS insider_buyer_count,
  count(*) FILTER (classification = 'external') AS external_buyer_count FROM classified GROUP BY pool_address),
 intel AS (SELECT '0x' || lpad(lower(hex(CAST(substr(p.pool_address, 2) AS BIGINT))), 40, '0') AS pool_address, coalesce(n.analyzed_trades, 0) AS analyzed_trades, coalesce(s.insider_buyer_count, 0) AS insider_buyer_count,
  coalesce(s.external_buyer_count, 0) AS external_buyer_count, coalesce(s.total, 0) AS total, coalesce(s.insider, 0) AS insider, CASE WHEN s.total > 0 THEN CAST(s.insider AS DOUBLE) / CAST(s.total AS DOUBLE) ELSE 0.0e0 END AS insider_ratio,
  CASE WHEN p.volume_usd > 0 THEN p.volume_usd ELSE CAST(coalesce(s.total, 0) AS DOUBLE) / 1.0e20 * pr.price_usd END AS total_volume_usd
  FROM f_pools p LEFT JOIN sums s ON s.pool_address = p.pool_address LEFT JOIN seen n ON n.pool_address = p.pool_address LEFT JOIN prices pr ON pr.token = p.quote_address)
 SELECT pool_address, analyzed_trades, insider_buyer_count, external_buyer_count, insider_buyer_count + external_buyer_count AS buyer_count, round(insider_ratio, 9) AS insider_ratio, round(total_volume_usd, 4) AS total_volume_usd,
  round(total_volume_usd * (1 - insider_ratio), 4) AS external_volume_usd, round(total_volume_usd * insider_ratio, 4) AS insider_volume_usd,
  lpad(lower(hex(total)), 72, '0') AS total_quote_hex, lpad(lower(hex(insider)), 72, '0') AS insider_quote_hex FROM intel"""


def _chain_address(name):
    """'w12' and 's12' as addresses in the logs' hex space; other names as they are."""
    number = F.lpad(F.lower(F.hex(F.substring(name, 2, 18).try_cast("long"))), 40, "0")
    return F.when(name.rlike("^[ws][0-9]+$"), F.concat(F.lit("0x"), number)).otherwise(name)


@query("pool_intel_from_logs", _FROM_LOGS)
def intel_from_logs(fx: Fixtures):
    """Real volume of every pool from raw 256-bit logs over the newer half of the chain."""
    logs = fx.swap_logs(wide=True)
    tip = realvolume.tip_of(fx.lineitem, "l_orderkey")
    transactions = fx.orders.filter("o_orderstatus <> 'P'").select(
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("o_orderkey")), 64, "0")).alias("hash"), _chain_address(F.concat(F.lit("w"), "o_custkey")).alias("from"), F.col("o_orderkey").alias("block_number"))
    pools = priced_pools(fx).select(
        _chain_address(F.col("pool_address")).alias("pool_address"), _chain_address(F.col("creator")).alias("creator"), F.col("block_number").alias("launch_block"),
        (F.substring("pool_address", 2, 18).cast("long") % 2 == 0).alias("quote_is_token0"), F.lit(20).alias("quote_decimals"), "price_usd", "volume_usd")
    edges = fx.f_edges.withColumns({c: _chain_address(F.col(c)) for c in ("wallet", "funder")})
    labels = fx.f_labels.withColumn("address", _chain_address(F.col("address")))
    rows = realvolume.pool_intel_from_logs(logs.drop("quote_is_token0"), transactions, pools, edges, labels, tip, tip // 2, threshold=PUBLIC_AT, seeds=[])
    return _round(rows, 9)


# ---- rings, clusters

_RING = f"{_CLASS}, {RINGS}"
query("coordinated_rings", f"{_RING} SELECT pool_address, ring_id, funder, unnest(fresh) AS trader FROM ring_rows")(_rings)
_CLUSTERED = """clustered AS (SELECT c.*, CASE WHEN c.classification <> 'external' THEN 0 ELSE m.ring_id END AS cluster_id FROM classified c
 LEFT JOIN (SELECT pool_address, ring_id, unnest(fresh) AS trader FROM ring_rows) m ON m.pool_address = c.pool_address AND m.trader = c.trader)"""
query("cluster_rollup", f"""{_RING}, {_CLUSTERED} SELECT c.pool_address, CAST(c.cluster_id AS BIGINT) AS cluster_id, CASE WHEN c.cluster_id = 0 THEN 'creator-insider' ELSE 'coordinated' END AS kind, count(*) AS member_count,
 CAST(sum(c.quote_raw) AS DOUBLE) AS quote_total, CASE WHEN c.cluster_id = 0 THEN (SELECT arg_min(e.funder, e.position) FROM f_edges e WHERE e.wallet = any_value(c.creator)) ELSE any_value(r.funder) END AS funding_source
 FROM clustered c LEFT JOIN ring_rows r ON r.pool_address = c.pool_address AND r.ring_id = c.cluster_id WHERE c.cluster_id IS NOT NULL GROUP BY c.pool_address, c.cluster_id""")(lambda fx: full_report(fx).clusters)


# ---- report and graph

_GRAPH = f"""{_RING}, {_CLUSTERED}, {_RANKED.format('clustered')},
 g0 AS (SELECT pool_address, trader AS address, rank AS place FROM ranked WHERE rank <= 60 AND trader <> creator UNION ALL SELECT pool_address, creator, 0 FROM f_pools),
 f1 AS (SELECT g.pool_address, x.funder AS address, min((g.place, x.position)) AS k FROM g0 g JOIN private x ON x.pool_address = g.pool_address AND x.wallet = g.address GROUP BY 1, 2),
 c1 AS (SELECT *, row_number() OVER (PARTITION BY pool_address ORDER BY k, address) AS rn FROM f1 WHERE (pool_address, address) NOT IN (SELECT (pool_address, address) FROM g0)),
 g1 AS (SELECT c.pool_address, c.address, 1000 + rn AS place FROM c1 c WHERE rn + (SELECT count(*) FROM g0 WHERE g0.pool_address = c.pool_address) <= 140), a1 AS (SELECT * FROM g0 UNION ALL SELECT * FROM g1),
 f2 AS (SELECT g.pool_address, x.funder AS address, min((g.place, x.position)) AS k FROM g1 g JOIN private x ON x.pool_address = g.pool_address AND x.wallet = g.address GROUP BY 1, 2),
 c2 AS (SELECT *, row_number() OVER (PARTITION BY pool_address ORDER BY k, address) AS rn FROM f2 WHERE (pool_address, address) NOT IN (SELECT (pool_address, address) FROM a1)),
 g2 AS (SELECT c.pool_address, c.address, 2000 + rn AS place FROM c2 c WHERE rn + (SELECT count(*) FROM a1 WHERE a1.pool_address = c.pool_address) <= 140), a2 AS (SELECT * FROM a1 UNION ALL SELECT * FROM g2),
 f3 AS (SELECT g.pool_address, x.funder AS address, min((g.place, x.position)) AS k FROM g2 g JOIN private x ON x.pool_address = g.pool_address AND x.wallet = g.address GROUP BY 1, 2),
 c3 AS (SELECT *, row_number() OVER (PARTITION BY pool_address ORDER BY k, address) AS rn FROM f3 WHERE (pool_address, address) NOT IN (SELECT (pool_address, address) FROM a2)),
 g3 AS (SELECT c.pool_address, c.address, 3000 + rn AS place FROM c3 c WHERE rn + (SELECT count(*) FROM a2 WHERE a2.pool_address = c.pool_address) <= 140), drawn AS (SELECT * FROM a2 UNION ALL SELECT * FROM g3),
 node AS (SELECT d.pool_address, d.address, CASE WHEN d.address = p.creator THEN 'creator' WHEN d.address IN (SELECT address FROM bots) THEN 'rug' WHEN c.classification = 'rug-bot' THEN 'rug'
  WHEN c.classification = 'external' THEN CASE WHEN c.cluster_id IS NOT NULL THEN 'coordinated' ELSE 'external' END WHEN c.classification IS NOT NULL THEN 'insider'
  WHEN r.root = cr.root OR rr.root IS NOT NULL THEN 'insider' ELSE 'funder' END AS role,
  CAST(CASE WHEN d.address = p.creator THEN 0 WHEN d.address IN (SELECT address FROM bots) THEN NULL ELSE c.cluster_id END AS BIGINT) AS cluster_id, CAST(c.quote_raw AS DOUBLE) AS quote_total
  FROM drawn d JOIN f_pools p ON p.pool_address = d.pool_address LEFT JOIN clustered c ON c.pool_address = d.pool_address AND c.trader = d.address LEFT JOIN roots r ON r.pool_address = d.pool_address AND r.node = d.address
  LEFT JOIN creator_root cr ON cr.pool_address = d.pool_address LEFT JOIN rug_roots rr ON rr.pool_address = r.pool_address AND rr.root = r.root),
 link AS (SELECT DISTINCT x.pool_address, x.wallet AS from_address, x.funder AS to_address FROM private x JOIN drawn a ON a.pool_address = x.pool_address AND a.address = x.wallet JOIN drawn b ON b.pool_address = x.pool_address AND b.address = x.funder)"""
query("attendee_graph", f"{_GRAPH} SELECT pool_address, address, role, cluster_id FROM node")(lambda fx: full_report(fx).nodes.select("pool_address", "address", "role", "cluster_id"))
query("nodes_x_volume", f"{_GRAPH} SELECT pool_address, address, quote_total FROM node")(lambda fx: full_report(fx).nodes.select("pool_address", "address", "quote_total"))
query("graph_edges_in_nodes", f"{_GRAPH} SELECT * FROM link")(lambda fx: full_report(fx).edges)

_REPORT = f"""{_FULL}, funded AS (SELECT concat('w', p_partkey) AS address FROM part WHERE p_size < 50 OR p_brand <> 'Brand#7'),
 comp AS (SELECT pool_address, bool_and(wallet IN (SELECT address FROM funded)) AS complete FROM core GROUP BY pool_address),
 rep AS (SELECT i.pool_address, i.dex, i.creator, (SELECT arg_min(e.funder, e.position) FROM f_edges e WHERE e.wallet = i.creator) AS creator_funding_source, TRUE AS analyzed, c.complete, i.analyzed_trades,
  i.insider_buyer_count + i.external_buyer_count AS buyer_count, i.insider_buyer_count, i.external_buyer_count, round(i.total_volume_usd, 4) AS total_volume_usd,
  round(i.total_volume_usd * (1 - i.insider_ratio), 4) AS external_volume_usd, round(i.total_volume_usd * i.insider_ratio, 4) AS insider_volume_usd, round(i.insider_ratio, 6) AS insider_ratio
  FROM intel i JOIN comp c ON c.pool_address = i.pool_address)"""
query("attendee_report", f"{_REPORT} SELECT * FROM rep")(lambda fx: _round(full_report(fx).summary.drop("updated_at")))
query("attendee_report_buyers", f"""{_merge(TRADERS, BALL, ROOTS, CLASSIFIED, RINGS, _CLUSTERED, _RANKED.format('clustered'))} SELECT r.pool_address, r.rank, r.trader AS address, r.classification, r.funding_source, r.funder_count,
 CAST(r.cluster_id AS BIGINT) AS cluster_id, r.trade_count, round(r.quote_raw / 100.0e0 * pr.price_usd, 4) AS volume_usd, r.first_trade_at,
 CAST(greatest(0, floor(epoch(r.first_trade_at - p.created_at) + 0.5)) AS BIGINT) AS seconds_after_launch
 FROM ranked r JOIN f_pools p ON p.pool_address = r.pool_address LEFT JOIN prices pr ON pr.token = p.quote_address WHERE rank <= 100""")(
    lambda fx: full_report(fx).buyers.withColumn("volume_usd", F.round("volume_usd", 4)))


@query("attendee_report_or_stub", f"""{_REPORT} SELECT p.pool_address, p.dex, p.creator, coalesce(r.analyzed, FALSE) AS analyzed, coalesce(r.buyer_count, 0) AS buyer_count, coalesce(r.analyzed_trades, 0) AS analyzed_trades, r.insider_ratio
 FROM f_pools p LEFT JOIN (SELECT * FROM rep WHERE insider_buyer_count > 60) r ON r.pool_address = p.pool_address""")
def report_or_stub(fx: Fixtures):
    """Only the reports with more than 60 insiders have been stored."""
    stored = _round(full_report(fx).summary).filter("insider_buyer_count > 60")
    return intel.attendee_report_or_stub(fx.f_pools, stored).select("pool_address", "dex", "creator", "analyzed", "buyer_count", "analyzed_trades", "insider_ratio")


@query("creator_profile", f"""{duckdb_cte('f_launches', 'f_edges')} SELECT l.creator AS address, count(*) AS launch_count, CASE WHEN count(*) > 1 THEN 'repeat creator' ELSE 'first observed launch' END AS label,
 any_value(e.funding_source) AS funding_source FROM f_launches l LEFT JOIN (SELECT wallet, arg_min(funder, position) AS funding_source FROM f_edges GROUP BY wallet) e ON e.wallet = l.creator GROUP BY l.creator""")
def profiles(fx: Fixtures):
    records = fx.f_edges.groupBy(F.col("wallet").alias("address")).agg(F.min_by("funder", "position").alias("funding_source")).withColumns(
        {"first_funded_at": F.lit(None).cast("timestamp"), "funding_amount": F.lit(None).cast("string")})
    return intel.creator_profile(fx.f_launches, records).select("address", "launch_count", "label", "funding_source")


query("analyze_pool", f"""{_FULL} SELECT pool_address, buyer, share FROM (SELECT pool_address, insider_buyer_count + external_buyer_count AS buyer, round(insider_ratio, 6) AS share FROM intel WHERE pool_address = 's1')""")(
    lambda fx: _one_pool(fx, "s1"))


def _one_pool(fx: Fixtures, pool: str):
    """The same job for one chosen pool."""
    pools = priced_pools(fx).filter(F.col("pool_address") == pool)
    traders = intel.trader_activity(fx.f_swaps.filter(F.col("pool_address") == pool))
    done = attendees.analyse(pools, traders, fx.f_edges, fx.f_labels, PUBLIC_AT, [])
    return intel.pool_intel(done.classified, pools).select("pool_address", F.col("buyer_count").alias("buyer"), F.round("insider_ratio", 6).alias("share"))
