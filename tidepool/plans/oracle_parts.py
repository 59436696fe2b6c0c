"""SQL building blocks of the oracle: the same results stated as plain queries for DuckDB."""

from tidepool.plans.fixtures import duckdb_cte

PUBLIC_AT = 20

TRADERS = """traders AS (
 SELECT pool_address, trader, CAST(sum(quote_raw) AS BIGINT) AS quote_raw, count(*) AS trade_count, min(ts) AS first_trade_at,
  min(struct_pack(b := block_number, l := log_index)) AS seen FROM f_swaps GROUP BY pool_address, trader)"""

# Funding ball of every pool (creator, traders and all tagged bots, three hops) and its private part.
BALL = f"""deg AS (SELECT funder, count(DISTINCT wallet) AS wallets FROM f_edges GROUP BY funder),
bots AS (SELECT address FROM f_labels WHERE kind = 'rug-bot'),
core AS (SELECT pool_address, trader AS wallet FROM traders UNION SELECT pool_address, creator FROM f_pools
 UNION SELECT pool_address, address FROM f_pools CROSS JOIN bots),
e0 AS (SELECT c.pool_address, e.wallet, e.funder, e.position FROM core c JOIN f_edges e ON e.wallet = c.wallet),
h1 AS (SELECT DISTINCT pool_address, funder AS wallet FROM e0),
e1 AS (SELECT h.pool_address, e.wallet, e.funder, e.position FROM h1 h JOIN f_edges e ON e.wallet = h.wallet),
h2 AS (SELECT DISTINCT pool_address, funder AS wallet FROM e1),
e2 AS (SELECT h.pool_address, e.wallet, e.funder, e.position FROM h2 h JOIN f_edges e ON e.wallet = h.wallet),
ball AS (SELECT * FROM e0 UNION SELECT * FROM e1 UNION SELECT * FROM e2),
private AS (SELECT b.pool_address, b.wallet, b.funder, b.position FROM ball b JOIN f_pools p ON p.pool_address = b.pool_address JOIN deg d ON d.funder = b.funder
 WHERE b.funder = p.creator OR b.funder IN (SELECT address FROM bots) OR d.wallets < {PUBLIC_AT})"""

# One label per (pool, node), lowered until nothing changes.
ROOTS = """und AS MATERIALIZED (SELECT pool_address, wallet AS u, funder AS v FROM private UNION SELECT pool_address, funder, wallet FROM private),
closure(pool_address, node, label) USING KEY (pool_address, node) AS (SELECT DISTINCT pool_address, u, u FROM und
 UNION SELECT e.pool_address, e.v, min(c.label) FROM closure c JOIN und e ON e.pool_address = c.pool_address AND e.u = c.node
  JOIN recurring.closure k ON k.pool_address = e.pool_address AND k.node = e.v WHERE c.label < k.label GROUP BY e.pool_address, e.v),
labelled AS (SELECT pool_address, node, label AS root FROM closure),
roots AS (SELECT * FROM labelled UNION ALL SELECT c.pool_address, c.wallet, c.wallet FROM core c
 WHERE NOT EXISTS (SELECT 1 FROM labelled l WHERE l.pool_address = c.pool_address AND l.node = c.wallet))"""

CLASSIFIED = """rug_roots AS (SELECT DISTINCT r.pool_address, r.root FROM roots r JOIN bots b ON b.address = r.node),
creator_root AS (SELECT r.pool_address, r.root FROM roots r JOIN f_pools p ON p.pool_address = r.pool_address AND p.creator = r.node),
creator_funders AS (SELECT DISTINCT x.pool_address, x.funder FROM private x JOIN f_pools p ON p.pool_address = x.pool_address AND p.creator = x.wallet),
classified AS (SELECT t.*, p.creator, r.root,
 CASE WHEN t.trader = p.creator THEN 'creator'
  WHEN rr.root IS NOT NULL THEN 'rug-bot'
  WHEN EXISTS (SELECT 1 FROM f_edges e WHERE e.wallet = t.trader AND e.funder = p.creator) THEN 'creator-funded'
  WHEN EXISTS (SELECT 1 FROM private e JOIN creator_funders cf ON cf.pool_address = e.pool_address AND cf.funder = e.funder
    WHERE e.pool_address = t.pool_address AND e.wallet = t.trader) THEN 'same-funder'
  WHEN r.root = cr.root THEN 'linked' ELSE 'external' END AS classification,
 fs.funding_source, coalesce(fs.funder_count, 0) AS funder_count
 FROM traders t JOIN f_pools p ON p.pool_address = t.pool_address JOIN roots r ON r.pool_address = t.pool_address AND r.node = t.trader
 JOIN creator_root cr ON cr.pool_address = t.pool_address LEFT JOIN rug_roots rr ON rr.pool_address = r.pool_address AND rr.root = r.root
 LEFT JOIN (SELECT wallet, arg_min(funder, position) AS funding_source, count(*) AS funder_count FROM f_edges GROUP BY wallet) fs ON fs.wallet = t.trader)"""


def intel_cte(*parts: str) -> str:
    return ", ".join([duckdb_cte("f_swaps", "f_pools", "f_edges", "f_labels"), *parts])

# Greedy rings, one funder per recursion step and pool.
RINGS = """held AS (SELECT c.pool_address, x.funder, c.trader, c.quote_raw, c.seen, x.position FROM classified c JOIN private x ON x.pool_address = c.pool_address AND x.wallet = c.trader WHERE c.classification = 'external'),
grp AS (SELECT *, row_number() OVER (PARTITION BY pool_address ORDER BY size DESC, lead, funder) AS k FROM
 (SELECT pool_address, funder, count(*) AS size, list(trader) AS members, min((-quote_raw, seen.b, seen.l, trader, position)) AS lead FROM held GROUP BY pool_address, funder HAVING count(*) >= 3)),
greedy(pool_address, k, taken, fresh, ring_id, funder) AS (
 SELECT pool_address, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM f_pools UNION ALL
 SELECT pool_address, k, CASE WHEN len(f) >= 3 THEN list_concat(taken, f) ELSE taken END, CASE WHEN len(f) >= 3 THEN f ELSE CAST([] AS VARCHAR[]) END,
  ring_id + CASE WHEN len(f) >= 3 THEN 1 ELSE 0 END, funder FROM
  (SELECT g.pool_address, n.k, g.taken, g.ring_id, n.funder, list_filter(n.members, lambda x: NOT list_contains(g.taken, x)) AS f FROM greedy g JOIN grp n ON n.pool_address = g.pool_address AND n.k = g.k + 1)),
ring_rows AS (SELECT pool_address, ring_id, funder, fresh FROM greedy WHERE len(fresh) >= 3)"""
