"""Attendee intelligence: who traded, how they relate to the creator, how much volume is real.

Everything is keyed by pool and computed for all pools in one job. The tagged rug bots belong to
every pool's core, but their funding ball is the same everywhere: it is walked and reduced to
components once, and a pool only links its own wallets to those components.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidepool.functions.text import secs_after_launch
from tidepool.functions.words import exact_total, limbs_double, limbs_hex
from tidepool.operators import components
from tidepool.operators.components import connected_components
from tidepool.operators.funding import flag_public, funding_walk
from tidepool.operators.market import quote_sum, raw_to_units
from tidepool.runtime import number_rows, skew_join, stage, stage_table, top_k
from tidepool.schemas import (
    GRAPH_MAX_NODES,
    GRAPH_MAX_TRADERS,
    MAX_FUNDING_HOPS,
    MAX_REPORT_BUYERS,
    MIN_RING_SIZE,
    PUBLIC_FUNDER_SEEDS,
    PUBLIC_FUNDER_THRESHOLD,
)

POOL = "pool_address"
LOG_SPAN, LOG_SHIFT = Decimal(10**19), Decimal((1 << 62) + 1)  # log indexes a block can have, and what makes them positive
SMALL_LOG = 23  # bits of the log index where block and log share a BIGINT
NO_BLOCK = Decimal(-(1 << 63) - 1)  # below every BIGINT
RING_ROWS = 1 << 18  # (funder, trader) memberships that one task decides
# What a row says that meets its pool: a core wallet, a core wallet's edge, its first edge, a link to the bots' ball, one to a bot's component.
OWN, DIRECT, FIRST, LINK, BOT = 1, 2, 4, 8, 16
MEMBER = StructType([
    *[StructField(name, StringType()) for name in (POOL, "creator", "node", "root")],
    *[StructField(name, BooleanType()) for name in ("has_creator", "has_bot", "in_core")],
    StructField("funding_source", StringType()), StructField("funder_count", LongType()),
    *[StructField(name, BooleanType()) for name in ("paid", "same")],
])


def trader_activity(pool_swaps: DataFrame) -> DataFrame:
    """Per (pool, trader): exact raw quote volume, trades, first trade and first position in the log.

    All traders count as "buyers" downstream, sellers included. ``quote_key`` orders the volumes:
    the raw BIGINT, or fixed-width hex when amounts are 256-bit limbs.
    """
    limbs = "quote_limbs" in pool_swaps.columns
    small, wide = _log_place()
    rows = pool_swaps.groupBy(POOL, F.lower("trader").alias("trader")).agg(
        quote_sum(pool_swaps.columns).alias("_raw"),
        F.count("*").alias("trade_count"),
        F.min("ts").alias("first_trade_at"),
        F.min(small).alias("_small"),
        F.min(wide).alias("_wide"),
    )
    raw, (block, log) = F.col("_raw"), _of_place(F.col("_small"), F.col("_wide"))
    return rows.select(
        POOL, "trader",
        raw.alias("quote_raw"),
        (limbs_hex(raw) if limbs else raw).alias("quote_key"),
        (limbs_double(raw) if limbs else raw.cast("double")).alias("quote_total"),
        "trade_count", "first_trade_at",
        block.alias("first_block"), log.alias("first_log_index"),
    )


def _log_place() -> tuple[Column, Column]:
    """(block_number, log_index) as numbers that order like the pair, NULLs first: a BIGINT for ordinary logs, a decimal for others.

    The minimum of a struct is found by sorting all rows, that of a number by hashing. Blocks are any BIGINT, log
    indexes any of less than 2^62 either way.
    """
    block, log = F.col("block_number"), F.col("log_index")
    small = F.when(block.between(0, (1 << 40) - 1) & log.between(0, (1 << SMALL_LOG) - 1), F.shiftleft(block.cast("long"), SMALL_LOG) + log)
    return small, F.when(small.isNull(), _wide_place(block, log))


def _wide_place(block: Column, log: Column) -> Column:
    block = F.coalesce(block.cast("decimal(19,0)"), F.lit(NO_BLOCK))
    log = F.coalesce(log.cast("decimal(19,0)") + F.lit(LOG_SHIFT), F.lit(Decimal(0)))
    return (block * F.lit(LOG_SPAN) + log).cast("decimal(38,0)")


def _of_place(small: Column, wide: Column) -> tuple[Column, Column]:
    """block_number and log_index of the smaller of both ``_log_place`` numbers."""
    block, log = F.shiftright(small, SMALL_LOG), small.bitwiseAND(F.lit((1 << SMALL_LOG) - 1).cast("long"))
    place = F.least(wide, F.when(small.isNotNull(), _wide_place(block, log)))
    rest = F.pmod(place, F.lit(LOG_SPAN))
    wide_block = F.when(place >= F.lit((NO_BLOCK + 1) * LOG_SPAN), F.call_function("div", place - rest, F.lit(LOG_SPAN)))
    wide_log = F.when(rest != 0, (rest - F.lit(LOG_SHIFT)).cast("long"))
    return F.when(wide.isNull(), block).otherwise(wide_block), F.when(wide.isNull(), log).otherwise(wide_log)


def _buyer_order() -> list[Column]:
    return [F.desc("quote_key"), F.asc("first_block"), F.asc("first_log_index"), F.asc("trader")]


def rank_buyers(traders: DataFrame, n: int = MAX_REPORT_BUYERS) -> DataFrame:
    """Top ``n`` traders per pool by volume; ties go to whoever traded first."""
    return top_k(traders, [POOL], _buyer_order(), n, "rank")


@dataclass
class PoolGraph:
    """What the funding walk found: flagged edges per pool, component roots, and the bots' shared ball."""

    edges: DataFrame        # pool_address, creator, wallet, funder, position, is_public, hop, and maybe _funds
    members: DataFrame      # MEMBER columns: every wallet of the pool's graph
    bot_edges: DataFrame    # wallet, funder, position, is_public (creator exemption not applied)
    bots: DataFrame         # address

    def flags(self) -> DataFrame:
        """(pool, creator, node, root, has_creator, has_bot) of every member."""
        return self.members.select(POOL, "creator", "node", "root", "has_creator", "has_bot")


def _core(launches: DataFrame, traders: DataFrame) -> DataFrame:
    """Distinct (pool, creator, wallet) of creators and traders; traders are unique per pool already."""
    pools = launches.select(POOL, F.lower("creator").alias("creator"))
    trading = skew_join(traders.select(POOL, F.col("trader").alias("wallet")), pools, POOL)
    own = pools.select(POOL, "creator", F.col("creator").alias("wallet"))
    return trading.filter("wallet <> creator").select(POOL, "creator", "wallet").unionByName(own)


def _bot_ball(bots: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Funding edges around the tagged bots, and (node, root, has_bot) of their private components.

    ``root`` is the smallest address of the component.
    """
    start = bots.select(F.lit("bots").alias("ball"), F.col("address").alias("wallet"))
    ball = funding_walk(start, edges, ["ball"], hops).select("ball", "wallet", "funder", "position", "is_public")
    labels = connected_components(ball.filter(~F.col("is_public")), ["ball"]).drop("ball")
    alone = bots.select(F.col("address").alias("node")).join(labels, "node", "left_anti").withColumn("root", F.col("node"))
    nodes = labels.unionByName(alone)
    tagged = nodes.join(bots.select(F.col("address").alias("node")), "node", "left_semi").select("root").distinct()
    return ball.drop("ball"), stage(skew_join(nodes, tagged.withColumn("has_bot", F.lit(True)), "root", "left").select("node", "root", F.coalesce("has_bot", F.lit(False)).alias("has_bot")), "bot-roots")


def _bot_links(nodes: DataFrame, launches: DataFrame, ball: DataFrame, bot_roots: DataFrame) -> DataFrame:
    """(pool, wallet, funder, has_bot) links that stand for the bots' ball inside each pool.

    A pool wallet that is in the ball links to its component's smallest address. A creator that is a
    public funder is private in its own pools: there it also joins the components it funded, of which
    only those the pool touches, the smallest one and one holding a bot can matter.
    """
    links = skew_join(nodes, bot_roots.select(F.col("node").alias("wallet"), F.col("root").alias("funder"), "has_bot"), "wallet")
    opened = ball.filter("is_public").select(F.col("funder").alias("creator"), F.col("wallet").alias("node"))
    own_root = bot_roots.select("node", "root", "has_bot")
    # A funded wallet whose only edges are public has no component in the ball: it is its own root.
    pairs = stage(opened.join(own_root, "node", "left").select(
        "creator", F.coalesce("root", "node").alias("root"), F.coalesce("has_bot", F.lit(False)).alias("has_bot")
    ).distinct(), "bot-pairs")
    pools = launches.select(POOL, F.lower("creator").alias("creator"))
    bot_root = F.when(F.col("has_bot"), F.col("root"))
    anchors = pairs.groupBy("creator").agg(
        F.array_distinct(F.array_compact(F.array(F.min("root"), F.min(bot_root)))).alias("_anchors"), F.max("has_bot").alias("has_bot")
    )
    columns = [POOL, F.col("creator").alias("wallet"), "funder", "has_bot"]
    to_anchor = skew_join(pools, anchors, "creator").select(POOL, F.col("creator").alias("wallet"), F.explode("_anchors").alias("funder"), "has_bot")
    met = links.select(POOL, "creator", "funder").unionByName(nodes.select(POOL, "creator", F.col("wallet").alias("funder")))
    touched = skew_join(met, pairs.select("creator", F.col("root").alias("funder"), "has_bot"), ["creator", "funder"]).select(*columns)
    return links.select(POOL, "wallet", "funder", "has_bot").unionByName(to_anchor).unionByName(touched)


def build_pool_graph(
    launches: DataFrame, traders: DataFrame, edges: DataFrame, bots: DataFrame, hops: int = MAX_FUNDING_HOPS,
    threshold: int = PUBLIC_FUNDER_THRESHOLD, seeds: list[str] = PUBLIC_FUNDER_SEEDS, prune_public: bool = False,
) -> PoolGraph:
    """Funding balls and private components of every pool. ``edges``: wallet, funder, position, ..."""
    bots = bots.select(F.lower("address").alias("address")).distinct()
    flagged = stage(_with_first(flag_public(edges.select("wallet", "funder", "position"), bots, threshold, seeds)), "edges-flagged")
    core = stage(_core(launches, traders), "pool-core")
    walked = funding_walk(core, flagged, [POOL, "creator"], hops, prune_public, tied=True)
    own_creator = F.col("funder") == F.col("creator")
    walked = walked.withColumn("is_public", F.col("is_public") & ~own_creator)
    ball, bot_roots = _bot_ball(bots, flagged.drop("_first", "_funders"), hops)

    private = walked.filter(~F.col("is_public"))
    ends = private.select(POOL, "creator", "wallet").unionByName(private.select(POOL, "creator", F.col("funder").alias("wallet")))
    links = stage(_bot_links(ends.unionByName(core), launches, ball, bot_roots).distinct(), "bot-links")
    members = stage(_members(core, walked, links), "pool-members")
    return PoolGraph(walked.drop("_first", "_funders"), members, ball, bots)


def _with_first(edges: DataFrame) -> DataFrame:
    """Adds to a wallet's first edge (_first) how many it has (_funders), so that no pool has to count them again."""
    own = Window.partitionBy("wallet")
    first = F.row_number().over(own.orderBy(F.asc_nulls_last("position"), "funder")) == 1
    return edges.withColumns({"_first": first, "_funders": F.when(first, F.count(F.lit(1)).over(own)).otherwise(F.lit(0)).cast("long")})


def _members(core: DataFrame, walked: DataFrame, links: DataFrame) -> DataFrame:
    """Every wallet of every pool's private graph with its component and what its own funders say (``MEMBER`` columns).

    All of a pool's rows meet once. Pools of up to ``GROUP_EDGES`` rows are solved many at a time by one task each; larger
    ones go through joins.
    """
    counted = core.select(POOL).unionByName(walked.select(POOL)).groupBy(POOL).agg(F.count("*").alias("_n")).filter(F.col("_n") > components.GROUP_EDGES)
    large = stage_table(counted.filter(F.col(POOL).isNotNull()).drop("_n"), "pool-large", n=F.count(F.lit(1)))  # at most one per GROUP_EDGES rows
    if not large.metrics["n"]:
        return _members_by_pool(core, walked, links)
    listed = F.broadcast(large.df)
    small = _members_by_pool(*[part.join(listed, POOL, "left_anti") for part in (core, walked, links)])
    return small.unionByName(_members_by_joins(*[part.join(listed, POOL, "left_semi") for part in (core, walked, links)]))


def _members_by_pool(core: DataFrame, walked: DataFrame, links: DataFrame) -> DataFrame:
    none, nobody = F.lit(0).cast("long"), F.lit(None).cast("string")
    sourced = F.when(F.col("_first") & F.col("position").isNotNull(), FIRST).otherwise(0)
    direct = F.when(F.col("hop") == 0, F.lit(DIRECT) + sourced).otherwise(0)
    own = F.when(F.col("hop") == 0, F.col("_funders")).otherwise(none)
    rows = core.select(POOL, "creator", F.col("wallet").alias("_u"), nobody.alias("_v"), nobody.alias("_source"), none.alias("_funders"), F.lit(OWN).alias("_is"))
    private = walked.filter("NOT is_public").select(
        POOL, "creator", F.col("wallet").alias("_u"), F.col("funder").alias("_v"), nobody.alias("_source"), own.alias("_funders"), direct.alias("_is"))
    public = walked.filter("hop = 0 AND _first AND coalesce(is_public, TRUE)").select(
        POOL, "creator", F.col("wallet").alias("_u"), nobody.alias("_v"), F.col("funder").alias("_source"), F.col("_funders"), sourced.alias("_is"))
    linked = links.select(
        POOL, nobody.alias("creator"), F.col("wallet").alias("_u"), F.col("funder").alias("_v"), nobody.alias("_source"), none.alias("_funders"),
        F.when(F.col("has_bot"), LINK + BOT).otherwise(LINK).alias("_is"))
    rows = rows.unionByName(private).unionByName(public).unionByName(linked.filter("_v IS NOT NULL")).filter("_u IS NOT NULL")
    return components.solve_groups(rows, [POOL], _solved_members, MEMBER)


def _solved_members(table: pa.Table) -> pa.RecordBatch:
    """Members of whole pools that follow each other. The order of names is that of their ranks, so the smallest node is a number."""
    of_row, start = components.group_numbers(table, [POOL])
    names, order, (u, v, creator) = components.ranked_names(table.column("_u"), table.column("_v"), table.column("creator"))
    kind, rows, width = table.column("_is").to_numpy(), table.num_rows, len(names)
    paired = v >= 0
    keys = np.concatenate([of_row * width + u, of_row * width + np.where(paired, v, u)])
    nodes, index = np.unique(keys, return_inverse=True)
    at, to = index[:rows], index[rows:]
    root = components.smallest_reachable(len(nodes), at, to)

    def marked(where: np.ndarray) -> np.ndarray:
        found = np.zeros(len(nodes), bool)
        found[where] = True
        return found

    has_creator = marked(root[at[(kind & OWN > 0) & (u == creator)]])[root]
    has_bot = marked(root[at[kind & BOT > 0]])[root]
    direct = (kind & DIRECT > 0) & paired
    paid = marked(at[direct & (v == creator)])
    of_creator = marked(to[direct & (u == creator) & (v != creator)])
    same = marked(at[direct & of_creator[to]])
    funders = np.zeros(len(nodes), np.int64)
    np.add.at(funders, at, table.column("_funders").to_numpy())
    first = np.flatnonzero(kind & FIRST)
    source = np.full(len(nodes), -1)
    source[at[first]] = first

    def taken(values: pa.Array, rows: np.ndarray) -> pa.Array:
        return values.take(pa.array(rows, mask=rows < 0))

    # A pool of several creators has a member for each.
    inside = kind & LINK == 0
    by = creator + 1
    seen = np.unique(np.concatenate([at[inside], to[inside]]) * (width + 1) + np.concatenate([by[inside], by[inside]]))
    own = np.zeros(len(seen), bool)
    core = kind & OWN > 0
    own[np.searchsorted(seen, at[core] * (width + 1) + by[core])] = True
    node, by = seen // (width + 1), seen % (width + 1) - 1
    spelled = names.take(pa.array(order[nodes % width]))
    of_source = pc.coalesce(table.column("_source"), table.column("_v")).combine_chunks()
    pools = table.column(POOL).combine_chunks().take(pa.array(start[nodes[node] // width]))
    creators = taken(names, np.where(by < 0, -1, order[by]))
    return pa.RecordBatch.from_arrays(
        [pools, creators, spelled.take(pa.array(node)), spelled.take(pa.array(root[node])), *[pa.array(x[node]) for x in (has_creator, has_bot)],
         pa.array(own), taken(of_source, source[node]), *[pa.array(x[node]) for x in (funders, paid, same)]], names=MEMBER.names)


def _members_by_joins(core: DataFrame, walked: DataFrame, links: DataFrame) -> DataFrame:
    private = walked.filter(~F.col("is_public"))
    ends = private.select(POOL, "creator", "wallet").unionByName(private.select(POOL, "creator", F.col("funder").alias("wallet")))
    nodes = stage(ends.unionByName(core).distinct(), "pool-nodes")
    roots = connected_components(private.select(POOL, "wallet", "funder").unionByName(links.drop("has_bot")), [POOL])
    # Pool wallets outside every private edge are their own component.
    members = nodes.withColumnRenamed("wallet", "node").join(roots, [POOL, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    members = stage(members, "pool-rooted")
    creator_root = members.filter("node = creator").select(POOL, "root", F.lit(True).alias("has_creator"), F.lit(False).alias("has_bot"))
    near_bots = links.filter("has_bot").select(POOL, F.col("wallet").alias("node")).distinct()
    bot_root = members.join(near_bots, [POOL, "node"], "left_semi").select(POOL, "root", F.lit(False).alias("has_creator"), F.lit(True).alias("has_bot"))
    marks = creator_root.unionByName(bot_root).groupBy(POOL, "root").agg(F.max("has_creator").alias("has_creator"), F.max("has_bot").alias("has_bot"))
    flags = skew_join(members, stage(marks, "pool-marks"), [POOL, "root"], "left")

    direct = walked.filter("hop = 0")
    creator_side = direct.filter("wallet = creator AND NOT is_public AND funder <> creator").select(POOL, "funder", F.lit(True).alias("_of_creator")).distinct()
    facts = skew_join(direct, creator_side, [POOL, "funder"], "left").groupBy(POOL, F.col("wallet").alias("node")).agg(
        F.min_by("funder", "position").alias("funding_source"),
        F.count("*").alias("funder_count"),
        F.max(F.col("funder") == F.col("creator")).alias("paid"),
        F.max("_of_creator").alias("same"),
    )
    own = core.select(POOL, "creator", F.col("wallet").alias("node"), F.lit(True).alias("in_core")).distinct()
    rows = flags.join(own, [POOL, "creator", "node"], "left").join(facts, [POOL, "node"], "left").fillna(False, ["has_creator", "has_bot", "in_core", "paid", "same"])
    return rows.fillna(0, ["funder_count"]).select(*MEMBER.names)


def classify_attendees(traders: DataFrame, graph: PoolGraph) -> DataFrame:
    """Traders with ``classification``: the first rule that holds of creator, rug-bot, creator-funded,
    same-funder, linked, external.

    A shared funder only matters when it is private; the creator as a funder is covered by the
    creator-funded rule.
    """
    core = graph.members.filter("in_core").drop("in_core").withColumnRenamed("node", "trader")
    rows = traders.join(core, [POOL, "trader"])
    kind = (
        F.when(F.col("trader") == F.col("creator"), "creator")
        .when(F.col("has_bot"), "rug-bot")
        .when(F.col("paid"), "creator-funded")
        .when(F.col("same"), "same-funder")
        .when(F.col("has_creator"), "linked")
        .otherwise("external")
    )
    return rows.withColumn("classification", kind).drop("has_creator", "has_bot", "same", "paid")


def analysis_complete(launches: DataFrame, traders: DataFrame, bots: DataFrame, funded: DataFrame) -> DataFrame:
    """(pool, complete): creator, every trader and every tagged bot have a funding record.

    ``funded`` lists the recorded wallets (column address). The bots are checked once for all pools.
    """
    have = funded.select(F.col("address").alias("wallet"), F.lit(1).alias("_have"))
    core = skew_join(_core(launches, traders), have, "wallet", "left")
    missing_bots = bots.select(F.lower("address").alias("wallet")).join(have, "wallet", "left_anti").count()
    return core.groupBy(POOL).agg((F.count("*") == F.count("_have")).alias("_core")).select(POOL, (F.col("_core") & F.lit(missing_bots == 0)).alias("complete"))


def insider_cluster(classified: DataFrame) -> DataFrame:
    """Cluster 0 is every trader that is not external."""
    return classified.withColumn("cluster_id", F.when(F.col("classification") != "external", F.lit(0).cast("long")))


def coordinated_rings(classified: DataFrame, edges: DataFrame, min_size: int = MIN_RING_SIZE) -> DataFrame:
    """(pool, ring_id, funder, trader): external traders tied together by a shared private funder.

    The rule is greedy: funders in order of total group size (ties: whoever's first trader ranks
    higher, then funder position) take the traders no earlier ring has; fewer than ``min_size`` fresh
    traders make no ring. Pools of up to ``RING_ROWS`` memberships are decided in one task each. Of larger
    ones, first the components of funders and traders are found and decided in one task each. What is
    left are components beyond that, decided in rounds: a funder may decide as soon as it is the first
    undecided funder of all its fresh traders, and one whose fresh traders fell below ``min_size`` can be
    struck off at any time, because they only ever get fewer.

    ``edges``: the pools' flagged edges (``PoolGraph.edges``).
    """
    outside = classified.filter("classification = 'external'").select(POOL, "trader", "quote_key", "first_block", "first_log_index")
    held = edges.filter("hop = 0 AND NOT is_public").select(POOL, F.col("wallet").alias("trader"), "funder", "position")
    # Most funders have too few traders of any class: they go before the traders' volumes are looked up.
    crowded = stage(held.groupBy(POOL, "funder").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size).drop("_n"), "ring-funders")
    members = outside.join(stage(held.join(crowded, [POOL, "funder"], "left_semi"), "ring-held"), [POOL, "trader"])
    lead = F.struct(
        _descending(classified, F.col("quote_key")).alias("volume"), "first_block", "first_log_index", "trader", "position"
    )
    groups = members.groupBy(POOL, "funder").agg(F.count("*").alias("size"), F.min(lead).alias("lead")).filter(F.col("size") >= min_size)
    order = ["_size", "_volume", "_block", "_log", "_trader", "_position", "funder"]
    groups = groups.select(
        POOL, "funder",
        (-F.col("size")).alias("_size"),
        F.col("lead.volume").alias("_volume"),
        F.col("lead.first_block").alias("_block"), F.col("lead.first_log_index").alias("_log"),
        F.col("lead.trader").alias("_trader"), F.col("lead.position").alias("_position"),
    )
    wanted = stage_table(members.select(POOL, "trader", "funder").join(groups, [POOL, "funder"]), "ring-members", rows=F.count(F.lit(1)))
    rows = wanted.df
    if (wanted.metrics["rows"] or 0) > RING_ROWS:
        rows, rest = _split(rows, [POOL])
        if rest is not None:
            # Funders and traders that no chain of shared members connects decide independently.
            linked = connected_components(rest.select(POOL, F.concat(F.lit("f"), "funder").alias("u"), F.concat(F.lit("t"), "trader").alias("v")), [POOL], "u", "v")
            roots = linked.filter("substr(node, 1, 1) = 't'").select(POOL, F.substring("node", 2, 1 << 30).alias("trader"), "root")
            parts = stage(skew_join(rest, roots, [POOL, "trader"]), "ring-parts")
            medium, large = _split(parts, [POOL, "root"])
            solved = _greedy_rings(rows, [POOL], order, min_size).unionByName(_greedy_rings(medium, [POOL, "root"], order, min_size))
            rings = solved if large is None else solved.unionByName(_rings_by_rounds(large.drop("root"), order, min_size))
        else:
            rings = _greedy_rings(rows, [POOL], order, min_size)
    else:
        rings = _greedy_rings(rows, [POOL], order, min_size)
    rings = stage(rings, "rings")
    heads = number_rows(rings.select(POOL, *order).distinct(), [POOL], order, "ring_id").select(POOL, "funder", "ring_id")
    return rings.join(heads, [POOL, "funder"]).select(POOL, "ring_id", "funder", "trader")


def _split(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most ``RING_ROWS`` rows, and the others (None if there are none)."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > RING_ROWS).drop("_n")
    large = stage_table(counted, "ring-large", n=F.count(F.lit(1)))  # at most one per RING_ROWS rows
    if not large.metrics["n"]:
        return rows, None
    return rows.join(F.broadcast(large.df), keys, "left_anti"), rows.join(F.broadcast(large.df), keys, "left_semi")


def _greedy_rings(rows: DataFrame, keys: list[str], order: list[str], min_size: int) -> DataFrame:
    """The rule as it is stated, group by group: rows of the funders' fresh traders."""
    columns = [POOL, "funder", "trader", *[c for c in order if c != "funder"]]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(order, kind="stable")
        taken: set[str] = set()
        keep = []
        for _, own in ordered.groupby("funder", sort=False):
            fresh = ~own["trader"].isin(taken) if taken else np.ones(len(own), bool)
            if fresh.sum() >= min_size:
                keep.append(own[fresh])
                taken.update(own["trader"][fresh])
        return pd.concat(keep)[columns] if keep else group.iloc[:0][columns]

    return rows.select(*{*keys, *columns}).groupBy(*keys).applyInPandas(solve, rows.select(*columns).schema)


def _rings_by_rounds(rows: DataFrame, order: list[str], min_size: int) -> DataFrame:
    """The same for components too large for a task: each round decides every funder that nothing before it can affect."""
    open_rows = stage_table(rows, "ring-members")
    taken = []
    while not open_rows.df.isEmpty():
        current = open_rows.df
        key = F.struct(*[F.col(c) for c in order])
        first = current.groupBy(POOL, "trader").agg(F.min(key).alias("_first"))
        told = current.join(first, [POOL, "trader"]).withColumn("_leads", F.col("_first.funder") == F.col("funder"))
        state = told.groupBy(POOL, "funder").agg(F.count("*").alias("_fresh"), F.min("_leads").alias("_ready")).filter(F.col("_fresh") >= min_size)
        decided = stage_table(current.join(state.select(POOL, "funder", "_ready"), [POOL, "funder"]), "ring-round")
        rings = stage(decided.df.filter("_ready").drop("_ready"), "rings")
        taken.append(rings)
        rest = decided.df.filter("NOT _ready").drop("_ready").join(rings.select(POOL, "trader"), [POOL, "trader"], "left_anti")
        following = stage_table(rest, "ring-members")
        open_rows.drop()
        decided.drop()
        open_rows = following
    found = open_rows.df
    for more in taken:
        found = found.unionByName(more)
    return found.select(POOL, "funder", "trader", *[c for c in order if c != "funder"])


def _descending(df: DataFrame, key: Column) -> Column:
    """A key that sorts ascending like ``key`` sorts descending (BIGINT, or fixed-width hex)."""
    if dict(df.dtypes)["quote_key"] == "string":
        return F.translate(key, "0123456789abcdef", "fedcba9876543210")
    return -key


def assign_clusters(classified: DataFrame, rings: DataFrame) -> DataFrame:
    """Every trader with cluster_id: 0 for insiders, the ring id for ring members, NULL otherwise."""
    ringed = insider_cluster(classified).join(rings.select(POOL, "trader", "ring_id"), [POOL, "trader"], "left")
    return ringed.withColumn("cluster_id", F.coalesce("cluster_id", "ring_id")).drop("ring_id")


def cluster_rollup(clustered: DataFrame, rings: DataFrame | None = None, creator_source: DataFrame | None = None) -> DataFrame:
    """Per (pool, cluster): kind, members, raw volume and, when the inputs are given, the funding source."""
    rows = clustered.filter("cluster_id IS NOT NULL").groupBy(POOL, "cluster_id").agg(
        F.count("*").alias("member_count"), exact_total(clustered, "quote_raw").alias("quote_total")
    ).withColumn("kind", F.when(F.col("cluster_id") == 0, "creator-insider").otherwise("coordinated"))
    if rings is not None:
        heads = rings.select(POOL, F.col("ring_id").alias("cluster_id"), F.col("funder").alias("_ring_source")).distinct()
        rows = rows.join(heads, [POOL, "cluster_id"], "left")
        source = F.col("_ring_source")
        if creator_source is not None:
            rows = skew_join(rows, creator_source.select(POOL, "creator_funding_source"), POOL, "left")
            source = F.when(F.col("cluster_id") == 0, F.col("creator_funding_source")).otherwise(source)
        rows = rows.withColumn("funding_source", source).drop("_ring_source", "creator_funding_source")
    return rows


def pool_intel(classified: DataFrame, launches: DataFrame, logs_seen: DataFrame | None = None) -> DataFrame:
    """Per pool: raw totals, insider ratio and counts, and external/insider volume in USD.

    ``launches``: pool_address, volume_usd (stored total, may be NULL), quote_decimals, price_usd. The
    split is anchored to the stored total when positive, otherwise to the measured one. Raw amounts are
    summed exactly before anything is rounded. ``logs_seen`` (pool_address, analyzed_trades) counts the
    logs looked at, undecodable ones too; without it the traders' trades are counted.
    """
    insider = F.col("classification") != "external"
    sums = classified.groupBy(POOL).agg(
        exact_total(classified, "quote_raw").alias("total_quote"),
        exact_total(classified, "quote_raw", insider).alias("insider_quote"),
        F.count(F.when(insider, 1)).alias("insider_buyer_count"),
        F.count(F.when(~insider, 1)).alias("external_buyer_count"),
        F.sum("trade_count").alias("analyzed_trades"),
    )
    if logs_seen is not None:
        sums = sums.drop("analyzed_trades").join(logs_seen, POOL, "full_outer")
    joined = launches.select(POOL, "volume_usd", "quote_decimals", "price_usd").join(sums, POOL, "left").fillna(
        0, ["total_quote", "insider_quote", "insider_buyer_count", "external_buyer_count", "analyzed_trades"]
    )
    ratio = F.when(F.col("total_quote") > 0, F.col("insider_quote") / F.col("total_quote")).otherwise(F.lit(0.0))
    measured = raw_to_units(F.col("total_quote"), F.col("quote_decimals"), False) * F.col("price_usd")
    total = F.when(F.col("volume_usd") > 0, F.col("volume_usd")).otherwise(measured)
    return joined.withColumn("insider_ratio", ratio).withColumn("total_volume_usd", total).select(
        POOL, "analyzed_trades", "insider_buyer_count", "external_buyer_count",
        (F.col("insider_buyer_count") + F.col("external_buyer_count")).alias("buyer_count"),
        "insider_ratio", "total_volume_usd",
        (F.col("total_volume_usd") * (1 - F.col("insider_ratio"))).alias("external_volume_usd"),
        (F.col("total_volume_usd") * F.col("insider_ratio")).alias("insider_volume_usd"),
    )


def buyer_rows(clustered: DataFrame, launches: DataFrame, n: int = MAX_REPORT_BUYERS) -> DataFrame:
    """The report's top ``n`` buyers per pool. ``launches``: pool_address, created_at, quote_decimals, price_usd."""
    top = rank_buyers(clustered, n)
    dim = launches.select(POOL, F.col("created_at").alias("_launched"), "quote_decimals", "price_usd")
    usd = raw_to_units(F.col("quote_total"), F.col("quote_decimals"), False) * F.col("price_usd")
    return top.join(dim, POOL).select(
        POOL, F.col("rank").cast("long").alias("rank"), F.col("trader").alias("address"), "classification", "funding_source", "funder_count", "cluster_id",
        "trade_count", usd.alias("volume_usd"), "first_trade_at",
        secs_after_launch(F.col("first_trade_at"), F.col("_launched")).alias("seconds_after_launch"),
    )


def attendee_graph(clustered: DataFrame, launches: DataFrame, graph: PoolGraph, max_traders: int = GRAPH_MAX_TRADERS, max_nodes: int = GRAPH_MAX_NODES, hops: int = MAX_FUNDING_HOPS) -> tuple[DataFrame, DataFrame]:
    """Display graph per pool: (nodes, edges).

    Starts from the creator and the top traders and adds their private funders hop by hop, in order of
    the wallet that brings them in and the funder's position, up to ``max_nodes``. Every step holds at
    most max_nodes x 12 rows per pool.
    """
    creators = launches.select(POOL, F.lower("creator").alias("address"), F.lit(0).cast("long").alias("place"))
    top = rank_buyers(clustered, max_traders).select(POOL, F.col("trader").alias("address"), F.col("rank").cast("long").alias("place"))
    start = top.join(creators.select(POOL, "address"), [POOL, "address"], "left_anti").unionByName(creators)
    included = stage(start, "graph-start")
    private = graph.edges.filter("NOT is_public")
    columns = [POOL, F.col("wallet").alias("address"), "funder", "position"]
    # Only the start is not reached as somebody's funder.
    of_start, of_funders = private.select(*columns), (private.filter("_funds") if "_funds" in private.columns else private).select(*columns)
    ball_private = graph.bot_edges.select("wallet", "funder", "position", "is_public")
    pools = launches.select(POOL, F.lower("creator").alias("creator"))

    def funders(of: DataFrame, edges: DataFrame) -> DataFrame:
        """Private funders of graph nodes: from the pool's own walk and from the bots' ball (some may come twice)."""
        own = of.join(edges, [POOL, "address"])
        ball = skew_join(of, ball_private.withColumnRenamed("wallet", "address"), "address").join(pools, POOL).filter(
            "NOT is_public OR funder = creator"
        ).drop("is_public", "creator")
        return own.unionByName(ball)

    newest, met, edges = included, [], of_start
    for _ in range(hops):
        met.append(stage(funders(newest, edges), "graph-met"))
        edges = of_funders
        found = met[-1].groupBy(POOL, F.col("funder").alias("address")).agg(F.min(F.struct("place", "position")).alias("_by"))
        found = found.join(included.select(POOL, "address"), [POOL, "address"], "left_anti")
        room = included.groupBy(POOL).agg(F.count("*").alias("_size"), F.max("place").alias("_last"))
        ranked = top_k(found, [POOL], [F.col("_by"), F.col("address")], max_nodes, "_rn").join(room, POOL)
        newest = stage(ranked.filter(F.col("_rn") + F.col("_size") <= max_nodes).select(POOL, "address", (F.col("_last") + F.col("_rn")).alias("place")), "graph-hop")
        included = included.unionByName(newest)
    # Every node's funders have been looked up by the hop it led to, but for the last ones'.
    drawn = reduce(DataFrame.unionByName, [*met, funders(newest, edges)]).join(included.select(POOL, F.col("address").alias("funder")), [POOL, "funder"], "left_semi")
    edge_rows = drawn.select(POOL, F.col("address").alias("from_address"), F.col("funder").alias("to_address")).distinct()

    buyers = clustered.select(POOL, F.col("trader").alias("address"), "classification", "cluster_id", "quote_total")
    flags = graph.flags().drop("creator").withColumnRenamed("node", "address")
    bots = graph.bots.withColumn("_bot", F.lit(True))
    known = included.join(buyers, [POOL, "address"], "left").join(flags, [POOL, "address"], "left").join(pools, POOL)
    known = skew_join(known, bots, "address", "left")
    is_creator = F.col("address") == F.col("creator")
    role = (
        F.when(is_creator, "creator")
        .when(F.col("_bot"), "rug")
        .when(F.col("classification") == "rug-bot", "rug")
        .when(F.col("classification") == "external", F.when(F.col("cluster_id").isNotNull(), "coordinated").otherwise("external"))
        .when(F.col("classification").isNotNull(), "insider")
        .when(F.col("has_creator") | F.col("has_bot"), "insider")
        .otherwise("funder")
    )
    cluster = F.when(is_creator, F.lit(0).cast("long")).when(F.col("_bot"), F.lit(None)).otherwise(F.col("cluster_id"))
    return known.select(POOL, "address", role.alias("role"), cluster.alias("cluster_id"), "quote_total", "place"), edge_rows


@dataclass
class AttendeeReport:
    """Flat parts of the report; ``summary`` has one row per pool."""

    summary: DataFrame
    buyers: DataFrame
    clusters: DataFrame
    nodes: DataFrame
    edges: DataFrame


def attendee_report(launches: DataFrame, intel: DataFrame, creator_source: DataFrame, complete: DataFrame, as_of: Column) -> DataFrame:
    """Report scalars per pool."""
    base = launches.select(POOL, "dex", F.lower("creator").alias("creator"))
    return base.join(intel, POOL).join(creator_source.select(POOL, "creator_funding_source"), POOL, "left").join(complete, POOL, "left").select(
        POOL, "dex", "creator", "creator_funding_source", F.lit(True).alias("analyzed"),
        F.coalesce("complete", F.lit(False)).alias("complete"), "analyzed_trades", "buyer_count", "insider_buyer_count",
        "external_buyer_count", "total_volume_usd", "external_volume_usd", "insider_volume_usd", "insider_ratio", as_of.alias("updated_at"),
    )


def nest_report(summary: DataFrame, buyers: DataFrame) -> DataFrame:
    """Report rows with their (at most 100) buyers nested in rank order."""
    fields = [c for c in buyers.columns if c != POOL]
    nested = buyers.groupBy(POOL).agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in fields if c != "rank"]))).alias("buyers"))
    return summary.join(nested, POOL, "left")


def attendee_report_or_stub(launches: DataFrame, reports: DataFrame) -> DataFrame:
    """The stored report of every launch, or the row of one that is not analysed yet."""
    base = launches.select(POOL, F.col("dex").alias("_dex"), F.lower("creator").alias("_creator"))
    counts = ["analyzed_trades", "buyer_count", "insider_buyer_count", "external_buyer_count"]
    joined = base.join(reports, POOL, "left")
    return joined.withColumns({
        "dex": F.coalesce("dex", "_dex"),
        "creator": F.coalesce("creator", "_creator"),
        "analyzed": F.coalesce("analyzed", F.lit(False)),
        "complete": F.coalesce("complete", F.lit(False)),
        **{c: F.coalesce(c, F.lit(0)) for c in counts},
    }).select(*reports.columns)


def creator_profile(launches: DataFrame, funding: DataFrame) -> DataFrame:
    """Per creator: launches, first funding and the repeat label.

    The launches themselves stay a table (``launches_by_creator``): a creator may own any number.
    """
    rollup = launches.groupBy(F.lower("creator").alias("address")).agg(F.count("*").alias("launch_count"))
    dim = funding.select("address", "first_funded_at", "funding_source", "funding_amount")
    label = F.when(F.col("launch_count") > 1, "repeat creator").otherwise("first observed launch")
    return rollup.join(dim, "address", "left").withColumn("label", label)
