"""Address research: a bounded two-way walk of the funding graph around any number of seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.components import connected_components, ranked_names
from tidepool.operators.funding import flag_public, unseen_nodes
from tidepool.runtime import skew_join, stage, stage_table, top_k
from tidepool.schemas import (
    PUBLIC_FUNDER_SEEDS,
    PUBLIC_FUNDER_THRESHOLD,
    RESEARCH_GRAPH_MAX_NODES,
    RESEARCH_HOPS,
    RESEARCH_MAX_CONNECTIONS,
)

UP, DOWN = "funder", "funded"
# Frontier rows whose seeds meet in one task, edges that may meet them there, and rows of an answer's batch.
BLOCK_ROWS, SLICE_EDGES, ANSWER_ROWS = 1 << 13, 1 << 20, 1 << 16
REACHED = "seed string, address string, direction string, hops long, via string, tx_hash string"


@dataclass
class Walk:
    nodes: DataFrame     # seed, address, direction, hops, via, tx_hash (the seed itself included)
    found: DataFrame     # seed, child, funder, ...: every edge end met, as often as it was met
    complete: DataFrame  # seed, complete

    @cached_property
    def edges(self) -> DataFrame:
        """seed, child, funder; written when first asked for, because it may be as large as the nodes."""
        return stage(self.found.select("seed", "child", "funder").distinct(), "research-edges")


def _meet(frontier: DataFrame, edges: DataFrame, back: DataFrame) -> DataFrame:
    """Neighbours of the frontier in both directions, one row per edge end.

    Looking up, a wallet has a bounded number of funders and the frontier is the big side. Looking
    down, a public funder may have funded a third of all wallets and the edge table is the big side.
    """
    up = skew_join(frontier.withColumnRenamed("address", "child"), edges.withColumnRenamed("wallet", "child"), "child")
    up = up.select("seed", F.col("funder").alias("address"), F.lit(UP).alias("step"), "child", "funder", "via", "tx_hash", "position", F.col("child").alias("parent"))
    down = skew_join(back.withColumnRenamed("wallet", "child"), frontier.withColumnRenamed("address", "funder"), "funder", sliced=True)
    down = down.select("seed", F.col("child").alias("address"), F.lit(DOWN).alias("step"), "child", "funder", "via", "tx_hash", "position", F.col("funder").alias("parent"))
    return up.unionByName(down)


def research_walk(seeds: DataFrame, edges: DataFrame, hops: int = RESEARCH_HOPS, outflows: DataFrame | None = None, strict_both: bool = False, written: bool = True) -> Walk:
    """Walks ``hops`` steps from every seed through funders and funded wallets, public ones included.

    A wallet's direction is that of the steps that reached it, over all hops ("both" if they differ, so
    also when a funder lists the wallet it funded); hops and the via/tx of the connection come from
    its first discovery, funders before funded wallets, then by parent address and funder position.
    ``strict_both`` instead calls a wallet "both" only if purely-up and purely-down paths reach it.

    ``edges``: wallet, funder, via, tx_hash, position. ``outflows`` (funding_outflows) adds recipients
    whose own funder list was cut before it reached the sender.

    The last hop meets by far the most edge ends. ``written`` keeps them and the nodes as tables, for callers that read
    both; without, neither is written or shuffled, and the nodes are made when they are read (``_reached_by_blocks``).
    """
    columns = ["wallet", "funder", "via", "tx_hash", "position"]
    base = edges.select(*columns)
    if not written:
        base = stage(base, "research-up")
    back = base
    if outflows is not None:
        extra = outflows.select("wallet", "funder", "via", F.col("hash").alias("tx_hash"), "position")
        back = base.unionByName(extra.join(base, ["wallet", "funder"], "left_anti"))
        if not written:
            back = stage(back, "research-down")
    frontier = stage(seeds.select(F.lower("seed").alias("seed")).distinct().withColumn("address", F.col("seed")), "research-seeds")
    all_seeds = frontier.select("seed")
    visited, met = [frontier], []
    for hop in range(hops):
        step = _meet(frontier, base, back).withColumn("hops", F.lit(hop + 1).cast("long"))
        if written or hop + 1 < hops:
            step = stage(step, "research-step")
        met.append(step)
        seen = reduce(DataFrame.unionByName, visited)
        frontier = unseen_nodes(step, seen, ["seed", "address"])
        if hop + 1 < hops:  # what lies beyond the last hop only tells which walks are complete
            frontier = stage(frontier, "research-frontier")
        visited.append(frontier)
    found = reduce(DataFrame.unionByName, met)
    if written or not met:
        reached = _reached(found)
        direction = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.lit("both"))
        nodes = reached.select("seed", "address", direction.alias("direction"), "hops", F.col("_first.via").alias("via"), F.col("_first.tx_hash").alias("tx_hash"))
    else:
        earlier = _reached(reduce(DataFrame.unionByName, met[:-1])) if hops > 1 else None
        nodes = _reached_by_blocks(visited[-2], base, back, earlier, hops)
    if strict_both:
        nodes = _strict_direction(nodes, found)
    own = all_seeds.select("seed", F.col("seed").alias("address"), F.lit("seed").alias("direction"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("tx_hash"))
    unfinished = visited[-1].select("seed").distinct().withColumn("_open", F.lit(True))
    complete = all_seeds.join(unfinished, "seed", "left").select("seed", F.col("_open").isNull().alias("complete"))
    nodes = nodes.unionByName(own)
    return Walk(stage(nodes, "research-nodes") if written else nodes, found, complete)


def _reached(found: DataFrame) -> DataFrame:
    """Per (seed, address): the first hop, the steps that reached it (_low to _high) and the connection of the first (_first)."""
    first = F.struct(F.col("hops"), (F.col("step") == DOWN).alias("late"), F.col("parent"), F.col("position"), F.col("child"))
    return found.filter("address <> seed").groupBy("seed", "address").agg(
        F.min("hops").alias("hops"),
        F.min("step").alias("_low"), F.max("step").alias("_high"),
        F.min_by(F.struct("via", "tx_hash"), first).alias("_first"),
    )


def _reached_by_blocks(frontier: DataFrame, up: DataFrame, down: DataFrame, earlier: DataFrame | None, hop: int) -> DataFrame:
    """What ``hop`` reaches from ``frontier`` together with what was reached ``earlier``, without a row per edge end.

    Seeds are dealt into blocks and addresses into slices. A block's seeds share the edges of their frontiers: an edge goes
    once to the cell of a block and its address's slice, not once to every seed, and all ends of a seed's edges to one
    address meet in one cell. So what is shuffled is never more than the edge ends, and mostly very much less.
    """
    held = stage_table(frontier.filter("address IS NOT NULL"), "research-last", rows=F.count(F.lit(1)))
    blocks = max(1, -(-(held.metrics["rows"] or 0) // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("seed"), F.lit(blocks))
    front = held.df.select(block.alias("_block"), F.col("address").alias("_at"), "seed")
    wanted = stage(front.select("_block", "_at").distinct(), "research-wanted")
    sides = []
    for edges, at, other, bit in ((up, "wallet", "funder", 1), (down, "funder", "wallet", 2)):
        ends = edges.select(F.col(at).alias("_at"), F.col(other).alias("address"), F.lit(bit).alias("step"), F.col("position").cast("long").alias("position"), "via", "tx_hash")
        sides.append(skew_join(ends.filter("address IS NOT NULL"), wanted, "_at", sliced=True))
    counted = up.count() + down.count()
    slices = max(1, -(-counted // SLICE_EDGES))
    cell = lambda seeds, address: (seeds * slices + F.pmod(F.xxhash64(address), F.lit(slices))).cast("int").alias("cell")
    none = lambda kind: F.lit(None).cast(kind)
    rows = sides[0].unionByName(sides[1]).select(
        cell(F.col("_block"), "address"), F.lit(0).alias("kind"), F.col("_at").alias("a"), F.col("address").alias("b"), "step", "position", "via", "tx_hash", none("long").alias("hops"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    rows = rows.unionByName(front.select("*", every.alias("_slice")).select(
        (F.col("_block") * slices + F.col("_slice")).cast("int").alias("cell"), F.lit(1).alias("kind"), F.col("seed").alias("a"), F.col("_at").alias("b"),
        F.lit(0).alias("step"), none("long").alias("position"), none("string").alias("via"), none("string").alias("tx_hash"), none("long").alias("hops")))
    if earlier is not None:
        steps = F.when(F.col("_low") != F.col("_high"), 3).when(F.col("_low") == UP, 1).otherwise(2)
        rows = rows.unionByName(earlier.select(
            cell(block, "address"), F.lit(2).alias("kind"), F.col("seed").alias("a"), F.col("address").alias("b"), steps.alias("step"), none("long").alias("position"),
            F.col("_first.via").alias("via"), F.col("_first.tx_hash").alias("tx_hash"), "hops"))
    dealt = rows.repartitionById(blocks * slices, F.col("cell")).sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(_by_cell(hop), REACHED)


def _by_cell(hop: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)] if len(cells) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column("cell")[0].as_py() != cells[lo]:
                    yield from _cell_reached(pa.Table.from_batches(held), hop)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _cell_reached(pa.Table.from_batches(held), hop)

    return run


def _cell_reached(table: pa.Table, hop: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``REACHED`` for the seeds of one cell, from its edges (kind 0), frontier (1) and what was reached earlier (2)."""
    names, order, (a, b) = ranked_names(table.column("a"), table.column("b"))
    spelled = names.take(pa.array(order))  # by rank
    kind, step = table.column("kind").to_numpy(), table.column("step").to_numpy()
    position, known = table.column("position").fill_null(0).to_numpy(), np.array(table.column("position").is_valid())
    edges = np.flatnonzero(kind == 0)
    # Funders before funded wallets, then by parent and position: of a seed's ends to an address the first in this order counts.
    edges = edges[np.lexsort((position[edges], known[edges], a[edges], step[edges]))]
    rising = int(np.searchsorted(step[edges], 2))
    target, key = b[edges], step[edges].astype(np.int64) * (len(names) + 1) + a[edges]
    front, before = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
    front, before = front[np.lexsort((b[front], a[front]))], before[np.argsort(a[before], kind="stable")]
    starts = [np.searchsorted(key, bit * (len(names) + 1) + b[front], side) for bit in (1, 2) for side in ("left", "right")]
    hops, rows = table.column("hops").fill_null(hop).to_numpy(), np.append(edges, before)
    texts = [table.column(c).combine_chunks() for c in ("via", "tx_hash")]
    directions = pa.array([None, UP, DOWN, "both"])
    bits, row = np.zeros(len(names), np.uint8), np.zeros(len(names), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def answer() -> pa.RecordBatch:
        seed, address, steps, at = (np.concatenate(p) for p in zip(*out, strict=True))
        source = pa.array(rows[at])
        columns = [spelled.take(pa.array(seed)), spelled.take(pa.array(address)), directions.take(pa.array(steps)), pa.array(hops[rows[at]]), *[x.take(source) for x in texts]]
        return pa.RecordBatch.from_arrays(columns, names=["seed", "address", "direction", "hops", "via", "tx_hash"])

    for seed in np.union1d(a[front], a[before]).tolist():
        lo, hi = np.searchsorted(a[front], [seed, seed + 1])
        spans = [np.arange(x, y) for left, right in (starts[:2], starts[2:]) for x, y in zip(left[lo:hi].tolist(), right[lo:hi].tolist(), strict=True) if y > x]
        met = np.concatenate(spans) if spans else np.zeros(0, np.int64)  # ascending, so in the order that counts
        to = target[met]
        cut = int(np.searchsorted(met, rising))
        row[to[::-1]] = met[::-1]  # the first is written last
        bits[to[:cut]] = 1
        bits[to[cut:]] |= 2
        lo, hi = np.searchsorted(a[before], [seed, seed + 1])
        had = b[before[lo:hi]]
        row[had] = len(edges) + np.arange(lo, hi)
        bits[had] |= step[before[lo:hi]].astype(np.uint8)
        bits[seed] = 0
        seen = np.flatnonzero(bits) if 16 * (len(to) + len(had)) > len(bits) else np.unique(np.append(to, had))
        seen = seen[seen != seed]
        if len(seen):
            out.append((np.full(len(seen), seed), seen, bits[seen], row[seen]))
            size += len(seen)
        bits[to] = 0
        bits[had] = 0
        if size > ANSWER_ROWS:
            yield answer()
            out, size = [], 0
    if out:
        yield answer()


def _strict_direction(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Directions from two one-way walks inside the edges already met."""
    def one_way(step: str) -> DataFrame:
        arrows = stage(found.filter(F.col("step") == step).select("seed", "parent", "address").distinct(), "research-arrows")
        front = arrows.filter("parent = seed").select("seed", "address").distinct()
        reach = [stage(front, "research-way")]
        for _ in range(RESEARCH_HOPS - 1):
            onward = reach[-1].withColumnRenamed("address", "parent").join(arrows, ["seed", "parent"]).select("seed", "address")
            reach.append(stage(unseen_nodes(onward, reduce(DataFrame.unionByName, reach), ["seed", "address"]), "research-way"))
        return reduce(DataFrame.unionByName, reach).withColumn(f"_{step}", F.lit(True))

    keys = ["seed", "address"]
    tagged = nodes.join(one_way(UP), keys, "left").join(one_way(DOWN), keys, "left")
    direction = (
        F.when(F.col(f"_{UP}") & F.col(f"_{DOWN}"), "both").when(F.col(f"_{UP}"), UP).when(F.col(f"_{DOWN}"), DOWN)
        .otherwise(F.when(F.col("direction") == "both", UP).otherwise(F.col("direction")))
    )
    return tagged.withColumn("direction", direction).drop(f"_{UP}", f"_{DOWN}")


def research_components(walk: Walk, edges: DataFrame, bots: DataFrame, threshold: int = PUBLIC_FUNDER_THRESHOLD, public_seeds: list[str] = PUBLIC_FUNDER_SEEDS) -> DataFrame:
    """Walk nodes with in_cluster: connected to the seed without any public funder in between.

    The seed and tagged bots are never public. Out-degrees come from the whole edge table.
    """
    public = flag_public(edges.select("wallet", "funder"), bots, threshold, public_seeds).filter("is_public").select("funder").distinct()
    tagged = skew_join(walk.edges, public.withColumn("_public", F.lit(True)), "funder", "left")
    private = tagged.filter(F.col("_public").isNull() | (F.col("funder") == F.col("seed"))).select("seed", "child", "funder")
    roots = stage(connected_components(private, ["seed"], "child", "funder"), "research-roots")
    home = roots.filter("node = seed").select("seed", "root")
    inside = skew_join(roots, home.withColumn("_in", F.lit(True)), ["seed", "root"], "left_semi").select("seed", F.col("node").alias("address"), F.lit(True).alias("_in"))
    return walk.nodes.join(inside, ["seed", "address"], "left").withColumn(
        "in_cluster", F.coalesce("_in", F.lit(False)) | (F.col("address") == F.col("seed"))
    ).drop("_in")


def top_connections(nodes: DataFrame, n: int = RESEARCH_MAX_CONNECTIONS) -> DataFrame:
    """The ``n`` strongest connections per seed: cluster members first, then the closest."""
    return top_k(nodes.filter("address <> seed"), ["seed"], [F.desc("in_cluster"), F.asc("hops"), F.asc("address")], n, "rank")


def research_graph(connections: DataFrame, walk: Walk, bots: DataFrame, max_nodes: int = RESEARCH_GRAPH_MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to draw per seed: the seed plus its best connections, tagged bots first."""
    tagged = skew_join(connections, bots.select("address").distinct().withColumn("_bot", F.lit(True)), "address", "left")
    is_bot = F.coalesce("_bot", F.lit(False))
    kept = top_k(tagged.withColumn("_bot", is_bot), ["seed"], [F.desc("_bot"), F.desc("in_cluster"), F.asc("hops"), F.asc("rank")], max_nodes - 1, "place")
    role = F.when(F.col("_bot"), "rug").when(F.col("in_cluster"), "insider").otherwise("funder")
    own = walk.nodes.filter("address = seed").select("seed", "address", F.lit("seed").alias("role"))
    nodes = stage(kept.select("seed", "address", role.alias("role")).unionByName(own), "research-drawn")
    ends = nodes.select("seed", "address")
    edges = walk.edges.join(ends.withColumnRenamed("address", "child"), ["seed", "child"], "left_semi").join(
        ends.withColumnRenamed("address", "funder"), ["seed", "funder"], "left_semi"
    )
    return nodes, edges.select("seed", F.col("child").alias("from_address"), F.col("funder").alias("to_address"))


def label_connections(connections: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds each connection's manual label."""
    return skew_join(connections, labels.select(F.lower("address").alias("address"), F.col("kind").alias("label")), "address", "left")


def research_summary(labelled: DataFrame, walk: Walk, labels: DataFrame) -> DataFrame:
    """Per seed: connection and cluster counts and linked bots of the ``labelled`` connections, and wallets explored."""
    bot = F.col("label") == "rug-bot"
    counted = labelled.groupBy("seed").agg(
        F.count("*").alias("connection_count"),
        F.count(F.when(F.col("in_cluster"), 1)).alias("cluster_members"),
        F.count(F.when(bot, 1)).alias("linked_rug_bot_count"),
        F.sort_array(F.collect_list(F.when(bot, F.col("address")))).alias("linked_rug_bots"),
        F.max(F.coalesce(bot & F.col("in_cluster"), F.lit(False))).alias("_bot_inside"),
    )
    explored = walk.nodes.groupBy("seed").agg(F.count("*").alias("wallets_explored"))
    own = labels.select(F.lower("address").alias("seed"), F.col("kind").alias("label"))
    joined = explored.join(counted, "seed", "left").join(own, "seed", "left").join(walk.complete, "seed", "left")
    return joined.select(
        "seed", "label",
        (F.coalesce(F.col("label") == "rug-bot", F.lit(False)) | F.coalesce("_bot_inside", F.lit(False))).alias("rug_connected"),
        F.coalesce("connection_count", F.lit(0)).alias("connection_count"),
        F.coalesce("cluster_members", F.lit(0)).alias("cluster_members"),
        F.coalesce("linked_rug_bot_count", F.lit(0)).alias("linked_rug_bot_count"),
        F.coalesce("linked_rug_bots", F.array().cast("array<string>")).alias("linked_rug_bots"),
        "wallets_explored", "complete",
    )


def research_counts(clustered: DataFrame, walk: Walk, labels: DataFrame) -> DataFrame:
    """``research_summary`` over every connection of a seed, however many: counts only, no list (see ``linked_bots``)."""
    labelled = label_connections(clustered.filter("address <> seed"), labels)
    bot = F.coalesce(F.col("label") == "rug-bot", F.lit(False))
    counted = labelled.groupBy("seed").agg(
        F.count("*").alias("connection_count"),
        F.count(F.when(F.col("in_cluster"), 1)).alias("cluster_members"),
        F.count(F.when(bot, 1)).alias("linked_rug_bot_count"),
        F.max(bot & F.col("in_cluster")).alias("_bot_inside"),
    )
    explored = walk.nodes.groupBy("seed").agg(F.count("*").alias("wallets_explored"))
    own = labels.select(F.lower("address").alias("seed"), F.col("kind").alias("label"))
    joined = explored.join(counted, "seed", "left").join(own, "seed", "left").join(walk.complete, "seed", "left")
    return joined.select(
        "seed", "label",
        (F.coalesce(F.col("label") == "rug-bot", F.lit(False)) | F.coalesce("_bot_inside", F.lit(False))).alias("rug_connected"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("connection_count", "cluster_members", "linked_rug_bot_count")],
        "wallets_explored", "complete",
    )


def linked_bots(clustered: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per seed and tagged bot among its connections."""
    labelled = label_connections(clustered.filter("address <> seed"), labels)
    return labelled.filter("label = 'rug-bot'").select("seed", "address", "hops", "in_cluster")


@dataclass
class ResearchReport:
    summary: DataFrame
    connections: DataFrame
    nodes: DataFrame
    edges: DataFrame


def research_report(seeds: DataFrame, edges: DataFrame, labels: DataFrame, as_of: Column | None = None, hops: int = RESEARCH_HOPS,
                    threshold: int = PUBLIC_FUNDER_THRESHOLD, public_seeds: list[str] = PUBLIC_FUNDER_SEEDS, outflows: DataFrame | None = None,
                    counted: int | None = None) -> ResearchReport:
    """The whole research answer for all seeds in one job.

    The summary counts all connections, or the ``counted`` strongest; only the rows shown are cut.
    """
    bots = labels.filter("kind = 'rug-bot'").select(F.lower("address").alias("address")).distinct()
    walk = research_walk(seeds, edges, hops, outflows)
    clustered = stage(research_components(walk, edges, bots, threshold, public_seeds), "research-clustered")
    connections = stage(label_connections(top_connections(clustered), labels), "research-connections")
    nodes, drawn = research_graph(connections, walk, bots)
    every = clustered.filter("address <> seed") if counted is None else top_connections(clustered, counted)
    summary = research_summary(label_connections(every, labels), walk, labels)
    if as_of is not None:
        summary = summary.withColumn("updated_at", as_of)
    return ResearchReport(summary, connections, nodes, drawn)
