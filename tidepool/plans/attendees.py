"""End-to-end attendee analysis for any set of launches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators import intel as ops
from tidepool.operators.funding import creator_funding_source
from tidepool.runtime import stage
from tidepool.schemas import PUBLIC_FUNDER_SEEDS, PUBLIC_FUNDER_THRESHOLD


@dataclass
class Analysis:
    """Lazy results over staged intermediate tables."""

    launches: DataFrame
    traders: DataFrame
    graph: ops.PoolGraph
    classified: DataFrame


def analyse(launches: DataFrame, traders: DataFrame, edges: DataFrame, labels: DataFrame,
            threshold: int = PUBLIC_FUNDER_THRESHOLD, seeds: list[str] = PUBLIC_FUNDER_SEEDS, prune_public: bool = False) -> Analysis:
    """Walks, components and classes of every trader. ``traders`` comes from ``trader_activity``.

    Many steps read the launches: what is behind them (prices, say) is made once.
    """
    launches, traders = stage(launches, "launches"), stage(traders, "traders")
    bots = labels.filter("kind = 'rug-bot'").select("address")
    graph = ops.build_pool_graph(launches, traders, edges, bots, threshold=threshold, seeds=seeds, prune_public=prune_public)
    classified = stage(ops.classify_attendees(traders, graph), "classified")
    return Analysis(launches, traders, graph, classified)


def report(done: Analysis, edges: DataFrame, funded: DataFrame, as_of: Column) -> ops.AttendeeReport:
    """All parts of the attendee report. ``launches`` carries quote_decimals, price_usd and volume_usd."""
    rings = stage(ops.coordinated_rings(done.classified, done.graph.edges), "rings-all")
    clustered = ops.assign_clusters(done.classified, rings)  # each reader joins the few columns it asks for
    source = creator_funding_source(done.launches, edges)
    intel = ops.pool_intel(done.classified, done.launches)
    complete = ops.analysis_complete(done.launches, done.traders, done.graph.bots, funded)
    nodes, drawn = ops.attendee_graph(clustered, done.launches, done.graph)
    return ops.AttendeeReport(
        summary=ops.attendee_report(done.launches, intel, source, complete, as_of),
        buyers=ops.buyer_rows(clustered, done.launches),
        clusters=ops.cluster_rollup(clustered, rings, source),
        nodes=nodes,
        edges=drawn,
    )
