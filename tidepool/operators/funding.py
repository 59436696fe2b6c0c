"""The wallet funding graph: who first sent value to whom, public funders, bounded walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.runtime import number_rows, skew_join, stage, top_k
from tidepool.schemas import (
    MAX_FUNDERS_PER_WALLET,
    MAX_FUNDING_HOPS,
    PUBLIC_FUNDER_SEEDS,
    PUBLIC_FUNDER_THRESHOLD,
    RESEARCH_OUT_FANOUT,
)


def _effective(transfers: DataFrame) -> DataFrame:
    """Successful transfers of some value between two different addresses.

    Expects sender, recipient, value, is_error BOOLEAN, ts, via and an order column ``seq``.
    """
    nonzero = F.col("value").cast("string") != "0"
    if dict(transfers.dtypes)["value"] != "string":
        nonzero = F.col("value") != 0
    sender, recipient = F.lower("sender"), F.lower("recipient")
    return transfers.withColumns({"sender": sender, "recipient": recipient}).filter(
        ~F.coalesce(F.col("is_error"), F.lit(False)) & nonzero
        & F.col("sender").isNotNull() & F.col("recipient").isNotNull() & (F.col("sender") != F.col("recipient"))
    )


def _first_by_other(transfers: DataFrame, wallet: str, other: str) -> DataFrame:
    """Earliest transfer per (wallet, other side), with what orders a wallet's other sides: ts, _late, _seq, other."""
    when = F.struct(F.col("ts"), (F.col("via") != "external").alias("late_list"), F.col("seq"))
    return _effective(transfers).groupBy(F.col(wallet).alias("wallet"), F.col(other).alias("other")).agg(
        F.min(when).alias("_when"),
        F.min_by(F.struct("via", "hash", "value"), when).alias("_first"),
    ).select("wallet", "other", "_first.*", F.col("_when.ts").alias("ts"), F.col("_when.late_list").alias("_late"), F.col("_when.seq").alias("_seq"))


def dedupe_first_inflow(transfers: DataFrame, wallet: str = "recipient", other: str = "sender", n: int | None = None) -> DataFrame:
    """Earliest transfer per (wallet, other side), then the ``n`` earliest other sides per wallet.

    Time ties go to the normal transfer list, then to list order. The first step is a map-side
    combined aggregate, the second keeps n rows per wallet before its shuffle.
    """
    first = _first_by_other(transfers, wallet, other)
    order = [F.col("ts"), F.col("_late"), F.col("_seq"), F.col("other")]
    if n is None:
        return first.drop("_late", "_seq")
    return top_k(first, ["wallet"], order, n, "position").drop("_late", "_seq")


def _positioned(transfers: DataFrame, wallet: str, other: str, n: int | None) -> DataFrame:
    """The ``n`` earliest other sides of every wallet, or all of them, numbered without one task per wallet."""
    if n is not None:
        return dedupe_first_inflow(transfers, wallet, other, n)
    return number_rows(_first_by_other(transfers, wallet, other), ["wallet"], ["ts", "_late", "_seq", "other"], "position").drop("_late", "_seq")


def funding_inflows(transfers: DataFrame, max_funders: int | None = MAX_FUNDERS_PER_WALLET) -> DataFrame:
    """(wallet, funder, via, hash, value, ts, position): each wallet's first distinct funders; None gives all."""
    return _positioned(transfers, "recipient", "sender", max_funders).withColumnRenamed("other", "funder")


def funding_outflows(transfers: DataFrame, max_recipients: int | None = RESEARCH_OUT_FANOUT) -> DataFrame:
    """(funder, wallet, via, hash, value, ts, position): the first distinct wallets each sender funded; None gives all."""
    rows = _positioned(transfers, "sender", "recipient", max_recipients)
    return rows.withColumnsRenamed({"wallet": "funder", "other": "wallet"})


def funding_amount(value: Column, decimals: int = 18) -> Column:
    """Raw native amount as text with four decimals."""
    return F.format_string("%.4f ETH", value.cast("double") / F.lit(10.0 ** decimals))


def wallet_funding_build(inflows: DataFrame, as_of: Column, decimals: int = 18) -> DataFrame:
    """One record per wallet: all funders of ``inflows`` in order and the earliest one spelled out.

    A record holds its funders in one array, so inflows without a cap belong here only where no wallet has very many
    (they are edges as they are).
    """
    funder = F.struct(
        F.col("position"), F.col("funder").alias("from"), "via", F.col("hash").alias("tx_hash"),
        F.col("value").cast("string").alias("value"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time_stamp"),
    )
    first = inflows.groupBy(F.col("wallet").alias("address")).agg(
        F.sort_array(F.collect_list(funder)).alias("_funders"),
        F.min_by(F.struct("ts", "value"), "position").alias("_primary"),
    )
    return first.select(
        "address",
        F.transform("_funders", lambda x: x.dropFields("position")).alias("funders"),
        F.col("_funders")[0]["from"].alias("funding_source"),
        F.col("_funders")[0]["tx_hash"].alias("funding_tx_hash"),
        F.col("_primary.ts").alias("first_funded_at"),
        funding_amount(F.col("_primary.value"), decimals).alias("funding_amount"),
        as_of.alias("fetched_at"),
    )


def funders_of(wallet_funding: DataFrame) -> DataFrame:
    """Funding edges (wallet, funder, via, tx_hash, time_stamp, position) of stored records.

    Records from before the funders array carry one funder in scalar columns; it counts as one
    external edge.
    """
    legacy = F.array(F.struct(
        F.col("funding_source").alias("from"), F.lit("external").alias("via"),
        F.coalesce("funding_tx_hash", F.lit("")).alias("tx_hash"), F.lit("0").alias("value"),
        F.lit(0).cast("long").alias("time_stamp"),
    ))
    funders = F.when(F.size(F.coalesce("funders", F.array())) > 0, F.col("funders")).when(F.col("funding_source").isNotNull(), legacy)
    return wallet_funding.select("address", F.posexplode(funders).alias("_at", "_funder")).select(
        F.col("address").alias("wallet"), F.col("_funder.from").alias("funder"), F.col("_funder.via").alias("via"),
        F.nullif(F.col("_funder.tx_hash"), F.lit("")).alias("tx_hash"), F.col("_funder.time_stamp").alias("time_stamp"),
        (F.col("_at") + 1).alias("position"),
    )


def funder_x_wallets(edges: DataFrame, funders: DataFrame) -> DataFrame:
    """Edges out of the given funders: the wallets they funded."""
    return skew_join(edges, funders.select("funder").distinct(), "funder", "left_semi")


def funder_out_degree(edges: DataFrame) -> DataFrame:
    """Distinct wallets per funder over all edges."""
    return edges.groupBy("funder").agg(F.countDistinct("wallet").alias("wallets"))


def flag_public(edges: DataFrame, exempt: DataFrame | None = None, threshold: int = PUBLIC_FUNDER_THRESHOLD, seeds: list[str] = PUBLIC_FUNDER_SEEDS) -> DataFrame:
    """Adds is_public: the funder is a known public address or funded ``threshold`` wallets.

    ``exempt`` (one column: address) is never public. The flag is computed once on the edge table;
    exemptions that differ per pool or per seed are applied where they are known.
    """
    crowd = funder_out_degree(edges).filter(F.col("wallets") >= threshold).select("funder")
    if exempt is not None:
        crowd = crowd.join(exempt.select(F.col("address").alias("funder")).distinct(), "funder", "left_anti")
    tagged = skew_join(edges, crowd.withColumn("_crowd", F.lit(True)), "funder", "left")
    flag = F.coalesce("_crowd", F.lit(False))
    if seeds:
        known = F.col("funder").isin(seeds)
        if exempt is not None:
            listed = exempt.filter(F.col("address").isin(seeds)).select(F.col("address").alias("funder")).distinct()
            tagged = tagged.join(F.broadcast(listed.withColumn("_listed", F.lit(True))), "funder", "left")
            known = known & F.col("_listed").isNull()
        flag = flag | known
    return tagged.withColumn("is_public", flag).drop("_crowd", "_listed")


def public_funders(edges: DataFrame, exempt: DataFrame | None = None, threshold: int = PUBLIC_FUNDER_THRESHOLD, seeds: list[str] = PUBLIC_FUNDER_SEEDS) -> DataFrame:
    """The public funders that occur in ``edges``."""
    return flag_public(edges, exempt, threshold, seeds).filter("is_public").select("funder").distinct()


def unseen_nodes(candidates: DataFrame, visited: DataFrame, keys: list[str]) -> DataFrame:
    """New frontier: distinct candidates not visited yet."""
    return candidates.select(*keys).distinct().join(visited.select(*keys), keys, "left_anti")


def funding_walk(start: DataFrame, edges: DataFrame, keys: list[str], hops: int = MAX_FUNDING_HOPS, prune_public: bool = False, tied: bool = False) -> DataFrame:
    """Edges met on a walk of ``hops`` steps up through the funders of every (keys..., wallet) in ``start``.

    All groups walk at once; each hop expands only wallets its group has not expanded before. The walk
    goes through public funders too unless ``prune_public``. ``edges`` has at most a few funders per
    wallet, so a wallet shared by very many groups is handled by ``skew_join``. ``tied`` keeps _funds: the wallet is a
    funder in ``edges``, so that a walk can come to it.
    """
    frontier, met = start.select(*keys, "wallet").distinct(), []
    edges = stage(_tied(edges), "walk-edges")
    for hop in range(hops):
        step = stage(skew_join(frontier, edges, "wallet").withColumn("hop", F.lit(hop)), "walk-step")
        met.append(step)
        # Wallets without funders may come back; they have nothing to expand.
        seen = reduce(DataFrame.unionByName, [done.filter("_funds").select(*keys, "wallet") for done in met])
        onward = step.filter("_funded AND NOT is_public") if prune_public else step.filter("_funded")
        frontier = unseen_nodes(onward.select(*keys, F.col("funder").alias("wallet")), seen, [*keys, "wallet"])
    return reduce(DataFrame.unionByName, met).drop("_funded", *([] if tied else ["_funds"]))


def _tied(edges: DataFrame) -> DataFrame:
    """Adds to the edge table what spares a walk rows in every group: _funded (the funder has funders of its own, so a
    step to it leads on) and _funds (the wallet is a funder too, so that a later step may come back to it)."""
    ends = {"_funded": ("funder", "wallet"), "_funds": ("wallet", "funder")}
    for name, (at, other) in ends.items():
        known = edges.select(F.col(other).alias(at)).distinct().withColumn(name, F.lit(True))
        edges = skew_join(edges, known, at, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return edges


def funding_components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Components of (keys..., wallet, funder) edges; see ``connected_components``."""
    from tidepool.operators.components import connected_components

    return connected_components(edges, ["pool_address"] if keys is None else keys)


def creator_funding_source(launches: DataFrame, edges: DataFrame) -> DataFrame:
    """Earliest funder of each launch's creator, public or not."""
    first = edges.groupBy(F.col("wallet").alias("creator")).agg(F.min_by("funder", "position").alias("creator_funding_source"))
    return skew_join(launches.select("pool_address", "creator"), first, "creator", "left")
