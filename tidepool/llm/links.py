"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.runtime import Staged, stage_table


def _written(edges: DataFrame) -> Staged:
    return stage_table(edges, "links", rows=F.count(F.lit(1)), print=F.bit_xor(F.xxhash64("a", "b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected BIGINT edges (a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014) until the edges are stars. Every step is a
    map-side combined minimum and a join; every round is a written table, so a lost executor costs one round.
    """
    now = _written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = now.df.join(lowest, F.col("b") == F.col("u")).select("a", F.col("m").alias("b"))
        lowest = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(lowest, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = _written(small.unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        settled = then.metrics == now.metrics
        now.drop()
        now = then
        if settled:
            break
    stars = now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
