"""Connected components of many graphs at once.

Groups of up to ``GROUP_EDGES`` edges meet in one task and are solved there, many of them at a time; larger groups go
through rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidepool.runtime import Staged, hot_rows, skew_join, stage_table

GROUP_EDGES = 1 << 18
SOLVED_AT_ONCE = 1 << 17  # edges


def _stage_edges(edges: DataFrame, name: str) -> Staged:
    """Staged (a, b) pairs with their row count and an order-free fingerprint."""
    return stage_table(
        edges, name, rows=F.count(F.lit(1)), ab=F.bit_xor(F.xxhash64("a", "b")), ba=F.bit_xor(F.xxhash64("b", "a"))
    )


def _larger_to_parent(edges: DataFrame, rows: int) -> DataFrame:
    """Large-star: every node a of an edge (a, b), a > b, moves to the smallest neighbour of b."""
    parent = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    return skew_join(edges, parent, "b", "left", rows).select("a", F.coalesce("m", "b").alias("b"))


def _smaller_to_parent(edges: DataFrame, rows: int) -> DataFrame:
    """Small-star: the smaller neighbours of every node a move to the smallest of them."""
    parent = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = skew_join(edges, parent, "a", "inner", rows)
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(parent.select("a", F.col("m").alias("b"))).distinct()


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of every node's component, for nodes 0..n-1 and edges (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def group_numbers(table: pa.Table, group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of every row's group (groups follow each other) and the first row of every group."""
    change = np.zeros(table.num_rows, bool)
    for name in group:
        codes = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change), np.append(0, np.flatnonzero(change))


def ranked_names(*columns: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """The distinct names of all columns, their ascending order, and every column as ranks in it (-1 for NULL)."""
    ends = pa.chunked_array([chunk for column in columns for chunk in column.chunks], columns[0].type).combine_chunks().dictionary_encode()
    names, order = ends.dictionary, pc.sort_indices(ends.dictionary).to_numpy()
    rank = np.full(len(names) + 1, -1, np.int64)
    rank[order] = np.arange(len(names))
    ranks = rank[ends.indices.fill_null(-1).to_numpy()]
    return names, order, np.split(ranks, np.cumsum([len(column) for column in columns])[:-1])


def _solved(table: pa.Table, group: list[str]) -> pa.RecordBatch:
    """Components of whole groups that follow each other (columns: group..., _u, _v)."""
    rows = table.num_rows
    of_row, first = group_numbers(table, group)
    names, order, (u, v) = ranked_names(table.column("_u"), table.column("_v"))
    key = np.concatenate([of_row * len(names) + u, of_row * len(names) + v])
    nodes, index = np.unique(key, return_inverse=True)
    root = smallest_reachable(len(nodes), index[:rows], index[rows:])
    spelled = names.take(pa.array(order[nodes % len(names)]))
    columns = [table.column(name).combine_chunks().take(pa.array(first[nodes // len(names)])) for name in group]
    return pa.RecordBatch.from_arrays([*columns, spelled, spelled.take(pa.array(root))], names=[*group, "node", "root"])


def solve_groups(rows: DataFrame, group: list[str], solve: Callable[[pa.Table], pa.RecordBatch], schema: StructType) -> DataFrame:
    """``solve`` on whole groups small enough for a task: sorted by group, solved whenever enough whole groups have come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < SOLVED_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            last = table.slice(table.num_rows - 1, 1).to_pylist()[0]
            same = np.ones(table.num_rows, bool)
            for name in group:
                column = table.column(name)
                equal = column.is_null() if last[name] is None else pc.equal(column, pa.scalar(last[name], column.type)).fill_null(False)
                same &= equal.to_numpy().astype(bool)
            cut = table.num_rows - int(same[::-1].argmin() if not same.all() else table.num_rows)
            if cut:
                yield solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
        if size:
            yield solve(pa.Table.from_batches(held))

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def _by_group(edges: DataFrame, group: list[str]) -> DataFrame:
    """Components of groups small enough for a task."""
    node = edges.schema["_u"].dataType
    schema = StructType([*[edges.schema[g] for g in group], StructField("node", node), StructField("root", node)])
    return solve_groups(edges, group, lambda table: _solved(table, group), schema)


def connected_components(edges: DataFrame, group: list[str], u: str = "wallet", v: str = "funder") -> DataFrame:
    """(group..., node, root) for every node of an undirected edge table, one graph per group value.

    ``root`` is the smallest node of the component. Edges without one of their ends are ignored.
    """
    pairs = edges.select(*group, F.col(u).alias("_u"), F.col(v).alias("_v")).filter("_u <> _v")
    staged = stage_table(pairs, "cc-pairs", rows=F.count(F.lit(1)))
    if (staged.metrics["rows"] or 0) <= GROUP_EDGES:  # so is every group
        return _by_group(staged.df, group)
    counted = staged.df.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > GROUP_EDGES).drop("_n")
    numbered = counted.withColumn("_g", F.monotonically_increasing_id())
    large = stage_table(numbered, "cc-groups", n=F.count(F.lit(1)))  # at most one per GROUP_EDGES edges
    if not large.metrics["n"]:
        return _by_group(staged.df, group)
    match = [F.col(g).eqNullSafe(F.col(f"_large_{g}")) for g in group]
    listed = F.broadcast(large.df.withColumnsRenamed({g: f"_large_{g}" for g in group}))
    small = _by_group(staged.df.join(listed, match, "left_anti"), group)
    rest = _by_rounds(staged.df.join(listed, match).select("_g", "_u", "_v"), ["_g"])
    return small.unionByName(rest.join(F.broadcast(large.df), "_g").select(*group, "node", "root"))


def _by_rounds(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Components of groups of any size. ``pairs``: group..., _u, _v.

    Nodes get integer ids that order like (group, node), so the loop works on pairs of longs and the
    smallest id is the smallest node. The loop alternates large-star and small-star steps (Kiveris et
    al., SoCC 2014) until the edge set is a forest of stars; each round is a staged table and the
    previous one is dropped.
    """
    limit = hot_rows(pairs.sparkSession)
    ends = pairs.select(*group, F.col("_u").alias("node")).unionByName(pairs.select(*group, F.col("_v").alias("node"))).distinct()
    ordered = ends.repartitionByRange(*group, "node").sortWithinPartitions(*group, "node")
    nodes = stage_table(ordered.withColumn("id", F.monotonically_increasing_id()), "cc-nodes").df

    def with_id(df: DataFrame, end: str) -> DataFrame:
        dim = nodes.select(*group, F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
        return skew_join(df, dim, [*group, end]).drop(end)

    ids = with_id(with_id(pairs, "_v"), "_u")
    oriented = ids.select(F.greatest("_u_id", "_v_id").alias("a"), F.least("_u_id", "_v_id").alias("b"))
    current = _stage_edges(oriented.distinct(), "cc-edges")
    while True:
        rows = current.metrics["rows"]
        large = _larger_to_parent(current.df, rows)
        # Below one hot key's worth of rows the first step is cheaper to repeat than to write.
        staged = stage_table(large, "cc-large") if rows > limit else None
        small = _stage_edges(_smaller_to_parent(staged.df if staged else large, rows), "cc-small")
        settled = small.metrics == current.metrics
        if staged:
            staged.drop()
        current.drop()
        current = small
        if settled:
            break
    parents = current.df.select(F.col("a").alias("id"), F.col("b").alias("root_id"))
    rooted = nodes.join(parents, "id", "left").withColumn("root_id", F.coalesce("root_id", "id"))
    names = nodes.select(F.col("id").alias("root_id"), F.col("node").alias("root"))
    return skew_join(rooted, names, "root_id", "inner", current.metrics["rows"] * 2).select(*group, "node", "root")
