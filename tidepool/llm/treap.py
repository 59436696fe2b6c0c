"""Ranked lexical search on K2-treaps over the term-document grid.

``build``   cuts the documents into shards. A shard's grid has a row per term (frequent ones first, so that the lower
            rows are sparse) and a column per document; a filled cell holds the impact of the term in the document. The
            grid is halved both ways again and again; every quadrant with a filled cell is a node, kept as a mask of its
            four quadrants and the difference of its maximal impact from its parent's. Weights of terms are no part of
            the index, so it serves any query; one row per shard is all that is stored.
``search``  An item holds one node per term for a range of documents: the quadrants on that term's row path. The sum of
            weight times maximum bounds every score in the range from above. In rounds the items open their best ranges,
            all of a shard together: a range is halved and every path goes down one level on either side. A range of one
            document has its exact score. A range whose bound is below the item's k-th best score so far is dropped, so
            the result is exact. A task carries these scores on from shard to shard and gives out k rows per item.

A score sums w * ((1000000000 * tf) div (1000 * tf + 20 * m)) over an item's distinct terms, with
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 100 - 50 + ((50 * n * N) div L).

Defined cases: NULL and empty texts, and texts without terms, are found by no item and count in no statistic; items
without terms have no rows; texts of one item_id (NULL too) are one item; NULL and repeated document ids and repeated
rows are documents of their own, NULL coming last among equal scores; a text of any length is a document of one
shard; no rows give no rows. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.coding import packed, packed_sorted, unpacked, unpacked_sorted
from tidepool.llm.tokens import ALNUM, lower_ascii, text_chunks, word_hashes, word_spans
from tidepool.runtime import stage, top_k

SHARD_DOCS = 1 << 14
SHARD_CELLS = 1 << 20
BLOCK_BYTES = 16 << 20  # of item texts that are searched at once
OPENED = 256  # ranges that an item opens in a round
_LAST = np.int64((1 << 63) - 1)  # stands for a NULL id, which sorts last


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of the distinct terms of every text, and the number of terms of every text."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets, ALNUM)
    names, index = np.unique(word_hashes(data, starts, ends), return_inverse=True)
    sizes = np.diff(first)
    cells, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(names)) + index, return_counts=True)
    return cells // max(1, len(names)), names[cells % max(1, len(names))] if len(names) else names, tf, sizes


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N and L: documents with a term, and terms in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = terms = 0
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                sizes = np.diff(word_spans(lower_ascii(data), offsets, ALNUM)[2])
                full, terms = full + int((sizes > 0).sum()), terms + int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array([full]), pa.array([terms])], names=["n", "l"])

    row = docs.select(text).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers on the even places of 64."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _tree(row: np.ndarray, column: np.ndarray, impact: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of all inner nodes and falls of all nodes from their parents' maxima, level by level from the root."""
    cells = (_spread(row) << np.uint64(1)) | _spread(column)
    order = np.argsort(cells, kind="stable")
    cells, best = cells[order], impact[order]
    masks, falls = [], []
    for _ in range(levels):
        above = cells >> np.uint64(2)
        first = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
        masks.append(np.bitwise_or.reduceat(np.uint8(1) << (cells & np.uint64(3)).astype(np.uint8), first))
        top = np.maximum.reduceat(best, first)
        falls.append(np.repeat(top, np.diff(np.append(first, len(cells)))) - best)
        cells, best = above[first], top
    falls.append(-best)  # the root's own maximum
    return np.concatenate(masks[::-1]), np.concatenate(falls[::-1]).astype(np.int32)


class Treap:
    """A shard's tree in memory: nodes of all levels numbered in one row, root first."""

    def __init__(self, levels: int, masks: np.ndarray, falls: np.ndarray):
        self.levels = levels
        self.masks = masks
        children = np.bitwise_count(masks).astype(np.int64)
        self.first = 1 + np.cumsum(children) - children  # number of a node's first child
        self.best = np.empty(len(falls), np.int64)
        self.best[0] = -int(falls[0])
        lo, n, done = 0, 1, 1
        for _ in range(levels):
            below = int(children[lo : lo + n].sum())
            self.best[done : done + below] = np.repeat(self.best[lo : lo + n], children[lo : lo + n]) - falls[done : done + below]
            lo, n, done = lo + n, below, done + below

    def child(self, node: np.ndarray, quadrant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the quadrant of the node is filled, and its node."""
        mask = self.masks[node]
        there = (mask >> quadrant) & np.uint8(1)
        return there.astype(bool), self.first[node] + np.bitwise_count(mask & ((np.uint8(1) << quadrant) - np.uint8(1)))


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int | None = None, terms: int | None = None) -> DataFrame:
    """The index: names (of terms, in row order) and df, ids of documents, levels, masks, falls; a row per shard.

    ``documents`` and ``terms`` are N and L; they are counted where not given.
    """
    if documents is None or terms is None:
        documents, terms = statistics(docs, text)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        bases = np.cumsum([0, *(len(h[0]) for h in held)])
        column = np.concatenate([h[1] + b for h, b in zip(held, bases, strict=False)])
        names, row, df = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True, return_counts=True)
        tf, size = np.concatenate([h[3] for h in held]).astype(np.int64), np.concatenate([h[4] for h in held]).astype(np.int64)
        m = 50 + (50 * size * documents) // max(1, terms)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[column])
        place = np.empty(len(names), np.int64)
        place[np.argsort(-df, kind="stable")] = np.arange(len(names))
        levels = max(1, int(max(len(names), len(ids)) - 1).bit_length())
        masks, falls = _tree(place[row], column, impact, levels)
        values = [packed_sorted(names), packed(place.astype(np.uint32)), packed(df.astype(np.uint32)), packed(ids), levels, packed(masks), packed(falls)]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["names", "places", "df", "ids", "levels", "masks", "falls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cells = many = 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
            for at, data, offsets in text_chunks(batch.column("text")):
                doc, names, tf, sizes = _terms(data, offsets)
                if not len(doc):
                    continue
                full = np.flatnonzero(sizes)
                held.append((ids[at : at + len(sizes)][full], np.searchsorted(full, doc), names, tf, sizes[full]))
                cells, many = cells + len(doc), many + len(full)
                if cells >= SHARD_CELLS or many >= SHARD_DOCS:
                    yield flush(held)
                    held, cells, many = [], 0, 0
        if held:
            yield flush(held)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "names binary, places binary, df binary, ids binary, levels long, masks binary, falls binary")


class Queries:
    """Items of a block: the terms of item i are names[bounds[i]:bounds[i + 1]], with their weights."""

    def __init__(self, ids: list, terms: list[np.ndarray], df: dict[int, int], documents: int):
        self.ids = ids
        self.bounds = np.cumsum([0, *(len(t) for t in terms)])
        self.names = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(ids)), np.diff(self.bounds))
        count = np.array([df.get(h, 0) for h in self.names.tolist()], np.int64)
        self.weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * count + 1))).astype(np.int64)
        self.weight[count == 0] = 0


def _ranges(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Found:
    """The k best (score, then smaller id) documents of every item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.ones(items, np.int64)  # a score or bound below it is of no use

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.concatenate([self.item, item]), np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[item[last]] = score[last]
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def _descend(tree: Treap, ids: np.ndarray, item: np.ndarray, place: np.ndarray, weight: np.ndarray, found: Found) -> None:
    """Adds a shard's documents. ``item``, ``place``, ``weight``: the terms of the items, items ascending."""
    # Open ranges: item, level, column (of their first document, in units of their width), bound, and their nodes.
    e_item, count = np.unique(item, return_counts=True)
    e_level, e_column = np.zeros(len(e_item), np.int64), np.zeros(len(e_item), np.int64)
    e_count, n_node, n_place, n_weight = count, np.zeros(len(item), np.int64), place, weight
    e_bound = np.add.reduceat(weight * tree.best[0], np.cumsum(count) - count)
    while len(e_item):
        order = np.lexsort((-e_bound, e_item))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(e_item[order], e_item[order])
        useful = e_bound >= found.least[e_item]
        now = np.flatnonzero(useful & (rank < OPENED))
        later = np.flatnonzero(useful & (rank >= OPENED))
        starts = np.cumsum(e_count) - e_count
        own = _ranges(e_count[now], starts[now])
        node, at, w = n_node[own], n_place[own], n_weight[own]
        of = np.repeat(np.arange(len(now)), e_count[now])
        row_bit = ((at >> (tree.levels - 1 - e_level[now][of])) & 1).astype(np.uint8) << np.uint8(1)
        sides = []
        for half in (0, 1):
            there, child = tree.child(node, row_bit + np.uint8(half))
            sides.append((2 * of[there] + half, child[there], at[there], w[there]))
        entry, child, at, w = (np.concatenate(c) for c in zip(*sides, strict=True))
        order = np.argsort(entry, kind="stable")
        entry, child, at, w = entry[order], child[order], at[order], w[order]
        first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1])) if len(entry) else np.zeros(0, np.int64)
        bound = np.add.reduceat(w * tree.best[child], first) if len(entry) else np.zeros(0, np.int64)
        new = entry[first]
        item_, level = e_item[now][new // 2], e_level[now][new // 2] + 1
        column, size = 2 * e_column[now][new // 2] + new % 2, np.diff(np.append(first, len(entry)))
        done = level == tree.levels
        good = done & (bound >= found.least[item_])
        if good.any():
            found.add(item_[good], bound[good], ids[column[good]])
        go = np.flatnonzero(~done & (bound >= found.least[item_]))
        below, kept = _ranges(size[go], first[go]), _ranges(e_count[later], starts[later])
        n_node, n_place, n_weight = (np.concatenate([a[kept], b[below]]) for a, b in ((n_node, child), (n_place, at), (n_weight, w)))
        e_item, e_level, e_column, e_bound, e_count = (
            np.concatenate([a[later], b[go]]) for a, b in ((e_item, item_), (e_level, level), (e_column, column), (e_bound, bound), (e_count, size))
        )


def _local(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted terms are among a shard's sorted names, and which are."""
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


def _frequencies(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """df of the wanted terms (a block's: bounded)."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for names, df in zip(batch.column("names").to_pylist(), batch.column("df").to_pylist(), strict=True):
                at, there = _local(unpacked_sorted(names), shared.value)
                total[there] += unpacked(df, np.uint32)[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    counted = index.select("names", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {int(wanted[r["term"]]): r["df"] for r in counted.collect()}


def _item_terms(items: DataFrame) -> dict:
    """Distinct terms of every item of a block."""
    out: dict = {}
    rows = items.collect()
    for at, data, offsets in text_chunks(pa.array([r["text"] for r in rows], pa.string())):
        text, names, _, _ = _terms(data, offsets)
        for k, name in zip(text.tolist(), names.tolist(), strict=True):
            out.setdefault(rows[at + k]["item_id"], set()).add(name)
    return {k: np.array(sorted(v), np.uint64) for k, v in out.items()}


def search(
    index: DataFrame, items: DataFrame, documents: int, k: int = 50, item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents of score above 0. ``documents`` is N."""
    kind = items.select(item_id).schema[0].dataType
    listed = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for block in range(blocks):
        terms = _item_terms(listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block))  # about block_bytes of text
        wanted = np.unique(np.concatenate([*terms.values(), np.zeros(0, np.uint64)]))
        shared = index.sparkSession.sparkContext.broadcast(Queries(list(terms), list(terms.values()), _frequencies(index, wanted), documents))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            found = Found(len(asked.ids), k)
            for batch in batches:
                for r in range(batch.num_rows):
                    row = batch.slice(r, 1).to_pylist()[0]
                    at, there = _local(unpacked_sorted(row["names"]), asked.names)
                    there &= asked.weight > 0
                    if there.any():
                        tree = Treap(row["levels"], unpacked(row["masks"], np.uint8), unpacked(row["falls"], np.int32))
                        place = unpacked(row["places"], np.uint32).astype(np.int64)[at[there]]
                        _descend(tree, unpacked(row["ids"], np.int64), asked.item[there], place, asked.weight[there], found)
            if len(found.item):
                yield pa.RecordBatch.from_arrays([pa.array(found.item), pa.array(found.doc), pa.array(found.score)], names=["item", "doc", "score"])

        rows = index.mapInArrow(run, "item long, doc long, score long")
        best = top_k(rows, ["item"], [F.desc("score"), F.asc("doc")], k, "rank")
        names = index.sparkSession.createDataFrame(list(enumerate(terms)), f"item long, item_id {kind.simpleString()}")
        named = best.join(names, "item").select("item_id", "rank", F.when(F.col("doc") != int(_LAST), F.col("doc")).alias("doc_id"), "score")
        out = named if out is None else out.unionByName(named)
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item."""
    documents, terms = statistics(docs, text)
    index = stage(build(docs, doc_id, text, documents, terms), "treap")
    return search(index, items, documents, k)
