"""Benchmark decontamination with suffix arrays over the training words.

Every chunk of training documents is a shard with its own suffix array: positions whose next words are all known to
the test set, sorted by those words. Every test suffix is binary-searched in it (``window`` words; an item of fewer
words is one suffix), all occurrences are hits, and hits that continue one another give the longest verbatim match
and its place. Positions followed by a word the test set has not cannot hold a match and are left out of the array.

The test set goes to all tasks in blocks of at most ``BLOCK_BYTES``, one pass per block, so it may be of any size;
the documents are not shuffled.

Defined cases: NULL texts have no words; items without words never match; items with a NULL id count under the
empty id; items of one id count once; repeated rows are judged alike; no documents give no rows, no items no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.tokens import ALNUM, lower_ascii, text_chunks, word_hashes, word_spans

WINDOW = 10
BLOCK_BYTES = 16 << 20

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("item_start", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()),
    ]))),
])


class TestSet:
    """One block of items: its vocabulary as ranks and its suffixes by length."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        column = pa.array([t or "" for t in texts], pa.large_string())
        hashes, bounds = [np.zeros(0, np.uint64)], [0]
        for _, data, offsets in text_chunks(column):
            data = lower_ascii(data)
            starts, ends, first = word_spans(data, offsets, ALNUM)
            hashes.append(word_hashes(data, starts, ends))
            bounds += (bounds[-1] + first[1:]).tolist()
        self.ids, words, self.bounds = ids, np.concatenate(hashes), np.array(bounds)
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        self.high = np.zeros(1 << 16, bool)
        self.high[self.vocabulary >> np.uint64(48)] = True
        rank = (rank + 1).astype(">u4")
        self.suffixes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.diff(self.bounds)
        starts_by_length: dict[int, list[np.ndarray]] = {}
        for item, n in enumerate(lengths.tolist()):
            if n:
                size = min(n, window)
                starts_by_length.setdefault(size, []).append(np.arange(self.bounds[item], self.bounds[item + 1] - size + 1))
        for size, found in starts_by_length.items():
            starts = np.concatenate(found)
            self.suffixes[size] = (starts, _keys(rank, starts, size))

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of every word, 0 for one the test set has not."""
        out = np.zeros(len(hashes), np.int64)
        if not len(self.vocabulary):
            return out
        maybe = np.flatnonzero(self.high[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out

    def occurrences(self, ranks: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, word position, test position) of every occurrence of every suffix in one shard."""
        # Words from each position on that are known and in the same text.
        stop = np.zeros(len(ranks) + 1, bool)
        stop[:-1] = ranks == 0
        stop[first] = True
        next_stop = np.append(np.flatnonzero(stop), len(ranks))
        where = np.arange(len(ranks))
        run = next_stop[np.searchsorted(next_stop, where + 1)] - where
        run[ranks == 0] = 0
        wide = ranks.astype(">u4")
        for size, (starts, keys) in self.suffixes.items():
            kept = np.flatnonzero(run >= size)
            shard = _keys(wide, kept, size)
            suffix_array = np.argsort(shard, kind="stable")
            shard = shard[suffix_array]
            lo, hi = np.searchsorted(shard, keys, "left"), np.searchsorted(shard, keys, "right")
            count = hi - lo
            picked = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield size, kept[suffix_array[picked]], np.repeat(starts, count)


def _keys(ranks: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The next ``size`` ranks as byte strings that sort like the words' ranks."""
    taken = np.ascontiguousarray(ranks[starts[:, None] + np.arange(size)[None, :]])
    return taken.view(f"S{4 * size}").reshape(-1)


def _longest(size: int, at: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Length of the verbatim match of every occurrence: occurrences that continue each other are one."""
    order = np.lexsort((at, at - test))
    a, d = at[order], (at - test)[order]
    last = np.ones(len(a), bool)
    last[:-1] = (a[1:] != a[:-1] + 1) | (d[1:] != d[:-1])
    ends = np.flatnonzero(last)
    length = np.empty(len(a), np.int64)
    length[order] = a[ends[np.searchsorted(ends, np.arange(len(a)))]] - a + size
    return length


def _judge(tests: TestSet, column: pa.Array) -> Iterator[dict]:
    for _, data, offsets in text_chunks(column):
        data = lower_ascii(data)
        starts, ends, first = word_spans(data, offsets, ALNUM)
        found = [{"n_words": n, "hits": [], "items": [], "matches": []} for n in np.diff(first).tolist()]
        spans: dict[int, list[np.ndarray]] = {}
        for size, at, test in tests.occurrences(tests.ranks(word_hashes(data, starts, ends)), first):
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            local = at - first[doc]
            length = _longest(size, at, test)
            order = np.lexsort((local, -length, test, doc))
            top = np.ones(len(order), bool)
            top[1:] = (doc[order][1:] != doc[order][:-1]) | (test[order][1:] != test[order][:-1])
            for k in order[top].tolist():
                item = int(np.searchsorted(tests.bounds, test[k], "right")) - 1
                found[doc[k]]["matches"].append({"item_id": tests.ids[item], "item_start": int(test[k] - tests.bounds[item]), "start": int(local[k]), "length": int(length[k])})
            for d in np.unique(doc).tolist():
                starts_here = np.unique(local[doc == d])
                spans.setdefault(d, []).append(np.stack([starts_here, starts_here + size]))
        for d, parts in spans.items():
            lo, hi = np.concatenate(parts, axis=1)
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            new = np.append(True, lo[1:] > hi[:-1])
            found[d]["hits"] = [{"start": int(s), "end": int(e)} for s, e in zip(lo[new], hi[np.append(new[1:], True)], strict=True)]
            found[d]["items"] = sorted({m["item_id"] for m in found[d]["matches"]})
        yield from found


def annotate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, name: str = "_found", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one more column ``name``: n_words, hits (word ranges), items, and per test suffix its longest match."""
    listed = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text"))
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out, columns = docs, []
    arrow = pa.struct([
        ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())),
        ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))),
    ])
    for block in range(blocks):
        rows = listed.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # about block_bytes of text
        shared = docs.sparkSession.sparkContext.broadcast(TestSet([r["id"] for r in rows], [r["text"] for r in rows], window))
        columns.append(f"{name}_{block}")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=(*out.columns, columns[-1])) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                added = pa.array(list(_judge(shared.value, batch.column(text))), arrow)
                yield pa.RecordBatch.from_arrays([*batch.columns, added], names=list(names))

        out = out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(columns[-1], FOUND)]))
    joined = F.struct(
        F.col(f"{columns[0]}.n_words").alias("n_words"),
        *[F.concat(*[F.col(f"{c}.{part}") for c in columns]).alias(part) for part in ("hits", "items", "matches")],
    )
    return out.withColumn(name, joined).drop(*columns)


def covered(hits: Column) -> Column:
    """Number of words inside any of the ranges."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))).alias("n")
    )
    return F.aggregate(F.array_sort(hits), start, step, lambda acc: acc["n"])
