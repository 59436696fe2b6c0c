"""Sampled splitters: cut records into shards of near equal bytes by ranges of a key.

1. Every record is drawn with a chance in proportion to its size (by a hash, so reruns draw the same), which gives
   about ``SAMPLES`` keys whatever the input; quantiles of the weighted sample are the range boundaries.
2. Ranges are measured; a range with more than twice the mean size gets a sample and boundaries of its own.
3. Records are numbered and their sizes summed inside each range only; the offsets of the ranges (a table as small
   as the boundaries) make that the exact place in the whole order. A shard is a stretch of equal bytes of it.

Keys that many records share are told apart by a hash, so one key may hold any part of the input.

Defined cases: NULL text counts 8 bytes and has CRC 0; a NULL key comes first; records that are alike in key, size
and CRC are interchangeable; fewer records than shards leave shards empty; no records give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.runtime import stage, stage_table

SHARDS = 24
RANGES = 1024
SAMPLES = 16_384
ROUNDS = 4


def _sort_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs of longs as 16-byte strings that compare alike."""
    flip = np.uint64(1 << 63)
    both = np.empty((len(first), 2), ">u8")
    both[:, 0] = first.view(np.uint64) ^ flip
    both[:, 1] = second.view(np.uint64) ^ flip
    return both.view("S16").reshape(-1)


def _boundaries(keys: np.ndarray, sizes: np.ndarray, parts: int) -> np.ndarray:
    """Keys at the weighted quantiles."""
    order = np.argsort(keys, kind="stable")
    rising = np.cumsum(sizes[order])
    cuts = np.searchsorted(rising, rising[-1] * np.arange(1, parts) / parts) if len(rising) else []
    return np.unique(keys[order][cuts]) if len(cuts) else keys[:0]


def _with_range(df: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds ``_range``: the number of splitters at or below the record's key."""
    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _sort_keys(*(np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("_k", "_tie")))
            found = np.searchsorted(splitters, keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "_range"])

    return df.mapInArrow(assign, schema)


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards in order of ``key`` (a BIGINT column; doc_id by default)."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), crc.alias("text_crc32"),
        F.coalesce(F.col(key or doc_id).cast("long"), F.lit(-(1 << 63))).alias("_k"),
    )
    slim = slim.withColumn("_tie", F.xxhash64("doc_id", "text_crc32", "size"))
    table = stage_table(slim, "shard-slim", size=F.sum("size"))
    total = table.metrics["size"] or 0

    def drawn(rows: DataFrame, weight: int, samples: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        chance = F.least(F.lit(1.0), F.col("size") * (samples / max(1, weight)))
        picked = rows.filter(F.pmod(F.xxhash64("_tie", "_k", F.lit(salt)), F.lit(1 << 40)) < chance * (1 << 40)).select("_k", "_tie", "size").toPandas()
        return _sort_keys(picked["_k"].to_numpy(np.int64), picked["_tie"].to_numpy(np.int64)), np.maximum(picked["size"].to_numpy(float), weight / samples)

    splitters = _boundaries(*drawn(table.df, total, SAMPLES, 0), ranges)
    for round_ in range(1, ROUNDS + 1):
        placed = stage(_with_range(table.df, splitters), "shard-ranges")
        measured = placed.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.countDistinct("_k", "_tie").alias("keys")).toPandas().sort_values("_range")
        overfull = measured[(measured["bytes"] > 2 * total / ranges) & (measured["keys"] > 1)]
        if overfull.empty or round_ == ROUNDS:
            break
        wide = placed.filter(F.col("_range").isin(overfull["_range"].tolist()))
        weight = int(overfull["bytes"].sum())
        samples = 16 * int(np.ceil(weight * ranges / total))
        splitters = np.union1d(splitters, _boundaries(*drawn(wide, weight, samples, round_), max(2, samples // 8)))
    offsets = {name: np.zeros(len(splitters) + 1, np.int64) for name in ("bytes", "rows")}
    for name, at in offsets.items():
        at[measured["_range"].to_numpy(int)] = measured[name].to_numpy(np.int64)
        at[:] = np.cumsum(at) - at
    starts = placed.sparkSession.createDataFrame(
        [(k, int(b), int(r)) for k, (b, r) in enumerate(zip(offsets["bytes"], offsets["rows"], strict=True))], "_range int, _bytes long, _rows long"
    )
    order = Window.partitionBy("_range").orderBy("_k", "_tie", "doc_id", "size", "text_crc32")
    sums = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.select("doc_id", "size", "text_crc32", "_range", F.row_number().over(order).alias("_n"), F.sum("size").over(sums).alias("_upto"))
    middle = F.col("_bytes") + F.col("_upto") - F.col("size") / 2
    numbered = numbered.join(F.broadcast(starts), "_range").select(  # one row per range: at most a few times ``ranges``
        "doc_id", "size", "text_crc32", F.least(F.floor(middle * shards / max(1, total)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("_rows") + F.col("_n") - 1).alias("_row"),
    )
    numbered = stage(numbered, "shard-numbered")
    first = numbered.groupBy("shard").agg(F.min("_row").alias("_first"))
    return numbered.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
