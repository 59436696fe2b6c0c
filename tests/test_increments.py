"""Streams and merges whose work follows the batch, not the table."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidepool.operators import stats, upsert
from tidepool.sources.bucketed import BucketedTable
from tidepool.streaming import inflows, rolling

T0 = dt.datetime(2024, 1, 1)
ROW = "dex STRING, pool_address STRING, block_number BIGINT, volume_usd DOUBLE, pair STRING"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_small_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    schema = spark.createDataFrame([], ROW).schema
    table = BucketedTable(spark, str(tmp_path / "t"), schema, bucket_blocks=100)
    merge = lambda rows, *more: table.merge(spark.createDataFrame(rows, ROW), lambda old, new: upsert.upsert(old, new, ["pool_address"], ["dex", "block_number", "pair", *more], order=["block_number"]))
    assert table.read().count() == 0 and merge([]) == 0
    merge([(d, f"p{i}", i, float(i), "old") for i in range(2000) for d in ("x",)], "volume_usd")
    before = files(tmp_path / "t")
    assert merge([("x", f"p{i}", i, None, "new") for i in range(1995, 2005)]) == 2
    after = files(tmp_path / "t")
    kept = {f for f, at in before.items() if after.get(f) == at}
    assert len(before) == 20 and len(kept) == 19 and len(after) == 21
    got = {r["pool_address"]: (r["pair"], r["volume_usd"]) for r in table.read().collect()}
    assert len(got) == 2005 and got["p1995"] == ("new", 1995.0) and got["p3"] == ("old", 3.0) and got["p2004"] == ("new", None)
    assert merge([("x", f"p{i}", i, None, "new") for i in range(1995, 2005)]) == 2 and table.read().count() == 2005  # a replay


def test_a_key_that_moves_leaves_its_old_bucket(spark, tmp_path):
    schema = spark.createDataFrame([], ROW).schema
    table = BucketedTable(spark, str(tmp_path / "t"), schema, bucket_blocks=10)
    apply = lambda old, new: upsert.upsert(old, new, ["pool_address"], ["dex", "block_number", "pair"], order=["block_number"])
    whole = lambda old, new: upsert.upsert(old, new, ["pool_address"], ["dex", "block_number", "pair", "volume_usd"])
    table.merge(spark.createDataFrame([("x", "a", 5, 1.0, "p"), ("x", "b", 15, 2.0, "p"), (None, "c", None, 3.0, "p")], ROW), whole)
    table.merge(spark.createDataFrame([("x", "a", 25, None, "q"), (None, "c", None, None, "q"), ("x", None, 5, None, "none")], ROW), apply)
    assert sorted(tuple(r) for r in table.read().select("pool_address", "block_number", "volume_usd", "pair").collect()) == [("a", 25, 1.0, "q"), ("b", 15, 2.0, "p"), ("c", None, 3.0, "q")]


TRANSFER = "seq BIGINT, hash STRING, sender STRING, recipient STRING, value STRING, is_error BOOLEAN, via STRING, ts TIMESTAMP"


def test_first_inflows_write_what_a_batch_touches(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, TRANSFER).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], TRANSFER).schema).parquet(str(tmp_path / "in"))
        inflows.stream_first_inflows(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        return {(r["wallet"], r["other"]): (r["hash"], r["value"]) for r in inflows.read_first_inflows(spark, str(tmp_path / "out")).collect()}

    assert inflows.read_first_inflows(spark, str(tmp_path / "none")).count() == 0
    hour = lambda h: T0 + dt.timedelta(hours=h)
    big = str(2**80 + 1)
    many = [(i, f"h{i}", "F", f"w{i}", "1", False, "external", hour(5)) for i in range(3000)]
    assert len(run([*many, (9000, "self", "w1", "W1", "1", False, "external", hour(1)), (9001, "zero", "f", "w1", "0", False, "external", hour(1)), (9002, "bad", "f", "w1", "1", True, "external", hour(1))])) == 3000
    sizes = [sum(os.path.getsize(p) for p in Path(tmp_path / "out" / "batch_id=0").glob("*.parquet"))]
    got = run([(1, "early", "f", "W7", big, False, "internal", hour(2)), (2, "late", "f", "w8", "3", False, "external", hour(9))])
    assert got["w7", "f"] == ("early", big) and got["w8", "f"] == ("h8", "1") and len(got) == 3000
    sizes.append(sum(os.path.getsize(p) for p in Path(tmp_path / "out" / "batch_id=1").glob("*.parquet")))
    assert spark.read.parquet(str(tmp_path / "out" / "batch_id=1")).count() == 2 and sizes[1] < sizes[0] / 4


@pytest.mark.parametrize("settle", [(), (0,), (0, 1, 2)])
def test_rolling_volume_keeps_late_rows_and_open_windows(spark, tmp_path, settle):
    schema = "pool_address STRING, amount BIGINT, ts TIMESTAMP"
    hour = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[("p", 1, hour(0.5)), ("p", 2, hour(0.6)), ("q", 5, hour(1))], [("p", 10, hour(40)), ("p", 7, None)], [("p", 100, hour(0.7)), ("q", 50, hour(41))]]
    volume = rolling.RollingVolume(spark, str(tmp_path / "out"), "3 hours", "1 hour")
    assert volume.windows().count() == 0 and volume.late().count() == 0
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
        volume.start(stream, str(tmp_path / "c")).awaitTermination()
        if n in settle:
            volume.settle()
    got = {(r["pool_address"], (r["window_start"] - T0).total_seconds() / 3600): (r["volume"], r["swaps"]) for r in volume.windows().collect()}
    want = {}
    for pool, amount, ts in (r for b in batches for r in b):
        for back in range(3 if ts else 0):
            key = pool, (ts - T0).total_seconds() // 3600 - back
            want[key] = (want.get(key, (0, 0))[0] + amount, want.get(key, (0, 0))[1] + 1)
    assert got == want
    assert [tuple(r) for r in volume.late().collect()] == [("p", 1, 1)]




def test_kept_rollups_follow_replays_and_moves(spark, tmp_path):
    ddl = "dex STRING, pool_address STRING, block_number BIGINT, volume_usd DOUBLE, creator STRING, created_at TIMESTAMP"
    schema = spark.createDataFrame([], ddl).schema
    table = BucketedTable(spark, str(tmp_path / "t"), schema, bucket_blocks=10, rollups={"creators": stats.creator_parts, "days": stats.daily_parts})
    assert table.rollup("creators").count() == 0
    day = lambda d: T0 + dt.timedelta(days=d)
    batches = [
        [("x", "a", 5, 1.0, "w1", day(0)), ("x", "b", 15, 2.0, "w1", day(1)), ("y", "c", 25, None, "w2", day(1))],
        [("x", "a", 5, 4.0, "w1", day(3)), ("y", "c", 45, 8.0, "w3", day(2))],  # replaced, and moved to another bucket and creator
        [("x", "a", 5, 4.0, "w1", day(3)), ("x", "d", 46, 16.0, "w1", day(2))],  # a replay, and a new one
    ]
    for rows in batches:
        table.merge(spark.createDataFrame(rows, ddl), lambda old, new: upsert.upsert(old, new, ["pool_address"], ["dex", "block_number", "volume_usd", "creator", "created_at"]))
        got = sorted(tuple(r) for r in stats.creator_rollup_of(table.rollup("creators")).select("address", "launch_count", "first_launch_at", "last_launch_at").collect())
        assert got == sorted(tuple(r) for r in stats.creator_rollup(table.read()).select("address", "launch_count", "first_launch_at", "last_launch_at").collect())
        until = F.lit(day(5))
        assert stats.daily_analytics_of(table.rollup("days"), until, 7).orderBy("date").collect() == stats.daily_analytics(table.read(), until, 7).orderBy("date").collect()
    assert sorted(r["address"] for r in stats.creator_rollup_of(table.rollup("creators")).collect()) == ["w1", "w3"]
