import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepool.functions.text import choice_param, clamp_param, decode_cursor, encode_cursor, optional_number
from tidepool.operators import listing, stats, upsert

SCHEMA = "id STRING, dex STRING, pool_address STRING, creator STRING, pair STRING, created_at TIMESTAMP, block_number BIGINT, pool_type STRING, liquidity_usd DOUBLE, volume_usd DOUBLE, external_volume_usd DOUBLE, intel_updated_at TIMESTAMP"
DAY = dt.datetime(2024, 5, 10, 12)


def launch(n, volume=1.0, block=None, creator="w1", pair="A / B", intel=None, external=None, created=DAY, dex="d"):
    return (f"p{n}", dex, f"p{n}", creator, pair, created, n if block is None else block, "x", volume, volume, external, intel)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def chain(df, sort, limit, **options):
    seen, cursor = [], None
    while True:
        page = listing.launch_page(df, sort, limit, cursor, **options).collect()
        seen += [r["id"] for r in page[:limit]]
        cursor = listing.next_cursor(page, sort, limit)
        if cursor is None:
            return seen


def test_pages_chain_without_gaps_or_repeats(spark):
    df = frame(spark, [launch(i, volume=float(i % 4), block=i % 3) for i in range(11)])
    for sort, key in [("newest", lambda i: (-(i % 3),)), ("oldest", lambda i: (i % 3,)), ("volume", lambda i: (-(i % 4),))]:
        ids = sorted((f"p{i}" for i in range(11)), reverse=True)
        expected = sorted(ids, key=lambda p: key(int(p[1:])))
        assert chain(df, sort, 3) == expected


def test_null_metrics_only_on_the_first_page_unless_asked(spark):
    df = frame(spark, [launch(1, 5.0), launch(2, None), launch(3, None), launch(4, None)])
    assert chain(df, "volume", 2) == ["p1", "p4"]
    assert chain(df, "volume", 2, null_tail=True) == ["p1", "p4", "p3", "p2"]


def test_real_volume_needs_analysis(spark):
    df = frame(spark, [launch(1, external=9.0), launch(2, external=3.0, intel=DAY), launch(3, intel=DAY)])
    assert chain(df, "realVolume", 5) == ["p2"]


def test_search_is_literal(spark):
    df = frame(spark, [launch(1, pair="a.*+?()[]b"), launch(2, pair="axxb"), launch(3, pair="É / q")])
    assert [r["id"] for r in listing.search_launches(df, "  .*+?()[] ").collect()] == ["p1"]
    assert [r["id"] for r in listing.search_launches(df, "é").collect()] == ["p3"]
    assert listing.search_launches(df, "   ").count() == 3


def test_cursor_round_trip_and_errors():
    assert decode_cursor(encode_cursor(None, "p1")) == (-1, "p1")
    assert decode_cursor(encode_cursor("2024", "w", "address"), "address", text_values=True) == ("2024", "w")
    for bad in ["???", encode_cursor("text", "p1"), encode_cursor(1, ""), encode_cursor(True, "p")]:
        with pytest.raises(ValueError):
            decode_cursor(bad)


def test_parameters():
    assert [clamp_param(v, 30, 1, 100) for v in (None, "x", 0, "0", "", -5, 500, "12", 2.5)] == [30, 30, 30, 30, 30, 1, 100, 12, 2.5]
    assert [optional_number(v) for v in (None, "", "-1", "inf", "0", "2.5")] == [None, None, None, None, 0.0, 2.5]
    assert choice_param("cheap", ["newest"], "newest") == "newest"


def test_creator_pages(spark):
    df = frame(spark, [launch(i, creator=f"w{i % 5}", created=DAY + dt.timedelta(hours=i)) for i in range(13)])
    for sort in listing.CREATOR_SORTS:
        page = listing.creator_page(df, sort, 2).collect()
        rest = listing.creator_page(df, sort, 10, listing.next_cursor(page, sort, 2, creators=True)).collect()
        assert [r["address"] for r in page[:2]] + [r["address"] for r in rest] == [r["address"] for r in listing.creator_page(df, sort, 10).collect()]


def test_empty_day_gives_zeros(spark):
    row = stats.day_fake_volume(stats.day_stats(frame(spark, [launch(1)]), F.lit("2030-01-01").cast("timestamp"))).head()
    assert (row["day_launch_count"], row["day_volume_usd"], row["day_active_creators"], row["day_fake_volume_usd"], row["day_fake_pct"]) == (0, 0.0, 0, 0.0, 0)


def test_unanalysed_external_volume_is_not_real(spark):
    df = frame(spark, [launch(1, 50.0, external=40.0), launch(2, 500.0, external=400.0, intel=DAY)])
    row = stats.day_stats(df, F.lit(DAY).cast("timestamp")).head()
    assert (row["day_real_volume_usd"], row["day_analyzing_volume_usd"], row["day_launch_count_min_volume"]) == (400.0, 50.0, 1)


def test_daily_series_is_gap_filled_and_ends_today(spark):
    df = frame(spark, [launch(1), launch(2, created=DAY + dt.timedelta(days=3)), launch(3, created=DAY - dt.timedelta(days=60))])
    points = stats.daily_analytics(df, F.lit(DAY).cast("timestamp"), 7).orderBy("date").collect()
    assert len(points) == 7 and points[-1]["launch_count"] == 1 and sum(r["launch_count"] for r in points) == 1
    summary = stats.daily_summary(stats.daily_analytics(df, F.lit("2030-01-01").cast("timestamp"), 7)).head()
    assert summary["busiest_day"] == dt.date(2029, 12, 26) and summary["avg_launches"] == 0.0


# ---- table maintenance

def test_upsert_touches_only_given_columns_and_replays(spark):
    target = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k STRING, x INT, y INT")
    updates = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("c", 9, 1)], "k STRING, x INT, n INT")
    once = upsert.upsert(target, updates, ["k"], ["x"], order=["n"])
    expected = [("a", 7, 10), ("b", 2, 20), ("c", 9, None)]
    assert sorted(map(tuple, once.collect())) == expected
    assert sorted(map(tuple, upsert.upsert(once, updates, ["k"], ["x"], order=["n"]).collect())) == expected
    assert sorted(map(tuple, upsert.upsert(target, updates, ["k"], ["x"], insert=False, order=["n"]).collect())) == expected[:2]


def test_reingest_keeps_metrics_unless_told(spark):
    cols = "pool_address STRING, pair STRING, liquidity_usd DOUBLE, volume_usd DOUBLE, first_trades BIGINT, risk STRING, insider_ratio DOUBLE"
    old = spark.createDataFrame([("p", "A", 1.0, 2.0, 3, "low", 0.5)], cols)
    new = spark.createDataFrame([("p", "B", None, None, None, "unrated", None), ("q", "C", None, None, None, "unrated", None)], cols)
    kept = {r["pool_address"]: tuple(r) for r in upsert.upsert_launches(old, new).collect()}
    assert kept == {"p": ("p", "B", 1.0, 2.0, 3, "low", 0.5), "q": ("q", "C", None, None, None, "unrated", None)}
    reset = {r["pool_address"]: tuple(r) for r in upsert.upsert_launches(old, new, overwrite_metrics=True).collect()}
    assert reset["p"] == ("p", "B", None, None, None, "unrated", 0.5)


def test_fallback_market_data_leaves_real_volume(spark):
    old = spark.createDataFrame([("p", 1.0, 2.0, 1.5, 0.5, None)], "pool_address STRING, liquidity_usd DOUBLE, volume_usd DOUBLE, external_volume_usd DOUBLE, insider_volume_usd DOUBLE, market_data_updated_at TIMESTAMP")
    data = spark.createDataFrame([("p", 9.0, 8.0, DAY)], "pool_address STRING, liquidity_usd DOUBLE, volume_usd DOUBLE, market_data_updated_at TIMESTAMP")
    assert tuple(upsert.save_market_data(old, data).head())[:5] == ("p", 9.0, 8.0, 1.5, 0.5)


def test_labels(spark):
    address = "0x" + "Ab" * 20
    labels = spark.createDataFrame([(address.lower(), "watch", "old", DAY)], "address STRING, kind STRING, note STRING, created_at TIMESTAMP")
    asked = spark.createDataFrame([(f" {address} ", "rug-bot", "  "), ("0x1", "watch", None), ("0x" + "1" * 40, "friend", None)], "address STRING, kind STRING, note STRING")
    good = upsert.checked_labels(asked)
    assert good.count() == 1
    row = upsert.set_labels(labels, good, F.lit("2030-01-01").cast("timestamp")).collect()
    assert [tuple(r) for r in row] == [(address.lower(), "rug-bot", None, DAY)]
    assert upsert.remove_labels(labels, spark.createDataFrame([(address,)], "address STRING")).count() == 0


def test_prepare_index(spark):
    launches = spark.createDataFrame([("a", "d", 5), ("b", "d", 50), ("c", "e", 1), ("x", None, 1)], "id STRING, dex STRING, block_number BIGINT")
    state = spark.createDataFrame([("d-pools", 60, 6), ("e-pools", 3, 6)], "id STRING, indexed_block BIGINT, version INT")

    def run(**kw):
        kept, after = upsert.prepare_index(launches, state, "d", 10, **kw)
        return sorted(r["id"] for r in kept.collect()), {r["id"]: (r["indexed_block"], r["version"]) for r in after.collect()}

    assert run() == (["b", "c", "x"], {"d-pools": (60, 6), "e-pools": (3, 6)})
    assert run(version=7) == (["c", "x"], {"d-pools": (9, 7), "e-pools": (3, 6)})
    assert run(version=7, default_dex=True) == (["c"], {"d-pools": (9, 7), "e-pools": (3, 6)})
    assert upsert.indexed_block(state, "new", 41).head()[0] == 41
    moved = upsert.save_indexed_block(state, "d", 99)
    assert upsert.indexed_block(moved, "d", 0).head()[0] == 99
