"""Members of the pools' graphs: one pass over whole pools, and the joins for pools beyond a task (F4 to F8)."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import components, intel
from tidepool.plans import attendees
from tidepool.runtime import stage

EDGE = "wallet STRING, funder STRING, position INT"


def world(spark, seed):
    rng = random.Random(seed)
    names = [f"w{i:02d}" for i in range(50)]
    edges = [(w, f, at) for w in names for at, f in enumerate(rng.sample([None, "hub", "é", *names], rng.randrange(5))) if f != w]
    launches = [("p1", "w03"), ("p2", "hub"), ("p3", None), ("p4", "unfunded"), ("p4", "w05"), ("p1", "w03"), (None, "w01")]
    traders = [(p, t) for p in ("p1", "p2", "p3", "p4", "p5", None) for t in [*rng.sample(names, 12), "stranger", None]]
    return (
        spark.createDataFrame(launches, "pool_address STRING, creator STRING"),
        spark.createDataFrame(traders, "pool_address STRING, trader STRING"),
        spark.createDataFrame(edges, EDGE),
        spark.createDataFrame([("w11",), ("loner",)], "address STRING"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_members_in_one_pass_equal_those_by_joins(spark, monkeypatch, seed):
    monkeypatch.setattr(components, "SOLVED_AT_ONCE", 9)
    passed, joined, real = [], [], intel._members

    def both(core, walked, links):
        passed.append(intel._members_by_pool(core, walked, links))
        joined.append(intel._members_by_joins(core, walked, links))
        return real(core, walked, links)

    monkeypatch.setattr(intel, "_members", both)
    launches, traders, edges, bots = world(spark, seed)
    intel.build_pool_graph(launches, traders, edges, bots, threshold=7, seeds=[])
    rows = [sorted(map(repr, found[0].filter("pool_address IS NOT NULL AND node IS NOT NULL").collect())) for found in (passed, joined)]
    assert rows[0] == rows[1] and any("same=True" in r for r in rows[0]) and any("has_bot=True" in r for r in rows[0])


def test_large_pools_go_by_joins(spark, monkeypatch):
    core = spark.createDataFrame([("p", "c", w) for w in ("c", "t", "u")] + [("q", "d", w) for w in "defghijk"], "pool_address STRING, creator STRING, wallet STRING")
    walked = spark.createDataFrame([("p", "c", "t", "c", 1, False, 0, True, 1)],
                                   "pool_address STRING, creator STRING, wallet STRING, funder STRING, position INT, is_public BOOLEAN, hop INT, _first BOOLEAN, _funders BIGINT")
    links = spark.createDataFrame([("q", "e", "bot", True), ("q", "f", "bot", True)], "pool_address STRING, wallet STRING, funder STRING, has_bot BOOLEAN")
    whole = sorted(map(repr, intel._members(core, walked, links).collect()))
    asked, real = [], intel._members_by_joins
    monkeypatch.setattr(components, "GROUP_EDGES", 5)
    monkeypatch.setattr(intel, "_members_by_joins", lambda *parts: (asked.append(parts[0].select("pool_address").distinct().collect()), real(*parts))[1])
    assert sorted(map(repr, intel._members(core, walked, links).collect())) == whole
    assert [[r[0] for r in rows] for rows in asked] == [["q"]]


def test_classes_take_no_joins_on_pool_and_funder(spark):
    """The traders meet one table of members: no second join for their funders, none for the marks of components."""
    launches, traders, edges, bots = world(spark, 1)
    graph = intel.build_pool_graph(launches, traders, edges, bots, threshold=7, seeds=[])
    plan = intel.classify_attendees(traders, graph)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan


def test_first_edge_and_number_of_funders(spark):
    rows = [("a", "x", 2), ("a", "y", 1), ("b", "x", None), ("c", None, 1), ("c", "z", 2)]
    got = intel._with_first(spark.createDataFrame(rows, EDGE)).filter("_first").select("wallet", "funder", "_funders").collect()
    assert sorted(map(tuple, got)) == [("a", "y", 2), ("b", "x", 1), ("c", None, 2)]


def test_a_staged_table_is_not_staged_again(spark):
    first = stage(spark.range(3).toDF("n"), "once")
    assert stage(first, "twice") is first
    assert stage(first.filter("n > 0"), "other").count() == 2


def test_small_rings_leave_the_traders_where_they_are(spark, monkeypatch):
    written = []
    monkeypatch.setattr(attendees, "stage", lambda df, name: (written.append(name), stage(df, name))[1])
    edges = spark.createDataFrame([(t, "f", 1) for t in ("a", "b", "c")], EDGE)
    traders = spark.createDataFrame([("p", t, n, float(n), 1, 1, n) for n, t in enumerate(("a", "b", "c", "d"))],
                                    "pool_address STRING, trader STRING, quote_raw BIGINT, quote_total DOUBLE, trade_count BIGINT, first_block BIGINT, first_log_index BIGINT")
    traders = traders.withColumns({"quote_key": F.col("quote_raw"), "first_trade_at": F.lit("2001-01-01").cast("timestamp_ntz")})
    launches = spark.createDataFrame([("p", "x", "d", 1.0, 2, 1.0)], "pool_address STRING, creator STRING, dex STRING, volume_usd DOUBLE, quote_decimals INT, price_usd DOUBLE")
    launches = launches.withColumn("created_at", F.lit("2001-01-01").cast("timestamp_ntz"))
    done = attendees.analyse(launches, traders, edges, spark.createDataFrame([], "address STRING, kind STRING"))
    report = attendees.report(done, edges, edges.select(F.col("wallet").alias("address")), F.lit("2001-01-01").cast("timestamp_ntz"))
    assert [(r.cluster_id, r.member_count, r.funding_source) for r in report.clusters.collect()] == [(1, 3, "f")]
    assert {r.address: r.cluster_id for r in report.buyers.collect()} == {"a": 1, "b": 1, "c": 1, "d": None}
    assert "clustered" not in written


def test_the_graph_asks_once_for_every_nodes_funders(skewed, monkeypatch):
    """Large rings do not write the traders again, a hop's funders serve its edges too, and later hops read only wallets that fund."""
    spark, written, drawn = skewed, [], []
    monkeypatch.setattr(attendees, "stage", lambda df, name: (written.append(name), stage(df, name))[1])
    monkeypatch.setattr(intel, "stage", lambda df, name: (drawn.append((name, df)), stage(df, name))[1])
    edges = spark.createDataFrame([*[(t, "f", 1) for t in ("a", "b", "c")], ("a", "e", 2), ("f", "g", 1), ("g", "h", 1), ("h", "i", 1), ("i", "j", 1), ("d", "b", 1), ("lone", "f", 1), ("k", None, 1)], EDGE)
    traders = spark.createDataFrame([("p", t, n, float(n), 1, 1, n) for n, t in enumerate(("a", "b", "c", "d", "k"))],
                                    "pool_address STRING, trader STRING, quote_raw BIGINT, quote_total DOUBLE, trade_count BIGINT, first_block BIGINT, first_log_index BIGINT")
    traders = traders.withColumns({"quote_key": F.col("quote_raw"), "first_trade_at": F.lit("2001-01-01").cast("timestamp_ntz")})
    launches = spark.createDataFrame([("p", "x", "d", 1.0, 2, 1.0)], "pool_address STRING, creator STRING, dex STRING, volume_usd DOUBLE, quote_decimals INT, price_usd DOUBLE")
    launches = launches.withColumn("created_at", F.lit("2001-01-01").cast("timestamp_ntz"))
    done = attendees.analyse(launches, traders, edges, spark.createDataFrame([], "address STRING, kind STRING"))
    report = attendees.report(done, edges, edges.select(F.col("wallet").alias("address")), F.lit("2001-01-01").cast("timestamp_ntz"))
    want = {("a", "e"), ("a", "f"), ("b", "f"), ("c", "f"), ("d", "b"), ("f", "g"), ("g", "h")}
    assert {(r.from_address, r.to_address) for r in report.edges.collect()} == want
    assert "clustered" not in written and [name for name, _ in drawn].count("graph-met") == 3
    assert "_funds" in done.graph.edges.columns
    assert {r.wallet for r in done.graph.edges.filter("_funds").collect()} == {"b", "f", "g"}
