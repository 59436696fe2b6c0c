"""Steps that once cost more than their input: what they hand on, and that their rows stay the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import decode, funding, intel, research
from tidepool.plans import attendees
from tidepool.plans.queries_research import _in_files
from tidepool.runtime import skew_join
from tidepool.sources.dex import SWAP_V2
from tidepool.streaming import ingest


def test_walk_hands_on_only_wallets_that_lead_on(spark, monkeypatch):
    pairs = [("a", "hub"), ("b", "hub"), ("a", "x"), ("x", "y"), ("y", "a"), ("b", None), (None, "x")]
    edges = spark.createDataFrame([(w, f, i, False) for i, (w, f) in enumerate(pairs)], "wallet STRING, funder STRING, position INT, is_public BOOLEAN")
    start = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b"), ("q", None)], "pool_address STRING, wallet STRING")
    handed, real = [], funding.unseen_nodes

    def watched(candidates, visited, keys):
        handed.append({r[1] for r in candidates.select(*keys).collect()})
        return real(candidates, visited, keys)

    monkeypatch.setattr(funding, "unseen_nodes", watched)
    rows = funding.funding_walk(start, edges, ["pool_address"])
    assert handed == [{"x"}, {"y"}, {"a"}]  # hub and NULL have no funders
    assert sorted((r.pool_address, r.wallet, r.funder or "", r.hop) for r in rows.collect()) == [
        ("p", "a", "hub", 0), ("p", "a", "x", 0), ("p", "b", "", 0), ("p", "b", "hub", 0), ("p", "x", "y", 1), ("p", "y", "a", 2), ("q", "b", "", 0), ("q", "b", "hub", 0)]
    assert rows.columns == ["wallet", "pool_address", "funder", "position", "is_public", "hop"]


def test_first_position_of_a_trader_needs_no_sort(spark):
    top = (1 << 63) - 1
    seen = [("t", 5, 3), ("t", 5, 2), ("t", 6, 1), ("n", None, 3), ("n", -3, 1), ("m", 7, None), ("m", 7, 0), ("x", top, (1 << 62) - 2), ("y", -5, 0), ("y", -5, -4),
            ("z", 0, 0), ("q", None, None), ("l", -top - 1, 4)]
    rows = spark.createDataFrame([("p", t, 1, b, i) for t, b, i in seen], "pool_address STRING, trader STRING, quote_raw BIGINT, block_number BIGINT, log_index BIGINT")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(0)))
    found = intel.trader_activity(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    want = rows.groupBy("trader").agg(F.min(F.struct("block_number", "log_index")).alias("s")).select("trader", "s.*")
    assert {tuple(r) for r in found.select("trader", "first_block", "first_log_index").collect()} == {tuple(r) for r in want.collect()}


def test_undecodable_logs_are_dropped_before_decoding(spark):
    whole, topic = "0x" + "0" * 63 + "7" + "0" * 192, "0x" + "1" * 64
    logs = spark.createDataFrame(
        [("0xA", [SWAP_V2, topic, topic], whole), ("0xA", [SWAP_V2, topic, topic], whole[:100]), ("0xA", [SWAP_V2], whole), ("0xA", None, whole), ("0xA", [SWAP_V2, topic, topic], None), ("0xA", ["0x0"], whole)],
        "address STRING, topics ARRAY<STRING>, data STRING").withColumn("tx_hash", F.lit("0xH"))
    kept = decode.tag_swaps(logs, F.lit(True), only=True)
    every = decode.tag_swaps(logs, F.lit(True)).filter("side IS NOT NULL")
    assert kept.columns == every.columns
    assert kept.collect() == every.collect() and kept.count() == 1
    # Read once more by the filter, an amount would stand there too.
    plan = decode.decode_swaps_v2(logs, F.lit(True))._jdf.queryExecution().optimizedPlan().toString()
    assert all("substr(" not in line for line in plan.splitlines() if "Filter" in line)


def test_chain_of_skew_joins_makes_each_step_once(skewed):
    dims = [skewed.createDataFrame([(i, i * 10 + n) for i in range(3)] + [(None, 5)], f"k INT, d{n} INT") for n in range(3)]
    facts = skewed.createDataFrame([(i % 4, i) for i in range(6)] + [(None, 9)], "k INT, v INT")
    got, want = facts, facts
    for dim in dims:
        got, want = skew_join(got, dim, "k", "left"), want.join(dim, "k", "left")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "hot-facts" in got.inputFiles()[0]


def test_late_rows_are_made_by_all_tasks(spark, tmp_path):
    rows = spark.range(0, 80, 1, 8).withColumn("made_in", F.spark_partition_id())
    _in_files(rows, F.col("id") % 2 == 0, "id", str(tmp_path / "in"))
    written = spark.read.parquet(str(tmp_path / "in")).withColumn("file", F.input_file_name()).collect()
    late = [r for r in written if r.id % 2 == 0]
    assert sorted(r.id for r in written) == list(range(80))
    assert len({r.file for r in late}) == 1 and len({r.file for r in written}) == 5
    assert {r.made_in for r in late} == set(range(8))


def test_analysis_makes_its_launches_once(spark, monkeypatch):
    monkeypatch.setattr(attendees.ops, "build_pool_graph", lambda launches, *_, **__: launches)
    monkeypatch.setattr(attendees.ops, "classify_attendees", lambda traders, graph: traders)
    pools = spark.createDataFrame([("p", "t0"), ("p", "t0"), (None, "t1")], "pool_address STRING, quote STRING")
    launches = pools.join(spark.createDataFrame([("t0", 2.0)], "quote STRING, price_usd DOUBLE"), "quote", "left")
    labels = spark.createDataFrame([], "address STRING, kind STRING")
    done = attendees.analyse(launches, pools, None, labels)
    assert sorted(map(repr, done.launches.collect())) == sorted(map(repr, launches.collect()))
    assert done.graph is done.launches and "Join" not in done.launches._jdf.queryExecution().optimizedPlan().toString()


def test_walk_writes_its_edges_only_when_asked(spark, monkeypatch):
    names, real = [], research.stage

    def watched(df, name):
        names.append(name)
        return real(df, name)

    monkeypatch.setattr(research, "stage", watched)
    pairs = [("a", "x"), ("b", "x"), ("c", "b"), ("x", None)]
    edges = spark.createDataFrame([(w, f, "external", f"{w}<", i) for i, (w, f) in enumerate(pairs)], "wallet STRING, funder STRING, via STRING, tx_hash STRING, position INT")
    walk = research.research_walk(spark.createDataFrame([("a",)], "seed STRING"), edges, 2)
    assert names.count("research-frontier") == 1 and "research-edges" not in names
    assert {tuple(r) for r in walk.edges.collect()} == {("a", "a", "x"), ("a", "b", "x"), ("a", "x", None)} and walk.edges.count() == 3
    assert walk.edges is walk.edges and names.count("research-edges") == 1
    assert [tuple(r) for r in walk.complete.collect()] == [("a", False)]
    assert sorted((r.address, r.hops, r.direction) for r in walk.nodes.collect()) == [("a", 0, "seed"), ("b", 2, "funded"), ("x", 1, "funder")]


def test_batch_of_few_files_is_decoded_by_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.createDataFrame([(i, ["t", None]) for i in range(40)] + [(3, ["t", None]), (None, None)], "id INT, topics ARRAY<STRING>").coalesce(1)
    wide = ingest._spread(one)
    assert wide.rdd.getNumPartitions() == cores and sorted(map(repr, wide.collect())) == sorted(map(repr, one.collect()))
    assert ingest._spread(wide) is wide
