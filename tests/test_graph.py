"""Funding graph against small brute-force models."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import funding, intel, research
from tidepool.operators.components import connected_components
from tidepool.plans import attendees
from tidepool.runtime import stage

EDGE = "wallet STRING, funder STRING, via STRING, tx_hash STRING, position BIGINT"


class Sets:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def edge_rows(funders):
    return [(w, f, "external", f"{w}<{f}", i + 1) for w, fs in sorted(funders.items()) for i, f in enumerate(fs)]


def random_funders(rng, wallets, most):
    names = [f"w{i:02d}" for i in range(wallets)]
    return {w: [f for f in rng.sample(names, rng.randrange(most + 1)) if f != w] for w in names}


def check_components(spark, seed):
    rng = random.Random(seed)
    edges, sets = [], {}
    for group in ("a", "b"):
        for _ in range(45):
            u, v = rng.randrange(60), rng.randrange(60)
            edges.append((group, f"n{u:02d}", f"n{v:02d}"))
            sets.setdefault(group, Sets()).join(f"n{u:02d}", f"n{v:02d}")
    chain = [("c", f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)] + [("c", f"n{i:02d}", "n77") for i in range(50, 70)]
    for group, u, v in chain:
        sets.setdefault(group, Sets()).join(u, v)
    edges += chain
    got = connected_components(spark.createDataFrame(edges, "g STRING, u STRING, v STRING"), ["g"], "u", "v").collect()
    looped = {(g, u) for g, u, v in edges if u != v} | {(g, v) for g, u, v in edges if u != v}
    assert {(r["g"], r["node"]): r["root"] for r in got} == {(g, n): sets[g].find(n) for g, n in looped}


def test_components_equal_disjoint_sets(spark):
    check_components(spark, 1)


def test_components_with_hot_nodes(skewed):
    check_components(skewed, 2)


def test_inflows_cap_ties_and_cleaning(spark):
    schema = "seq BIGINT, hash STRING, sender STRING, recipient STRING, value STRING, is_error BOOLEAN, via STRING, ts BIGINT"
    rows = [(i, f"h{i}", f"F{i:02d}", "W", "7", False, "external", 100 + i) for i in range(13)]
    rows += [(20, "x", "in", "W", "7", False, "internal", 50), (21, "y", "in", "W", "7", False, "external", 50), (22, "z", "w", "W", "7", False, "external", 1),
             (23, "e", "bad", "W", "7", True, "external", 1), (24, "0", "zero", "W", "0", False, "external", 1)]
    got = funding.funding_inflows(spark.createDataFrame(rows, schema)).orderBy("position").collect()
    assert [r["funder"] for r in got] == ["in"] + [f"f{i:02d}" for i in range(11)]
    assert (got[0]["hash"], got[0]["via"]) == ("y", "external")
    record = funding.wallet_funding_build(funding.funding_inflows(spark.createDataFrame(
        [(1, "h", "f", "w", "1234567890000000000", False, "external", 60)], schema).withColumn("ts", F.timestamp_seconds("ts"))), F.current_timestamp()).head()
    assert (record["funding_amount"], record["funders"][0]["time_stamp"], record["funding_source"]) == ("1.2346 ETH", 60, "f")


def test_fan_outs_without_a_cap_keep_every_edge(spark):
    schema = "seq BIGINT, hash STRING, sender STRING, recipient STRING, value STRING, is_error BOOLEAN, via STRING, ts BIGINT"
    rows = [(i, f"h{i}", f"f{i % 40:02d}", "w", "7", False, "external", 100 + i // 2) for i in range(60)]
    rows += [(100 + i, f"o{i}", "hub", f"r{i:02d}", "7", False, "internal" if i == 1 else "external", 5) for i in range(30)]
    transfers = spark.createDataFrame(rows, schema).repartition(3)
    into = funding.funding_inflows(transfers, None).filter("wallet = 'w'").orderBy("position").collect()
    assert [(r["position"], r["funder"], r["hash"]) for r in into] == [(i + 1, f"f{i:02d}", f"h{i}") for i in range(40)]
    out = funding.funding_outflows(transfers, None).filter("funder = 'hub'").orderBy("position").collect()
    assert [(r["position"], r["wallet"]) for r in out] == list(enumerate([f"r{i:02d}" for i in range(30) if i != 1] + ["r01"], 1))


def test_research_flags_count_connections_that_are_not_shown(spark):
    funders = {f"w{i:03d}": ["hub"] for i in range(320)}
    labels = spark.createDataFrame([("w319", "rug-bot")], "address STRING, kind STRING")
    seeds = spark.createDataFrame([("hub",)], "seed STRING")
    edges = spark.createDataFrame(edge_rows(funders), EDGE)
    report = research.research_report(seeds, edges, labels, hops=1)
    row = report.summary.head()
    assert (row["connection_count"], row["cluster_members"], row["rug_connected"], row["linked_rug_bots"]) == (320, 320, True, ["w319"])
    assert report.connections.count() == 300 and report.connections.filter("address = 'w319'").count() == 0


def test_legacy_records_have_one_edge(spark):
    schema = "address STRING, funders ARRAY<STRUCT<`from`: STRING, via: STRING, tx_hash: STRING, value: STRING, time_stamp: BIGINT>>, funding_source STRING, funding_tx_hash STRING"
    rows = [("a", [("f1", "internal", "", "1", 5), ("f2", "external", "t", "1", 6)], "f1", "x"), ("b", [], "old", "t9"), ("c", None, "old", None), ("d", None, None, None)]
    got = {(r["wallet"], r["funder"], r["via"], r["tx_hash"], r["position"]) for r in funding.funders_of(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "f1", "internal", None, 1), ("a", "f2", "external", "t", 2), ("b", "old", "external", "t9", 1), ("c", "old", "external", None, 1)}


# ---- attendee classes

def model_classes(pool, creator, traders, funders, bots, threshold):
    degree = {}
    for wallet, sources in funders.items():
        for f in sources:
            degree.setdefault(f, set()).add(wallet)
    frontier, known = {creator, *traders, *bots}, {}
    for _ in range(3):
        for w in frontier:
            known[w] = funders.get(w, [])
        frontier = {f for w in frontier for f in known[w]} - set(known)

    def private(f):
        return f == creator or f in bots or len(degree[f]) < threshold

    sets = Sets()
    for w, sources in known.items():
        for f in sources:
            if private(f):
                sets.join(w, f)
    tagged = {sets.find(b) for b in bots}
    out = {}
    for t in traders:
        if t == creator:
            kind = "creator"
        elif sets.find(t) in tagged:
            kind = "rug-bot"
        elif creator in known[t]:
            kind = "creator-funded"
        elif any(f in known[creator] and private(f) for f in known[t]):
            kind = "same-funder"
        elif sets.find(t) == sets.find(creator):
            kind = "linked"
        else:
            kind = "external"
        out[(pool, t)] = (kind, sets.find(t))
    return out


def scenario(spark, seed, bot_count):
    rng = random.Random(seed)
    funders = random_funders(rng, 60, 2)
    for w in list(funders)[:40]:
        if rng.random() < 0.5:
            funders[w].append("hub")
    names = list(funders)
    for w in rng.sample(names, 12):
        if names[0] not in funders[w] and w != names[0]:
            funders[w].append(names[0])
    funders = {w: list(dict.fromkeys(fs)) for w, fs in funders.items()}
    bots = set(rng.sample(names, bot_count)) | ({"loner"} if bot_count else set())
    creators = {"p1": names[0], "p2": "hub", "p3": names[7], "p4": "unfunded"}
    traded = {p: rng.sample(names, 14) + ["stranger", "loner"] for p in creators}
    traded["p3"].append(names[7])
    traders = [(p, t, rng.randrange(50), 1, i, 0) for p, ts in traded.items() for i, t in enumerate(dict.fromkeys(ts))]
    frame = spark.createDataFrame(traders, "pool_address STRING, trader STRING, quote_raw BIGINT, trade_count BIGINT, first_block BIGINT, first_log_index BIGINT")
    frame = frame.withColumn("quote_key", F.col("quote_raw")).withColumn("quote_total", F.col("quote_raw").cast("double"))
    launches = spark.createDataFrame(list(creators.items()), "pool_address STRING, creator STRING")
    labels = spark.createDataFrame([(b, "rug-bot") for b in bots] + [("w01", "watch")], "address STRING, kind STRING")
    done = attendees.analyse(launches, frame, spark.createDataFrame(edge_rows(funders), EDGE), labels, threshold=6, seeds=[])
    got = {(r["pool_address"], r["trader"]): (r["classification"], r["root"]) for r in done.classified.collect()}
    expected = {}
    for pool, creator in creators.items():
        expected |= model_classes(pool, creator, list(dict.fromkeys(traded[pool])), funders, bots, 6)
    assert got == expected
    return {kind for kind, _ in expected.values()}


def test_classes_equal_the_model(spark):
    assert {"creator", "rug-bot", "external"} <= scenario(spark, 5, 3) | scenario(spark, 11, 1)


def test_classes_without_bots_and_with_hot_keys(skewed):
    scenario(skewed, 8, 0)


# ---- rings

def model_rings(rows, held):
    """rows: (trader, volume, block); held: trader -> funders in order."""
    ranked = sorted(rows, key=lambda r: (-r[1], r[2]))
    groups = {}
    for trader, _, _ in ranked:
        for f in held.get(trader, []):
            groups.setdefault(f, []).append(trader)
    taken, rings = {}, []
    for funder, members in sorted(groups.items(), key=lambda g: -len(g[1])):
        fresh = [t for t in members if t not in taken]
        if len(fresh) >= 3:
            rings.append(funder)
            for t in fresh:
                taken[t] = (len(rings), funder)
    return taken


def test_rings_equal_the_sequential_rule(spark):
    most = 0
    for seed in range(4):
        rng = random.Random(seed)
        rows, held, edges = {}, {}, []
        for pool in ("p", "q"):
            rows[pool] = [(f"t{i:02d}", rng.randrange(6), i) for i in range(30)]
            held[pool] = {t: rng.sample([f"f{j}" for j in range(11)], rng.randrange(4)) for t, _, _ in rows[pool]}
            edges += [(pool, "c", t, f, i + 1, False, 0) for t, fs in held[pool].items() for i, f in enumerate(fs)]
        classified = spark.createDataFrame(
            [(p, t, "external", v, b, 0) for p in rows for t, v, b in rows[p]],
            "pool_address STRING, trader STRING, classification STRING, quote_key BIGINT, first_block BIGINT, first_log_index BIGINT")
        graph = spark.createDataFrame(edges, "pool_address STRING, creator STRING, wallet STRING, funder STRING, position BIGINT, is_public BOOLEAN, hop INT")
        got = {(r["pool_address"], r["trader"]): (r["ring_id"], r["funder"]) for r in intel.coordinated_rings(classified, graph).collect()}
        expected = {(p, t): ring for p in rows for t, ring in model_rings(rows[p], held[p]).items()}
        assert got == expected
        most = max(most, len(set(expected.values())))
    assert most >= 3


# ---- research

def model_research(seed, funders, hops):
    funded = {}
    for w, fs in funders.items():
        for f in fs:
            funded.setdefault(f, []).append(w)
    meta, frontier, edges = {seed: ["seed", 0]}, [seed], set()
    for hop in range(hops):
        met = [(f, "funder", (w, f)) for w in frontier for f in funders.get(w, [])] + [(w, "funded", (w, f)) for f in frontier for w in funded.get(f, [])]
        following = []
        for other, way, edge in met:
            edges.add(edge)
            if other not in meta:
                meta[other] = [way, hop + 1]
                following.append(other)
            elif meta[other][0] not in ("seed", way):
                meta[other][0] = "both"
        frontier = following
    return meta, edges, not frontier


def test_research_equals_the_model(spark):
    rng = random.Random(4)
    funders = random_funders(rng, 40, 2)
    seeds = ["w03", "w17", "nobody"]
    edges = spark.createDataFrame(edge_rows(funders), EDGE)
    walk = research.research_walk(spark.createDataFrame([(s,) for s in seeds], "seed STRING"), edges, hops=3)
    bots = spark.createDataFrame([("w09",)], "address STRING")
    nodes = research.research_components(walk, edges, bots, threshold=3, public_seeds=["w05"]).collect()
    complete = {r["seed"]: r["complete"] for r in walk.complete.collect()}
    degree = {}
    for w, fs in funders.items():
        for f in fs:
            degree[f] = degree.get(f, 0) + 1
    for seed in seeds:
        meta, met, done = model_research(seed, funders, 3)
        sets = Sets()
        for child, funder in met:
            if funder in (seed, "w09") or not (funder == "w05" or degree[funder] >= 3):
                sets.join(child, funder)
        got = {r["address"]: ([r["direction"], r["hops"]], r["in_cluster"]) for r in nodes if r["seed"] == seed}
        assert got == {a: (m, sets.find(a) == sets.find(seed)) for a, m in meta.items()}
        assert complete[seed] == done


def test_research_caps_and_roles(spark):
    funders = {f"w{i:02d}": ["hub"] for i in range(30)} | {"hub": ["top"]}
    labels = spark.createDataFrame([("w29", "rug-bot"), ("w01", "watch")], "address STRING, kind STRING")
    seeds = spark.createDataFrame([("hub",)], "seed STRING")
    report = research.research_report(seeds, spark.createDataFrame(edge_rows(funders), EDGE), labels, F.lit("2024-01-01").cast("timestamp"), threshold=75)
    row = report.summary.head()
    assert (row["connection_count"], row["wallets_explored"], row["rug_connected"], row["linked_rug_bots"], row["label"]) == (31, 32, True, ["w29"], None)
    connections = stage(research.top_connections(report.connections.drop("rank"), 10), "few")
    nodes, edges = research.research_graph(report.connections, research.Walk(report.connections.select("seed", "address").limit(0).unionByName(
        spark.createDataFrame([("hub", "hub")], "seed STRING, address STRING")), spark.createDataFrame([("hub", f"w{i:02d}", "hub") for i in range(30)], "seed STRING, child STRING, funder STRING"), None),
        labels.filter("kind = 'rug-bot'"), max_nodes=5)
    roles = {r["address"]: r["role"] for r in nodes.collect()}
    assert connections.count() == 10 and len(roles) == 5 and roles["hub"] == "seed" and roles["w29"] == "rug"
    assert edges.count() == sum(a.startswith("w") for a in roles)


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_research_by_blocks_equals_the_written_walk(spark, monkeypatch, hops):
    """Nodes made when they are read, over many blocks and slices, are those of the walk that writes every edge end."""
    rng = random.Random(hops)
    funders = random_funders(rng, 60, 2) | {f"z{i:02d}": ["hub", f"w{i:02d}"] for i in range(40)}
    rows = [*edge_rows(funders), ("w01", None, "external", "lost", 9), (None, "w02", "external", "lost", 1), ("w03", "w44", None, None, None)]
    edges = spark.createDataFrame(rows, EDGE)
    out = spark.createDataFrame([(f, w, "internal", f"{f}>{w}", n) for n, (f, w) in enumerate([("hub", "z01"), ("hub", "w50"), ("w07", "w08"), ("w07", "z09")])],
                                "funder STRING, wallet STRING, via STRING, hash STRING, position LONG")
    seeds = spark.createDataFrame([(s,) for s in ("w03", "W17", "z05", "hub", "nobody", "w03", None)], "seed STRING")
    want = research.research_walk(seeds, edges, hops, out)
    kept = []
    monkeypatch.setattr(research, "BLOCK_ROWS", 2)
    monkeypatch.setattr(research, "SLICE_EDGES", 40)
    monkeypatch.setattr(research, "ANSWER_ROWS", 5)
    monkeypatch.setattr(research, "stage", lambda df, name: kept.append(name) or stage(df, name))
    walk = research.research_walk(seeds, edges, hops, out, written=False)
    columns = ["seed", "address", "direction", "hops", "via", "tx_hash"]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(walk.nodes) == rows(want.nodes) and walk.nodes.schema == want.nodes.schema
    assert kept.count("research-step") == hops - 1 and "research-nodes" not in kept
    assert sorted(walk.edges.collect(), key=repr) == sorted(want.edges.collect(), key=repr)
    assert sorted(walk.complete.collect(), key=repr) == sorted(want.complete.collect(), key=repr)
