"""Components and rings: many groups in one pass, and the ways for groups beyond a task."""

import random

import numpy as np
import pytest

from tidepool.operators import components, intel


def brute_components(edges):
    out = {}
    for g, u, v in edges:
        if u is not None and v is not None and u != v:
            out.setdefault(g, {}).setdefault(u, set()).add(v)
            out[g].setdefault(v, set()).add(u)
    rows = []
    for g, near in out.items():
        seen = set()
        for start in sorted(near):
            if start not in seen:
                todo, own = [start], {start}
                while todo:
                    todo += (new := near[todo.pop()] - own)
                    own |= new
                seen |= own
                rows += [(g, n, start) for n in own]
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("bound", "at_once"), [(1 << 18, 1 << 17), (1 << 18, 7), (40, 16), (3, 4)])
def test_components_of_groups_of_any_size(spark, monkeypatch, bound, at_once):
    monkeypatch.setattr(components, "GROUP_EDGES", bound)
    monkeypatch.setattr(components, "SOLVED_AT_ONCE", at_once)
    rng = random.Random(bound + at_once)
    edges = [(rng.choice([None, "a", "b", "c", "d", "é"]), f"n{rng.randrange(60)}", rng.choice([None, *(f"n{i}" for i in range(60))])) for _ in range(300)]
    edges += [("chain", f"k{i:03d}", f"k{i + 1:03d}") for i in range(90)] + [("self", "x", "x"), ("ü", "ä", "z"), ("ü", "𝄞", "ä")]
    frame = spark.createDataFrame(edges, "pool STRING, wallet STRING, funder STRING").repartition(5)
    got = components.connected_components(frame, ["pool"])
    assert sorted((tuple(r) for r in got.select("pool", "node", "root").collect()), key=repr) == brute_components(edges)
    assert components.connected_components(frame.limit(0), ["pool"]).count() == 0


def test_smallest_reachable_of_a_long_chain():
    n = 50_000
    order = np.random.default_rng(1).permutation(n)
    assert (components.smallest_reachable(n, order[:-1], order[1:]) == 0).all()


def brute_rings(members, ranks, min_size):
    """members: pool -> funder -> traders; ranks: (pool, trader) -> volume (ties by name)."""
    rows = []
    for pool, groups in members.items():
        kept = {f: t for f, t in groups.items() if len(t) >= min_size}
        lead = {f: min((-ranks[pool, t], t) for t in own) for f, own in kept.items()}
        taken, ring = set(), 0
        for f in sorted(kept, key=lambda f: (-len(kept[f]), lead[f], f)):
            fresh = kept[f] - taken
            if len(fresh) >= min_size:
                ring += 1
                taken |= fresh
                rows += [(pool, ring, f, t) for t in fresh]
    return sorted(rows)


def frames(spark, members, ranks):
    classified = spark.createDataFrame([(p, t, "external", v, 0, 0) for (p, t), v in ranks.items()], "pool_address STRING, trader STRING, classification STRING, quote_key BIGINT, first_block BIGINT, first_log_index BIGINT")
    edges = [(p, t, f, 1, False, 0) for p, groups in members.items() for f, own in groups.items() for t in own]
    return classified, spark.createDataFrame(edges, "pool_address STRING, wallet STRING, funder STRING, position BIGINT, is_public BOOLEAN, hop INT")


@pytest.mark.parametrize("bound", [1 << 18, 60, 4])
def test_rings_of_pools_of_any_size(spark, monkeypatch, bound):
    monkeypatch.setattr(intel, "RING_ROWS", bound)
    rng = random.Random(7)
    members, ranks = {}, {}
    for pool, (traders, funders) in {"p1": (30, 12), "p2": (8, 3), "p3": (60, 40), "p4": (2, 2)}.items():
        names = [f"t{i:02d}" for i in range(traders)]
        ranks |= {(pool, t): rng.randrange(5) for t in names}
        members[pool] = {f"f{k:02d}": set(rng.sample(names[(k % 3) * traders // 3 :][: max(2, traders // 2)], min(rng.randrange(1, 7), max(2, traders // 3)))) for k in range(funders)}
    got = intel.coordinated_rings(*frames(spark, members, ranks))
    assert sorted(tuple(r) for r in got.select("pool_address", "ring_id", "funder", "trader").collect()) == brute_rings(members, ranks, 3)


def test_a_chain_of_conflicting_funders_takes_a_fixed_number_of_jobs(spark):
    """Funder k shares traders with funder k + 1, so a round could only ever decide one."""
    def jobs(n):
        names = [f"t{i:05d}" for i in range(2 * n + 2)]
        members = {"p": {f"f{k:05d}": set(names[2 * k : 2 * k + 4]) for k in range(n)}}
        ranks = {("p", t): len(names) - i for i, t in enumerate(names)}
        spark.sparkContext.setJobGroup(f"rings-{n}", "rings")
        rows = intel.coordinated_rings(*frames(spark, members, ranks))
        got = sorted(tuple(r) for r in rows.select("pool_address", "ring_id", "funder", "trader").collect())
        used = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rings-{n}"))
        spark.sparkContext.setJobGroup("", "")
        assert got == brute_rings(members, ranks, 3)
        return used

    assert jobs(500) <= jobs(5) + 2
