"""Jaccard join against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import jaccard, links
from tidepool.llm.queries import QUERIES


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, n=4, percent=85):
    sets = [(d, frozenset(shingles(t, n))) for d, t in docs]
    distinct = sorted({s for _, s in sets if s}, key=len)
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            parent[s] = s = parent[parent[s]]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if percent * len(b) > 100 * len(a):
                break
            shared = len(a & b)
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                parent[root(a)] = root(b)
    least = {}
    for d, s in sets:
        if s and d is not None:
            least[root(s)] = min(d, least.get(root(s), d))
    return sorted(((d, len(s), least.get(root(s)) if s else d) for d, s in sets), key=repr)


def test_query(spark, data_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op5_jaccard_join"](spark, data_dir).collect()), key=repr)
    assert got == brute(docs) and any(r[0] != r[2] for r in got)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 4), ("SPREAD", 3), ("COMMON_HERE", 2), ("COMMON_ALL", 6)):
        monkeypatch.setattr(jaccard, name, value)


def test_chains_passages_and_odd_rows(spark, make_docs, small_blocks):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(0, 40)))) for i in range(150)]
    base = [f"b{i}" for i in range(80)]
    for i in range(60):  # a chain: neighbours are alike, the ends are not
        base[rng.randrange(80)] = f"c{i}"
        rows.append((1000 + i, " ".join(base)))
    rows += [(2000 + i, " ".join(rng.choices("xyz", k=rng.randint(1, 9)))) for i in range(80)]
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "One two"), (3004, "one  TWO"), (3005, "É one"), (None, "one two"), (None, "lone row"), (3003, "One two"), (7, passage)]
    rows += [(4000, "long " * 50_000), (4001, " ".join(map(str, range(30_000)))), (4002, " ".join(map(str, range(30_500))))]
    docs = make_docs(rows).withColumn("n", F.lit("clash")).withColumn("sid", F.lit(1)).repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs).collect()), key=repr)
    assert got == brute(rows)
    kept = jaccard.keep_one(docs, words=5, percent=80)
    want = brute(rows, 5, 80)
    assert kept.columns == docs.columns
    assert kept.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count() == len({r[2] for r in want if r[1] and r[2] is not None}) + len({1 for r in want if r[1] and r[2] is None})
    assert jaccard.classes(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_keep_one_keeps_a_row_of_every_component(spark, make_docs, small_blocks):
    rng = random.Random(8)
    unlike = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(12)]
    near = [t + f" tail{i}" for i, t in enumerate(unlike)]
    rows = [(None, t) for t in unlike[:4] + near[:2]] + [(7, t) for t in unlike[4:8] + near[4:6]] + [(20 + i, t) for i, t in enumerate(unlike[8:] + near[2:4])]
    rows += [(None, None), (None, ""), (7, ""), (7, unlike[4])]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(make_docs(rows).repartition(3)).collect()]
    # A component of the brute force, by numbering the rows: ids that are unique name it.
    true = {i: c for i, _, c in brute([(i, t) for i, (_, t) in enumerate(rows)])}
    of_text = {t: true[i] for i, (_, t) in enumerate(rows) if t}
    assert sorted(of_text[t] for _, t in kept if t) == sorted(set(of_text.values())) and len(set(of_text.values())) == 12
    for d, t in kept:
        if t:
            assert d == min((e for e, u in rows if u and of_text[u] == of_text[t] and e is not None), default=None)
    assert {(d, t) for d, t in kept if not t} == {(None, None), (None, ""), (7, "")}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(500, 500)]
    got = {tuple(r) for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 130)}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_joins_what_its_edges_join():
    a, b = np.array([1, 1, 2, 5, 2]), np.array([2, 3, 3, 6, 3])
    picked = jaccard._forest(a, b, np.array([0.9, 0.8, 0.95, 0.9, 0.95]))
    assert sorted(zip(a[picked].tolist(), b[picked].tolist(), strict=True)) == [(1, 2), (2, 3), (5, 6)]
