"""K2-treap search against a plain scoring of every document."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import treap
from tidepool.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for d, w in held:
            m = 50 + (50 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * w.count(x)) // (1000 * w.count(x) + 20 * m)) for x in own if x in w)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query(spark, data_dir):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data_dir}/{name}.parquet')")
    want = sorted(duck.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op11_lexical_search']})").fetchall(), key=repr)
    got = rows(QUERIES["op11_lexical_search"](spark, data_dir))
    assert len(got) == len(want) > 1000
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3] == []


@pytest.mark.parametrize("shard", [1, 3, 1 << 14])
def test_odd_texts(spark, make_docs, monkeypatch, shard):
    monkeypatch.setattr(treap, "SHARD_DOCS", shard)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "!?"), (203, "É É\x00é W1"), (204, "w1 " * 5000), (None, "w3 w4"), (None, "w3 w4"), (205, "w3 w4"), (205, "w3 w4"), (7, "w59"), (206, "rare once"), (207, ("filler " * 30_000) + "w2")]
    items = [(1, "w1 W2, w3 w3"), (2, None), (3, "..."), (4, "absent"), (5, "é"), (None, "w3"), (None, "w4 w5"), (6, "rare"), (1, "w7"), (8, " ".join(words))]
    table = make_docs(docs).withColumn("item_id", F.lit("clash")).withColumn("score", F.lit(1)).repartition(3)
    bench = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    for k in (1, 5, 500):
        assert rows(treap.rank(table, bench, k)) == brute(docs, items, k)
    documents, total = treap.statistics(table)
    split = treap.search(treap.build(table, documents=documents, terms=total), bench, documents, 5, block_bytes=16)
    assert rows(split) == brute(docs, items, 5)
    assert treap.rank(table.limit(0), bench).count() == 0
    assert treap.rank(table, bench.limit(0)).count() == 0


def test_tree_holds_every_cell():
    rng = np.random.default_rng(2)
    cells = np.unique(rng.integers(0, 64, (300, 2)), axis=0)
    impact = rng.integers(1, 1000, len(cells))
    tree = treap.Treap(6, *treap._tree(cells[:, 0], cells[:, 1], impact, 6))
    node = np.zeros(len(cells), np.int64)
    for level in range(6):
        assert (tree.best[node] >= impact).all()
        bits = (cells >> (5 - level)) & 1
        there, node = tree.child(node, (2 * bits[:, 0] + bits[:, 1]).astype(np.uint8))
        assert there.all()
    assert (tree.best[node] == impact).all() and len(np.unique(node)) == len(cells)
