"""Suffix-array decontamination against a plain search of every window."""

import hashlib
import re

from pyspark.sql import functions as F

from tidepool.llm import decontaminate
from tidepool.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_query(spark, data_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op7_decontamination"](spark, data_dir).select(*COLUMNS).collect()
    want = brute(docs, items)
    assert sorted(map(tuple, got), key=repr) == want and any(r[-1] for r in want)


def test_odd_texts_and_blocks(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Only, three words"), (3, None), (4, "!!"), (5, "ab " * 14), (None, "é ü"), (1, "second text of one id"), (6, long)]
    texts = [
        None, "", "x " + long.upper() + " y", " ".join(long.split()[5:14]), " ".join(long.split()[5:15]), "only three", "so only - THREE\nwords here", "ab " * 40, "é\x00ü", "é", "éü",
        long + " " + long, "second text of one id", ("filler words " * 30_000) + long,
    ]
    rows = list(enumerate(texts)) + [(2, "only three words"), (None, long)]
    docs = make_docs(rows).withColumn("item_id", F.lit("clash")).withColumn("n_words", F.lit(1))
    bench = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    want = brute(rows, items)
    for limit in (1 << 20, 64):
        found = decontaminate.annotate(docs, bench, block_bytes=limit).collect()
        got = []
        for r in found:
            f = r["_found"]
            hit = {i for h in f["hits"] for i in range(h["start"], h["end"])}
            names = sorted(set(f["items"]))
            got.append((r["doc_id"], f["n_words"], len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
            assert r["item_id"] == "clash"
        assert sorted(got, key=repr) == want
        longest = max((m for r in found if r["doc_id"] == 11 for m in r["_found"]["matches"]), key=lambda m: m["length"])
        assert (longest["length"], longest["start"], longest["item_start"]) == (30, 0, 0)
    assert decontaminate.annotate(docs.limit(0), bench).count() == 0
    assert decontaminate.annotate(docs, bench.limit(0)).filter(F.size("_found.hits") > 0).count() == 0
