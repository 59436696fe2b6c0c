"""The pipeline against a version with plain Python for every stage but the classifier."""

import sys
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_jaccard import brute as components
from test_native import check_shards, targets
from tidepool.llm import quality
from tidepool.llm.columns import table, word_count


def test_stages_one_by_one(spark, data_dir):
    docs = table(spark, data_dir, "documents")
    bench = [tuple(r) for r in table(spark, data_dir, "benchmark").select("item_id", "text").collect()]
    kept = {}
    for name, apply in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.stage(apply(spark, docs, data_dir), f"test-{name}")
        after = docs.collect()
        kept[name] = len(after)
        if name != "shards":
            assert docs.columns == table(spark, data_dir, "documents").columns
            assert set(after) <= set(before)
        if name == "quality":
            scored = {r["doc_id"] for r in quality.scores(table(spark, data_dir, "documents"), table(spark, data_dir, "labels")).collect() if r["score"] >= 0.3}
            assert {r["doc_id"] for r in after} == scored
        elif name == "near_duplicates":
            want = components([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in want})
        elif name == "decontamination":
            want = contaminated([(r["doc_id"], r["text"]) for r in before], bench)
            assert sorted(r["doc_id"] for r in after) == sorted(d for d, *_, hit in want if not hit)
        elif name == "mix":
            rows = spark.createDataFrame(before).select("doc_id", "source", word_count(F.col("text")).alias("n")).collect()
            size = {r["doc_id"]: r["n"] for r in rows}
            sizes = Counter()
            for r in rows:
                sizes[r["source"]] += r["n"]
            taken = Counter()
            for r in after:
                taken[r["source"]] += size[r["doc_id"]]
            largest = max(size.values())
            assert all(abs(taken[s] - t) <= largest for s, t in targets(sizes).items())
            assert max(Counter(r["doc_id"] for r in after).values()) <= 2
        else:
            check_shards(before, after)
    assert 0 < kept["decontamination"] < kept["near_duplicates"] < kept["quality"]


def test_run_and_empty(spark, data_dir, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, data_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    table(spark, data_dir, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_registers_everything():
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as entry

    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {k.split("_")[0] for k in entry.queries()}
