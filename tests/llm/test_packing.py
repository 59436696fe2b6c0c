"""Vector best-fit packing: round trip through the tokenizer, capacities, and a plain best fit."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm import packing
from tidepool.llm.queries import QUERIES

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_pieces(docs, tokens=2048):
    out = []
    for doc_id, text in docs:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), tokens)):
            part = np.array(ids[start : start + tokens], "<u4")
            out.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def best_fit(lengths, tokens):
    """Plain best-fit decreasing; the number of bins."""
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(tokens - n)
    return len(free)


def check(rows, docs, tokens=2048, documents=None, attention=None):
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == brute_pieces(docs, tokens)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= tokens and len(own) <= (documents or tokens) and sum(n * n for _, n in own) <= (attention or tokens * tokens)
    return len(bins)


def test_query(spark, data_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op13_packing"](spark, data_dir).collect()
    used = check(rows, docs)
    lengths = [r["length"] for r in rows]
    assert -(-sum(lengths) // 2048) <= used <= best_fit(lengths, 2048)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_odd_texts_and_capacities(spark, make_docs, rule, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 1 << 10)
    texts = [None, "", " \t\n", "one", "It's 'S we'VE, don't.", "<|endoftext|> A <|ENDOFTEXT|>x", "a^b ^ ^^", "É́é ΣΑΣ. Σ", "a.b,c!!d 12.5%", "nb sp ſt K", "\x00 a\x0bb", "word " * 700, "long text, of several windows. " * 400, "x" * 5000]
    docs = list(enumerate(texts)) + [(3, "one"), (3, "other"), (None, "one"), (None, None)] + [(100 + i, "copies of one text") for i in range(300)]
    table = make_docs(docs).withColumn("piece", F.lit("clash")).withColumn("rank", F.lit(0)).withColumn("offset", F.lit(0)).repartition(3)
    for tokens, documents, attention in ((2048, None, None), (64, 5, None), (256, 7, 256 * 300)):
        rows = packing.pack(table, tokens=tokens, documents=documents, attention=attention, rule=rule).collect()
        check(rows, docs, tokens, documents, attention)
    assert packing.pack(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.plan({10: 1}, 64, attention=99)


def test_plan_places_all_and_packs_tight():
    rng = np.random.default_rng(1)
    for trial in range(20):
        tokens = int(rng.choice([16, 100, 2048]))
        lengths = rng.integers(1, tokens + 1, 3000) if trial % 2 else np.minimum(tokens, 1 + rng.geometric(0.05, 3000))
        counts = Counter(lengths.tolist())
        plan = packing.plan(counts, tokens)
        placed = Counter()
        load = Counter()
        for length, first, per, bins, sequence, offset in sorted(plan.tolist(), key=lambda p: (-p[0], p[1])):
            assert first == placed[length]
            placed[length] += per * bins
            for b in range(sequence, sequence + bins):
                assert load[b] == offset
                load[b] += per * length
        assert placed == counts and max(load.values()) <= tokens
        assert len(load) <= best_fit(lengths.tolist(), tokens) * 1.01 + 1
        assert len(np.unique(plan[:, [0, 1]], axis=0)) == len(plan)
