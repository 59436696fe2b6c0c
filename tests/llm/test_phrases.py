"""Phrase mining against plain counting."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepool.llm import phrases
from tidepool.llm.queries import ORACLES, QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(docs, words, least, covered, k):
    counts, sizes = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(ws)
            for n in range(1, words + 1):
                for i in range(len(ws) - n + 1):
                    counts[lang, tuple(ws[i : i + n])] += 1
    found = [(lang, p, a) for (lang, p), a in counts.items() if len(p) > 1 and a >= least]
    dropped = {(lang, p[i:j]) for lang, p, a in found for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (i, j) != (0, len(p)) and 100 * a >= covered * counts[lang, p[i:j]]}
    out = []
    for lang, p, a in found:
        if (lang, p) not in dropped:
            score, _, l, r = min((1_000_000 * a * a // (counts[lang, p[:c]] * counts[lang, p[c:]]), c, counts[lang, p[:c]], counts[lang, p[c:]]) for c in range(1, len(p)))
            out.append((lang, " ".join(p), a, l, r, sizes[lang], score))
    ranked = []
    for lang in sizes:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(own[:k], 1)]
    return sorted(ranked, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query(spark, data_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data_dir}/documents.parquet')")
    want = sorted(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_collocations']})").fetchall(), key=repr)
    got = rows(QUERIES["op12_collocations"](spark, data_dir))
    assert len(got) == len(want) > 500
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3] == []


@pytest.mark.parametrize(("block", "part", "words"), [(1 << 21, 1 << 20, 3), (40, 16, 4)])
def test_odd_texts(spark, monkeypatch, block, part, words):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "PART", part)
    base = ["New York city. new york!", "x y z x y z", "a b, a b\nc a b c", None, "", "  \t ", "É é É é", "nb sp nb sp", "one two three four five six", "and so on, and so on; and so on", "\x00 \x00 \x0b a b"]
    docs = [(i, t, lang) for i, (t, lang) in enumerate([(t, lang) for t in base for lang in ("en", None, "fr", "und")] * 3)]
    docs += [(None, "x y z", "en"), (5, "x y z", "en"), (5, "x y z", "en"), (900, "x y " * 40_000, "zz"), (901, "only few", "once")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    for least, covered, k in ((3, 50, 2000), (1, 80, 4)):
        want = brute([(r[2], r[1]) for r in docs], words, least, covered, k)
        assert rows(phrases.top(table, k, words=words, min_count=least, covered=covered)) == want
    assert phrases.top(table.limit(0)).count() == 0


def test_large_counts_are_exact(spark):
    a, l, r = 3_000_000_019, 900_000_000_007, 800_000_000_003
    row = spark.createDataFrame([(a, [l, a], [r, a])], "a long, firsts array<long>, lasts array<long>").select(phrases._lowest_cut(2).alias("c")).first()
    assert row["c"]["score"] == 1_000_000 * a * a // (l * r)
