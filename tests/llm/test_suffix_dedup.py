"""Suffix dedup against a plain table of all 100-byte strings."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tidepool.llm import suffix_dedup
from tidepool.llm.queries import QUERIES


def brute(docs, length=100):
    seen, out = set(), []
    unique = sorted({(d is not None, d or 0, t or "") for d, t in docs})
    done = {}
    for known, d, text in unique:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            part = raw[s : s + length]
            if part in seen:
                gone[s : s + length] = True
            seen.add(part)
        edges = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        done[(known, d, text)] = (len(raw), len(raw) - len(kept), edges, hashlib.sha256(kept).hexdigest())
    for d, t in docs:
        out.append((d, *done[(d is not None, d or 0, t or "")]))
    return sorted(out, key=repr)


def test_query(spark, data_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op6_suffix_dedup"](spark, data_dir).collect()), key=repr)
    want = brute(docs)
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3] == []
    assert any(r[2] for r in want)


def test_odd_texts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE", 64)
    monkeypatch.setattr(suffix_dedup, "RUN", 50)
    rng = random.Random(3)
    prose = "".join(rng.choices("abcdefgh ", k=1500))
    rows = [(i, prose[rng.randrange(600) : 700 + rng.randrange(800)]) for i in range(25)]
    rows += [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 101), (105, "é" * 300), (106, "ab" * 500), (107, "ab" * 500), (108, "\x00" * 250), (None, prose), (109, prose), (109, prose)]
    rows += [(200 + i, "".join(rng.choices("xyzw", k=60)) + prose[300:420] + "".join(rng.choices("xyzw", k=80))) for i in range(20)]
    rows += [(300, prose[:99] + "!" + prose[100:199] + "?" + prose[199:300]), (301, "".join(rng.choices("kl", k=20_000)) + prose)]
    docs = make_docs(rows).withColumn("th", F.lit("clash")).withColumn("start", F.lit(0)).repartition(4)
    got = sorted((tuple(r) for r in suffix_dedup.dedup(docs).collect()), key=repr)
    want = brute(rows)
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3] == []
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_text_hash_collisions(spark, make_docs, monkeypatch):
    """Texts of one hash (of 64 bits): none is taken for a copy of another, no anchor points beyond a text."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefgh ", k=n)) for n in (30, 150, 400, 2500, 9000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(suffix_dedup, "_text_hash", lambda c: F.octet_length(c).cast("long") * 0)
    assert rows_of(suffix_dedup.dedup(make_docs(rows).repartition(3))) == brute(rows)


def test_two_texts_of_one_hash_prefix(spark, make_docs, monkeypatch):
    """Two copies but for their id at equal offsets, under hashes whose upper bits are alike."""
    rng = random.Random(4)
    shared = "".join(rng.choices("abcdefgh ", k=330))
    rows = [(1, "document 00001: " + shared), (2, "document 00002: " + shared), (3, "x" * 20 + shared)]
    monkeypatch.setattr(suffix_dedup, "_text_hash", lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)))
    assert rows_of(suffix_dedup.dedup(make_docs(rows))) == brute(rows)


def test_common_grams_go_by_window(spark, make_docs, monkeypatch):
    """A short line in every third document, with other text around it, and a passage with both: no range holds them all."""
    monkeypatch.setattr(suffix_dedup, "RANGE", 32)
    monkeypatch.setattr(suffix_dedup, "WINDOWED", 40)
    used = []
    apart = suffix_dedup._common_spans
    monkeypatch.setattr(suffix_dedup, "_common_spans", lambda suspects, common: used.append(len(common)) or apart(suspects, common))
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line, passage = prose(60), prose(180)
    rows = [(i, prose(150) + (line if i % 3 == 0 else passage if i % 3 == 1 else "") + prose(rng.randrange(200))) for i in range(180)]
    rows += [(500 + i, prose(rng.randrange(30)) + line + line + passage[:110]) for i in range(30)] + [(None, passage), (600, line * 20)]
    want = brute(rows)
    for ranges in (1 << 14, 4):  # with 4 there are sections
        monkeypatch.setattr(suffix_dedup, "RANGES", ranges)
        assert rows_of(suffix_dedup.dedup(make_docs(rows).repartition(4))) == want
    assert used and used[0] > 0


def test_text_of_many_chunks(spark, make_docs):
    rng = np.random.default_rng(8)
    long = rng.integers(97, 105, 20 << 20, dtype=np.uint8)
    long[18 << 20 : (18 << 20) + 5000] = long[1000:6000]
    text = long.tobytes().decode()
    rows = [(1, text), (2, text[(1 << 24) + 300 : (1 << 24) + 700]), (3, text[300:700])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(make_docs(rows)).collect()}
    assert got == {1: (5000, 1), 2: (400, 1), 3: (400, 1)}


def test_loser_tree():
    rng = random.Random(1)
    for runs in (1, 2, 3, 7, 16):
        made = []
        for _ in range(runs):
            s = sorted(bytes(rng.choices(b"ab", k=12)) for _ in range(rng.randrange(40)))
            made.append((s, [0] + [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in zip(s, s[1:], strict=False)]))
        order, common = suffix_dedup.merge_runs(made)
        at, out = [0] * runs, []
        for r in order:
            out.append(made[r][0][at[r]])
            at[r] += 1
        assert out == sorted(x for s, _ in made for x in s)
        assert common[1:] == [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in zip(out, out[1:], strict=False)]
