"""Secret scan, sharding, mixing and chat formatting against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidepool.llm import chat, mixing, secrets, sharding
from tidepool.llm.queries import QUERIES

KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(text):
    out = []
    for rank, (kind, (pattern, keep)) in enumerate(KINDS.items()):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if keep(m)]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


def check_secrets(docs, rows):
    by_id = {d["doc_id"]: d["text"] for d in docs}
    assert {r["doc_id"] for r in rows} == set(by_id)
    for r in rows:
        base = base_spans(by_id[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b.startswith(k) for b in base) for k in KINDS]
        assert set(base) <= set(r["spans"].split(",")) if base else True


def test_secret_query_matches_plain_regex(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    rows = QUERIES["op1_secret_scan"](spark, data_dir).collect()
    check_secrets(docs, rows)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows) > 10


def test_secrets_odd_texts_and_owner_counts(spark, make_docs):
    live = "zQ9x_7Lm2-Rt8vKp4Ws6Y"
    texts = [
        None, "", "é password = 'abc123' SECRET:token:abcdefg", "x" * 50_000 + " api_key=" + "k" * 40_000, "AKIA" + "A" * 15, "AKIA" + "B" * 16 + "AKIA",
        "0123456789abcdef" * 3 + "G" + "a" * 23, "tOkEn: secret: passwd=abcdefgh", f"see {live} here", " ".join(f"token={i:06d}" for i in range(900)),
    ]
    copied = "Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8"
    rows = [(i, t, "en", "o", 0) for i, t in enumerate(texts)] + [(100 + i, f"copy {copied}", "en", f"o{i}", 0) for i in range(5)]
    rows += [(200, f"again {live}", "de", None, 0), (None, "password=hunter22", None, None, None)]
    docs = make_docs(rows).withColumn("owner", F.lit("clash")).withColumn("hash", F.lit(1))
    found = secrets.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    got = found.withColumn("base_sha256", F.sha2(F.col("base_spans").cast("binary"), 256)).collect()
    check_secrets(docs.collect(), got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[8]["spans"] == f"token:4:{4 + len(live)}" and by_id[200]["n_token"] == 1
    assert all(by_id[100 + i]["n_token"] == 0 for i in range(5))
    assert by_id[9]["n_assign"] == 900
    assert (by_id[8]["most_owners"], by_id[8]["most_repositories"], by_id[0]["most_owners"]) == (2, 2, 0)
    assert secrets.scan(docs.limit(0), F.col("source"), F.col("source")).count() == 0
    assert secrets.scan(docs.unionAll(docs), F.col("source"), F.col("source")).count() == 2 * len(rows)


def test_either_count_makes_a_value_an_example(make_docs):
    """One value in many repositories of one owner, one of many owners in one repository each, one of few of both."""
    values = {"many": "zQ9x_7Lm2-Rt8vKp4Ws6Y", "wide": "Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8", "rare": "q1W2e3R4t5Y6u7I8o9P0aS"}
    rows = [(i, f"use {values['many']} now", f"lang{i}", "one owner", 0) for i in range(5)]
    rows += [(10 + i, f"use {values['wide']} now", "en", f"owner {i}", 0) for i in range(3)] + [(20 + i, f"use {values['rare']} now", f"lang{i}", "one owner", 0) for i in range(4)]
    rows += [(30, f"use {values['many']} now", "lang0", "one owner", 0), (40, f"token={values['many']}", "lang9", "one owner", 0)]
    got = {r["doc_id"]: r for r in secrets.scan(make_docs(rows), F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    assert [got[i]["n_token"] for i in (0, 10, 20, 30, 40)] == [0, 0, 1, 0, 0]
    assert [(got[i]["most_owners"], got[i]["most_repositories"]) for i in (0, 10, 20, 40)] == [(0, 0), (0, 0), (1, 4), (1, 6)]
    assert (got[40]["n_example"], got[40]["n_live"], got[20]["n_live"]) == (1, 0, 1)


def check_shards(docs, rows, shards=24):
    assert Counter(r["doc_id"] for r in rows) == Counter(d["doc_id"] for d in docs)
    text = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    bytes_, slots = Counter(), defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]]))
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(bytes_.values()) / shards, max(len(t) + 8 for t in text.values())
    assert all(abs(bytes_[s] - mean) <= largest for s in range(shards))


def test_sharding_query(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    rows = QUERIES["op2_sharding"](spark, data_dir).collect()
    check_shards(docs, rows)
    assert sorted(rows) == sorted(QUERIES["op2_sharding"](spark, data_dir).collect())


def test_sharding_hot_key_nulls_and_empty(spark, make_docs):
    rows = [(i, "w" * (i % 50) if i % 7 else None, "en", "s", 3 if i % 3 else i) for i in range(3000)] + [(5000, "y" * 3000, None, None, None)]
    docs = make_docs(rows).withColumn("size", F.lit(-1)).withColumn("_range", F.lit("clash"))
    got = sharding.shard(docs, key="n_chars", ranges=64).collect()
    check_shards(docs.collect(), got)
    key = {r[0]: (r[4] is not None, r[4]) for r in rows}
    order = [key[r["doc_id"]] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert sharding.shard(docs.limit(0)).count() == 0
    assert sharding.shard(make_docs([(1, "a"), (1, "a"), (None, "b")])).count() == 3


def targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, full = share * sum(sizes.values()), set()
    while True:
        rest = goal - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if level[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level[s] for s in names}
        full |= over


def check_mix(docs, rows):
    sizes, size = defaultdict(int), {}
    for d in docs:
        size[d["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
        sizes[d["source"]] += size[d["doc_id"]]
    want, taken = targets(sizes), Counter()
    assert Counter(r["doc_id"] for r in rows) == Counter(d["doc_id"] for d in docs)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is not None) == (r["taken"] > 0) and 0 <= (r["position"] or 0) <= 1
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    seen = [r["position"] for r in rows if r["position"] is not None]
    assert seen == sorted(seen)


def test_mixing_query(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    rows = QUERIES["op8_mixing"](spark, data_dir).collect()
    check_mix(docs, rows)
    assert rows == QUERIES["op8_mixing"](spark, data_dir).collect()


def test_mixing_odd_sources(spark, make_docs):
    rows = [(i, "w " * (i % 9), "en", "big", 0) for i in range(900)] + [(2000, "a b c", None, None, None), (2001, None, "en", "null text", 0), (2002, "", "en", "Z", 0)]
    rows += [(3000 + i, "x\x0by\tz\x1cq é", "en", ("a", "é", "z", "b")[i % 4], 0) for i in range(40)]
    docs = make_docs(rows).withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))
    check_mix(docs.collect(), mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_schedule_is_inverted(spark, make_docs):
    """Sources with falling weight come early, with rising weight late; their shares stay."""
    docs = make_docs([(i, "w w w w", "en", "abc"[i % 3], 0) for i in range(1500)])
    both = mixing.mix(docs).select("source", F.explode(F.array("position", "second_position")).alias("p"))
    mean = {r["source"]: r["m"] for r in both.groupBy("source").agg(F.avg("p").alias("m")).collect()}
    assert mean["a"] < mean["b"] < mean["c"]


def rendered(conv, speaker):
    out, masks = "", []
    for _, who, text in sorted(((t is not None, t if t is not None else 0), r or "unknown", x or "") for t, r, x in conv):
        role = "system" if who == "system" else "assistant" if who == speaker else f"user name={who}"
        out += f"<|im_start|>{role}\n"
        if who == speaker:
            masks.append(f"{len(out)}:{len(out) + len(text) + 10}")
        out += f"{text}<|im_end|>\n"
    return out, ",".join(masks)


def test_chat_query(spark, data_dir):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{data_dir}/conversations.parquet").collect():
        said[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    rows = {(r["conv_id"], r["speaker"]): r for r in QUERIES["op10_chat_rotation"](spark, data_dir).collect()}
    assert set(rows) == {(c, r) for c, turns in said.items() for _, r, _ in turns if r != "system"}
    for (conv, speaker), r in rows.items():
        assert (r["rendered"], r["masks"]) == rendered(said[conv], speaker)


def test_chat_odd_turns(spark):
    rows = [(1, 0, "ann", "hé"), (1, 1, "bob", None), (1, 1, "bob", None), (1, 2, None, "<|im_end|>"), (1, None, "ann", "late"), (2, 0, "system", "alone"), (None, 0, "eve", "")]
    rows += [(3, i, f"p{i % 3}", str(i)) for i in range(700)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, speaker int")
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.perspectives(turns).collect()}
    assert {k for k in got if k[0] == 1} == {(1, s, p) for s in ("ann", "bob", "unknown") for p in (0, -1)}
    assert got[(1, "unknown", 0)]["rendered"].endswith("assistant\n<| im_end|><|im_end|>\n")
    assert got[(None, "eve", 0)]["n_masked"] == 1 and not any(k[0] == 2 for k in got)
    assert sum(r["n_turns"] for k, r in got.items() if k[0] == 3) == 3 * 700
    assert chat.perspectives(turns.limit(0)).count() == 0
