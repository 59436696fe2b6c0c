"""Phrase collocations by set-oriented mining (SETM) over persisted, sorted occurrence relations.

R1 holds every word occurrence as (block, place, word). Places ascend by document, piece and position; a piece starts
two places after the last word of the one before, so "same piece, next position" is ``place + 1``. A block is the
relation's unit of storage: some two million words, its columns sorted by place and packed. For k = 1, 2, ...

1. Group count: every block sends its distinct phrases of k words with their counts, cut by hash into parts of about
   a million; a part's task adds them up and numbers the frequent ones.
2. Semi-join: the part answers each block with the numbers of the frequent phrases among those it sent. Neither
   phrases nor occurrences are broadcast, and a phrase costs a block one entry however often it occurs.
3. Extension: the block drops the occurrences of infrequent phrases and merge-joins the rest with itself on
   ``place + 1``. Two phrases of k words that share k - 1 make one of k + 1, named by their two numbers. This is
   R(k + 1), which is persisted again.

Every phrase so has a left and a right part of k - 1 words, by which joins pass down texts and the counts of all first
and last parts. Scores are integers of up to 38 digits.

Words are told apart by 96 bits (a hash of 64, and 32 of their length and outer bytes). Numbers have 32 bits: more
than 2**32 frequent phrases of one length raise an error.

Defined cases: NULL text has no words; a NULL language is ``und``; rows with one id, repeated rows and NULL ids are
documents of their own; a text of any length is one document of one block; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.coding import packed, packed_sorted, unpacked, unpacked_sorted
from tidepool.llm.tokens import lower_ascii, mixed, text_chunks, word_hashes, word_spans
from tidepool.runtime import skew_join, stage_table, top_k

BLOCK = 1 << 21  # words of a block
PART = 1 << 20  # phrases of a part, about
MIN_COUNT = 10
WORDS = 3
COVERED = 50  # percent of a phrase's occurrences inside one longer phrase at which it is dropped

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", 10, 11, 12, 13]] = True
_WORD = ~_SEPARATOR
_WORD[[9, 32]] = False

_RELATION = "block long, places binary, codes binary, keys binary, checks binary, counts binary, n long"


def _outer_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32 bits of every word's length, first and last eight bytes."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[8 : 8 + len(data)] = data
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = np.minimum(ends - starts, 8).astype(np.uint64)
    spare = np.uint64(8) * (np.uint64(8) - size)
    first = np.ascontiguousarray(eights[starts + 8]).view("<u8").reshape(-1) << spare
    last = np.ascontiguousarray(eights[ends]).view("<u8").reshape(-1) >> spare
    return (mixed(mixed(first) + last + (ends - starts).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _words(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """R1 with each block's vocabulary: words, and per language its name and number of words."""

    def flush(held: list[tuple], names: list[str], block: int) -> pa.RecordBatch:
        keys, at, index = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, index, np.concatenate([h[4] for h in held]))
        bases = np.cumsum([0, *(len(h[0]) for h in held)])
        by_count = np.empty(len(keys), np.uint32)
        by_count[np.argsort(-counts, kind="stable")] = np.arange(len(keys), dtype=np.uint32)
        codes = np.concatenate([by_count[index[b : b + len(h[0])]][h[5]] for b, h in zip(bases, held, strict=False)])
        shift, places = 0, []
        for h in held:
            places.append(h[6] + shift)
            shift = int(places[-1][-1]) + 2
        langs = np.concatenate([h[2] for h in held])[at]
        sizes = np.bincount(langs, counts, len(names)).astype(np.int64)
        row = {
            "block": [block], "places": [packed_sorted(np.concatenate(places).astype(np.uint64))], "codes": [packed(codes)], "keys": [packed_sorted(keys)],
            "checks": [packed(np.concatenate([h[1] for h in held])[at])], "counts": [packed(counts)], "n": [len(keys)],
        }
        words = pa.concat_arrays([h[3] for h in held]).take(pa.array(at)).cast(pa.string())
        lists = [pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([packed(langs)]), pa.array([names], pa.list_(pa.string())), pa.array([sizes.tolist()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*(pa.array(v) for v in row.values()), *lists], names=[*row, "words", "word_langs", "langs", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        names: dict[str, int] = {}
        salts: list[int] = []
        total = 0
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column("text")):
                data = lower_ascii(data)
                starts, ends, first = word_spans(data, offsets, _WORD)
                if not len(starts):
                    continue
                of_doc = []
                for name in batch.column("lang").slice(row, len(offsets) - 1).to_pylist():
                    if name not in names:
                        names[name] = len(names)
                        salts.append(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))
                    of_doc.append(names[name])
                langs = np.repeat(np.array(of_doc, np.uint32), np.diff(first))
                keys, at, index, counts = np.unique(mixed(word_hashes(data, starts, ends) ^ np.array(salts, np.uint64)[langs]), return_index=True, return_inverse=True, return_counts=True)
                cut = np.cumsum(_SEPARATOR[data])[starts]
                new = np.zeros(len(starts), np.int64)
                new[1:] = cut[1:] != cut[:-1]
                new[first[:-1][(first[:-1] < len(starts)) & (first[:-1] > 0)]] = 1
                raw = data.tobytes()
                words = pa.array([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary())
                held.append((keys, _outer_bytes(data, starts[at], ends[at]), langs[at], words, counts, index, np.arange(len(starts)) + np.cumsum(new)))
                total += len(starts)
                if total >= BLOCK:
                    yield flush(held, list(names), block)
                    block, held, names, salts, total = block + 1, [], {}, [], 0
        if held:
            yield flush(held, list(names), block)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _RELATION + ", words array<string>, word_langs binary, langs array<string>, sizes array<long>")


def _order(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of every key and the order in which a block sends its (sorted) keys."""
    part = (mixed(keys) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    return part, np.argsort(part, kind="stable")


def _counted(relation: DataFrame, total: int, least: int) -> tuple[DataFrame, int]:
    """Group count over all blocks, staged. Per part one row without a block: keys and counts of the frequent phrases in
    the order of their numbers. Per part and block: ``known`` (bit per key sent), ``ranks`` (of the frequent ones among
    them), ``owned`` (bit per frequent one: this block is the first that has it)."""
    parts = max(1, -(-total // PART))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, checks, counts = unpacked_sorted(row["keys"]), unpacked(row["checks"], np.uint32), unpacked(row["counts"], np.int64)
                part, order = _order(keys, parts)
                edges = np.append(np.flatnonzero(np.diff(part[order], prepend=-1 if part.dtype != np.uint16 else part[order][:1] + 1)), len(order)) if len(order) else [0]
                out = []
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    own = order[lo:hi]
                    out.append((int(part[own[0]]), row["block"], packed_sorted(keys[own]), packed(checks[own]), packed(counts[own])))
                kinds = {"part": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "checks": pa.binary(), "counts": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "keys", "checks", "counts")), strict=True):
                if held and row[0] != now:
                    yield answer(now, held)
                    held = []
                now = row[0]
                held.append((row[1], unpacked_sorted(row[2]), unpacked(row[3], np.uint32), unpacked(row[4], np.int64)))
        if held:
            yield answer(now, held)

    def answer(part: int, held: list[tuple]) -> pa.RecordBatch:
        keys, checks = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        counts, source = np.concatenate([h[3] for h in held]), np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if (same & (checks[order][1:] != checks[order][:-1])).any():
            order = np.lexsort((checks, keys))
            same = (keys[order][1:] == keys[order][:-1]) & (checks[order][1:] == checks[order][:-1])
        group = np.cumsum(np.append(True, ~same)) - 1
        first = np.flatnonzero(np.append(True, ~same))
        sums = np.add.reduceat(counts[order], first)
        frequent = sums >= least
        rank = np.cumsum(frequent) - 1
        of_key = np.empty(len(keys), np.int64)
        of_key[order] = np.where(frequent[group], rank[group], -1)
        owner = np.zeros(len(keys), bool)
        owner[order[first]] = True  # a stable order: the first block that sent it
        rows = [(part, None, None, None, None, packed_sorted(keys[order[first]][frequent]), packed(sums[frequent]), int(frequent.sum()))]
        for k, h in enumerate(held):
            own = of_key[source == k]
            good = own >= 0
            rows.append((part, h[0], packed(np.packbits(good)), packed(own[good].astype(np.uint32)), packed(np.packbits(owner[source == k][good])), None, None, len(own)))
        kinds = {"part": pa.int32(), "block": pa.int64(), "known": pa.binary(), "ranks": pa.binary(), "owned": pa.binary(), "keys": pa.binary(), "counts": pa.binary(), "n": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    sent = relation.select("block", "keys", "checks", "counts").mapInArrow(send, "part int, block long, keys binary, checks binary, counts binary")
    sent = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "block")
    done = stage_table(sent.mapInArrow(add_up, "part int, block long, known binary, ranks binary, owned binary, keys binary, counts binary, n long"), "phrase-counts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per million phrases
    starts = done.df.filter("block IS NULL").select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return done.df.join(starts, "part"), parts


def _answers(counted: DataFrame) -> DataFrame:
    return counted.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("part", "start", "n", "known", "ranks", "owned")).alias("answers"))


def _numbers(keys: np.ndarray, parts: int, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """1-based number of every key (0: not frequent), and whether this block is the first that has it."""
    _, order = _order(keys, parts)
    out, owned = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = 0
    for a in sorted(answers, key=lambda a: a["part"]):
        own = order[at : at + a["n"]]
        good = own[np.unpackbits(unpacked(a["known"], np.uint8), count=len(own)).astype(bool)]
        out[good] = a["start"] + 1 + unpacked(a["ranks"], np.uint32)
        owned[good] = np.unpackbits(unpacked(a["owned"], np.uint8), count=len(good)).astype(bool)
        at += a["n"]
    return out, owned


def _extended(relation: DataFrame, counted: DataFrame, parts: int, last: bool) -> DataFrame:
    """R(k + 1) from R(k): frequent occurrences, merge-joined on the next place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                numbers, _ = _numbers(unpacked_sorted(row["keys"]), parts, row["answers"])
                of_code = numbers[np.argsort(-unpacked(row["counts"], np.int64), kind="stable")]
                phrase = of_code[unpacked(row["codes"], np.uint32)]
                frequent = phrase > 0
                places, phrase = unpacked_sorted(row["places"])[frequent], phrase[frequent].astype(np.uint64)
                if len(phrase) and int(phrase.max()) >> 32:
                    raise ValueError("more than 2**32 frequent phrases of one length")
                meets = np.flatnonzero(places[1:] == places[:-1] + np.uint64(1))
                keys, index, counts = np.unique((phrase[meets] << np.uint64(32)) | phrase[meets + 1], return_inverse=True, return_counts=True)
                by_count = np.empty(len(keys), np.uint32)
                by_count[np.argsort(-counts, kind="stable")] = np.arange(len(keys), dtype=np.uint32)
                out = {
                    "block": row["block"], "places": None if last else packed_sorted(places[meets]), "codes": None if last else packed(by_count[index]),
                    "keys": packed_sorted(keys), "checks": packed(np.zeros(len(keys), np.uint32)), "counts": packed(counts.astype(np.int64)), "n": len(keys),
                }
                kinds = [pa.int64(), *[pa.binary()] * 5, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    joined = relation.select("block", "places", "codes", "keys", "counts").join(_answers(counted), "block")
    return joined.mapInArrow(run, _RELATION)


def _frequent(counted: DataFrame) -> DataFrame:
    """id, left, right, a of the frequent phrases (left and right: numbers of their parts; of words, halves of a hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = unpacked_sorted(row["keys"])
                arrays = [row["start"] + 1 + np.arange(len(keys)), (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), unpacked(row["counts"], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["id", "left", "right", "a"])

    return counted.filter("block IS NULL").select("start", "keys", "counts").mapInArrow(run, "id long, left long, right long, a long")


def _spelled(relation: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    """id, lang, word of the frequent words, each given by the first block that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column("words")[k].values
                row = batch.drop_columns("words").slice(k, 1).to_pylist()[0]
                numbers, owned = _numbers(unpacked_sorted(row["keys"]), parts, row["answers"])
                mine = np.flatnonzero(owned & (numbers > 0))
                langs = pa.array(row["langs"], pa.string()).take(pa.array(unpacked(row["word_langs"], np.uint32)[mine]))
                yield pa.RecordBatch.from_arrays([pa.array(numbers[mine]), langs, words.take(pa.array(mine))], names=["id", "lang", "word"])

    joined = relation.select("block", "keys", "words", "word_langs", "langs").join(_answers(counted), "block")
    return joined.mapInArrow(run, "id long, lang string, word string")


def _lowest_cut(words: int) -> Column:
    """The lowest-scoring cut of a phrase: score, k, l, r; ties to the smallest k."""
    wide = lambda c: c.cast("decimal(15,0)")
    cuts = []
    for k in range(1, words):
        l, r = F.col("firsts")[k - 1], F.col("lasts")[words - k - 1]
        million = F.lit(1_000_000).cast("decimal(7,0)") * (wide(F.col("a")) * wide(F.col("a")))
        score = F.call_function("div", million, wide(l) * wide(r)).cast("long")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return cuts[0] if len(cuts) == 1 else F.least(*cuts)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = WORDS, min_count: int = MIN_COUNT, covered: int = COVERED) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every phrase of 2 to ``words`` words that is frequent and not dropped."""
    relation = stage_table(_words(docs, lang, text), "phrase-words", n=F.sum("n"))
    sizes = relation.df.select(F.explode(F.arrays_zip("langs", "sizes")).alias("s")).groupBy(F.col("s.langs").alias("lang")).agg(F.sum("s.sizes").alias("n"))
    sizes = stage_table(sizes, "phrase-sizes").df
    counted, parts = _counted(relation.df, relation.metrics["n"] or 0, min_count)
    frequent = _frequent(counted).select("id", "a")
    phrases = [stage_table(
        _spelled(relation.df, counted, parts).join(frequent, "id").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", F.array("a").alias("firsts"), F.array("a").alias("lasts")),
        "phrases",
    ).df]
    for k in range(2, words + 1):
        longer = stage_table(_extended(relation.df, counted, parts, k == words), "phrase-places", n=F.sum("n"))
        relation.drop()
        relation = longer
        counted, parts = _counted(relation.df, relation.metrics["n"] or 0, min_count)
        left = phrases[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), F.col("firsts").alias("before"))
        right = phrases[-1].select(F.col("id").alias("right"), "last", F.col("lasts").alias("after"))
        both = skew_join(skew_join(_frequent(counted), left, "left"), right, "right")
        made = both.select(
            "id", "left", "right", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "a",
            F.concat("before", F.array("a")).alias("firsts"), F.concat("after", F.array("a")).alias("lasts"),
        )
        phrases.append(stage_table(made, "phrases").df)
    relation.drop()
    out = []
    for k in range(2, words + 1):
        rows = phrases[k - 1]
        if k < words:  # a longer phrase around it lies around one of k + 1 words that is as frequent at least
            around = phrases[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("whole")).groupBy("id").agg(F.max("whole").alias("whole"))
            rows = rows.join(around, "id", "left").filter(F.col("whole").isNull() | (100 * F.col("whole") < covered * F.col("a")))
        rows = rows.withColumn("cut", _lowest_cut(k))
        out.append(rows.select("lang", "phrase", F.lit(k).alias("words"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.join(sizes, "lang").select("lang", "phrase", "words", "a", "l", "r", "n", "score")


def top(docs: DataFrame, k: int = 2000, **options: object) -> DataFrame:
    """The ``k`` best collocations of every language, with their rank."""
    ranked = top_k(collocations(docs, **options), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], k, "rank")
    return ranked.withColumn("rank", F.col("rank").cast("long"))
