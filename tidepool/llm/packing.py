"""Vector best-fit packing of tokenised documents into sequences of bounded tokens, documents and attention cost.

1. Tokens: texts are cut where a token of a word-level vocabulary never spans (ASCII white space, and before a mark
   that follows an ASCII letter or digit), so every distinct word is tokenised once per worker and a document is put together from those.
   The token stream and a closing id 0 are cut into pieces of at most ``tokens`` ids.
2. Classes: two pieces of one length make the same demand in every dimension (tokens, one document, length squared
   attention cost). So the packing is decided on the counts per length, of which there are at most ``tokens``, in
   decreasing order. Bins of one fill are a class with a multiplicity; each step picks, among the classes in which the
   piece fits under every constraint, the one of the best score: the least weighted norm of what stays free
   (``norm``) or the largest weighted dot-product of demand and free capacity (``dot``). A bin takes as many equal
   pieces as fit, so it holds each length once and a plan has at most 2 * tokens classes of under 2 * sqrt(tokens)
   entries, whatever the size of the corpus.
3. Places: pieces are numbered inside their length (in ranges over the data, so that a length may hold any share of
   the rows) and look their number up in the plan.

Defined cases: NULL text is an empty text, which is one piece of the closing id; a text of any length is read in
windows of 1 MB; NULL and repeated ids and repeated rows are documents of their own; no rows give no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.tokens import CHUNK, NOT_SPACE, lower_ascii, text_chunks, word_hashes
from tidepool.runtime import number_rows, stage

TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"
WEIGHTS = (1.0, 0.05, 0.05)
CLOSING = 0
CACHED = 1 << 21  # words a worker remembers
_vocabularies: dict[str, Vocabulary] = {}

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?#$%&*")] = True
MARK = "^"
LINE = 512  # words encoded at once


class Vocabulary:
    """Token ids of whole columns of text by way of distinct words. ``source``: a path, or a name of public_tokenizers."""

    def __init__(self, source: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if "/" not in source:
            import public_tokenizers

            source = public_tokenizers.path(source)
        self.tokenizer = Tokenizer.from_file(str(source))
        mark = self.tokenizer.encode(f"a {MARK} b", add_special_tokens=False).ids
        self.mark = mark[1] if len(mark) == 3 else None
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of words, and each word's stretch of ``ids``
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _tokenised(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Words are encoded in lines, with a mark of one id between them that none of them holds."""
        if self.mark is None:
            return [np.array(c.ids, np.uint32) for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        plain = [k for k, w in enumerate(words) if MARK not in w]
        odd = [k for k, w in enumerate(words) if MARK in w]
        lines = [plain[k : k + LINE] for k in range(0, len(plain), LINE)]
        between = f" {MARK} "
        for line, code in zip(lines, self.tokenizer.encode_batch_fast([between.join(words[k] for k in line) for line in lines], add_special_tokens=False), strict=True):
            ids = np.array(code.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            for k, lo, hi in zip(line, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                out[k] = ids[lo:hi]
        for k, code in zip(odd, self.tokenizer.encode_batch_fast([words[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = np.array(code.ids, np.uint32)
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        codes = self._tokenised(words)
        count = np.array([len(c) for c in codes], np.int64)
        at = np.searchsorted(self.known, hashes)
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.known = np.insert(self.known, at, hashes)
        self.ids = np.concatenate([self.ids, *codes])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and where each text's ids start (one more at the end)."""
        if len(self.known) > CACHED:
            self.forget()
        data = _lower_words(data)
        inside = NOT_SPACE[data]
        fresh = np.ones(len(data), bool)
        fresh[1:] = ~inside[:-1] | (_ALNUM[data[:-1]] & _MARKS[data[1:]])
        fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(inside & fresh)
        last = np.ones(len(data), bool)
        last[:-1] = fresh[1:] | ~inside[1:]
        ends = np.flatnonzero(inside & last) + 1
        hashes, at, index = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        slots = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(self.known[np.minimum(slots, len(self.known) - 1)] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)
            self._learn(hashes[new], [raw[lo:hi].decode("utf-8", "replace") for lo, hi in spans])
            slots = np.searchsorted(self.known, hashes)
        slots = slots[index]
        count = self.count[slots]
        before = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        take = np.repeat(self.first[slots] - before[:-1], count) + np.arange(before[-1])
        return self.ids[take], before[np.searchsorted(starts, offsets)]


def _lower_words(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, as the vocabulary has it, so that fewer words differ. White-space words with ``<`` stay,
    because names of special tokens count only as they are written."""
    low = lower_ascii(data)
    tags = np.flatnonzero(data == ord("<"))
    if len(tags):
        edges = np.flatnonzero(~NOT_SPACE[data])
        lo = np.append(-1, edges)[np.searchsorted(edges, tags)] + 1
        hi = np.append(edges, len(data))[np.searchsorted(edges, tags)]
        for a, b in sorted(set(zip(lo.tolist(), hi.tolist(), strict=True))):
            low[a:b] = data[a:b]
    return low


def _windows(data: np.ndarray, limit: int = CHUNK) -> Iterator[np.ndarray]:
    """One text in parts of about ``limit`` bytes, cut after white space."""
    while len(data) > limit:
        spaces = np.flatnonzero(~NOT_SPACE[data[:limit]])
        if not len(spaces):
            spaces = np.flatnonzero(~NOT_SPACE[data])
        if not len(spaces):
            break
        cut = int(spaces[-1] if spaces[-1] < limit else spaces[0]) + 1
        yield data[:cut]
        data = data[cut:]
    yield data


def pieces(docs: DataFrame, doc_id: str, text: str, tokens: int = TOKENS, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _vocabularies:
            _vocabularies[tokenizer] = Vocabulary(tokenizer)
        known = _vocabularies[tokenizer]
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column("text")):
                if len(offsets) == 2:
                    parts = [known.encode(w, np.array([0, len(w)]))[0] for w in _windows(data)]
                    ids = np.concatenate(parts)
                    edges = np.array([0, len(ids)])
                else:
                    ids, edges = known.encode(data, offsets)
                length = np.diff(edges) + 1
                count = -(-length // tokens)
                doc = np.repeat(np.arange(len(length)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                size = np.minimum(tokens, length[doc] - piece * tokens)
                crcs = np.empty(len(doc), np.int64)
                closing = np.array([CLOSING], "<u4").tobytes()
                raw = memoryview(ids.astype("<u4").tobytes())
                for k, (lo, n, hi) in enumerate(zip((edges[doc] + piece * tokens).tolist(), size.tolist(), edges[doc + 1].tolist(), strict=True)):
                    crc = zlib.crc32(raw[4 * lo : 4 * min(lo + n, hi)])
                    crcs[k] = zlib.crc32(closing, crc) if lo + n > hi else crc
                names = batch.column("doc_id").slice(row, len(length)).take(pa.array(doc))
                columns = [names, pa.array(piece.astype(np.int32)), pa.array(piece * tokens), pa.array(size), pa.array(crcs)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Rows (length, first, per_bin, bins, sequence, offset): the pieces of ``length`` numbered from ``first`` on go
    ``per_bin`` each into the ``bins`` sequences from ``sequence`` on, from ``offset`` on. Sorted by length and first.

    ``documents`` and ``attention`` default to what never binds before ``tokens`` does; a piece must fit an empty bin.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    whole = np.array([tokens, documents or tokens, attention or tokens * tokens], np.int64)
    weight = np.array(weights)
    free = np.zeros((0, 3), np.int64)  # of one bin of each class
    bins = np.zeros((0, 3), np.int64)  # how many, first sequence, tokens filled
    out: list[tuple[int, ...]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds an empty sequence")
        while left:
            fits = np.flatnonzero((free >= need).all(axis=1))
            if len(fits):
                if rule == "norm":
                    score = -(weight * ((free[fits] - need) / whole) ** 2).sum(axis=1)
                else:
                    score = (weight * (free[fits] / whole) * (need / whole)).sum(axis=1)
                pick = int(fits[np.argmax(score)])
            else:
                per = int((whole // need).min())
                free = np.vstack([free, whole])
                bins = np.vstack([bins, [-(-left // per), opened, 0]])
                opened += -(-left // per)
                pick = len(free) - 1
            per = int((free[pick] // need).min())
            many, at, filled = bins[pick].tolist()
            full = min(many, left // per)
            odd = min(per, left - full * per) if full < many else 0
            parts = [(full, per), (1 if odd else 0, odd), (many - full - (1 if odd else 0), 0)]
            made_free, made_bins = [], []
            for n, copies in parts:
                if n:
                    if copies:
                        out.append((length, first, copies, n, at, filled))
                        first, left = first + n * copies, left - n * copies
                    made_free.append(free[pick] - copies * need)
                    made_bins.append([n, at, filled + copies * length])
                    at += n
            free = np.vstack([np.delete(free, pick, axis=0), made_free])
            bins = np.vstack([np.delete(bins, pick, axis=0), made_bins])
            shut = (free[:, 0] <= 0) | (free[:, 1] <= 0)
            free, bins = free[~shut], bins[~shut]
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: int = TOKENS, documents: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", tokenizer: str = TOKENIZER,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    cut = stage(pieces(docs, doc_id, text, tokens, tokenizer), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``tokens`` rows
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, tokens, documents, attention, weights, rule))
    numbered = number_rows(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")

    columns = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, per, _, sequence, offset = shared.value.T
        keys = (length << 48) + first
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() - 1
            k = np.searchsorted(keys, (own << 48) + rank, "right") - 1
            at = rank - first[k]
            placed = [pa.array(sequence[k] + at // per[k]), pa.array(offset[k] + at % per[k] * own)]
            yield pa.RecordBatch.from_arrays([*batch.select(columns).columns, *placed], names=[*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")
