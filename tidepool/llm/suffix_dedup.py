"""Removal of every byte inside a 100-byte string that also starts earlier, by a distributed suffix merge sort.

1. Anchors: in every window of 100 bytes the position with the least hash of its next ``GRAM`` bytes. Equal windows
   have their anchor at the same offset, so suffixes at anchors (some 3 % of all) are enough.
2. Distinguishing prefixes: an anchor whose gram occurs nowhere else cannot start a repeat and needs no sorting.
3. Runs: every task cuts the remaining anchors' suffixes (100 bytes, and the bytes before them as far as a window
   reaches), sorts them, and joins equal ones: all but the earliest are repeats already. The run is cut at sampled
   splitters and shipped front-coded: common-prefix length with the one before, then only the rest.
4. Merge: each range's runs go through a loser tree that knows every candidate's common prefix with the last output;
   where two differ, no byte is read, where they are equal only the bytes after it are.
5. In the merged order suffixes with a common prefix of a gram are neighbours; among these every window that an
   earlier one has too marks its bytes.
6. A gram that fills a range of its own takes no part in 3 to 5: its windows go by their hash instead, after each run
   has kept the earliest of equal ones, so no task holds all places of a gram. Ranges grow in number with the data:
   beyond ``RANGES`` of them grams are dealt to sections by hash, each with the same splitters.

Texts that repeat in full are one text from step 1 on (all rows but the first are repeats), so copies cost nothing.

Defined cases: NULL text is empty; texts below 100 bytes are kept; a NULL id is smaller than all; rows of one id and
different texts go by the text's hash; rows alike in id and text are one document; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.tokens import mixed, powers, prefix_hash, text_chunks
from tidepool.runtime import skew_join, stage, stage_table

LENGTH = 100
GRAM = 40
REACH = LENGTH - GRAM  # a window starts at most so far before its anchor
RUN = 1 << 17  # suffixes of a run
RANGE = 1 << 16  # suffixes of a range, about
RANGES = 1 << 14  # ranges of a section
WINDOWED = 1 << 14  # suffixes of a common gram whose windows are held at once
WIDTH = LENGTH + 1 + REACH + 1  # right context, its length, left context (backwards), its length


def _least_of(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every ``window`` consecutive keys."""
    size = 1
    while 2 * size <= window:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = window - size
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the chunk, gram hash) of the anchors of all texts."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    _, inverse = powers(len(data) + 1)
    count = len(data) - GRAM + 1
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[:count])
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(count, dtype=np.uint64)
    best = (_least_of(keys, REACH + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(data) + LENGTH, bool)
    for end in offsets[1:].tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    chosen = best[inside[: len(best)]]
    chosen = np.unique(chosen[np.append(True, chosen[1:] != chosen[:-1])]) if len(chosen) else chosen
    return chosen, grams[chosen]


def _repeated_anchors(texts: DataFrame) -> DataFrame:
    """(th, at): anchors whose gram has another place. ``texts``: th, text.

    Where a chunk has a gram at several places, these are repeated for sure and one of them stands for all in the
    exchange, so a common gram brings a row per chunk.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names = batch.column("th").to_numpy()
            for row, data, offsets in text_chunks(batch.column("text")):
                at, grams = _anchors(data, offsets)
                doc = np.searchsorted(offsets, at, "right") - 1
                own = names[row : row + len(offsets) - 1]
                new = np.ones(len(own), bool)
                for k, name in enumerate(own.tolist()):
                    new[k] = name not in seen
                    seen.add(name)
                keep = new[doc]
                at, grams, th = (at - offsets[doc])[keep], grams[keep], own[doc][keep]
                order = np.argsort(grams, kind="stable")
                at, grams, th = at[order], grams[order], th[order]
                first = np.append(True, grams[1:] != grams[:-1])[: len(grams)]
                several = ~first | np.append(~first[1:], False)[: len(grams)]
                # The rows for sure are dealt by place; of each gram one row more is dealt by the gram.
                salt = mixed(th.view(np.uint64) ^ mixed(at.astype(np.uint64)))
                key = np.concatenate([grams[first], salt[several]]).view(np.int64)
                columns = [key, np.concatenate([th[first], th[several]]), np.concatenate([at[first], at[several]]), np.append(np.zeros(int(first.sum()), bool), np.ones(int(several.sum()), bool))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "th", "at", "sure"])

    def keep_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A gram's rows are sorted by place: a row is repeated if a neighbour has its gram and another place.
        before: tuple[int, ...] | None = None  # the last row of the batch before
        matched = False  # and whether it has been given out
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2)], axis=1)
            sure = np.array(batch.column(3).to_pylist(), bool)
            given, rows = rows[sure], rows[~sure]
            if len(given):
                yield pa.RecordBatch.from_arrays([pa.array(given[:, 1]), pa.array(given[:, 2])], names=["th", "at"])
            if not len(rows):
                continue
            if before is not None:
                rows = np.concatenate([np.array([before], np.int64), rows])
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
            same = rows[1:, 0] == rows[:-1, 0]
            out = np.append(False, same) | np.append(same, False)
            out[0] &= not matched
            matched = bool(out[-1]) or (len(rows) == 1 and matched)
            before = tuple(rows[-1].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(rows[out, 1]), pa.array(rows[out, 2])], names=["th", "at"])

    found = texts.mapInArrow(find, "key long, th long, at long, sure boolean").repartition("key").sortWithinPartitions("key", "th", "at")
    return found.mapInArrow(keep_repeated, "th long, at long")


def _contexts(data: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Rows of WIDTH bytes: what follows each position, and what is before it."""
    padded = np.zeros(n + REACH + LENGTH, np.uint8)
    padded[REACH : REACH + n] = data
    windows = np.lib.stride_tricks.sliding_window_view(padded, REACH + LENGTH)[at]
    out = np.empty((len(at), WIDTH), np.uint8)
    out[:, :LENGTH] = windows[:, REACH:]
    out[:, LENGTH] = np.minimum(LENGTH, n - at)
    out[:, LENGTH + 1 : -1] = windows[:, REACH - 1 :: -1] if REACH else 0
    out[:, -1] = np.minimum(REACH, at)
    return out


def _front_coded(rows: np.ndarray, places: np.ndarray) -> bytes:
    """A sorted run as bytes: common prefixes, remaining suffix bytes, then the left contexts and places."""
    differ = rows[1:, :LENGTH] != rows[:-1, :LENGTH]
    common = np.zeros(len(rows), np.uint8)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    rest = rows[:, :LENGTH][np.arange(LENGTH)[None, :] >= common[:, None]]
    raw = b"".join([np.int64(len(rows)).tobytes(), common.tobytes(), rest.tobytes(), np.ascontiguousarray(rows[:, LENGTH:]).tobytes(), places.tobytes()])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _decoded(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and common prefixes of a run."""
    raw = pa.decompress(block[8:], decompressed_size=int(np.frombuffer(block[:8], np.int64)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    common = np.frombuffer(raw, np.uint8, n, 8)
    rest = LENGTH * n - int(common.sum(dtype=np.int64))
    rows = np.zeros((n, WIDTH), np.uint8)
    own = np.arange(LENGTH)[None, :] >= common[:, None]
    rows[:, :LENGTH][own] = np.frombuffer(raw, np.uint8, rest, 8 + n)
    filled = np.where(own, np.arange(n)[:, None], 0)
    np.maximum.accumulate(filled, axis=0, out=filled)
    rows[:, :LENGTH] = np.take_along_axis(rows[:, :LENGTH], filled, axis=0)
    rows[:, LENGTH:] = np.frombuffer(raw, np.uint8, n * (WIDTH - LENGTH), 8 + n + rest).reshape(n, -1)
    places = np.frombuffer(raw, np.int64, 3 * n, 8 + n + rest + n * (WIDTH - LENGTH)).reshape(n, 3)
    return rows, places, common


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs of (suffixes, common prefix of each with the one before it in its run).

    Returns the run of every output and its common prefix with the output before. A node of the loser tree keeps
    the run that lost there and that run's common prefix with the winner; a candidate with the longer common prefix
    with the last output is the smaller one, so bytes are read only where the two are equal, and only after it.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    last = [len(s) for s, _ in runs] + [0] * (leaves - len(runs))
    at = [0] * leaves

    def head(run: int) -> bytes | None:
        return runs[run][0][at[run]] if at[run] < last[run] else None

    def play(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """(winner, its prefix, loser, its prefix)."""
        x, y = head(a), head(b)
        if y is None:
            return a, ha, b, hb
        if x is None:
            return b, hb, a, ha
        if ha > hb:
            return a, ha, b, hb
        if hb > ha:
            return b, hb, a, ha
        x, y = x[ha:], y[ha:]
        if x == y:
            return (a, ha, b, ha + len(x)) if a < b else (b, ha, a, ha + len(x))
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        h = ha + len(x) - (differ.bit_length() + 7) // 8
        return (a, ha, b, h) if x < y else (b, ha, a, h)

    loser, prefix = [0] * leaves, [0] * leaves
    level = [(k, 0) for k in range(leaves)]
    node = leaves
    while len(level) > 1:
        node //= 2
        above = []
        for k in range(len(level) // 2):
            w, hw, lost, h = play(*level[2 * k], *level[2 * k + 1])
            loser[node + k], prefix[node + k] = lost, h
            above.append((w, hw))
        level = above
    winner, common = level[0]
    order, commons = [], []
    while at[winner] < last[winner]:
        order.append(winner)
        commons.append(common)
        at[winner] += 1
        common = runs[winner][1][at[winner]] if at[winner] < last[winner] else 0
        node = (winner + leaves) // 2
        while node:
            winner, common, loser[node], prefix[node] = play(winner, common, loser[node], prefix[node])
            node //= 2
    return order, commons


def _repeats(rows: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, end) of the bytes of each row's windows that an earlier row has too."""
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0]))
    rows, places = rows[order], places[order]
    n = len(rows)
    sums = _window_hashes(rows)
    _, inverse = powers(REACH + LENGTH + 1)
    alike = np.zeros(n, bool)  # the same place as the row before (rows that repeat in full)
    alike[1:] = (places[1:] == places[:-1]).all(axis=1)
    identity = np.cumsum(~alike)
    shortest, longest = np.full(n, LENGTH), np.full(n, -1)
    right, left = rows[:, LENGTH], rows[:, -1]
    for shift in range(REACH + 1):
        ok = np.flatnonzero((left >= shift) & (right >= LENGTH - shift))
        hashed = (sums[ok, REACH - shift + LENGTH] - sums[ok, REACH - shift]) * inverse[REACH - shift]
        by = np.argsort(hashed, kind="stable")
        new = np.append(True, hashed[by][1:] != hashed[by][:-1]) if len(ok) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(new, np.arange(len(ok)), 0))
        again = ok[by[identity[ok[by]] > identity[ok[by[first]]]]]
        shortest[again] = np.minimum(shortest[again], shift)
        longest[again] = shift
    hit = np.flatnonzero(longest >= 0)
    yield order[hit], places[hit, 2] - longest[hit], places[hit, 2] - shortest[hit] + LENGTH


def _window_hashes(rows: np.ndarray) -> np.ndarray:
    """Prefix sums of every row's left and right context, in the order of the text."""
    text = np.concatenate([rows[:, LENGTH + 1 : -1][:, ::-1], rows[:, :LENGTH]], axis=1).astype(np.uint64) + np.uint64(1)
    raised, _ = powers(REACH + LENGTH + 1)
    sums = np.zeros((len(rows), REACH + LENGTH + 1), np.uint64)
    np.cumsum(text * raised[None, :-1], axis=1, out=sums[:, 1:], dtype=np.uint64)
    return sums


def _gram_names(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :GRAM]).view(f"S{GRAM}").reshape(-1)


def _gram_hashes(rows: np.ndarray) -> np.ndarray:
    raised, _ = powers(GRAM)
    return mixed(((rows[:, :GRAM].astype(np.uint64) + np.uint64(1)) * raised[None, :]).sum(axis=1, dtype=np.uint64))


def _placed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and places (id, th, position) of the anchors of all texts, about ``size`` at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for doc_id, th, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "at")), strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            at = np.sort(np.array(at, np.int64))
            at = at[at <= len(data) - GRAM]  # texts of one hash share their anchors
            for k in range(0, len(at), size):
                part = at[k : k + size]
                place = np.empty((len(part), 3), np.int64)
                place[:, 0], place[:, 1], place[:, 2] = -(1 << 63) if doc_id is None else doc_id, th, part
                held.append((_contexts(data, len(data), part), place))
                if sum(len(p) for _, p in held) >= size:
                    yield np.concatenate([r for r, _ in held]), np.concatenate([p for _, p in held])
                    held = []
    if held:
        yield np.concatenate([r for r, _ in held]), np.concatenate([p for _, p in held])


SPANS = "doc_id long, th long, start long, end long"


def _span_batch(doc_id: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_id), pa.array(th), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "th", "start", "end"])


def _spans(suspects: DataFrame, total: int) -> DataFrame:
    """(doc_id, th, start, end) of repeated bytes. ``suspects``: doc_id, th, text, at (anchors)."""
    wanted = max(1, -(-total // RANGE))
    sections, ranges = -(-wanted // RANGES), min(RANGES, wanted)
    chance = min(1.0, 64.0 * ranges / max(1, total))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for th, text, at in zip(*(batch.column(c).to_pylist() for c in ("th", "text", "at")), strict=True):
                raw, at = (text or "").encode(), np.array(at, np.uint64)
                drawn = at[mixed(at ^ np.uint64(th & 0xFFFFFFFFFFFFFFFF)) < np.uint64(chance * 0xFFFFFFFFFFFFF000)]
                out += [raw[p : p + GRAM] for p in drawn.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["gram"])

    splitters = common = np.zeros(0, f"S{GRAM}")
    if ranges > 1:  # about 64 grams per range, at most a million
        drawn = np.sort(np.array([bytes(r["gram"]) for r in suspects.mapInArrow(sample, "gram binary").toLocalIterator()], f"S{GRAM}"))
        if len(drawn):
            splitters, times = np.unique(drawn[np.arange(1, ranges) * len(drawn) // ranges], return_counts=True)
            common = splitters[times > 1]

    def make_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, places in _placed(batches, RUN):
            plain = ~np.isin(_gram_names(rows), common) if len(common) else np.ones(len(rows), bool)
            if plain.any():
                yield from _ship(rows[plain], places[plain], splitters, sections, ranges)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[bytes] = []
        now = None
        for batch in batches:
            for at, block, doc_id, th, start, end in zip(*(batch.column(c).to_pylist() for c in ("range", "block", "doc_id", "th", "start", "end")), strict=True):
                if at != now and blocks:
                    yield from _merged(blocks)
                    blocks = []
                now = at
                if block is not None:
                    blocks.append(block)
                if doc_id:
                    yield _span_batch(doc_id, th, start, end)
        if blocks:
            yield from _merged(blocks)

    shipped = suspects.mapInArrow(make_runs, "range int, block binary, doc_id array<long>, th array<long>, start array<long>, end array<long>")
    spans = shipped.repartitionById(sections * ranges, F.col("range")).sortWithinPartitions("range").mapInArrow(merge, SPANS)
    return spans.unionByName(_common_spans(suspects, common)) if len(common) else spans


def _common_spans(suspects: DataFrame, common: np.ndarray) -> DataFrame:
    """The same for suffixes that start with one of the ``common`` grams (sorted), by an exchange of window hashes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, places in _placed(batches, WINDOWED):
            own = np.isin(_gram_names(rows), common)
            if not own.any():
                continue
            rows, places = rows[own], places[own]
            order = np.lexsort((places[:, 2], places[:, 1], places[:, 0]))
            rows, places = rows[order], places[order]
            sums, grams = _window_hashes(rows), _gram_hashes(rows)
            _, inverse = powers(REACH + LENGTH + 1)
            shortest, longest = np.full(len(rows), LENGTH), np.full(len(rows), -1)
            out: list[list[np.ndarray]] = [[], [], []]
            for shift in range(REACH + 1):
                ok = np.flatnonzero((rows[:, -1] >= shift) & (rows[:, LENGTH] >= LENGTH - shift))
                hashed = mixed(((sums[ok, REACH - shift + LENGTH] - sums[ok, REACH - shift]) * inverse[REACH - shift]) ^ grams[ok])
                by = np.argsort(hashed, kind="stable")
                new = np.append(True, hashed[by][1:] != hashed[by][:-1])[: len(by)]
                first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
                again = ok[by[(places[ok[by]] != places[ok[by[first]]]).any(axis=1)]]
                shortest[again] = np.minimum(shortest[again], shift)
                longest[again] = shift
                lead = by[new]
                for column, values in zip(out, (hashed[lead].view(np.int64), ok[lead], np.full(len(lead), shift)), strict=True):
                    column.append(values)
            hashed, row, shift = (np.concatenate(c) for c in out)
            hit = np.flatnonzero(longest >= 0)
            key = np.append(hashed, mixed(places[hit, 1].view(np.uint64) ^ mixed(places[hit, 2].astype(np.uint64))).view(np.int64))
            doc_id, th = np.append(places[row, 0], places[hit, 0]), np.append(places[row, 1], places[hit, 1])
            start = np.append(places[row, 2] - shift, places[hit, 2] - longest[hit])
            end = np.append(places[row, 2] - shift + LENGTH, places[hit, 2] - shortest[hit] + LENGTH)
            sure = np.append(np.zeros(len(row), bool), np.ones(len(hit), bool))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, doc_id, th, start, end, sure)], names=["key", "doc_id", "th", "start", "end", "sure"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of equal windows all but the one of the least place are repeats.
        first: np.ndarray | None = None
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(5)], axis=1)
            sure = np.array(batch.column(5).to_pylist(), bool)
            if sure.any():
                yield _span_batch(*rows[sure, 1:].T)
            rows = rows[~sure]
            if not len(rows):
                continue
            if first is not None:
                rows = np.concatenate([first[None, :], rows])
            new = np.append(True, rows[1:, 0] != rows[:-1, 0])
            lead = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
            again = (rows[:, 1:4] != lead[:, 1:4]).any(axis=1)
            if again.any():
                yield _span_batch(*rows[again, 1:].T)
            first = lead[-1]

    sent = suspects.mapInArrow(windows, "key long, doc_id long, th long, start long, end long, sure boolean")
    return sent.repartition("key").sortWithinPartitions("key", "doc_id", "th", "start").mapInArrow(later, SPANS)


def _ship(rows: np.ndarray, places: np.ndarray, splitters: np.ndarray, sections: int, per_section: int) -> Iterator[pa.RecordBatch]:
    """One front-coded piece of the run per range; suffixes that an earlier one of the run equals go as repeats."""
    names = rows.view(f"S{WIDTH}").reshape(-1)
    by_place = np.lexsort((places[:, 2], places[:, 1], places[:, 0]))
    order = by_place[np.argsort(names[by_place], kind="stable")]
    rows, places, names = rows[order], places[order], names[order]
    new = np.append(True, names[1:] != names[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    again = ~new & (places != places[first]).any(axis=1)
    start = np.maximum(0, places[:, 2] - rows[:, -1].astype(np.int64))
    end = places[:, 2] + rows[:, LENGTH].astype(np.int64)
    again &= end - start >= LENGTH
    ranges = np.searchsorted(splitters, _gram_names(rows), "right")
    if sections > 1:
        ranges = ranges + per_section * (_gram_hashes(rows) % np.uint64(sections)).astype(np.int64)
    by_range = np.argsort(ranges, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, np.diff(ranges[by_range]) != 0)), len(ranges))
    out = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = by_range[lo:hi]
        r, kept, done = int(ranges[own[0]]), own[new[own]], own[again[own]]
        out.append({
            "range": r, "block": _front_coded(rows[kept], places[kept]), "doc_id": places[done, 0], "th": places[done, 1], "start": start[done], "end": end[done],
        })
    longs = pa.list_(pa.int64())
    kinds = {"range": pa.int32(), "block": pa.binary(), "doc_id": longs, "th": longs, "start": longs, "end": longs}
    yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in kinds.items()], names=list(kinds))


def _merged(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of a range and gives the repeats among suffixes with a common gram."""
    runs = [_decoded(b) for b in blocks]
    order, common = merge_runs([([r.tobytes() for r in np.ascontiguousarray(rows[:, :LENGTH])], c.tolist()) for rows, _, c in runs])
    order, common = np.array(order), np.array(common)
    bases = np.cumsum([0, *(len(p) for _, p, _ in runs)])
    picked = np.empty(len(order), np.int64)
    for k in range(len(runs)):
        picked[order == k] = bases[k] + np.arange(len(runs[k][1]))
    rows, places = np.concatenate([r for r, _, _ in runs])[picked], np.concatenate([p for _, p, _ in runs])[picked]
    first = np.flatnonzero(np.append(True, common[1:] < GRAM))
    ends = np.append(first[1:], len(rows))
    several = ends - first > 1
    batch, size = [], 0
    for s, e in zip(first[several].tolist(), ends[several].tolist(), strict=True):
        batch.append((s, e))
        size += e - s
        if size > 1 << 14:
            yield from _given(rows, places, batch)
            batch, size = [], 0
    if batch:
        yield from _given(rows, places, batch)


def _given(rows: np.ndarray, places: np.ndarray, groups: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    index = np.concatenate([np.arange(s, e) for s, e in groups])
    for row, start, end in _repeats(rows[index], places[index]):
        own = places[index][row]
        yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(start), pa.array(end)], names=["doc_id", "th", "start", "end"])


def _cut(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, th, text, spans) to doc_id, th, removed (merged spans), kept_sha256, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, th, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "spans")), strict=True):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in spans):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append({"doc_id": doc_id, "th": th, "n_removed": len(raw) - len(rest), "n_spans": len(merged), "kept_sha256": hashlib.sha256(rest).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return texts.mapInArrow(run, "doc_id long, th long, n_removed long, n_spans long, kept_sha256 string")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _alike(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay) per document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", _text_hash(F.col("text")))
    slim = stage(rows.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole")), "dedup-slim")
    owner = slim.groupBy("th", "whole").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("o")).select("th", "whole", F.col("o.doc_id").alias("owner"))

    anchors = _repeated_anchors(rows.select("th", "text")).groupBy("th").agg(F.collect_set("at").alias("at"))
    listed = anchors.join(owner, "th").select(F.col("th").alias("_th"), "owner", "at")
    suspects = stage_table(
        rows.join(listed, (F.col("th") == F.col("_th")) & _alike("doc_id", "owner")).select("doc_id", "th", "text", "at"), "dedup-suspects", n=F.sum(F.size("at"))
    )
    spans = _spans(suspects.df, suspects.metrics["n"] or 0)
    spans = spans.groupBy(F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")).alias("_d"), F.col("th").alias("_t")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    texts = suspects.df.select("doc_id", "th", "text").join(spans, _alike("doc_id", "_d") & (F.col("th") == F.col("_t")))
    done = _cut(texts.select("doc_id", "th", "text", "spans")).dropDuplicates(["doc_id", "th"]).withColumnsRenamed({"doc_id": "_d", "th": "_t"})

    judged = skew_join(slim, owner, ["th", "whole"]).withColumn("copy", ~_alike("doc_id", "owner") & (F.col("n_bytes") >= LENGTH))
    judged = judged.join(done, _alike("doc_id", "_d") & (F.col("th") == F.col("_t")), "left")
    pick = lambda whole, part, none: F.when(F.col("copy"), whole).otherwise(F.coalesce(part, none))
    return judged.select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit("").cast("binary"), 256), F.col("kept_sha256"), F.col("whole")).alias("kept_sha256"),
    )
