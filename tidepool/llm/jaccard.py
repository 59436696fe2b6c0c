"""Exact Jaccard join on word shingles: size-banded tiles, hashed bitmaps, then sorted-array intersection.

1. Every text becomes a sorted set of 64-bit shingle hashes. Equal sets are one class from here on (``sid``), so
   copies cost nothing. Shingles that many texts of one task share are noted as common (a bitmap of fixed size).
2. Prefix rule: two sets within the threshold share one of their first ``n - ceil(t n) + 1`` shingles in any order
   common to all. The order here is by hash, common ones last, so shared passages seldom make candidates. Sets that
   share a prefix shingle form a group; groups of equal members are one.
3. First pass: in every group each set is held against the group's smallest set by bitmaps. What passes gives
   tentative components.
4. Groups that hold several of them are cut into tiles of one size band (and blocks of a band), in which every two
   sets of different components are compared by bitmaps: a bit of A that B has not is at least one shingle of A that
   B has not, so ``|A| - bits(A and not B)`` bounds the overlap from above. A tile gives a forest of the highest
   bounds that joins all its candidates, one pair less than it has components.
5. These pairs and those of the first pass are intersected exactly, which gives components of real links. Tiles over
   these give another forest, and its links join further components.
6. Last, the sets that this forest named meet in tiles with finer bitmaps; the places (set and tile) that still have a
   candidate meet once more as sorted arrays. Such a tile intersects every pair that bitmaps allow between components
   still apart, and gives a link for each two components it joins. Sets already connected are not compared again and
   a tile gives no more rows than it has sets, so all passes are linear. Components only merge and a forest names
   every set of its candidates, so each pass holds only the sets that the one before named.

Nothing is capped: common shingles only change the order, and large groups only get more tiles.

Defined cases: NULL and empty texts (and texts without words) have no shingles and are linked with nothing; a text
shorter than a shingle is one shingle; a NULL id is no smallest id, so such a row's component may be NULL; repeated
rows and ids are rows of their own, of one class if their texts are alike; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.links import components
from tidepool.llm.tokens import mixed, shingle_sets, text_chunks
from tidepool.runtime import Staged, stage, stage_table

WORDS = 4
PERCENT = 85
COMMON_BITS = 20
COMMON_HERE = 4  # texts of one batch that make a shingle worth counting
COMMON_ALL = 64  # texts in all that make it common
BLOCK = 1024  # sets per side of a tile
TILE_BYTES = 64 << 20  # about, of bitmaps or arrays per side of a tile
TILE = ["gid", "tile", "i", "j"]
MASK_BITS = 1 << 24
SPREAD = 64  # sets compared with one copy of a group's smallest set


def _set_id(hashes: np.ndarray) -> int:
    total = np.sum(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def _common(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Bitmap over the low bits of the hashes of common shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, np.ndarray] = {}
            for _, data, offsets in text_chunks(batch.column(0)):
                for s in shingle_sets(data, offsets, words):
                    if len(s):
                        held[_set_id(s)] = s
                if sum(map(len, held.values())) > 4 << 20:
                    yield _often(held)
                    held = {}
            if held:
                yield _often(held)

    counted = docs.select(text).mapInArrow(count, "bit long, h long, n long")
    often = counted.groupBy("h", "bit").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_ALL).select("bit").distinct()
    bits = np.zeros(1 << COMMON_BITS, bool)
    bits[often.toPandas()["bit"].to_numpy(np.int64)] = True  # at most 2**COMMON_BITS numbers
    return np.packbits(bits)


def _often(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    hashes, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
    hashes, n = hashes[n >= COMMON_HERE], n[n >= COMMON_HERE]
    return pa.RecordBatch.from_arrays([pa.array((hashes & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64)), pa.array(hashes.view(np.int64)), pa.array(n)], names=["bit", "h", "n"])


def _bitmap(hashes: np.ndarray, spread: int = 2) -> bytes:
    """One bit per hash, in a power of two of at least ``spread`` times as many bits."""
    width = max(64, 1 << (spread * len(hashes) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(hashes >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _fine(hashes: np.ndarray) -> bytes:
    return _bitmap(hashes, 5)


def _folded(bits: bytes, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def _least(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return (percent * n + 99) // 100


def sketches(docs: DataFrame, text: str, words: int, percent: int) -> Staged:
    """Staged: docs' other columns, n, sid (NULL without shingles), bits, prefix (empty if this task had the set before)."""
    kept = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, text, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(shared.value).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(text)):
                out: dict[str, list] = {"n": [], "sid": [], "bits": [], "prefix": []}
                for s in shingle_sets(data, offsets, words):
                    n = len(s)
                    sid = _set_id(s) if n else None
                    new = n and sid not in seen
                    if new:
                        often = common[s & np.uint64((1 << COMMON_BITS) - 1)]
                        prefix = np.concatenate([s[~often], s[often]])[: n - _least(n, percent) + 1].view(np.int64)
                        seen.add(sid)
                    out["n"].append(n)
                    out["sid"].append(sid)
                    out["bits"].append(_bitmap(s) if new else None)
                    out["prefix"].append(prefix if new else [])
                part = batch.slice(row, len(out["n"]))
                arrays = [pa.array(out["n"], pa.int64()), pa.array(out["sid"], pa.int64()), pa.array(out["bits"], pa.binary()), pa.array(out["prefix"], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *arrays], names=[*kept, "n", "sid", "bits", "prefix"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return stage_table(docs.mapInArrow(run, f"{fields}, n long, sid long, bits binary, prefix array<long>"), "jaccard-sketch")


def _groups(sketch: DataFrame) -> DataFrame:
    """(gid, lead, sid): sets that share a prefix shingle, one group per set of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2), np.int64)
        large: tuple[int, int] | None = None  # token and smallest set of a group given out in pieces
        seen: set[int] = set()

        def give(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
            first = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            size = np.diff(np.append(first, len(rows)))
            gid = mixed(np.add.reduceat(mixed(rows[:, 1].view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)
            keep = size > 1
            gid_kept, where = np.unique(gid[keep], return_index=True)
            where = np.flatnonzero(keep)[where[[g not in seen for g in gid_kept.tolist()]]] if len(where) else where
            if len(seen) > 500_000:
                seen.clear()
            seen.update(gid[where].tolist())
            if len(where):
                n = size[where]
                picked = np.repeat(first[where] - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield from record(np.repeat(gid[where], n), np.repeat(rows[first[where], 1], n), rows[picked, 1])

        def record(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gid", "lead", "sid"])

        def give_piece(rows: np.ndarray, at: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            name = mixed(np.array([at[0]], np.int64).view(np.uint64)).view(np.int64)[0]
            yield from record(np.full(len(rows), name), np.full(len(rows), at[1]), rows[:, 1])

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)])
            if large:
                end = int(np.searchsorted(rows[:, 0], large[0], "right"))
                yield from give_piece(rows[:end], large)
                rows = rows[end:]
                large = large if not len(rows) else None
            if not len(rows):
                held = rows
                continue
            open_ = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))
            if open_:
                yield from give(rows[:open_])
            held = rows[open_:]
            if len(held) > 1 << 20:
                large = (int(held[0, 0]), int(held[0, 1]))
                yield from give_piece(held, large)
                held = held[:0]
        if len(held):
            yield from give(held)

    tokens = sketch.filter("n > 0").select(F.explode("prefix").alias("token"), "sid")
    ordered = tokens.repartition("token").sortWithinPartitions("token", "sid")
    return stage(ordered.mapInArrow(run, "gid long, lead long, sid long").dropDuplicates(["gid", "sid"]), "jaccard-groups")


def _bound(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow a link."""
    a = sizes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    b = sizes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    near = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ba", "bb")), strict=True)
            keep = [_may_link(*r, percent) for r in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def _may_link(na: int, nb: int, ba: bytes, bb: bytes, percent: int) -> bool:
    size = min(len(ba), len(bb))
    x, y = _folded(ba, size), _folded(bb, size)
    shared = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
    return 100 * shared >= percent * (na + nb - shared)


def _tiles(rows: DataFrame, sizes: DataFrame, percent: int, shingle_bytes: float) -> Staged:
    """Sets of groups with several roots, dealt to tiles: gid, tile, i, j, home, left, sid, root. ``rows``: gid, sid, root.

    A tile holds one size band at home and the one above; large ones are cut into blocks that meet in pairs (i, j).
    """
    mixed_groups = rows.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("gid")
    rows = rows.join(mixed_groups, "gid").join(sizes.select("sid", "n"), "sid")
    # Sets within the threshold lie in one band or in neighbouring ones.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    sides = F.array(F.struct(band.alias("tile"), F.lit(True).alias("home")), F.struct((band - 1).alias("tile"), F.lit(False).alias("home")))
    places = stage_table(rows.select("gid", "sid", "root", "n", F.explode(sides).alias("at")).select("gid", "sid", "root", "n", "at.tile", "at.home"), "jaccard-places")
    counts = places.df.groupBy("gid", "tile").agg(
        F.count("*").alias("n_all"), F.sum(F.col("home").cast("int")).alias("n_home"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("n").alias("shingles"),
    )
    blocks = F.ceil(F.greatest(F.col("n_all") / BLOCK, F.col("shingles") * shingle_bytes / TILE_BYTES)).cast("int")
    counts = counts.filter("n_home > 0 AND n_all > 1 AND lo <> hi").select("gid", "tile", blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j")))
    placed = places.df.join(counts, ["gid", "tile"]).withColumn("at", F.explode(every))
    placed = placed.select("gid", "tile", "at.i", "at.j", "home", (block == F.col("at.i")).alias("left"), "sid", "root")
    done = stage_table(placed, "jaccard-tiles")
    places.drop()
    return done


def _in_tiles(placed: DataFrame, compare: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> Staged:
    """Distinct pairs (a, b) that ``compare`` gives for the tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for tile in _runs(batches, TILE):
            a, b = compare(tile)
            new = [p for p in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True) if p not in seen]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in new], pa.int64()) for k in (0, 1)], names=["a", "b"])
            if len(seen) > 500_000:
                seen.clear()
            seen.update(new)

    ordered = placed.repartition(*TILE).sortWithinPartitions(*TILE, "n")
    return stage_table(ordered.mapInArrow(run, "a long, b long").distinct(), "jaccard-pairs")


def _tile_pairs(rows: DataFrame, sizes: DataFrame, percent: int) -> Staged:
    """Per tile a forest of the likeliest pairs of different roots that pass the bitmap bound, and (a, a) for every set of such a pair."""
    tiles = _tiles(rows, sizes, percent, 0.5)
    pairs = _in_tiles(tiles.df.join(sizes, "sid"), lambda tile: _compare_tile(tile, percent))
    tiles.drop()
    return pairs


def _tile_links(rows: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> Staged:
    """Per tile links that join all components it has a link between. ``sets``: sid, n, bits (finer), hashes."""
    tiles = _tiles(rows, sizes, percent, 8.0)
    kinds = {f.name: f.dataType.simpleString() for f in tiles.df.schema}

    def open_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _runs(batches, TILE):
            yield from tile.select(list(kinds)).filter(pa.array(_has_candidate(tile, percent))).combine_chunks().to_batches()

    fine = tiles.df.join(sets.select("sid", "n", "bits"), "sid").repartition(*TILE).sortWithinPartitions(*TILE, "n")
    left = stage_table(fine.mapInArrow(open_places, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())), "jaccard-open")
    tiles.drop()
    links = _in_tiles(left.df.join(sets.select("sid", "n", "hashes"), "sid"), lambda tile: _link_tile(tile, percent))
    left.drop()
    return links


def _sorted_sets(texts: DataFrame, words: int) -> Staged:
    """sid, n, bits (finer than those of ``sketches``), hashes (sorted 64-bit shingle hashes) of ``texts``: sid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, words)
                columns = [batch.column("sid").slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([f(s) for s in sets], pa.binary()) for f in (_fine, np.ndarray.tobytes))]
                yield pa.RecordBatch.from_arrays(columns, names=["sid", "n", "bits", "hashes"])

    return stage_table(texts.mapInArrow(run, "sid long, n long, bits binary, hashes binary"), "jaccard-sets")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _forest(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Positions of the edges (a, b) of a maximum spanning forest, by Boruvka's rounds."""
    order = np.argsort(-bound, kind="stable")
    names, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    every, edge, picked = np.arange(len(names)), np.arange(len(a)), []
    while len(x):
        part, first = np.unique(np.stack([x, y], axis=1).ravel(), return_index=True)
        best = first // 2
        up = every.copy()
        up[part] = x[best] + y[best] - part
        up = np.where((up[up] == every) & (every < up), every, up)
        while (up[up] != up).any():
            up = up[up]
        picked.append(edge[np.unique(best)])
        x, y = up[x], up[y]
        apart = x != y
        x, y, edge = x[apart], y[apart], edge[apart]
    return order[np.concatenate(picked)]


@dataclass
class _Tile:
    """A tile's sets in ascending size: which are compared with which."""

    n: np.ndarray
    sid: np.ndarray
    root: np.ndarray
    home: np.ndarray
    left: np.ndarray
    diagonal: bool

    @classmethod
    def of(cls, tile: pa.Table) -> _Tile:
        n, sid, root = (tile.column(c).to_numpy() for c in ("n", "sid", "root"))
        home, left = (np.array(tile.column(c).to_pylist(), bool) for c in ("home", "left"))
        return cls(n, sid, root, home, left, tile.column("i")[0] == tile.column("j")[0])

    def others(self, k: int, part: np.ndarray, percent: int) -> np.ndarray:
        """Sets not smaller than k that it may link with by size, of other parts."""
        other = np.arange(k + 1, int(np.searchsorted(self.n, self.n[k] * 100 // percent, "right")))
        other = other[(part[other] != part[k]) & (self.home[other] | self.home[k])]
        return other if self.diagonal else other[self.left[other] != self.left[k]]

    def bound(self, k: int, other: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Upper bound of the intersection of k with each of ``other``."""
        mine, theirs = bits[k], bits[other]
        return np.minimum(self.n[k] - np.bitwise_count(mine & ~theirs).sum(axis=1), self.n[other] - np.bitwise_count(theirs & ~mine).sum(axis=1))


def _compare_tile(tile: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    t = _Tile.of(tile)
    n, sid, root = t.n, t.sid, t.root
    raw = tile.column("bits").to_pylist()
    size = min(map(len, raw))
    bits = np.stack([_folded(b, size) for b in raw])
    found_a, found_b, bounds = [], [], []
    for k in range(len(n) - 1):
        other = t.others(k, root, percent)
        if not len(other):
            continue
        shared = t.bound(k, other, bits)
        either = n[k] + n[other] - shared
        keep = 100 * shared >= percent * either
        found_a.append(np.full(keep.sum(), k))
        found_b.append(other[keep])
        bounds.append(shared[keep] / either[keep])
    if not sum(map(len, found_a)):
        return sid[:0], sid[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    both = np.unique(np.concatenate([a, b]))
    of_forest = _forest(root[a], root[b], np.concatenate(bounds))
    return sid[np.concatenate([a[of_forest], both])], sid[np.concatenate([b[of_forest], both])]


def _has_candidate(tile: pa.Table, percent: int) -> np.ndarray:
    """Which sets of the tile may link, by their bitmaps, with one of another root."""
    t = _Tile.of(tile)
    raw = tile.column("bits").to_pylist()
    size = min(map(len, raw))
    bits = np.stack([_folded(b, size) for b in raw])
    out = np.zeros(len(raw), bool)
    for k in range(len(raw) - 1):
        other = t.others(k, t.root, percent)
        if len(other):
            shared = t.bound(k, other, bits)
            near = other[100 * shared >= percent * (t.n[k] + t.n[other] - shared)]
            out[near] = True
            out[k] |= len(near) > 0
    return out


def _link_tile(tile: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    t = _Tile.of(tile)
    n = t.n
    sets = [np.frombuffer(raw, np.uint64) for raw in tile.column("hashes").to_pylist()]
    width = min(1 << 17, max(64, 1 << (8 * int(n[-1]) - 1).bit_length()))
    bits = np.stack([np.packbits(np.bincount(((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64), minlength=width) > 0, bitorder="little").view(np.uint64) for s in sets])
    part = np.unique(t.root, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for k in range(len(n) - 1):
        other = t.others(k, part, percent)
        if len(other):
            shared = t.bound(k, other, bits)
            other = other[100 * shared >= percent * (n[k] + n[other] - shared)]
        if not len(other):
            continue
        own, theirs = sets[k], np.concatenate([sets[o] for o in other])
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        shared = np.add.reduceat(hit, np.cumsum(n[other]) - n[other], dtype=np.int64)
        for o in other[100 * shared >= percent * (n[k] + n[other] - shared)].tolist():
            if part[o] != part[k]:
                out.append((k, o))
                part[part == part[o]] = part[k]
    a, b = np.array([p[0] for p in out], np.int64), np.array([p[1] for p in out], np.int64)
    return t.sid[a], t.sid[b]


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by intersecting the sorted sets. The texts of a pair meet in a tile of one ``a``."""
    pairs = pairs.filter("a <> b")
    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("slices"))
    spread = pairs.join(slices, "a").withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int"))
    leads = spread.select("a", "slice").distinct().select("a", "slice", F.lit(0).alias("role"), F.col("a").alias("sid"))
    rows = spread.select("a", "slice", F.lit(1).alias("role"), F.col("b").alias("sid")).unionByName(leads).join(texts, "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, lead_set = None, None
        for batch in batches:
            a, role, sid, part = (batch.column(c).to_numpy() for c in ("a", "role", "sid", "slice"))
            out: list[tuple[int, int]] = []
            for at, data, offsets in text_chunks(batch.column("text")):
                for k, s in enumerate(shingle_sets(data, offsets, words), at):
                    if role[k] == 0:
                        lead, lead_set = (a[k], part[k]), s
                    elif lead == (a[k], part[k]):
                        shared = len(np.intersect1d(lead_set, s, assume_unique=True))
                        if 100 * shared >= percent * (len(lead_set) + len(s) - shared):
                            out.append((int(a[k]), int(sid[k])))
            yield pa.RecordBatch.from_pylist([{"a": x, "b": y} for x, y in out], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    ordered = rows.select("a", "slice", "role", "sid", "text").repartition("a", "slice").sortWithinPartitions("a", "slice", "role")
    return ordered.mapInArrow(run, "a long, b long")


def _masked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``_row`` is not in ``wanted``: before they are shuffled, by a bitmap of fixed size.

    The bitmap is a table of at most MASK_BITS / 64 words, so its broadcast is bounded.
    """
    place = F.pmod(F.col("_row"), F.lit(MASK_BITS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_mask"))
    return rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word").filter(F.col("_mask").bitwiseAND(F.col("_bit")) != 0).drop("_word", "_bit", "_mask")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, _row (hash of id and text), n_shingles, component_id, _root per document.

    ``_root`` names the component by one of its sets, also where ids are NULL or repeat; NULL without shingles.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("_row"), F.col(text).alias("text"))
    sketch = sketches(rows, "text", words, percent)
    groups = _groups(sketch.df)
    sizes = sketch.df.filter("bits IS NOT NULL").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    sizes = stage(sizes.join(groups.select("sid").distinct(), "sid"), "jaccard-sizes")
    slim = stage(sketch.df.select("doc_id", "_row", "n", "sid"), "jaccard-slim")
    sketch.drop()
    full = slim.filter("n > 0")

    stars = groups.filter("lead <> sid").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct()
    near = stage_table(_bound(stars, sizes, percent), "jaccard-near")
    tentative = stage(components(near.df).select(F.col("node").alias("sid"), F.col("root").alias("guess")), "jaccard-guess")
    guessed = groups.select("gid", "sid").join(tentative, "sid", "left")
    across = _tile_pairs(guessed.select("gid", "sid", F.coalesce("guess", "sid").alias("root")), sizes, percent)
    pairs = near.df.unionByName(across.df)
    # Whatever a later pass compares is in one of these pairs too, if only with itself.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(full.groupBy("sid").agg(F.min("_row").alias("_row")), "sid")
    wanted = stage(wanted, "jaccard-wanted")
    texts = stage(_masked(rows.select("_row", "text"), wanted).join(wanted.hint("merge"), "_row").select("sid", "text").dropDuplicates(["sid"]), "jaccard-texts")
    links = stage(_verified(pairs, texts, words, percent), "jaccard-links")
    near.drop()
    across.drop()

    def rooted(links: DataFrame, compared: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components of the links so far as stars, and the groups of the sets still compared with their roots."""
        root = stage(components(links).withColumnRenamed("node", "sid"), "jaccard-roots")
        stars = root.filter("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))
        return stars, groups.select("gid", "sid").join(compared, "sid").join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    stars, left = rooted(links, texts.select("sid"))
    more = _tile_pairs(left, sizes, percent)
    links = stars.unionByName(stage(_verified(more.df, texts, words, percent), "jaccard-links"))
    compared = stage(more.df.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "jaccard-compared")
    more.drop()
    stars, left = rooted(links, compared)
    sets = _sorted_sets(texts.join(compared, "sid"), words)
    final = components(stars.unionByName(_tile_links(left, sizes, sets.df, percent).df)).withColumnRenamed("node", "sid")
    sets.drop()

    ids = full.groupBy("sid").agg(F.min("doc_id").alias("least")).join(final, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = ids.join(named, "root").select("sid", "component_id", "root")
    return slim.select("doc_id", "_row", F.col("n").alias("n_shingles"), "sid").join(of_set, "sid", "left").select(
        "doc_id", "_row", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("root").alias("_root")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the smallest id (texts without words all stay once)."""
    found = classes(docs, doc_id, text, words, percent)
    kept = found.filter("n_shingles > 0").groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row")).alias("k")).select("k._row")
    kept = kept.unionByName(found.filter("n_shingles = 0").select("_row")).distinct()
    return docs.withColumn("_row", F.xxhash64(doc_id, text)).join(kept, "_row").dropDuplicates(["_row"]).select(*docs.columns)
