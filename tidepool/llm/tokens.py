"""Words, hashes and n-grams of whole columns of text at once, as numpy arrays over the raw UTF-8 bytes.

A column is cut into chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own), so memory follows
the chunk and not the Arrow batch. Hashes are 64 bits wide: a polynomial over the bytes, read off prefix sums,
then a full mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK + 1)
        step = np.full(size, BASE, np.uint64)
        step[0] = 1
        _powers = np.cumprod(step, dtype=np.uint64)
        step = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        step[0] = 1
        _inverse = np.cumprod(step, dtype=np.uint64)
    return _powers[:n], _inverse[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[i] = hash of values[:i]; a stretch [s, e) hashes to (H[e] - H[s]) * BASE**-s."""
    out = np.zeros(len(values) + 1, np.uint64)
    raised, _ = powers(len(values) + 1)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * raised[:-1], out=out[1:], dtype=np.uint64)
    return out


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) per chunk of a string or binary column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, raw_offsets, data = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for every text the index of its first word (one more at the end)."""
    inside = is_word[data]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[full] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[full[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    _, inverse = powers(len(data) + 1)
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (positions near the end are short of words and left out)."""
    count = max(0, len(hashes) - n + 1)
    out = hashes[:count]
    for k in range(1, n):
        out = mixed(out * np.uint64(BASE) + hashes[k : k + count])
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of every text; a shorter text is one shingle, one without words none."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    hashes = word_hashes(data, starts, ends)
    runs = chained(hashes, n)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(runs[lo : hi - n + 1]))
        elif hi > lo:
            out.append(chained(hashes[lo:hi], hi - lo))
        else:
            out.append(hashes[:0])
    return out
