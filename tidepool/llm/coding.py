"""Integer arrays as short bytes: byte planes under zstd, sorted ones by their differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(values: np.ndarray) -> bytes:
    """``unpacked`` gives the array back. Planes of high bytes are mostly zeros and cost nothing."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return np.int64(len(values)).tobytes() + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    n, width = int(np.frombuffer(raw[:8], np.int64)[0]), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(raw[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).reshape(-1)


def packed_sorted(values: np.ndarray) -> bytes:
    """For ascending unsigned 64-bit values."""
    return packed(np.diff(values, prepend=np.zeros(1, values.dtype)))


def unpacked_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)
