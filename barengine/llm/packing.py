"""Compact binary forms of integer arrays that travel between tasks."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(a: np.ndarray) -> bytes:
    """Unsigned 32 or 64 bit integers: byte planes, Zstandard."""
    width = a.dtype.itemsize
    planes = np.ascontiguousarray(np.frombuffer(a.tobytes(), np.uint8).reshape(len(a), width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    width = b[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(np.uint32 if width == 4 else np.uint64).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers, as differences."""
    d = a.copy()
    d[1:] -= a[:-1]
    return pack(d)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)
