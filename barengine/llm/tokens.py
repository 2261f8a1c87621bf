"""Words of Arrow text columns as 64-bit hashes, computed in NumPy.

Used inside ``mapInArrow``: a batch's UTF-8 buffer is cut at white space and
every word gets a polynomial hash of its bytes (A-Z in lower case), finished
with a bit mixer, so no Python object is made per word. Two different words
share a hash with probability 2^-64.

Texts are walked in pieces of ``STEP`` bytes, cut at white space, so memory
does not grow with the length of a text beyond eight bytes per word, and a piece's arrays stay in a core's cache.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of texts that callers gather, and bytes that are hashed at once.
PIECE = 1 << 20
STEP = 1 << 16
#: Mean bytes of a row from which rows are copied one by one.
LONG_ROW = 64
_R = 0x9E3779B97F4A7C15 | 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finisher of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
_INV = np.uint64(pow(_R, -1, 1 << 64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_R, STEP + 1)
_IPOW = _powers(int(_INV), STEP + 1)


def _piece(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of at most STEP bytes."""
    space = np.take(_SPACE, b)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    if not space[-1]:
        edge = np.concatenate([edge, [len(b)]])
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    value = np.take(_BYTE, b)
    value *= _POW[:len(b)]
    np.cumsum(value, out=total[1:])
    total = np.take(total, edge)
    h = total[1::2] - total[0::2]
    h *= np.take(_IPOW, starts)
    h ^= (ends - starts).view(np.uint64)
    return starts, ends, mix64(h)


def _long_word(b: np.ndarray) -> np.uint64:
    """The hash of one word of any length."""
    step = min(PIECE, STEP)
    total, shift = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(0, len(b), step):
            part = b[i:i + step]
            total += np.sum(_BYTE[part] * _POW[:len(part)], dtype=np.uint64) * shift
            shift = shift * _POW[step]
        return mix64(np.array([total ^ np.uint64(len(b))], dtype=np.uint64))[0]


def text_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a byte array of any length."""
    if len(b) == 0:
        e = np.empty(0, dtype=np.int64)
        return e, e, np.empty(0, dtype=np.uint64)
    step = min(PIECE, STEP)
    if len(b) <= step:
        return _piece(b)
    parts, at = [], 0
    while at < len(b):
        end = min(at + step, len(b))
        if end < len(b) and not _SPACE[b[end]]:
            for tail in (256, step):
                back = np.flatnonzero(_SPACE[b[max(at, end - tail):end]])
                if len(back):
                    break
            if len(back):
                end = max(at, end - tail) + int(back[-1]) + 1
            else:  # one word longer than a piece
                end = at
                while end < len(b) and not _SPACE[b[end:end + step]].any():
                    end += step
                end = min(len(b), end + (int(np.flatnonzero(_SPACE[b[end:end + step]])[0]) if end < len(b) else 0))
                parts.append((np.array([at]), np.array([end]), np.array([_long_word(b[at:end])], dtype=np.uint64)))
                at = end
                continue
        s, e, h = _piece(b[at:end])
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    return off, (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8))


def row_pieces(off: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges with at most ``limit`` bytes of text each (one row at least)."""
    out, at, n = [], 0, len(off) - 1
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        out.append((at, end))
        at = end
    return out


def range_words(off: np.ndarray, data: np.ndarray, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows a..z-1: (row of each word counted from a, hashes, counts per row).

    Rows are walked together: their bytes are laid one after another with a space between them.
    """
    lens = np.diff(off[a:z + 1])
    n = z - a
    buf = np.full(int(lens.sum()) + n, 0x20, dtype=np.uint8)
    new = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    src = data[off[a]:off[z]]
    if len(src) >= LONG_ROW * n:
        at = (off[a:z] - off[a]).tolist()
        for i, (to, size) in enumerate(zip(new.tolist(), lens.tolist())):
            buf[to:to + size] = src[at[i]:at[i] + size]
    else:  # a byte of row r moves r places to the right
        buf[np.arange(len(src)) + np.repeat(np.arange(n), lens)] = src
    starts, _, h = text_words(buf)
    counts = np.diff(np.searchsorted(starts, new), append=len(starts))
    return np.repeat(np.arange(n), counts), h, counts


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix64(a * np.uint64(0xD6E8FEB86659FD93) + np.bitwise_xor(b, b >> np.uint64(29)) + np.uint64(0x632BE59BD9B4E019))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word windows, sorted; of the whole sequence if it is shorter, none if it is empty."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    m = len(h) - k + 1
    out = h[:m]
    for i in range(1, k):
        out = pair_hash(out, h[i:i + m])
    return np.unique(out)
