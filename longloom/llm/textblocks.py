"""Arrow text columns as flat numpy byte blocks, and vectorised word hashing.

Helpers for operators that run numpy inside Spark tasks: a record batch is cut into blocks of
bounded size, every block is one ``uint8`` buffer plus document offsets, and all work on a block
is array arithmetic.  A document larger than the bound forms a block of its own.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 1 << 20

# ASCII white space 0x20 and 0x09-0x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# everything below 0x80 that is no digit and no lower-case letter
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x80] = True
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x61:0x7B] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def text_bytes(col):
    """A string column (nulls become empty texts) as ``(uint8 data, int64 offsets)``."""
    import pyarrow as pa
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def blocks(data: np.ndarray, off: np.ndarray, limit: int = BLOCK_BYTES):
    """Cut documents into runs of at most ``limit`` bytes: ``(first, last, data, offsets)``."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (works on a copy)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BASE = 0x5851F42D4C957F2D  # odd
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict = {}


def powers(n: int):
    """``base ** i`` and ``base ** -i`` modulo 2**64 for i < n (grown on demand, kept by the worker)."""
    have = _POWERS.get("n", 0)
    if have < n:
        n = max(n, 1 << 16)
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _POWERS.update(n=n, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """``q`` such that the hash of ``data[s:e]`` is ``(q[e] - q[s]) * base ** -s``."""
    up, _ = powers(len(data) + 1)
    q = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=q[1:])
    return q


def span_hash(q: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(q))
    return mix64((q[end] - q[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray):
    """Word spans of every document of a block: ``(start, end, first)`` where document ``d`` owns
    the words ``first[d] : first[d + 1]``.  Words never cross a document end."""
    n = len(data)
    sep = np.ones(n + 1, bool)
    sep[:n] = separator[data]
    cut = np.zeros(n + 1, bool)      # a document starts here
    cut[off[:-1]] = True
    inside = ~sep
    before = np.ones(n + 1, bool)
    before[1:] = sep[:-1]
    start = np.flatnonzero(inside & (before | cut))
    after = np.ones(n + 1, bool)
    after[:-1] = sep[1:] | cut[1:]
    end = np.flatnonzero(inside & after) + 1
    first = np.searchsorted(start, off)
    return start, end, first


def pack_texts(batches):
    """For ``mapInArrow``: the last column, a text, becomes ``packed``, its compressed bytes.  Texts that
    travel between tasks take less than half of the disk this way."""
    import pyarrow as pa
    import zstandard
    z = zstandard.ZstdCompressor(level=1)
    for rb in batches:
        data, off = text_bytes(rb.column(rb.num_columns - 1))
        raw = data.tobytes()
        packed = pa.array([z.compress(raw[a:b]) for a, b in zip(off.tolist(), off[1:].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*rb.columns[:-1], packed], names=[*rb.schema.names[:-1], "packed"])


def unpacker():
    """Function from a packed cell to its bytes."""
    import zstandard
    z = zstandard.ZstdDecompressor()
    return lambda cell: z.decompress(cell.as_buffer()) if len(cell.as_buffer()) else b""
