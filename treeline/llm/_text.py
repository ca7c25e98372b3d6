"""Vectorised access to Arrow text columns: bytes, words and n-gram hashes without a Python loop per word."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about this many bytes, so that temporary arrays stay in cache.
BLOCK = 1 << 19
#: Bits of an n-gram hash; the row number within a block takes the rest of a 64-bit sort key.
GRAM_BITS = 53
GRAM_MASK = np.uint64((1 << GRAM_BITS) - 1)
MAX_ROWS = 1 << (64 - GRAM_BITS)

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_powers = {"p": np.ones(1, _U), "i": np.ones(1, _U), "q": np.ones(1, _U), "j": np.ones(1, _U)}
#: A second polynomial modulo a prime: modulo a power of two alone, Thue-Morse words of 1,024 letters have one hash.
_PRIME = (1 << 31) - 1
_POINT = 1_640_531_527

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start offsets (one more than rows) and which rows are not null. No copy is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = np.ones(len(column), bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    return data, offsets, valid


def blocks(offsets: np.ndarray, size: int = BLOCK, rows: int = MAX_ROWS):
    """(first, last + 1) of runs of rows with about `size` bytes; a longer text is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + rows)
        yield lo, hi
        lo = hi


def powers(n: int) -> tuple[np.ndarray, ...]:
    """The first n powers of the hash base and of its inverse, modulo 2**64, then those of the point modulo the prime."""
    kept = _powers
    if len(kept["p"]) < n:
        m, made = max(n, BLOCK + 2), {}
        for k, b in (("p", _BASE), ("i", _INV)):
            x = np.full(m, b, _U)
            x[0] = 1
            made[k] = np.multiply.accumulate(x)
        for k, b in (("q", _POINT), ("j", pow(_POINT, -1, _PRIME))):
            x = np.ones(1, _U)
            while len(x) < m:
                x = np.concatenate([x, x[: m - len(x)] * _U(pow(b, len(x), _PRIME)) % _U(_PRIME)])
            made[k] = x
        # Tables for a single very long word are not kept.
        if m <= 4 * BLOCK:
            kept.update(made)
        kept = made
    return tuple(kept[k][:n] for k in "piqj")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for many spans in order, from differences of running sums."""
    if len(data) > 2 * BLOCK and len(start) > 1:
        # A hash does not depend on where its span lies, so that long data are worked on in parts.
        at = np.unique(np.append(np.searchsorted(start, np.arange(0, len(data), BLOCK)), len(start)))
        return np.concatenate([span_hashes(data[start[a] : end[z - 1]], start[a:z] - start[a], end[a:z] - start[a]) for a, z in zip(at, at[1:])])
    p, inverse, q, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    value = data.astype(_U) + _U(1)
    np.cumsum(value * p[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    # Terms are below 2**40, so that sums over 16 million bytes stay exact; longer data are summed modulo the prime.
    value *= q[: len(data)]
    if len(data) > 1 << 23:
        value %= _U(_PRIME)
    np.cumsum(value, out=total[1:])
    second = (total[end] - total[start]) % _U(_PRIME) * back[start] % _U(_PRIME)
    return mix(h + second * _U(0xC2B2AE3D27D4EB4F) + (end - start).astype(_U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the words, which are runs of ASCII letters and digits and of any other byte above 127.

    offsets count from the start of data.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return row, start, end


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct word n-gram of each row, by row and then hash. Fewer words than n are one gram."""
    row, start, end = words(data, offsets)
    h = span_hashes(data, start, end) if len(start) else np.zeros(0, _U)
    g = h.copy() if n == 1 else None
    if n > 1:
        m = len(h) - n + 1
        count = np.bincount(row, minlength=len(offsets) - 1)
        if m > 0:
            g = h[:m].copy()
            for k in range(1, n):
                g = mix(g * _U(0xC2B2AE3D27D4EB4F) + h[k : k + m])
            whole = row[:m] == row[n - 1 :]
            g, rows = g[whole], row[:m][whole]
        else:
            g, rows = np.zeros(0, _U), np.zeros(0, np.int64)
        for r in np.flatnonzero((count > 0) & (count < n)):
            own = h[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
            x = own[:1].copy()
            for k in range(1, len(own)):
                x = mix(x * _U(0xC2B2AE3D27D4EB4F) + own[k : k + 1])
            g, rows = np.concatenate([g, mix(x + _U(len(own)))]), np.concatenate([rows, [r]])
        row = rows
    key = (row.astype(_U) << _U(GRAM_BITS)) | (g & GRAM_MASK)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> _U(GRAM_BITS)).astype(np.int64), key & GRAM_MASK


def _frugal() -> None:
    """In Python workers, which live on beside those of other stages: large arrays are mapped, so that they go back to the
    system as they are freed, and Arrow's are as well."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if "pyspark.worker" in sys.modules and mallopt:
        mallopt(-3, 1 << 20)
        pa.set_memory_pool(pa.system_memory_pool())


_frugal()


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on after a task, beside other stages'."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts_of(column: pa.Array):
    """For runs of rows: first row, last row + 1, their bytes and offsets within those bytes."""
    data, offsets, _ = text_bytes(column)
    for lo, hi in blocks(offsets):
        a, b = offsets[lo], offsets[hi]
        yield lo, hi, data[a:b], offsets[lo : hi + 1] - a


def pack(values: np.ndarray) -> bytes:
    """Sorted 32- or 64-bit numbers as compressed byte planes of their differences."""
    d = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, values.itemsize).T)
    return values.dtype.str.encode() + pa.compress(planes.tobytes(), codec="lz4", asbytes=True) + len(values).to_bytes(8, "little") if len(values) else b""


def unpack(blob: bytes) -> np.ndarray:
    dtype = np.dtype(bytes(blob[:3]).decode())
    n = int.from_bytes(blob[-8:], "little")
    planes = np.frombuffer(pa.decompress(blob[3:-8], decompressed_size=n * dtype.itemsize, codec="lz4", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype), dtype=dtype)
