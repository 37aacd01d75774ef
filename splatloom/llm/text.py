"""Vectorised word splitting and hashing over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, hence invertible modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each 64-bit value, another one for each seed."""
    return mix(x + np.uint64((seed + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))


#: The hashed value of each byte; upper case A-Z hashes as lower case.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUES = seeded(np.arange(256, dtype=np.uint64), 7)[_FOLD]

#: Word bytes of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after folding).
_CODE = np.arange(256)
NOT_SPACE = (_CODE != 0x20) & ((_CODE < 0x09) | (_CODE > 0x0D))
ALNUM = ((_CODE >= 0x30) & (_CODE <= 0x39)) | ((_CODE >= 0x61) & (_CODE <= 0x7A)) | ((_CODE >= 0x41) & (_CODE <= 0x5A)) | (_CODE >= 0x80)

_powers = np.ones((2, 1), np.uint64)


def _power_table(n: int) -> np.ndarray:
    """BASE**i and BASE**-i for i < n, grown by doubling and kept by the worker."""
    global _powers
    while _powers.shape[1] < n:
        k = _powers.shape[1]
        step = np.array([[pow(int(_BASE), k, 1 << 64)], [pow(int(_INVERSE), k, 1 << 64)]], np.uint64)
        _powers = np.concatenate([_powers, _powers * step], axis=1)
    return _powers


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, index, data = column.buffers()
    size = 8 if wide else 4
    offsets = np.frombuffer(index, np.int64 if wide else np.int32, len(column) + 1, column.offset * size).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row where that alone is longer."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and the index of each row's first word (with an end)."""
    mask = inside[raw]
    left, right = np.empty_like(mask), np.empty_like(mask)
    left[1:], right[:-1] = mask[:-1], mask[1:]
    if len(raw):
        edges = offsets[:-1][np.diff(offsets) > 0]
        left[edges] = False
        right[np.append(edges[1:], len(raw)) - 1] = False
    start, end = np.flatnonzero(mask & ~left), np.flatnonzero(mask & ~right) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z folded to lower case."""
    power = _power_table(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * power[0, : len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * power[1][start] + (end - start).astype(np.uint64) * _STEP)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive word hashes, at each place where they start."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + len(out)] + np.uint64(k + 1))
    return out
