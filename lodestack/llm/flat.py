"""Flat numpy views of Arrow text columns: word bounds, rolling hashes, gathers.

Every helper works on one contiguous UTF-8 buffer of a few megabytes that holds whole
documents, so a task's memory does not depend on its partition's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document makes a piece of its own.
PIECE_BYTES = 1 << 20

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of [0-9a-z] and everything outside ASCII, after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: White space: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or n > len(_tables["p"]):
        size = max(n, PIECE_BYTES + 1)
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[key] = np.multiply.accumulate(steps)
    return _tables["p"][:n], _tables["q"]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    kinds = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kinds)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def bounds(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut where a row ends."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of hashes stay independent."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span's bytes, equal for equal spans in any buffer (Karp-Rabin over the prefix sums)."""
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=sums[1:])
    inner = (sums[ends] - sums[starts]) * inverse[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix(inner + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM, lower: bool = True):
    """(hash, start, end, words in the rows so far) of every word."""
    data = LOWER[data] if lower else data
    starts, ends = bounds(table[data], offsets)
    return span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of k consecutive word hashes from each place on, over the whole buffer."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _GRAM + words[j : j + n]
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the slices [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
