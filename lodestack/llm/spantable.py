"""A worker's memory of what short spans of text map to, so that each different span is worked out once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from lodestack.llm import flat

#: Different spans that one worker remembers, and bytes of them; others are worked out wherever they are met.
REMEMBERED, REMEMBERED_BYTES = 5 << 17, 32 << 20
#: Spans over so many bytes are hashed whole by XXH64, shorter ones by the rolling hash.
LONG = 256


#: Masks of a little-endian word's first bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """make()'s result, kept in this worker until another key is asked for: workers live on from stage to stage, and so would what they hold."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


class SpanTable:
    """values(data, starts, ends): the numbers of every span, one after the other, and how many each has.

    work takes a list of spans (bytes) and returns their numbers, flat, and the counts. Spans are found by
    hash and taken for equal only if their bytes are.
    """

    def __init__(self, work: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype=np.int32):
        self.work, self.dtype = work, dtype
        self.n = self.kept = 0  # rows in use, and those that can be found again
        self.keys = np.zeros(1 << 16, np.uint64)  # open addressing: a hash, and its row where one is kept
        self.rows = np.full(1 << 16, -1, np.int32)
        self.flat = np.zeros(1 << 12, self.dtype)
        self.cuts = np.zeros(1 << 10, np.int64)  # where each row's numbers start, and the end of the last
        self.text = np.zeros(1 << 12, np.uint8)  # the same of each row's bytes
        self.text_cuts = np.zeros(1 << 10, np.int64)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of every hash, -1 if there is none, and the place where its search ended."""
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            spot = at[left]
            row = self.rows[spot]
            same = self.keys[spot] == hashes[left]
            out[left[same]] = row[same]
            left = left[~same & (row >= 0)]
            at[left] = (at[left] + 1) & mask
        return out, at

    def _put(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Keeps different hashes that are not there yet."""
        while len(hashes):
            _, at = self._find(hashes)
            _, one = np.unique(at, return_index=True)  # of those that end at one place, the others go on
            self.keys[at[one]], self.rows[at[one]] = hashes[one], rows[one]
            rest = np.ones(len(hashes), bool)
            rest[one] = False
            hashes, rows = hashes[rest], rows[rest]

    def _append(self, spans: list[bytes]) -> None:
        """Rows of spans, from self.n on."""
        numbers, counts = self.work(spans)
        raw = np.frombuffer(b"".join(spans), np.uint8)
        n, more = self.n, len(spans)
        self.flat, self.cuts = _grown(self.flat, self.cuts, n, numbers, counts)
        self.text, self.text_cuts = _grown(self.text, self.text_cuts, n, raw, np.fromiter(map(len, spans), np.int64, more))
        self.n = n + more

    def _add(self, hashes: np.ndarray, spans: list[bytes]) -> None:
        n = self.n
        self._append(spans)
        if self.n > REMEMBERED or self.text_cuts[self.n] > REMEMBERED_BYTES:
            return
        self.kept = self.n
        if 2 * self.n > len(self.keys):
            kept = self.rows >= 0
            old = self.keys[kept], self.rows[kept]
            size = 2 * len(self.keys)
            while size < 2 * self.n:
                size *= 2
            self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            self._put(*old)
        self._put(hashes, np.arange(n, self.n))

    def _differ(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The spans whose bytes are not those of their rows: their first eight and last eight, and the others of longer ones."""
        low, size = self.text_cuts[rows], ends - starts
        other = self.text_cuts[rows + 1] - low != size
        mine, theirs = _eights(np.concatenate((data, np.zeros(8, np.uint8)))), _eights(self.text)
        other |= (mine[starts] ^ theirs[low]) & _FIRST[np.minimum(size, 8)] != 0
        more = np.flatnonzero((size > 8) & ~other)
        other[more] = mine[ends[more] - 8] != theirs[low[more] + size[more] - 8]
        long = more[size[more] > 16]
        unlike = data[flat.ranges(starts[long], size[long])] != self.text[flat.ranges(low[long], size[long])]
        if unlike.any():
            other[np.repeat(long, size[long])[unlike]] = True
        return np.flatnonzero(other)

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of every span in flat and cuts."""
        hashes = flat.span_hashes(data, starts, ends)
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
        hashes[hashes == 0] = 1
        self.n = self.kept
        rows, _ = self._find(hashes)
        miss = np.flatnonzero(rows < 0)
        of = lambda which: [raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist())]
        raw = data.tobytes()
        if len(miss):
            unique, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            n = self.n
            self._add(unique, of(miss[first]))
            rows[miss] = n + inverse
        odd = self._differ(data, starts, ends, rows)
        if len(odd):  # other spans of the same hash: worked out here and not remembered
            n = self.n
            self._append(of(odd))
            rows[odd] = np.arange(n, self.n)
        return rows

    def values(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.slots(data, starts, ends)
        counts = self.cuts[rows + 1] - self.cuts[rows]
        return self.flat[flat.ranges(self.cuts[rows], counts)], counts


def _grown(values: np.ndarray, cuts: np.ndarray, n: int, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values and cuts of n rows with more rows after them."""
    used = int(cuts[n])
    if used + len(more) + 8 > len(values):
        values = np.concatenate((values, np.zeros(used + len(more) + 8, values.dtype)))
    values[used : used + len(more)] = more
    if n + len(counts) + 1 > len(cuts):
        cuts = np.concatenate((cuts, np.zeros(n + len(counts) + 1, np.int64)))
    cuts[n + 1 : n + len(counts) + 1] = used + np.cumsum(counts)
    return values, cuts


def lists(numbers: np.ndarray, counts: np.ndarray, first_span: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and offsets per row, where row i has the spans from first_span[i] to first_span[i + 1]; end closes every row."""
    upto = np.concatenate(([0], np.cumsum(counts)))[first_span]
    if end is None:
        return numbers, upto
    n = len(first_span) - 1
    out = np.full(len(numbers) + n, end, numbers.dtype)
    out[np.arange(len(numbers)) + np.repeat(np.arange(n), np.diff(upto))] = numbers
    return out, upto + np.arange(n + 1)
