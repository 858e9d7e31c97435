"""Chroma fingerprints of audio columns, and the alignment of recordings by them."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import flat, grams
from lodestack.llm.shared import cut, new_path
from lodestack.llm.spantable import kept

#: Samples of a frame and from one frame to the next; hertz of the lowest and highest pitch.
FRAME, HOP, LOWEST, HIGHEST = 512, 128, 55.0, 3520.0
#: Frames that a filter spans, and the log ratios between which a filter's two bits change.
SPAN, STEPS = 8, (-0.25, 0.0, 0.25)
#: Filters by rule: over four bands of pitch classes, upper against lower half, first against second half of
#: the time, both at once, and the middle against the sides of the time.
FILTERS = [(kind, low, height) for low, height in ((0, 12), (0, 6), (6, 6), (3, 6)) for kind in ("pitch", "time", "both", "middle")]
#: Equal codes at one offset, codes that overlap, and the part of their bits that may differ.
MIN_VOTES, MIN_OVERLAP, MAX_BIT_ERRORS = 1, 16, 0.15
#: Filters of a query's code whose values are nearest to a change, and how many of them may have changed at once.
WEAK, CHANGED = 8, 3
#: Steps of a pitch class's energy from silence to all.
WHOLE = 1 << 16
#: Frames transformed at once, and bytes of recordings decoded at once.
BLOCK_FRAMES, BLOCK_BYTES = 1024, 8 << 20
#: Seeds of the queries that a worker holds at once, and votes (or codes compared) that it holds at once.
BLOCK_CODES, PAIRS = 4 << 20, 1 << 18


def samples_of(media: bytes | None) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1, channels averaged, and their rate, of 8- or 16-bit PCM in a WAV file; none if it can't be read."""
    try:
        with wave.open(io.BytesIO(media or b"")) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
        kind = {1: np.uint8, 2: np.dtype("<i2")}[width]
        if rate < 1 or channels < 1:
            raise wave.Error("no rate or no channel")
        x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], kind).astype(np.float32).reshape(-1, channels).mean(1)
        return ((x - 128) / 128 if width == 1 else x / 32768), rate
    except (wave.Error, EOFError, KeyError, RuntimeError, ArithmeticError, ValueError):  # what damaged headers lead to
        return np.zeros(0, np.float32), 1


def chroma(recordings: list[np.ndarray], rate: int) -> np.ndarray:
    """Energy of the twelve pitch classes in every frame of recordings of one rate, one after the other; each frame of length 1 or silent."""
    counts = [max(0, (len(x) - FRAME) // HOP + 1) for x in recordings]
    out = np.zeros((sum(counts), 12), np.float32)
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((hertz >= LOWEST) & (hertz <= HIGHEST))
    if not len(out) or not len(used):
        return out
    pitch = np.rint(12 * np.log2(hertz[used] / 440)).astype(int) % 12
    used = used[np.argsort(pitch, kind="stable")]
    classes, first = np.unique(np.sort(pitch), return_index=True)
    window = np.hanning(FRAME).astype(np.float32)
    held: list[np.ndarray] = []
    done = n = 0

    def flush() -> None:
        nonlocal held, done, n
        if n:
            frames = np.concatenate(held)
            frames *= window
            found = np.fft.rfft(frames, axis=1)
            power = found.real**2
            power += found.imag**2
            out[done : done + n, classes] = np.add.reduceat(power.take(used, axis=1), first, axis=1)
        held, done, n = [], done + n, 0

    for x, count in zip(recordings, counts):
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] if count else None
        for low in range(0, count, BLOCK_FRAMES):  # long recordings a block at a time, short ones together
            held.append(frames[low : low + BLOCK_FRAMES])
            n += len(held[-1])
            if n >= BLOCK_FRAMES:
                flush()
    flush()
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(size > 1e-3, out / np.maximum(size, 1e-3), 0)


def coded(image: np.ndarray, weak: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """A packed 32-bit code for every SPAN frames: two Gray-coded bits a filter, from sums over the integral image.

    The image is rounded to whole steps first, so that sums are exact whatever stands before a frame. With weak
    also, for each code, the bits that the WEAK filters nearest to a change would flip, the nearest first.
    """
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros((0, WEAK), np.int32)
    sums = np.zeros((len(image) + 1, 13), np.int64)
    sums[1:, 1:] = np.rint(image * WHOLE).astype(np.int64).cumsum(0).cumsum(1)
    sums = np.ascontiguousarray(sums.T)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        band = sums[p1] - sums[p0]
        return band[t1 : t1 + n] - band[t0 : t0 + n]

    half, quarter = SPAN // 2, SPAN // 4
    out, near, flips = np.zeros(n, np.uint32), [], []
    for i, (kind, low, height) in enumerate(FILTERS):
        mid, top = low + height // 2, low + height
        if kind == "pitch":
            a = area(0, SPAN, low, mid)
        elif kind == "time":
            a = area(0, half, low, top)
        elif kind == "both":
            a = area(0, half, low, mid) + area(half, SPAN, mid, top)
        else:
            a = area(quarter, SPAN - quarter, low, top)
        rest = WHOLE + area(0, SPAN, low, top) - a
        level = np.zeros(n, np.uint32)
        for step in STEPS:
            level += WHOLE + a >= rest * np.exp(step)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
        if weak:
            far = np.abs(np.log((WHOLE + a) / rest) - np.array(STEPS)[:, None])
            step = far.argmin(0)
            near.append(far[step, np.arange(n)])
            flips.append(np.where(step == 1, 2, 1).astype(np.uint32) << np.uint32(2 * (len(FILTERS) - 1 - i)))  # the Gray bit that changes there
    if not weak:
        return out.view(np.int32), None
    nearest = np.argsort(np.array(near), axis=0, kind="stable")[:WEAK]
    return out.view(np.int32), np.take_along_axis(np.array(flips), nearest, axis=0).T.copy().view(np.int32)


def codes_of(image: np.ndarray) -> np.ndarray:
    return coded(image)[0]


def variants(flips: np.ndarray) -> np.ndarray:
    """What a code may differ by where up to CHANGED of its weak filters changed, nothing included; a row for each row of flips."""
    chosen = [c for k in range(CHANGED + 1) for c in combinations(range(flips.shape[1]), k)]
    return np.stack([np.bitwise_xor.reduce(flips[:, list(c)], axis=1) if c else np.zeros(len(flips), np.int32) for c in chosen], axis=1)


def coded_many(media: list[bytes | None], asked: list[bool] | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Codes of each WAV recording, and their weak bits where asked; all of one rate are worked on together."""
    read = [samples_of(m) for m in media]
    asked = asked or [False] * len(read)
    out: list[tuple] = [(np.zeros(0, np.int32), None)] * len(read)
    for rate in {r for _, r in read}:
        own = [i for i, (_, r) in enumerate(read) if r == rate]
        image = chroma([read[i][0] for i in own], rate)
        plain, at = codes_of(image), 0
        for i in own:
            n = max(0, (len(read[i][0]) - FRAME) // HOP + 1)
            out[i] = coded(image[at : at + n], True) if asked[i] else (plain[at : at + max(0, n - SPAN + 1)], None)
            at += n
    return out


def codes_of_many(media: list[bytes | None]) -> list[np.ndarray]:
    return [codes for codes, _ in coded_many(media)]


_CODED = pa.struct([("codes", pa.list_(pa.int32())), ("flips", pa.list_(pa.int32()))])


def _codes(media: pa.Array, asked: pa.Array) -> pa.Array:
    found, held, want, size = [], [], [], 0
    for m, q in zip(media, asked.to_pylist()):
        held.append(m.as_py())
        want.append(bool(q))
        size += len(held[-1] or b"")
        if size >= BLOCK_BYTES:
            found += coded_many(held, want)
            held, want, size = [], [], 0
    return pa.array([{"codes": c, "flips": None if f is None else f.reshape(-1)} for c, f in found + coded_many(held, want)], _CODED)


def fingerprint(media: Column, asked: Column | None = None) -> Column:
    """codes of each WAV recording, and flips where asked: WEAK of them for each code, see coded().

    None for null, unreadable and too short ones. Recordings of any length are read whole.
    """
    return F.arrow_udf(_codes, "struct<codes:array<int>,flips:array<int>>")(media, F.lit(False) if asked is None else F.coalesce(asked, F.lit(False)))


class _Block:
    """Some queries' codes, and the places where a code or a variant of it starts, sorted by code; codes that stay the same, as in silence, start once."""

    def __init__(self, ids: pa.Array, codes: pa.Array, flips: pa.Array):
        self.ids, self.cuts, self.codes = ids, codes.offsets.to_numpy().astype(np.int64), codes.values.to_numpy()
        self.codes = self.codes[self.cuts[0] : self.cuts[-1]]
        self.cuts -= self.cuts[0]
        at, row = _starts(self.codes, self.cuts)
        weak, known = np.zeros((len(self.codes), WEAK), np.int32), flips.is_valid().to_numpy(False)
        weak[flat.ranges(self.cuts[:-1][known], np.diff(self.cuts)[known])] = flips.flatten().to_numpy().reshape(-1, WEAK)
        seeds = self.codes[at][:, None] ^ variants(weak[at])
        seed, row, at = seeds.reshape(-1), np.repeat(row, seeds.shape[1]), np.repeat(at, seeds.shape[1])
        order = np.lexsort((at, seed))
        order = order[np.append(True, (np.diff(seed[order]) != 0) | (np.diff(at[order]) != 0))[: len(order)]]  # one of a kind, where weak bits are not known
        self.seed, self.row = seed[order], row[order].astype(np.int32)
        self.pos = (at[order] - self.cuts[self.row]).astype(np.int32)


def _starts(codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a code starts, and the rows they stand in."""
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    new[cuts[:-1][np.diff(cuts) > 0]] = True
    at = np.flatnonzero(new)
    return at, np.searchsorted(cuts, at, "right") - 1


def _verified(block: _Block, codes: np.ndarray, cuts: np.ndarray, row: np.ndarray, query: np.ndarray, offset: np.ndarray, rules: tuple) -> tuple[np.ndarray, ...]:
    """Of votes (row, query, offset) those that hold: row, query, offset, overlap and bit errors of the best place of each pair."""
    min_votes, min_overlap, max_bit_errors = rules
    size, asked = np.diff(cuts)[row], np.diff(block.cuts)[query]
    overlap = np.minimum(size - np.maximum(offset, 0), asked - np.maximum(-offset, 0))
    enough = overlap >= min_overlap
    row, query, offset, overlap = (x[enough] for x in (row, query, offset, overlap))
    order = np.lexsort((offset, query, row))
    row, query, offset, overlap = (x[order] for x in (row, query, offset, overlap))
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(query) != 0) | (np.diff(offset) != 0)
    first = np.flatnonzero(new)
    first = first[np.diff(np.append(first, len(row))) >= min_votes]  # the histogram of offsets
    row, query, offset, overlap = (x[first] for x in (row, query, offset, overlap))
    errors = np.zeros(len(row), np.int64)
    upto = np.cumsum(overlap)
    low = 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] - overlap[low] + PAIRS, "right")))
        some = slice(low, high)
        mine = codes[flat.ranges((cuts[row] + np.maximum(offset, 0))[some], overlap[some])]
        theirs = block.codes[flat.ranges((block.cuts[query] + np.maximum(-offset, 0))[some], overlap[some])]
        errors[some] = np.add.reduceat(np.bitwise_count((mine ^ theirs).view(np.uint32)).astype(np.int64), np.cumsum(overlap[some]) - overlap[some])
        low = high
    good = np.flatnonzero(errors <= overlap * 32 * max_bit_errors)
    row, query, offset, overlap, errors = (x[good] for x in (row, query, offset, overlap, errors))
    order = np.lexsort((offset, errors - 32 * overlap, query, row))
    row, query, offset, overlap, errors = (x[order] for x in (row, query, offset, overlap, errors))
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(query) != 0)
    return tuple(x[new] for x in (row, query, offset, overlap, errors))


def _votes(block: _Block, codes: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, query, offset) of equal codes that start in both, all of one row and query at once, about PAIRS at a time."""
    at, row = _starts(codes, cuts)
    first, last = np.searchsorted(block.seed, codes[at]), np.searchsorted(block.seed, codes[at], "right")
    met = first < last
    at, row, first, n = at[met], row[met], first[met], (last - first)[met]
    upto = np.cumsum(n)
    ends = np.searchsorted(row, np.arange(len(cuts) - 1), "right")  # seeds up to each row's end
    total = np.append(0, upto)[ends]
    low = 0
    while low < len(total):
        before = int(total[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        seeds = slice(int(ends[low - 1]) if low else 0, int(ends[high - 1]))
        parts = -(-(int(total[high - 1]) - before) // (2 * PAIRS))  # more than one only for a single row: some of the queries at a time
        for part in range(parts):
            out = []
            b = seeds.start
            while b < seeds.stop:
                a, done = b, int(upto[b] - n[b])
                b = min(seeds.stop, max(a + 1, int(np.searchsorted(upto, done + 2 * PAIRS, "right"))))
                spot = flat.ranges(first[a:b], n[a:b])
                own = np.repeat(np.arange(a, b), n[a:b])
                if parts > 1:
                    mine = block.row[spot] % parts == part
                    spot, own = spot[mine], own[mine]
                out.append((row[own], block.row[spot].astype(np.int64), at[own] - cuts[row[own]] - block.pos[spot]))
            yield tuple(np.concatenate(x) for x in zip(*out))
        low = high


def _search(sent, rules: tuple):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = kept(("chroma", sent.value[0]), lambda: _Block(*sent.value[1:]))
        for batch in batches:
            lists = batch.column(1)
            cuts = lists.offsets.to_numpy().astype(np.int64)
            codes = lists.values.to_numpy()[cuts[0] : cuts[-1]]
            cuts -= cuts[0]
            for votes in _votes(block, codes, cuts):
                row, query, *numbers = _verified(block, codes, cuts, *votes, rules)
                columns = [batch.column(0).take(pa.array(row)), block.ids.take(pa.array(query)), *(pa.array(x.astype(np.int32)) for x in numbers)]
                yield pa.RecordBatch.from_arrays(columns, ["class_id", "query_class", "offset", "overlap", "bit_errors"])

    return search


def align(recordings: DataFrame, queries: Column, min_votes: int = MIN_VOTES, min_overlap: int = MIN_OVERLAP, max_bit_errors: float = MAX_BIT_ERRORS) -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id) and matches (class_id, query_class, offset, overlap, bit_errors).

    recordings: id, codes and, for queries, flips (see fingerprint()). Recordings with equal codes are one class, named by the smallest id; those
    without codes or without any id in their class have none. queries: a condition on id; classes with
    such a member are looked for among all. Equal codes, where they start, vote for the difference of
    their places; a query's code stands also for those that it would be if up to CHANGED of its WEAK filters
    nearest to a change had changed, as noise makes them do. Every difference with min_votes is verified: of the codes that overlap, at least
    min_overlap, no more than max_bit_errors of the bits may differ. A pair's best place is that with the
    longest overlap less its errors (ties: the smallest offset: the place in class_id's recording less that
    in the query's). A class matches itself. Copies are never made into pairs. A place where no code starts
    in both recordings at once is not verified. An empty table, or one without queries, gives no matches.

    The queries are dealt into blocks of about BLOCK_CODES seeds, which is what is sent to the workers at
    once; all recordings are read once for each block and shuffled for none. Votes are counted and verified
    where they are found, about PAIRS at a time, and only matches are written.
    """
    spark = recordings.sparkSession
    grams.bounded_batches(spark)
    full = F.size("codes") > 0
    flips = F.col("flips") if "flips" in recordings.columns else F.lit(None).cast("array<int>").alias("flips")
    keyed = recordings.select("id", "codes", flips, F.when(full, F.xxhash64("codes")).alias("_k1"), F.when(full, F.xxhash64(F.lit(1), "codes")).alias("_k2"))
    keyed = cut(keyed)
    groups = keyed.where(full).groupBy("_k1", "_k2").agg(F.min("id").alias("class_id"), F.first("codes").alias("codes"), F.max("flips").alias("flips"), F.max(F.coalesce(queries, F.lit(False))).alias("asked"))
    groups = cut(groups.where("class_id is not null"))
    members = keyed.join(groups.select("_k1", "_k2", "class_id"), ["_k1", "_k2"], "left").select("id", "class_id")
    asked = groups.where("asked").select("class_id", "codes", "flips")
    size = F.size("codes") * F.when(F.col("flips").isNull(), 1).otherwise(sum(comb(WEAK, k) for k in range(CHANGED + 1)))
    blocks = -(-(asked.agg(F.sum(size)).first()[0] or 0) // BLOCK_CODES)
    kind = dict(groups.dtypes)["class_id"]
    schema = f"class_id {kind}, query_class {kind}, offset int, overlap int, bit_errors int"
    if not blocks:
        return members, spark.createDataFrame([], schema)
    out, written = new_path(spark, "matches"), []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == b).toArrow()
        if not len(own):
            continue
        sent = spark.sparkContext.broadcast((f"{out}-{b}", *(pa.concat_arrays(own.column(c).chunks) for c in range(3))))
        found = groups.select("class_id", "codes").mapInArrow(_search(sent, (min_votes, min_overlap, max_bit_errors)), schema)
        written.append(f"{out}/{b}")
        found.write.parquet(written[-1])
        sent.destroy()
    return members, spark.read.schema(schema).parquet(*written)


def melody(values: list | None, rate: int = 4000, note: int = 128) -> bytes | None:
    """A WAV file that plays each number as a short note, the higher the larger (-1 to 1); null stays null, null numbers are rests."""
    if values is None:
        return None
    x = np.array([np.nan if v is None else v for v in values], np.float64)
    pitch = np.floor((np.clip(np.nan_to_num(x), -1, 1) + 1) * 18)
    hertz = 220 * 2 ** (pitch / 12)
    loud = np.where(np.isfinite(x), 0.5, 0)
    phase = np.cumsum(np.repeat(hertz, note)) * (2 * np.pi / rate)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.sin(phase) * np.repeat(loud, note) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _melodies(values: pa.Array) -> pa.Array:
    return pa.array([melody(v.as_py()) for v in values], pa.binary())


def play(values: Column) -> Column:
    """Arrays of numbers as WAV recordings, for tables that hold no audio."""
    return F.arrow_udf(_melodies, "binary")(values)


def recordings_of(rows: DataFrame, key: str, media: Column, asked: Column | None = None) -> DataFrame:
    """id and codes of every row, and flips of those that are asked for."""
    grams.bounded_batches(rows.sparkSession)
    return rows.select(F.col(key).alias("id"), fingerprint(media, asked).alias("_f")).select("id", "_f.codes", "_f.flips")
