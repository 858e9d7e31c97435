"""Chroma fingerprints and alignment against a plain search over all pairs and offsets."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import chroma


def wav(x, rate=4000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def samples(seed, notes=60):
    return chroma.samples_of(chroma.melody(np.random.default_rng(seed).uniform(-1, 1, notes).tolist()))[0]


@pytest.fixture(scope="module")
def media():
    rng = np.random.default_rng(0)
    base = {i * 10: samples(i) for i in range(8)}
    rows = [(i, wav(x)) for i, x in base.items()]
    rows += [(101, wav(base[0][chroma.HOP * 12 :])), (102, wav(np.concatenate((samples(99, 20), base[10])))), (103, wav(base[20] + rng.normal(0, 0.02, len(base[20]))))]
    rows += [(104, wav(base[30])), (105, wav(base[30])), (106, wav(np.repeat(base[40], 2), channels=2))]
    rows += [(200, None), (201, b"RIFF no wave"), (202, b""), (203, wav(np.zeros(100))), (204, wav(np.zeros(6000))), (205, wav(np.zeros(9000))), (None, wav(samples(77))), (104, wav(base[30]))]
    return rows


@pytest.fixture(scope="module")
def codes(media):
    """Each recording by itself."""
    return [(i, chroma.codes_of_many([m])[0].tolist()) for i, m in media]


def plain(codes, asked):
    classes = {}
    for i, c in codes:
        if c:
            classes.setdefault(tuple(c), []).append(i)
    named = {min(x for x in ids if x is not None): (c, any(asked(x) for x in ids if x is not None)) for c, ids in classes.items() if set(ids) != {None}}

    def starts(c):
        return [(i, x) for i, x in enumerate(c) if i == 0 or c[i - 1] != x]

    out = {}
    for q, (cq, is_asked) in named.items():
        for r, (cr, _) in named.items() if is_asked else ():
            votes = {}
            for i, x in starts(cq):
                for j, y in starts(cr):
                    if x == y:
                        votes[j - i] = votes.get(j - i, 0) + 1
            for offset, n in sorted(votes.items()):
                pairs = [(cr[j], cq[j - offset]) for j in range(max(offset, 0), min(len(cr), len(cq) + offset))]
                errors = sum(((a ^ b) & 0xFFFFFFFF).bit_count() for a, b in pairs)
                if n >= chroma.MIN_VOTES and len(pairs) >= chroma.MIN_OVERLAP and errors <= chroma.MAX_BIT_ERRORS * 32 * len(pairs):
                    better = out.get((r, q))
                    if better is None or errors - 32 * len(pairs) < better[2] - 32 * better[1]:
                        out[r, q] = (offset, len(pairs), errors)
    return out, named


@pytest.mark.parametrize("limits", [(4 << 20, 1 << 20), (100, 3)])
def test_alignment(spark, monkeypatch, media, codes, limits):
    for name, value in zip(("BLOCK_CODES", "PAIRS"), limits):
        monkeypatch.setattr(chroma, name, value)
    frame = spark.createDataFrame(media, "vec_id bigint, media binary").withColumn("codes", F.lit("x")).repartition(3)
    found = chroma.recordings_of(frame, "vec_id", F.col("media"))
    assert sorted(((r.id, r.codes) for r in found.collect()), key=str) == sorted(codes, key=str)
    members, matches = chroma.align(found, F.col("id") % 10 == 0)
    expect, named = plain(codes, lambda i: i % 10 == 0)
    assert {(r.class_id, r.query_class): (r.offset, r.overlap, r.bit_errors) for r in matches.collect()} == expect
    of = {tuple(c): i for i, (c, _) in named.items()}
    assert sorted(map(tuple, members.collect()), key=str) == sorted(((i, of.get(tuple(c))) for i, c in codes), key=str)
    assert expect[101, 0][0] == -12 and expect[102, 10][0] == 20 and expect[103, 20][0] == 0
    assert (10, 0) not in expect and of[tuple(dict(codes)[104])] == 30 and of[tuple(dict(codes)[106])] == 40


def test_filters_fill_32_bits_and_use_the_integral_image():
    assert len(chroma.FILTERS) == 16
    image = np.random.default_rng(1).random((30, 12)).astype(np.float32)
    got = chroma.codes_of(image)
    for t in (0, 11, len(got) - 1):
        bits = 0
        for kind, low, height in chroma.FILTERS:
            part = image[t : t + 8, low : low + height].astype(float)
            h = height // 2
            a = {"pitch": part[:, :h].sum(), "time": part[:4].sum(), "both": part[:4, :h].sum() + part[4:, h:].sum(), "middle": part[2:6].sum()}[kind]
            level = int(np.digitize(np.log((1 + a) / (1 + part.sum() - a)), chroma.STEPS))
            bits = bits << 2 | (level ^ level >> 1)
        assert int(got[t]) & 0xFFFFFFFF == bits


def test_codes_do_not_depend_on_what_stands_beside(media):
    """Stacked with others of the rate, in any order and in small blocks, a recording has the codes that it has alone."""
    rows = [m for _, m in media] + [wav(samples(5), rate=8000), wav(samples(6), rate=8000)]
    alone = [chroma.codes_of_many([m])[0].tolist() for m in rows]
    assert [c.tolist() for c in chroma.codes_of_many(rows)] == alone
    assert [c.tolist() for c in chroma.codes_of_many(rows[::-1])] == alone[::-1]
    long = wav(np.tile(samples(1), 120))
    assert chroma.codes_of_many([rows[0], long, rows[1]])[1].tolist() == chroma.codes_of_many([long])[0].tolist()


def test_empty_table(spark):
    none = spark.createDataFrame([], "id bigint, codes array<int>")
    members, matches = chroma.align(none, F.col("id") % 10 == 0)
    assert members.count() == matches.count() == 0


def test_recall_against_all_offsets(spark):
    """Every verified place counts, with or without two equal runs in a row: bit errors in every other run, and one run alone."""
    rng = np.random.default_rng(4)
    base = [np.repeat(rng.integers(-(2**31), 2**31, 30), 2) for _ in range(4)]
    broken = []
    for c in base:  # every other run has one bit flipped
        broken.append(np.where(np.arange(60) // 2 % 2 == 0, c, c ^ 4))
    broken[3] = np.where(np.arange(60) // 2 % 2 == 0, base[3], base[3] ^ -(2**31))  # the highest bit is one bit, too
    one = [(90, [7] * 20), (91, [7] * 30), (92, [7] * 20 + [9])]
    data = [(i * 10, c.tolist()) for i, c in enumerate(base)] + [(100 + i, c[4 * i :].tolist()) for i, c in enumerate(broken)] + one
    expect = {}
    for q, cq in data:
        for r, cr in data if q % 10 == 0 else ():
            for offset in range(-len(cq), len(cr)):
                pairs = [(cr[j], cq[j - offset]) for j in range(max(offset, 0), min(len(cr), len(cq) + offset))]
                errors = sum(((a ^ b) & 0xFFFFFFFF).bit_count() for a, b in pairs)
                if len(pairs) >= chroma.MIN_OVERLAP and errors <= chroma.MAX_BIT_ERRORS * 32 * len(pairs):
                    expect[r, q] = min(expect.get((r, q), (0, 0, 0, 0)), (errors - 32 * len(pairs), offset, len(pairs), errors))
    frame = spark.createDataFrame(data, "id bigint, codes array<int>")
    _, matches = chroma.align(frame, F.col("id") % 10 == 0)
    assert {(r.class_id, r.query_class): (r.offset, r.overlap, r.bit_errors) for r in matches.collect()} == {k: v[1:] for k, v in expect.items()}
    assert all((100 + i, 10 * i) in expect for i in range(4)) and (91, 90) in expect and (92, 90) in expect


@pytest.mark.parametrize("sigma, notes", [(0.05, 30), (0.1, 60), (0.2, 30), (0.3, 30), (0.4, 30)])
def test_recall_on_noisy_recordings(spark, sigma, notes):
    """Recordings with noise, and of lower resolution: of the pairs that pass at some offset at least nine in ten are found."""
    rng = np.random.default_rng(int(100 * sigma) + notes)
    clean = [samples(1000 + i, notes) for i in range(60)]
    noisy = [np.round((x + rng.normal(0, sigma, len(x))) * 40) / 40 for x in clean]  # noise, then steps of an 80th of the range
    media = [(100 * i, wav(x)) for i, x in enumerate(clean)] + [(100 * i + 1, wav(x)) for i, x in enumerate(noisy)]
    frame = spark.createDataFrame(media, "vec_id bigint, media binary")
    found = chroma.recordings_of(frame, "vec_id", F.col("media"), F.col("vec_id") % 100 == 0)
    codes = {r.id: np.array(r.codes, np.int32) for r in found.collect()}
    passing = set()
    for i in range(60):
        a, b = codes[100 * i], codes[100 * i + 1]
        for offset in range(-len(a) + chroma.MIN_OVERLAP, len(b) - chroma.MIN_OVERLAP + 1):
            x, y = a[max(-offset, 0) :][: len(b) - max(offset, 0)], b[max(offset, 0) :]
            n = min(len(x), len(y))
            if np.bitwise_count((x[:n] ^ y[:n]).view(np.uint32)).sum() <= chroma.MAX_BIT_ERRORS * 32 * n:
                passing.add(i)
    _, matches = chroma.align(found, F.col("id") % 100 == 0)
    got = {r.query_class // 100 for r in matches.collect() if r.class_id == r.query_class + 1}
    assert got <= passing and len(got) >= 0.9 * len(passing)


def test_weak_bits_are_those_of_the_nearest_changes(media):
    """Each flip is the Gray bit that changes at the step next to the filter's value, the nearest filters first."""
    image = np.random.default_rng(3).random((20, 12)).astype(np.float32)
    codes, flips = chroma.coded(image, True)
    assert codes.tolist() == chroma.codes_of(image).tolist() and flips.shape == (13, chroma.WEAK)
    assert chroma.variants(flips).shape == (13, 93) and (chroma.variants(flips)[:, 0] == 0).all()
    for t in (0, 7, 12):
        near = []
        for i, (kind, low, height) in enumerate(chroma.FILTERS):
            part = image[t : t + 8, low : low + height].astype(float)
            h = height // 2
            a = {"pitch": part[:, :h].sum(), "time": part[:4].sum(), "both": part[:4, :h].sum() + part[4:, h:].sum(), "middle": part[2:6].sum()}[kind]
            ratio = np.log((1 + a) / (1 + part.sum() - a))
            far, step = min((abs(ratio - s), k) for k, s in enumerate(chroma.STEPS))
            level = lambda x: int(np.digitize(x, chroma.STEPS)) ^ int(np.digitize(x, chroma.STEPS)) >> 1
            change = level(chroma.STEPS[step] - 1e-9) ^ level(chroma.STEPS[step] + 1e-9)
            near.append((far, change << 2 * (15 - i)))
        assert [int(x) & 0xFFFFFFFF for x in flips[t]] == [c for _, c in sorted(near)[: chroma.WEAK]]


def test_damaged_headers_are_unreadable_recordings(media):
    rng = np.random.default_rng(8)
    good = wav(samples(1, 16))
    broken = [bytearray(good) for _ in range(4000)]
    for raw in broken:
        for _ in range(int(rng.integers(1, 4))):
            raw[int(rng.integers(0, 44))] = int(rng.integers(0, 256))
    none = bytearray(good)
    none[24:28] = bytes(4)  # no frames a second
    found = chroma.codes_of_many([bytes(x) for x in broken] + [bytes(none), good])
    assert len(found) == 4002 and len(found[-2]) == 0 and len(found[-1]) > 0
