"""WARC archives: round trips, revisits, and what is left of damaged files."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestack.llm import warc
from lodestack.llm.shared import new_path

BIG = "<html>é " + "x" * 1000 + "</html>"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    rows = [(i, f"http://a/{i}", "".join(rng.choice("abc <>é\r\n") for _ in range(rng.randint(0, 3000)))) for i in range(40)]
    rows += [(100 + i, "http://big/ x\ny", BIG) for i in range(5)] + [(200, None, None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", BIG), (104, "twice", BIG), (300, "nested", "WARC/1.1\r\n\r\n" * 200)]
    return rows


@pytest.fixture(scope="module")
def archive(spark, pages):
    out = new_path(spark, "warc")
    docs = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit("x"))
    warc.write_archives(warc.plan_records(docs.repartition(3)), out)
    return out


def test_round_trip(spark, archive, pages):
    got = warc.read_archives(spark, archive).collect()
    assert {r.kind for r in got} == {"record"}
    report = sorted(map(tuple, warc.page_report(warc.read_archives(spark, archive)).collect()), key=str)
    expect = []
    for page, _, html in pages:
        raw = (html or "").encode()
        again = html == BIG and page != 104
        expect.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 104 if again else None))
    assert report == sorted(expect, key=str)
    by = {r.record_id: r for r in got}
    assert by["<urn:page:5>"].payload.decode() == pages[5][2] and by["<urn:page:200>"].target_uri is None
    assert by["<urn:page:100>"].payload is None


def records(n=20):
    out = []
    for i in range(n):
        body = f"HTTP/1.1 200 OK\r\n\r\npage {i} {'y' * i * 50}".encode()
        payload = body.partition(b"\r\n\r\n")[2]
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
        out.append(head.encode() + body + b"\r\n\r\n")
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_damaged_archives(packed):
    parts = [gzip.compress(r) for r in records()] if packed else records()
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    whole = b"".join(parts)
    clean = list(warc.salvage(whole))
    assert [r["record_id"] for r in clean] == [f"<{i}>" for i in range(20)] and [(r["start"], r["end"]) for r in clean] == list(zip(starts, starts[1:]))
    rng = random.Random(9)
    for _ in range(60):
        kind, i = rng.choice(["flip", "cut", "junk", "hole"]), rng.randrange(20)
        spot = starts[i] + rng.randrange(len(parts[i]))
        if kind == "flip":
            bad = whole[:spot] + bytes([whole[spot] ^ 0xFF]) + whole[spot + 1 :]
        elif kind == "cut":
            bad = whole[:spot]
        elif kind == "junk":
            bad = whole[: starts[i]] + rng.randbytes(50) + whole[starts[i] :]
        else:
            bad = whole[:spot] + whole[spot + 7 :]
        got = list(warc.salvage(bad))
        found = [r["record_id"] for r in got if r["kind"] == "record"]
        lost = {"cut": set(range(i, 20)), "junk": set()}.get(kind, {i, i + 1} if spot + 7 > starts[i + 1] else {i})
        assert set(found) >= {f"<{k}>" for k in range(20) if k not in lost}
        assert all(r["reason"] for r in got if r["kind"] == "gap")
        places = sorted({(r["start"], r["end"]) for r in got if r["end"] is not None})  # records of broken members are in gaps
        assert places[0][0] == 0 and places[-1][1] == len(bad) and all(a[1] == b[0] for a, b in zip(places, places[1:])) or not bad


def test_salvage_inside_members():
    """A member of many records: one damaged inside, and members that are cut, broken or have a wrong checksum."""
    parts = records()
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    whole = b"".join(parts)
    rng = random.Random(2)
    for i in (0, 7, 19):
        spot = starts[i + 1] - 8
        member = gzip.compress(whole[:spot] + b"?" + whole[spot + 1 :])
        got = list(warc.salvage(b"junk" + member + gzip.compress(parts[3])))
        assert [r["record_id"] for r in got if r["kind"] == "record"] == [*(f"<{k}>" for k in range(20) if k != i), "<3>"]
        (inner,) = [r for r in got if r["kind"] == "inner gap"]
        assert (inner["start"], inner["end"]) == (4, 4 + len(member)) and f"bytes {starts[i]} to {starts[i + 1]}" in inner["reason"]
        assert [(r["start"], r["end"]) for r in got if r["kind"] == "gap"] == [(0, 4)]
    member = gzip.compress(whole + rng.randbytes(1 << 18))
    cut = list(warc.salvage(member[: len(member) // 2]))
    assert [r["record_id"] for r in cut if r["kind"] == "record"] == [f"<{k}>" for k in range(20)] and cut[0]["end"] is None
    assert [(r["start"], r["end"]) for r in cut if r["kind"] == "gap"] == [(0, len(member) // 2)]
    wrong = gzip.compress(whole)[:-8] + bytes(8)
    assert len([r for r in warc.salvage(wrong) if r["kind"] == "record"]) == 20 and [r["kind"] for r in warc.salvage(wrong)][-1] == "gap"


def test_a_very_long_payload(spark):
    out = new_path(spark, "warc")
    long = "<p>é words </p>" * 700_000
    docs = spark.createDataFrame([(1, "u", long), (2, "v", long + "x"), (3, "w", long)], "page_id bigint, url string, html string")
    warc.write_archives(warc.plan_records(docs), out)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_report(warc.read_archives(spark, out)).collect()}
    size = len(long.encode())
    assert got == {1: (size, "revisit", 3), 2: (size + 1, "response", None), 3: (size, "response", None)}


def test_odd_archives(spark):
    assert list(warc.salvage(b"")) == []
    assert [r["kind"] for r in warc.salvage(b"nothing of use")] == ["gap"]
    assert [r["record_id"] for r in warc.salvage(gzip.compress(b"".join(records(3))))] == ["<0>", "<1>", "<2>"]
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    out = new_path(spark, "warc")
    warc.write_archives(warc.plan_records(none), out)
    assert warc.page_report(warc.read_archives(spark, out)).count() == 0


def test_header_numbers_that_are_none():
    """Lengths of other digits than ASCII's, of too many, of none or with a sign make a gap, and records around them are kept."""
    plain = b"".join(gzip.decompress(p) if p[:2] == b"\x1f\x8b" else p for p in records(3))
    one = records(1)[0]
    one = gzip.decompress(one) if one[:2] == b"\x1f\x8b" else one
    head = one[: one.index(b"Content-Length: ") + 16]
    tail = one[one.index(b"\r\n", len(head)) :]
    for number in ("²", "٣", "9" * 5000, "", "-1", "+5", "1_0", "0x10", "1e3", "9" * 19, "9" * 20, " "):
        bad = head + number.encode() + tail
        for raw in (bad + plain, gzip.compress(bad) + gzip.compress(plain), gzip.compress(bad + plain)):
            got = list(warc.salvage(raw))
            assert [r["record_id"] for r in got if r["kind"] == "record"][-3:] == ["<0>", "<1>", "<2>"]
            assert any(r["kind"].endswith("gap") for r in got)


def test_headers_of_random_bytes():
    whole, rng = b"".join(gzip.decompress(p) if p[:2] == b"\x1f\x8b" else p for p in records(4)), random.Random(7)
    for _ in range(2000):
        raw = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(raw))
            raw[at : at + rng.randint(0, 2)] = bytes(rng.randrange(256) for _ in range(rng.randint(1, 3)))
        assert all(r["kind"] in ("record", "gap", "inner gap") for r in warc.salvage(bytes(raw)))
