"""Token ids in ORC and SentencePiece BPE against the libraries themselves."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bytebpe, piecebpe, spantable
from lodestack.llm.queries import vocabulary
from lodestack.llm.shared import new_path

ODD = [
    "", " ", "  ", "\n", "▁", "x▁ y▁▁ z", "  lead", "trail  ", "<s></s><unk><0x41>", "中文字符没有空格" * 40, "emoji 😀😀 ‍", "a" * 3000, "ab" * 777,
    " \n y   　x", "x \n y", "x \n\n y", "\u0085 q\u0085 \n r", "\x00\x01 \x7f", "can't we'll ''s 12345  67", "tab\t\tx \r\n\r\n  y", "don't<|endoftext|>b <|endoftext|> c", "1" * 500, "-" * 40,
]


def texts(n=400, seed=5):
    rng = random.Random(seed)
    parts = [*" \n\tabcdeэтоñé▁中😀.,'\"-=0123 　 \x85", "the ", "ing", "tion", "    ", "<|endoftext|>"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts()), (None, None), (None, "a b"), (7, "again"), (7, "again"), (10**6, None), (10**6 + 1, "long words here " * 20000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_pieces_are_the_librarys(spark, rows):
    path = vocabulary("piece_bpe_32k.model")
    library = piecebpe.model(path).library
    coded = frame(spark, rows).withColumn("ids", piecebpe.encode(F.col("text"), path)).withColumn("back", piecebpe.decode(F.col("ids"), path))
    for r in coded.collect():
        expect = [*library.encode(r.text or ""), library.eos_id()]
        assert r.ids == expect and r.back == library.decode(expect)


def test_long_texts_without_spaces_are_the_librarys_and_take_time_that_grows_with_them():
    m = piecebpe.Model(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(3)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    long = ["the" * 33000, some([chr(c) for c in range(0x430, 0x450)], 60000), some("abcdefghijklmnopqrstuvwxyz", 100000), "a" * 50001, "-=" * 9000 + "-" * 77, some(["tion", "ing", "inter", "национ"], 8000)]
    short = [some(rng.choice(["abc", "the", "ing", "aAbB12 ", "абвг", "the ", "中文a", "==--", "aaab", "a😀b"]), rng.randint(1, 500)) for _ in range(500)]
    start = time.perf_counter()
    expect = [m.library.encode(t) for t in long]
    allowed = 1 + 40 * (time.perf_counter() - start)
    start = time.perf_counter()
    got = m.encode(pa.array(long), False).to_pylist()
    assert time.perf_counter() - start < allowed
    assert got == expect
    assert m.encode(pa.array(short), False).to_pylist() == [m.library.encode(t) for t in short]


def test_other_models_are_refused():
    def message(*fields):
        return b"".join(bytes([k << 3 | 2, len(v)]) + v if isinstance(v, bytes) else bytes([k << 3, v]) for k, v in fields)

    good = (2, message((3, 2))), (3, message((4, 0)))
    piecebpe.check_model(message(*good))
    for bad in [(good[1],), (good[0],), (good[0], (3, message((4, 0), (2, b"table")))), (good[0], (3, message((4, 0), (3, 0))))]:
        with pytest.raises(ValueError):
            piecebpe.check_model(message(*bad))


def test_decoding_any_ids():
    m = piecebpe.model(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(2)
    lists = [[rng.randrange(m.n) for _ in range(rng.randint(0, 12))] for _ in range(200)] + [[rng.randrange(300) for _ in range(6)] for _ in range(200)]
    assert m.decode(pa.array([*lists, None], pa.list_(pa.int32()))).to_pylist() == [*m.library.decode(lists), ""]


@pytest.mark.parametrize("remembered", [0, 50, 1 << 20])
def test_spans_are_worked_out_alike_beyond_the_memory(monkeypatch, remembered):
    monkeypatch.setattr(spantable, "REMEMBERED", remembered)
    table = spantable.SpanTable(lambda spans: (np.concatenate([np.frombuffer(s, np.uint8) for s in spans]).astype(np.int32), np.array([len(s) for s in spans])))
    rng = random.Random(1)
    for _ in range(20):
        words = [bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(100)] + [b"z" * 300]
        ends = np.cumsum([len(w) for w in words])
        numbers, counts = table.values(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends)
        assert numbers.astype(np.uint8).tobytes() == b"".join(words) and counts.tolist() == [len(w) for w in words]


def test_spans_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(spantable.flat, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    table = spantable.SpanTable(lambda spans: (np.array([s[0] for s in spans], np.int32), np.ones(len(spans), np.int64)))
    for words in ([b"ab", b"cd", b"ab", b"e"], [b"cd", b"xy", b"f", b"e"]):
        ends = np.cumsum([len(w) for w in words])
        numbers, _ = table.values(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends)
        assert numbers.tolist() == [w[0] for w in words]


def test_readers_skip_by_index_and_bloom_filter(spark):
    """Even ids only: an odd one lies between every index entry's ends, so that only the Bloom filter can leave a row group out."""
    import pyarrow.orc

    out = new_path(spark, "orc")
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    bytebpe.write_ids(docs, out, vocabulary("byte_bpe_50k.json"), 2, parts=1)

    def rows_read(doc_id):
        found = bytebpe.read_ids(spark, out, [doc_id])
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        metrics = leaves.apply(0).metrics().get("numOutputRows")
        return len(rows), metrics.get().value()

    assert rows_read(20_000) == (1, bytebpe.ROW_INDEX_STRIDE)
    assert rows_read(20_001) == (0, 0)
    (file,) = [x[5:] if x.startswith("file:") else x for x in spark.read.orc(out).inputFiles()]
    stored = pyarrow.orc.ORCFile(file)
    assert stored.row_index_stride == bytebpe.ROW_INDEX_STRIDE and stored.nrows == 20_000
    # 20,000 rising ids of 8 bytes in run lengths: far less than a byte each
    assert stored.nstripes == 1 and stored.content_length < 20_000 * 8


def test_ids_in_orc(spark, rows):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    out = new_path(spark, "orc")
    bytebpe.write_ids(frame(spark, rows).withColumn("_part", F.lit(1)), out, path, 2, parts=4)
    expect = sorted(((d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    back = bytebpe.read_ids(spark, out)
    assert sorted(((r.doc_id, r.ids) for r in back.collect()), key=str) == sorted(expect, key=str)
    assert sorted(map(str, [r.ids for r in bytebpe.read_ids(spark, out, [7, 8]).collect()])) == sorted(str(i) for d, i in expect if d in (7, 8))
    crc = {(d, zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in expect}
    got = sorted(bytebpe.positions(back).collect(), key=lambda r: r.start)
    assert {(r.doc_id, r.ids_crc32) for r in got} == crc
    assert [r.doc_id for r in got] == [d for d, _ in expect]
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])))[:-1].tolist()


def test_empty_table(spark):
    none, out = frame(spark, []), new_path(spark, "orc")
    bytebpe.write_ids(none, out, vocabulary("byte_bpe_50k.json"), 2)
    assert bytebpe.positions(spark.read.schema("doc_id bigint, _tie bigint, ids array<int>").orc(out)).count() == 0
