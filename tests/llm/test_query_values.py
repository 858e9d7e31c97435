"""Whole results of queries that SQL can't express, against libraries and plain Python."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lodestack.llm import chroma, licenses, queries, toxicity
from tests.llm.test_op4_op5_op6_op9 import words
from tests.llm.test_op7 import plain_score

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet') order by doc_id").fetchall()


def test_token_ids(spark, documents):
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json")), 0, []
    for doc, text in documents:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.QUERIES["op3_token_ids_orc"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert list(map(tuple, got)) == want


def test_licences(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op4_license_scan"](spark, SF).collect()}
    assert len(got) == len(documents)
    for doc, text in documents:
        w, places = words(text), []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        r, starts = got[doc], [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_toxicity_scores(spark, documents):
    """Every row's score by the plain scorer under the model that the query fits, which is the same each time."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on(docs, labels)
    got = {r.doc_id: r for r in queries.QUERIES["op7_toxicity"](spark, SF).collect()}
    assert set(got) == {d for d, _ in documents}
    for doc, text in documents:
        r = got[doc]
        assert r.score == pytest.approx(plain_score(model, text), abs=1e-4) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)


def test_alignments(spark):
    """Classes of equal codes, and the best place of every class in every query where a code starts in both at once."""
    vectors = duckdb.sql(f"select vec_id, embedding from read_parquet('{SF}/embeddings.parquet')").fetchall()
    media = [chroma.melody(v) for _, v in vectors]
    found = chroma.coded_many(media)
    classes = defaultdict(list)
    for (i, _), (codes, _) in zip(vectors, found):
        classes[codes.tobytes()].append((i, codes))
    rows = queries.QUERIES["op10_chroma_fingerprints"](spark, SF).collect()
    members = {r.vec_id: r.class_id for r in rows if r.kind == "member"}
    named = {min(i for i, *_ in own): own for own in classes.values() if len(own[0][1])}
    assert members == {i: name for name, own in named.items() for i, *_ in own} | {i: None for own in classes.values() if not len(own[0][1]) for i, *_ in own}

    def starts(c):
        return np.flatnonzero(np.append(True, c[1:] != c[:-1]))

    want = {}
    for q, own in named.items():
        asked = [x for x in own if x[0] % 100 == 0]
        if not asked:
            continue
        cq, seeds = asked[0][1], defaultdict(set)
        for at in starts(cq):
            seeds[int(cq[at])].add(int(at))
        for name, (first, *_) in named.items():
            c = first[1]
            for offset in {int(j) - i for j in starts(c) for i in seeds.get(int(c[j]), ())}:
                low, high = max(offset, 0), min(len(c), len(cq) + offset)
                errors = int(np.bitwise_count((c[low:high] ^ cq[low - offset : high - offset]).view(np.uint32)).sum()) if high > low else 0
                if high - low >= chroma.MIN_OVERLAP and errors <= chroma.MAX_BIT_ERRORS * 32 * (high - low):
                    want[name, q] = min(want.get((name, q), (9**9,)), (errors - 32 * (high - low), offset, high - low, errors))
    got = {(r.vec_id, r.class_id): (r.offset, r.overlap, r.bit_errors) for r in rows if r.kind == "match"}
    assert got == {k: v[1:] for k, v in want.items()} and len(got) >= len({q for _, q in want})
