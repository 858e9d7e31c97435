"""Source divergence, repeated passages and the filter audit against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.llm import divergence, filteraudit, relativelz

SCHEMA = "doc_id bigint, text string, lang string, source string, pair string, item string, row string, copy int, mask int, part string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=150, seed=3):
    """Passages that repeat at changed edges, copies of all kinds, nulls, repeated ids, one long text, and columns with names that the operators use."""
    rng = random.Random(seed)
    vocabulary = [f"w{c}{d}" for c in "abcdefgh" for d in "xyzé漢"] + ["The", "END.", "#tag", "naïve"]
    said = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [said(k) for k in (12, 13, 14, 20, 60)]
    texts = [None, "", " ", "\n\t", "one", " ".join(["the"] * 40), " ".join(["the"] * 55), " ".join(said(12)), "a b " * 30]
    while len(texts) < n:
        words = said(rng.randint(0, 25))
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = p[rng.choice((0, 0, 1)) : len(p) - rng.choice((0, 0, 1))]
            words[rng.randint(0, len(words)) : 0] = cut
        texts.append(rng.choice((" ", "\n", " \t")).join(words))
        if rng.random() < 0.2:
            texts.append(texts[-1])
        if rng.random() < 0.2:
            texts.append(texts[-1] + " tail")
    texts.append(" ".join(said(4000) + passages[-1]))
    rows = [(i, t, rng.choice(("en", "fr", None)), rng.choice(("a", "b", "c", None, "é"))) for i, t in enumerate(texts)]
    rows += [(7, texts[20], "en", "a"), (7, texts[20], "en", "a"), (9, texts[40], "de", "only"), (None, texts[30], "en", "b"), (None, None, None, None)]
    rng.shuffle(rows)
    return [(*r, "p", "i", "r", 1, 2, "q") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain_divergence(rows):
    kept, counts, groups = defaultdict(Counter), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))
        groups.add((lang, source))
        kept[lang].update(set(terms))
        counts.update((lang, source, t) for t in terms)
    out = set()
    for lang in {g[0] for g in groups}:
        own = sorted(t for t, n in kept[lang].items() if n >= 10)
        sources = sorted(s for g, s in groups if g == lang)
        table = {s: [counts[lang, s, t] for t in own] for s in sources}
        share = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(own)) for x in c]
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in table.items()}, share([sum(x) for x in zip(*table.values())])
        utf8 = lambda x: (-x[1], x[0].encode())
        for s in sources:
            pairs = sorted(((o, sum(map(f, p[s], p[o]))) for o in sources if o != s), key=utf8)
            terms = sorted(((t, f(a, b)) for t, c, a, b in zip(own, table[s], p[s], q) if c and a > b), key=utf8)[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1)}
    return out


def test_divergence(docs, rows, monkeypatch):
    want = plain_divergence(rows)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "" for r in want)
    got = divergence.source_divergence(docs).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(divergence, "BLOCK", 2)  # several blocks of sources
    assert {tuple(r) for r in divergence.source_divergence(docs).collect()} == want


def test_chunks_of_terms(monkeypatch):
    rng = random.Random(5)
    rows = sorted({(lang, f"t{rng.randrange(90)}", f"s{rng.randrange(4)}") for lang in ("", "a", "b") for _ in range(300)})
    rows = [(*r, rng.randint(1, 9), rng.randint(9, 20), 3) for r in rows]
    for chunk, wide, size in ((4096, 200_000, 7), (5, 200_000, 7), (4, 200_000, 400), (4096, 6, 9), (3, 5, 1)):
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        monkeypatch.setattr(divergence, "CHUNK_ROWS", wide)
        batches = [pa.RecordBatch.from_pylist([dict(zip("abcdef", r)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        found = [r for b in divergence._chunks(iter(batches)) for r in b.to_pylist()]
        terms, got, at = {}, {}, {}
        for r in found:
            if r["source"] is None:
                assert (r["lang"], r["chunk"]) not in terms and r["terms"] == sorted(r["terms"]) and len(r["terms"]) <= chunk
                terms[r["lang"], r["chunk"]] = r["terms"]
                at.update({(r["lang"], t): n for t, n in zip(r["terms"], r["counts"])})
        for r in found:
            if r["source"] is not None:
                got.update({(r["lang"], terms[r["lang"], r["chunk"]][i], r["source"]): n for i, n in zip(r["ids"], r["counts"])})
        n_docs, n = Counter(), Counter()
        for lang, term, _, d, c, _ in rows:
            n_docs[lang, term] += d
            n[lang, term] += c
        assert at == {k: n[k] for k in n if n_docs[k] >= 10}
        assert got == {(a, t, s): c for a, t, s, _, c, _ in rows if n_docs[a, t] >= 10}
        ordered = [(k[0], t) for k in sorted(terms, key=lambda k: k[1]) for t in terms[k]]
        assert ordered == sorted(ordered)


def test_shares_are_exact_beyond_64_bits():
    counts, n = [0, 1, 10**12, 3 * 10**14 + 7], 4 * 10**14 + 11
    got = divergence.shares(np.array(counts), np.int64(n), 10**9 + 7)
    assert got.tolist() == [1 + 10**9 * (c + 2) // (n + 2 * (10**9 + 7)) for c in counts]


def plain_repeats(rows, size=13):
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            w = WORD.findall(text or "")
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text, *_ in rows:
        w = WORD.findall(text or "")
        gone = set()
        if doc is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < doc:
                    gone |= set(range(i, i + size))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def repeats(docs, size=13):
    return sorted(map(tuple, relativelz.remove_repeats(docs, size).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


@pytest.mark.parametrize("heavy", [1024, 30, 1])
def test_repeats(docs, rows, heavy, monkeypatch):
    """Also where most anchors are heavy, and where none is."""
    monkeypatch.setattr(relativelz, "HEAVY", heavy)
    want = plain_repeats(rows)
    assert sum(r[2] for r in want) > 1000 and repeats(docs) == want


def test_repeats_of_other_sizes(docs, rows):
    for size in (3, 5, 20):
        assert repeats(docs, size) == plain_repeats(rows, size)


def test_repeats_between_batches(spark, docs, rows):
    """Rows of one key come in many batches, of the texts and of what is sorted."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert repeats(docs) == plain_repeats(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_factors_are_copies_of_their_references(docs, rows):
    texts = defaultdict(list)
    for doc, text, *_ in rows:
        texts[doc].append(WORD.findall(text or ""))
    found = [r for r in relativelz.remove_repeats(docs).collect() if r.factors]
    assert found
    for r in found:
        own = WORD.findall(r.row.text)
        for f in r.factors:
            assert f.length >= 13 and f.ref_doc < r.doc_id
            assert any(own[f.start : f.start + f.length] == w[f.ref_start : f.ref_start + f.length] for w in texts[f.ref_doc])
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    long = max(found, key=lambda r: max(f.length for f in r.factors))
    assert max(f.length for f in long.factors) > 20


def test_a_passage_of_one_window_at_every_place(spark):
    """Thirteen words between other words, at each distance from an anchor; the first document with them is none of those that share its fragments."""
    rng = random.Random(9)
    said = lambda k: [f"x{rng.randrange(10**6)}" for _ in range(k)]
    rows = []
    for _ in range(40):
        p = said(13)
        for _ in range(3):
            rows.append((len(rows), " ".join(said(rng.randint(0, 15)) + p + said(rng.randint(0, 15)))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = repeats(docs)
    assert got == plain_repeats(rows) and sum(r[2] for r in got) == 80 * 13


def plain_audit(rows, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    seen = defaultdict(list)
    for doc, text, _, source, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and first[text] < doc}
        seen[source or ""].append(({k for k, v in fails.items() if v}, doc in good, doc in toxic))
    out = {}
    for part, docs in seen.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                redundant = sum(f in d[0] for d in docs) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for f in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == f:
                    v.append(total)
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("block", [64, 2])
def test_audit(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(filteraudit, "FIRST_BLOCK", block)
    monkeypatch.setattr(filteraudit, "GROWTH", 2 if block == 2 else 8)
    rng = random.Random(4)
    labels = [(rng.randrange(160), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(200)] + [(None, 1, 1)]
    got = filteraudit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    want = plain_audit(rows, labels)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_equal_hashes_decide_nothing(spark, docs, rows, monkeypatch):
    """With block hashes that are all equal, texts of one length are still told apart."""
    measured = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"), F.coalesce("text", F.lit("")).alias("text"))
    same = measured.select("doc_id", "copy", F.char_length("text").cast("bigint").alias("n_chars"), F.array(F.lit(1).cast("bigint")).alias("blocks"))
    got = {r.doc_id for r in filteraudit.copies(measured, same).collect()}
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    assert got == {doc for doc, text, *_ in rows if doc is not None and first[text or ""] < doc}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert divergence.source_divergence(none).count() == relativelz.remove_repeats(none).count() == filteraudit.audit(none, labels).count() == 0
