"""Licence scans, tiling, line dedup and SimHash against brute force on small tables."""

import hashlib
import itertools
import random
import re
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestack.llm import components, decontam, licenses, linededup, simhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall((text or "").translate(AZ))


def corpus(n=60, seed=1):
    """Texts with hot lines, copies, near copies, nulls, empties, odd white space and one long text."""
    rng = random.Random(seed)
    vocabulary = ["tha%d" % i for i in range(40)] + ["Élan", "ÉTÉ", "straße", "naïve", "mit", "THE"]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))
    hot = ["A very common Line that many hold", "  \tSecond common line, é and É alike  ", "short"]
    texts = [None, "", "\n\n", " ", "one", "two words", "x\x0b y z w"]
    while len(texts) < n:
        lines = [line() for _ in range(rng.randint(1, 6))]
        for h in hot:
            if rng.random() < 0.5:
                lines.insert(rng.randrange(len(lines) + 1), h if rng.random() < 0.5 else h.upper() if rng.random() < 0.5 else h.translate(AZ) + " \r")
        if rng.random() < 0.2:
            lines.append(rng.choice(["Released under the MIT License.", "the Apache License, Version 2.0", "CC BY-NC 4.0 and cc by nc", "GNU General Public License, version 3"]))
        texts.append("\n".join(lines))
        if rng.random() < 0.3:
            texts.append(texts[-1])
        if rng.random() < 0.3:
            texts.append(texts[-1] + " tail")
    texts.append("\n".join(line() for _ in range(3000)))
    return [(i, t, "en", "s", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_license_base_places(docs, rows):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        w, places = words(text), []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        r, starts = got[doc], [i for i, _ in places]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (not places or r.score == 1)


def test_license_diagonals_merge_over_changed_words(spark):
    text = "x y Redistribution and use in source, binary forms with or without any modification are permitted provided that the following conditions are met z"
    docs = spark.createDataFrame([(1, text), (2, "redistribution and use"), (None, text), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert got[1].labels == "bsd" and got[None].labels == "bsd" and got[2].labels == "" and got[3].n_words == 0
    assert [(s.start, s.label) for s in got[1].spans] == [(2, "bsd")]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert licenses.scan_licenses(none).count() == 0
    assert linededup.line_report(none).count() == 0 and linededup.dedup_lines(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.benchmark_tiles(docs, empty).count() == 0
    assert decontam.decontaminate(docs, empty).count() == docs.count()


def plain_tiles(item, doc, k):
    """Greedy string tiling by looking at every pair of places, again for every tile."""
    mi, md, tiles = set(), set(), []
    while True:
        best = None
        for i, d in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in mi and d + n not in md:
                n += 1
            if n >= k and (best is None or (-n, i, d) < best):
                best = (-n, i, d)
        if best is None:
            return sorted(tiles)
        n, i, d = -best[0], best[1], best[2]
        mi.update(range(i, i + n)), md.update(range(d, d + n)), tiles.append((i, d, n))


def tiles_of(item, doc, k=5):
    return decontam.tiles_of(decontam._Words(item.encode()), decontam._Words(doc.encode()), k)


def test_greedy_tiles_against_plain_search():
    rng = random.Random(3)
    said = ["a", "b", "c", "Ab", "é", "x1"]
    for _ in range(200):
        k = rng.choice([2, 3, 5])
        item = [rng.choice(said[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 18))]
        doc = [rng.choice([*said, "zz"]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3) if item else 0):
            s, p = rng.randrange(len(item)), rng.randint(0, len(doc))
            doc[p:p] = item[s : s + rng.randint(1, 9)]
        assert tiles_of(" ".join(item), ", ".join(doc), k) == plain_tiles(words(" ".join(item)), words(" ".join(doc)), k)


def test_repeated_words_take_no_more_time(monkeypatch):
    start = time.perf_counter()
    assert tiles_of("word " * 5000, "word " * 200_000) == [(0, 0, 5000)]
    assert tiles_of("word word x " * 70, "word word word x y " * 20_000) == []
    assert time.perf_counter() - start < 10
    monkeypatch.setattr(decontam.flat, "span_hashes", lambda data, starts, ends: (ends - starts).astype("uint64"))  # words of one hash stay apart
    assert tiles_of("ab cd ef gh ij kl", "xx ab cd ef gh ij zz kl") == [(0, 1, 5)]


def plain_leaks(docs, items, k=5, threshold=0.6):
    out = set()
    for (doc, text), (item, said) in itertools.product(set(docs), {x for x in items if x[1] is not None}):
        w = words(said)
        if len(w) >= k:
            tiles = plain_tiles(w, words(text), k)
            covered = sum(n for *_, n in tiles)
            if covered / len(w) >= threshold:
                out.add((doc, item, len(w), covered, tuple(tiles), covered / len(w)))
    return out


@pytest.mark.parametrize("limits", [(500_000, 16), (0, 1), (500_000, 0)])
def test_tiling_against_every_pair(spark, monkeypatch, limits):
    """All columns, with hot grams that most documents and items hold, repeated ids, null ids, reordered and repeated passages."""
    monkeypatch.setattr(decontam.grams, "BROADCAST_ROWS", limits[0])
    monkeypatch.setattr(decontam, "COMMON", limits[1])
    rng = random.Random(9)
    hot = "what is the right answer to this"
    fresh = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(n)]
    items = [(i, f"{hot} {' '.join(fresh(rng.randint(3, 14)))}") for i in range(12)] + [(20, hot), (21, "too short"), (22, None), (None, " ".join(fresh(9))), (3, " ".join(fresh(8))), (3, " ".join(fresh(7))), (23, "word " * 12)]
    items.append(items[2])
    docs = [(i, f"{hot}, {' '.join(fresh(20))}. {hot}") for i in range(6)] + [(30, None), (31, ""), (None, items[0][1]), (32, "word " * 300)]
    for i, (_, said) in enumerate(items):
        w = (said or "").split()
        a = rng.randrange(len(w) + 1)
        docs.append((100 + i, " ".join([*fresh(3), *w[a:], *fresh(2), *w[:a]]).upper()))
        docs.append((200 + i, " ".join([*w[: len(w) * 2 // 3], *fresh(4)])))
    docs += [docs[-1], (100, "another text of that id")]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, item_id int, h string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.benchmark_tiles(frame, bench).collect()
    got = [(r.doc_id, r.item_id, r.n_words, r.covered, tuple((t.item_start, t.doc_start, t.n_words) for t in r.tiles), r.coverage) for r in found]
    expect = plain_leaks(docs, items)
    assert len(got) == len(set(got)) and set(got) == expect and len(expect) > 20
    assert {(3, 8), (3, 7)} <= {(i, n) for _, i, n, *_ in expect} and None in {i for _, i, *_ in expect}
    leaking = {(d, t) for d, t in docs if any(x[0] == d for x in expect) and plain_leaks([(d, t)], items)}
    kept = decontam.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((x for x in docs if x not in leaking), key=str)


def plain_votes(text, known, k=licenses.K):
    """Diagonal voting by plain loops: (start, end, label, coverage, base) of every merged span."""
    w, out = words(text), []
    for label, said, base in known:
        t = words(said)
        need = len(t) - k + 1
        places = {}
        for i in range(len(w) - k + 1):
            for j in range(need):
                if w[i : i + k] == t[j : j + k]:
                    places.setdefault(i - j, set()).add(j)
        islands = []
        for d in sorted(places):
            if not base and islands and d - islands[-1][-1] <= licenses.SLACK:
                islands[-1].append(d)
            else:
                islands.append([d])
        for island in islands:
            shown = set().union(*(places[d] for d in island))
            start, end = min(d + min(places[d]) for d in island), max(d + max(places[d]) + k for d in island)
            out.append((start, end, label, len(shown) / need, base))
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_licenses_against_plain_voting(spark, monkeypatch, most):
    monkeypatch.setattr(licenses.grams, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    templates = [*licenses.TEMPLATES, ("loop", "very very very very very long"), ("short", "two words"), (None, "a label that is null"), ("none", None)]
    known = [(label, said, True) for said, label in licenses.PHRASES.items()] + [(x, t, False) for x, t in templates[:-3]]
    texts = [None, "", "very " * 40 + "long", "Released under the MIT License. " * 3]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(known)[1].split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = rng.choice([[], ["new"], ["two", "more"]])
            parts += [*w, *rng.choices(["of", "the", "license", "under"], k=rng.randint(0, 6))]
        texts.append(" ".join(parts))
    rows = [*enumerate(texts), (0, "the same id"), (5, texts[5])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, label string").repartition(3)
    table = spark.createDataFrame(templates, "label string, text string")
    got = licenses.scan_licenses(docs, table if most else templates).collect()
    expect = {}
    for d, t in set(rows):
        found = plain_votes(t, known)
        base = [s for s in found if s[4] and s[3] >= 1]
        more = base + [s for s in found if not s[4] and s[3] >= licenses.COVERAGE]
        score = max([1.0 for _ in base] + [min(1.0, s[3]) for s in found if not s[4]], default=0.0)
        names = lambda xs: ",".join(sorted({s[2] for s in xs}))
        expect[d, t] = (len(words(t)), len(base), min([s[0] for s in base], default=None), max([s[0] for s in base], default=None), names(base), names(more), score, sorted(s[:4] for s in more))
    assert len(got) == len(expect)
    found = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted(tuple(s) for s in r.spans)) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, expect.values()))
    assert len({x[5] for x in expect.values()}) > 5
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, phrases={"too short": "x"})


def test_tiling_catches_reordered_passages(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa".split()
    texts = {
        1: "start " + " ".join(item) + " end",
        2: " ".join(item[8:]).upper() + ", in between, " + " ".join(item[:8]),
        3: " ".join(item[:6]) + " and nothing else of it",
        4: " ".join(reversed(item)),
        5: None, 6: "",
    }
    schema = "doc_id bigint, text string, item_id string, h int, tid int, pos int"
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in texts.items()] + [(1, texts[1], "x", 1, 2, 3), (None, texts[1], "x", 1, 2, 3)], schema)
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (7, " ".join(item))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.covered, len(r.tiles)) for r in decontam.benchmark_tiles(docs, bench).collect()}
    assert got == {(1, 7): (16, 1), (2, 7): (16, 2), (None, 7): (16, 1)}
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def plain_dedup(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    holders = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != doc)]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, rows):
    expect = plain_dedup(rows)
    assert sum(x[1] for x in expect.values()) > 20
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.line_report(docs).collect()}
    assert got == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in expect.items()}
    texts = {r.doc_id: (r.text, r.n_chars) for r in linededup.dedup_lines(docs).collect()}
    assert texts == {d: (None if t is None else expect[d][2], None if t is None else len(expect[d][2])) for d, t, *_ in rows}


def test_line_dedup_of_odd_rows(spark):
    line = "this line stands in every document"
    docs = spark.createDataFrame([(1, line, "a"), (1, line, "b"), (2, line + "\nown", "c"), (3, line.upper(), "d"), (None, line, "e")], "doc_id bigint, text string, keep string")
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "", "a"), (1, "", "b"), (2, "own", "c"), (3, line.upper(), "d"), (None, line, "e")], key=str)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in prints}


def test_simhash(docs, rows):
    prints = {d: plain_fingerprint(t) for d, t, *_ in rows}
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    expect = plain_components(prints)
    assert {r.doc_id: r.component_id for r in got} == expect
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(expect.values()))


@pytest.mark.parametrize("seed", [2, 5, 7])
def test_links_connect_as_all_pairs_do(spark, seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for center in list(fps)[:3]:
        for _ in range(40):
            center ^= 1 << rng.randrange(64)
            fps.add(center)
            fps.add(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    for a, b in ((0, 1), (0, 40), (5, 6), (33, 63), (31, 32)):  # lone pairs: two bits of one half, one of each
        fps |= {x := rng.getrandbits(64), x ^ (1 << a) ^ (1 << b)}
    signed = lambda x: x - (1 << 64) * (x >> 63)
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    found = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(frame).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    roots = {r.node: r.root for r in components.components(simhash.links(frame), "a", "b").collect()}
    expect = plain_components({signed(x): x for x in sorted(fps, key=signed)})
    classes = {}
    for x, r in expect.items():
        classes.setdefault(r, set()).add(x)
    for members in classes.values():
        assert len({roots.get(x, x) for x in members}) == 1
    assert len({roots.get(x, x) for x in expect}) == len(classes)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 300)] + [(500, 400), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 200 for i in range(200, 300)}, 400: 400, 500: 400}


def test_filter_of_hashes(spark):
    """All hashes that a filter was made of pass it, and few others; MARK and none at all included."""
    import numpy as np

    from lodestack.llm import grams

    rng = np.random.default_rng(5)
    own, other = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    passes = grams.hash_filter(spark.createDataFrame([(int(h),) for h in [*own, grams.MARK]], "h bigint"))
    assert passes(own).all() and passes(np.array([grams.MARK])).all() and passes(other).mean() < 0.01 and len(passes(own[:0])) == 0
    none = grams.hash_filter(spark.createDataFrame([], "h bigint"))
    assert not none(own).any()


def test_little_is_shuffled_beyond_the_broadcast_bound(spark, monkeypatch, docs, rows):
    """Grams that no template has stay where they are: the rows that reach the join are those that pass the filter."""
    from lodestack.llm import grams

    reference = spark.createDataFrame([("redistribution and use in source and binary forms with or without",)], "text string")
    reference = reference.select(F.inline(grams.small_grams(F.col("text"), 4))).select("h", F.lit(1).alias("tid"), "tpos", "words")
    few, many = (grams.join_grams(docs, ["doc_id"], "text", 4, reference, n).collect() for n in (8, grams.BROADCAST_ROWS + 1))
    assert sorted(few, key=str) == sorted(many, key=str) and len(many) >= len(rows)
    text = spark.createDataFrame([(1, "a redistribution and use in source and binary forms b redistribution and use in x")], "doc_id bigint, text string")
    one = [sorted((r.tpos, r.pos) for r in grams.join_grams(text, ["doc_id"], "text", 4, reference, n).collect() if r.tid) for n in (8, grams.BROADCAST_ROWS + 1)]
    assert one[0] == one[1] == [(0, 1), (0, 10), (1, 2), (2, 3), (3, 4), (4, 5)]
