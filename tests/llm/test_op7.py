"""The toxicity classifier: held-out accuracy, unseen misspellings, odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.llm import toxicity

STEMS = ["grobnix", "vurkash", "plimdor"]


def rows(n=900, seed=3):
    rng = random.Random(seed)
    syllables = ["ta", "no", "ri", "el", "su", "mo", "ka", "pen", "dor", "lim", "vur", "ix"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        said = [word() for _ in range(rng.randint(3, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 5)):
                said.insert(rng.randrange(len(said) + 1), rng.choice(STEMS) + rng.choice(["", *syllables]))
        out.append((i, " ".join(said), toxic))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    data = rows()
    docs = spark.createDataFrame([*((d, t) for d, t, _ in data), (None, "x grobnix"), (5000, None), (5001, ""), (5001, ""), (5002, "mo " * 30000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([*((d, 0, y) for d, _, y in data), (None, 0, 1), (5000, 0, None)], "doc_id bigint, quality int, toxic int")
    return data, docs.withColumn("score", F.lit("kept")), labels


def test_held_out_accuracy_and_odd_rows(tables):
    data, docs, labels = tables
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    truth = {d: y for d, _, y in data}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in by.items() if d is not None)
    held = [(by[d].predicted, y) for d, y in truth.items() if by[d].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert by[5000].score == by[5001].score == 0
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if not r.predicted)


def test_misspellings_share_ngrams():
    data = rows()
    model = toxicity.fit([t for _, t, _ in data], [y for *_, y in data])
    plain = "ta no ri mo ka el su pen "
    score = dict(zip("abcd", model.scores(pa.array([plain, plain + "grobnixx", plain + "vurkashh", plain + "tanori"])).to_pylist()))
    assert min(score["b"], score["c"]) > max(score["a"], score["d"])
    again = toxicity.fit([t for _, t, _ in data], [y for *_, y in data])
    assert np.array_equal(model.weights, again.weights) and model.shift == again.shift


def test_no_labels_and_empty_tables(spark, tables):
    _, docs, labels = tables
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_threshold_is_the_same_at_every_size(spark):
    """Ten times as many labels of either kind, with the same sample, leave the threshold where it is."""
    half = spark.range(60_000).where(toxicity.learned_from(F.col("id"))).select("id", (F.xxhash64("id") < 0).alias("low")).orderBy("id").collect()
    low, high = [r.id for r in half if r.low], [r.id for r in half if not r.low]
    rng = random.Random(5)
    data = [(d, t, y if rng.random() < 0.8 else 1 - y) for d, (_, t, y) in zip(low, rows(600, seed=8))]  # some labels are wrong
    bad = sum(y for *_, y in data)
    more = [(d, int(k < 9 * bad)) for k, d in enumerate(high[: 9 * len(data)])]
    docs = spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id bigint, text string")
    few, many = ([(d, y) for d, _, y in data], [*((d, y) for d, _, y in data), *more])
    models = [toxicity.fit_on(docs, spark.createDataFrame(x, "doc_id bigint, toxic int"), per_label=150) for x in (few, many)]
    assert min(bad, len(data) - bad) > 150 and np.array_equal(models[0].weights, models[1].weights)
    assert models[0].shift == models[1].shift
    assert toxicity.fit(["grobnix ta", "ta no"] * 40, [1, 0] * 40, 40, toxic_rows=40).shift == toxicity.fit(["grobnix ta", "ta no"] * 40, [1, 0] * 40).shift


def plain_score(model, text, passage=toxicity.PASSAGE):
    """Word by word and passage by passage, with the fitted weights."""
    said = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    if not said:
        return 0.0
    scores = []
    for w in said:
        buckets, _ = toxicity.gram_buckets([w])
        scores.append(float(np.mean(model.weights[buckets].astype(np.float64))))
    width = min(passage, len(said))
    best = max(sum(scores[i : i + width]) / width for i in range(len(said) - width + 1))
    return 1 / (1 + math.exp(-(best + model.shift)))


@pytest.mark.parametrize("passage", [toxicity.PASSAGE, 3, toxicity.WHOLE])
def test_scores_against_a_plain_scorer(passage):
    data = rows(400)
    model = toxicity.fit([t for _, t, _ in data], [y for *_, y in data], passage=passage)
    texts = [None, "", " .,", "Ta", "GROBNIX ta", "é grobnix É mo", *(t for _, t, _ in data[:60]), "mo " * 3000 + "grobnix", "a" * 5000]
    got = model.scores(pa.array(texts)).to_pylist()
    assert got == pytest.approx([plain_score(model, t, passage) for t in texts], abs=1e-4)


def test_passages_come_from_whole_texts():
    long = " ".join(f"w{i}" for i in range(50_000)) + " Grobnix"
    got = toxicity.drawn_passages(pa.array([long, "Ta, no.", None, " .", " ".join("abcdefgh")]), pa.array([5, 6, 7, 8, 9])).to_pylist()
    assert got[1:] == [["ta no"], [], [], ["a b c d e f g h"]]
    places = [int(p.split()[0][1:]) for p in got[0]]
    assert len(places) == toxicity.DRAWN and min(places) < 10_000 and max(places) > 40_000
    assert all(p == " ".join(f"w{i}" for i in range(a, a + 8)) for p, a in zip(got[0], places))
    model = toxicity.fit([t for _, t, _ in rows(300)], [y for *_, y in rows(300)])
    worst = model.worst(pa.array([long, "", "ta"])).to_pylist()
    assert "grobnix" in worst[0]["said"] and worst[1] == {"mean": -math.inf, "said": None} and worst[2]["said"] == "ta"


def test_what_is_learned_may_stand_anywhere_in_a_long_text(spark):
    """The few words that make a text toxic stand between hundreds of others."""
    rng = random.Random(6)
    data = [(d, " ".join(["mo ta no"] * rng.randint(0, 80) + [t] + ["el su ri"] * rng.randint(0, 80)), y) for d, t, y in rows(900)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in data], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[d].predicted, y) for d, _, y in data if got[d].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_a_doc_id_that_many_rows_repeat_is_one_row(spark):
    data = rows(200)
    docs = spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in data], "doc_id bigint, toxic int")
    one = next(d for d, *_ in data if zlib.crc32(str(d).encode()) % 5)
    more = spark.range(10_000).select(F.lit(one).cast("bigint").alias("doc_id"), F.concat(F.lit("~"), F.col("id").cast("string")).alias("text"))
    plain, again = toxicity.fit_on(docs, labels), toxicity.fit_on(docs.union(more), labels)
    assert np.array_equal(plain.weights, again.weights) and plain.shift == again.shift
