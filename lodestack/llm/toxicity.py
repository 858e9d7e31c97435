"""Toxicity by subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import flat, grams
from lodestack.llm.shared import packed, saved
from lodestack.llm.spantable import SpanTable, kept

#: Labelled rows that a model is fitted on, of each label.
SAMPLE_PER_LABEL = 4000
#: Passages of a row's whole text that are drawn at random, and times that its most toxic one is looked for while fitting.
DRAWN, ROUNDS = 24, 6
#: Words of a passage; a text is as toxic as its most toxic passage.
PASSAGE = 8
#: A passage that is always the whole text.
WHOLE = 1 << 40
SIZES, BUCKETS, WIDTH = (3, 4, 5, 6), 1 << 18, 8
#: Epochs over drawn passages and after each search for the most toxic ones, rows of a step, and its length.
EPOCHS, AFTER, BATCH, RATE = 4, 2, 256, 0.3
#: Rows by whose labels the threshold is set, one in so many; they take no part in the descent.
CALIBRATION = 4

_PRIME = np.uint64(0x100000001B3)


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams of bytes, with < and > around it, and of the whole word; and their counts."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    padded = np.frombuffer(b"".join(b"<%s>" % w for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(padded))  # bytes to the word's end
    of = np.repeat(np.arange(len(words)), sizes)
    hashes, owners = [], []
    for n in SIZES:
        h = np.full(max(0, len(padded) - n + 1), n, np.uint64)
        for j in range(n):
            h = h * _PRIME + padded[j : j + len(h)] + np.uint64(1)
        ok = left[: len(h)] >= n
        hashes.append(h[ok])
        owners.append(of[: len(h)][ok])
    raw = padded.astype(np.uint8)
    hashes.append(flat.span_hashes(raw, ends - sizes, ends))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (flat.mix(np.concatenate(hashes))[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owner, minlength=len(words))


def passage_means(scores: np.ndarray, upto: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its highest mean over passage words (over all, where it has fewer), and the passage's start. No word: -inf, -1."""
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    n = np.diff(upto)
    width = np.minimum(n, passage)
    windows = np.where(n > 0, n - width + 1, 0)
    best, at = np.full(len(n), -np.inf), np.full(len(n), -1)
    full = np.flatnonzero(n)
    if len(full):
        start = flat.ranges(upto[:-1][full], windows[full])
        w = np.repeat(width[full], windows[full])
        means = (sums[start + w] - sums[start]) / w
        first = np.cumsum(windows[full]) - windows[full]
        best[full] = np.maximum.reduceat(means, first)
        hit = np.flatnonzero(means == np.repeat(best[full], windows[full]))
        of = np.repeat(np.arange(len(full)), windows[full])[hit]
        _, one = np.unique(of, return_index=True)
        at[full] = start[hit[one]]
    return best, at


def _spans(texts: pa.Array) -> Iterator[tuple]:
    """(first row, bytes in lower case, starts and ends of words, words before each row) of whole texts, a piece at a time."""
    for low, _, data, offsets in flat.pieces(texts):
        data = flat.LOWER[data]
        starts, ends = flat.bounds(flat.ALNUM[data], offsets)
        yield low, data, starts, ends, np.searchsorted(starts, offsets)


def drawn_passages(texts: pa.Array, seeds: pa.Array, passage: int = PASSAGE) -> pa.Array:
    """Passages from anywhere in each whole text, its words joined by one space; a text of at most a passage is its only one."""
    out: list[list[str]] = []
    seeds = seeds.to_numpy(False)
    for low, data, starts, ends, upto in _spans(texts):
        raw, cuts = data.tobytes(), list(zip(starts.tolist(), ends.tolist()))
        for i, n in enumerate(np.diff(upto).tolist()):
            places = np.random.default_rng(int(seeds[low + i]) & 0xFFFFFFFF).integers(0, n - passage + 1, DRAWN) if n > passage else [0] * (n > 0)
            said = [b" ".join(raw[a:b] for a, b in cuts[upto[i] + p : upto[i] + min(p + passage, n)]) for p in dict.fromkeys(map(int, places))]
            out.append([x.decode() for x in said])
    return pa.array(out, pa.list_(pa.string()))


@dataclass(frozen=True)
class Model:
    """Weight of every bucket (its vector times the difference of the softmax's two rows), and what is added."""

    weights: np.ndarray
    shift: float
    passage: int = PASSAGE
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buckets, counts = gram_buckets(words)
        ones = np.ones(len(words), np.int64)
        if not len(words):
            return np.zeros(0, np.float32), ones
        return (np.add.reduceat(self.weights[buckets], np.cumsum(counts) - counts) / counts).astype(np.float32), ones

    def _best(self, texts: pa.Array) -> Iterator[tuple]:
        table = kept(("toxicity", self.name), lambda: SpanTable(self.word_scores, np.float32))
        for low, data, starts, ends, upto in _spans(texts):
            said, _ = table.values(data, starts, ends)
            yield low, data, starts, ends, upto, *passage_means(said, upto, self.passage)

    def scores(self, texts: pa.Array) -> pa.Array:
        """Probability of the toxic class, of each text's most toxic passage; a text without a word scores 0."""
        out = np.full(len(texts), -np.inf)
        for low, *_, best, _ in self._best(texts):
            out[low : low + len(best)] = best
        with np.errstate(over="ignore"):
            return pa.array(1 / (1 + np.exp(-(out + self.shift))))

    def worst(self, texts: pa.Array) -> pa.Array:
        """Of each whole text its most toxic passage and that one's mean; null and minus infinity without a word."""
        means, said = [], []
        for _, data, starts, ends, upto, best, at in self._best(texts):
            raw = data.tobytes()
            for i, (mean, place) in enumerate(zip(best.tolist(), at.tolist())):
                stop = min(place + self.passage, int(upto[i + 1]))
                means.append(mean)
                said.append(b" ".join(raw[a:b] for a, b in zip(starts[place:stop].tolist(), ends[place:stop].tolist())).decode() if place >= 0 else None)
        return pa.StructArray.from_arrays([pa.array(means, pa.float64()), pa.array(said, pa.string())], ["mean", "said"])


class _Vocabulary:
    """Numbers of words, and the buckets of each."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.buckets, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def passages(self, said: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of passages, one after the other, and how many each has."""
        words = [x.encode().split(b" ") for x in said]
        known = len(self.index)
        ids = [self.index.setdefault(w, len(self.index)) for x in words for w in x]
        new = list(self.index)[known:]
        parts = [gram_buckets(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
        self.buckets, self.counts = (np.concatenate([x, *(p[k] for p in parts)]) for k, x in enumerate((self.buckets, self.counts)))
        return np.array(ids, np.int32), np.array([len(x) for x in words], np.int64)


def fit_passages(drawn: list[list[str]], toxic: list[int], worst: Callable[[Model], tuple], clean_rows: int | None = None, toxic_rows: int | None = None, seed: int = 11, passage: int = PASSAGE) -> Model:
    """A model of rows' labels: bucket vectors and the softmax, trained jointly by gradient descent.

    drawn: passages of each row, none of a row without a word. worst: of each row the mean and the words of the
    most toxic passage of its whole text under a model. Drawn passages are learned from first. Then each row
    gives its most toxic passage under the model so far, and a drawn one if its label is 0, ROUNDS times.
    clean_rows, toxic_rows: how many rows those of label 0 and of label 1 stand for, when the threshold is
    set. Without rows of both labels every text scores 0.1.
    """
    y = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(0.1 / 0.9)), passage)
    rng, words = np.random.default_rng(seed), _Vocabulary()
    n = np.array([len(x) for x in drawn])
    word, size = words.passages([p for x in drawn for p in x])
    first = np.cumsum(n) - n
    vectors = rng.uniform(-1e-3, 1e-3, (BUCKETS, WIDTH)).astype(np.float32)  # next to nothing for n-grams that are never met
    soft, bias = rng.normal(0, 0.5, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32)
    memory, memory_soft = np.full((BUCKETS, WIDTH), 1e-6, np.float32), np.full((2, WIDTH), 1e-6, np.float32)
    held = np.zeros(len(y), bool)
    held[rng.permutation(len(y))[:: CALIBRATION]] = True
    learn = np.flatnonzero(~held & (n > 0))

    def step(said: np.ndarray, size: np.ndarray, y: np.ndarray) -> None:
        used, inverse = np.unique(said, return_inverse=True)
        at = np.cumsum(words.counts) - words.counts
        counts = words.counts[used]
        ids = words.buckets[flat.ranges(at[used], counts)]
        of_word = np.add.reduceat(vectors[ids], np.cumsum(counts) - counts) / counts[:, None].astype(np.float32)
        mean = np.add.reduceat(of_word[inverse], np.cumsum(size) - size) / size[:, None].astype(np.float32)
        out = mean @ soft.T + bias
        p = np.exp(out - out.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = np.repeat(p @ soft / size[:, None], size, axis=0)
        to_word = np.stack([np.bincount(inverse, back[:, k], len(used)) for k in range(WIDTH)], 1) / counts[:, None]
        spread = np.repeat(to_word, counts, axis=0)
        slope = np.stack([np.bincount(ids, spread[:, k], BUCKETS) for k in range(WIDTH)], 1).astype(np.float32)
        turn = p.T @ mean
        memory[:] += slope**2
        memory_soft[:] += turn**2
        vectors[:] -= RATE * slope / np.sqrt(memory)
        soft[:] -= 0.1 * turn / np.sqrt(memory_soft)
        bias[:] -= 0.1 * p.sum(0)

    def epoch(word: np.ndarray, size: np.ndarray, passages: np.ndarray, rows: np.ndarray) -> None:
        """Steps over passages of rows, as many on either label."""
        cuts = np.cumsum(size) - size
        share = np.where(y[rows] == 1, 0.5 / max(1, (y[rows] == 1).sum()), 0.5 / max(1, (y[rows] == 0).sum()))
        order = rng.choice(len(rows), len(rows), p=share / share.sum())
        for low in range(0, len(order), BATCH):
            pick = order[low : low + BATCH]
            some = passages[pick]
            step(word[flat.ranges(cuts[some], size[some])], size[some], y[rows[pick]])

    def model(shift: float = 0.0) -> Model:
        return Model((vectors @ (soft[1] - soft[0])).astype(np.float32), shift, passage)

    any_of = lambda rows: first[rows] + rng.integers(0, n[rows])
    for _ in range(EPOCHS):
        rows = np.tile(learn, 6)
        epoch(word, size, any_of(rows), rows)
    bad, good = learn[y[learn] == 1], learn[y[learn] == 0]
    for _ in range(ROUNDS):
        _, said = worst(model())
        found, more = words.passages([said[i] for i in learn])
        own = np.full(len(y), -1)
        own[learn] = len(size) + np.arange(len(learn))
        all_words, all_sizes = np.concatenate((word, found)), np.concatenate((size, more))
        for _ in range(AFTER):
            rows = np.concatenate((bad, bad, good, good))
            epoch(all_words, all_sizes, np.concatenate((own[bad], own[bad], own[good], any_of(good))), rows)
    last = model()
    best = np.array(worst(last)[0], np.float64)
    held &= n > 0
    stand_for = [rows / max(1, (y == label).sum()) if rows else 1.0 for label, rows in enumerate((clean_rows, toxic_rows))]
    weight = np.where(y == 1, stand_for[1], stand_for[0])
    return Model(last.weights, -_threshold(best[held], y[held], weight[held]), passage)


def fit(texts: list[str], toxic: list[int], clean_rows: int | None = None, seed: int = 11, toxic_rows: int | None = None, passage: int = PASSAGE) -> Model:
    """fit_passages() of texts at hand."""
    column = pa.array(texts, pa.string())

    def worst(model: Model) -> tuple:
        found = model.worst(column)
        return found.field("mean").to_pylist(), found.field("said").to_pylist()

    drawn = drawn_passages(column, pa.array(range(len(texts)), pa.int64()), passage).to_pylist()
    return fit_passages(drawn, toxic, worst, clean_rows, toxic_rows, seed, passage)


def _threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The score from which on calling a row toxic gives the best F1; of equally good ones the middle."""
    if not len(y):
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, hit, weight = scores[order], y[order], weight[order]
    f1 = 2 * np.cumsum(hit * weight) / (np.cumsum(weight) + max(1e-9, (hit * weight).sum()))
    last = np.append(s[1:] != s[:-1], True)
    f1 = np.where(last, f1, -1)
    k = int(np.argmax(f1))
    below = s[k + 1] if k + 1 < len(s) else s[k] - 1
    return float((s[k] + below) / 2)


def learned_from(doc_id, modulus: int = 5):
    """Whether a row's label may be learned from: the crc32 of its doc_id as text is no multiple of modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus != 0


def fit_on(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, passage: int = PASSAGE) -> Model:
    """A model fitted to a bounded sample: the whole texts of per_label rows of each label at most, in the order of a hash of doc_id.

    docs: doc_id, text; labels: doc_id, toxic. Repeated labels of a doc_id count as toxic if one does; of rows
    that repeat a doc_id the first text in the order of texts is taken, where the rows are. Null labels, ids and
    texts are not learned from. The tasks draw passages from the whole texts, and look through all of them for
    the most toxic passages whenever the model got better; only passages come to the driver, DRAWN of a
    few words and then one of each row. For the threshold each row of the sample stands for as many labels
    as there are of its kind, so that it follows the labels' shares and not the sample's.
    """
    spark = docs.sparkSession
    grams.bounded_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").where(learned_from(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_order", F.xxhash64("doc_id"))
    counts = {r.toxic: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    rows = known.where("toxic = 1").orderBy("_order").limit(per_label).union(known.where("toxic = 0").orderBy("_order").limit(per_label))
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    texts = saved(texts, "labelled-texts")
    draw = F.arrow_udf(lambda t, s: drawn_passages(t, s, passage), "array<string>")
    sample = sorted(texts.select("doc_id", "toxic", draw("text", F.xxhash64("doc_id")).alias("drawn")).collect())
    place = {r.doc_id: i for i, r in enumerate(sample)}

    def worst(model: Model) -> tuple:
        sent = spark.sparkContext.broadcast(model)
        look = F.arrow_udf(lambda t: sent.value.worst(t), "struct<mean:double,said:string>")
        means, said = [-np.inf] * len(sample), [None] * len(sample)
        for r in texts.select("doc_id", look("text").alias("w")).collect():
            means[place[r.doc_id]], said[place[r.doc_id]] = r.w.mean, r.w.said
        return means, said

    return fit_passages([r.drawn for r in sample], [int(r.toxic) for r in sample], worst, counts.get(0), counts.get(1), passage=passage)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs and score (0 to 1) of each whole text; null and empty texts have one too."""
    grams.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn("score", F.arrow_udf(lambda x: sent.value.scores(x), "double")(F.coalesce("text", F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out (its label is not learned from), score and predicted (1 from a score of 0.5 on).

    A null doc_id has no label; its held_out is false. Empty tables give no rows.
    """
    scored = with_scores(docs.select("doc_id", "text"), fit_on(docs, labels))
    held = F.coalesce(~learned_from(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score threshold or more; all columns stay, also ones named as those that are added here.

    Null and empty texts score 0 and stay; rows that repeat are each kept or not; empty tables give no rows.
    """
    return with_scores(packed(docs, "text"), fit_on(docs, labels)).where(F.col("score") < threshold).select("row.*")
