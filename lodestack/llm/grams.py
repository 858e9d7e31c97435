"""Rolling word k-gram hashes as a Spark column, and verified joins of them to small texts.

Licence scans and benchmark decontamination both join every k-gram of every document to the
k-grams of a reference set. The hashes are made from Arrow batches with numpy; the join, the
check of the words and all grouping are Spark's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import flat

#: The last gram of each document: it keeps documents without a match in the result.
MARK = -(1 << 63)

GRAMS = "struct<n_words:int,h:array<bigint>,pos:array<int>,at:array<int>,until:array<int>>"

#: Reference grams, and other rows of numbers, are broadcast up to this many (about 100 bytes each), texts up to so many bytes; beyond it they are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


#: Bytes of an Arrow batch.
BATCH_BYTES = 32 << 20
#: Bits of a filter of hashes (8 MB, whatever it is made of), as a power of two, and bits that a hash sets. With 3 million hashes it lets one other in 500 pass.
FILTER_BITS, FILTER_HASHES = 26, 3


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows and BATCH_BYTES, unless the session already asks for fewer."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def _filter_places(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash in a filter, a row for each."""
    seeds = np.arange(1, FILTER_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (flat.mix(hashes.view(np.uint64)[:, None] ^ seeds) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def hash_filter(hashes: DataFrame):
    """A test for arrays of hashes that all of hashes' column h pass and few others: a Bloom filter of a fixed size, made in the tasks and sent to them.

    However many hashes there are, at most its 2**FILTER_BITS bits come to the driver; with too many it lets
    more pass, and changes no result.
    """
    places = F.arrow_udf(lambda h: pa.array(list(_filter_places(h.to_numpy())), pa.list_(pa.int64())), "array<bigint>")
    at = hashes.select(F.explode(places("h")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent = hashes.sparkSession.sparkContext.broadcast(table)

    def passes(found: np.ndarray) -> np.ndarray:
        at = _filter_places(found)
        return ((sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)

    return passes


def _of_piece(data: np.ndarray, offsets: np.ndarray, k: int, passes=None) -> tuple[pa.Array, ...]:
    words, starts, ends, upto = flat.word_hashes(data, offsets)
    grams = flat.gram_hashes(words, k).view(np.int64)
    grams[grams == MARK] += 1
    n_words = np.diff(upto)
    n_grams = np.maximum(n_words - k + 1, 0)
    take = flat.ranges(upto[:-1], n_grams)
    rows = np.repeat(np.arange(len(n_words)), n_grams)
    ends_at = np.cumsum(n_grams + 1)
    out = np.full(int(ends_at[-1]), MARK, np.int64)
    spot = np.arange(len(take)) + rows
    out[spot] = grams[take]
    first, last = np.zeros((2, len(out)), np.int32)
    first[spot] = starts[take] - offsets[rows]
    last[spot] = ends[take + k - 1] - offsets[rows]
    cuts = np.concatenate(([0], ends_at))
    if passes is not None:
        keep = (out == MARK) | passes(out)
        cuts = np.concatenate(([0], np.cumsum(keep)))[cuts]
        out, first, last = out[keep], first[keep], last[keep]
        spot = np.flatnonzero(keep) - np.repeat(np.concatenate(([0], ends_at))[:-1], np.diff(cuts))
    else:
        spot = np.arange(len(out)) - np.repeat(cuts[:-1], np.diff(cuts))
    return pa.array(n_words.astype(np.int32)), flat.list_array(out, cuts), flat.list_array(spot.astype(np.int32), cuts), flat.list_array(first, cuts), flat.list_array(last, cuts)


def grams_of(text: Column, k: int, passes=None) -> Column:
    """Of each text: its words, its gram hashes (those that pass, see hash_filter()) and MARK, their places in words, and the bytes where each starts and ends."""

    def make(column: pa.Array) -> pa.Array:
        parts = [_of_piece(data, offsets, k, passes) for _, _, data, offsets in flat.pieces(column)]
        fields = [pa.concat_arrays(x) for x in zip(*parts)]
        return pa.StructArray.from_arrays(fields, ["n_words", "h", "pos", "at", "until"])

    return F.arrow_udf(make, GRAMS)(text)


def distinct_grams(text: Column, k: int, passes=None) -> Column:
    """The different gram hashes of each whole text, those that pass."""

    def make(column: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.int64()))]
        for _, _, data, offsets in flat.pieces(column):
            words, _, _, upto = flat.word_hashes(data, offsets)
            found = flat.gram_hashes(words, k).view(np.int64)
            n = np.maximum(np.diff(upto) - k + 1, 0)
            own = found[flat.ranges(upto[:-1], n)]
            row = np.repeat(np.arange(len(n)), n)
            if passes is not None:
                keep = passes(own)
                own, row = own[keep], row[keep]
            order = np.lexsort((own, row))
            own, row = own[order], row[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
            out.append(flat.list_array(own[new], np.searchsorted(row[new], np.arange(len(n) + 1))))
        return pa.concat_arrays(out)

    return F.arrow_udf(make, "array<bigint>")(F.coalesce(text, F.lit("")))


def small_grams(text: Column, k: int) -> Column:
    """(hash, position, words) of the k-grams of short texts; fewer words have none."""

    def make(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words, starts, ends, _ = flat.word_hashes(raw, np.array([0, len(raw)]))
            said = [flat.LOWER[raw[s:e]].tobytes().decode() for s, e in zip(starts, ends)]
            found = flat.gram_hashes(words, k).view(np.int64)
            rows.append([{"h": h + (h == MARK), "tpos": i, "words": " ".join(said[i : i + k])} for i, h in enumerate(found.tolist())])
        return pa.array(rows, pa.list_(pa.struct([("h", pa.int64()), ("tpos", pa.int32()), ("words", pa.string())])))

    return F.arrow_udf(make, "array<struct<h:bigint,tpos:int,words:string>>")(text)


def normal_words(raw: Column) -> Column:
    """Words of a span of bytes, A-Z lower-cased, joined by one space."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_replace(F.translate(raw.cast("string"), upper, upper.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def join_grams(docs: DataFrame, keys: list[str], text: str, k: int, reference: DataFrame, n_reference: int) -> DataFrame:
    """Places where a document's k words are a reference's k words.

    reference: (h, tid, tpos, words) and its number of rows. Returns keys, n_words, tid, tpos and pos;
    of each document also one row with a null tid. Equal hashes of other words are left out. Rows of
    docs that repeat the keys must repeat the text.

    A reference of up to BROADCAST_ROWS is broadcast. Beyond that only the grams that pass a filter of the
    reference's hashes travel to it, each with its own words; texts stay where they are. Either way each gram
    is checked by its words.
    """
    raw, passes = F.col(text).cast("binary").alias("_raw"), None
    if n_reference > BROADCAST_ROWS:
        passes = hash_filter(reference.select("h"))
    g = docs.select(*keys, raw, grams_of(F.coalesce(F.col(text), F.lit("")), k, passes).alias("_g"))
    g = g.select(*keys, "_raw", "_g.n_words", F.col("_g.pos").alias("_places"), F.col("_g.at").alias("_at"), F.col("_g.until").alias("_until"), F.col("_g.h").alias("_hs"))
    g = g.select("*", F.posexplode("_hs").alias("_i", "_h")).withColumn("pos", F.get("_places", F.col("_i")))
    start, end = F.get("_at", F.col("_i")), F.get("_until", F.col("_i"))
    words = normal_words(F.substring(F.col("_raw"), start + 1, end - start))
    columns = [*keys, "n_words", "tid", "tpos", "pos"]
    if passes is None:
        mark = docs.sparkSession.range(1).select(F.lit(MARK).alias("h"), *(F.lit(None).cast(t).alias(c) for c, t in reference.dtypes if c != "h"))
        met = g.join(F.broadcast(reference.unionByName(mark)), F.col("_h") == F.col("h"))
        return met.where(F.col("tid").isNull() | (words == F.col("words"))).select(*columns)
    met = g.where(F.col("_h") != MARK).select(*keys, "n_words", "pos", "_h", words.alias("_words")).join(reference.hint("merge"), (F.col("_h") == F.col("h")) & (F.col("_words") == F.col("words")))
    alone = g.where(F.col("_h") == MARK).select(*keys, "n_words", *(F.lit(None).cast(t).alias(c) for c, t in [*reference.dtypes, ("pos", "int")] if c in ("tid", "tpos", "pos")))
    return met.select(*columns).unionByName(alone)
