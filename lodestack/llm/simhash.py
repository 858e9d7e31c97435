"""SimHash near-duplicates over deletion-variant signatures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import flat, grams
from lodestack.llm.components import components
from lodestack.llm.shared import cut, packed, saved

SHINGLE, MAX_BITS = 3, 2
#: Bytes of a text whose words are held at once.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(raw: bytes, k: int) -> Iterator[int]:
    """Hashes of a text's shingles in their order; its words are split BLOCK bytes at a time."""
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    raw = raw.lower()  # A-Z only
    words, at, many = [], 0, False
    while at < len(raw):
        stop = len(raw) if at + BLOCK >= len(raw) else next((m.start() for m in _SPACE.finditer(raw, at + BLOCK)), len(raw))
        words = words[max(0, len(words) - k + 1) :] + raw[at:stop].split()  # at [\x20\x09-\x0D]
        at = stop
        if len(words) >= k:
            many = True
            yield from (hashed(join(x), 42) for x in zip(*(words[i:] for i in range(k))))
    if words and not many:
        yield hashed(join(words), 42)


def fingerprint_array(texts: pa.Array, k: int = SHINGLE) -> pa.Array:
    """SimHash of each text as a signed 64-bit integer."""
    out = np.zeros(len(texts), np.uint64)
    for low, high, data, offsets in flat.pieces(texts):
        raw, cuts = data.tobytes(), offsets.tolist()
        rows = [np.fromiter(_hashes(raw[a:b], k), np.uint64) for a, b in zip(cuts, cuts[1:])]
        sizes = np.array([len(x) for x in rows])
        full = np.flatnonzero(sizes)
        if not len(full):
            continue
        flat_hashes = np.concatenate(rows)
        ends = np.cumsum(sizes)
        counts = np.zeros((high - low, 64), np.int64)
        for block in range(0, 64, 8):  # a byte of the hashes at a time
            bits = np.unpackbits(((flat_hashes >> np.uint64(block)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            counts[full, block : block + 8] = np.add.reduceat(bits, (ends - sizes)[full], axis=0, dtype=np.int64)
        out[low:high] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return pa.array(out.view(np.int64))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs' columns and fp; null and empty texts have fingerprint 0."""
    grams.bounded_batches(docs.sparkSession)
    return docs.withColumn("fp", F.arrow_udf(lambda x: fingerprint_array(x, k), "bigint")(F.coalesce("text", F.lit(""))))


def _variants(fps: DataFrame) -> DataFrame:
    """(sig, half, fp): each half with one of its bits left out.

    Of two fingerprints that differ in two bits or fewer, one half differs in one bit at most. Such
    halves agree in the variant without that bit.
    """
    half = F.when(F.col("i") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    fps = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    bit = F.expr("shiftleft(1L, i % 32)")
    sig = half.bitwiseAND(F.bitwise_not(bit)).bitwiseOR(F.expr("shiftleft(cast(i as bigint), 32)"))
    return fps.select(sig.alias("sig"), F.expr("cast(i div 32 as tinyint)").alias("half"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in MAX_BITS or fewer; enough of them to connect whatever all such pairs connect.

    Signatures that more than one fingerprint has name the candidates. Comparing all that share one would
    make pairs without bound where near copies are many, so they are verified by one more equality: a
    candidate steps to itself and to each center one bit away in the half that its shared signature leaves
    open. Two that are linked step to a center in common (where either half differs in a bit they share
    signatures of both, and step in both), and all that step to one center are linked; each takes a link to
    the smallest of them. Rows are in proportion to the fingerprints, however many share a signature.
    """
    variants = _variants(fps).repartition("sig")  # one shuffle for the count and the join
    shared = variants.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
    candidates = variants.join(shared.hint("merge"), "sig").groupBy("fp").agg(F.bool_or(F.col("half") == 0).alias("_low"), F.bool_or(F.col("half") == 1).alias("_high"))
    bits = lambda first: f"transform(sequence({first}, {first + 31}), i -> fp ^ shiftleft(1L, i))"
    centers = f"concat(array(fp), if(_low, {bits(32)}, array()), if(_high, {bits(0)}, array()))"
    around = cut(candidates.select("fp", F.explode(F.expr(centers)).alias("center")))
    smallest = around.groupBy("center").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("center", "a")
    found = around.join(smallest, "center").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) per row of docs.

    docs needs doc_id and text. Texts without a word have fingerprint 0 and link like any other.
    Rows that repeat a doc_id are kept and linked by that doc_id too. A row without a doc_id has
    its fingerprint and links others, but is never the id of a component; it takes that of the
    others, null if there are none.
    """
    prints = cut(fingerprints(docs.select("doc_id", "text"), k).select("doc_id", "fp"))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(groups.select("fp")), "a", "b")
    roots = groups.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = roots.join(names, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs with one document of each group of near-duplicates, that with the smallest doc_id, and all rows without a doc_id."""
    found = saved(near_duplicates(docs, k).where("doc_id <> component_id").select(F.col("doc_id").alias("__copy_of")).distinct(), "near-copies")
    return packed(docs, "doc_id").join(found, F.col("doc_id") == F.col("__copy_of"), "left_anti").select("row.*")
