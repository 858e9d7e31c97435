"""Token ids by the byte-level BPE of a tokenizers file, and their store in ORC."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import flat, grams
from lodestack.llm.shared import cut
from lodestack.llm.spantable import SpanTable, kept, lists

#: Rows between two entries of an ORC row index, and bytes of a stripe.
ROW_INDEX_STRIDE, STRIPE_BYTES = 1000, 16 << 20


def _table(path: str) -> SpanTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    size = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)  # bytes of each token: one a character, but for added ones
    for token, i in tokenizer.get_vocab().items():
        size[i] = len(special[i].encode()) if i in special else len(token)

    def alone(spans: list[bytes]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([s.decode() for s in spans], add_special_tokens=False)]

    def work(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Spans that start with white space and end without are encoded as one text, which is much faster."""
        join = [s[:1].isspace() and 32 < s[-1] < 127 for s in spans]
        apart = alone([s for s, j in zip(spans, join) if not j])
        whole = b"".join(s for s, j in zip(spans, join) if j).decode()
        ids = np.array(tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.int32) if whole else np.zeros(0, np.int32)
        ends = np.cumsum([len(s) for s, j in zip(spans, join) if j], dtype=np.int64)
        upto = np.searchsorted(np.cumsum(size[ids]), ends, "right")
        counts = np.zeros(len(spans), np.int64)
        joined = np.array(join, bool)
        counts[joined] = np.diff(np.concatenate(([0], upto)))
        counts[~joined] = [len(x) for x in apart]
        out = np.zeros(int(counts.sum()), np.int32)
        starts = np.cumsum(counts) - counts
        out[flat.ranges(starts[joined], counts[joined])] = ids
        out[flat.ranges(starts[~joined], counts[~joined])] = np.fromiter((i for x in apart for i in x), np.int32)
        return out, counts

    return SpanTable(work)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the spans that the tokenizer's pattern never joins: where ASCII white space follows other characters.

    No match of the pattern goes from a character that is not white space into white space, and
    none looks back. After white space outside ASCII the text stays whole, as a run of it may go on.
    """
    space = flat.SPACE[data]
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = space[1:] & ~space[:-1]
    wide = np.flatnonzero(start[:-1] & np.concatenate(([False], data[:-1] >= 128)))
    if len(wide):
        a, b, c = (np.where(wide >= k, data[wide - k], 0) for k in (3, 2, 1))
        odd = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
        odd |= (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        start[wide[odd]] = False
    start[offsets] = True
    start[-1] = False
    return np.flatnonzero(start)


def encode_array(texts: pa.Array, path: str, end: int | None) -> pa.Array:
    out = [pa.array([], pa.list_(pa.int32()))]
    for _, _, data, offsets in flat.pieces(texts):
        starts = cut_points(data, offsets)
        numbers, counts = kept(("bytebpe", path), lambda: _table(path)).values(data, starts, np.append(starts[1:], len(data)))
        ids, cuts = lists(numbers, counts, np.searchsorted(starts, offsets), end)
        out.append(flat.list_array(ids, cuts))
    return pa.concat_arrays(out)


def encode(text: Column, path: str, end: int | None = None) -> Column:
    """Ids of each whole text (null: empty), and the end id after them.

    Rows that repeat a text have equal ids, an empty table gives no rows, other columns are not looked at.
    A text without white space, however long, is one call of the library.
    """
    return F.arrow_udf(lambda x: encode_array(x, path, end), "array<int>")(F.coalesce(text, F.lit("")))


def write_ids(docs: DataFrame, out: str, path: str, end: int, parts: int | None = None) -> None:
    """docs' ids as ORC files in ascending doc_id order: rows (doc_id, ids).

    Integers are run-length encoded; each stripe has row indexes of doc_id and a Bloom filter on it,
    so a reader skips files, stripes and row groups without a wanted id. A range of ids goes to each
    task, which sorts and encodes it as it streams; rows that repeat a doc_id may be dealt to several
    tasks and stand in the order of their texts' hashes. Null ids come first. The text travels, not the
    ids, which are larger.
    """
    grams.bounded_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    keyed = keyed.repartitionByRange(*([parts] if parts else []), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    ids = keyed.select("doc_id", "_tie", encode(F.col("text"), path, end).alias("ids"))
    ids.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option(
        "orc.row.index.stride", str(ROW_INDEX_STRIDE)
    ).option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").orc(out)


def read_ids(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, _tie, ids); with doc_ids only theirs, found by the files' indexes and Bloom filters."""
    rows = spark.read.orc(out)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _crc(ids: pa.Array) -> pa.Array:
    values, cuts = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_pylist()
    return pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.int64())


def positions(rows: DataFrame) -> DataFrame:
    """Per document doc_id, start (ids before it), n_tokens and ids_crc32, from the files.

    Only these numbers are shuffled. The files' own sums, one row each, are added up apart; within a
    file, which is no more than one range of ids, a running sum goes on from there.
    """
    crc = F.arrow_udf(_crc, "bigint")
    at = cut(rows.select("doc_id", "_tie", F.input_file_name().alias("_file"), F.size("ids").cast("bigint").alias("n_tokens"), crc("ids").alias("ids_crc32")))
    sums = at.groupBy("_file").agg(F.sum("n_tokens").alias("_sum"))
    # files are numbered in the ids' order; names alone would sort part-100000 before part-99999
    number = lambda pattern: F.regexp_extract(F.substring_index("_file", "/", -1), pattern, 1).try_cast("bigint")
    order = Window.orderBy(number(r"^part-(\d+)"), number(r"c(\d+)\."), "_file")
    sums = sums.select("_file", (F.sum("_sum").over(order) - F.col("_sum")).alias("_before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("_file").orderBy("doc_id", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = at.withColumn("_upto", inner - F.col("n_tokens")).join(sums, "_file")
    return at.select("doc_id", (F.col("_before") + F.col("_upto")).alias("start"), "n_tokens", "ids_crc32")
