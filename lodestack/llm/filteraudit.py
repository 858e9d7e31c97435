"""How quality filters interact: what each would remove before, after and without the others."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import flat, grams
from lodestack.llm.shared import cut, saved

FILTERS = "ABCDE"
#: A: fewest words; B: distinct words per 100; C: most capitals per 100 code points; D: characters that no text may hold.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
#: Bytes of a text's first block, and how much longer each next one is.
FIRST_BLOCK, GROWTH = 64, 8

_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_MEASURES = pa.struct([("fails", pa.int32()), ("n_chars", pa.int64()), ("blocks", pa.list_(pa.int64()))])


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often mask holds in each row."""
    upto = np.concatenate(([0], np.cumsum(mask)))
    return np.diff(upto[offsets])


def _blocks(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Hashes of each row's successive blocks, which grow by GROWTH; an empty row has none."""
    low, size, starts, rows = offsets[:-1].copy(), FIRST_BLOCK, [], []
    while True:
        left = np.flatnonzero(low < offsets[1:])
        if not len(left):
            break
        starts.append(low[left])
        rows.append(left)
        low = np.minimum(low + size, offsets[1:])
        size *= GROWTH
    if not starts:
        return flat.list_array(np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    start, row = np.concatenate(starts), np.concatenate(rows)
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    ends = np.append(start[1:], 0)
    last = np.append(row[1:] != row[:-1], True)
    ends[last] = offsets[row[last] + 1]
    return flat.list_array(flat.span_hashes(data, start, ends).view(np.int64), np.searchsorted(row, np.arange(len(offsets))))


def _measured(texts: pa.Array) -> pa.Array:
    parts = [pa.array([], _MEASURES)]
    for _, _, data, offsets in flat.pieces(texts):
        words, _, _, upto = flat.word_hashes(data, offsets, ~flat.SPACE, lower=False)
        n = np.diff(upto)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((words, row))
        new = np.ones(len(words), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][new], minlength=len(n))
        chars = _sums((data & 0xC0) != 0x80, offsets)
        capitals = _sums((data >= 65) & (data <= 90), offsets)
        tests = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * chars, _sums(_MARK[data], offsets) > 0]
        fails = sum(t.astype(np.int32) << i for i, t in enumerate(tests))
        parts.append(pa.StructArray.from_arrays([pa.array(fails.astype(np.int32)), pa.array(chars), _blocks(data, offsets)], fields=list(_MEASURES)))
    return pa.concat_arrays(parts)


def measures(text: Column) -> Column:
    """fails (bits of filters A to D), n_chars (code points) and blocks (hashes of successive blocks) of each whole text."""
    return F.arrow_udf(_measured, "struct<fails:int,n_chars:bigint,blocks:array<bigint>>")(F.coalesce(text, F.lit("")))


def _refined(rows: DataFrame) -> DataFrame:
    """rows without those that are alone in their class.

    Which classes are shared is counted with partial sums; the join back then has a shuffle of its own,
    whose tasks Spark splits where a class is hot.
    """
    shared = saved(rows.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "shared-classes")
    return cut(rows.join(shared, "class", "left_semi"))


def copies(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """doc_id, copy of the rows whose text a row with a smaller doc_id has.

    docs: doc_id, copy (a hash of text) and text; measured: doc_id, copy, n_chars, blocks. Classes of
    equal length are split by the hashes of successive blocks, and rows that are alone drop out each time.
    Whole texts of those left are compared, so that equal hashes decide nothing.
    """
    rows = measured.where("doc_id is not null").select("doc_id", "copy", "blocks", F.col("n_chars").alias("class")).distinct()
    rows = _refined(rows)
    depth = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    for i in range(depth):
        rows = _refined(rows.withColumn("class", F.xxhash64("class", F.get("blocks", F.lit(i)))))
    left = saved(rows.select("doc_id", "copy"), "like-texts")
    texts = docs.where("doc_id is not null").join(left.hint("merge"), ["doc_id", "copy"], "left_semi")  # alike at every size
    least = texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("doc_id"), F.min_by("copy", "doc_id").alias("copy"))
    return left.join(saved(least.select("doc_id", "copy"), "first-texts"), ["doc_id", "copy"], "left_anti")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits of the filters A to E that the row fails), good and toxic (0 or 1) per row of docs.

    Null and empty texts have no word (A fails) and equal each other. Rows without a doc_id copy none, are
    no one's original and have no label; rows that repeat a doc_id are each judged by their own text, and
    two of them are no copies of each other. Repeated labels count as good or toxic if one of them is.
    """
    grams.bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"))
    measured = saved(docs.select("doc_id", "copy", "part", measures(F.col("text")).alias("_m")).select("doc_id", "copy", "part", "_m.*"), "measures")
    again = copies(docs.select("doc_id", "copy", "text"), measured).withColumn("again", F.lit(16))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    rows = measured.drop("blocks", "n_chars").join(again, ["doc_id", "copy"], "left").join(told, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("doc_id", "part", (F.col("fails") + zero("again")).alias("mask"), zero("good").alias("good"), zero("toxic").alias("toxic"))


def _rules() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of every order and step: the order, the step's filter, and the masks that reach the step and that were removed before."""
    masks, orders, filters, reach = np.arange(1 << len(FILTERS)), [], [], []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for f in order:
            orders.append("".join(FILTERS[i] for i in order))
            filters.append(f)
            reach.append(masks & before == 0)
            before |= 1 << f
    filters = np.array(filters)
    return orders, filters, np.array(reach), masks[None, :] >> filters[:, None] & 1 == 1


def _interactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders, filters, reach, fails = _rules()
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders) // len(FILTERS))
    alone = np.arange(1 << len(FILTERS))[None, :] == 1 << filters[:, None]
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, good, toxic = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for c in counts:
                n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
            gone = reach & fails
            removed = gone @ n
            shapley = np.bincount(filters, removed)  # sums of counts, whole below 2**53
            columns = [(reach & ~fails) @ n, removed, (fails & ~reach) @ n, alone @ n, gone @ good, gone @ toxic, shapley.astype(np.int64)[filters]]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(orders)), pa.array(orders), pa.array(steps), *map(pa.array, columns)], _NAMES)


_NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _NAMES[3:])


def interactions(masks: DataFrame) -> DataFrame:
    """Per part, order of the filters and step, what the step keeps and removes; from counts of masks alone.

    masks: part, mask, good, toxic. A part has at most 32 counts, whatever its rows.
    """
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(_interactions, _SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five filters per source of docs; an empty table has no part and gives no rows."""
    return interactions(masks(docs, labels))
