"""Repeated passages by relative Lempel-Ziv parsing of documents against indexed reference blocks.

A passage repeats if a run of `words` words also starts in a document with a smaller doc_id.

* Windows of so many words are grouped into fragments: successive windows whose least k-gram hash, the anchor, is
  the same. Equal windows have equal anchors wherever they stand, so a window needs only be looked for among those
  of its anchor. There is about one fragment for five words.
* Fragments are dealt by their anchor. Each task holds a block of the reference, sorted by anchor, fragment and
  document: the first document that holds a fragment is its reference, and later ones point there.
* Each document is then parsed greedily: a factor goes on as long as the next fragment points to the next place of
  the same reference. Factors are long enough to be duplicates as they consist of whole windows.
* Fragments at the ends of factors hold words of both sides and are mostly no whole copy. Where another document
  has their anchor, their windows are looked up one by one, in all documents' fragments of that kind.

A window that lies in a factor has an earlier copy, so the first document with a window never has it in one: the
look-up at the ends misses none. No pairs are made, a key's rows are read in order and none are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import flat, grams
from lodestack.llm.shared import packed, saved

#: Words of the shortest passage, and of an anchor.
WORDS, ANCHOR = 13, 5
#: An anchor with one of so many fragments is dealt to many tasks.
HEAVY = 1024

_WORD = ~flat.SPACE
_FRAGMENT = [("h", pa.int64()), ("f", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int32()), ("at", pa.int32()), ("n", pa.int32())]
_REFERENCE = [("ref_doc", pa.int64()), ("ref_at", pa.int32())]
_WINDOW = [("h", pa.int64()), ("w", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int32()), ("at", pa.list_(pa.int32()))]


def _ddl(fields: list) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{c} {names[t]}" for c, t in fields)


class _Spans:
    """Hashes of runs of words by prefix sums."""

    def __init__(self, words: np.ndarray):
        power, self.inverse = flat._powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return flat.mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def _fragments(words: np.ndarray, upto: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, hash, first window's word in the row, windows) of each fragment of the rows' words, in order."""
    n = np.maximum(np.diff(upto) - size + 1, 0)
    windows, row = flat.ranges(upto[:-1], n), np.repeat(np.arange(len(n)), n)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    k = min(ANCHOR, size)
    least = found = flat.gram_hashes(words, k)
    for i in range(1, size - k + 1):
        least = np.minimum(least[: len(found) - i], found[i:])
    anchor = least[windows].view(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    start, end = windows[first], windows[last]
    return row[first], anchor[first], _Spans(words).hashes(start, end + size), start - upto[row[first]], end - start + 1


def _pieces(batch: pa.RecordBatch):
    """doc_id, copy and words of the rows (doc_id, copy, text), a piece at a time."""
    ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for low, high, data, offsets in flat.pieces(batch.column(2)):
        words, starts, ends, upto = flat.word_hashes(data, offsets, _WORD, lower=False)
        yield low, high, ids[low:high], copies[low:high], words, upto, (data, starts, ends)


def _earlier(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows by keys a, b, then document and place; and of each row in it the place in it of its keys' first row."""
    order = np.lexsort((at, doc, b, a))
    a, b = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _anchored(size: int, heavy: np.ndarray):
    """Fragments of texts. Those with an earlier copy in the same batch point there at once, so that a key sends one document a batch on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, ids, copies, words, upto, _ in _pieces(batch):
                row, anchor, hashed, at, n = _fragments(words, upto, size)
                parts.append((anchor, hashed, ids[row], copies[row].astype(np.int32), at.astype(np.int32), n.astype(np.int32)))
            if not parts:
                continue
            h, f, doc, copy, at, n = (np.concatenate(x) for x in zip(*parts))
            order, first = _earlier(h, f, doc, at)
            h, f, doc, copy, at, n = (x[order] for x in (h, f, doc, copy, at, n))
            none = doc[first] == doc
            columns = [*map(pa.array, (h, f, doc, copy, at, n)), pa.array(doc[first], mask=none), pa.array(at[first], mask=none), pa.array(np.isin(h, heavy))]
            out = pa.RecordBatch.from_arrays(columns, schema=pa.schema([*_FRAGMENT, *_REFERENCE, ("heavy", pa.bool_())]))
            for low in range(0, out.num_rows, 100_000):
                yield out.slice(low, 100_000)

    return run


def _frequent(size: int):
    """Anchors with at least one of 2 * HEAVY of a batch's fragments, with their counts; in the row without an anchor, all fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fragments(words, upto, size)[1] for _, _, _, _, words, upto, _ in _pieces(batch)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                hot = n * 2 * HEAVY >= n.sum()
                yield pa.RecordBatch.from_arrays([pa.array([None, *h[hot].tolist()], pa.int64()), pa.array([int(n.sum()), *n[hot].tolist()], pa.int64())], ["h", "n"])

    return run


def heavy_anchors(texts: DataFrame, size: int = WORDS) -> list[int]:
    """Anchors with at least one of HEAVY of all fragments, so HEAVY of them at most; each with one of HEAVY / 2 is among them."""
    counts = texts.mapInArrow(_frequent(size), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), F.col("h").asc_nulls_first()).limit(HEAVY + 1).collect()
    total = next((r.n for r in rows if r.h is None), 0)
    return [r.h for r in rows if r.h is not None and r.n * HEAVY >= total]


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of fragments sorted by anchor, fragment, document and place: those with an earlier document, which they point to, and those whose anchor other fragments have too.

    What is carried from batch to batch: rows of the last anchor's only fragment so far, which wait for
    another one; or one row of an earlier fragment and the first of the last.
    """
    carried = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(False) for i in range(6)]
        ref, ref_at, heavy = batch.column(6), batch.column(7), batch.column(8).to_numpy(False)
        done = ref.is_valid().to_numpy(False)
        ready = pa.RecordBatch.from_arrays([*(pa.array(x[done]) for x in rows), ref.filter(pa.array(done)), ref_at.filter(pa.array(done))], schema=_FOUND)
        if ready.num_rows:
            yield ready
        rows, heavy = [x[~done] for x in rows], heavy[~done]
        told = np.zeros(len(heavy), bool)  # carried rows that are out already
        if carried is not None:
            rows, heavy, told = [np.concatenate(x) for x in zip(carried[0], rows)], np.concatenate((carried[1], heavy)), np.concatenate((carried[2], told))
        if not len(heavy):
            continue
        h, f, doc, copy, at, n = rows
        new_h, new_f = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_f[1:] = new_h[1:] | (f[1:] != f[:-1])
        first = np.maximum.accumulate(np.where(new_f, np.arange(len(h)), 0))
        start = np.flatnonzero(new_h)
        many = np.repeat(np.add.reduceat(new_f, start, dtype=np.int64) > 1, np.diff(np.append(start, len(h)))) | heavy
        copied = doc[first] < doc
        last = np.arange(len(h)) >= start[-1]
        wait = last & ~many & ~copied
        out = ~told & (copied | many) & ~wait
        if out.any():
            points = first[out]
            none = ~copied[out]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[out]) for x in rows), pa.array(doc[points], mask=none), pa.array(at[points], mask=none)], schema=_FOUND)
        keep = np.flatnonzero(wait)
        if not len(keep):
            keep = np.unique([start[-1], first[-1]])
        carried = [x[keep] for x in rows], heavy[keep], ~wait[keep]


_FOUND = pa.schema([*_FRAGMENT, *_REFERENCE])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, copy and text of the rows that take part; copy tells rows that repeat a doc_id apart."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), _copy(), "text")


def _copy() -> Column:
    return F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("copy")


def matched_fragments(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """h, f, doc_id, copy, at, n, ref_doc, ref_at: fragments that an earlier document has (it is named), and those whose anchor another fragment has."""
    texts = _texts(docs)
    heavy = np.array(heavy_anchors(texts, size), np.int64)
    rows = texts.mapInArrow(_anchored(size, heavy), _ddl([*_FRAGMENT, *_REFERENCE, ("heavy", pa.bool_())]))
    dealt = rows.repartition(F.when(F.col("ref_doc").isNotNull(), F.xxhash64("doc_id")).when(F.col("heavy"), F.xxhash64("h", "f")).otherwise(F.col("h")))
    return dealt.sortWithinPartitions("h", "f", "doc_id", "at").mapInArrow(_resolved, _ddl([*_FRAGMENT, *_REFERENCE]))


def _edge_windows(size: int):
    """The windows of the fragments that no earlier document has whole, in rows (doc_id, copy, text, edges), each once a document; ones with an earlier copy in the batch point at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, parts = batch.column(3).to_pylist(), []
            for low, high, ids, copies, words, upto, _ in _pieces(batch):
                spans = _Spans(words)
                for i in range(high - low):
                    own = [e for e in edges[low + i] if e["at"] + e["n"] + size - 1 <= upto[i + 1] - upto[i]]
                    if own:
                        n = np.array([e["n"] for e in own])
                        start = flat.ranges(np.array([e["at"] for e in own]), n)
                        anchors = np.repeat(np.array([e["h"] for e in own], np.int64), n)
                        parts.append((anchors, spans.hashes(start + upto[i], start + upto[i] + size), np.full(len(start), ids[i]), np.full(len(start), copies[i], np.int32), start.astype(np.int32)))
            if not parts:
                continue
            h, w, doc, copy, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, copy, doc, w, h))
            h, w, doc, copy, at = (x[order] for x in (h, w, doc, copy, at))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
            own = new.copy()
            own[1:] |= (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])
            group = np.flatnonzero(own)
            places = pa.ListArray.from_arrays(pa.array(np.append(group, len(h)).astype(np.int32)), pa.array(at))
            least = doc[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))[group]]
            columns = [pa.array(h[group]), pa.array(w[group]), pa.array(doc[group]), pa.array(copy[group]), places, pa.array(least < doc[group])]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*_WINDOW, ("copied", pa.bool_())]))

    return run


def _resolved_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by anchor, hash and document, those that an earlier document has."""
    last = None
    for batch in batches:
        h, w, doc, done = (batch.column(i).to_numpy(False) for i in (0, 1, 2, 5))
        open_ = np.flatnonzero(~done)
        copied = done.copy()
        if len(open_):
            a, b, d = h[open_], w[open_], doc[open_]
            new = np.ones(len(open_), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            least = d[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
            if last is not None:
                least[(a == last[0]) & (b == last[1])] = last[2]
            copied[open_] = least < d
            last = a[-1], b[-1], least[-1]
        keep = pa.array(copied)
        out = pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(5)], schema=pa.schema(_WINDOW))
        if out.num_rows:
            yield out


_FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_PARSED = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("factors", pa.list_(_FACTOR)), ("spans", pa.list_(_SPAN)), ("kept", pa.string())])
_PARSED_DDL = "struct<n_words:bigint,n_removed:bigint,factors:array<struct<start:int,length:int,ref_doc:bigint,ref_start:int>>,spans:array<struct<start:int,end:int>>,kept:string>"


def parse(fragments: list[dict], size: int = WORDS) -> list[dict]:
    """Factors of a document, greedily from its start: each goes on while the next fragment points to the next place of the same reference."""
    out = []
    for x in sorted(fragments, key=lambda x: (x["at"], -x["n"])):
        end, shift = x["at"] + x["n"] + size - 1, x["ref_at"] - x["at"]
        if out and out[-1]["ref_doc"] == x["ref_doc"] and out[-1]["ref_start"] - out[-1]["start"] == shift and x["at"] <= out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], end - out[-1]["start"])
        else:
            out.append({"start": x["at"], "length": end - x["at"], "ref_doc": x["ref_doc"], "ref_start": x["ref_at"]})
    return out


def _kept_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    data = np.append(data, np.uint8(32))
    size = (ends - starts + 1)[keep]
    out = data[flat.ranges(starts[keep], size)]
    stops = np.cumsum(size)
    out[stops - 1] = 32
    kept = np.concatenate(([0], np.cumsum(keep)))[upto]  # kept words before each row
    bytes_ = np.concatenate(([0], stops))[kept]
    full = np.flatnonzero(np.diff(kept))
    left = np.ones(len(out), bool)
    left[bytes_[1:][full] - 1] = False
    cuts = bytes_ - np.concatenate(([0], np.cumsum(np.diff(kept) > 0)))
    return pa.Array.from_buffers(pa.string(), len(upto) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out[left])])


def _cleaned(size: int):
    def run(text: pa.Array, fragments: pa.Array, windows: pa.Array) -> pa.Array:
        parts = [pa.array([], _PARSED)]
        told, seen = fragments.is_valid().to_numpy(False), windows.is_valid().to_numpy(False)
        for low, high, data, offsets in flat.pieces(text):
            words, starts, ends, upto = flat.word_hashes(data, offsets, _WORD, lower=False)
            keep, n = np.ones(len(words), bool), np.diff(upto)
            factors, spans = [[]] * (high - low), [[]] * (high - low)
            hashes = _Spans(words).hashes if (told | seen)[low:high].any() else None
            for i in np.flatnonzero((told | seen)[low:high]):
                # what came by doc_id is held against the row's own words, as rows may repeat a doc_id
                own = [x for x in fragments[int(low + i)].as_py() or [] if x["ref_doc"] is not None and x["at"] + x["n"] + size - 1 <= n[i]]
                at = np.array([x["at"] for x in own], np.int64) + upto[i]
                same = hashes(at, at + np.array([x["n"] + size - 1 for x in own], np.int64)) == np.array([x["f"] for x in own], np.int64)
                factors[i] = parse([x for x, ok in zip(own, same) if ok], size)
                found = [(t + upto[i], x["w"]) for x in windows[int(low + i)].as_py() or [] for t in x["at"] if t + size <= n[i]]
                at = np.array([t for t, _ in found], np.int64)
                at = at[hashes(at, at + size) == np.array([w for _, w in found], np.int64)]
                cover = np.zeros(n[i] + 1, np.int64)
                np.add.at(cover, np.concatenate((at - upto[i], np.array([x["start"] for x in factors[i]], np.int64))), 1)
                np.add.at(cover, np.concatenate((at - upto[i] + size, np.array([x["start"] + x["length"] for x in factors[i]], np.int64))), -1)
                gone = np.cumsum(cover[:-1]) > 0
                keep[upto[i] : upto[i + 1]] = ~gone
                a, b = flat.bounds(gone, np.array([0, len(gone)]))
                spans[i] = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]
            removed = n - np.diff(np.concatenate(([0], np.cumsum(keep)))[upto])
            columns = [pa.array(n), pa.array(removed), pa.array(factors, pa.list_(_FACTOR)), pa.array(spans, pa.list_(_SPAN)), _kept_text(data, starts, ends, upto, keep)]
            parts.append(pa.StructArray.from_arrays(columns, fields=list(_PARSED)))
        return pa.concat_arrays(parts)

    return run


def cleaned(text: Column, fragments: Column, windows: Column, size: int = WORDS) -> Column:
    return F.arrow_udf(_cleaned(size), _PARSED_DDL)(F.coalesce(text, F.lit("")), fragments, windows)


def remove_repeats(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, row (all of its columns), n_words, n_removed, factors, spans and kept.

    factors: start and length in words, and the document and word that each copies. spans: the removed
    words, from start to before end. kept: the other words, joined by one space. Words are what stands
    between white space. Null and empty texts have no words, texts under `size` words lose none; nor do rows
    without a doc_id, which no other row copies either. Rows that repeat a doc_id each lose their own words, and
    are no copies of each other. doc_id must be an integer; empty tables give no rows. Words, anchors and windows are
    told apart by hashes (two of 64 bits for a window, and the places of factors are held against the row's own words).
    """
    grams.bounded_batches(docs.sparkSession)
    found = saved(matched_fragments(docs, size), "fragments")
    lists = found.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("f", "at", "n", "ref_doc", "ref_at")).alias("fragments"), F.collect_list(F.when(F.col("ref_doc").isNull(), F.struct("h", "at", "n"))).alias("edges"))
    own = packed(docs, F.col("doc_id").cast("bigint").alias("doc_id"), _copy(), "text")
    keyed = own.where("doc_id is not null")  # the same shuffle of texts serves both joins
    edges = keyed.join(lists.where(F.size("edges") > 0).select("doc_id", "copy", "edges"), ["doc_id", "copy"])
    windows = edges.select("doc_id", "copy", "text", "edges").mapInArrow(_edge_windows(size), _ddl([*_WINDOW, ("copied", pa.bool_())]))
    dealt = windows.repartition(F.when(F.col("copied"), F.xxhash64("doc_id")).otherwise(F.xxhash64("h", "w")))
    again = dealt.sortWithinPartitions("h", "w", "doc_id").mapInArrow(_resolved_windows, _ddl(_WINDOW))
    again = again.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("w", "at")).alias("windows"))
    joined = keyed.join(lists.drop("edges").join(again, ["doc_id", "copy"], "full"), ["doc_id", "copy"], "left")
    joined = joined.unionByName(own.where("doc_id is null"), allowMissingColumns=True)
    return joined.select("doc_id", "row", cleaned(F.col("text"), F.col("fragments"), F.col("windows"), size).alias("_p")).select("doc_id", "row", "_p.*")
