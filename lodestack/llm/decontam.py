"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import flat, grams
from lodestack.llm.shared import packed, saved

#: Words of the shortest tile.
MIN_MATCH = 5
#: Part of an item's words that the tiles in one document must cover.
THRESHOLD = 0.6
#: A gram that more items hold brings no document to its items, as far as an item's other grams are enough to find it.
COMMON = 16

TILES = "array<struct<item_start:int,doc_start:int,n_words:int>>"
_ARROW = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))


class _Side:
    """Words of one text as numbers (negative: nothing matches), with rolling hashes and what is not yet marked."""

    def __init__(self, words: np.ndarray):
        self.words, self.free = words, words >= 0
        power, self.back = flat._powers(len(words) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat.mix(words.astype(np.uint64)) * power[:-1])))

    def runs(self) -> np.ndarray:
        """Unmarked words from each place on."""
        stops = np.append(np.flatnonzero(~self.free), len(self.free))
        return stops[np.searchsorted(stops, np.arange(len(self.free)))] - np.arange(len(self.free))

    def windows(self, runs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of n unmarked words, and the hashes of those words."""
        at = np.flatnonzero(runs >= n)
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def greedy_tiles(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (start in the item, start in the document, words) of two arrays of numbers of words; negative ones match nothing.

    The longest match of unmarked words is marked first (ties: first in the item, then in the
    document), until none has k words. Lengths are searched by halving with running hashes, so
    that the work does not grow with the number of places where repeated words agree.
    """
    a, b, tiles, most = _Side(item), _Side(doc), [], len(item)
    while True:
        run_a, run_b = a.runs(), b.runs()
        high = min(most, int(run_a.max(initial=0)), int(run_b.max(initial=0)))

        def meet(n: int, run_a=run_a, run_b=run_b) -> bool:
            return bool(np.isin(a.windows(run_a, n)[1], b.windows(run_b, n)[1]).any())

        if high < k or not meet(k):
            return sorted(tiles)
        low = k
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if meet(mid) else (low, mid - 1)
        at_a, hash_a = a.windows(run_a, low)
        at_b, hash_b = b.windows(run_b, low)
        order = np.argsort(hash_b, kind="stable")
        at_b, hash_b = at_b[order], hash_b[order]
        first, last = np.searchsorted(hash_b, hash_a), np.searchsorted(hash_b, hash_a, "right")
        gone: dict[int, int] = {}  # places of each hash that have been marked since
        for i, x, y in zip(at_a.tolist(), first.tolist(), last.tolist()):
            if x == y or not a.free[i : i + low].all():
                continue
            j = gone.get(x, x)
            while j < y and not b.free[at_b[j] : at_b[j] + low].all():
                j += 1
            gone[x] = j
            while j < y:
                d = int(at_b[j])
                if b.free[d : d + low].all() and (a.words[i : i + low] == b.words[d : d + low]).all():
                    a.free[i : i + low] = b.free[d : d + low] = False
                    tiles.append((i, d, low))
                    break
                j += 1
        most = low - 1


class _Words:
    """The words of a text: their bytes in lower case, and a hash of each."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        self.data = flat.LOWER[data]
        self.hashes, self.starts, self.ends, _ = flat.word_hashes(data, np.array([0, len(data)]))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def tiles_of(item: _Words, doc: _Words, k: int) -> list[tuple[int, int, int]]:
    """greedy_tiles() of two texts; words are equal if their bytes are."""
    known: dict[bytes, int] = {}
    own = np.array([known.setdefault(item.word(i), len(known)) for i in range(len(item.hashes))], np.int64)
    some, first = np.unique(item.hashes, return_index=True)
    if not len(some):
        return []
    spot = np.minimum(np.searchsorted(some, doc.hashes), len(some) - 1)
    met = np.flatnonzero(some[spot] == doc.hashes)
    words = np.full(len(doc.hashes), -1, np.int64)
    like = first[spot[met]]
    words[met] = own[like]
    size = doc.ends[met] - doc.starts[met]
    other = item.ends[like] - item.starts[like] != size
    same = np.flatnonzero(~other)
    unlike = doc.data[flat.ranges(doc.starts[met[same]], size[same])] != item.data[flat.ranges(item.starts[like[same]], size[same])]
    other[np.repeat(same, size[same])[unlike]] = True
    for j in met[other].tolist():  # words of one hash
        words[j] = known.get(doc.word(j), -1)
    # only runs of k known words matter; the others shrink to one word that matches nothing
    start, end = flat.bounds(words >= 0, np.array([0, len(words)]))
    long = end - start >= k
    start, end = start[long], end[long]
    at = flat.ranges(start, end - start + 1)
    short = np.append(words, -1)[at]
    return [(i, int(at[d]), n) for i, d, n in greedy_tiles(own, short, k)]


def _tiles(k: int):
    def make(texts: pa.Array, items: pa.Array) -> pa.Array:
        rows, last, doc = [], None, None
        for text, item in zip(texts, items):
            raw = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
            if last is None or not raw.equals(last):
                last, doc = raw, _Words(raw.to_pybytes())
            rows.append([{"item_start": i, "doc_start": d, "n_words": n} for i, d, n in tiles_of(_Words((item.as_py() or "").encode()), doc, k)])
        return pa.array(rows, _ARROW)

    return F.arrow_udf(make, TILES)


def _counted(k: int):
    """The number of a text's words, and its different grams with the number of their places."""

    def make(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            words = _Words((text or "").encode()).hashes
            found, places = np.unique(flat.gram_hashes(words, k).view(np.int64), return_counts=True)
            rows.append({"n": len(words), "g": [{"h": h, "places": n} for h, n in zip(found.tolist(), places.tolist())]})
        return pa.array(rows, pa.struct([("n", pa.int32()), ("g", pa.list_(pa.struct([("h", pa.int64()), ("places", pa.int32())])))]))

    return F.arrow_udf(make, "struct<n:int,g:array<struct<h:bigint,places:int>>>")


def _index(items: DataFrame, k: int, threshold: float) -> DataFrame:
    """(h, item_id, __item, n_words, places, need): a document holds enough of an item only if its places of the grams here add up to need.

    Tiles that cover c words have c / k places or more. Of these an item can do without one less than
    it must have: so many places of its most common grams are left out, if more than COMMON items hold them.
    """
    rows = items.select("item_id", "__item", _counted(k)("text").alias("_g")).select("item_id", "__item", F.col("_g.n").alias("n_words"), F.inline("_g.g"))
    rows = rows.join(rows.groupBy("h").agg(F.count("*").alias("_held")), "h")
    least = F.greatest(F.lit(1), F.ceil(F.col("n_words") * threshold / k - 1e-9))
    order = Window.partitionBy("item_id", "__item").orderBy(F.desc("_held"), "h")
    upto = F.sum("places").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spare = (F.col("_held") > COMMON) & (upto < least)
    left_out = F.sum(F.when(F.col("_spare"), F.col("places")).otherwise(0)).over(Window.partitionBy("item_id", "__item"))
    rows = rows.withColumns({"_least": least, "_spare": spare}).withColumn("need", F.col("_least") - left_out)
    return rows.where(~F.col("_spare")).select("h", "item_id", "__item", "n_words", "places", "need")


def benchmark_tiles(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, keys=("doc_id",)) -> DataFrame:
    """One row per document and item whose tiles cover enough of it: keys, item_id, n_words, covered, coverage, tiles.

    docs needs keys and text, benchmark item_id and text; other columns are not read. Words are
    [0-9a-z] and all outside ASCII, with A-Z lower-cased. Null and empty texts match nothing, nor do
    items under min_match words, which have no tile. Rows that repeat keys and text count once; a
    null key stays null. Items are told apart by item_id and text: two texts of one item_id are two
    items, with a row each; a null item_id is one like any other. Reordered passages count, as tiles may
    stand anywhere in the document. Empty tables give no rows. Texts of any length and repetition are
    tiled whole.
    """
    own = docs.select(*keys, F.xxhash64("text").alias("__copy"), "text")
    return _tiles_in(own, benchmark, min_match, threshold, [*keys, "__copy"]).drop("__copy")


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _tiles_in(docs: DataFrame, benchmark: DataFrame, k: int, threshold: float, keys: list[str]) -> DataFrame:
    """Documents meet the items whose grams they share; only such pairs bring their texts together."""
    grams.bounded_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").where("text is not null").distinct().withColumn("__item", F.xxhash64("text"))
    index = saved(_index(items, k, threshold), "tiling-index")
    few = index.count() <= grams.BROADCAST_ROWS
    passes = None if few else grams.hash_filter(index.select("h"))  # of the documents' grams only those that pass are shuffled
    met = docs.select(*keys, F.explode(grams.distinct_grams(F.col("text"), k, passes)).alias("h")).join(F.broadcast(index) if few else index.hint("merge"), "h")
    pairs = met.groupBy(*keys, "item_id", "__item").agg(F.sum("places").alias("_seen"), F.max("need").alias("_need"), F.max("n_words").alias("n_words")).where("_seen >= _need")
    pairs = saved(pairs.select(*(F.col(c).alias(f"__of_{c}") for c in keys), "item_id", "__item", "n_words"), "tiling-pairs")
    texts = items.select(F.col("item_id").alias("__id"), F.col("__item").alias("__as"), F.col("text").alias("__said"))
    here, said = _same(keys, [f"__of_{c}" for c in keys]), _same(["item_id", "__item"], ["__id", "__as"])
    if few and (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= grams.BROADCAST_BYTES:
        tiled = docs.join(F.broadcast(pairs) if pairs.count() <= grams.BROADCAST_ROWS else pairs.hint("merge"), here).join(F.broadcast(texts), said)
    else:
        tiled = docs.join(pairs.join(texts.hint("merge"), said).hint("merge"), here)
    tiled = tiled.select(*keys, "item_id", "__item", "n_words", _tiles(k)("text", "__said").alias("tiles"))
    covered = F.aggregate("tiles", F.lit(0), lambda n, t: n + t["n_words"])
    tiled = tiled.select(*keys, "item_id", "__item", "n_words", covered.alias("covered"), "tiles").withColumn("coverage", F.col("covered") / F.col("n_words"))
    return tiled.where(F.col("coverage") >= threshold).dropDuplicates([*keys, "item_id", "__item"]).drop("__item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that hold enough of an item; all columns stay. See benchmark_tiles for odd inputs."""
    keyed = packed(docs, "doc_id", "text", F.xxhash64("text").alias("__copy"))
    leaks = _tiles_in(keyed.drop("row"), benchmark, min_match, threshold, ["doc_id", "__copy"])
    leaks = saved(leaks.select(F.col("doc_id").alias("__leak"), F.col("__copy").alias("__leak_copy")).distinct(), "leaks")
    return keyed.join(leaks, _same(["doc_id", "__copy"], ["__leak", "__leak_copy"]), "left_anti").select("row.*")
