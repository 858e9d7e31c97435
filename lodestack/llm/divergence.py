"""How far the sources of a language differ in their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import flat, grams
from lodestack.llm.shared import saved

#: Documents of a language that must hold a term, terms that are listed of a group, and what a share of 1 is.
MIN_DOCS, TOP, WHOLE = 10, 10, 1_000_000_000
#: Terms of a chunk and rows that make one at most; sources of a block. A task holds the vectors of two blocks over a chunk.
CHUNK, CHUNK_ROWS, BLOCK = 4096, 200_000, 64
#: Rows and bytes of counts that a task adds up before it sends them on.
HELD_ROWS, HELD_BYTES = 300_000, 16 << 20

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True  # after lower-casing: [^\x00-\x40\x5B-\x60\x7B-\x7F]
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n_docs", pa.int64()), ("n", pa.int64())])


def _of_piece(data: np.ndarray, offsets: np.ndarray, langs: pa.Array, sources: pa.Array) -> pa.Table:
    data = flat.LOWER[data]
    mask = _LETTER[data]
    starts, ends = flat.bounds(mask, offsets)
    cuts = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[mask])]).dictionary_encode()
    pairs = pa.StructArray.from_arrays([langs, sources], ["lang", "source"])
    names: dict = {}
    group = np.array([names.setdefault((p["lang"], p["source"]), len(names)) for p in pairs.to_pylist()], np.int64)
    size = max(1, len(terms.dictionary))
    doc = np.repeat(np.arange(len(langs)), np.diff(np.searchsorted(starts, offsets)))
    in_doc, times = np.unique(doc * size + terms.indices.to_numpy(), return_counts=True)
    keys, inverse = np.unique(group[in_doc // size] * size + in_doc % size, return_inverse=True)
    n_docs, n = np.bincount(inverse, minlength=len(keys)), np.bincount(inverse, times, len(keys))
    known = pa.table({"lang": [a for a, _ in names], "source": [b for _, b in names]}, pa.schema([_COUNTS.field(0), _COUNTS.field(1)]))
    own = known.take(pa.array(keys // size))
    rows = pa.Table.from_arrays([*own.columns, terms.dictionary.take(pa.array(keys % size)), pa.array(n_docs.astype(np.int64)), pa.array(n.astype(np.int64))], schema=_COUNTS)
    zero = pa.array(np.zeros(len(names), np.int64))
    return pa.concat_tables([rows, pa.Table.from_arrays([*known.columns, pa.array([""] * len(names)), zero, zero], schema=_COUNTS)])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each (lang, source, term); the term '' stands for the group itself, so that groups without terms are there too."""
    held, rows = [], 0
    for batch in batches:
        langs, sources = batch.column(0), batch.column(1)
        for low, high, data, offsets in flat.pieces(batch.column(2)):
            held.append(_of_piece(data, offsets, langs[low:high], sources[low:high]))
            rows += held[-1].num_rows
            if rows > 2 * HELD_ROWS:
                held = [pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n_docs", "sum"), ("n", "sum")]).rename_columns(_COUNTS.names)]
                rows = held[0].num_rows
                if rows > HELD_ROWS or held[0].nbytes > HELD_BYTES:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
    if held:
        yield from pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n_docs", "sum"), ("n", "sum")]).rename_columns(_COUNTS.names).to_batches(max_chunksize=50_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n_docs, n: documents of the group that hold the term, and how often they do."""
    grams.bounded_batches(docs.sparkSession)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    parts = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(_counted, "lang string, source string, term string, n_docs bigint, n bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


_CODED = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()), ("terms", pa.list_(pa.string())), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows starts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _code(lang: str, chunk: int, terms: np.ndarray, sources: np.ndarray, n_docs: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
    """The rows of one language's terms as ids in the sorted array of those that are kept: a row for the language, one for each source."""
    at = _runs(terms)
    kept = terms[at][np.add.reduceat(n_docs, at) >= MIN_DOCS]
    if not len(kept):
        return None
    ids = np.minimum(np.searchsorted(kept, terms), len(kept) - 1)
    hit = kept[ids] == terms
    ids, sources, n = ids[hit], sources[hit], n[hit]
    total = np.zeros(len(kept), np.int64)
    np.add.at(total, ids, n)
    order = np.lexsort((ids, np.unique(sources, return_inverse=True)[1]))
    ids, sources, n = ids[order].astype(np.int32), sources[order], n[order]
    first = _runs(sources)
    cuts = np.concatenate(([0, len(kept)], len(kept) + np.append(first[1:], len(ids)))).astype(np.int32)
    rows = len(first) + 1
    names = pa.array([None, *sources[first].tolist()], pa.string())
    own = pa.array([[t.decode() for t in kept], *[None] * len(first)], _CODED.field("terms").type)
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * rows), pa.array([chunk] * rows, pa.int64()), names, own,
        pa.ListArray.from_arrays(cuts, np.concatenate((np.arange(len(kept), dtype=np.int32), ids))), pa.ListArray.from_arrays(cuts, np.concatenate((total, n))),
    ], schema=_CODED)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (lang, term, source, n_docs, n, partition) as chunks of one language's successive terms."""
    held, seen = None, 0
    for batch in batches:
        new = [batch.column(0).to_numpy(False), np.array([t.encode() for t in batch.column(1).to_pylist()], object), *(batch.column(i).to_numpy(False) for i in (2, 3, 4, 5))]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        while True:
            coded, held, seen = _one_chunk(held, seen, False)
            if coded is None:
                break
            if coded:
                yield coded
    while held is not None and len(held[0]):
        coded, held, seen = _one_chunk(held, seen, True)
        if coded:
            yield coded


def _one_chunk(held: list, seen: int, last: bool):
    """The first chunk of the held rows if it is whole (False if none of its terms is kept, None if rows are missing), the other rows, and chunks so far."""
    lang, terms = held[0], held[1]
    starts = _runs(lang, terms)
    end = len(lang)
    other = np.flatnonzero(lang != lang[0])
    stop = int(other[0]) if len(other) else None
    inside = starts if stop is None else starts[starts <= stop]
    if stop is None and not last:
        inside = inside[:-1] if len(inside) > 1 else inside  # the last term may go on in the next batch
        if len(inside) <= CHUNK and (len(inside) < 2 or inside[-1] < CHUNK_ROWS):
            return None, held, seen
    full = inside[CHUNK] if len(inside) > CHUNK else None
    wide = inside[inside >= CHUNK_ROWS]
    cuts = [int(x) for x in (full, wide[0] if len(wide) else None, stop) if x is not None]
    cut = min(cuts) if cuts else end
    coded = _code(lang[0], (int(held[5][0]) << 33) + seen, terms[:cut], held[2][:cut], held[3][:cut], held[4][:cut])
    return coded or False, [x[cut:] for x in held], seen + 1


def code_terms(counts: DataFrame) -> DataFrame:
    """lang, chunk, source, terms, ids, counts: the kept terms of a language in chunks, as sorted arrays (source null), and each source's counts by id.

    Chunks are numbered in the order of their terms' UTF-8 bytes and ids within them too, so that (chunk,
    id) is the order of terms. All rows of a term come to one task, one for each source of its language.
    """
    dealt = counts.where("term <> ''").select("lang", "term", "source", "n_docs", "n").repartitionByRange("lang", "term")
    dealt = dealt.sortWithinPartitions("lang", "term", "source").withColumn("partition", F.spark_partition_id().cast("bigint"))
    return dealt.mapInArrow(_chunks, "lang string, chunk bigint, source string, terms array<string>, ids array<int>, counts array<bigint>")


def shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(WHOLE * (counts + 2) / (n + 2 v)), exact for n + 2 v below 9e15: long division, three digits at a time."""
    d = n + 2 * v
    whole, rest = np.divmod(counts + 2, d)
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // d
        rest %= d
    return whole + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _dense(members: list[dict], vectors: dict[int, dict], size: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each member over the chunk, and the shares they make."""
    counts = np.zeros((len(members), size), np.int64)
    for i, m in enumerate(members):
        found = vectors.get(m["no"])
        if found is not None:
            counts[i] = np.bincount(found["ids"], found["counts"], size)
    return counts, shares(counts, np.array([m["n"] for m in members], np.int64)[:, None], v) if v else counts


_FOUND = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("term", pa.string()), ("value", pa.int64())])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk and pair of blocks: sums of differences of each two sources, and the best terms of each source in the chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            vectors = {x["no"]: x for x in row["vectors"]}
            terms, v, size, same = row["terms"], row["v"], row["size"], row["lo"] == row["hi"]
            low_counts, low = _dense(row["low"], vectors, size, v)
            high = low if same else _dense(row["high"], vectors, size, v)[1]
            a, b, item, value = [], [], [], []
            for i, m in enumerate(row["low"]):
                rest = slice(i + 1 if same else 0, None)
                others = [x["no"] for x in row["high"]][rest]
                a += [m["no"]] * len(others)
                b += others
                value += differences(low[i], high[rest]).sum(1).tolist() if size else [0] * len(others)
            item += [None] * len(a)
            if same and size:
                total = shares(np.array(row["totals"], np.int64), np.int64(row["n"]), v)
                for i, m in enumerate(row["low"]):
                    hits = np.flatnonzero((low_counts[i] > 0) & (low[i] > total))
                    f = differences(low[i][hits], total[hits])
                    best = np.argsort(-f, kind="stable")[:TOP]  # ids keep the order of the terms, so ties do too
                    a += [m["no"]] * len(best)
                    b += [None] * len(best)
                    item += [terms[k] for k in hits[best]]
                    value += f[best].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(a)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(item, pa.string()), pa.array(value, pa.int64())], schema=_FOUND)


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, and the terms that mark it.

    docs: text, lang, source; null is ''. Each row is a document. Parts 'pair' (item: another source) and
    'term' (item: one of the TOP terms that are more frequent in the source than in its language). A
    language without kept terms has pairs of value 0; one with a single source has no pair; an empty table
    gives no rows.
    """
    counts = saved(term_counts(docs), "term-counts")
    coded = saved(code_terms(counts), "coded-terms")
    sums = coded.groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("n"), F.sum(F.size("terms")).alias("v"))
    sums = saved(sums, "term-sums")
    groups = counts.where("term = ''").select("lang", "source").join(sums.where("source is not null").select("lang", "source", "n"), ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("no"))
    groups = saved(groups.withColumn("block", F.expr(f"no div {BLOCK}")), "term-groups")
    langs = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    langs = langs.join(sums.where("source is null").select("lang", "n", "v"), "lang", "left").na.fill(0, ["n", "v"])
    members = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("no", "n"))).alias("members"))

    vector = F.struct("no", "ids", "counts")
    placed = coded.where("source is not null").join(groups.select("lang", "source", "no", "block"), ["lang", "source"]).join(langs.select("lang", "blocks"), "lang")
    placed = placed.select("lang", "chunk", "block", vector.alias("vector"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("lang", "chunk", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "vector")
    # every chunk, and one without terms so that languages without kept terms have their pairs, meets every two blocks
    heads = coded.where("source is null").select("lang", "chunk", "terms", F.col("counts").alias("totals"))
    heads = heads.unionByName(langs.select("lang", F.lit(-1).cast("bigint").alias("chunk")), allowMissingColumns=True).join(langs.select("lang", "blocks"), "lang")
    heads = heads.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("lo"))
    heads = heads.select("*", F.explode(F.sequence(F.col("lo"), F.col("blocks") - 1)).alias("hi"))
    alike = F.col("lo") == F.col("hi")  # only there terms are named
    heads = heads.select("lang", "chunk", "lo", "hi", F.coalesce(F.size("totals"), F.lit(0)).alias("size"), F.when(alike, F.col("terms")).alias("terms"), F.when(alike, F.col("totals")).alias("totals"))
    work = heads.unionByName(placed, allowMissingColumns=True).groupBy("lang", "chunk", "lo", "hi")
    work = work.agg(F.max("size").alias("size"), F.first("terms", True).alias("terms"), F.first("totals", True).alias("totals"), F.collect_list("vector").alias("vectors"))
    work = work.join(langs.select("lang", "n", "v"), "lang")
    for side, name in (("lo", "low"), ("hi", "high")):
        work = work.join(members.select("lang", F.col("block").alias(side), F.col("members").alias(name)), ["lang", side])
    found = work.mapInArrow(_compared, "lang string, a int, b int, term string, value bigint")
    found = saved(found.groupBy("lang", "a", "b", "term").agg(F.sum("value").alias("value")), "term-differences")

    def named(rows: DataFrame, no: str, name: str) -> DataFrame:
        return rows.join(groups.select("lang", F.col("no").alias(no), F.col("source").alias(name)), ["lang", no])

    pairs = found.where("b is not null").select("lang", F.inline(F.array(F.struct("a", "b", "value"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "value"))))
    pairs = named(named(pairs, "a", "source"), "b", "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = named(found.where("b is null"), "a", "source").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
