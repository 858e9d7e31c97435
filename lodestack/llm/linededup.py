"""Line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.shared import packed, saved

#: Code points of the shortest key that counts, and documents that must hold it.
MIN_CHARS, MIN_DOCS = 20, 3
#: Slices of a line's documents. A line that a third of all rows hold is then sorted in so many parts.
SLICES = 64

_WHITE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case, other letters as they are."""
    line = F.btrim(line, F.lit(_WHITE))
    other = F.regexp_replace(line, r"[\x00-\x7F]+", "")
    # lower() is much faster than translate(), and does the same where it changes nothing outside ASCII
    return F.when(F.lower(other) == other, F.lower(line)).otherwise(F.translate(line, _UPPER, _UPPER.lower()))


def _lines(docs: DataFrame) -> DataFrame:
    """Keys of the documents' long lines as two 64-bit hashes, with the place of each line."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("_copy"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "_line"))
    lines = lines.where(F.char_length(F.btrim("_line", F.lit(_WHITE))) >= MIN_CHARS).withColumn("_key", line_key(F.col("_line")))
    return lines.select(F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"), "doc_id", "_copy", "pos")


def repeated_keys(lines: DataFrame) -> DataFrame:
    """Hashes of lines (h1, h2, doc_id, pos) that at least MIN_DOCS documents hold: h1, h2, keeper (the largest doc_id).

    Hashes are range-partitioned with a slice of the documents, sorted by document and position, and
    streamed for the first line of each document; what the slices found is added up per hash, in the
    map tasks first.
    """
    lines = lines.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("tinyint"))
    order = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc("doc_id"), "pos")
    first = ~F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id"))
    firsts = lines.repartitionByRange("h1", "h2", "slice").withColumn("first", first).where("first")
    found = firsts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return found.where(F.col("n_docs") >= MIN_DOCS).select("h1", "h2", "keeper")


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, _copy, n_lines and keep of the documents that lose lines.

    flips is the bitmap of kept lines, compressed to the places where it changes: lines are kept
    before the first, dropped from there to the second, kept from there to the third, and so on.
    """
    lines = saved(_lines(docs), "line-hashes")  # texts are split once for the sample of the ranges, the ranges and the join
    repeated = saved(repeated_keys(lines), "repeated-lines")  # with a shuffle of its own Spark splits the tasks of hot lines
    lost = lines.join(repeated, ["h1", "h2"]).where("doc_id <> keeper")
    lost = lost.groupBy("doc_id", "_copy").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1))
    return lost.select("doc_id", "_copy", F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b + 1))).alias("flips"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with __lines (all), __kept (the text of the kept lines) and __n_dropped added."""
    docs = docs.withColumn("__copy", F.xxhash64("text"))
    bitmaps = saved(bitmaps.select(F.col("doc_id").alias("__doc"), F.col("_copy").alias("__of"), F.col("flips").alias("__flips")), "bitmaps")  # its size is known from here on
    docs = docs.join(bitmaps, (F.col("doc_id") == F.col("__doc")) & (F.col("__copy") == F.col("__of")), "left").drop("__doc", "__of", "__copy")
    docs = docs.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    none = F.array().cast("array<string>")
    before = lambda i: F.coalesce(F.get("__flips", i - 1), F.lit(0))
    runs = F.transform("__flips", lambda at, i: F.when(i % 2 == 0, F.slice("__lines", before(i) + 1, at - before(i))).otherwise(none))
    rest = F.slice("__lines", F.element_at("__flips", -1) + 1, F.size("__lines"))
    docs = docs.withColumn("__kept", F.when(F.col("__flips").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.concat(F.flatten(runs), rest), "\n")))
    dropped = F.aggregate(F.transform("__flips", lambda at, i: F.when(i % 2 == 0, -at).otherwise(at)), F.lit(0), lambda a, n: a + n)
    return docs.withColumn("__n_dropped", F.coalesce(dropped, F.lit(0))).drop("__flips")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of text, all other columns as they are.

    A document keeps its row even if it keeps no line; null text stays null. Rows without a doc_id
    take no part and keep all lines. Rows that repeat a doc_id are one document to the counts, and
    each loses its own lines.
    """
    own = packed(docs, "doc_id", "text")
    out = apply_bitmaps(own, keep_bitmaps(own))
    new = {"text": F.when(F.col("text").isNotNull(), F.col("__kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(new["text"]).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def line_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256. Null or empty text is one empty line."""
    docs = docs.select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", F.size("__lines").cast("bigint").alias("n_lines"), F.col("__n_dropped").cast("bigint").alias("n_dropped"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))
