"""Which items a request takes: patterns, mentions, promotions and the two rankings."""

from __future__ import annotations

import fnmatch
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import paths
from lodestack.functions.text import PATH_PATTERN, normal_pattern

#: Items that just missed the cut, as a report names them.
DROPPED = 8
# Words of a text that reads what contracts define.
CONSUMES = "handoff_id reply_template manifest preview confirm status paths artifacts schema".split()
CODE_LIKE = ["workflow", "selection_logic", "code_snippet"]


def pattern_matches(path: Column, pattern: str) -> Column:
    """Whether a path meets one pattern: a glob (* crosses /), a path, or a folder above it."""
    normal = pattern.strip().replace("\\", "/")
    while normal.startswith("./"):
        normal = normal[2:]
    if not normal:
        return F.lit(False)
    if any(c in normal for c in "*?["):
        return path.rlike("^" + fnmatch.translate(normal).replace(r"\Z", "$").replace(r"\z", "$"))
    return (path == normal) | F.startswith(path, F.lit(normal.rstrip("/") + "/"))


def resolve_patterns(items: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, ord, path) of every item that a pattern meets, patterns in order; a pattern without one has a null path.

    The few patterns become predicates of one scan.
    """
    spark = items.sparkSession
    known = spark.createDataFrame([(p, i) for i, p in enumerate(patterns)], "pattern string, ord int")
    met = F.array(*(F.when(pattern_matches(F.col("path"), p), F.lit(i)) for i, p in enumerate(patterns))) if patterns else F.array().cast("array<int>")
    hits = items.select("path", F.explode(F.array_compact(met)).alias("ord"))
    return known.join(hits, "ord", "left").select("pattern", "ord", "path")


def without(rows: DataFrame, banned: DataFrame, key: str = "path") -> DataFrame:
    """The different keys of rows that are not among those of banned; null keys are none."""
    return rows.where(F.col(key).isNotNull()).select(key).distinct().join(banned.select(key), key, "left_anti")


def include_minus_exclude(items: DataFrame, include: list[str], exclude: list[str]) -> tuple[DataFrame, DataFrame]:
    """Included paths (path, ord: place in the order of patterns, then paths) and warnings (kind, what)."""
    wanted, banned = resolve_patterns(items, include), resolve_patterns(items, exclude)
    out = banned.where("path is not null").select("path").distinct()
    kept = wanted.where("path is not null").groupBy("path").agg(F.min("ord").alias("ord")).join(out, "path", "left_anti")
    notes = wanted.where("path is null").select(F.lit("include_without_match").alias("kind"), F.col("pattern").alias("what"))
    notes = notes.union(banned.where("path is null").select(F.lit("exclude_without_match"), "pattern"))
    notes = notes.union(wanted.join(out, "path", "left_semi").select(F.lit("included_and_excluded"), "path"))
    return kept, notes


def mentioned_paths(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(path, ord) of items that texts (ord, text) name; ord, a struct, sorts by the first mention.

    A token that is an item's path names it; the second mention of such a path, and any other token,
    names all items of its last part. Only the first mention of a path and of a last part meets the items.
    """
    tokens = texts.select(F.col("ord").alias("_text"), F.posexplode(F.regexp_extract_all("text", F.lit(PATH_PATTERN), F.lit(0))).alias("_at", "_raw"))
    tokens = tokens.select("_text", "_at", normal_pattern("_raw").alias("token")).withColumn("base", paths.name("token"))
    known = items.select("path", paths.name("path").alias("base"))
    place = F.struct("_text", "_at")
    exact = tokens.groupBy("token").agg(F.min(place).alias("_place")).join(known.select(F.col("path").alias("token")), "token", "left_semi")
    exact = exact.select(F.col("token").alias("path"), "_place._text", "_place._at", F.lit("").alias("_order"))
    # a path that only a later mention of its name has brought in is also a hit by then; the first place counts either way
    loose = tokens.join(exact.select(F.col("path").alias("token"), "_text", "_at"), ["token", "_text", "_at"], "left_anti")
    loose = loose.groupBy("base").agg(F.min(place).alias("_place")).join(known, "base").select("path", "_place._text", "_place._at", F.col("path").alias("_order"))
    return exact.unionByName(loose).groupBy("path").agg(F.min(F.struct("_text", "_at", "_order")).alias("ord"))


def consumes_contract(content: Column | str) -> Column:
    return reads_contract(F.lower(content))


def reads_contract(low: Column | str) -> Column:
    """consumes_contract() of a text in lower case."""
    low = F.col(low) if isinstance(low, str) else low
    return functools.reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in CONSUMES))


def promotions(preliminary: DataFrame, items: DataFrame, imports: DataFrame, reads: Column | None = None) -> DataFrame:
    """(path, reason) of items that a first selection promotes.

    preliminary: path, artifact_type, ord; items: path, artifact_type, content; imports: src, dst. What a
    chosen workflow imports comes first (of several the earliest chosen names it); then, if a contract is
    chosen, all code that reads what contracts define. reads: of items, whether they do, where that is known without content.
    """
    flows = preliminary.where("artifact_type = 'workflow'").select(F.col("path").alias("src"), "ord")
    direct = imports.join(F.broadcast(flows), "src").where("src <> dst").groupBy(F.col("dst").alias("path")).agg(F.min(F.struct("ord", "src")).alias("_by"))
    direct = direct.select("path", F.lit(0).alias("_rank"), F.concat(F.lit("A direct dependency of "), "_by.src", F.lit(".")).alias("reason"))
    contracts = preliminary.where("artifact_type = 'contract'").limit(1).select(F.lit(1).alias("_any"))
    readers = items.where(F.col("artifact_type").isin(CODE_LIKE)).where(consumes_contract("content") if reads is None else reads).select("path").crossJoin(F.broadcast(contracts))
    readers = readers.select("path", F.lit(1).alias("_rank"), F.lit("It reads what contracts define.").alias("reason"))
    return direct.unionByName(readers).groupBy("path").agg(F.min_by("reason", "_rank").alias("reason"))


def best(ranked: DataFrame, n: int) -> DataFrame:
    """The n best by score, priority and path: a top-k, not a sort of all."""
    return ranked.orderBy(F.desc("score"), "base_priority", "path").limit(n)


def dropped(ranked: DataFrame, after: int, most: int = DROPPED) -> DataFrame:
    """The rows that follow the cut."""
    return ranked.orderBy(F.desc("score"), "base_priority", "path").offset(after).limit(most)
