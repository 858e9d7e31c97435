"""Groups, order, measures and text of a bundle of selected items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import bullets, clip, quarter_units
from lodestack.operators.pack import DIGEST, language

STRUCTURED = ["symbol_extract", "section_extract", "key_block_extract"]
GROUPS = ["contract", "workflow", "code", "supporting", "attachments"]
LAYERS = ["stable_contract", "dynamic_task", "evidence", "attachments"]
TITLES = {"contract": "Contracts", "workflow": "Workflows", "code": "Code", "supporting": "Supporting context"}
ANCHORS = 6


def bundle_group(kind: Column | str, included: Column | str) -> Column:
    kind, included = (F.col(c) if isinstance(c, str) else c for c in (kind, included))
    return (
        F.when(~included, "attachments").when(kind.isin("contract", "workflow"), kind)
        .when(kind.isin("selection_logic", "code_snippet"), "code").otherwise("supporting")
    )


def bundle_rank(group: Column, path: Column, kind: Column, promoted: Column, priority: Column) -> Column:
    """Sort key of an item within its group: struct of three."""
    low = F.lower(path)
    has = lambda *tokens: F.lower(path).rlike("|".join(tokens))
    # Names that come first.
    contract = F.when(F.contains(low, F.lit("schema")), 0).when(F.contains(low, F.lit("template")), 1).when(has("policy", "status", "manifest", "openai", "skill"), 2).otherwise(3)
    flow = F.when(F.contains(low, F.lit("confirm")), 0).when(has("preview", "prepare", "workflow"), 1).otherwise(2)
    code = F.when(promoted, 0).otherwise(1)
    other = F.when(has("problem", "overview", "research"), 0).otherwise(1)
    first = F.when(group == "contract", contract).when(group == "workflow", flow).when(group == "code", code).when(group == "supporting", other).otherwise(0)
    second = F.when(group == "code", F.when(kind == "selection_logic", 0).otherwise(1)).when(group == "attachments", 0).otherwise(priority)
    return F.struct(first.alias("first"), second.cast("int").alias("second"), path.alias("path"))


def grouped(items: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """items (keys of the bundle, path, artifact_type, included, promoted, priority) with bundle_group and place: their order within it."""
    rows = items.withColumn("bundle_group", bundle_group("artifact_type", "included"))
    rank = bundle_rank(*(F.col(c) for c in ("bundle_group", "path", "artifact_type", "promoted", "priority")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "bundle_group").orderBy(rank)))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent of whole (1 at least), halves to even."""
    return F.bround(100 * part / F.greatest(whole, F.lit(1)), 0).cast("int")


def quality(items: DataFrame, tokens: Column, most: Column, keys: list[str] | None = None) -> DataFrame:
    """Measures of bundles (one, or one per keys): items has included, artifact_type, strategy, compaction, fallback, anchors, explained."""
    i = F.col("included")
    n = F.count_if(i)
    anchored = F.size("anchors") > 0
    lost = i & ~anchored & (F.col("strategy").isin(STRUCTURED) | (F.col("compaction") == DIGEST) & (F.col("artifact_type") != "contract"))
    out = items.groupBy(*(keys or [])).agg(
        F.count_if(i & (F.col("artifact_type") == "contract")).alias("contract_coverage"),
        F.count_if(i & (F.col("artifact_type") == "workflow")).alias("workflow_coverage"),
        percent(F.count_if(i & F.col("strategy").isin(STRUCTURED) & (F.col("compaction") == "none")), n).alias("structured_extract_ratio"),
        percent(F.count_if(i & F.col("fallback")), n).alias("fallback_ratio"),
        F.coalesce(F.bool_and(~lost), F.lit(True)).alias("anchor_fidelity"),
        F.when(n == 0, 100).otherwise(percent(F.count_if(i & F.col("explained")), n)).alias("explanation_coverage"),
    )
    return out.withColumns({"budget_compliance": tokens <= most, "bundle_order_valid": F.lit(True)})


#: Columns of an item that a manifest shows, as far as it has them.
PUBLISHED = (
    "path file_type artifact_type context_layer origin included promoted priority score reason n_tokens n_included bundle_group place excerpt anchors path_types distance explained graph_selected attachment"
).split()


def published(items: DataFrame) -> DataFrame:
    """items as a manifest shows them: without their contents and what only orders them."""
    return items.select(*(c for c in PUBLISHED if c in items.columns))


def summary(items: DataFrame) -> DataFrame:
    """One row of counts and lists over the items of a bundle: included, path, artifact_type, promoted, excerpt."""
    i, e = F.col("included"), "excerpt."
    paths = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("path"))))
    structured = F.col(e + "strategy").isin(STRUCTURED) & (F.col(e + "compaction") == "none")
    return items.agg(
        F.count("*").alias("n_selected"), F.count_if(i).alias("n_included"), F.count_if(e + "truncated").alias("n_truncated"),
        F.count_if(i & structured).alias("n_structured"), F.count_if(i & (F.col(e + "compaction") == DIGEST)).alias("n_digests"), F.count_if(i & F.col(e + "fallback")).alias("n_fallbacks"),
        paths(i & (F.col("artifact_type") == "contract") & F.col(e + "kept_tokens")).alias("preserved"), paths(i & F.col("promoted")).alias("promoted"),
    )


def layer_counts(items: DataFrame) -> DataFrame:
    """Rows of every layer, zero included; items: included, context_layer."""
    layer = F.when(~F.col("included"), "attachments").when(F.col("context_layer") == "stable_contract", "stable_contract").otherwise("evidence")
    known = items.sparkSession.createDataFrame([(x, k) for k, x in enumerate(LAYERS)], "layer string, ord int")
    counts = items.groupBy(layer.alias("layer")).count()
    return known.join(counts, "layer", "left").select("layer", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))


def top_anchors(items: DataFrame, keys: list[str], most: int = ANCHORS) -> DataFrame:
    """The first few different anchors per keys, items in the order of ord."""
    rows = items.where("included").select(*keys, "ord", F.posexplode("anchors").alias("at", "anchor"))
    rows = rows.groupBy(*keys, "anchor").agg(F.min(F.struct("ord", "at")).alias("first"))
    return rows.groupBy(*keys).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("first", "anchor"))), 1, most), lambda s: s["anchor"]).alias("anchors"))


def block(included_tokens: Column | str = "n_included") -> Column:
    """An item's block: what it is and why, and its excerpt in a fence."""
    included_tokens = F.col(included_tokens) if isinstance(included_tokens, str) else included_tokens
    line = lambda label, value: F.concat(F.lit(f"- {label}: "), value)
    return F.concat_ws(
        "\n", F.concat(F.lit("### "), "path"), line("layer", F.col("context_layer")), line("kind", F.col("artifact_type")), line("reason", F.col("reason")),
        line("anchors", F.coalesce(F.nullif(F.array_join("excerpt.anchors", ", "), F.lit("")), F.lit("none"))), line("tokens", F.concat(included_tokens.cast("string"), F.lit(" of "), F.col("n_tokens").cast("string"))),
        line("strategy", F.col("excerpt.strategy")), line("compaction", F.col("excerpt.compaction")), line("cut", F.col("excerpt.method")),
        F.lit(""), F.concat(F.lit("```"), language("path", F.col("excerpt.compaction"))), F.col("excerpt.text"), F.lit("```"), F.lit(""),
    )


def item_text() -> Column:
    """All that a bundle says of an item: its block, with tokens of up to ten digits, and the notes on it."""
    return F.concat(block(F.lit(9_999_999_999)), F.lit("\n- "), "path", F.lit(": a digest\n- "), "path", F.lit(": cut by "), "excerpt.method", F.lit("\n"))


def left_out() -> Column:
    """The note on an item that is attached only."""
    return F.concat("path", F.lit(": attached only"))


def bundle_text(items: DataFrame, mode: str, topic: str, goal: str, focus: list[str], risks: list[str]) -> DataFrame:
    """The bundle of grouped() items as one row; the items of a bundle are few."""
    spark = items.sparkSession
    rows = items.where("included").withColumn("_block", block(F.ceil(quarter_units("excerpt.text") / 4)))
    texts = rows.groupBy("bundle_group").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "_block"))), lambda s: s["_block"]), "\n").alias("_text"))
    notes = items.agg(
        F.sort_array(F.collect_list(F.when(~F.col("included"), left_out()))).alias("_left"),
        F.sort_array(F.collect_list(F.when(F.col("included") & (F.col("excerpt.compaction") == DIGEST), F.concat("path", F.lit(": a digest"))))).alias("_short"),
        F.sort_array(F.collect_list(F.when(F.col("included") & F.col("excerpt.fallback"), F.concat("path", F.lit(": cut by "), "excerpt.method")))).alias("_cut"),
    )
    sections = spark.createDataFrame([(g, i, t) for i, (g, t) in enumerate(TITLES.items(), 2)], "bundle_group string, ord int, title string").join(texts, "bundle_group", "left")
    body = F.concat(F.lit("## "), F.col("ord").cast("string"), F.lit(". "), "title", F.lit("\n"), F.coalesce("_text", F.lit("Nothing was selected here.\n")))
    middle = sections.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", body.alias("t")))), lambda s: s["t"]), "\n").alias("_middle"))
    focus_text = clip(F.lit("; ".join(focus) or "To be made clear."), 320)
    top = F.concat_ws("\n", F.lit(f"# Bundle\n\n## 1. Task\n- mode: {mode}\n- topic: {topic}"), F.concat(F.lit("- goal: "), clip(F.lit(goal), 280)), F.concat(F.lit("- focus: "), focus_text), F.lit(""))
    said = F.concat(F.array(*map(F.lit, risks)).cast("array<string>"), "_left", "_short", "_cut")
    return middle.crossJoin(notes).select(F.concat_ws("\n", top, "_middle", F.lit("## 6. Risks"), bullets(said, "None recorded."), F.lit("")).alias("bundle"))
