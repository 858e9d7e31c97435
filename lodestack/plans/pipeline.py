"""From a corpus and a request to a bundle, its manifest, and its confirmation."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.frames import create_text, cut, make_folder, names, saved, write_text
from lodestack.functions import paths
from lodestack.functions.text import estimate_tokens, quarter_units, words
from lodestack.functions.tokens import exact_tokens
from lodestack.operators import extract, graph, pack, report, select, terms
from lodestack.operators.catalog import GATES, Exclusions, catalog, classified, excluded
from lodestack.operators.score import graph_bonus, scored
from lodestack.operators.score import promoted as promote
from lodestack.request import Request

#: Tokens of one item's excerpt at most.
PER_ITEM = 1200
#: How a manifest names what selected its items.
ENGINE = {"name": "lodestack-graph", "version": 1, "graph_version": 1, "graph_assisted": True}
STATUS = ("preview", "confirmed")
#: The folder of a bundle that holds the versions of its manifest.
VERSIONS = "versions"


@dataclass(frozen=True)
class Vocabulary:
    """What exact token counts need: a file of ranks that every machine has, and how texts are split. See functions.tokens."""

    ranks: str
    pattern: str
    name: str


def token_count(request: Request, vocabulary: Vocabulary | None) -> tuple[Callable[[Column], Column], str]:
    """How texts are counted for a request, and the name of it; a request for exact counts needs a vocabulary."""
    if not request.require_exact_tokens:
        return estimate_tokens, "estimate"
    if vocabulary is None:
        raise ValueError("The request asks for exact tokens, which need a vocabulary")
    return (lambda c: exact_tokens(c, vocabulary.ranks, vocabulary.pattern)), vocabulary.name


@dataclass
class Selection:
    """Chosen items (path, content, kinds, score, reason, origin, promoted, priority, place, paths), those that just missed, warnings, and what was decided.

    nodes and edges: counts by type. counts: n_items and n_excluded of the corpus.
    """

    items: DataFrame
    dropped: DataFrame
    warnings: DataFrame
    explain: Callable[[], DataFrame]
    gate: str
    all_terms: list[str]
    two_hops: bool
    nodes: DataFrame
    edges: DataFrame
    counts: DataFrame

    @cached_property
    def explanations(self) -> DataFrame:
        """The paths to the items; put together when they are asked for."""
        return self.explain()


def select_items(corpus: DataFrame, request: Request, rules: Exclusions = Exclusions(), traverse_dirs: bool = True) -> Selection:
    """The items of a corpus (path, content) for a request: what it includes, what it mentions, and the best of the rest.

    Scores, joins and rankings run over the whole corpus; only the request's lanes and the number of
    included and mentioned items, which max_files bounds, come to the driver. The corpus is read three times:
    its paths; its texts, in one pass that keeps what was found and no text; and the texts of what is chosen.
    """
    spark, request = corpus.sparkSession, request.normalized().validate()
    about = terms.cross_file(terms.gate(request.frame(spark))).first()
    allowed = GATES[about.retrieval_gate]
    known = saved(classified(corpus.drop("content")).withColumn("_out", excluded("path", rules)), "catalog")
    everything, items = known.drop("_out"), known.where(~F.col("_out")).drop("_out")
    references = graph.References(items)
    texts = classified(corpus.select("path", "content").where(~excluded("path", rules)))
    read = saved(references.read(texts, extract.facts_of("path", "content").alias("facts")), "read")
    symbols, raw = extract.told(read)
    modules = items.select("path", paths.module("path").alias("module")).where("module is not null")
    imports = cut(graph.resolve_imports(raw, modules))
    nodes, edges = graph.build(items, symbols, imports, references.edges(read))
    lanes = {lane: list(about[lane]) for lane in ("task", "contract", "code")}
    plain = saved(scored(items, lanes), "scored")
    text = " ".join([request.topic, request.goal, *request.focus_points, *request.questions, *request.blockers, *request.known_routes, *request.output_requirements])
    anchors = cut(graph.seeds(plain, [*request.must_include, *request.mentioned_paths], symbols, text))
    reached = graph.Search(edges, anchors, traverse_dirs)
    wide = about.wants_two_hops
    found = cut(reached.nearest(2 if wide else 1))
    if not wide and graph.neighbour_count(found, items) < 2:
        wide, found = True, cut(reached.nearest(2))
    two_hops = wide and not found.where("least_hops > 1").isEmpty()

    included, notes = select.include_minus_exclude(everything.select("path"), list(request.must_include), list(request.must_exclude))
    banned = select.resolve_patterns(everything.select("path"), list(request.must_exclude)).where("path is not null").select("path").distinct()
    said = [request.background, *request.focus_points, *request.questions, *request.known_routes, *request.blockers]
    named = select.mentioned_paths(spark.createDataFrame(list(enumerate(said)), "ord int, text string"), items.select("path"))
    key = lambda kind, *place: F.struct(F.lit(kind).alias("_kind"), *(F.lit(x).cast(t).alias(n) for n, t, x in zip(("_text", "_at", "_order"), ("bigint", "bigint", "string"), place))).alias("ord")
    named = named.select("path", key(1, F.col("ord._text"), F.col("ord._at"), F.col("ord._order")))
    listed = select.resolve_patterns(items.select("path"), list(request.mentioned_paths)).where("path is not null").select("path", key(0, F.col("ord"), 0, ""))
    named = listed.union(named).groupBy("path").agg(F.min("ord").alias("ord")).join(banned, "path", "left_anti").join(included, "path", "left_anti")
    if about.retrieval_gate != "full_bundle":
        named = named.join(items.where(F.col("artifact_type").isin(allowed)), "path", "left_semi")
    included, named = cut(included), cut(named)
    room = max(request.max_files - included.count(), 0)
    mentioned = cut(named.orderBy("ord", "path").limit(room).withColumn("ord", F.row_number().over(Window.orderBy("ord", "path"))))
    left = max(room - mentioned.count(), 0)

    def ranked(promoted: DataFrame | None) -> DataFrame:
        rows = plain.join(banned, "path", "left_anti").join(included, "path", "left_anti").join(named, "path", "left_anti")
        if promoted is not None:
            rows = rows.join(promoted.withColumnRenamed("reason", "_why"), "path", "left")
        else:
            rows = rows.withColumn("_why", F.lit(None).cast("string"))
        rows = rows.where(F.col("_why").isNotNull() | F.col("artifact_type").isin(allowed) if allowed else F.col("_why").isNotNull())
        rows = promote(rows, "_why").join(found.select("path", "path_types", "distance"), "path", "left")
        return rows.withColumn("score", F.col("score") + graph_bonus(F.coalesce("path_types", F.array().cast("array<string>")), F.col("artifact_type")))

    first = select.best(ranked(None), left).select("path", F.lit(2).alias("_o"), F.monotonically_increasing_id().alias("ord"))
    chosen = included.select("path", F.lit(0).alias("_o"), "ord").unionByName(mentioned.select("path", F.lit(1).alias("_o"), "ord")).unionByName(first)
    chosen = items.select("path", "artifact_type").join(chosen, "path").withColumn("ord", F.struct("_o", "ord"))
    promoted = cut(select.promotions(chosen, read.select("path", "artifact_type", "_reads"), imports, F.col("_reads")))
    last = cut(ranked(promoted))
    auto = select.best(last, left).select("path", F.lit("auto").alias("origin"), F.struct(-F.col("score"), "base_priority", "path").alias("_k"), "score", "reason")
    auto = auto.select("path", "origin", F.struct(F.col("_k.col1").cast("bigint").alias("a"), F.col("path").alias("b")).alias("_k"), "score", "reason")
    fixed = included.select("path", F.lit("must_include").alias("origin"), "ord").unionByName(mentioned.select("path", F.lit("mentioned").alias("origin"), "ord"))
    fixed = fixed.select("path", "origin", F.struct(F.col("ord").cast("bigint").alias("a"), F.col("path").alias("b")).alias("_k"), F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("reason"))
    picked = saved(fixed.unionByName(auto), "picked")  # its size is known, so few items don't make Spark shuffle all texts
    rows = catalog(corpus.join(picked, "path")).join(promoted.select("path", F.lit(True).alias("promoted")), "path", "left").join(found.select("path", "path_types", "distance"), "path", "left")
    why = F.when(F.col("origin") == "must_include", F.concat(F.lit("The request includes it. "), "base_reason")).when(F.col("origin") == "mentioned", F.concat(F.lit("The request names it. "), "base_reason")).otherwise(F.col("reason"))
    priority = F.when(F.col("origin") == "must_include", 1).when(F.col("origin") == "mentioned", F.least("base_priority", F.lit(2))).otherwise(F.col("base_priority"))
    rank = F.when(F.col("origin") == "must_include", 0).when(F.col("origin") == "mentioned", 1).otherwise(2)
    rows = rows.withColumns({"reason": why, "priority": priority, "promoted": F.coalesce("promoted", F.lit(False)), "distance": F.coalesce("distance", F.lit(-1)), "_o": rank})
    rows = rows.withColumn("explained", F.col("path_types").isNotNull()).withColumn("graph_selected", F.col("distance") > 0)
    rows = cut(rows)
    missed = select.dropped(last.where("path_types is not null"), 0, left + select.DROPPED).join(rows, "path", "left_anti").orderBy(F.desc("score"), "base_priority", "path").limit(select.DROPPED)
    shown = found.join(rows, "path", "left_semi")
    explain = lambda: graph.explanations(shown.join(reached.traced(shown), ["target_node", "distance"]))
    kinds = graph.type_counts(nodes.select("node_type").union(anchors.select(F.lit("task_state_anchor"))), "node_type", graph.NODE_TYPES)
    counts = known.agg(F.count("*").alias("n_items"), F.count_if("_out").alias("n_excluded"))
    return Selection(rows, missed, notes, explain, about.retrieval_gate, list(about.all_terms), two_hops, kinds, graph.edge_counts(edges), counts)


def bundle(chosen: Selection, request: Request, per_item: int = PER_ITEM, vocabulary: Vocabulary | None = None) -> tuple[DataFrame, DataFrame]:
    """(items with excerpt, included, bundle_group and place; the bundle's text and its tokens in one row), within the request's tokens.

    Excerpts, blocks and the whole are counted as the request asks, by the estimate or by a vocabulary.
    Items that are dropped are settled() as attachments. Raises if what must stay does not fit.
    """
    request = request.normalized()
    count, _ = token_count(request, vocabulary)
    exact = None if count is estimate_tokens else pack.Exact(vocabulary.ranks, vocabulary.pattern)
    frame = 4 * 220 + 4 * len(" ".join([request.topic, request.goal[:280], *request.focus_points])) + 4 * sum(len(b) + 4 for b in request.blockers)
    rows = chosen.items.withColumns({"n_included": F.lit(0), "reason": F.coalesce("reason", F.lit(""))})
    units = (lambda c: 4 * count(c)) if exact else quarter_units
    fitted, room = pack.Fitted(rows, words(chosen.all_terms), per_item, units(report.item_text()), frame, quarter_units(report.left_out()) + 12, exact), request.max_bundle_tokens
    while True:
        made = pack.settled(fitted.choose(room)[0])
        made = cut(report.grouped(made.withColumn("n_included", F.when(F.col("included"), count(F.col("excerpt.text"))).otherwise(0))))
        text = report.bundle_text(made, request.mode, request.topic, request.goal, list(request.focus_points), list(request.blockers))
        text = cut(text.withColumn("tokens", count(F.col("bundle"))))
        over = text.first().tokens - request.max_bundle_tokens
        if over <= 0:
            return made, text
        room -= over  # exact tokens of blocks don't quite add up to those of the whole


def manifest(chosen: Selection, made: DataFrame, request: Request, bundle_id: str, created_at: str, tokens: int, counted: str = "estimate", attachments: str = "") -> dict:
    """What was decided and why, ready to be written as JSON. A bundle's items are few."""
    flat = made.select("included", "artifact_type", "context_layer", F.col("excerpt.strategy").alias("strategy"), F.col("excerpt.compaction").alias("compaction"), F.col("excerpt.fallback").alias("fallback"), F.col("excerpt.anchors").alias("anchors"), "explained")
    measures = report.quality(flat, F.lit(tokens), F.lit(request.max_bundle_tokens)).first().asDict()
    layers = {r.layer: r.n for r in report.layer_counts(flat).collect()}
    files = report.published(made.withColumn("attachment", F.lit(attachments)).orderBy("_o", "_k")).toJSON().collect()
    summary = chosen.counts.first().asDict() | report.summary(made).first().asDict()
    linked = {name: {r[0]: r.n for r in rows.orderBy("ord").collect()} for name, rows in (("nodes", chosen.nodes), ("edges", chosen.edges))}
    summary |= {
        "retrieval_gate": chosen.gate, "total_bundle_tokens": tokens, "tokens_counted_by": counted, "max_files_requested": request.max_files, "max_bundle_tokens_requested": request.max_bundle_tokens,
        "selector_engine": ENGINE, "two_hop_triggered": chosen.two_hops, "graph": linked | {"version": ENGINE["graph_version"], "two_hop_enabled": graph.MAX_HOPS >= 2, "two_hop_triggered": chosen.two_hops}, "bundle_layer_counts": layers, "quality_metrics": measures,
    }
    return {
        "bundle_id": bundle_id, "created_at": created_at, "status": STATUS[0], "mode": request.mode, "topic": request.topic, "goal": request.goal,
        "inputs": asdict(request), "task_state": request.task_state(), "files": [json.loads(f) for f in files], "selection_summary": summary,
        "explanation": {"per_artifact_paths": [json.loads(x) for x in chosen.explanations.toJSON().collect()], "dropped_candidates": [json.loads(x) for x in chosen.dropped.select("path", "score", "reason").toJSON().collect()]},
        "warnings": [r.asDict() for r in chosen.warnings.collect()],
    }


def write_bundle(
    corpus: DataFrame, request: Request, folder: str, bundle_id: str, created_at: str, rules: Exclusions = Exclusions(), per_item: int = PER_ITEM, vocabulary: Vocabulary | None = None
) -> dict:
    """Selects, packs and writes bundle.md, the manifest's first version and the chosen items' texts (attachments, as Parquet) into folder/bundle_id, in any store that Spark knows."""
    spark, out = corpus.sparkSession, f"{folder.rstrip('/')}/{bundle_id}"
    chosen = select_items(corpus, request, rules)
    made, text = bundle(chosen, request, per_item, vocabulary)
    said = text.first()
    make_folder(spark, out)
    made.select("path", "content").write.parquet(f"{out}/attachments")
    told = manifest(chosen, made, request.normalized(), bundle_id, created_at, said.tokens, token_count(request, vocabulary)[1], "attachments")
    write_text(spark, f"{out}/bundle.md", said.bundle)
    make_folder(spark, f"{out}/{VERSIONS}")
    return _put(spark, out, told)


#: What is read of every version of a manifest.
STATE = "version int, bundle_id string, status string"


def preview(spark: SparkSession, folder: str, bundle_id: str) -> dict:
    """The latest whole version of a written bundle's manifest, checked against its folder.

    Versions that a crash left half-written do not parse and are passed over.
    """
    text = spark.read.text(f"{folder.rstrip('/')}/{bundle_id}/{VERSIONS}", wholetext=True)
    known = text.select("value", F.from_json("value", STATE).alias("s")).where("s.version is not null and s.status is not null")
    last = known.agg(F.max_by("value", "s.version")).first()[0]
    if last is None:
        raise FileNotFoundError(f"{bundle_id} has no manifest")
    told = json.loads(last)
    if told["bundle_id"] != bundle_id:
        raise ValueError(f"The manifest in {bundle_id} is that of {told['bundle_id']}")
    return told


def _put(spark: SparkSession, out: str, told: dict) -> dict:
    """Writes told as the next version of its manifest, and manifest.json as a copy for readers; FileExistsError if someone else wrote that version."""
    told = told | {"version": 1 + max((int(n.partition(".")[0]) for n in names(spark, f"{out}/{VERSIONS}")), default=0)}
    text = json.dumps(told, ensure_ascii=False, indent=2) + "\n"
    create_text(spark, f"{out}/{VERSIONS}/{told['version']:06d}.json", text)
    write_text(spark, f"{out}/manifest.json", text)
    return told


def confirm(spark: SparkSession, folder: str, bundle_id: str, at: str) -> dict:
    """Marks a bundle as confirmed, in a new version of its manifest; again is no change but of the time.

    The version before stays, so a crash at any point loses nothing. Of two who confirm at once one creates the
    version and the other goes on from it.
    """
    while True:
        told = preview(spark, folder, bundle_id) | {"status": STATUS[1], "confirmed_at": at}
        try:
            return _put(spark, f"{folder.rstrip('/')}/{bundle_id}", told)
        except FileExistsError:
            continue
