"""Queries over the test tables, one or more per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.frames import table
from lodestack.functions import paths, text
from lodestack.functions.text import words
from lodestack.operators import catalog, extract, graph, pack, report, score, select, terms
from lodestack.plans import pipeline, sql
from lodestack.request import Request
from lodestack.sources.corpus import documents_corpus

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LANES = {"task": ["docs", "src1", "overview"], "contract": [*terms.CONTRACT_TERMS, "docs"], "code": terms.CODE_TERMS}
TERMS = ["the", "that", "schema", "en"]
TOP = 8
INCLUDE, EXCLUDE = ["schemas/*_1?0.json", "docs/en", "./README_9.md", "no/such"], ["*_110.json", "docs/en/d_15.md", "gone*"]


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_corpus(table(spark, sf_dir, "documents"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog(corpus(spark, sf_dir))


@query(f"WITH {sql.CORPUS} SELECT path, {sql.NAME} AS name, {sql.SUFFIX} AS suffix, {sql.STEM} AS stem, {sql.FILE_TYPE} AS file_type FROM corpus")
def classify_file_type(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", paths.name("path").alias("name"), paths.suffix("path").alias("suffix"), paths.stem("path").alias("stem"), catalog.file_type("path").alias("file_type"))


@query(f"WITH {sql.CATALOG} SELECT path, artifact_type, {sql.of_kind(2)} AS context_layer, {sql.of_kind(0)} AS base_priority, {sql.of_kind(1)} AS base_score, n_tokens FROM items")
def classify_artifact(spark, sf_dir):
    return items(spark, sf_dir).select("path", "artifact_type", "context_layer", "base_priority", catalog.of_kind("artifact_type", 1).alias("base_score"), "n_tokens")


@query(f"WITH {sql.CORPUS} SELECT path FROM corpus WHERE NOT {sql.EXCLUDED}")
def exclude_filter(spark, sf_dir):
    return corpus(spark, sf_dir).where(~catalog.excluded("path")).select("path")


@query(f"WITH {sql.CORPUS} SELECT count(*) AS n_items, 0::BIGINT AS n_binary, count(*) FILTER (WHERE {sql.EXCLUDED}) AS n_excluded, count(*) FILTER (WHERE NOT {sql.EXCLUDED}) AS n_candidates FROM corpus")
def scan_summary(spark, sf_dir):
    return catalog.scan_summary(corpus(spark, sf_dir))


@query(f"SELECT doc_id, {sql.tokens('text')} AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens("text").alias("n_tokens"))


@query(f"SELECT lang, count(*) AS n, CAST(sum({sql.units('text')}) AS BIGINT) AS units, CAST(ceil(sum({sql.units('text')}) / 4.0) AS BIGINT) AS n_tokens FROM documents GROUP BY lang")
def token_budget_by_lang(spark, sf_dir):
    units = F.sum(text.quarter_units("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), units.alias("units"), F.ceil(units / 4).alias("n_tokens"))


@query("SELECT doc_id, left(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), 200) AS start, right(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), 200) AS ending FROM documents")
def slice_head_ascii(spark, sf_dir):
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return table(spark, sf_dir, "documents").select("doc_id", text.slice_head(ascii_only, 50).alias("start"), text.slice_tail(ascii_only, 50).alias("ending"))


_fit = "length(list_filter(range(1, 201), lambda n: length(left({0}, n)) = n AND n + 3 * length(regexp_replace(left({0}, n), '[\\x00-\\x7F]', '', 'g')) <= 200))"


@query(f"SELECT doc_id, left(text, {_fit.format('left(text, 200)')}) AS start, right(text, {_fit.format('reverse(right(text, 200))')}) AS ending FROM documents")
def slice_head_mixed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slice_head("text", 50).alias("start"), text.slice_tail("text", 50).alias("ending"))


@query(f"SELECT DISTINCT conv_id, unnest({sql.query_terms('text')}) AS term FROM conversations")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.explode(text.query_terms("text")).alias("term")).distinct()


@query(f"WITH {sql.CATALOG}, {sql.scored(LANES)} SELECT path, array_to_string(task_hits, ' ') AS task_hits, array_to_string(contract_hits, ' ') AS contract_hits, array_to_string(code_hits, ' ') AS code_hits, array_to_string(hits, ' ') AS hits FROM hit")
def path_term_hits(spark, sf_dir):
    rows = score.scored(items(spark, sf_dir), LANES)
    return rows.select("path", *(F.array_join(c, " ").alias(c) for c in ("task_hits", "contract_hits", "code_hits", "hits")))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per conversation: the first user turn is its topic, the others are its questions."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("said"))
    none = F.array().cast("array<string>")
    empty = {c: none for c in ("focus_points", "must_include", "mentioned_paths", "known_routes", "blockers", "output_requirements")}
    return rows.select("conv_id", F.get("said", F.lit(0)).alias("topic"), F.lit("").alias("goal"), F.lit("").alias("background"), F.slice("said", F.lit(2), F.size("said")).alias("questions")).withColumns(empty)


_hay = "lower(array_to_string(list_transform(said, lambda s: s), ' '))"


@query(f"""
WITH s AS (SELECT conv_id, list(text ORDER BY turn) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id),
t AS (SELECT conv_id, said, list_distinct(list_filter(flatten(list_transform(said, lambda x: {sql.query_terms('x')})), lambda x: x IS NOT NULL)) AS task FROM s)
SELECT conv_id, len(task) AS n_terms, CASE WHEN {sql.any_of(_hay, terms.CODE_FOCUS)} THEN 'full_bundle'
  WHEN NOT {sql.any_of(_hay, terms.CONTRACT_FOCUS)} AND len(task) <= {terms.FEW_TERMS} THEN 'brief_only' ELSE 'brief_plus_contract' END AS retrieval_gate FROM t
""")
def gate_decision(spark, sf_dir):
    return terms.gate(tasks(spark, sf_dir)).select("conv_id", F.size("task").cast("bigint").alias("n_terms"), "retrieval_gate")


_of_all = lambda texts: f"list_distinct(flatten(list_transform({texts}, lambda x: {sql.query_terms('x')})))"


@query(f"""
WITH s AS (SELECT conv_id, list(text ORDER BY turn) AS said, '{terms.CODE_PHRASE}' AS phrase FROM conversations WHERE role = 'user' GROUP BY conv_id),
t AS (SELECT conv_id, list_distinct(list_concat({_of_all('said')}, {sql.query_terms("''")})) AS task, list_concat({_of_all('said[2:]')}, {sql.query_terms('phrase')}, {sql.array(terms.CODE_TERMS)}) AS code FROM s),
l AS (SELECT conv_id, 'task' AS lane, task AS terms FROM t UNION ALL SELECT conv_id, 'contract', list_concat(task, {sql.array(terms.CONTRACT_TERMS)}) FROM t
  UNION ALL SELECT conv_id, 'code', code FROM t UNION ALL SELECT conv_id, 'all_terms', list_concat(task, {sql.array(terms.CONTRACT_TERMS)}, code) FROM t)
SELECT conv_id, lane, array_to_string(list_sort(list_distinct(terms)), ' ') AS terms FROM l
""")
def lane_union(spark, sf_dir):
    """The lanes of every task, and their union."""
    rows = terms.lanes(tasks(spark, sf_dir))
    lanes = F.array(*(F.struct(F.lit(c).alias("lane"), F.array_join(c, " ").alias("terms")) for c in ("task", "contract", "code", "all_terms")))
    return rows.select("conv_id", F.inline(lanes))


@query(f"WITH {sql.CATALOG}, {sql.scored(LANES)} SELECT path, artifact_type, score, base_priority FROM ranked WHERE NOT {sql.EXCLUDED} ORDER BY score DESC, base_priority, path LIMIT {TOP}")
def score_rank_topk(spark, sf_dir):
    rows = score.scored(items(spark, sf_dir).where(~catalog.excluded("path")), LANES)
    return select.best(rows, TOP).select("path", "artifact_type", "score", "base_priority")


def imports_by_id(rows: DataFrame) -> DataFrame:
    """Edges for the test: item n imports item n + 1 and item n + 2."""
    return rows.select(F.col("path").alias("src"), F.explode(F.array(F.col("ord") + 1, F.col("ord") + 2)).alias("ord")).join(rows.select("ord", F.col("path").alias("dst")), "ord").select("src", "dst")


_consumes = sql.any_of("lower(content)", select.CONSUMES)


@query(f"""
WITH {sql.CATALOG}, {sql.scored(LANES)},
first AS (SELECT *, row_number() OVER (ORDER BY score DESC, base_priority, path) AS place FROM ranked QUALIFY place <= 40),
direct AS (SELECT b.path, arg_min('A direct dependency of ' || f.path || '.', f.place) AS reason FROM first f JOIN items b ON b.ord IN (f.ord + 1, f.ord + 2) WHERE f.artifact_type = 'workflow' GROUP BY b.path),
readers AS (SELECT path, 'It reads what contracts define.' AS reason FROM items WHERE artifact_type IN ('workflow', 'selection_logic', 'code_snippet') AND {_consumes} AND EXISTS (SELECT 1 FROM first WHERE artifact_type = 'contract')),
promoted AS (SELECT * FROM direct UNION ALL SELECT * FROM readers WHERE path NOT IN (SELECT path FROM direct)),
again AS (SELECT r.path, r.artifact_type, r.score + CASE WHEN p.path IS NULL THEN 0 ELSE 180 END AS score, r.base_priority, p.reason AS why FROM ranked r LEFT JOIN promoted p ON r.path = p.path)
SELECT path, artifact_type, score, why FROM again ORDER BY score DESC, base_priority, path LIMIT 60
""")
def two_pass_promotion(spark, sf_dir):
    rows = items(spark, sf_dir)
    ranked = score.scored(rows, LANES)
    first = select.best(ranked, 40).withColumn("ord", F.row_number().over(Window.orderBy(F.desc("score"), "base_priority", "path"))).select("path", "artifact_type", "ord")
    why = select.promotions(first, rows, imports_by_id(rows)).withColumnRenamed("reason", "why")
    again = score.scored(rows.join(why, "path", "left"), LANES, reason="why")
    return select.best(again, 60).select("path", "artifact_type", "score", "why")


@query(f"WITH {sql.CATALOG}, {sql.scored(LANES)} SELECT path, score FROM ranked ORDER BY score DESC, base_priority, path LIMIT {select.DROPPED} OFFSET {TOP}")
def dropped_report(spark, sf_dir):
    return select.dropped(score.scored(items(spark, sf_dir), LANES), TOP).select("path", "score")


_patterns = {"schemas/*_1?0.json": "regexp_full_match(path, 'schemas/.*_1.0\\.json')", "docs/en": "(path = 'docs/en' OR starts_with(path, 'docs/en/'))", "./README_9.md": "path = 'README_9.md'", "no/such": "path = 'no/such'", "*_110.json": "regexp_full_match(path, '.*_110\\.json')", "docs/en/d_15.md": "path = 'docs/en/d_15.md'", "gone*": "regexp_full_match(path, 'gone.*')"}


def _resolved(patterns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{p}' AS pattern, {i} AS ord, path FROM (SELECT 1) LEFT JOIN corpus ON {_patterns[p]}" for i, p in enumerate(patterns))


@query(f"WITH {sql.CORPUS} {_resolved(INCLUDE)}")
def glob_resolve(spark, sf_dir):
    return select.resolve_patterns(corpus(spark, sf_dir).select("path"), INCLUDE).select("pattern", "ord", "path")


@query(f"""
WITH {sql.CORPUS}, t AS (SELECT page_id, unnest(regexp_extract_all(url || ' docs/en/d_' || page_id || '.md mod_' || (page_id * 10 + 4) || '.py x/workflow.py', '[A-Za-z0-9_./\\\\-]+\\.[A-Za-z0-9_]+')) AS token FROM pages),
k AS (SELECT path, {sql.NAME} AS name FROM corpus)
SELECT DISTINCT k.path FROM t JOIN k ON t.token = k.path OR regexp_extract(t.token, '([^/]*)$', 1) = k.name AND (t.token <> k.path)
""")
def mentioned_paths(spark, sf_dir):
    said = F.concat("url", F.lit(" docs/en/d_"), "page_id", F.lit(".md mod_"), F.col("page_id") * 10 + 4, F.lit(".py x/workflow.py"))
    texts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), said.alias("text"))
    return select.mentioned_paths(texts, corpus(spark, sf_dir)).select("path")


@query(f"""
WITH {sql.CORPUS}, i AS ({_resolved(INCLUDE)}), e AS ({_resolved(EXCLUDE)})
SELECT 'kept' AS kind, path AS what FROM (SELECT path FROM i WHERE path IS NOT NULL GROUP BY path) WHERE path NOT IN (SELECT path FROM e WHERE path IS NOT NULL)
UNION ALL SELECT 'include_without_match', pattern FROM i WHERE path IS NULL UNION ALL SELECT 'exclude_without_match', pattern FROM e WHERE path IS NULL
UNION ALL SELECT 'included_and_excluded', path FROM i WHERE path IN (SELECT path FROM e WHERE path IS NOT NULL)
""")
def include_minus_exclude(spark, sf_dir):
    kept, notes = select.include_minus_exclude(corpus(spark, sf_dir).select("path"), INCLUDE, EXCLUDE)
    return kept.select(F.lit("kept").alias("kind"), F.col("path").alias("what")).unionByName(notes)


@query("SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id")
def labels_minus_toxic(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return select.without(labels.where("quality = 1"), labels.where("toxic = 1"), "doc_id")


@query(f"WITH {sql.CATALOG} SELECT path, {sql.anchor_score('path', 'left(content, 160)', TERMS)} AS priority FROM items")
def anchor_score(spark, sf_dir):
    return items(spark, sf_dir).select("path", text.anchor_score("path", "artifact_type", words(TERMS), F.left("content", F.lit(160))).alias("priority"))


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


HEADING = r"regexp_extract(top, '^#{1,6}\s+(.*\S)\s*$', 1)"


@query(rf"""
WITH d AS (SELECT conv_id, string_agg('# ' || role || ' ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, generate_subscripts(string_split(content, chr(10)), 1) AS pos, unnest(string_split(content, chr(10))) AS line FROM d),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\s+.*\S\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS seg FROM l),
b AS (SELECT conv_id, seg, {sql.strip("string_agg(line, chr(10) ORDER BY pos)")} AS text, arg_min(line, pos) AS top, {sql.strip("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT regexp_matches(line, '^#{1,6}.*')), '')")} AS body FROM s GROUP BY conv_id, seg),
t AS (SELECT *, {sql.strip(HEADING)} AS anchor FROM b)
SELECT conv_id || '.md' AS path, CAST(seg AS BIGINT) AS seg, anchor, text, anchor || ': ' || {sql.first_sentence("CASE WHEN body <> '' THEN body ELSE anchor END")} AS summary,
  {sql.anchor_score('anchor', 'left(body, 160)', TERMS, "'supporting_context'")} AS priority, {sql.strip('top')} AS snippet FROM t
""")
def markdown_sections(spark, sf_dir):
    rows = _lined(spark, sf_dir).withColumn("piece", F.concat(F.lit("# "), "role", F.lit(" "), "turn", F.lit("\n"), "text"))
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "piece"))), lambda s: s["piece"]), "\n")
    docs = rows.groupBy("conv_id").agg(content.alias("content")).select(F.concat("conv_id", F.lit(".md")).alias("path"), F.lit("supporting_context").alias("artifact_type"), "content")
    return extract.sections(docs, words(TERMS))


_toml = "'name = ' || p_name || chr(10) || '[' || p_brand || ']' || chr(10) || 'size = ' || p_size || chr(10) || '[[type]]' || chr(10) || p_type"
_yaml = "'# part' || chr(10) || 'name: ' || p_name || chr(10) || '  inner: 1' || chr(10) || '\"policy\": ' || p_brand || chr(10) || '- item' || chr(10) || 'size: ' || p_size"


def _block_sql(content: str, end: str, start: str, keep: str, anchor: str, config: bool) -> str:
    bonus = f" + CASE WHEN anchor IN ({sql.texts(extract.CONFIG_KEYS)}) THEN {extract.CONFIG_BONUS} ELSE 0 END" if config else ""
    return f"""
WITH d AS (SELECT p_partkey || '{end}' AS path, {content} AS content FROM part),
l AS (SELECT path, generate_subscripts(string_split(content, chr(10)), 1) AS pos, unnest(string_split(content, chr(10))) AS line FROM d),
s AS (SELECT *, sum(CASE WHEN {start} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS seg FROM l),
b AS (SELECT path, seg, trim(string_agg(line, chr(10) ORDER BY pos)) AS text, trim(arg_min(line, pos)) AS top FROM s GROUP BY path, seg),
t AS (SELECT *, {anchor} AS anchor FROM b WHERE {keep})
SELECT path, CAST(seg AS BIGINT) AS seg, anchor, text, anchor || ': ' || {sql.first_sentence('text')} AS summary,
  {sql.anchor_score('anchor', 'left(text, 160)', TERMS, "'contract'")}{bonus} AS priority, top AS snippet FROM t"""


def _parts(spark: SparkSession, sf_dir: str, content: str, end: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(end)).alias("path"), F.lit("contract").alias("artifact_type"), F.expr(content.replace("chr(10)", "'\\n'")).alias("content"))


@query(_block_sql(_toml, ".toml", "line LIKE '[%]'", "true", "CASE WHEN seg = 0 THEN '<root>' ELSE trim(top, '[]') END", False))
def toml_blocks(spark, sf_dir):
    return extract.toml_blocks(_parts(spark, sf_dir, _toml, ".toml"), words(TERMS))


@query(_block_sql(_yaml, ".yaml", "contains(line, ':') AND line NOT LIKE ' %'", "seg > 0", "trim(trim(string_split(top, ':')[1]), '\"''')", True))
def yaml_blocks(spark, sf_dir):
    return extract.yaml_blocks(_parts(spark, sf_dir, _yaml, ".yaml"), words(TERMS))


@query("WITH k AS (SELECT event_id, unnest(json_keys(props)) AS anchor, props FROM events) SELECT event_id || '.json' AS path, anchor, '{' || chr(10) || '  \"' || anchor || '\": ' || (props ->> anchor) || chr(10) || '}' AS text FROM k")
def json_key_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat("event_id", F.lit(".json")).alias("path"), F.lit("contract").alias("artifact_type"), F.col("props").alias("content"))
    return extract.segments(rows, words(TERMS)).select("path", "anchor", "text")


@query(f"SELECT doc_id, {sql.first_sentence('text')} AS sentence, {sql.clip('text', 240)} AS clipped FROM documents")
def first_sentence_and_clip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_sentence("text").alias("sentence"), text.clip("text", 240).alias("clipped"))


_up = f"list_concat(['.'], list_transform(range(1, len({sql.PARTS})), lambda i: array_to_string(({sql.PARTS})[1:i], '/')))"


@query(f"""
WITH {sql.CATALOG}, a AS (SELECT path, {_up} AS up FROM items),
e AS (SELECT DISTINCT 'dir:' || up[i] AS src, 'dir:' || up[i + 1] AS dst FROM (SELECT up, unnest(range(1, len(up))) AS i FROM a)
  UNION ALL SELECT 'dir:' || up[-1], 'file:' || path FROM a
  UNION ALL SELECT 'file:' || path, CASE artifact_type WHEN 'workflow' THEN 'artifact_workflow:' ELSE 'artifact_schema_template:' END || path FROM items WHERE artifact_type IN ('workflow', 'contract'))
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, 'contains' AS edge_type FROM e
""")
def contains_edges(spark, sf_dir):
    none = spark.createDataFrame([], "path string, symbol string")
    return graph.undirected(graph.contains_edges(items(spark, sf_dir), none))


@query(f"WITH {sql.CATALOG}, a AS (SELECT DISTINCT unnest({_up}) AS dir FROM items), k AS (SELECT 'dir' AS node_type, count(*) AS n FROM a UNION ALL SELECT 'file', count(*) FROM items UNION ALL SELECT 'artifact_workflow', count(*) FILTER (WHERE artifact_type = 'workflow') FROM items UNION ALL SELECT 'artifact_schema_template', count(*) FILTER (WHERE artifact_type = 'contract') FROM items UNION ALL SELECT unnest(['artifact_contract', 'symbol', 'task_state_anchor']), 0) SELECT * FROM k")
def node_counts(spark, sf_dir):
    found = graph.nodes(items(spark, sf_dir), spark.createDataFrame([], "path string, symbol string"))
    return graph.type_counts(found, "node_type", graph.NODE_TYPES).select("node_type", "n")


@query("""
WITH e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'imports' AS t FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'depends_on' FROM orders),
r0 AS (SELECT 'r0' AS node, 0 AS distance, 0 AS cost), r1 AS (SELECT dst AS node, 1 AS distance, 2 AS cost FROM r0 JOIN e ON e.src = r0.node),
r2 AS (SELECT dst AS node, 1 AS distance, 2 AS cost FROM r1 JOIN e ON e.src = r1.node), r3 AS (SELECT dst AS node, 2 AS distance, 4 AS cost FROM r2 JOIN e ON e.src = r2.node)
SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3
""")
def graph_bfs_2hop(spark, sf_dir):
    edge = lambda name, a, b, kind: table(spark, sf_dir, name).select(F.concat(F.lit(a[0]), a[1]).alias("src"), F.concat(F.lit(b[0]), b[1]).alias("dst"), F.lit(kind).alias("edge_type"))
    edges = edge("nation", ("r", "n_regionkey"), ("n", "n_nationkey"), "imports").union(edge("customer", ("n", "c_nationkey"), ("c", "c_custkey"), "contains"))
    edges = edges.union(edge("orders", ("c", "o_custkey"), ("o", "o_orderkey"), "depends_on"))
    start = spark.createDataFrame([("r0", "direct_path")], "node string, reason string")
    return graph.search(edges, start, 2).select("node", "distance", "cost")


@query("""
WITH m AS (SELECT lower(replace(t, ' ', '.')) AS module, min(p_partkey) AS k FROM (SELECT p_type AS t, p_partkey FROM part UNION ALL SELECT string_split(p_type, ' ')[1], p_partkey FROM part) GROUP BY 1),
i AS (SELECT p_partkey, lower(replace(p_type, ' ', '.')) || '.x' AS w FROM part),
j AS (SELECT p_partkey, m.module, row_number() OVER (PARTITION BY p_partkey ORDER BY length(m.module) DESC) AS n FROM i JOIN m ON starts_with(i.w, m.module || '.'))
SELECT DISTINCT 'part/' || p_partkey AS src, 'module/' || module AS dst FROM j WHERE n = 1
""")
def import_prefix_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    dotted = F.lower(F.translate("p_type", " ", "."))
    modules = part.select(F.explode(F.array(dotted, F.substring_index(dotted, ".", 1))).alias("module")).distinct().select("module", F.concat(F.lit("module/"), "module").alias("path"))
    wanted = part.select(F.concat(F.lit("part/"), "p_partkey").alias("path"), F.array(F.concat(dotted, F.lit(".x"))).alias("wanted"))
    return graph.resolve_imports(wanted, modules)


# Paths and texts of the corpus view with shared names (SKILL.md, manifest.schema.json) and texts that name them.
_renamed = {"ord % 30 = 1": "concat('templates/', lang, '/d', ord, '/manifest.schema.json')", "ord % 20 = 9": "concat(source, '/k', ord, '/SKILL.md')"}
_named = {"ord % 7 = 2": "concat(' schemas/', source, '_', ord - 2, '.json')", "ord % 7 = 3 AND ord % 10 <> 2": "' the manifest'", "ord % 7 = 4": "' see skill.md'", "ord % 21 = 5": "concat('templates/', lang, '/d', ord + 5, '/manifest.schema.json')"}


def _cases(cases: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


_view = sql.CATALOG.replace("corpus AS (", "plain AS (", 1).replace(", items AS (", f", corpus AS (SELECT ord, {_cases(_renamed, 'path')} AS path, content || {_cases(_named, chr(39) * 2)} AS content, lang, source FROM plain), items AS (", 1)
_words = "list_distinct(list_filter(list_concat([lower(path), lower({0}), replace(lower({1}), '.', '_'), replace(lower({1}), '.', '')], CASE WHEN contains(lower(path), 'manifest.schema') THEN {2} ELSE [] END, CASE WHEN lower({0}) = 'skill.md' THEN {3} ELSE [] END), lambda x: length(x) >= 3))".format(
    sql.NAME, sql.STEM, sql.array("manifest schema status paths artifacts".split()), sql.array("skill handoff preview confirm".split())
)


@query(f"""
WITH {_view}, w AS (SELECT *, lower(content) AS low, CASE WHEN artifact_type <> 'contract' THEN NULL WHEN lower({sql.NAME}) = 'skill.md' THEN 'artifact_contract' ELSE 'artifact_schema_template' END AS kind FROM items),
r AS (SELECT *, coalesce(CASE artifact_type WHEN 'workflow' THEN 'artifact_workflow' END, kind, 'file') || ':' || path AS node, artifact_type = 'workflow' AND {sql.any_of('low', select.CONSUMES)} AS reads FROM w WHERE kind IS DISTINCT FROM 'artifact_schema_template'),
t AS (SELECT kind AS to_kind, kind || ':' || path AS dst, unnest({_words}) AS term FROM w WHERE kind IS NOT NULL),
n AS (SELECT to_kind, term FROM t GROUP BY to_kind, term HAVING count(*) > 1),
m AS (SELECT to_kind, dst, string_agg(term, chr(10) ORDER BY term) AS mark FROM t JOIN n USING (to_kind, term) GROUP BY to_kind, dst),
g AS (SELECT dst, 'group:' || to_kind || ':' || sha256(mark) AS unit FROM m WHERE (to_kind, mark) IN (SELECT (to_kind, mark) FROM m GROUP BY to_kind, mark HAVING count(*) > 1)),
p AS (SELECT r.node, r.artifact_type, r.kind, t.to_kind, t.dst, any_value(g.unit) AS unit, bool_or(n.term IS NOT NULL) AS shared
  FROM r JOIN t ON NOT reads AND r.node <> t.dst AND contains(r.low, t.term) LEFT JOIN n ON n.to_kind = t.to_kind AND n.term = t.term LEFT JOIN g ON g.dst = t.dst GROUP BY r.node, r.artifact_type, r.kind, t.to_kind, t.dst),
e AS (SELECT DISTINCT node, CASE WHEN shared AND unit IS NOT NULL THEN unit ELSE dst END AS dst, CASE WHEN kind = 'artifact_contract' THEN CASE WHEN to_kind <> kind THEN 'constrains' END
  WHEN artifact_type = 'workflow' THEN 'consumes' WHEN to_kind = 'artifact_schema_template' THEN 'depends_on' END AS edge_type FROM p)
SELECT CASE WHEN dst LIKE 'group:%' THEN node ELSE least(node, dst) END AS src, CASE WHEN dst LIKE 'group:%' THEN dst ELSE greatest(node, dst) END AS dst, edge_type FROM e WHERE edge_type IS NOT NULL
UNION ALL SELECT node, '{graph.ALL_CONTRACTS}', 'consumes' FROM r WHERE reads
UNION ALL SELECT unit, dst, '{graph.MEMBER}' FROM g UNION ALL SELECT DISTINCT '{graph.ALL_CONTRACTS}', dst, '{graph.MEMBER}' FROM t
""")
def reference_edges(spark, sf_dir):
    """References between items, some of which share names; with groups, members and edges of all types but imports and contains."""
    rows = corpus(spark, sf_dir)
    rows = rows.withColumns({"path": F.expr(_cases(_renamed, "path")), "content": F.concat("content", F.expr(_cases(_named, "''")))})
    return graph.undirected(graph.reference_edges(catalog.catalog(rows)))


_stripped = sql.strip("line")


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, CAST(seg AS BIGINT) AS seg, {sql.units(_stripped)} AS units, length(line) % 5 AS priority FROM l WHERE {_stripped} <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, seg) AS k FROM s),
f AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS units, []::BIGINT[] AS taken FROM r
  UNION ALL SELECT doc_id, k, CASE WHEN fits THEN used + more ELSE used END, CASE WHEN fits THEN units + own ELSE units END, CASE WHEN fits THEN list_append(taken, seg) ELSE taken END FROM (
    SELECT f.doc_id, r.k, f.used, f.units, f.taken, r.seg, CAST(ceil(r.units / 4.0) AS BIGINT) + CASE WHEN len(f.taken) > 0 THEN 1 ELSE 0 END AS more, r.units + CASE WHEN len(f.taken) > 0 THEN 2 ELSE 0 END AS own, f.used + more <= 600 AS fits
    FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1)),
e AS (SELECT doc_id, arg_max(taken, k) AS taken, arg_max(units, k) AS units FROM f GROUP BY doc_id)
SELECT doc_id, len(taken) AS n, CAST(ceil(units / 4.0) AS BIGINT) AS n_tokens, array_to_string(list_sort(taken), ' ') AS anchors FROM e WHERE len(taken) > 0
""")
def greedy_pack_first_fit(spark, sf_dir):
    """Of each document the lines that are taken, by a made-up priority."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("seg", "text"))
    segs = lines.select("path", "seg", F.col("seg").cast("string").alias("anchor"), "text", (F.length("text") % 5).alias("priority"))
    return pack.greedy(segs, 600).select(F.col("path").alias("doc_id"), F.size("anchors").cast("bigint").alias("n"), text.estimate_tokens("excerpt").alias("n_tokens"), F.array_join("anchors", " ").alias("anchors"))


_origin = "CASE ord % 11 WHEN 0 THEN 'must_include' WHEN 1 THEN 'mentioned' ELSE 'auto' END"


@query(f"""
WITH {sql.CATALOG}, o AS (SELECT *, {_origin} AS origin, {sql.units('content')} AS units FROM items),
f AS (SELECT *, origin <> 'must_include' AND artifact_type <> 'contract' AS free FROM o),
r AS (SELECT *, sum(units) OVER (PARTITION BY ord // 50) AS total, coalesce(sum(units) OVER (PARTITION BY ord // 50 ORDER BY CASE WHEN free THEN 0 ELSE 1 END, CASE origin WHEN 'auto' THEN 0 WHEN 'mentioned' THEN 1 ELSE 2 END, {sql.DROP_ORDER}, n_tokens DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT ord // 50 AS bundle, path, free AND ceil((total - before) / 4.0) > 5000 AS dropped FROM r
""")
def drop_until_fit(spark, sf_dir):
    """A bundle of every fifty items."""
    rows = items(spark, sf_dir).withColumns({"origin": F.expr(_origin), "units": text.quarter_units("content"), "bundle": F.expr("ord div 50")})
    return pack.drop_until_fit(rows, ["bundle"], 5000).select("bundle", "path", "dropped")


@query(f"""
WITH RECURSIVE b AS (SELECT doc_id, 0 AS k, greatest({pack.FLOOR}, {sql.tokens('text')}) AS budget FROM documents
  UNION ALL SELECT doc_id, k + 1, greatest({pack.FLOOR}, budget - greatest(1, budget // {pack.SHRINK})) FROM b WHERE budget > {pack.FLOOR})
SELECT doc_id, k, budget FROM b
""")
def budget_sequence(spark, sf_dir):
    """Every document's budgets, from its own size down."""
    start = F.greatest(F.lit(pack.FLOOR).cast("bigint"), text.estimate_tokens("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pack.budgets(start)).alias("k", "budget"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up selection: what stands for a packed bundle per language."""
    marks = {"included": F.col("ord") % 5 != 3, "promoted": F.col("ord") % 4 == 0, "priority": (F.col("ord") % 3).cast("int"), "fallback": F.col("ord") % 9 == 0, "explained": F.col("ord") % 2 == 0}
    rows = items(spark, sf_dir).withColumns(marks)
    more = {"strategy": extract.strategy("path"), "compaction": F.when(F.col("ord") % 6 == 0, "typed_digest_compaction").otherwise("none"), "anchors": F.when(F.col("ord") % 8 > 0, F.array("lang", F.col("ord").cast("string"))).otherwise(F.array().cast("array<string>"))}
    return rows.withColumns(more)


_strategy = f"CASE WHEN lower({sql.SUFFIX}) = '.py' THEN 'symbol_extract' WHEN lower({sql.SUFFIX}) IN ('.md', '.rst') THEN 'section_extract' WHEN lower({sql.SUFFIX}) IN ('.json', '.yaml', '.yml', '.toml') THEN 'key_block_extract' ELSE 'full_text' END"
_chosen = f"chosen AS (SELECT *, ord % 5 <> 3 AS included, ord % 4 = 0 AS promoted, ord % 3 AS priority, ord % 9 = 0 AS fallback, ord % 2 = 0 AS explained, {_strategy} AS strategy, CASE WHEN ord % 6 = 0 THEN 'typed_digest_compaction' ELSE 'none' END AS compaction, CASE WHEN ord % 8 > 0 THEN [lang, ord::VARCHAR] ELSE []::VARCHAR[] END AS anchors FROM items)"
_group = "CASE WHEN NOT included THEN 'attachments' WHEN artifact_type IN ('contract', 'workflow') THEN artifact_type WHEN artifact_type IN ('selection_logic', 'code_snippet') THEN 'code' ELSE 'supporting' END"


@query(f"""
WITH {sql.CATALOG}, {_chosen}, g AS (SELECT *, {_group} AS bundle_group FROM chosen),
k AS (SELECT *, CASE bundle_group WHEN 'contract' THEN CASE WHEN contains(lower(path), 'schema') THEN 0 WHEN contains(lower(path), 'template') THEN 1 WHEN regexp_matches(lower(path), 'policy|status|manifest|openai|skill') THEN 2 ELSE 3 END
  WHEN 'workflow' THEN CASE WHEN contains(lower(path), 'confirm') THEN 0 WHEN regexp_matches(lower(path), 'preview|prepare|workflow') THEN 1 ELSE 2 END
  WHEN 'code' THEN CASE WHEN promoted THEN 0 ELSE 1 END WHEN 'supporting' THEN CASE WHEN regexp_matches(lower(path), 'problem|overview|research') THEN 0 ELSE 1 END ELSE 0 END AS a,
  CASE bundle_group WHEN 'code' THEN CASE WHEN artifact_type = 'selection_logic' THEN 0 ELSE 1 END WHEN 'attachments' THEN 0 ELSE priority END AS b FROM g)
SELECT path, bundle_group, row_number() OVER (PARTITION BY bundle_group ORDER BY a, b, path) AS place FROM k
""")
def bundle_groups(spark, sf_dir):
    return report.grouped(_selected(spark, sf_dir)).select("path", "bundle_group", F.col("place").cast("bigint").alias("place"))


_n = "count(*) FILTER (WHERE included)"
_pct = lambda cond: f"CAST(round_even(100.0 * count(*) FILTER (WHERE included AND {cond}) / greatest({_n}, 1), 0) AS INTEGER)"
_shaped = f"strategy IN ({sql.texts(report.STRUCTURED)})"


@query(f"""
WITH {sql.CATALOG}, {_chosen}
SELECT lang, count(*) FILTER (WHERE included AND artifact_type = 'contract') AS contract_coverage, count(*) FILTER (WHERE included AND artifact_type = 'workflow') AS workflow_coverage,
  {_pct(_shaped + " AND compaction = 'none'")} AS structured_extract_ratio, {_pct('fallback')} AS fallback_ratio,
  bool_and(NOT (included AND len(anchors) = 0 AND ({_shaped} OR compaction = 'typed_digest_compaction' AND artifact_type <> 'contract'))) AS anchor_fidelity,
  CASE WHEN {_n} = 0 THEN 100 ELSE {_pct('explained')} END AS explanation_coverage, true AS budget_compliance, true AS bundle_order_valid
FROM chosen GROUP BY lang
""")
def quality_metrics(spark, sf_dir):
    return report.quality(_selected(spark, sf_dir), F.lit(10), F.lit(20), ["lang"])


@query(f"WITH {sql.CATALOG}, {_chosen}, l AS (SELECT CASE WHEN NOT included THEN 'attachments' WHEN artifact_type = 'contract' THEN 'stable_contract' ELSE 'evidence' END AS layer FROM chosen) SELECT layer, count(*) AS n FROM l GROUP BY layer UNION ALL SELECT 'dynamic_task', 0")
def layer_counts(spark, sf_dir):
    return report.layer_counts(_selected(spark, sf_dir))


@query(f"""
WITH {sql.CATALOG}, {_chosen}, a AS (SELECT source, ord, generate_subscripts(anchors, 1) AS pos, unnest(anchors) AS anchor FROM chosen WHERE included),
f AS (SELECT source, anchor, min(ord * 10 + pos) AS k FROM a GROUP BY source, anchor), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS n FROM f)
SELECT source, string_agg(anchor, ' ' ORDER BY n) AS anchors FROM r WHERE n <= {report.ANCHORS} GROUP BY source
""")
def top_anchors(spark, sf_dir):
    return report.top_anchors(_selected(spark, sf_dir), ["source"]).select("source", F.array_join("anchors", " ").alias("anchors"))


_trimmed = "list_filter(list_transform(list(' ' || text || chr(9) ORDER BY turn), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '')"


@query(f"WITH t AS (SELECT conv_id, {_trimmed} AS v FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS said FROM t")
def ordered_dedupe(spark, sf_dir):
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: F.concat(F.lit(" "), s["text"], F.lit("\t")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("v")).select("conv_id", F.array_join(text.dedupe("v"), "|").alias("said"))


@query(f"SELECT page_id, array_to_string(list_filter({sql.array(pack.SCHEMA_TOKENS)}, lambda t: contains(html || ' status preview', t)), ' ') AS tokens FROM pages")
def critical_tokens(spark, sf_dir):
    found = pack.critical_tokens(F.lit("schemas/x.json"), F.concat("html", F.lit(" status preview")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, " ").alias("tokens"))


_slug = f"regexp_replace(regexp_replace(lower({sql.strip('text')}), '[^A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"SELECT doc_id, coalesce(nullif(regexp_replace(left({_slug}, 40), '_+$', ''), ''), 'bundle') AS slug FROM documents")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slug("text").alias("slug"))


_brief = sql.squeeze("regexp_replace(text, '#+\\s*', '', 'g')")


@query(f"WITH b AS (SELECT doc_id, {_brief} AS s FROM documents), f AS (SELECT doc_id, s, length(list_filter(range(1, 157), lambda n: length(left(s, n)) = n AND n + 3 * length(regexp_replace(left(s, n), '[\\x00-\\x7F]', '', 'g')) <= 156)) AS n FROM b) SELECT doc_id, CASE WHEN {sql.tokens('s')} <= 40 THEN s ELSE regexp_replace(left(s, n), '{sql.WHITE}+$', '') || '...' END AS brief FROM f")
def briefs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.brief("text", 40).alias("brief"))


_symbols = (
    ("'<imports>'", "'import os'", "''", "'imports'", "'import os'"),
    ("'P' || p_partkey", "'class P' || p_partkey || ':' || chr(10) || '    def size(self):' || chr(10) || '        return ' || p_size", "'class P' || p_partkey || ':'", "anchor", "'class P' || p_partkey || ':'"),
    ("'P' || p_partkey || '.size'", "'def size(self):' || chr(10) || '        return ' || p_size", "'def size(self):'", "anchor", "'def size(self):'"),
    ("'make'", "'def make():' || chr(10) || '    \"Makes it.\"' || chr(10) || '    return P' || p_partkey || '()'", "'Makes it. Calls: P' || p_partkey || '.'", "anchor", "'def make():'"),
)
_rows = " UNION ALL ".join(f"SELECT p_partkey || '.py' AS path, {i} AS seg, {a} AS anchor, {t} AS text, {h} AS hint, {c} AS scored, {n} AS snippet FROM part" for i, (a, t, h, c, n) in enumerate(_symbols))


@query(f"""
WITH r AS ({_rows})
SELECT path, seg, anchor, text, CASE WHEN seg = 0 THEN 'What the module imports.' ELSE anchor || ': ' || {sql.first_sentence('hint', 120)} END AS summary,
  {sql.anchor_score('scored', 'hint', TERMS, "'contract'")} AS priority, snippet FROM r
""")
def python_ast_segments(spark, sf_dir):
    """Generated sources, one per part: segments of their symbols."""
    code = "'import os\\n\\nclass P' || p_partkey || ':\\n    def size(self):\\n        return ' || p_size || '\\n\\ndef make():\\n    \"Makes it.\"\\n    return P' || p_partkey || '()\\n'"
    return extract.segments(_parts(spark, sf_dir, code, ".py"), words(TERMS))


@query()
def excerpt_ladder(spark, sf_dir):
    rows = pack.excerpts(items(spark, sf_dir).select("path", "content", "artifact_type"), words(TERMS), 120)
    return rows.select("path", "excerpt.strategy", "excerpt.compaction", "excerpt.method", "excerpt.truncated", text.estimate_tokens("excerpt.text").alias("n_tokens"), F.size("excerpt.anchors").alias("n_anchors"))


@query(f"WITH {sql.CATALOG}, {_chosen} SELECT path, file_type, artifact_type, {sql.of_kind(2)} AS context_layer, included, promoted, priority::INTEGER AS priority, n_tokens, array_to_string(anchors, ' ') AS anchors, explained FROM chosen")
def manifest_projection(spark, sf_dir):
    return report.published(_selected(spark, sf_dir)).withColumn("anchors", F.array_join("anchors", " "))


#: A request over the documents' corpus.
REQUEST = Request(
    "review", "Overview of the docs", "Which schema does the workflow read?", focus_points=("schema paths",), questions=("What is in wf_12?",), known_routes=("read templates first",),
    must_include=("README_9.md", "docs/en"), must_exclude=("docs/en/d_15.md",), mentioned_paths=("conf",), background="See README_19.md and workflow.py", max_files=40,
)
_said = " ".join([REQUEST.topic, REQUEST.goal, *REQUEST.focus_points, *REQUEST.questions, *REQUEST.known_routes]).lower()


@query(f"""
WITH {sql.CATALOG}, {sql.scored(LANES)}
SELECT 'file:' || path AS node, CASE WHEN path IN ({sql.texts([*REQUEST.must_include, *REQUEST.mentioned_paths])}) THEN 'direct_path' WHEN artifact_type = 'contract' THEN 'contract_anchor' WHEN artifact_type = 'workflow' THEN 'workflow_anchor'
  WHEN artifact_type = 'supporting_context' THEN 'task_anchor' ELSE 'code_anchor' END AS reason FROM hit
WHERE path IN ({sql.texts([*REQUEST.must_include, *REQUEST.mentioned_paths])}) OR artifact_type = 'contract' AND len(contract_hits) > 0 OR artifact_type = 'workflow' AND len(contract_hits) + len(code_hits) > 0
  OR artifact_type IN ('selection_logic', 'code_snippet') AND len(code_hits) > 0 OR artifact_type = 'supporting_context' AND len(task_hits) > 0
UNION ALL SELECT 'symbol:' || path || ':wf_12', 'symbol_anchor' FROM items WHERE artifact_type = 'workflow'
""")
def selection_seeds(spark, sf_dir):
    """Anchors of a request; each workflow has a symbol that the request names after one that it does not."""
    rows = score.scored(items(spark, sf_dir), LANES)
    symbols = rows.where("artifact_type = 'workflow'").select("path", F.posexplode(F.array(*map(F.lit, ("wf_1", "wf_12", "workflow")))).alias("ord", "symbol"))
    return graph.seeds(rows, [*REQUEST.must_include, *REQUEST.mentioned_paths], symbols, _said)


_types = {"constrains": 2, "consumes": 3, "depends_on": 5, "imports": 7}
_gains = " + ".join(
    f"CASE WHEN ord % {_types[e]} = 0 AND ord % 13 > 1 THEN CASE WHEN artifact_type IN ({sql.texts(kinds)}) THEN {high} ELSE {low} END ELSE 0 END" for e, (high, low, kinds) in score.EDGE_BONUS.items()
)


@query(f"""
WITH {sql.CATALOG}, g AS (SELECT *, {_gains} AS gained FROM items)
SELECT path, CASE WHEN ord % 13 = 0 OR ord % 13 > 1 AND ord % 2 > 0 AND ord % 3 > 0 AND ord % 5 > 0 AND ord % 7 > 0 THEN 0 WHEN ord % 13 = 1 THEN CASE artifact_type WHEN 'contract' THEN 70 WHEN 'workflow' THEN 55 ELSE 30 END
  ELSE CASE artifact_type WHEN 'supporting_context' THEN least(gained, 45) WHEN 'contract' THEN gained + 25 WHEN 'workflow' THEN gained + 20 ELSE gained END END AS bonus FROM g
""")
def graph_bonuses(spark, sf_dir):
    """What made-up paths add to the items' scores: none, an anchor itself, or some kinds of edges."""
    types = F.array_compact(F.array(*(F.when(F.col("ord") % n == 0, e) for e, n in _types.items())))
    types = F.when(F.col("ord") % 13 == 0, F.array().cast("array<string>")).when(F.col("ord") % 13 == 1, F.array(F.lit("direct_anchor"))).otherwise(types)
    return items(spark, sf_dir).select("path", score.graph_bonus(types, F.col("artifact_type")).alias("bonus"))


@query("""
WITH e AS (SELECT 'w' || c_custkey AS src, 'c' || n_nationkey AS dst FROM customer, nation)
SELECT 'consumes' AS edge_type, count(*) + (SELECT count(*) FROM orders) AS n FROM e UNION ALL SELECT 'imports', count(*) FROM nation UNION ALL SELECT unnest(['contains', 'constrains', 'depends_on']), 0
""")
def edge_type_counts(spark, sf_dir):
    """Edges by type, where each customer consumes all nations as a group."""
    edge = lambda rows, a, b, kind: rows.select(F.concat_ws("", *a).alias("src"), F.concat_ws("", *b).alias("dst"), F.lit(kind).alias("edge_type"))
    nation, group = table(spark, sf_dir, "nation"), [F.lit(graph.ALL_CONTRACTS)]
    edges = edge(nation, [F.lit("r"), "n_regionkey"], [F.lit("n"), "n_nationkey"], "imports").union(edge(nation, group, [F.lit("c"), "n_nationkey"], graph.MEMBER))
    edges = edges.union(edge(table(spark, sf_dir, "customer"), [F.lit("w"), "c_custkey"], group, "consumes"))
    edges = edges.union(edge(table(spark, sf_dir, "orders"), [F.lit("c"), "o_custkey"], [F.lit("o"), "o_orderkey"], "consumes"))
    return graph.edge_counts(edges).select("edge_type", "n")


@query()
def selected_items(spark, sf_dir):
    """The whole selection of a request over all documents."""
    chosen = pipeline.select_items(corpus(spark, sf_dir), REQUEST)
    return chosen.items.select("path", "origin", "artifact_type", "score", "priority", "promoted", "distance", F.array_join("path_types", " ").alias("path_types"))


@query()
def selected_bundle(spark, sf_dir):
    """The items of a request's bundle with their excerpts' sizes, groups and places."""
    request = replace(REQUEST, max_bundle_tokens=16000, must_include=("README_9.md",))
    made, _ = pipeline.bundle(pipeline.select_items(corpus(spark, sf_dir), request), request)
    return made.select("path", "included", "bundle_group", "place", "n_included", "excerpt.strategy", "excerpt.compaction", "excerpt.method")
