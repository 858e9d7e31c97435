"""The numbered queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bytebpe, chat, chroma, decontam, divergence, filteraudit, grams, licenses, linededup, piecebpe, relativelz, simhash, toxicity, warc
from lodestack.llm.shared import new_path, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, which every machine has."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query(r"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(trim(role, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ''), 'unknown') AS speaker, coalesce(text, '') AS words FROM conversations),
n AS (SELECT *, CAST(floor(turn / 64) AS BIGINT) AS chunk, CASE WHEN turn IS NULL THEN substr(md5(speaker || words), 1, 2) ELSE '' END AS slice FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk, slice ORDER BY turn, speaker, words) AS rn FROM n),
v AS (SELECT r.*, CAST(floor((rn - 1) / 256) AS BIGINT) AS part, p.speaker AS perspective, r.speaker = p.speaker AS own,
    '<|im_start|>' || CASE WHEN r.speaker = 'system' THEN 'system' WHEN r.speaker = p.speaker THEN 'assistant'
      ELSE 'user name=' || regexp_replace(r.speaker, '[\x00-\x20<>|]+', '_', 'g') END || chr(10) AS head,
    regexp_replace(words, '<\|(im_start|im_end)\|>', '< |\1| >', 'g') || '<|im_end|>' AS body
  FROM r JOIN (SELECT DISTINCT conv_id, speaker FROM t WHERE speaker <> 'system') p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY chunk NULLS LAST, slice, part, rn) - length(body) - 1 AS start FROM v)
SELECT conv_id, perspective, chunk, slice, part, count(*) AS n_turns, CAST(min(start - length(head)) AS BIGINT) AS "offset", string_agg(head || body || chr(10), '' ORDER BY rn) AS text,
  coalesce(string_agg(start || '+' || length(body), ' ' ORDER BY rn) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, chunk, slice, part
""")
def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate(table(spark, sf_dir, "conversations"))
    return views.select(*views.columns[:-1], F.array_join(F.transform("spans", lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), " ").alias("mask"))


@query("""
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
""")
def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), out)
    return warc.page_report(warc.read_archives(spark, out))


@query()
def op3_token_ids_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-ids")
    bytebpe.write_ids(table(spark, sf_dir, "documents"), out, vocabulary("byte_bpe_50k.json"), end=2)
    return bytebpe.positions(bytebpe.read_ids(spark, out))


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query()
def op5_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.benchmark_tiles(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "covered", F.size("tiles").alias("n_tiles"), "coverage")


@query("""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT doc_id, pos, line,
        translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.pos, k.line, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS dropped FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id
""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams.bounded_batches(spark)
    path = vocabulary("piece_bpe_32k.model")
    coded = table(spark, sf_dir, "documents").select("doc_id", piecebpe.encode(F.col("text"), path).alias("ids"))
    said = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    decoded = F.sha2(piecebpe.decode(F.col("ids"), path), 256)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), said.alias("ids_sha256"), decoded.alias("decoded_sha256"))


@query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op10_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 'member': vec_id and its class_id; rows 'match': a class (vec_id) at an offset of a query's class (class_id)."""
    vectors = table(spark, sf_dir, "embeddings")
    members, matches = chroma.align(chroma.recordings_of(vectors, "vec_id", chroma.play(F.col("embedding"))), F.col("id") % 100 == 0)
    members = members.select(F.lit("member").alias("kind"), F.col("id").alias("vec_id"), "class_id")
    matches = matches.select(F.lit("match").alias("kind"), F.col("class_id").alias("vec_id"), F.col("query_class").alias("class_id"), "offset", "overlap", "bit_errors")
    return members.unionByName(matches, allowMissingColumns=True)


@query(r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY t.lang, t.source, t.term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 2) // (coalesce(n.n, 0) + 2 * v.v) AS BIGINT) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT x.lang, x.term, CAST(1 + CAST(1000000000 AS HUGEINT) * (x.c + 2) // (y.n + 2 * v.v) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term) x JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY lang) y USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
""")
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, start, array_to_string(words[start : start + 12], ' ') AS said
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS start FROM d WHERE len(words) >= 13)),
m AS (SELECT said, min(doc_id) AS least FROM w GROUP BY said HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT w.doc_id, unnest(generate_series(w.start, w.start + 12)) AS place FROM w JOIN m ON w.said = m.said AND m.least < w.doc_id),
p AS (SELECT doc_id, generate_subscripts(words, 1) AS place, unnest(words) AS word FROM d),
k AS (SELECT p.doc_id, count(*) AS n_words, count(x.place) AS n_removed, string_agg(p.word, ' ' ORDER BY p.place) FILTER (WHERE x.place IS NULL) AS kept
  FROM p LEFT JOIN x ON p.doc_id = x.doc_id AND p.place = x.place GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""")
def op12_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relativelz.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query(r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), t.doc_id > min(t.doc_id) OVER (PARTITION BY text)] AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
a AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM a, a b, a c, a d, a e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, i AS step, ord[i] AS filter, ord[1 : i - 1] AS before FROM o, a),
x AS (SELECT m.part, s.ord, s.step, s.filter, m.n, m.good, m.toxic, m.fails[s.filter] AS fail, len(list_filter(s.before, lambda b: m.fails[b])) = 0 AS here, len(list_filter(m.fails, lambda b: b)) AS n_fails FROM m, s),
r AS (SELECT part, list_aggregate(list_transform(ord, lambda b: substr('ABCDE', b, 1)), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step, filter,
    coalesce(sum(n) FILTER (WHERE here AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (WHERE here AND fail), 0) AS removed, coalesce(sum(n) FILTER (WHERE NOT here AND fail), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fail AND n_fails = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE here AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE here AND fail), 0) AS toxic_lost
  FROM x GROUP BY part, ord, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
