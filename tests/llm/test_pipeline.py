"""The numbered queries over whole tables, and the pipeline's stages, against SQL, libraries and plain Python."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm import decontam, piecebpe, queries, toxicity
from tests.llm.test_op4_op5_op6_op9 import plain_components, plain_dedup, plain_fingerprint, plain_tiles, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, lang, source, n_chars from read_parquet('{SF}/documents.parquet')").fetchall()


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(plain(r[c]) for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_fingerprints_and_components(spark, documents):
    prints = {d: plain_fingerprint(t) for d, t, *_ in documents}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op9_simhash"](spark, SF).collect()}
    roots = plain_components(prints)
    assert got == {d: (f"{p:016x}", roots[d]) for d, p in prints.items()}


def test_tokens(spark, documents):
    library = piecebpe.model(queries.vocabulary("piece_bpe_32k.model")).library
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op8_sentencepiece_bpe"](spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, t, *_ in documents:
        ids = [*library.encode(t or ""), library.eos_id()]
        assert got[d] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_every_query_returns_its_whole_table(spark, documents):
    n = len(documents)
    for name in ("op3_token_ids_orc", "op4_license_scan", "op7_toxicity"):
        assert queries.QUERIES[name](spark, SF).count() == n
    tiles = queries.QUERIES["op5_benchmark_tiling"](spark, SF)
    assert {tuple(r) for r in tiles.collect()} == leaks(documents)
    found = queries.QUERIES["op10_chroma_fingerprints"](spark, SF)
    assert found.where("kind = 'member'").count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def leaks(documents, benchmark=None):
    """Rows of benchmark_tiles by plain tiling of all pairs of a document and an item that share five words."""
    if benchmark is None:
        benchmark = duckdb.sql(f"select item_id, text from read_parquet('{SF}/benchmark.parquet')").fetchall()
    k, out = decontam.MIN_MATCH, set()
    items, index = [(i, words(t)) for i, t in sorted(set(benchmark))], {}
    for at, (_, w) in enumerate(items):
        for p in range(len(w) - k + 1):
            index.setdefault(tuple(w[p : p + k]), set()).add(at)
    for d, text, *_ in documents:
        w = words(text)
        met = [index.get(tuple(w[p : p + k]), ()) for p in range(len(w) - k + 1)]
        for at in set().union(*met):
            i, said = items[at]
            near = [p for p, known in enumerate(met) if at in known]
            keep = {q for p in near for q in range(p, p + k)}
            tiles = plain_tiles(said, [x if q in keep else "" for q, x in enumerate(w)] if len(w) < 400 else [w[q] if q in keep else "" for q in range(min(keep), max(keep) + 1)], k)
            covered = sum(n for *_, n in tiles)
            if covered >= decontam.THRESHOLD * len(said):
                out.add((d, i, len(said), covered, len(tiles), covered / len(said)))
    return out


def test_pipeline_stages(spark, documents, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    held = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted(map(tuple, docs.select(*names).collect()))
        if name == "toxicity":
            expect = [r for r in held if r[0] not in toxic]
        elif name == "line_dedup":
            kept = plain_dedup(held)
            expect = [(r[0], kept[r[0]][2], r[2], r[3], len(kept[r[0]][2])) for r in held]
        elif name == "simhash_near_dedup":
            roots = plain_components({r[0]: plain_fingerprint(r[1]) for r in held})
            expect = [r for r in held if roots[r[0]] == r[0]]
        elif name == "benchmark_decontamination":
            bad = {d for d, *_ in leaks(held)}
            expect = [r for r in held if r[0] not in bad]
        else:
            expect = held
            library = piecebpe.model(queries.vocabulary("piece_bpe_32k.model")).library
            for r in docs.collect():
                assert r.ids == [*library.encode(r.text), library.eos_id()] and r.decoded == library.decode(r.ids)
        assert got == sorted(expect), name
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
        held = got
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r[0] for r in held)


def test_stages_on_odd_rows(spark):
    rows = [(None, None, "a"), (None, "x y", "b"), (1, "", "c"), (1, "same text here", "d"), (1, "same text here", "e"), (2, "word " * 20000, "f"), (3, None, "g")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumns({c: F.lit(1) for c in ("score", "fp", "_copy", "__copy", "h1", "pos", "component_id", "_tie")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() <= len(rows) and set(odd.columns) <= set(out.columns), name
        assert dict(out.dtypes)["ids"] == "string"  # the caller's
        assert stage(spark, odd.limit(0), SF).count() == 0
        assert None in {r.doc_id for r in out.collect()} or name == "toxicity"
