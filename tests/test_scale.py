"""Steps whose cost must grow no faster than their input."""

import os
import random
import re
import time

from pyspark.sql import functions as F

from lodestack.frames import run_dir
from lodestack.functions import match, text
from lodestack.operators import catalog, extract, graph, score
from lodestack.plans import pipeline
from lodestack.request import Request


def test_many_terms_meet_only_what_begins_like_one(spark):
    """Words that begin like no term cost one pass, however many lengths the terms have."""
    rng = random.Random(3)
    said = ["".join(rng.choice("qrs") for _ in range(n)) for n in range(8, 68) for _ in range(3)]
    words = ["".join(rng.choice("0123456789abc") for _ in range(240)) for _ in range(20_000)]
    rows = [(i, " ".join(words[i::200]) + " " + said[i % len(said)] + "!") for i in range(200)]
    texts, terms = spark.createDataFrame(rows, "id int, content string"), spark.createDataFrame([(t,) for t in said], "term string")
    began = time.time()
    got = {tuple(r) for r in match.contained(texts, "content", terms, limit=0).collect()}
    assert time.time() - began < 30
    assert got == {(i, t) for i, c in rows for t in set(said) if t in c[-80:]}


def test_texts_of_a_small_file_are_read_by_all_cores(spark):
    """Parsing costs by the row: rows that come as one partition don't stay one task."""
    rows = spark.createDataFrame([(f"{i}.py", "contract", f"def f{i}():\n    pass") for i in range(2000)], "path string, artifact_type string, content string").coalesce(1)
    found = extract.segments(rows, text.words(["f1"]))
    sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 2000 and len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 500


def test_slugs_take_no_more_than_the_text_they_need(spark):
    """Equal to whole texts worked on in plain Python, and quick where blanks fill long texts."""
    rng = random.Random(5)
    rows = ["".join(rng.choice("aB9_ -.漢é\u0130\u212a\n\u3000") for _ in range(rng.randint(0, 150))) for _ in range(300)]
    rows += ["", " ", "--", "_a_", "a" * 50, "a" * 39 + "--b", "a" * 40 + "--b", "." * 500 + "x", None]
    blank = "a" + " " * 400_000
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*rows, blank + "b", blank])], "i int, v string")
    began = time.time()
    got = dict(df.select("i", text.slug("v")).collect())
    assert [r[0] for r in df.select(text.strip("v")).where("i >= %d" % len(rows)).orderBy("i").collect()] == [blank + "b", "a"]
    assert time.time() - began < 20
    plain = lambda v: re.sub("_+$", "", re.sub("[^A-Za-z0-9一-鿿]+", "_", (v or "").lower()).strip("_")[:40]) or "bundle"
    assert got == {i: plain(v) for i, v in enumerate([*rows, blank + "b", blank])}


def test_facts_are_parsed_once_and_the_catalog_is_read_by_columns(spark):
    rows = spark.createDataFrame([("a.py", "import b\ndef f(): pass"), ("b.py", "x = 1"), ("docs/c.md", "# C")], "path string, content string")
    symbols, imports = extract.facts(rows)
    assert [tuple(r) for r in symbols.collect()] == [("a.py", 0, "f")] and imports.first().wanted == ["b"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not any("ArrowEvalPython" in plan(x) for x in (symbols, imports))
    counts = pipeline.select_items(rows, Request("review", "b", "f?")).counts
    assert tuple(counts.first()) == (3, 0) and "content" not in plan(counts)


def test_a_promotion_of_a_scored_item_is_its_score_with_a_reason(spark):
    paths = ["README.md", "docs/a.md", "schemas/x.json", "p/workflow.py", "p/selector.py", "q.py", "docs/overview.md"]
    rows = catalog.catalog(spark.createDataFrame([(p, "", why) for p in paths for why in (None, "It is so.")], "path string, content string, why string"))
    lanes = {"task": ["docs", "overview"], "contract": ["schema"], "code": ["workflow", "selector"]}
    some = lambda df: sorted((r.path, r.why or "", r.score, r.reason) for r in df.collect())
    assert some(score.promoted(score.scored(rows, lanes), "why")) == some(score.scored(rows, lanes, reason="why"))


def test_a_selection_keeps_no_copy_of_the_texts_and_no_path_that_no_one_asks_for(spark):
    """What is saved has what was found in texts, not the texts; paths of the graph are put together for chosen items only, when they are asked for."""
    rows = [("a.py", "import b\ndef f(): pass"), ("b.py", "x = 1"), ("p/workflow.py", "import a\n# schemas/c.json"), ("schemas/c.json", "{}"), ("docs/d.md", "# workflow"), ("data/e.md", "x")]
    folder = run_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    chosen = pipeline.select_items(spark.createDataFrame(rows, "path string, content string"), Request("review", "workflow", "What does the workflow read?", must_include=("b.py",)))
    new = set(os.listdir(folder)) - before
    assert len(new) > 2 and not any("content" in spark.read.parquet(f"{folder}/{n}").columns for n in new)
    assert {r.path: r.content for r in chosen.items.collect()} == dict(rows[:5])
    assert "explanations" not in vars(chosen)
    told = {r.path: r for r in chosen.explanations.collect()}
    assert told and all(r.nodes and len(r.edge_types) == min(len(r.nodes) - 1, graph.SHOWN_EDGES) for r in told.values())


def test_the_nearest_items_and_traced_paths_are_those_of_all_paths(spark):
    rng = random.Random(11)
    for case in range(2):
        paths = [f"{rng.choice(['a', 'b:c', 'd/e'])}/{i}.py" for i in range(14)]
        kinds = [(f"artifact_workflow:{p}", "artifact_workflow", p) for p in paths[::3]]
        symbols = [(f"symbol:{p}:s{j}", "symbol", p) for p in paths[::2] for j in range(2)]
        dirs = [(f"dir:{d}", "dir", d) for d in ("a", "b:c", "d/e")]
        nodes = [(f"file:{p}", "file", p) for p in paths] + kinds + symbols + dirs
        edges = [(f"file:{p}", n, "contains") for n, _, p in kinds + symbols] + [(f"dir:{p.rpartition('/')[0]}", f"file:{p}", "contains") for p in paths if rng.random() < 0.3]
        others = [n for n, t, _ in nodes if t != "dir"]
        edges += [(*rng.sample(others, 2), rng.choice(graph.EDGE_TYPES[1:])) for _ in range(18)]
        edges += [(rng.choice(others[:20]), graph.ALL_CONTRACTS, "consumes") for _ in range(2)] + [(graph.ALL_CONTRACTS, n, graph.MEMBER) for n in others[-3:]]
        start = spark.createDataFrame([(n, "task_anchor") for n in rng.sample(others, 2)] if case else [], "node string, reason string")
        known = spark.createDataFrame(nodes, "node string, node_type string, path string")
        found = graph.Search(graph.undirected(spark.createDataFrame(edges, "src string, dst string, edge_type string")), start)
        for hops in (1, 2):
            want = graph.file_paths(found.paths(hops), known)
            some = ("path", "target_node", "distance", "cost", "reason", "path_types")
            near = found.nearest(hops)
            rows = lambda df, names: sorted(map(str, df.select(*names).collect()))
            assert rows(near, some) == rows(want, some) and bool(near.count()) == bool(case)
            traced = near.join(found.traced(near), ["target_node", "distance"])
            assert rows(traced, (*some, "nodes", "edge_types")) == rows(want, (*some, "nodes", "edge_types"))
        least = dict(found.nearest(2).select("path", "least_hops").collect())
        assert {p for p, n in least.items() if n < 2} == {r.path for r in found.nearest(1).collect()}


def test_sources_without_a_word_that_facts_need_are_not_parsed(monkeypatch):
    said = []
    monkeypatch.setattr(extract.ast, "parse", lambda t: said.append(t) or __import__("ast").Module([], []))
    for t in ("some prose, and no source", "x = 1", "def f(): pass"):
        extract.python_facts(t)
    assert said == ["def f(): pass"]
