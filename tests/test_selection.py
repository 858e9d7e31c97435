"""Whole selections, graphs, budgets and states against plain Python."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestack import frames
from lodestack.functions import match
from lodestack.functions.text import words
from lodestack.operators import extract, graph, pack, report
from lodestack.operators.catalog import catalog
from lodestack.plans import pipeline, queries
from lodestack.request import Request
from lodestack.sources.files import folder_corpus
from tests import plain_selection

SF = "/root/testdata/sf0.001"
#: Tokens of an excerpt in the query of ladders.
LIMIT = 120


@pytest.fixture(scope="module")
def corpus(spark):
    return {r.path: r.content for r in queries.corpus(spark, SF).select("path", "content").collect()}


def rows_of(df):
    return {r.path: tuple(r[c] for c in "origin artifact_type score priority promoted distance path_types".split()) for r in df.collect()}


def test_selected_items_against_plain_python(spark, corpus):
    got = rows_of(queries.QUERIES["selected_items"](spark, SF))
    want = plain_selection.selection(corpus, queries.REQUEST.normalized())
    assert {k: (*v[:6], v[6] or None) for k, v in got.items()} == want and len(want) == 40


@pytest.mark.parametrize("request_", [
    Request("review", "Schema", "Is the template right?", mentioned_paths=("src3/mod_14.py",), max_files=30, blockers=("import of src1/app.py",), must_exclude=("templates/*",)),
    Request("review", "Selector", "Which budget?", must_include=("src1/*", "none"), max_files=25, background="see app.py, SKILL.md and src1/app.py"),
])
def test_selections_of_sources_that_import_each_other(spark, corpus, request_):
    """Real sources, shared names, terms of contracts in texts, and requests that open two of the gates."""
    more = dict(corpus)
    for i in range(1, 6):
        more[f"src{i}/app.py"] = f"import src{i % 5 + 1}.lib\nfrom src{i}.helper import run, wf_12\n\ndef run_{i}():\n    return wf_12\n"
        more[f"src{i}/lib.py"] = f"from src{i % 5 + 1} import app\n\nclass Lib{i}:\n    schema = 'see SKILL.md'\n"
        more[f"src{i}/helper.py"] = "import os\nfrom .lib import Lib\n\ndef run():\n    pass\n"
        more[f"src{i}/workflow.py"] = f"import src{i}.app\n\ndef prepare():\n    return 'the {'manifest' if i % 2 else 'skill'}'\n"
        more[f"k{i}/SKILL.md"] = f"# Skill {i}\nreads templates/t{i}/manifest.schema.json and the artifacts\n"
        more[f"templates/t{i}/manifest.schema.json"] = '{"status": 1}'
    frame = spark.createDataFrame(list(more.items()), "path string, content string").repartition(6)
    chosen = pipeline.select_items(frame, request_).items
    got = rows_of(chosen.select("path", "origin", "artifact_type", "score", "priority", "promoted", "distance", F.array_join("path_types", " ").alias("path_types")))
    want = plain_selection.selection(more, request_.normalized())
    assert {k: (*v[:6], v[6] or None) for k, v in got.items()} == want and want


def test_reference_edges_are_all_pairs(spark):
    """Groups taken apart give every pair once, with shared names and words, several kinds of targets and texts that hold terms of all sorts."""
    rng = random.Random(3)
    paths = [f"t{i}/templates/{n}" for i in range(6) for n in ("manifest.schema.json", "x.json", f"own{i}.md")] + [f"s{i}/SKILL.md" for i in range(5)] + ["reply_template.md", "a/reply_template.md"]
    paths += [f"w{i}/workflow.py" for i in range(6)] + [f"m{i}.py" for i in range(12)]
    said = [*(p.split("/")[-1] for p in paths), *paths, "manifest", "handoff", "artifacts", "nothing", "template", "Final_Reply"]
    items = {p: " ".join(rng.sample(said, rng.randint(0, 3))) for p in paths}
    edges = graph.reference_edges(catalog(spark.createDataFrame(list(items.items()), "path string, content string")))
    rows = [tuple(r) for r in edges.collect()]
    members = {}
    for a, b, t in rows:
        if t == graph.MEMBER:
            members.setdefault(a, []).append(b)
    pairs = [(a, m, t) for a, b, t in rows if t != graph.MEMBER for m in (members[b] if b.startswith(graph.GROUP) else [b])]
    want = {e for e in plain_selection.pairs_of(items, set()) if e[2] != "contains"}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and {e[2] for e in want} == {"constrains", "consumes", "depends_on"}
    assert sum(g.startswith("group:artifact") for g in members) >= 3
    counts = {r.edge_type: r.n for r in graph.edge_counts(edges).collect()}
    assert {t: counts[t] for t in ("constrains", "consumes", "depends_on")} == {t: sum(e[2] == t for e in want) for t in ("constrains", "consumes", "depends_on")}


def test_edges_of_a_shared_name_grow_with_texts_and_targets(spark):
    items = [(f"t{i}/templates/manifest.schema.json", "{}") for i in range(60)] + [(f"m{i}.py", "the manifest and its status") for i in range(70)]
    edges = graph.reference_edges(catalog(spark.createDataFrame(items, "path string, content string")))
    assert edges.where("edge_type = 'depends_on'").count() == 70 and {r.edge_type: r.n for r in graph.edge_counts(edges).collect()}["depends_on"] == 4200


def test_search_paths_against_plain_python(spark):
    rng = random.Random(14)
    for _ in range(1):
        edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice(["contains", "contains", "imports", "depends_on", "consumes"])) for _ in range(50)}
        edges = [(min(a, b), max(a, b), t) for a, b, t in edges if a != b]
        edges += [(f"n{i}", f"deep{i}_0", "contains") for i in range(2)] + [(f"deep{i}_{k}", f"deep{i}_{k + 1}", "contains") for i in range(2) for k in range(20)]
        seeds = {"n0": "direct_path", "n1": "code_anchor", "away": "task_anchor"}
        frame = graph.undirected(spark.createDataFrame(edges, "src string, dst string, edge_type string"))
        start = spark.createDataFrame(list(seeds.items()), "node string, reason string")
        found = graph.Search(frame, start)
        for limit in (1, 2, 0):
            got = {r.node: (r.cost, r.distance, r.path, r.edge_types, r.reason) for r in found.paths(limit).collect()}
            want = {n: (c, h, p, t, r) for n, (c, h, _, _, p, t, r) in plain_selection.searched(edges, seeds, limit).items()}
            assert got == want
    assert graph.search(frame, start.limit(0)).count() == 0


def test_a_round_of_the_search_writes_what_it_reaches_first(spark):
    """No state is written twice, however many rounds there are."""
    edges = [(f"d{i}", f"d{i + 1}", "contains") for i in range(40)] + [(f"d{i}", f"x{i}", "depends_on") for i in range(0, 40, 5)]
    found = graph.Search(graph.undirected(spark.createDataFrame(edges, "src string, dst string, edge_type string")), spark.createDataFrame([("d0", "direct_path")], "node string, reason string")).to(2)
    states = [(r.node, r.hops) for level in found.levels for f in level for r in f.collect()]
    assert len(states) == len(set(states)) and len(found.levels[0]) == 41


def test_terms_in_a_word_of_a_million_characters(spark):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    said = [word[i : i + n] for i, n in zip(range(0, 900_000, 30_000), range(3, 43))] + ["xyz", "zz top", word[5:8] + "!", "aaaaaaaaaaaa"]
    texts, terms = spark.createDataFrame([(1, word), (2, "xyz"), (3, "a zz top b")], "id int, content string"), spark.createDataFrame([(t,) for t in said], "term string")
    match.contained(texts.limit(0), "content", terms).collect()
    began = time.time()
    got = {(r.id, r.term) for r in match.contained(texts, "content", terms).collect()}
    assert time.time() - began < 20
    assert got == {(1, t) for t in said if t in word} | {(2, "xyz"), (3, "zz top")}
    assert {(r.id, r.term) for r in match.contained(texts, "content", terms, limit=0).collect()} == got


def test_terms_beyond_the_automaton(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice("abc .\n漢") for _ in range(rng.choice((0, 5, 60, 900))))) for i in range(80)] + [(5, None), (6, "")]
    rows += [(200 + i, "".join(rng.choice("abc漢") for _ in range(rng.choice((255, 256, 257, 300, 2000))))) for i in range(20)]
    said = ["a b", "b.c", " ", "", *("".join(rng.choice("abc.漢") for _ in range(rng.randint(1, 6))) for _ in range(40)), rows[-1][1][240:290], rows[-2][1][100:250], rows[-3][1][:200]]
    texts, terms = spark.createDataFrame(rows, "id int, content string"), spark.createDataFrame([(t,) for t in said], "term string")
    want = {(i, t) for i, c in rows for t in said if t.strip() and t in (c or "")}
    for limit in (None, 0):
        got = [tuple(r) for r in match.contained(texts, "content", terms, limit=limit).collect()]
        assert set(got) == want and len(got) == len(want)


def items_frame(spark, n, seed):
    rng = random.Random(seed)
    said = lambda: " ".join(rng.choice(["alpha", "beta", "status", "漢字", "manifest,", "x" * 30]) for _ in range(rng.randint(1, 60)))
    rows = []
    for i in range(n):
        kind = rng.choice(["contract", "workflow", "selection_logic", "code_snippet", "supporting_context"])
        path = {"contract": f"schemas/s{i}.json", "workflow": f"w{i}/workflow.py", "supporting_context": f"d{i}.md"}.get(kind, f"c{i}.py")
        text = "\n".join([f"# Part {k}\n{said()}" for k in range(rng.randint(1, 8))]) if path.endswith(".md") else "\n\n".join(f"def f{k}():\n    return '{said()}'" for k in range(rng.randint(1, 8)))
        text = json.dumps({"status": said(), "paths": {"a": said()}}) if path.endswith(".json") else text
        rows.append((path, text, kind, rng.choice(["auto", "mentioned", "must_include"]), rng.randint(1, 5), "layer", "why", 10 * i, False, 0))
    return spark.createDataFrame(rows, "path string, content string, artifact_type string, origin string, priority int, context_layer string, reason string, n_tokens bigint, promoted boolean, n_included int")


def test_fit_against_the_loop_over_budgets(spark):
    items, terms, note = items_frame(spark, 6, 1), words(["alpha"]), pack.quarter_units(report.left_out())
    units = pack.quarter_units(report.item_text())
    fitted = pack.Fitted(items, terms, 200, units, 500, note)
    steps = pack.budget_steps(200)
    loop = {step: pack.excerpts(items, terms, step).withColumn("units", units).collect() for step in steps}
    tokens = {step: -(-(sum(r.units for r in rows) + 500) // 4) for step, rows in loop.items()}
    assert fitted.used == list(tokens.items()) and len(set(tokens.values())) > 1
    for limit in (tokens[steps[0]], tokens[steps[0]] - 1, tokens[steps[-1]]):
        step = next(s for s in steps if tokens[s] <= limit)
        rows, found = fitted.choose(limit)
        assert found == step and {r.path: (r.excerpt, r.dropped) for r in rows.collect()} == {r.path: (r.excerpt, False) for r in loop[step]}
    limit = tokens[steps[-1]] - 20
    rows, found = fitted.choose(limit)
    made = pack.excerpts(items, terms, steps[-1]).withColumn("units", units)
    want = {r.path: (r.excerpt, r.dropped) for r in pack.drop_until_fit(made, [], limit, 500, note).collect()}
    assert found == steps[-1] and {r.path: (r.excerpt, r.dropped) for r in rows.collect()} == want and any(d for _, d in want.values())
    with pytest.raises(ValueError):
        fitted.choose(50)


def test_jobs_of_a_fit_do_not_grow_with_its_steps(spark):
    items, jobs = items_frame(spark, 5, 3), []
    for most in (120, 4000):
        group = f"fit {most}"
        spark.sparkContext.setJobGroup(group, group)
        fitted = pack.Fitted(items, words(["alpha"]), most, pack.quarter_units(report.item_text()), 10)
        fitted.choose(10**6)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(pack.budget_steps(4000)) > 15 and jobs[0] == jobs[1]


@pytest.fixture(scope="module")
def exact():
    public = pytest.importorskip("public_tokenizers")
    return pack.Exact(str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)


def test_exact_ladders_fit_at_every_limit(exact):
    rng = random.Random(8)
    for limit in [*range(1, 40), 96, 300]:
        text = "".join(rng.choice(["ab ", "é", "漢", "😀", "\n", "the word ", "..."]) for _ in range(rng.randint(1, 800)))
        segs = [{"seg": i, "anchor": f"A{i}", "summary": f"A{i}: " + "é" * rng.randint(0, 40), "priority": rng.randint(0, 9), "snippet": rng.choice(["", "x" * rng.randint(1, 50)])} for i in range(rng.randint(0, 6))]
        got = pack.ladder("p.md", text, "contract", "section_extract", text[:200], ["A0"], segs, ["status", "paths"][: rng.randint(0, 2)], limit, exact)
        assert exact.count(got["text"]) <= limit and "�" not in got["text"]
        assert exact.count(exact.head(text, limit)) <= limit and text.startswith(exact.head(text, limit)) and text.endswith(exact.tail(text, limit))


def test_exact_bundles_fit_by_construction(spark, corpus, exact):
    """Excerpts, blocks and the whole by exact counts, at budgets where nothing, excerpts or items must shrink."""
    vocabulary = pipeline.Vocabulary(exact.ranks, exact.pattern, "bytes")
    frame = spark.createDataFrame(list(corpus.items()), "path string, content string")
    request = Request("review", "Docs", "Which schema does the workflow read?", must_include=("README_9.md",), max_files=8, max_bundle_tokens=100_000, require_exact_tokens=True, focus_points=("schema",))
    chosen, seen = pipeline.select_items(frame, request), []
    for most in (100_000, 2200, 1500):
        try:
            made, text = pipeline.bundle(chosen, Request(**{**request.__dict__, "max_bundle_tokens": most}), vocabulary=vocabulary)
        except ValueError as e:
            assert "must stay" in str(e)
            continue
        said = text.first()
        assert said.tokens == exact.count(said.bundle) <= most
        rows = made.collect()
        assert all(r.n_included == exact.count(r.excerpt.text) <= pipeline.PER_ITEM for r in rows if r.included)
        seen.append((sum(r.included for r in rows), sum(r.n_included for r in rows)))
    assert len(seen) >= 2 and seen == sorted(seen, reverse=True) and len(set(seen)) == len(seen)


def test_dropped_items_are_attachments_only(spark, tmp_path):
    long = "\n".join(f"# Part {i}\n" + "some words of it, " * 20 for i in range(30))
    frame = spark.createDataFrame([(f"docs/d{i}.md", long) for i in range(9)] + [("schemas/s.json", '{"status": 1}'), ("README.md", "# Read\nme")], "path string, content string")
    request = Request("review", "Docs", "Read the docs of the schema", must_include=("README.md",), max_files=9, max_bundle_tokens=1100, focus_points=("workflow",))
    told = pipeline.write_bundle(frame, request, str(tmp_path), "b", "2026")
    out = [f for f in told["files"] if not f["included"]]
    assert out and len(out) < 9
    for f in out:
        e = f["excerpt"]
        assert (e["text"], e["anchors"], e["method"], e["strategy"], e["compaction"], e["truncated"], e["fallback"], e["kept_tokens"]) == ("", [], "not_in_bundle", "not_in_bundle", "none", False, False, False)
        assert (f["n_included"], f["context_layer"], f["artifact_type"], f["bundle_group"]) == (0, "attachments", "attachments_only", "attachments")
    kept = [f for f in told["files"] if f["included"]]
    assert all(f["n_included"] > 0 and f["artifact_type"] != "attachments_only" for f in kept)
    summary = told["selection_summary"]
    assert summary["n_truncated"] <= len(kept) and summary["bundle_layer_counts"]["attachments"] == len(out)
    state = told["task_state"]
    assert state["topic"] == "Docs" and state["must_include"] == ("README.md",) and set(state) == set("topic goal focus_points questions blockers known_routes must_include must_exclude mentioned_paths output_requirements".split())
    assert summary["selector_engine"]["graph_assisted"] and summary["graph"]["two_hop_enabled"] and summary["graph"]["two_hop_triggered"] == summary["two_hop_triggered"]


def test_neighbours_are_contracts_and_workflows_a_hop_away(spark):
    items = spark.createDataFrame([("a", "contract"), ("b", "workflow"), ("c", "contract"), ("d", "code_snippet")], "path string, artifact_type string")
    found = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0), ("d", 1)], "path string, distance int")
    assert graph.neighbour_count(found, items) == 2 and graph.neighbour_count(found.limit(0), items) == 0


@pytest.fixture
def written(spark, tmp_path):
    frame = spark.createDataFrame([("README.md", "# Read\nme"), ("schemas/s.json", "{}")], "path string, content string")
    pipeline.write_bundle(frame, Request("review", "Docs", "Read the schema"), str(tmp_path), "b", "2026")
    return tmp_path


def test_a_crash_while_confirming_loses_nothing(spark, written, monkeypatch):
    def broken(spark, path, text):
        frames.create_text(spark, path, text[: len(text) // 2])
        raise OSError("lost")

    monkeypatch.setattr(pipeline, "create_text", broken)
    with pytest.raises(OSError):
        pipeline.confirm(spark, str(written), "b", "first")
    monkeypatch.undo()
    assert pipeline.preview(spark, str(written), "b")["status"] == "preview"  # half a version is passed over
    monkeypatch.setattr(pipeline, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        pipeline.confirm(spark, str(written), "b", "second")
    monkeypatch.undo()
    told = pipeline.preview(spark, str(written), "b")
    assert (told["status"], told["confirmed_at"], told["version"]) == ("confirmed", "second", 3)  # the version counts, not its copy
    again = pipeline.confirm(spark, str(written), "b", "third")
    assert again["version"] == 4 and json.loads((written / "b" / "manifest.json").read_text())["confirmed_at"] == "third"


def test_of_two_who_confirm_at_once_one_creates_a_version(spark, written, monkeypatch):
    create, other = frames.create_text, []

    def late(spark, path, text):
        if not other:  # someone else confirms between our reading and our writing
            other.append(path)
            create(spark, path, re.sub('"confirmed_at": "ours"', '"confirmed_at": "theirs"', text))
        create(spark, path, text)

    monkeypatch.setattr(pipeline, "create_text", late)
    told = pipeline.confirm(spark, str(written), "b", "ours")
    assert told["version"] == 3 and pipeline.preview(spark, str(written), "b") == told
    versions = sorted((written / "b" / "versions").glob("*.json"))
    assert [json.loads(v.read_text()).get("confirmed_at") for v in versions] == [None, "theirs", "ours"]
    with pytest.raises(FileExistsError):
        create(spark, str(versions[1]), "x")


def test_a_tree_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    names = {f"a/b{i}/c{i % 3}/.hidden_{k}/_x{k}.py" for i in range(6) for k in range(4)} | {"top.md", "a/skip/no.md", "empty.txt"}
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("" if n == "empty.txt" else n)
    (tmp_path / "none").mkdir()
    monkeypatch.setattr("os.walk", None)
    monkeypatch.setattr("lodestack.sources.files.FOLDERS_PER_TASK", 2)
    got = {r.path: r.content for r in folder_corpus(spark, str(tmp_path), ("skip",)).collect()}
    assert got == {n: "" if n == "empty.txt" else n for n in names if "skip" not in n}


def test_segments_read_their_items_once(spark, tmp_path):
    kinds = ["a.md", "b.yaml", "c.toml", "d.json", "e.py", "f.rst", "g.txt"]
    texts = ["# A\nx\n## B\ny", "k: 1\nj: 2", "[t]\nx=1", '{"a": {"b": 1}}', "def f():\n    pass\n", "plain", "none"]
    spark.createDataFrame([(p, "contract", t) for p, t in zip(kinds, texts)], "path string, artifact_type string, content string").write.parquet(str(tmp_path / "items"))
    found = extract.segments(spark.read.parquet(str(tmp_path / "items")), words([]))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r.path, r.seg, r.anchor) for r in found.collect()) == [
        ("a.md", 1, "A"), ("a.md", 2, "B"), ("b.yaml", 1, "k"), ("b.yaml", 2, "j"), ("c.toml", 1, "t"), ("d.json", 0, "a"), ("d.json", 1, "a.b"), ("e.py", 0, "f"), ("f.rst", 0, "document"),
    ]


def test_excerpt_ladder_against_plain_python(spark, corpus):
    """Of every item of the whole query: its segments, what the greedy choice takes, and the first rung that fits."""
    got = {r.path: r for r in queries.QUERIES["excerpt_ladder"](spark, SF).collect()}
    rows = {r.path: r for r in catalog(queries.corpus(spark, SF)).collect()}
    texts = spark.createDataFrame([(p, r.artifact_type, r.content) for p, r in rows.items()], "path string, artifact_type string, content string")
    segs = {}
    for s in extract.segments(texts, words(queries.TERMS)).collect():
        segs.setdefault(s.path, []).append(s.asDict())
    assert set(got) == set(rows)
    for path, r in rows.items():
        own, used, taken = sorted(segs.get(path, []), key=lambda s: s["seg"]), 0, []
        for s in sorted((s for s in own if s["text"]), key=lambda s: (-s["priority"], s["seg"])):
            n = pack.count(s["text"]) + (len(taken) > 0)
            if used + n <= LIMIT:
                used, taken = used + n, [*taken, s]
        taken.sort(key=lambda s: s["seg"])
        text = r.content.strip()
        how = next((k for k, v in extract.STRATEGIES.items() if plain_selection.suffix(path).lower() in v), "full_text")
        wanted = pack.REPLY_TOKENS if "reply_template" in path else pack.SCHEMA_TOKENS if "schema" in path or path.endswith(".json") else pack.ALWAYS
        critical = [t for t in dict.fromkeys(wanted) if t in text] if r.artifact_type == "contract" else []
        want = pack.ladder(path, text, r.artifact_type, how, "\n\n".join(s["text"] for s in taken) or None, [s["anchor"] for s in taken], own, critical, LIMIT)
        mine = got[path]
        assert (mine.strategy, mine.compaction, mine.method, mine.truncated) == tuple(want[k] for k in ("strategy", "compaction", "method", "truncated")), path
        assert (mine.n_tokens, mine.n_anchors) == (pack.count(want["text"]), len(want["anchors"]))


def test_intermediate_tables_are_removed(tmp_path):
    """In a session of its own, as tables that other tests still read would go."""
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession\nfrom lodestack import frames\n"
        f"s = SparkSession.builder.master('local[2]').config('spark.checkpoint.dir', '{tmp_path}/shared').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "a = frames.saved(s.range(5), 'numbers')\nassert a.count() == 5\nimport os\nfound = frames.run_dir(s)\nassert os.listdir(found)\nframes.clean_up(s)\nassert not os.path.exists(found)\nframes.clean_up(s)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=queries.__file__.rsplit("/lodestack/", 1)[0])
