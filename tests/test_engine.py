"""Unit tests of the selection engine: edge inputs, extraction, packing, and a small project from end to end."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import match, paths, text
from lodestack.functions.text import words
from lodestack.operators import catalog, extract, graph, pack, select
from lodestack.plans import pipeline
from lodestack.request import Request
from lodestack.sources.files import folder_corpus, is_text


def values(spark, rows, **columns):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [tuple(r) for r in df.select(*columns.values()).collect()]


def test_text_sniff():
    assert is_text(b"plain") and is_text("é".encode()) and is_text(b"") and is_text("x é".encode()[:-1])
    assert not is_text(b"a\0b") and not is_text(b"\xff\xfe")


def test_text_functions(spark):
    rows = ["  ./a\\b/c.py ", "x-Y_", "the", "\u00a0 sp\u3000", "", "a.b.", ".hidden", "dir/.x.txt", "漢字 and code_x", "a" * 50]
    got = values(spark, rows, a=text.normal_pattern("v"), b=text.normal_term("v"), c=text.strip("v"), d=paths.suffix("v"), e=paths.stem("v"))
    assert got[0][:1] == ("a/b/c.py",) and got[1][1] == "x_y" and got[2][1] is None and got[3][2] == "sp" and got[4] == ("", None, "", "", "")
    assert got[5][3:] == ("", "a.b.") and got[6][3:] == ("", ".hidden") and got[7][3:] == (".txt", ".x")
    assert sorted(values(spark, ["漢字 and code_x, the-end"], t=text.query_terms("v"))[0][0]) == ["code_x", "end", "漢字", "漢字 and code_x, the_end"]


def test_token_estimate_and_slices_against_plain_python(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab é漢😀\n") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = values(spark, rows, n=text.estimate_tokens("v"), h=text.slice_head("v", 7), t=text.slice_tail("v", 7))
    for row, (n, head, tail) in zip(rows, got):
        assert n == math.ceil(sum(1 if c.isascii() else 4 for c in row) / 4) == pack.count(row)
        assert head == pack.head(row, 7) and tail == pack.tail(row, 7)


def test_classification(spark):
    rows = {"logs/a": "other", "log/a": "log", "x.LOG": "log", "a.py": "code", "README": "other", "a.tar.gz": "other", "conf.YAML": "config", "n.md": "documentation"}
    assert [r[0] for r in values(spark, rows, t=catalog.file_type("v"))] == list(rows.values())
    rows = {"a/schemas/x.py": "contract", "SKILL.md": "contract", "a/config/defaults.yaml": "contract", "workflow.py": "workflow", "x/selector.py": "selection_logic", "b.rs": "code_snippet", "b": "supporting_context"}
    assert [r[0] for r in values(spark, rows, t=catalog.artifact_type("v"))] == list(rows.values())
    rows = {"a/.git/x": True, ".gitx": False, "data": True, "data/x": True, "x/.codex/handoffs/y": True, "x.pyc": True, "ok.py": False, "sub/data.py": False}
    assert [r[0] for r in values(spark, rows, t=catalog.excluded("v"))] == list(rows.values())
    assert values(spark, ["a.py", "a/b/c.py"], t=paths.ancestors("v")) == [(["."],), ([".", "a", "a/b"],)]
    assert values(spark, ["a/__init__.py", "__init__.py", "a/b.py", "a.txt"], t=paths.module("v")) == [("a",), (None,), ("a.b",), (None,)]


def test_contained_terms(spark):
    rng = random.Random(12)
    rows = [(1, "abcabc"), (2, "xbc"), (3, None), (4, ""), (5, " a  b\tbc\n"), (6, "my file.md is my  file.md"), (2, "xbc")]
    rows += [(10 + i, "".join(rng.choice("abc .\n漢") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    said = ["abc", "bc", "z", "", "bc", "my file.md", "a b", "漢", "漢a", "b.c", " ", "abcabcabc" * 20] + ["".join(rng.choice("abc.") for _ in range(rng.randint(1, 4))) for _ in range(20)]
    texts, terms = spark.createDataFrame(rows, "id int, content string"), spark.createDataFrame([(t,) for t in said], "term string")
    got = [tuple(r) for r in match.contained(texts, "content", terms).collect()]
    assert sorted(got) == sorted({(i, t) for i, c in rows for t in said if t.strip() and t in (c or "")})
    assert match.contained(texts, "content", terms.limit(0)).count() == 0


def test_patterns_and_mentions(spark):
    items = spark.createDataFrame([(p,) for p in ("a/x.py", "b/x.py", "a/y.md", "z[1].py", "a-b.py")], "path string")
    got = [(r.pattern, r.path) for r in select.resolve_patterns(items, ["a", "*x.py", "./a\\y.md", "none", "z[[]1].py"]).orderBy("ord", "path").collect()]
    assert got == [("a", "a/x.py"), ("a", "a/y.md"), ("*x.py", "a/x.py"), ("*x.py", "b/x.py"), ("./a\\y.md", "a/y.md"), ("none", None), ("z[[]1].py", "z[1].py")]
    texts = lambda *t: spark.createDataFrame(list(enumerate(t)), "ord int, text string")
    said = lambda *t: [r.path for r in select.mentioned_paths(texts(*t), items).orderBy("ord").collect()]
    assert said("see a/x.py.") == [] or said("see a/x.py now") == ["a/x.py"]
    assert said("a/x.py and a/x.py") == ["a/x.py", "b/x.py"]
    assert said("nothing", "x.py y.md") == ["a/x.py", "b/x.py", "a/y.md"]


def test_mentioned_paths_by_first_mentions(spark):
    paths = [f"d{i}/x.py" for i in range(20)] + [f"d{i}/y{i}.md" for i in range(20)]
    items = spark.createDataFrame([(p,) for p in paths], "path string")
    data = [(k, f"d{k % 7}/x.py of y{k % 5}.md and d9/y9.md on q/x.py" if k > 2 else "d3/y3.md none.txt") for k in range(60)]
    first = {}
    for k, said in data:
        for at, token in enumerate(t for t in said.split() if "." in t):
            new = token in paths and (token, None) not in first
            if new:
                first[token, None] = True
            for p in [token] if new else [p for p in paths if p.split("/")[-1] == token.split("/")[-1]]:
                first.setdefault(p, (k, at, "" if new else p))
    first = {p: v for p, v in first.items() if isinstance(p, str)}
    got = select.mentioned_paths(spark.createDataFrame(data, "ord int, text string").repartition(5), items)
    assert {r.path: tuple(r.ord) for r in got.collect()} == first
    assert [r.path for r in got.orderBy("ord").collect()] == sorted(first, key=first.get)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def body(n):
    return "\n".join(f"    x{i} = {i}" for i in range(n))


def test_python_segments():
    whole, long = f"def f():\n{body(27)}\n", f"def f():\n{body(28)}\n"
    assert [s["anchor"] for s in extract.python_symbols(whole)] == ["f"]
    found = extract.python_symbols("import os\nfrom a import b\n\n" + long)
    assert [s["anchor"] for s in found] == ["<imports>", "f", "f::chunk_1", "f::chunk_2"]
    assert len(found[1]["text"].split("\n")) == 4 and len(found[2]["text"].split("\n")) == 16
    methods = f"class C:\n    def a(self):\n        return g()\n\n{chr(10).join('    y%d = 1' % i for i in range(40))}\n\ndef g():\n    '''Says so.'''\n    return C()\n"
    found = {s["anchor"]: s for s in extract.python_symbols(methods)}
    assert list(found) == ["C", "C.a", "g"] and found["C"]["hint"].endswith("Calls: g.") and found["g"]["hint"] == "Says so. Calls: C."
    assert extract.python_symbols("def broken(:") == [] and extract.python_facts("def broken(:") == {"symbols": [], "imports": []}
    assert extract.python_facts("import a.b\nfrom .c import d\nfrom e import f\n")["imports"] == [["a.b"], ["c.d", "c"], ["e.f", "e"]]


def test_json_key_blocks():
    found = [s["anchor"] for s in extract.key_blocks('{"b": {"x": {"deep": 1}, "properties": {"p": {"q": 1}}}, "a": [1]}')]
    assert found == ["b", "b.x", "b.properties", "b.properties.p", "a"]
    assert extract.key_blocks("[1]") == [] == extract.key_blocks("no json")


def test_sections(spark):
    rows = [("a.md", "lost\n# One\nbody one.\n```\n# two\n```\n####### no\n"), ("b.md", "just text"), ("c.md", "  \n"), ("d.md", "# T\n")]
    items = spark.createDataFrame([(p, "supporting_context", t) for p, t in rows], "path string, artifact_type string, content string")
    got = [(r.path, r.anchor, r.summary, r.snippet) for r in extract.sections(items, words(["one"])).orderBy("path", "seg").collect()]
    assert got == [("a.md", "One", "One: body one.", "# One"), ("a.md", "two", "two: ``` ####### no", "# two"), ("b.md", "document", "just text", "just text"), ("d.md", "T", "T: T", "# T")]


def test_import_resolution(spark):
    modules = spark.createDataFrame([("a", "a/__init__.py"), ("a.b", "a/b.py"), ("c", "c.py")], "module string, path string")
    imports = spark.createDataFrame([("x.py", ["a.b.c"]), ("x.py", ["zz.q", "c"]), ("x.py", ["a.zz", "a"]), ("c.py", ["c"]), ("x.py", ["none"])], "path string, wanted array<string>")
    assert sorted(map(tuple, graph.resolve_imports(imports, modules).collect())) == [("x.py", "a/__init__.py"), ("x.py", "a/b.py"), ("x.py", "c.py")]


def plain_search(edges, seeds, limit):
    """Dijkstra by (cost, nodes, path) over states (node, hops)."""
    near = {}
    for a, b, t in edges:
        near.setdefault(a, []).append((b, t))
        near.setdefault(b, []).append((a, t))

    def cost(types):
        real = [t for t in types if t != "contains"]
        return 0 if not real else (2 if "imports" in real else 1) if len(real) == 1 else 4 if "imports" in real else 3

    best = {(s, 0): (0, 1, [s], []) for s in seeds}
    todo = list(best)
    while todo:
        node, hops = todo.pop(0)
        _, _, path, types = best[node, hops]
        for other, t in near.get(node, ()):
            h = hops + (t != "contains")
            new = (cost([*types, t]), len(path) + 1, [*path, other], [*types, t])
            if h <= limit and ((other, h) not in best or new[0] < best[other, h][0]):
                best[other, h] = new
                todo.append((other, h))
    out = {}
    for (node, hops), (c, *_rest) in best.items():
        out[node] = min(out.get(node, (99, 99)), (c, hops))
    return out


def test_search_against_plain_search(spark):
    rng = random.Random(4)
    edges = list({(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice(["contains", "imports", "depends_on"])) for _ in range(45)})
    edges = [e for e in edges if e[0] != e[1]]
    frame = spark.createDataFrame(edges, "src string, dst string, edge_type string")
    start = spark.createDataFrame([("n0", "direct_path"), ("n1", "code_anchor")], "node string, reason string")
    for limit in (1, 2):
        got = {r.node: (r.cost, r.distance) for r in graph.search(frame, start, limit).collect()}
        assert got == plain_search(edges, ["n0", "n1"], limit)


def test_search_over_a_group_is_that_over_all_its_pairs(spark):
    rng = random.Random(11)
    edges = [e for e in {(f"n{rng.randrange(18)}", f"n{rng.randrange(18)}", rng.choice(["contains", "imports", "depends_on"])) for _ in range(22)} if e[0] != e[1]]
    readers, members = ["n1", "n5", "w1", "w2"], ["n2", "n9", "m1", "m2"]
    schema = "src string, dst string, edge_type string"
    pairs = spark.createDataFrame(edges + [(r, m, "consumes") for r in readers for m in members], schema)
    group = spark.createDataFrame(edges + [(r, graph.ALL_CONTRACTS, "consumes") for r in readers] + [(graph.ALL_CONTRACTS, m, graph.MEMBER) for m in members], schema)
    for seeds in (["n0", "w1"], ["m1"]):
        start = spark.createDataFrame([(x, "direct_path") for x in seeds], "node string, reason string")
        for limit in (1, 2):
            rows = lambda e: sorted(map(tuple, graph.search(graph.undirected(e), start, limit).collect()))  # noqa: B023, E731
            assert rows(group) == rows(pairs)
    assert {r.edge_type: r.n for r in graph.edge_counts(group).collect()}["consumes"] == 16


def test_search_crosses_folders_of_any_depth(spark):
    chain = [(f"d{i}", f"d{i + 1}", "contains") for i in range(70)]
    start = spark.createDataFrame([("d0", "direct_path")], "node string, reason string")
    assert graph.search(spark.createDataFrame(chain, "src string, dst string, edge_type string"), start).count() == 71


def test_greedy_against_a_plain_fold(spark):
    rng = random.Random(2)
    segs = [("p%d" % rng.randrange(4), i, f"a{i}", "w" * rng.randrange(0, 90), "", rng.randrange(5), "") for i in range(60)]
    got = {r.path: r.anchors for r in pack.greedy(spark.createDataFrame(segs, "path string, seg int, anchor string, text string, summary string, priority int, snippet string"), 30).collect()}
    for path in {s[0] for s in segs}:
        used, taken = 0, []
        for s in sorted((s for s in segs if s[0] == path and s[3]), key=lambda s: (-s[5], s[1])):
            n = pack.count(s[3]) + (1 if taken else 0)
            if used + n <= 30:
                used, taken = used + n, [*taken, s]
        assert got.get(path, []) == [s[2] for s in sorted(taken, key=lambda s: s[1])]


def test_ladder_rungs():
    long = "word " * 400
    rung = lambda text, limit, kind="supporting_context", structured=None, segs=(), critical=(): pack.ladder("p.md", text, kind, "section_extract", structured, ["a"] if structured else [], list(segs), list(critical), limit)
    assert rung("", 96)["strategy"] == "empty_text" and rung("short", 96)["method"] == "full_text"
    assert rung(long, 100)["fallback"] and pack.count(rung(long, 100)["text"]) <= 100 and rung(long, 100)["method"].startswith("head_tail_tokens:")
    seg = {"seg": 0, "anchor": "A", "summary": "A: sum", "priority": 40, "snippet": "# A"}
    assert rung(long, 100, segs=[seg])["anchors"] == ["A"] and rung(long, 100, segs=[seg])["compaction"] == "typed_digest_compaction"
    kept = rung(long + "status", 100, "contract", "part", [seg], ["status"])
    assert kept["text"] == f"part\n\n{pack.NAMES}\n* status" and kept["kept_tokens"]
    assert f"{pack.NAMES}\n* status" in rung(long, 24, "contract", None, [{**seg, "summary": "A: " + "sum " * 60}], ["status"])["text"]


def test_rungs_fit_at_every_limit():
    rng = random.Random(8)
    for limit in [*range(1, 60), 96, 300]:
        text = "".join(rng.choice("ab é漢😀\n") for _ in range(rng.randint(1, 2000)))
        segs = [{"seg": i, "anchor": f"A{i}", "summary": f"A{i}: " + "é" * rng.randint(0, 40), "priority": rng.randint(0, 9), "snippet": rng.choice(["", "x" * rng.randint(1, 50)])} for i in range(rng.randint(0, 6))]
        got = pack.ladder("p.md", text, "contract", "section_extract", None, [], segs, ["status", "paths"][: rng.randint(0, 2)], limit)
        assert pack.count(got["text"]) <= limit, (limit, got)
        said, method = pack.ends(text, limit)
        assert pack.count(said) <= limit and method.startswith("head_t")
        short, taken = pack.filled("start", [("H", s["summary"]) for s in segs], limit)
        assert not taken or pack.count(short) <= limit


def test_budgets_have_a_closed_form(spark):
    assert pack.budget_steps(300)[:3] == [300, 240, 192] and pack.budget_steps(300)[-1] == pack.FLOOR and pack.budget_steps(50) == [50]
    starts = [50, 96, 97, 300, 4096, 2**31]
    assert [r.b for r in spark.createDataFrame([(n,) for n in starts], "n bigint").select(pack.budgets(F.col("n")).alias("b")).collect()] == list(map(pack.budget_steps, starts))
    rng = random.Random(6)
    rows = [(f"p{i}", rng.choice(list(pack.DROP_ORIGIN)), rng.choice(list(pack.DROP_KIND)), rng.randrange(500), rng.randrange(1, 2000)) for i in range(40)]
    got = {r.path for r in pack.drop_until_fit(spark.createDataFrame(rows, "path string, origin string, artifact_type string, n_tokens bigint, units bigint"), [], 5000).where("dropped").collect()}
    left, dropped = list(rows), set()
    while math.ceil(sum(r[4] for r in left) / 4) > 5000:
        free = [r for r in left if r[1] != "must_include" and r[2] != "contract"]
        if not free:
            break
        worst = min(free, key=lambda r: (pack.DROP_ORIGIN[r[1]], pack.DROP_KIND[r[2]], -r[3], r[0]))
        left.remove(worst)
        dropped.add(worst[0])
    assert got == dropped


PROJECT = {
    "README.md": "# Shop\nA small shop.\n## Usage\nRun it.\n", "docs/overview.md": "# Overview\nWhat the shop does.\n", "docs/questions.md": "# Questions\nWhat next?\n",
    "schemas/manifest.schema.json": '{"type": "object", "required": ["status"], "properties": {"status": {"type": "string"}}}', "templates/reply_template.md": "# Reply\nbundle status\n",
    "src/workflow.py": "from src.selector import pick\n\ndef prepare():\n    return pick([])\n", "src/selector.py": "def pick(xs):\n    return sorted(xs)\n", "src/__init__.py": "",
    "src/builder.py": "import os\n\ndef build():\n    return 'schema'\n", "logs/strategy.log": "line 1\nline 2\n", ".hidden/note.txt": "hidden\r\nline", "img.bin": b"\0\1", "bad.txt": b"ok \xff",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, content in PROJECT.items():
        os.makedirs(os.path.dirname(root / path) or root, exist_ok=True)
        (root / path).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


def test_folder_source(spark, project):
    got = {r.path: (r.is_text, r.content) for r in folder_corpus(spark, project).collect()}
    assert set(got) == set(PROJECT) and got["img.bin"] == got["bad.txt"] == (False, None) and got[".hidden/note.txt"][1] == "hidden\nline"
    assert "logs/strategy.log" not in {r.path for r in folder_corpus(spark, project, ("logs",)).collect()}


def test_a_bundle_from_end_to_end(spark, project, tmp_path):
    corpus = folder_corpus(spark, project).where("is_text").select("path", "content")
    include = ("README.md", "docs/overview.md", "schemas/manifest.schema.json", "templates/*", "src/workflow.py", "src/selector.py", "src/builder.py", "logs/strategy.log")
    request = Request("review", "Shop", "Understand the workflow", focus_points=("workflow",), questions=("Is the schema right?",), must_include=include)
    told = pipeline.write_bundle(corpus, request, str(tmp_path), "b1", "2026-01-01T00:00:00+00:00")
    summary = told["selection_summary"]
    assert summary["retrieval_gate"] == "full_bundle" and summary["total_bundle_tokens"] <= 4096
    assert len(told["files"]) == 8 and {f["origin"] for f in told["files"]} == {"must_include"}
    measures = summary["quality_metrics"]
    assert (measures["contract_coverage"], measures["workflow_coverage"], measures["fallback_ratio"]) == (2, 1, 0)
    assert sum(f["excerpt"]["strategy"] in ("symbol_extract", "section_extract", "key_block_extract") for f in told["files"]) == 7
    bundle = (tmp_path / "b1" / "bundle.md").read_text()
    assert pack.count(bundle) == summary["total_bundle_tokens"] and bundle.index("schemas/manifest") < bundle.index("src/workflow.py") < bundle.index("src/selector.py") < bundle.index("### README.md")
    assert pipeline.preview(spark, str(tmp_path), "b1")["status"] == "preview" and pipeline.confirm(spark, str(tmp_path), "b1", "later")["status"] == "confirmed"
    assert json.loads((tmp_path / "b1" / "manifest.json").read_text())["confirmed_at"] == "later"
    with pytest.raises(FileExistsError):
        pipeline.write_bundle(corpus, request, str(tmp_path), "b1", "2026")
    assert (summary["n_selected"], summary["n_structured"], summary["n_digests"], summary["n_fallbacks"]) == (8, 7, 0, 0)
    assert summary["tokens_counted_by"] == "estimate" and summary["graph"]["nodes"]["task_state_anchor"] > 0 and summary["graph"]["edges"]["contains"] > 10
    assert {f["attachment"] for f in told["files"]} == {"attachments"} and "content" not in told["files"][0]
    assert spark.read.parquet(str(tmp_path / "b1" / "attachments")).count() == 8


def test_items_are_dropped_where_a_bundle_is_too_long(spark):
    long = "\n".join(f"# Part {i}\n" + "some words of it, " * 20 for i in range(30))
    corpus = spark.createDataFrame([(f"docs/d{i}.md", long) for i in range(9)] + [("schemas/s.json", '{"status": 1}'), ("README.md", "# Read\nme")], "path string, content string")
    request = Request("review", "Docs", "Read the docs of the schema", must_include=("README.md",), max_files=9, max_bundle_tokens=1100, focus_points=("workflow",))
    chosen = pipeline.select_items(corpus, request)
    made, text = pipeline.bundle(chosen, request)
    rows = {r.path: r for r in made.collect()}
    said = text.first()
    out = [p for p, r in rows.items() if not r.included]
    assert out and all(p.startswith("docs/") for p in out) and rows["README.md"].included and rows["schemas/s.json"].included
    assert said.tokens == pack.count(said.bundle) <= 1100 and all(f"{p}: attached only" in said.bundle for p in out)
    with pytest.raises(ValueError):
        pipeline.bundle(chosen, Request("review", "Docs", "Read", must_include=("README.md",), max_bundle_tokens=96), per_item=96)


def test_exact_tokens_of_a_bundle(spark, project, tmp_path):
    import base64

    ranks = tmp_path / "ranks.txt"  # single bytes and a few merges
    ranks.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate([bytes([b]) for b in range(256)] + [b"th", b"the", b"in"])))
    vocabulary = pipeline.Vocabulary(str(ranks), r"\s?\S+|\s+", "bytes")
    corpus = folder_corpus(spark, project).where("is_text").select("path", "content")
    request = Request("review", "Shop", "Understand the workflow", must_include=("src/*",), require_exact_tokens=True, max_files=3, max_bundle_tokens=4096)
    chosen = pipeline.select_items(corpus, request)
    with pytest.raises(ValueError):
        pipeline.bundle(chosen, request)
    _, text = pipeline.bundle(chosen, request, vocabulary=vocabulary)
    said = text.first()
    assert len(said.bundle) / 2 < said.tokens <= 4096


def test_files_outside_the_root_are_refused(spark, tmp_path):
    (tmp_path / "root").mkdir(), (tmp_path / "secret.txt").write_text("secret"), (tmp_path / "root" / "ok.txt").write_text("ok")
    (tmp_path / "root" / "same.txt").symlink_to(tmp_path / "root" / "ok.txt")
    assert folder_corpus(spark, str(tmp_path / "root")).count() == 2
    (tmp_path / "root" / "leak.txt").symlink_to(tmp_path / "secret.txt")
    with pytest.raises(Exception, match="leads out of"):
        folder_corpus(spark, str(tmp_path / "root")).collect()


def test_selection_promotes_and_excludes(spark, project):
    corpus = folder_corpus(spark, project).where("is_text").select("path", "content")
    request = Request("review", "Shop workflow", "See selector.py", must_include=("src/workflow.py", "none.*"), must_exclude=("docs/*",), max_files=4, background="README.md matters")
    chosen = pipeline.select_items(corpus, request)
    rows = {r.path: r for r in chosen.items.drop("content").collect()}
    assert len(rows) == 4 and rows["src/workflow.py"].origin == "must_include" and rows["README.md"].origin == "mentioned"
    assert rows["src/selector.py"].promoted and "dependency of src/workflow.py" in rows["src/selector.py"].reason
    assert not any(p.startswith("docs/") for p in rows) and [tuple(r) for r in chosen.warnings.collect()] == [("include_without_match", "none.*")]
    assert chosen.dropped.count() > 0
    near = pipeline.select_items(corpus, request, traverse_dirs=False)
    assert near.items.count() == 4


def test_requests():
    request = Request(" m ", "t", "g", focus_points=(" a ", "a", "")).normalized()
    assert request.mode == "m" and request.focus_points == ("a",)
    for bad in ({"topic": ""}, {"max_files": 0}, {"max_bundle_tokens": 95}):
        with pytest.raises(ValueError):
            Request(**({"mode": "m", "topic": "t", "goal": "g"} | bad)).validate()


def test_quality_rounds_half_to_even(spark):
    from lodestack.operators import report

    rows = [(True, "contract", "full_text", "none", False, [], i == 0) for i in range(8)]
    frame = spark.createDataFrame(rows, "included boolean, artifact_type string, strategy string, compaction string, fallback boolean, anchors array<string>, explained boolean")
    assert report.quality(frame, F.lit(1), F.lit(2)).first().explanation_coverage == 12
    assert report.quality(frame.limit(0), F.lit(1), F.lit(2)).first().explanation_coverage == 100
