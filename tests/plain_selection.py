"""A selection in plain Python, over lists and pairs, as a yardstick for the whole of what users run."""

from __future__ import annotations

import ast
import fnmatch
import posixpath
import re
from collections import defaultdict

from lodestack.functions.text import STOP_WORDS
from lodestack.operators import catalog, graph, score, select, terms

TYPES = ["contract", "workflow", "selection_logic", "code_snippet", "supporting_context"]


def base(path):
    return path.rstrip("/").split("/")[-1]


def suffix(path):
    return m[1] if (m := re.match(r"(?s).+(\.[^.]+)$", base(path))) else ""


def stem(path):
    return m[1] if (m := re.match(r"(?s)(.+)\.[^.]+$", base(path))) else base(path)


def parts(path):
    return [p for p in path.split("/") if p]


def normal(pattern):
    return re.sub(r"^(\./)+", "", pattern.strip().replace("\\", "/"))


def term(t):
    t = re.sub("^_+|_+$", "", t.strip().lower().replace("-", "_"))
    return t if t and t not in STOP_WORDS else None


def query_terms(text):
    text = normal(text)
    found = [term(t) for t in re.findall(r"[A-Za-z][A-Za-z0-9_]{2,}|[一-鿿]{2,}", text)] + [term(stem(text))]
    return {t for t in found if t}


def kind_of(path):
    low, own = path.lower(), base(path).lower()
    code = suffix(path).lower() in catalog.FILE_TYPES["code"]
    if own in catalog.CONTRACT_NAMES or set(low.split("/")) & set(catalog.CONTRACT_FOLDERS) or low.endswith(catalog.CONTRACT_END):
        return "contract"
    return "workflow" if own in catalog.WORKFLOW_NAMES else "selection_logic" if own in catalog.SELECTION_NAMES else "code_snippet" if code else "supporting_context"


def node_kind(path):
    kind = kind_of(path)
    if kind == "contract":
        template = set(path.lower().split("/")) & set(catalog.CONTRACT_FOLDERS) or base(path).lower() in catalog.SCHEMA_TEMPLATE_NAMES or path.lower().endswith(catalog.CONTRACT_END)
        return "artifact_schema_template" if template else "artifact_contract"
    return "artifact_workflow" if kind == "workflow" else None


def excluded(path):
    r = catalog.Exclusions()
    top = any(path == f or path.startswith(f + "/") for f in r.folders)
    return base(path) in r.names or suffix(path).lower() in r.suffixes or bool(set(parts(path)[:-1]) & set(r.folders)) or "/.codex/handoffs/" in f"/{'/'.join(parts(path))}/" or top


def meets(path, pattern):
    pattern = normal(pattern)
    if any(c in pattern for c in "*?["):
        return fnmatch.fnmatchcase(path, pattern)
    return bool(pattern) and (path == pattern or path.startswith(pattern.rstrip("/") + "/"))


def facts(text):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return [], []
    wanted = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            wanted += [[a.name] for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            wanted += [[f"{n.module}.{a.name}", n.module] if n.module else [a.name] for a in n.names]
    return [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], wanted


def module(path):
    bare = re.sub(r"(^|/)__init__$", "", re.sub(r"\.py$", "", path))
    return bare.replace("/", ".") if suffix(path) == ".py" and bare else None


def imports_of(items):
    known, out = {}, set()
    for p in items:
        if m := module(p):
            known[m] = max(p, known.get(m, p))
    for p, text in items.items():
        for names in facts(text)[1] if suffix(p).lower() == ".py" else ():
            for n in names:
                prefixes = [".".join(n.split(".")[:i]) for i in range(len(n.split(".")), 0, -1)]
                hit = next((known[x] for x in prefixes if x in known), None)
                if hit:
                    if hit != p:
                        out.add((p, hit))
                    break
    return out


def target_terms(path):
    low, own, plain = path.lower(), base(path).lower(), stem(path).lower()
    out = [low, own, plain.replace(".", "_"), plain.replace(".", "")]
    for test, more in (
        ("manifest.schema" in low, "manifest schema status paths artifacts"), ("reply_template" in low, "reply reply_template template handoff_id final_reply"),
        ("defaults.yaml" in low, "defaults token budget exclude next_actions"), (own == "openai.yaml", "openai metadata policy prompt"), (own == "skill.md", "skill handoff preview confirm"),
    ):
        out += more.split() if test else []
    return {t for t in out if len(t) >= 3}


def pairs_of(items, imports):
    """Undirected edges between nodes, one for each pair."""
    own = {p: f"{node_kind(p)}:{p}" if node_kind(p) else f"file:{p}" for p in items}
    out = {(f"file:{a}", f"file:{b}", "imports") for a, b in imports}
    for p, text in items.items():
        up = ["."] + ["/".join(parts(p)[:i]) for i in range(1, len(parts(p)))]
        out |= {(f"dir:{a}", f"dir:{b}", "contains") for a, b in zip(up, up[1:])} | {(f"dir:{up[-1]}", f"file:{p}", "contains")}
        if node_kind(p):
            out.add((f"file:{p}", own[p], "contains"))
        if suffix(p).lower() == ".py":
            out |= {(f"file:{p}", f"symbol:{p}:{s}", "contains") for s in facts(text)[0]}
    targets = {p: target_terms(p) for p in items if node_kind(p) in ("artifact_schema_template", "artifact_contract")}
    for p, text in items.items():
        low, kind = text.lower(), node_kind(p)
        if kind == "artifact_schema_template":
            continue
        reads = kind == "artifact_workflow" and any(w in low for w in select.CONSUMES)
        for to, names in targets.items():
            template = node_kind(to) == "artifact_schema_template"
            edge = "constrains" if kind == "artifact_contract" and template else "consumes" if kind == "artifact_workflow" else "depends_on" if kind is None and template else None
            if edge and p != to and (reads or any(n in low for n in names)):
                out.add((own[p], own[to], edge))
    return out


def searched(edges, seeds, limit):
    """Of each node within limit hops (cost, hops, nodes, path, types, reason): states are settled by cost, a round an edge, ties by the node before."""
    near = defaultdict(list)
    for a, b, t in edges:
        near[a].append((b, t))
        near[b].append((a, t))
    settled = {}

    def close(start, hops):
        frontier = {n: s for n, s in start.items() if (n, hops) not in settled}
        while frontier:
            settled.update({(n, hops): s for n, s in frontier.items()})
            ahead = defaultdict(list)
            for n, (path, types, reason) in frontier.items():
                for other, t in near[n]:
                    if t == "contains" and (other, hops) not in settled:
                        ahead[other].append((n, (path + [other], types + [t], reason)))
            frontier = {n: min(x, key=lambda y: y[0])[1] for n, x in ahead.items()}

    close({n: ([n], [], r) for n, r in seeds.items()}, 0)
    for hops in range(1, limit + 1):
        for imported in (False, True):
            ahead = defaultdict(list)
            for (n, h), (path, types, reason) in list(settled.items()):
                for other, t in near[n] if h == hops - 1 else ():
                    if t != "contains" and ("imports" in types + [t]) == imported:
                        ahead[other].append(((n, t), (path + [other], types + [t], reason)))
            close({n: min(x, key=lambda y: y[0])[1] for n, x in ahead.items()}, hops)
    out = {}
    for (n, hops), (path, types, reason) in settled.items():
        cost = 0 if not hops else (2 if "imports" in types else 1) if hops == 1 else 4 if "imports" in types else 3
        out[n] = min(out.get(n, (9,)), (cost, hops, len(path), n, path, types, reason))
    return out


def scored(path, lanes, linked, promoted):
    """(score, base priority) of an item; linked: its path's different edges, promoted: why, or None."""
    kind, low = kind_of(path), normal(path).lower()
    hits = {lane: [t for t in sorted(lanes[lane]) if t in low][:3][: score.LANE_LIMITS[lane].get(kind, 3)] for lane in ("task", "contract", "code")}
    union = list(dict.fromkeys(hits["task"] + hits["contract"] + hits["code"]))[:4]
    support = kind == "supporting_context"
    out = catalog.KINDS[kind][1] + min(150, 30 * len(union)) + 35 * (kind == "contract" and bool(hits["contract"])) + 35 * (kind in ("workflow", "selection_logic", "code_snippet") and bool(hits["code"]))
    out += (20 if hits["task"] else -120) * support + 180 * (promoted is not None) + 30 * (support and base(path) in ("README.md", "AGENTS.md")) + 25 * (parts(path)[:1] == ["docs"])
    out += sum(gain for k, (gain, tokens) in score.NAMED.items() if kind == k and any(t in path.lower() for t in tokens))
    if linked == ["direct_anchor"]:
        bonus = {"contract": 70, "workflow": 55}.get(kind, 30)
    else:
        bonus = sum((high if kind in kinds else lower) for e, (high, lower, kinds) in score.EDGE_BONUS.items() if e in linked)
        bonus = min(bonus, 45) if support else bonus + ({"contract": 25, "workflow": 20}.get(kind, 0) if linked else 0)
    return out + bonus, catalog.KINDS[kind][0], hits


def selection(corpus, request):
    """path -> (origin, kind, score, priority, promoted, distance, path types) of the items that a request selects from corpus (path: content)."""
    items = {p: t for p, t in corpus.items() if not excluded(p)}
    focus = [request.topic, request.goal, *request.focus_points, *request.questions, *request.known_routes, *request.blockers]
    task = set().union(*map(query_terms, [*focus, request.background]))
    code = set().union(*map(query_terms, [*request.must_include, *request.mentioned_paths, *request.focus_points, *request.questions, terms.CODE_PHRASE])) | set(terms.CODE_TERMS)
    lanes = {"task": task, "contract": task | set(terms.CONTRACT_TERMS), "code": code}
    said = " ".join(focus).lower()
    full = any(suffix(normal(p)).lower() == ".py" for p in (*request.must_include, *request.mentioned_paths)) or any(k in said for k in terms.CODE_FOCUS)
    full = full or len(request.must_include) >= terms.MANY_INCLUDES or len(request.mentioned_paths) > terms.MANY_MENTIONS
    brief = not request.must_include and not request.mentioned_paths and not any(k in said for k in terms.CONTRACT_FOCUS) and len(task) <= terms.FEW_TERMS
    gate = "full_bundle" if full else "brief_only" if brief else "brief_plus_contract"
    allowed = catalog.GATES[gate]
    imports = imports_of(items)

    text = " ".join([request.topic, request.goal, *request.focus_points, *request.questions, *request.blockers, *request.known_routes, *request.output_requirements]).lower()
    seeds = {}
    for p, content in items.items():
        hits, kind = scored(p, lanes, [], None)[2], kind_of(p)
        why = "direct_path" if p in (*request.must_include, *request.mentioned_paths) else "contract_anchor" if kind == "contract" and hits["contract"] else "workflow_anchor" if kind == "workflow" and (hits["contract"] or hits["code"]) else None
        why = why or ("code_anchor" if kind in ("selection_logic", "code_snippet") and hits["code"] else "task_anchor" if kind == "supporting_context" and hits["task"] else None)
        if why:
            seeds[f"file:{p}"] = why
        for s in facts(content)[0] if suffix(p).lower() == ".py" else ():
            if len(s) >= 3 and re.search(rf"\b{re.escape(s.lower())}\b", text):
                seeds[f"symbol:{p}:{s}"] = "symbol_anchor"
                break

    edges = pairs_of(items, imports)

    def of_items(limit):
        out = {}
        for n, (cost, hops, size, node, path, types, reason) in searched(edges, seeds, limit).items():
            if not n.startswith("dir:"):
                p = n.split(":", 1)[1]
                p = p.rsplit(":", 1)[0] if n.startswith("symbol:") else p
                out[p] = min(out.get(p, (9,)), (cost, hops, size, node, path, types, reason))
        return {p: (b[1], list(dict.fromkeys(t for t in b[5] if t != "contains")) or ["direct_anchor"]) for p, b in out.items()}

    found = of_items(1)
    close = sum(d > 0 and kind_of(p) in ("contract", "workflow") for p, (d, _) in found.items())
    wide = any(k in " ".join([*focus, *request.output_requirements]).lower() for k in terms.CROSS_FILE)
    if wide or close < 2:
        found = of_items(2)

    banned = {p for p in corpus if any(meets(p, x) for x in request.must_exclude)}
    included = {}
    for i, x in enumerate(request.must_include):
        for p in corpus:
            if meets(p, x) and p not in banned:
                included.setdefault(p, i)
    named = {}
    for i, x in enumerate(request.mentioned_paths):
        for p in items:
            if meets(p, x):
                named.setdefault(p, (0, i, 0, ""))
    told, exact = [request.background, *request.focus_points, *request.questions, *request.known_routes, *request.blockers], set()
    for k, t in enumerate(told):
        for at, raw in enumerate(re.findall(r"[A-Za-z0-9_./\\-]+\.[A-Za-z0-9_]+", t)):
            token = normal(raw)
            new = token in items and token not in exact
            exact |= {token} if new else set()
            for p in [token] if new else [p for p in items if base(p) == base(token)]:
                named[p] = min(named.get(p, (2,)), (1, k, at, "" if new else p))
    named = {p: o for p, o in named.items() if p not in banned and p not in included and (gate == "full_bundle" or kind_of(p) in allowed)}
    room = max(request.max_files - len(included), 0)
    mentioned = sorted(named, key=lambda p: (named[p], p))[:room]
    left = max(room - len(mentioned), 0)

    def ranked(promoted):
        rows = []
        for p in items:
            if p in banned or p in included or p in named or (kind_of(p) not in allowed and p not in promoted):
                continue
            points, priority, _ = scored(p, lanes, found.get(p, (0, []))[1], promoted.get(p))
            rows.append((-points, priority, p))
        return sorted(rows)[:left]

    order = [*sorted(included, key=lambda p: (included[p], p)), *mentioned, *(p for *_, p in ranked({}))]
    order = [p for p in order if p in items]
    promoted = {}
    for p in order:
        if kind_of(p) == "workflow":
            for a, b in sorted(imports):
                if a == p:
                    promoted.setdefault(b, f"A direct dependency of {p}.")
    if any(kind_of(p) == "contract" for p in order):
        for p, t in items.items():
            if kind_of(p) in select.CODE_LIKE and any(w in t.lower() for w in select.CONSUMES):
                promoted.setdefault(p, "It reads what contracts define.")
    out = {}
    rest = {"promoted": promoted, "found": found}
    for p in included:
        out[p] = ("must_include", kind_of(p), None, 1)
    for p in mentioned:
        out[p] = ("mentioned", kind_of(p), None, min(catalog.KINDS[kind_of(p)][0], 2))
    for points, priority, p in ranked(promoted):
        out[p] = ("auto", kind_of(p), -points, priority)
    return {p: (*v, p in rest["promoted"], *((found[p][0], " ".join(found[p][1])) if p in found else (-1, None))) for p, v in out.items()}


assert graph.MAX_HOPS == 2 and posixpath.sep == "/" and TYPES == list(catalog.KINDS)
