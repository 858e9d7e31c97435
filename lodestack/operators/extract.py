"""Structure of texts as rows: sections, blocks, keys, symbols.

Texts are read by an Arrow function, each by the small reader of its suffix, in one pass over all items; what is
said of the segments, their scores and all that follows are Spark's.
"""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.frames import saved, spread
from lodestack.functions import paths
from lodestack.functions.text import anchor_score, first_sentence, strip

# Sizes up to which a symbol is shown whole, and lines of a chunk of its body.
FUNCTION_LINES, CLASS_LINES, CHUNK_LINES = 28, 40, 16
# Keys that are worth more, by how much, and under which deeper keys are shown.
CONFIG_KEYS = "required properties status paths selection_summary inputs notes policy interface".split()
CONFIG_BONUS = 35
DEEPER = "properties paths selection_summary inputs notes".split()
# How an item is read, by suffix.
STRATEGIES = {"symbol_extract": [".py"], "section_extract": [".md", ".rst"], "key_block_extract": [".json", ".yaml", ".yml", ".toml"]}

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SEGMENTS = "array<struct<seg:int,anchor:string,text:string,hint:string,scored:string,weighed:string,snippet:string,summary:string,bonus:int,most:int>>"
SEGMENT = ["path", "seg", "anchor", "text", "summary", "priority", "snippet"]


def strategy(path: Column | str) -> Column:
    end, out = F.lower(paths.suffix(path)), F.lit(None).cast("string")
    for name, ends in STRATEGIES.items():
        out = F.coalesce(out, F.when(end.isin(ends), name))
    return F.coalesce(out, F.lit("full_text"))


HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*$")


def _segment(seg: int, anchor: str, text: str, snippet: str, hint: str | None = None, weighed: str | None = None, scored: str | None = None, summary: str | None = None, bonus: int = 0, most: int = 160) -> dict:
    """hint: what a summary says after the anchor; weighed: what the priority is scored by besides the anchor."""
    hint = text if hint is None else hint
    return {
        "seg": seg, "anchor": anchor, "text": text, "hint": hint, "scored": scored or anchor, "weighed": (text if weighed is None else weighed)[:160], "snippet": snippet, "summary": summary, "bonus": bonus, "most": most,
    }


def _blocks(text: str, starts) -> list[tuple[int, list[str]]]:
    """Lines of a text in numbered blocks, each from a line where starts holds to the next; block 0 is what stands before, if anything does."""
    out: list[tuple[int, list[str]]] = [(0, [])]
    for line in re.split(LINE_END, text.strip()):
        if starts(line):
            out.append((out[-1][0] + 1, []))
        out[-1][1].append(line)
    return out if out[0][1] else out[1:]


def markdown_segments(text: str) -> list[dict]:
    """Segments of a Markdown text: one for each heading of # to ######; a text without any is one called document.

    What stands before the first heading is in no segment.
    """
    out, blocks = [], _blocks(text, HEADING.match)
    for seg, lines in blocks:
        whole = "\n".join(lines).strip()
        if seg:
            title, body = HEADING.match(lines[0])[2].strip(), "\n".join(lines[1:]).strip()
            out.append(_segment(seg, title, whole, lines[0].strip(), body or title, body))
        elif len(blocks) == 1 and whole:
            out.append(_segment(0, "document", whole, lines[0].strip()) | {"summary": ""})
    return out


def yaml_segments(text: str) -> list[dict]:
    """Segments of a YAML text: from each line with a colon that is not indented to the next."""
    out = []
    for seg, lines in _blocks(text, lambda line: line[:1] not in ("", " ", "\t") and ":" in line):
        if seg:
            key = re.sub("^['\"]+|['\"]+$", "", lines[0].strip().partition(":")[0].strip())
            out.append(_segment(seg, key, "\n".join(lines).strip(), lines[0].strip(), bonus=CONFIG_BONUS * (key in CONFIG_KEYS)))
    return out


def toml_segments(text: str) -> list[dict]:
    """Segments of a TOML text: the root, and from each [table] line to the next."""
    out = []
    for seg, lines in _blocks(text, lambda line: line.strip()[:1] == "[" and line.strip()[-1:] == "]"):
        whole = "\n".join(lines).strip()
        if whole:
            out.append(_segment(seg, re.sub(r"^[\[\]]+|[\[\]]+$", "", lines[0].strip()) if seg else "<root>", whole, re.split(LINE_END, whole)[0]))
    return out


#: What the parser raises for texts that are no source, among them ones nested too deeply.
UNREADABLE = (SyntaxError, ValueError, MemoryError, RecursionError)


def key_blocks(text: str) -> list[dict]:
    """Keys of a JSON object to a depth of two, deeper under some; each with its value inside its own path."""
    try:
        top = json.loads(text)
    except (ValueError, RecursionError):
        return []
    found: list[dict] = []
    waiting = [((), top)]
    while waiting:
        above, value = waiting.pop()
        if above:
            whole = value
            for key in reversed(above):
                whole = {key: whole}
            shown = json.dumps(whole, ensure_ascii=False, indent=2)
            name = ".".join(above)
            found.append({"anchor": name, "text": shown, "hint": shown, "scored": name, "snippet": json.dumps({above[-1]: value}, ensure_ascii=False)[:160], "fixed": above[-1]})
        if isinstance(value, dict) and (len(above) < 2 or above[-1] in DEEPER):
            waiting += [((*above, k), v) for k, v in reversed(value.items())]
    return found


def _span(lines: list[str], first: int, last: int) -> str:
    return "\n".join(lines[first - 1 : last]).strip()


def _chunks(lines: list[str], name: str, body: list[ast.stmt]) -> list[dict]:
    """The statements of a long body, docstrings aside, in runs of no more than CHUNK_LINES lines where they fit."""
    runs: list[list[int]] = []
    for s in body:
        if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
            continue
        if runs and s.end_lineno - runs[-1][0] < CHUNK_LINES:
            runs[-1][1] = s.end_lineno
        else:
            runs.append([s.lineno, s.end_lineno])
    shown = [(first, _span(lines, first, last)) for first, last in runs]
    shown = [x for x in shown if x[1]]
    return [{"anchor": f"{name}::chunk_{i}", "text": t, "hint": t, "scored": name, "snippet": lines[first - 1].strip(), "fixed": None} for i, (first, t) in enumerate(shown, 1)]


def _symbol(lines: list[str], node: ast.stmt, name: str, hint: str, most: int, head: int) -> dict:
    last = node.end_lineno if node.end_lineno - node.lineno < most else min(node.lineno + head - 1, len(lines))
    return {"anchor": name, "text": _span(lines, node.lineno, last), "hint": hint, "scored": name, "snippet": lines[node.lineno - 1].strip(), "fixed": None}


FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def python_symbols(text: str) -> list[dict]:
    """Imports, functions, classes and methods of a Python source; of long ones the head and the body in chunks. Nothing if it does not parse."""
    try:
        tree = ast.parse(text)
    except UNREADABLE:
        return []
    lines, found = text.splitlines(), []
    named = [n for n in tree.body if isinstance(n, (*FUNCTIONS, ast.ClassDef))]
    own = {n.name for n in named}
    last = 0
    for n in tree.body:
        if not isinstance(n, (ast.Import, ast.ImportFrom)):
            break
        last = max(last, n.end_lineno)
    if last:
        found.append({"anchor": "<imports>", "text": _span(lines, 1, last), "hint": "", "scored": "imports", "snippet": lines[0].strip(), "fixed": "What the module imports."})
    for n in named:
        hint = ast.get_docstring(n) or lines[n.lineno - 1].strip()
        calls = [getattr(c.func, "id", None) or getattr(c.func, "attr", None) for c in ast.walk(n) if isinstance(c, ast.Call)]
        calls = list(dict.fromkeys(c for c in calls if c in own))[:4]
        if calls:
            hint += f" Calls: {', '.join(calls)}."
        is_class = isinstance(n, ast.ClassDef)
        found.append(_symbol(lines, n, n.name, hint, CLASS_LINES if is_class else FUNCTION_LINES, 4))
        inner = [(m, f"{n.name}.{m.name}") for m in n.body if isinstance(m, FUNCTIONS)] if is_class else []
        if not is_class and n.end_lineno - n.lineno >= FUNCTION_LINES:
            found += _chunks(lines, n.name, n.body)
        for m, name in inner:
            found.append(_symbol(lines, m, name, ast.get_docstring(m) or lines[m.lineno - 1].strip(), FUNCTION_LINES, 3))
            if m.end_lineno - m.lineno >= FUNCTION_LINES:
                found += _chunks(lines, name, m.body)
    return [f for f in found if f["text"]]


def python_facts(text: str) -> dict:
    """Top-level symbols, and of every import the names to try, in order."""
    if not any(word in text for word in ("def", "class", "import")):
        return {"symbols": [], "imports": []}  # no source without these words has any, so it need not be parsed
    try:
        tree = ast.parse(text)
    except UNREADABLE:
        return {"symbols": [], "imports": []}
    wanted = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            wanted += [[a.name] for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            wanted += [[f"{n.module}.{a.name}", n.module] if n.module else [a.name] for a in n.names]
    return {"symbols": [n.name for n in tree.body if isinstance(n, (*FUNCTIONS, ast.ClassDef))], "imports": wanted}


def _each(parse, kind: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))
    return F.arrow_udf(lambda *columns: pa.array([parse(*(t or "" for t in row)) for row in zip(*(x.to_pylist() for x in columns))], arrow), kind)


def facts_of(path: Column | str, content: Column | str) -> Column:
    """python_facts() of a Python item's text, nothing in it for other items."""
    source = F.when(F.lower(paths.suffix(path)) == ".py", F.col(content) if isinstance(content, str) else content)
    return _each(python_facts, "struct<symbols:array<string>,imports:array<array<string>>>")(source)


def told(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, symbol, ord) and (path, wanted) of rows (path, facts: facts_of())."""
    return rows.select("path", F.posexplode("facts.symbols").alias("ord", "symbol")), rows.select("path", F.explode("facts.imports").alias("wanted"))


def facts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, symbol, ord) and (path, wanted) of Python items, parsed once each."""
    return told(saved(items.where(F.lower(paths.suffix("path")) == ".py").select("path", facts_of("path", "content").alias("facts")), "facts"))


def _numbered(found: list[dict], config: bool) -> list[dict]:
    """What a parser found as segments."""
    out = []
    for seg, f in enumerate(found):
        if config:
            out.append(_segment(seg, f["anchor"], f["text"], f["snippet"], f["hint"], bonus=CONFIG_BONUS * (f["fixed"] in CONFIG_KEYS)))
        else:
            out.append(_segment(seg, f["anchor"], f["text"], f["snippet"], f["hint"], scored=f["scored"], summary=f["fixed"], most=120) | {"weighed": f["hint"]})
    return out


# How texts are read, by suffix.
READERS = {
    **dict.fromkeys(STRATEGIES["section_extract"], markdown_segments), ".yaml": yaml_segments, ".yml": yaml_segments, ".toml": toml_segments,
    ".json": lambda text: _numbered(key_blocks(text), True), ".py": lambda text: _numbered(python_symbols(text), False),
}


def _segments(items: DataFrame, terms: Column, read) -> DataFrame:
    """Segments of items (path, artifact_type, content) by read(suffix, text); what is said of a segment is put together by Spark."""
    rows = spread(items.select("path", "artifact_type", "content"), "path")
    rows = rows.select("path", "artifact_type", F.inline(_each(read, SEGMENTS)(F.lower(paths.suffix("path")), strip("content"))))
    said = F.when(F.col("most") == 120, first_sentence("hint", 120)).otherwise(first_sentence("hint"))
    summary = F.when(F.col("summary") == "", said).otherwise(F.coalesce("summary", F.concat("anchor", F.lit(": "), said)))
    priority = anchor_score("scored", "artifact_type", terms, F.col("weighed")) + F.col("bonus")
    return rows.withColumns({"summary": summary, "priority": priority}).select(*SEGMENT)


def sections(items: DataFrame, terms: Column) -> DataFrame:
    return _segments(items, terms, lambda _, text: markdown_segments(text))


def yaml_blocks(items: DataFrame, terms: Column) -> DataFrame:
    return _segments(items, terms, lambda _, text: yaml_segments(text))


def toml_blocks(items: DataFrame, terms: Column) -> DataFrame:
    return _segments(items, terms, lambda _, text: toml_segments(text))


def segments(items: DataFrame, terms: Column) -> DataFrame:
    """Segments (path, seg, anchor, text, summary, priority, snippet) of items (path, artifact_type, content), each read as its suffix asks for; others have none.

    One pass over the items: each text is read once, by the reader of its suffix.
    """
    known = F.lower(paths.suffix("path")).isin(list(READERS))
    return _segments(items.where(known), terms, lambda end, text: READERS[end](text))
