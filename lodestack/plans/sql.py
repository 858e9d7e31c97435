"""Pieces of DuckDB SQL that the queries' oracles share. A piece reads columns of the names in it."""

from __future__ import annotations

from lodestack.functions.text import FOCUS, NOTHING, OTHER_FOCUS, STOP_WORDS
from lodestack.operators.catalog import CONTRACT_FOLDERS, CONTRACT_NAMES, FILE_TYPES, KINDS, SELECTION_NAMES, WORKFLOW_NAMES, Exclusions
from lodestack.operators.pack import DROP_KIND
from lodestack.operators.score import LANE_LIMITS, NAMED
from lodestack.sources.corpus import DOCUMENT_PATHS


def texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def array(values) -> str:
    return f"[{texts(values)}]::VARCHAR[]"


def any_of(hay: str, values) -> str:
    return "(" + " OR ".join(f"contains({hay}, {texts([v])})" for v in values) + ")"


CORPUS = (
    "corpus AS (SELECT doc_id AS ord, CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN {p}" for k, p in enumerate(DOCUMENT_PATHS)) + " END AS path, coalesce(text, '') AS content, lang, source FROM documents)"
)
NAME = "regexp_extract(path, '([^/]*)$', 1)"
SUFFIX = f"regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1)"
STEM = f"regexp_replace({NAME}, '^(.+)\\.[^.]+$', '\\1')"
PARTS = "list_filter(string_split(path, '/'), lambda p: p <> '')"

FILE_TYPE = (
    "CASE " + " ".join(f"WHEN lower({SUFFIX}) IN ({texts(ends)}) THEN '{kind}'" for kind, ends in FILE_TYPES.items())
    + f" WHEN lower({SUFFIX}) = '.log' OR list_contains(string_split(lower(path), '/'), 'log') THEN 'log' ELSE 'other' END"
)
KIND = (
    f"CASE WHEN lower({NAME}) IN ({texts(CONTRACT_NAMES)}) OR list_has_any(string_split(lower(path), '/'), {array(CONTRACT_FOLDERS)}) OR lower(path) LIKE '%config/defaults.yaml' THEN 'contract' "
    f"WHEN lower({NAME}) IN ({texts(WORKFLOW_NAMES)}) THEN 'workflow' WHEN lower({NAME}) IN ({texts(SELECTION_NAMES)}) THEN 'selection_logic' "
    f"WHEN {FILE_TYPE} = 'code' THEN 'code_snippet' ELSE 'supporting_context' END"
)


def of_kind(field: int, kind: str = "artifact_type") -> str:
    value = lambda v: str(v) if isinstance(v, int) else texts([v])
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {value(v[field])}" for k, v in KINDS.items()) + " END"


_rules = Exclusions()
EXCLUDED = (
    f"({NAME} IN ({texts(_rules.names)}) OR lower({SUFFIX}) IN ({texts(_rules.suffixes)}) OR list_has_any(({PARTS})[:-2], {array(_rules.folders)}) OR contains('/' || path || '/', '/.codex/handoffs/')"
    + "".join(f" OR path = '{f}' OR starts_with(path, '{f}/')" for f in _rules.folders) + ")"
)
CATALOG = CORPUS + f", items AS (SELECT *, {FILE_TYPE} AS file_type, {KIND} AS artifact_type, CAST(ceil({{}} / 4.0) AS BIGINT) AS n_tokens FROM corpus)".replace(
    "{}", "(length(content) + 3 * length(regexp_replace(content, '[\\x00-\\x7F]', '', 'g')))"
)


def units(c: str) -> str:
    return f"CAST(length({c}) + 3 * length(regexp_replace({c}, '[\\x00-\\x7F]', '', 'g')) AS BIGINT)"


def tokens(c: str) -> str:
    return f"CAST(ceil({units(c)} / 4.0) AS BIGINT)"


WHITE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def squeeze(c: str) -> str:
    return strip(f"regexp_replace({c}, '{WHITE}+', ' ', 'g')")


def clip(c: str, most: int) -> str:
    s = squeeze(c)
    return f"CASE WHEN length({s}) <= {most} THEN {s} ELSE {strip(f'left({s}, {most - 3})')} || '...' END"


def first_sentence(c: str, most: int = 160) -> str:
    s = squeeze(c)
    found = strip(f"regexp_extract({s}, '^(.{{1,{most}}}?[.!?。；;])', 1)")
    return f"CASE WHEN length({s}) = 0 THEN '{NOTHING}' WHEN length({found}) > 0 THEN {found} ELSE {strip(f'left({s}, {most})')} || CASE WHEN length({s}) > {most} THEN '...' ELSE '' END END"


def normal_term(c: str) -> str:
    t = f"regexp_replace(replace(lower({strip(c)}), '-', '_'), '^_+|_+$', '', 'g')"
    return f"CASE WHEN length({t}) > 0 AND {t} NOT IN ({texts(STOP_WORDS)}) THEN {t} END"


def normal_pattern(c: str) -> str:
    return f"regexp_replace(replace({strip(c)}, '\\', '/'), '^(\\./)+', '')"


def query_terms(c: str) -> str:
    p = normal_pattern(c)
    bare = f"regexp_extract(regexp_replace({p}, '/+$', ''), '([^/]*)$', 1)"
    stem = f"regexp_replace({bare}, '(?s)^(.+)\\.[^.]+$', '\\1')"
    found = f"list_transform(regexp_extract_all({p}, '[A-Za-z][A-Za-z0-9_]{{2,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda t: {normal_term('t')})"
    return f"list_distinct(list_filter(list_concat({found}, [{normal_term(stem)}]), lambda t: t IS NOT NULL))"


def hits(lane: str, values: list[str]) -> str:
    most = "CASE artifact_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in LANE_LIMITS[lane].items()) + " ELSE 3 END"
    return f"(list_filter({array(sorted(values))}, lambda t: contains(lower(path), t))[:3])[:({most})]"


def score(lanes: dict[str, list[str]], more: str = "") -> str:
    """score over columns path, artifact_type and task_hits, contract_hits, code_hits, hits."""
    low = "lower(path)"
    named = " ".join(f"+ CASE WHEN artifact_type = '{k}' AND {any_of(low, tokens_)} THEN {gain} ELSE 0 END" for k, (gain, tokens_) in NAMED.items())
    return (
        f"{of_kind(1)} + least(150, 30 * len(hits)) + CASE WHEN artifact_type = 'contract' AND len(contract_hits) > 0 THEN 35 ELSE 0 END "
        "+ CASE WHEN artifact_type IN ('workflow', 'selection_logic', 'code_snippet') AND len(code_hits) > 0 THEN 35 ELSE 0 END "
        "+ CASE WHEN artifact_type = 'supporting_context' THEN CASE WHEN len(task_hits) > 0 THEN 20 ELSE -120 END ELSE 0 END "
        f"+ CASE WHEN artifact_type = 'supporting_context' AND {NAME} IN ('README.md', 'AGENTS.md') THEN 30 ELSE 0 END + CASE WHEN starts_with(path, 'docs/') THEN 25 ELSE 0 END {named} {more}"
    )


def scored(lanes: dict[str, list[str]], source: str = "items", more: str = "") -> str:
    """CTEs hit and ranked over a table with path and artifact_type."""
    lists = ", ".join(f"{hits(lane, lanes[lane])} AS {lane}_hits" for lane in ("task", "contract", "code"))
    union = "list_distinct(list_concat(task_hits, contract_hits, code_hits))"
    return (
        f"hit0 AS (SELECT *, {lists} FROM {source}), "
        f"hit AS (SELECT *, len({union}) AS n_union, (list_filter(list_concat(task_hits, contract_hits, code_hits), lambda t, i: list_position(list_concat(task_hits, contract_hits, code_hits), t) = i))[:4] AS hits FROM hit0), "
        f"ranked AS (SELECT *, CAST({score(lanes, more)} AS INTEGER) AS score, {of_kind(0)} AS base_priority FROM hit)"
    )


def anchor_score(anchor: str, hint: str, values: list[str], kind: str = "artifact_type") -> str:
    hay = f"replace(lower({anchor} || ' ' || {hint}), '-', '_')"
    count = lambda xs: "(" + " + ".join(f"CASE WHEN contains({hay}, {texts([x])}) THEN 1 ELSE 0 END" for x in xs) + ")"
    focus = f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {count(v)}" for k, v in FOCUS.items()) + f" ELSE {count(OTHER_FOCUS)} END"
    return f"CAST(40 + 30 * {count(values)} + 35 * ({focus}) AS INTEGER)"


DROP_ORDER = "CASE artifact_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DROP_KIND.items()) + " ELSE 5 END"
