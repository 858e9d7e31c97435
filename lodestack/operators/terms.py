"""Query lanes of requests, and the gate that says how much context a request needs.

Requests are a table: any number of them is worked on at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import paths
from lodestack.functions.text import normal_pattern, query_terms, words

# Terms that every request adds to its contract and code lanes.
CONTRACT_TERMS = "contract schema template reply manifest preview confirm status paths artifacts policy handoff_id".split()
CODE_TERMS = "workflow prepare preview confirm select selector token budget excerpt dependency helper snippet code tradeoff".split()
CODE_PHRASE = "workflow selection token budget excerpt dependency helper snippet code tradeoff"
# Words that turn a gate, and those that ask for paths over two hops.
CODE_FOCUS = "workflow selection selector token budget excerpt code tradeoff dependency helper".split()
CONTRACT_FOCUS = "contract schema template reply manifest status paths artifacts policy handoff_id".split()
CROSS_FILE = "跨文件 依赖 import imports workflow selector code snippet graph topology topological cross-file dependency".split()
# Limits of the gate.
MANY_INCLUDES, MANY_MENTIONS, FEW_TERMS = 3, 1, 6


def terms_of(texts: Column) -> Column:
    """The different terms of all texts of an array, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(texts, query_terms))))


def _texts(*columns: str) -> Column:
    one = ("topic", "goal", "background")
    return F.concat(*(F.array(c) if c in one else F.col(c) for c in columns))


def lanes(requests: DataFrame) -> DataFrame:
    """requests with the sorted lanes task, contract, code and all_terms."""
    task = terms_of(_texts("topic", "goal", "background", "focus_points", "questions", "known_routes", "blockers"))
    code = terms_of(F.concat(_texts("must_include", "mentioned_paths", "focus_points", "questions"), F.array(F.lit(CODE_PHRASE))))
    out = requests.withColumns({"task": task, "code": F.array_sort(F.array_union(code, words(CODE_TERMS)))})
    out = out.withColumn("contract", F.array_sort(F.array_union("task", words(CONTRACT_TERMS))))
    return out.withColumn("all_terms", F.array_sort(F.array_union(F.array_union("task", "contract"), F.col("code"))))


def mentions_any(keywords: list[str], *columns: str) -> Column:
    hay = F.lower(F.array_join(_texts(*columns), " "))
    return F.exists(words(keywords), lambda k: F.contains(hay, k))


def gate(requests: DataFrame) -> DataFrame:
    """requests with lanes() and retrieval_gate: brief_only, brief_plus_contract or full_bundle."""
    focus = ("topic", "goal", "focus_points", "questions", "known_routes", "blockers")
    listed = F.concat("must_include", "mentioned_paths")
    code = F.exists(listed, lambda p: F.lower(paths.suffix(normal_pattern(p))) == ".py") | mentions_any(CODE_FOCUS, *focus)
    full = code | (F.size("must_include") >= MANY_INCLUDES) | (F.size("mentioned_paths") > MANY_MENTIONS)
    brief = (F.size(listed) == 0) & ~mentions_any(CONTRACT_FOCUS, *focus) & (F.size("task") <= FEW_TERMS)
    return lanes(requests).withColumn("retrieval_gate", F.when(full, "full_bundle").when(brief, "brief_only").otherwise("brief_plus_contract"))


def cross_file(requests: DataFrame) -> DataFrame:
    """requests with wants_two_hops."""
    return requests.withColumn("wants_two_hops", mentions_any(CROSS_FILE, "topic", "goal", "focus_points", "questions", "blockers", "known_routes", "output_requirements"))
