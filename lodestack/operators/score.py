"""Scores of items against a request's lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import paths
from lodestack.functions.text import normal_pattern, words
from lodestack.operators.catalog import of_kind

# Parts of names that add to a kind's score, and how much.
NAMED = {
    "contract": (40, "schema template reply manifest preview confirm".split()),
    "workflow": (30, "workflow prepare preview confirm".split()),
    "selection_logic": (30, "select selector token budget excerpt".split()),
}
# What a promotion adds.
PROMOTED = 180
# Hits of a lane that count, by kind (3 where none is named).
LANE_LIMITS = {
    "task": {"workflow": 1},
    "contract": {"workflow": 2, "selection_logic": 1, "code_snippet": 1, "supporting_context": 1},
    "code": {"contract": 1, "supporting_context": 1},
}
# Bonuses of linked items by edge, and for which kinds they are the higher one.
EDGE_BONUS = {
    "constrains": (110, 80, ["contract"]),
    "consumes": (95, 70, ["workflow", "selection_logic"]),
    "depends_on": (70, 35, ["selection_logic", "code_snippet", "workflow"]),
    "imports": (45, 10, ["selection_logic", "code_snippet", "workflow"]),
}


def path_hits(path: Column | str, terms: Column) -> Column:
    """The first three of the sorted terms that the path contains."""
    return _hits(F.lower(normal_pattern(path)), terms)


def _hits(hay: Column, terms: Column) -> Column:
    return F.slice(F.filter(terms, lambda t: F.contains(hay, t)), 1, 3)


def lane_hits(lane: str, hay: Column | str, kind: Column | str, terms: Column) -> Column:
    """path_hits() of a path in lower case as far as they count for the kind."""
    hay, kind = (F.col(c) if isinstance(c, str) else c for c in (hay, kind))
    most = F.lit(3)
    for name, limit in LANE_LIMITS[lane].items():
        most = F.when(kind == name, limit).otherwise(most)
    return F.slice(_hits(hay, terms), F.lit(1), most)


def scored(items: DataFrame, lanes: dict[str, list[str]], mentioned: Column | None = None, reason: str | None = None) -> DataFrame:
    """items (path, artifact_type, base_reason) with task_hits, contract_hits, code_hits, hits, score and reason.

    lanes: sorted terms of task, contract and code; a few dozen literals, so no join. mentioned: whether the
    request names the item; reason: a column with why it was promoted, null if it was not.
    """
    kind = F.col("artifact_type")
    out = items.withColumn("_hay", F.lower(normal_pattern("path")))  # once a row, not once a term
    out = out.withColumns({f"{lane}_hits": lane_hits(lane, "_hay", "artifact_type", words(sorted(lanes[lane]))) for lane in ("task", "contract", "code")}).drop("_hay")
    out = out.withColumn("hits", F.slice(F.array_distinct(F.concat("task_hits", "contract_hits", "code_hits")), 1, 4))
    has = {lane: F.size(f"{lane}_hits") > 0 for lane in ("task", "contract", "code")}
    support = kind == "supporting_context"
    named = F.lit(mentioned) if isinstance(mentioned, bool) else mentioned if mentioned is not None else F.lit(False)
    why = F.col(reason) if reason else F.lit(None).cast("string")
    points = of_kind(kind, 1)
    for test, gain in (
        (named, 140),
        (has["contract"] & (kind == "contract"), 35),
        (has["code"] & kind.isin("workflow", "selection_logic", "code_snippet"), 35),
        (has["task"] & support, 20),
        (~has["task"] & support, -120),
        (why.isNotNull(), PROMOTED),
        (_top(), 30),
        (F.get(paths.parts("path"), F.lit(0)) == "docs", 25),
        *((((kind == k) & F.exists(words(tokens), lambda t: F.contains(F.lower("path"), t))), gain) for k, (gain, tokens) in NAMED.items()),
    ):
        points = points + F.when(test, gain).otherwise(0)
    points = points + F.least(F.lit(150), 30 * F.size("hits"))
    return out.withColumns({"score": points.cast("int"), "reason": _reason(why, named)})


def _top() -> Column:
    return (F.col("artifact_type") == "supporting_context") & paths.name("path").isin("README.md", "AGENTS.md")


def _reason(why: Column, named: Column) -> Column:
    """What scored() says of an item."""
    alone = (F.col("artifact_type") == "supporting_context") & (F.size("task_hits") == 0)
    return F.concat_ws(
        " ", "base_reason", F.when(named, "The request names it."), F.when(F.size("hits") > 0, F.concat(F.lit("Its path has query terms: "), F.array_join("hits", ", "), F.lit("."))),
        F.when(alone, "It is background only."), why, F.when(_top(), "It frames the whole repository."),
    )


def promoted(rows: DataFrame, why: str) -> DataFrame:
    """rows as scored() makes them without a reason, with what it would say and add with the column why as one."""
    rows = rows.withColumn("score", F.col("score") + F.when(F.col(why).isNotNull(), PROMOTED).otherwise(0))
    return rows.withColumn("reason", F.when(F.col(why).isNull(), F.col("reason")).otherwise(_reason(F.col(why), F.lit(False))))


def path_types(edge_types: Column | str) -> Column:
    """The different edges of a path that mean something, in order; direct_anchor if there is none."""
    edge_types = F.col(edge_types) if isinstance(edge_types, str) else edge_types
    real = F.array_distinct(F.filter(edge_types, lambda t: t != "contains"))
    return F.when(edge_types.isNull(), F.array().cast("array<string>")).when(F.size(real) > 0, real).otherwise(F.array(F.lit("direct_anchor")))


def path_cost(edge_types: Column) -> Column:
    """0 without an edge that means something, 1 or (import) 2 with one, 3 or (imports) 4 with more."""
    real = F.filter(edge_types, lambda t: t != "contains")
    imports = F.array_contains(real, "imports")
    return F.when(F.size(real) == 0, 0).when(F.size(real) == 1, F.when(imports, 2).otherwise(1)).otherwise(F.when(imports, 4).otherwise(3))


def graph_bonus(types: Column, kind: Column) -> Column:
    """What an item's path from the request's anchors adds to its score; types: path_types(), empty without a path."""
    direct = F.when(kind == "contract", 70).when(kind == "workflow", 55).otherwise(30)
    gained = F.lit(0)
    for edge, (high, low, kinds) in EDGE_BONUS.items():
        gained = gained + F.when(F.array_contains(types, edge), F.when(kind.isin(kinds), high).otherwise(low)).otherwise(0)
    linked = F.when(kind == "supporting_context", F.least(gained, F.lit(45))).when(kind == "contract", gained + 25).when(kind == "workflow", gained + 20).otherwise(gained)
    return F.when(F.size(types) == 0, 0).when(F.array_contains(types, "direct_anchor"), direct).otherwise(linked)
