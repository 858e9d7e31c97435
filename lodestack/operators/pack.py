"""Excerpts within a token budget, and the choice of budgets and items that fits a whole bundle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.frames import cut
from lodestack.functions import paths, tokens
from lodestack.functions.text import estimate_tokens, quarter_units, strip, words
from lodestack.operators.extract import segments, strategy

SEPARATOR, GAP, REST = "\n\n", "\n\n[... middle left out ...]\n\n", "\n[... rest left out ...]"
NAMES, SAMPLES = "Names that the contract fixes:", "Samples:"
#: Samples of a digest at most.
MOST_SAMPLES = 3
# Tokens that an excerpt of a contract must keep.
ALWAYS = "handoff_id preview confirmed archived brief.md bundle.md reply_template.md".split()
SCHEMA_TOKENS = "handoff_id preview confirmed archived status paths artifacts brief.md bundle.md reply_template.md".split()
REPLY_TOKENS = (
    "handoff_id preview confirmed archived brief.md bundle.md reply_template.md schema_version topic mode source_provider source_channel generated_at generated_from "
    "reply_template_version language contains_external_sources status"
).split() + ["## 问题定义", "## 最终结论", "## 推荐路线", "## 备选路线", "## 关键依据", "## 风险与反例", "## 候选论文/资料", "## 建议下一步", "## 仍未解决的问题"]
# How a report names what was done to an item.
DIGEST, PLAIN, EMPTY, FALLBACK = "typed_digest_compaction", "full_text", "empty_text", "head_tail_fallback"
# The least budget, and the part by which budgets shrink.
FLOOR, SHRINK = 96, 5
#: Steps from a budget of 2^31 to FLOOR, and some.
STEPS = 100
# The order in which items are dropped.
DROP_ORIGIN = {"auto": 0, "mentioned": 1, "must_include": 2}
DROP_KIND = {"supporting_context": 0, "code_snippet": 1, "selection_logic": 2, "workflow": 3, "contract": 4}

EXCERPT = "struct<text:string,truncated:boolean,method:string,strategy:string,anchors:array<string>,compaction:string,fallback:boolean,kept_tokens:boolean>"
_ARROW = pa.struct([("text", pa.string()), ("truncated", pa.bool_()), ("method", pa.string()), ("strategy", pa.string()), ("anchors", pa.list_(pa.string())), ("compaction", pa.string()), ("fallback", pa.bool_()), ("kept_tokens", pa.bool_())])


def greedy(segs: DataFrame, limit: int) -> DataFrame:
    """Per path the excerpt of its segments: by priority each that still fits is taken, those that don't are passed over, and what was taken stands in the order of the text.

    A fold over each item's own segments; a running sum would stop at the first that does not fit.
    """
    rows = _ranked(segs, estimate_tokens).withColumn("t", _taken(F.lit(limit), math.ceil(len(SEPARATOR) / 4)))
    return rows.where("size(t) > 0").select("path", *_placed())


def _placed() -> tuple[Column, Column]:
    return F.array_join(F.transform("t", lambda s: s["text"]), SEPARATOR).alias("excerpt"), F.transform("t", lambda s: s["anchor"]).alias("anchors")


def _ranked(segs: DataFrame, tokens: Callable[[Column], Column], *more: Column) -> DataFrame:
    """Per path its segments that have text, by priority, as ranked, and more aggregates."""
    rows = segs.withColumns({"text": strip("text")}).withColumn("n", tokens(F.col("text")))
    one = F.when(F.col("text") != "", F.struct((-F.col("priority")).alias("p"), "seg", "n", "anchor", "text"))
    return rows.groupBy("path").agg(F.sort_array(F.collect_list(one)).alias("ranked"), *more)


def _taken(limit: Column, gap: int) -> Column:
    """Of the column ranked what greedy() takes within limit, with so many tokens between two segments."""
    empty = F.filter("ranked", lambda s: F.lit(False))

    def take(state: Column, s: Column) -> Column:
        more = s["n"] + F.when(F.size(state["taken"]) > 0, gap).otherwise(0)
        fits = state["used"] + more <= limit
        return F.struct(F.when(fits, state["used"] + more).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["taken"], F.array(s))).otherwise(state["taken"]).alias("taken"))

    taken = F.aggregate("ranked", F.struct(F.lit(0).cast("bigint").alias("used"), empty.alias("taken")), take, lambda s: s["taken"])
    return F.array_sort(F.transform(taken, lambda s: F.struct(s["seg"], s["anchor"], s["text"])))


def critical_tokens(path: Column | str, text: Column | str) -> Column:
    """The fixed tokens of a contract that its text holds, in their order."""
    path, text = (F.col(c) if isinstance(c, str) else c for c in (path, text))
    schema = F.contains(path, F.lit("schema")) | F.endswith(path, F.lit(".json"))
    want = F.when(F.contains(path, F.lit("reply_template")), words(dict.fromkeys(REPLY_TOKENS))).when(schema, words(SCHEMA_TOKENS)).otherwise(words(ALWAYS))
    return F.filter(want, lambda t: F.contains(text, t))


def count(text: str) -> int:
    """estimate_tokens() for the helpers below."""
    return (len(text) + 3 * (len(text) - len(text.encode("ascii", "ignore"))) + 3) // 4


def head(text: str, tokens: int) -> str:
    ahead = text[: 4 * max(tokens, 0)]
    if ahead.isascii():
        return ahead
    used = 0
    for i, c in enumerate(ahead):
        used += 1 if c < "\x80" else 4
        if used > 4 * tokens:
            return ahead[:i]
    return ahead


def tail(text: str, tokens: int) -> str:
    return head(text[: -4 * max(tokens, 0) - 1 : -1], tokens)[::-1]


def units(text: str) -> int:
    """quarter_units() for the helpers below; they add up, so a line's cost is known before it is put in."""
    return len(text) + 3 * (len(text) - len(text.encode("ascii", "ignore")))


class Estimate:
    """How the helpers below measure texts: by the estimate, of which quarters add up."""

    count, head, tail, units = staticmethod(count), staticmethod(head), staticmethod(tail), staticmethod(units)


@dataclass(frozen=True)
class Exact:
    """The same by a vocabulary. Tokens of parts don't quite add up to those of the whole, so what is put together of them is counted again."""

    ranks: str
    pattern: str

    def count(self, text: str) -> int:
        return tokens.count_of(text, self.ranks, self.pattern)

    def _part(self, text: str, most: int, from_end: bool) -> str:
        """As many tokens as still are no more than most when the part is counted by itself; characters are never split."""
        for n in range(most, 0, -1):
            said = tokens.part(text, n, self.ranks, self.pattern, from_end).strip("\ufffd")
            if self.count(said) <= most:
                return said
        return ""

    def head(self, text: str, most: int) -> str:
        return self._part(text, most, False)

    def tail(self, text: str, most: int) -> str:
        return self._part(text, most, True)

    def units(self, text: str) -> int:
        return 4 * self.count(text)


def ends(text: str, limit: int, m=Estimate) -> tuple[str, str]:
    """A start of about 70 % and an end of the text with GAP between, as long as fits, and how it was cut."""
    room = 4 * limit - m.units(GAP)
    if room >= 8:
        first = max(1, room // 4 * 7 // 10)
        a, b = m.head(text, first).rstrip(), m.tail(text, max(1, room // 4 - first)).lstrip()
        return a + GAP + b, f"head_tail_tokens:{m.count(a)}+{m.count(b)}"
    rest = m.head(REST, limit)
    a = m.head(text, limit - m.count(rest)).rstrip()
    return a + rest, f"head_tokens:{m.count(a)}"


def clipped(text: str, limit: int, m=Estimate) -> str:
    """The text on one line, its start and ... if that is too long."""
    text = " ".join(text.split())
    return text if m.count(text) <= limit else m.head(m.head(text, limit - 1).rstrip() + "...", limit)


def filled(start: str, options: list[tuple[str, str]], limit: int, m=Estimate, stop: tuple[str, ...] = ()) -> tuple[str, list[int]]:
    """start and the options (heading, line) that fit, each tried once in their order, under their headings; and which were taken.

    A heading comes with the first of its lines, and costs with it. Under headings of stop, no line comes
    after one that does not fit.
    """
    room, said, taken, full = 4 * limit - m.units(start), {}, [], set()
    for i, (heading, line) in enumerate(options):
        if heading in full:
            continue
        cost = m.units(f"\n* {line}") + (0 if heading in said else m.units(f"\n{heading}"))
        if cost <= room:
            room -= cost
            said.setdefault(heading, []).append(f"* {line}")
            taken.append(i)
        elif heading in stop:
            full.add(heading)
    return "\n".join([start, *("\n".join([h, *lines]) for h, lines in said.items())]), taken


def digest(path: str, kind: str, how: str, segs: list[dict], limit: int, critical: list[str], m=Estimate) -> tuple[str, list[str]]:
    """What an item is, then its critical tokens, summaries by priority and a few samples, each as far as it fits; and the anchors of the summaries."""
    ranked = sorted(segs, key=lambda s: (-s["priority"], s["anchor"]))
    samples = [s["snippet"] for s in ranked if s["snippet"]][:MOST_SAMPLES]
    options = [(NAMES, t) for t in critical] + [("Parts:", s["summary"]) for s in ranked] + [(SAMPLES, t) for t in samples]
    text, taken = filled(f"{path} in short ({kind}, {how})", options, limit, m)
    first = len(critical)
    return text, [ranked[i - first]["anchor"] for i in taken if first <= i < first + len(ranked)]


def names_only(path: str, critical: list[str], limit: int, m=Estimate) -> str:
    """The critical tokens up to the first that does not fit."""
    return filled(f"{path} in short", [(NAMES, t) for t in critical], limit, m, (NAMES,))[0]


def completed(structured: str | None, critical: list[str], limit: int, m=Estimate) -> str | None:
    """The structured excerpt with the critical tokens that it lacks at its end; null if they don't all fit."""
    lacking = [t for t in critical if t not in (structured or "")]
    if not structured or not lacking:
        return structured or None
    text, taken = filled(structured.rstrip() + "\n", [(NAMES, t) for t in lacking], limit, m)
    return text if len(taken) == len(lacking) else None


def rungs(path: str, text: str, kind: str, how: str, structured: str | None, anchors: list[str], segs: list[dict], critical: list[str], limit: int, m=Estimate) -> Iterator[tuple]:
    """What stands for a text, the best first: (text, method, strategy, anchors, compaction, fallback)."""
    if segs:
        if whole := completed(structured, critical, limit, m):
            yield whole, how, how, anchors, "none", False
        short, kept = digest(path, kind, how, segs, limit, critical, m)
        for t in [short, *([names_only(path, critical, limit, m)] if critical else []), clipped(short, limit, m)]:
            yield t, f"{DIGEST}:{how}", how, kept, DIGEST, False
    yield text, PLAIN, PLAIN, [], "none", False
    if critical:
        yield names_only(path, critical, limit, m), f"{DIGEST}:critical_tokens", how, [], DIGEST, False
    for room in range(limit, 0, -1):  # by exact counts the two ends and what joins them may need a little less room
        short, method = ends(text, room, m)
        yield short, method, FALLBACK, [], method.partition(":")[0], True
    yield "", "head_tokens:0", FALLBACK, [], "head_tokens", True


def ladder(path: str, text: str, kind: str, how: str, structured: str | None, anchors: list[str], segs: list[dict], critical: list[str], limit: int, m=Estimate) -> dict:
    """The first rung that fits the limit: structured segments, a digest, the whole text, its critical tokens, its start and end."""
    if not text:
        return dict(zip(_ARROW.names, ("", False, EMPTY, EMPTY, [], "none", False, False)))
    steps = rungs(path, text, kind, how, structured, anchors, segs, critical, limit, m)
    said, method, strategy, kept, compaction, fallback = next(r for r in steps if m.count(r[0]) <= limit)
    return dict(zip(_ARROW.names, (said, said != text, method, strategy, kept, compaction, fallback, all(t in said for t in critical))))


def _ladders(m):
    def climb(path: pa.Array, text: pa.Array, kind: pa.Array, how: pa.Array, structured: pa.Array, anchors: pa.Array, segs: pa.Array, critical: pa.Array, limit: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (path, text, kind, how, structured, anchors, segs, critical, limit)))
        return pa.array([ladder(p, t, k, h, s, a or [], g or [], c or [], n, m) for p, t, k, h, s, a, g, c, n in rows], _ARROW)

    return climb


def excerpts(items: DataFrame, terms: Column, limit: int | Column, segs: DataFrame | None = None, exact: Exact | None = None) -> DataFrame:
    """items (path, content, artifact_type) with excerpt, the struct of EXCERPT, within limit, which may be a column of items.

    Segments don't depend on the limit and can be given. exact: a vocabulary by which all is counted, in place of the estimate.
    """
    segs = segments(items, terms) if segs is None else segs
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    own = F.sort_array(F.collect_list(F.struct("seg", "anchor", "summary", "priority", "snippet"))).alias("_segs")
    tokens_of = (lambda c: tokens.exact_tokens(c, exact.ranks, exact.pattern)) if exact else estimate_tokens
    rows = items.join(_ranked(segs, tokens_of, own), "path", "left").withColumn("t", _taken(limit, exact.count(SEPARATOR) if exact else math.ceil(len(SEPARATOR) / 4)))
    rows = rows.withColumns(dict(zip(("_structured", "_anchors"), _placed()))).drop("t", "ranked")
    text = strip("content")
    critical = F.when(F.col("artifact_type") == "contract", critical_tokens("path", text)).otherwise(F.array().cast("array<string>"))
    made = F.arrow_udf(_ladders(exact or Estimate), EXCERPT)("path", text, "artifact_type", strategy("path"), "_structured", "_anchors", "_segs", critical, limit.cast("int"))
    return rows.withColumn("excerpt", made).drop("_structured", "_anchors", "_segs")


def budget_steps(start: int) -> list[int]:
    """Budgets from start on, each a fifth less than the one before, down to FLOOR."""
    out = [start]
    while out[-1] > FLOOR:
        out.append(max(FLOOR, out[-1] - max(1, out[-1] // SHRINK)))
    return out


def budgets(start: Column) -> Column:
    """budget_steps() of a column of budgets up to 2^31, as an array; one of FLOOR or less is the only one."""
    floor = F.lit(FLOOR).cast("bigint")
    less = lambda b: F.greatest(floor, b - F.greatest(F.lit(1).cast("bigint"), F.floor(b / SHRINK)))
    last = lambda a: F.element_at(a, -1)
    more = lambda a, _: F.when(last(a) > FLOOR, F.concat(a, F.array(less(last(a))))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array(start.cast("bigint")), more)


def drop_rank(origin: Column | str = "origin", kind: Column | str = "artifact_type") -> tuple[Column, Column]:
    a, b = F.lit(2), F.lit(5)
    for name, rank in DROP_ORIGIN.items():
        a = F.when(F.col(origin) == name, rank).otherwise(a)
    for name, rank in DROP_KIND.items():
        b = F.when(F.col(kind) == name, rank).otherwise(b)
    return a, b


def drop_until_fit(sized: DataFrame, group: list[str], limit: int, frame_units: int = 0, note_units: Column | None = None) -> DataFrame:
    """sized (group, path, origin, artifact_type, n_tokens, units) with dropped: the shortest run of items, in the order of dropping, without which the rest fits the limit.

    Included items and contracts stay. Quarter-units add up, so a running sum over each group tells;
    a group is a bundle, with as many items as a request may select. note_units: what is still said of an item that is dropped.
    """
    free = (F.col("origin") != "must_include") & (F.col("artifact_type") != "contract")
    a, b = drop_rank()
    order = Window.partitionBy(*group).orderBy(F.when(free, 0).otherwise(1), a, b, F.desc("n_tokens"), "path")
    gain = F.col("units") - (F.lit(0) if note_units is None else note_units)
    before = F.coalesce(F.sum(gain).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("units").over(Window.partitionBy(*group))
    return sized.withColumn("dropped", free & (F.ceil((total - before + frame_units) / 4) > limit))


class Fitted:
    """The items of one bundle with their excerpts under every budget that it may shrink to, sized in one pass.

    All budgets shrink in step, so the steps are known (budget_steps): each item is a row for each of them, and
    one job makes and sizes all excerpts. Which budget fits and what is dropped beyond the last are sums over
    these rows. units: four times the tokens of what is said of an item with its excerpt; note_units: of one
    that is dropped.
    """

    def __init__(self, items: DataFrame, terms: Column, per_item: int, units: Column, frame_units: int, note_units: Column | None = None, exact: Exact | None = None):
        self.note, self.frame = F.lit(0) if note_units is None else note_units, frame_units
        rows = items.withColumn("_budget", F.explode(F.array(*map(F.lit, budget_steps(per_item)))))
        self.made = cut(excerpts(rows, terms, F.col("_budget"), segments(items, terms), exact).withColumn("units", units))
        used = {r[0]: r[1] for r in self.made.groupBy("_budget").agg(F.sum("units")).collect()}
        #: Tokens of the bundle under each budget, the largest first.
        self.used = [(step, math.ceil((used.get(step, 0) + frame_units) / 4)) for step in budget_steps(per_item)]

    def choose(self, limit: int) -> tuple[DataFrame, int]:
        """The items (dropped or not) under the first budget at which all fit, and it; under the last without those that must go. Raises if the others don't fit."""
        step = next((step for step, used in self.used if used <= limit), None)
        if step is not None:
            return self.made.where(F.col("_budget") == step).drop("_budget").withColumn("dropped", F.lit(False)), step
        step = self.used[-1][0]
        out = cut(drop_until_fit(self.made.where(F.col("_budget") == step).drop("_budget"), [], limit, self.frame, self.note))
        left = out.agg(F.sum(F.when(F.col("dropped"), self.note).otherwise(F.col("units")))).first()[0] or 0
        if math.ceil((left + self.frame) / 4) > limit:
            raise ValueError(f"Items that must stay don't fit {limit} tokens")
        return out, step


def fit(items: DataFrame, terms: Column, limit: int, per_item: int, units: Column, frame_units: int, note_units: Column | None = None) -> tuple[DataFrame, int]:
    """Excerpts of the items of one bundle under the first budget at which all fit, and that budget; see Fitted."""
    return Fitted(items, terms, per_item, units, frame_units, note_units).choose(limit)


# The state of an item that is attached only.
NOT_IN_BUNDLE, ATTACHED_LAYER, ATTACHED_KIND = "not_in_bundle", "attachments", "attachments_only"


def settled(made: DataFrame) -> DataFrame:
    """Items (dropped or not) with included and, of those that are dropped, the state of what is attached only: no excerpt, anchors or tokens, and its layer and kind."""
    empty = F.struct(
        F.lit("").alias("text"), F.lit(False).alias("truncated"), F.lit(NOT_IN_BUNDLE).alias("method"), F.lit(NOT_IN_BUNDLE).alias("strategy"), F.array().cast("array<string>").alias("anchors"),
        F.lit("none").alias("compaction"), F.lit(False).alias("fallback"), F.lit(False).alias("kept_tokens"),
    )
    gone = {"excerpt": empty, "context_layer": F.lit(ATTACHED_LAYER), "artifact_type": F.lit(ATTACHED_KIND)}
    return made.withColumns({"included": ~F.col("dropped"), **{c: F.when(F.col("dropped"), v).otherwise(F.col(c)) for c, v in gone.items()}})


def language(path: Column | str, compaction: Column | str) -> Column:
    """The name of the language of an excerpt's fence."""
    end = F.lower(paths.suffix(path))
    named = {".py": "python", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml"}
    out = F.lit("text")
    for e, name in named.items():
        out = F.when(end == e, name).otherwise(out)
    return F.when((F.col(compaction) if isinstance(compaction, str) else compaction) == DIGEST, "text").otherwise(out)
