"""Which of many terms a text contains."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.frames import saved

#: Characters of all terms together up to which one automaton holds them (about 100 bytes each in a worker).
AUTOMATON_CHARS = 500_000
#: Characters that the starts of terms may have together, and how long starts may be, the best first.
START_CHARS, STARTS = 100_000, (32, 24, 16, 12, 8, 6, 4, 3, 2, 1)
#: White space in a term.
_WHITE = r"\s+"

_built: dict = {}


def _automaton(name: str, known: list[tuple]):
    """The automaton of known (term, value), built once in each worker; its transitions are followed a character at a time, whatever the number of terms."""
    if name not in _built:
        import ahocorasick

        made = ahocorasick.Automaton()
        for term, value in known:
            made.add_word(term, value)
        made.make_automaton()
        _built.clear()
        _built[name] = made
    return _built[name]


def _found(spark: SparkSession, content: Column | str, known: list[tuple[str, tuple[int, tuple[int, ...]]]]) -> Column:
    """The different parts of each text that begin with one of known and have one of its lengths, from one pass over it.

    known: (start, (its length, sorted lengths of what begins with it)); of a whole term the only length is its own.
    """
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(known)

    def parts(text: str, automaton) -> set[str]:
        out = set()
        for end, (own, lengths) in automaton.iter(text):
            at = end - own + 1
            for n in lengths:
                if at + n > len(text):
                    break
                out.add(text[at : at + n])
        return out

    def find(column: pa.Array) -> pa.Array:
        if not sent.value:
            return pa.array([[]] * len(column), pa.list_(pa.string()))
        automaton = _automaton(name, sent.value)
        return pa.array([sorted(parts(t, automaton)) if t else [] for t in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(find, "array<string>")(content)


class Terms:
    """Different terms (column term) made ready to be looked for in texts, by parts() in the pass that reads them and met() after it.

    Terms of up to `limit` characters together (AUTOMATON_CHARS) go into one automaton that is sent to the
    tasks; each text is read once, in time proportional to its length and its matches, and none is shuffled.
    Of more terms than that, which no task could hold, the automaton has only the starts, as long as START_CHARS
    allows (they are the shorter, the more terms begin differently; single characters always fit). Where a text
    has a start, its parts of the lengths that terms with this start have are looked up among the terms by
    equality, so only these parts are shuffled. limit changes no row. Terms of white space alone are left out.
    """

    def __init__(self, terms: DataFrame, limit: int | None = None):
        self.terms = saved(terms.select("term").where(F.length(F.regexp_replace("term", _WHITE, "")) > 0).distinct(), "terms")
        chars = self.terms.agg(F.sum(F.length("term"))).first()[0] or 0
        self.whole = chars <= (AUTOMATON_CHARS if limit is None else limit)
        self.known = [(t, (len(t), (len(t),))) for t in sorted(r.term for r in self.terms.collect())] if self.whole else self._starts()

    def _starts(self) -> list[tuple]:
        differ = self.terms.agg(*(F.approx_count_distinct(F.left("term", F.lit(n))).alias(str(n)) for n in STARTS)).first()
        most = next((n for n in STARTS if n * differ[str(n)] <= START_CHARS), STARTS[-1])
        starts = self.terms.groupBy(F.left("term", F.lit(most)).alias("start")).agg(F.sort_array(F.collect_set(F.length("term"))).alias("lengths")).collect()
        return [(r.start, (len(r.start), tuple(r.lengths))) for r in starts]

    def parts(self, content: Column | str) -> Column:
        """What each text has of the terms, or of what begins like one, as an array; empty for a null one."""
        return _found(self.terms.sparkSession, content, self.known)

    def met(self, rows: DataFrame, parts: str) -> DataFrame:
        """rows without the column parts, and term: each term of their parts once for each different row."""
        out = rows.select(*(c for c in rows.columns if c != parts), F.explode(parts).alias("term"))
        return (out if self.whole else out.join(self.terms, "term").select(*out.columns)).distinct()


def contained(texts: DataFrame, content: str, terms: DataFrame, limit: int | None = None) -> DataFrame:
    """texts' columns but content, and term: each term (column term) once for each different row whose content contains it anywhere.

    Null texts and empty terms meet nothing, and terms of white space alone are left out; no text meets a term
    that it does not hold. See Terms.
    """
    keep = [c for c in texts.columns if c != content]
    known = Terms(terms, limit)
    if not known.known:
        return texts.select(*keep, F.lit("").alias("term")).limit(0)
    return known.met(texts.select(*keep, known.parts(content).alias(content)), content)
