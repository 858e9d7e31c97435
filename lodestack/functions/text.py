"""Column builders for text: trimming, query terms, token estimates, slices, anchors.

All of them stay inside Spark's expressions, so that they are pushed down and compiled with the rest of a plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "..."
#: The first sentence of a text that has none.
NOTHING = "Nothing is said."

# Words that are no query terms.
STOP_WORDS = (
    "the and for with this that from into your their have need keep make mode topic goal focus task handoff package "
    "current should would will then when where what which"
).split()
#: White space as Unicode has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What a slug keeps, and what becomes such a character in lower case.
KEPT, LOWERED = "A-Za-z0-9一-鿿", "\u0130\u212a"
# What counts as a term and as a mentioned path.
TERM_PATTERN = r"[A-Za-z][A-Za-z0-9_]{2,}|[一-鿿]{2,}"
PATH_PATTERN = r"[A-Za-z0-9_./\\-]+\.[A-Za-z0-9_]+"
# Words that raise an anchor's score, by kind of item.
FOCUS = {
    "workflow": "prepare render confirm preview bundle manifest handoff resolve validate entry".split(),
    "selection_logic": "select selector scan score rank excerpt budget token compact context".split(),
    "contract": "schema template reply manifest preview confirm output contract status path".split(),
}
OTHER_FOCUS = "problem goal question research overview readme agent".split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values) -> Column:
    """A literal array of strings, made in one call however long it is."""
    quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"cast(array({', '.join(quoted)}) as array<string>)")


def strip(c: Column | str) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.btrim(col(c), F.lit(WHITE))


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normal_pattern(c: Column | str) -> Column:
    """A path as it is compared: trimmed, with slashes, without ./ in front."""
    return F.regexp_replace(F.translate(strip(c), "\\", "/"), r"^(\./)+", "")


def normal_term(c: Column | str) -> Column:
    """A query term in lower case with _ for -; null for stop words and nothing."""
    t = F.regexp_replace(F.translate(F.lower(strip(c)), "-", "_"), "^_+|_+$", "")
    return F.when((F.length(t) > 0) & ~t.isin(STOP_WORDS), t)


def query_terms(c: Column | str) -> Column:
    """The different terms of a text: identifiers, runs of Han characters, and the stem of the whole as a path."""
    from lodestack.functions.paths import stem

    text = normal_pattern(c)
    found = F.transform(F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)), normal_term)
    return F.array_distinct(F.filter(F.concat(found, F.array(normal_term(stem(text)))), lambda t: t.isNotNull()))


def quarter_units(c: Column | str) -> Column:
    """Token estimate in quarters: 1 an ASCII character, 4 any other. Adds up over pieces."""
    c = col(c)
    return (F.length(c) + 3 * F.length(F.regexp_replace(c, r"[\x00-\x7F]+", ""))).cast("bigint")


def estimate_tokens(c: Column | str) -> Column:
    return F.ceil(quarter_units(c) / 4).cast("bigint")


def slice_head(c: Column | str, tokens: int) -> Column:
    """The longest start that is estimated at no more than so many tokens; it ends before the first character that does not fit."""
    c, units = col(c), 4 * max(tokens, 0)
    ahead = F.left(c, F.lit(units))
    return F.when(F.length(F.regexp_replace(ahead, r"[\x00-\x7F]+", "")) == 0, ahead).otherwise(F.left(ahead, _fitting(ahead, units)))


def slice_tail(c: Column | str, tokens: int) -> Column:
    """The longest end that is estimated at no more than so many tokens."""
    c, units = col(c), 4 * max(tokens, 0)
    behind = F.right(c, F.lit(units))
    return F.when(F.length(F.regexp_replace(behind, r"[\x00-\x7F]+", "")) == 0, behind).otherwise(F.right(behind, _fitting(F.reverse(behind), units)))


def _fitting(c: Column, units: int) -> Column:
    """How many of the first characters fit; c has no more than units of them."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))

    def step(s: Column, ch: Column) -> Column:
        weight = F.when(ch.rlike(r"[\x00-\x7F]"), 1).otherwise(4)
        fits = s["on"] & (s["units"] + weight <= units)
        return F.struct((s["units"] + F.when(fits, weight).otherwise(0)).alias("units"), (s["n"] + F.when(fits, 1).otherwise(0)).alias("n"), fits.alias("on"))

    return F.aggregate(chars, F.struct(F.lit(0).alias("units"), F.lit(0).alias("n"), F.lit(True).alias("on")), step, lambda s: s["n"])


def clip(c: Column | str, most: int) -> Column:
    c = squeeze(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(strip(F.left(c, F.lit(most - len(ELLIPSIS)))), F.lit(ELLIPSIS)))


def first_sentence(c: Column | str, most: int = 160) -> Column:
    """Up to the first end of a sentence within so many characters and one, else so many characters."""
    c = squeeze(c)
    found = strip(F.regexp_extract(c, "^(.{1,%d}?[.!?。；;])" % most, 1))
    cut = F.concat(strip(F.left(c, F.lit(most))), F.when(F.length(c) > most, ELLIPSIS).otherwise(""))
    return F.when(F.length(c) == 0, NOTHING).when(F.length(found) > 0, found).otherwise(cut)


def fitted(c: Column | str, tokens: int) -> Column:
    """The text on one line, or the start of it that is estimated at so many tokens with ... at its end."""
    c = squeeze(c)
    start = F.regexp_replace(slice_head(c, tokens - 1), r"(?U)\s+$", "")
    return F.when(estimate_tokens(c) <= tokens, c).otherwise(F.concat(start, F.lit(ELLIPSIS)))


def brief(c: Column | str, tokens: int) -> Column:
    """A Markdown text in short: without the marks of its headings, fitted() to so many tokens."""
    return fitted(F.regexp_replace(col(c), r"(?U)#+\s*", ""), tokens)


def dedupe(values: Column | str) -> Column:
    """Trimmed values in order, the first of equal ones, none empty."""
    return F.array_distinct(F.filter(F.transform(col(values), strip), lambda v: F.length(v) > 0))


def bullets(values: Column | str, fallback: str) -> Column:
    kept = F.filter(F.transform(col(values), strip), lambda v: F.length(v) > 0)
    return F.when(F.size(kept) == 0, f"- {fallback}").otherwise(F.array_join(F.transform(kept, lambda v: F.concat(F.lit("- "), clip(v, 240))), "\n"))


def slug(c: Column | str, most: int = 40, fallback: str = "bundle") -> Column:
    """ASCII letters and digits and Han characters in lower case, with _ between.

    Of the text only what the slug needs is worked on: up to the first most + 1 characters that it keeps.
    """
    known = KEPT + LOWERED
    start = F.regexp_extract(col(c), f"^[^{known}]*+((?:[{known}][^{known}]*+){{0,{most + 1}}}+)", 1)
    s = F.regexp_replace(F.lower(start), f"[^{KEPT}]+", "_")
    s = F.regexp_replace(F.left(F.regexp_replace(s, "^_+|_+$", ""), F.lit(most)), "_+$", "")
    return F.when(F.length(s) > 0, s).otherwise(fallback)


def count_within(haystack: Column, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(haystack, t)))


def anchor_score(anchor: Column | str, kind: Column | str, terms: Column, hint: Column | str = "") -> Column:
    """40, 30 for each query term and 35 for each focus word of the item's kind in the anchor and the hint."""
    hint = F.lit(hint) if isinstance(hint, str) else hint
    hay = F.translate(F.lower(F.concat(col(anchor), F.lit(" "), hint)), "-", "_")
    focus = F.lit(None).cast("array<string>")
    for name, own in FOCUS.items():
        focus = F.coalesce(focus, F.when(col(kind) == name, words(own)))
    return 40 + 30 * count_within(hay, terms) + 35 * count_within(hay, F.coalesce(focus, words(OTHER_FOCUS)))
