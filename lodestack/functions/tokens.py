"""Exact token counts and slices by a vocabulary of ranks, where the estimate of text.estimate_tokens() is not enough."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import col


@lru_cache(2)
def _encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=known, special_tokens={})


def count_of(text: str, ranks: str, pattern: str) -> int:
    return len(_encoding(ranks, pattern).encode_ordinary(text)) if text else 0


def part(text: str, tokens: int, ranks: str, pattern: str, from_end: bool = False) -> str:
    """The first (or last) so many tokens of a text; a character that the cut splits becomes U+FFFD."""
    e = _encoding(ranks, pattern)
    ids = e.encode_ordinary(text) if tokens > 0 else []
    return e.decode(ids[-tokens:] if from_end else ids[:tokens])


def exact_tokens(c: Column | str, ranks: str, pattern: str) -> Column:
    """Tokens of each text (null: 0). ranks: a file of base64 tokens and ranks that every machine has; pattern: how texts are split."""

    def count(x: pa.Array) -> pa.Array:
        return pa.array([count_of(t or "", ranks, pattern) for t in x.to_pylist()], pa.int64())

    return F.arrow_udf(count, "bigint")(col(c))


def exact_slice(c: Column | str, tokens: int, ranks: str, pattern: str, from_end: bool = False) -> Column:
    """part() of each text, a null one being empty."""

    def cut(x: pa.Array) -> pa.Array:
        return pa.array([part(t or "", tokens, ranks, pattern, from_end) for t in x.to_pylist()], pa.string())

    return F.arrow_udf(cut, "string")(col(c))
