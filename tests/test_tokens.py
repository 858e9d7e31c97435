"""Exact counts and slices against the tokenizer itself."""

import pytest

from lodestack.functions import tokens


def test_exact_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    ranks, pattern = str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN
    texts = ["", None, "Plain words, and more.", "é漢字😀 " * 5, "<|endoftext|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tokens.exact_tokens("t", ranks, pattern), tokens.exact_slice("t", 3, ranks, pattern), tokens.exact_slice("t", 3, ranks, pattern, True), tokens.exact_slice("t", 0, ranks, pattern)).collect()
    e = tokens._encoding(ranks, pattern)
    for t, r in zip(texts, got):
        ids = e.encode_ordinary(t or "")
        assert tuple(r) == (len(ids), e.decode(ids[:3]), e.decode(ids[-3:]), "")
