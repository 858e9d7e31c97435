"""Corpora: anything with path and content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths that stand for documents of a table, by doc_id modulo 10, so that every kind of item occurs.
DOCUMENT_PATHS = [
    "concat('schemas/', source, '_', doc_id, '.json')", "concat('templates/', lang, '/t_', doc_id, '.md')", "concat(source, '/wf_', doc_id, '/workflow.py')",
    "concat(source, '/sel_', doc_id, '/selector.py')", "concat(source, '/mod_', doc_id, '.py')", "concat('docs/', lang, '/d_', doc_id, '.md')",
    "concat(source, '/log/run_', doc_id, '.out')", "concat('data/', source, '_', doc_id, '.csv')", "concat('conf/', lang, '_', doc_id, '.toml')", "concat('README_', doc_id, '.md')",
]


def documents_corpus(docs: DataFrame) -> DataFrame:
    """A table of documents as a corpus: ord, path, content, and lang and source."""
    path = F.expr("case doc_id % 10 " + " ".join(f"when {k} then {p}" for k, p in enumerate(DOCUMENT_PATHS)) + " end")
    return docs.select(F.col("doc_id").alias("ord"), path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), "lang", "source")
