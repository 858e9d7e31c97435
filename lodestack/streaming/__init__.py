"""Corpora that arrive as streams.

catalog() and scored() keep no state, so they take a streaming DataFrame as it is; what needs a whole corpus
(rankings, the graph, bundles) is run over what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators.catalog import Exclusions, catalog, excluded


def write_catalog(stream: DataFrame, out: str, checkpoint: str, rules: Exclusions = Exclusions()) -> StreamingQuery:
    """Classifies a stream of path and content, leaves excluded items out and appends the rest as Parquet, each item once."""
    kept = catalog(stream.where(~excluded("path", rules)))
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
