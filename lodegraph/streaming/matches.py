"""Matches of vertices that arrive as a stream: each micro-batch is matched against the standing graph and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import Graph
from ..operators.match import candidates
from ..plans.query import Query


def candidate_stream(vertices: DataFrame, query: Query, tau: float) -> DataFrame:
    """(u, v, score) of a stream of vertices (id, x): stateless, so it runs in append mode without a watermark."""
    return candidates(Graph(vertices, None), query, tau)


def append_candidates(vertices: DataFrame, query: Query, tau: float, path: str, checkpoint: str) -> StreamingQuery:
    return candidate_stream(vertices, query, tau).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
