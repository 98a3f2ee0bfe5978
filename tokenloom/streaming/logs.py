"""Incremental log parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.operators.runlog import parse_points
from tokenloom.streaming.tail import BLOCK_BYTES, stream_lines

REFRESH = "10 seconds"


def stream_log_points(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Points of both grammars from logs as they grow, one run per file path.

    ``position`` is the byte where a point's line starts; it orders the points of a run. A line
    is parsed once it is complete. The parse is stateless, so nothing is shuffled. An empty or
    missing folder yields nothing until the first file arrives.
    """
    lines = stream_lines(spark, path, block_bytes).withColumnRenamed("position", "line_no")
    return parse_points(lines.select("run", "line_no", "line")).withColumnRenamed("line_no", "position")
