"""Windowed GPU telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.sources.logs import GPU_FIELDS

REFRESH = "5 seconds"
LATENESS = "1 minute"


def telemetry_windows(records: DataFrame, width: str = REFRESH) -> DataFrame:
    """Mean and peak readings per run and tumbling window; works on tables and streams."""
    return (records.groupBy("run", F.window("ts", width).alias("w"))
            .agg(F.count("*").alias("readings"),
                 *[F.avg(c).alias(f"avg_{c}") for c in GPU_FIELDS], F.max("temp").alias("max_temp"))
            .select("run", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "readings", *[f"avg_{c}" for c in GPU_FIELDS], "max_temp"))


def stream_telemetry(records: DataFrame, width: str = REFRESH, lateness: str = LATENESS) -> DataFrame:
    """The same over a stream. A window is emitted once, when the watermark passes its
    end; records later than the lateness are dropped by the watermark."""
    return telemetry_windows(records.withWatermark("ts", lateness), width)
