"""GPU and cost telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.numeric import memory_pct, progress_bar, temp_status

# Hourly rate, planned hours, and the scale of each bar.
RATE, PLANNED_HOURS = 2.69, 7
PERCENT_SCALE, POWER_SCALE = 100, 700


def gpu_panel(records: DataFrame) -> DataFrame:
    """Memory share, temperature status and one bar per reading."""
    return records.withColumns({
        "mem_pct": memory_pct("mem_used", "mem_total"),
        "temp_status": temp_status("temp"),
        "gpu_bar": progress_bar("gpu_util", PERCENT_SCALE),
        "mem_bar": progress_bar("mem_used", F.col("mem_total")),
        "temp_bar": progress_bar("temp", PERCENT_SCALE),
        "power_bar": progress_bar("power", POWER_SCALE)})


def cost_tracking(records: DataFrame, rate: float = RATE, planned_hours: float = PLANNED_HOURS,
                  asof: Column | None = None) -> DataFrame:
    """Hours and cost of each run so far, planned cost, hours left."""
    start = F.min(F.unix_micros("ts"))
    end = F.max(F.unix_micros("ts")) if asof is None else F.unix_micros(asof)
    return (records.groupBy("run").agg(((end - start) / 3.6e9).alias("hours"))
            .select("run", "hours", (F.col("hours") * rate).alias("cost"),
                    F.lit(planned_hours * rate).alias("estimated_cost"),
                    F.greatest(F.lit(0.0), planned_hours - F.col("hours")).alias("remaining_hours")))


def run_liveness(records: DataFrame, asof: Column, timeout_seconds: float) -> DataFrame:
    """TRAINING while the last record is recent enough, STOPPED otherwise."""
    age = (F.unix_micros(asof) - F.unix_micros("last_ts")) / 1e6
    return (records.groupBy("run").agg(F.max("ts").alias("last_ts"))
            .withColumn("status", F.when(age <= timeout_seconds, "TRAINING").otherwise("STOPPED")))
