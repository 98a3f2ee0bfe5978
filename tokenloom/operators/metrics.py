"""Metric tables: schedules, step counters, norms, histograms, run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.numeric import lr_multiplier
from tokenloom.plans.joins import lookup_join
from tokenloom.plans.ordered import running_sums
from tokenloom.session import written


def lr_audit(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Logged against expected learning rate.

    The schedule spans all iterations but advances once per ``grad_accum_steps`` of them.
    ``runs`` has lr, iterations, warmup_ratio, min_lr_ratio and grad_accum_steps. Points of a
    run without settings stay, with nulls.
    """
    joined = lookup_join(points.select("run", "iteration", F.col("lr").alias("logged_lr")), runs, ["run"])
    step = F.expr("iteration div grad_accum_steps")
    warmup = (F.col("iterations") * F.col("warmup_ratio")).cast("bigint")
    expected = F.col("lr") * lr_multiplier(step, warmup, F.col("iterations"), F.col("min_lr_ratio"))
    return (joined.select("run", "iteration", step.alias("scheduler_step"), "logged_lr",
                          expected.alias("expected_lr"))
            .withColumn("abs_diff", F.abs(F.col("logged_lr") - F.col("expected_lr"))))


def auto_step(metrics: DataFrame, order: str = "call_no") -> DataFrame:
    """Fill missing steps from a per-run counter that only such calls advance."""
    missing = F.col("step").isNull().cast("bigint")
    counted = running_sums(metrics, [order], {"_auto": missing}, ["run"])
    return (counted.withColumn("step", F.coalesce("step", "_auto")).drop("_auto"))


def l2_norm(arrays: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Norm over all values of all arrays of a group, as for a total gradient norm."""
    squares = F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    return arrays.groupBy(*by).agg(F.sqrt(F.sum(squares)).alias("norm"))


def value_histograms(arrays: DataFrame, column: str, by: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width histogram of all array values of a group, between its extremes."""
    values = F.col(column).cast("array<double>")
    # Stored once: its size is checked before the join reads it.
    ranges = written(arrays.groupBy(*by).agg(F.min(F.array_min(values)).alias("low"),
                                             F.max(F.array_max(values)).alias("high")), "ranges")
    each = lookup_join(arrays.select(*by, values.alias("_values")), ranges, by, "inner")
    share = F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    bin_no = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    return (each.select(*by, "low", "high", F.explode("_values").alias("v"))
            .select(*by, "low", "high", bin_no.alias("bin"))
            .groupBy(*by, "low", "high", "bin").agg(F.count("*").alias("n")))


def compare_runs(metrics: DataFrame, tag: str, runs: Sequence[str] | None = None) -> DataFrame:
    """One row per step with one column per run: the named ones, or all that logged the metric."""
    found = metrics.where(F.col("tag") == tag).groupBy("step")
    return (found.pivot("run") if runs is None else found.pivot("run", list(runs))).agg(F.max("value"))


def run_name(n_layers: Column | str = "n_layers", d_model: Column | str = "d_model") -> Column:
    return F.format_string("%dL-%dd", n_layers, d_model)


def runs_with_config(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Last value of each metric next to the run's settings; unlogged runs stay."""
    last = (metrics.groupBy("run", "tag")
            .agg(F.max_by(F.struct("step", "value"), "step").alias("p"))
            .select("run", "tag", F.col("p.step").alias("last_step"), F.col("p.value").alias("last_value")))
    return runs.withColumn("name", run_name()).join(last, "run", "left")
