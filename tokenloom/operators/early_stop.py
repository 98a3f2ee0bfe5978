"""Early stopping and best checkpoints from logged losses."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.plans.joins import lookup_join
from tokenloom.plans.ordered import (OWN, SEGMENT, SEGMENT_ROWS, largest_group, own_rows,
                                     reach_partition, reach_windows, row_index, with_segments)
from tokenloom.session import written

EVALUATION = ("run string, iteration bigint, recent_avg double, improved boolean, best_loss double, "
              "best_iteration bigint, counter int, stopped boolean")


@dataclass(frozen=True)
class StopRule:
    """The trainer's default settings."""

    checkpoint_interval: int = 500
    patience: int = 10
    limit: int = 5
    min_delta: float = 0.01


def rolling_loss(points: DataFrame, width: int, size: int = SEGMENT_ROWS) -> DataFrame:
    """Mean of the last ``width`` logged losses, null until that many exist."""
    stored = written(points.select("run", "iteration", "loss"), "points")
    laid = reach_windows(stored, ["run"], ["iteration"], before=width - 1, size=size)
    return own_rows(_with_mean(laid, width)).select("run", "iteration", "loss", "recent_avg")


def _with_mean(laid: DataFrame, width: int) -> DataFrame:
    last = (Window.partitionBy(*reach_partition(["run"])).orderBy("iteration")
            .rowsBetween(-(width - 1), 0))
    mean = F.when(F.count("loss").over(last) == width, F.sum("loss").over(last) / width)
    return laid.withColumn("recent_avg", mean)


def evaluations(points: DataFrame, rule: StopRule = StopRule(), size: int = SEGMENT_ROWS) -> DataFrame:
    """The mean recent loss at every checkpoint iteration.

    A checkpoint that falls between two logged points uses the losses logged before it.
    """
    # Stored, because counting, numbering and the window each read the points, whatever made them.
    stored = written(points.select("run", "iteration", "loss"), "points")
    laid = reach_windows(stored, ["run"], ["iteration"], before=rule.patience - 1, after=1, size=size)
    following = F.lead("iteration").over(Window.partitionBy(*reach_partition(["run"])).orderBy("iteration"))
    each = F.lit(rule.checkpoint_interval).cast("bigint")
    rows = (own_rows(_with_mean(laid, rule.patience).withColumn("_next", following))
            .where(F.col("recent_avg").isNotNull())
            .withColumn("_first", F.ceil(F.col("iteration") / each) * each)
            .withColumn("_last", F.coalesce(F.col("_next") - 1, F.col("iteration")))
            .where(F.col("_first") <= F.col("_last")))
    return rows.select("run", F.explode(F.sequence("_first", "_last", each)).alias("iteration"),
                       "recent_avg")


def early_stopping(points: DataFrame, rule: StopRule = StopRule(), size: int = SEGMENT_ROWS) -> DataFrame:
    """Every evaluation up to the stop with best loss, counter and outcome.

    The best loss feeds back into the next comparison, so this is a recurrence. A run of
    at most ``size`` evaluations is walked in one task. For longer runs the recurrence is
    cut: the state at a border is fully given by which of the last ``limit`` evaluations
    is the best one, so each segment first reports where every such entry leads, the
    borders of a run are chained, and the segments are then walked in parallel.

    The evaluations are stored once, because several passes read them.
    """
    evals = written(evaluations(points, rule, size), "evaluations")
    if largest_group(evals, ["run"]) <= size:
        return evals.groupBy("run").applyInPandas(_walker(rule), EVALUATION)
    numbered = row_index(evals, ["iteration"], "k", ["run"])
    cut = with_segments(numbered, "k", before=rule.limit, size=size)
    keys = ["run", SEGMENT]
    exits = cut.groupBy(*keys).applyInPandas(_exits(rule), f"run string, {SEGMENT} bigint, entry bigint, leaves bigint")
    entries = exits.groupBy("run").applyInPandas(_chain, f"run string, {SEGMENT} bigint, entry bigint")
    known = entries.select(F.col("run").alias("_run"), F.col(SEGMENT).alias("_at"), "entry")
    # Null-safe, as a run without a name is a run too.
    reached = cut.join(known, F.col("run").eqNullSafe(F.col("_run")) & (F.col(SEGMENT) == F.col("_at"))).drop("_run", "_at")
    return reached.groupBy(*keys).applyInPandas(_walker(rule), EVALUATION)


def _walker(rule: StopRule):
    """Walk one run, or one segment whose best evaluation so far is known."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("iteration")
        best, best_at, counter = float("inf"), None, 0
        if "entry" in rows and rows["entry"].iloc[0] >= 0:
            entry = rows[rows["k"] == rows["entry"].iloc[0]].iloc[0]
            best, best_at = entry["recent_avg"], entry["iteration"]
            counter = int((~rows[OWN] & (rows["k"] > entry["k"])).sum())
        elif "entry" in rows:
            counter = int((~rows[OWN]).sum())
        own = rows[rows[OWN]] if OWN in rows else rows
        out = []
        for at, mean in zip(own["iteration"], own["recent_avg"]):
            improved = mean < best - rule.min_delta
            best, best_at, counter = (mean, at, 0) if improved else (best, best_at, counter + 1)
            stopped = counter >= rule.limit
            out.append((rows["run"].iloc[0], at, mean, improved, best, best_at, counter, stopped))
            if stopped:
                break
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in EVALUATION.split(", ")])
        frame["best_iteration"] = frame["best_iteration"].astype("Int64")
        return frame

    return walk


def _exits(rule: StopRule):
    """For every possible best evaluation at the start of a segment, the one at its end.

    Entry -1 is "none yet". ``leaves`` is null where the run stops inside the segment.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        k = rows["k"].to_numpy()
        mean = rows["recent_avg"].to_numpy()
        halo = int((~rows[OWN]).sum())
        fresh = k[0] == 0
        if fresh:
            k, mean = np.append(-1, k), np.append(np.inf, mean)
            halo += 1
        leaves: list[int | None] = [None] * len(k)
        for q in range(len(k) - 1, -1, -1):
            ahead = mean[max(q + 1, halo):q + 1 + rule.limit]
            better = np.flatnonzero(ahead < mean[q] - rule.min_delta)
            if len(better):
                leaves[q] = leaves[max(q + 1, halo) + int(better[0])]
            elif q + rule.limit >= len(k):
                leaves[q] = int(k[q])
        return pd.DataFrame({"run": rows["run"].iloc[0], SEGMENT: rows[SEGMENT].iloc[0],
                             "entry": k[:halo], "leaves": pd.array(leaves[:halo], "Int64")})

    return solve


def _chain(exits: pd.DataFrame) -> pd.DataFrame:
    """Follow the borders of one run; a row per segment and possible entry."""
    run, state, out = exits["run"].iloc[0], -1, []
    for segment, table in exits.sort_values(SEGMENT).groupby(SEGMENT):
        out.append((run, segment, state))
        after = table.loc[table["entry"] == state, "leaves"]
        if not len(after) or pd.isna(after.iloc[0]):
            break
        state = int(after.iloc[0])
    return pd.DataFrame(out, columns=["run", SEGMENT, "entry"])


def best_checkpoint(evals: DataFrame, runs: DataFrame) -> DataFrame:
    """The last improving evaluation of each run with the run's settings."""
    kept = (evals.where("improved").groupBy("run")
            .agg(F.max_by(F.struct("iteration", "recent_avg"), "iteration").alias("b"))
            .select("run", F.col("b.iteration").alias("iteration"), F.col("b.recent_avg").alias("loss")))
    return lookup_join(kept, runs, ["run"])


def early_stop_savings(evals: DataFrame, runs: DataFrame, rule: StopRule = StopRule(),
                       hourly_rate: float = 1.0, seconds_per_iteration: float = 12.0) -> DataFrame:
    """Iterations run against planned, the share saved and the cost of both."""
    end = (evals.groupBy("run")
           .agg(F.max("iteration").alias("ended_at"), F.max("stopped").alias("stopped")))
    joined = runs.select("run", F.col("iterations").alias("planned")).join(end, "run", "left")
    ran = F.when(F.coalesce("stopped", F.lit(False)), F.col("ended_at")).otherwise(F.col("planned"))
    per_iteration = seconds_per_iteration / 3600 * hourly_rate
    return (joined.withColumn("iterations_run", ran)
            .select("run", "planned", "iterations_run",
                    (1 - F.try_divide(F.col("iterations_run"), F.col("planned"))).alias("saved_share"),
                    F.when(F.coalesce("stopped", F.lit(False)), rule.limit * rule.checkpoint_interval)
                    .otherwise(0).alias("idle_iterations"),
                    (F.col("planned") * per_iteration).alias("planned_cost"),
                    (F.col("iterations_run") * per_iteration).alias("cost")))
