"""Scalar formulas used by the model, log and telemetry operators."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The loss above which perplexity stops growing, and the bar glyphs.
LOSS_CAP = 20.0
BAR_FULL, BAR_EMPTY = "█", "░"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def perplexity(loss: Column | str, cap: float = LOSS_CAP, base: str | int = "e") -> Column:
    """``exp`` of the capped loss, or ``2**loss`` as the log monitor shows it."""
    if base == 2:
        return F.pow(F.lit(2.0), _c(loss))
    return F.exp(F.least(_c(loss), F.lit(float(cap))))


def lr_multiplier(step: Column | str, warmup: Column | int, total: Column | int,
                  min_ratio: Column | float = 0.1) -> Column:
    """Linear warmup, then one cosine half-wave down to ``min_ratio``.

    With ``total == warmup`` there is no decay phase and the factor stays 1.
    """
    step, warmup, total, floor = (
        v.cast("double") if isinstance(v, Column) else F.lit(float(v))
        for v in (_c(step), warmup, total, min_ratio))
    done = F.try_divide(step - warmup, total - warmup)
    wave = (F.cos(F.lit(math.pi) * F.coalesce(done, F.lit(0.0))) + 1) / 2
    return F.when(step < warmup, F.try_divide(step, warmup)).otherwise(floor + (1 - floor) * wave)


def apply_schedule(step: Column | str, schedule: Callable[[int], float]) -> Column:
    """A user's step-to-multiplier function, applied to Arrow batches."""

    def run(steps: pd.Series) -> pd.Series:
        # Steps repeat across runs, so each distinct one is evaluated once per batch.
        return steps.map({s: float(schedule(s)) for s in steps.unique().tolist()})

    run.__annotations__ = {"steps": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(_c(step))


def format_duration(seconds: Column | str) -> Column:
    """Seconds, minutes, hours or days in the shortest fitting unit; ties go to the even digit."""
    s = _c(seconds)

    def shown(value: Column, digits: int, unit: str) -> Column:
        # format_number rounds the exact binary value half to even; its grouping commas go.
        return F.concat(F.translate(F.format_number(value.cast("double"), digits), ",", ""), F.lit(unit))

    return (F.when(s < 60, shown(s, 0, "s")).when(s < 3600, shown(s / 60, 0, "m"))
            .when(s / 3600 < 24, shown(s / 3600, 1, "h")).otherwise(shown(s / 3600 / 24, 1, "d")))


def progress_bar(value: Column | str, maximum: Column | float, width: int = 40) -> Column:
    """A text bar; values beyond the maximum overshoot and negative ones show empty."""
    maximum = maximum if isinstance(maximum, Column) else F.lit(float(maximum))
    filled = (_c(value) / maximum * width).cast("int")
    full = F.repeat(F.lit(BAR_FULL), F.greatest(filled, F.lit(0)))
    return F.concat(full, F.repeat(F.lit(BAR_EMPTY), F.greatest(F.lit(width) - filled, F.lit(0))))


def memory_pct(used: Column | str, total: Column | str) -> Column:
    return F.try_divide(_c(used), _c(total)) * 100


def temp_status(temp: Column | str, warm: float = 70, hot: float = 85) -> Column:
    t = _c(temp)
    return F.when(t < warm, "green").when(t < hot, "amber").otherwise("red")
