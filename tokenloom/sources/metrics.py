"""Scalar metrics and generated samples as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Length of a stored sample, and of one shown on a console.
STORED_CHARS, SHOWN_CHARS = 512, 256


def explode_metrics(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """A map of metrics per row to one ``(run, tag, step, value)`` row each."""
    return df.select("run", "step", F.explode(metrics).alias("tag", "value")).select(
        "run", "tag", "step", F.col("value").cast("double").alias("value"))


def append_metrics(df: DataFrame, path: str) -> None:
    """Append points, one folder per run; a hot run may still span many files."""
    df.select("run", "tag", "step", "value").write.mode("append").partitionBy("run").parquet(path)


def shape_samples(df: DataFrame) -> DataFrame:
    """Stored text cut to 512 characters and a display form of at most 256 plus dots."""
    shown = F.concat(F.left("generated", F.lit(SHOWN_CHARS)),
                     F.when(F.length("generated") > SHOWN_CHARS, "...").otherwise(""))
    return df.select("run", "step", "prompt", F.left("generated", F.lit(STORED_CHARS)).alias("generated"),
                     shown.alias("display"))


def generation_note(prompt: Column | str, generated: Column | str) -> Column:
    """A sample as the Markdown text that metric boards show."""
    return F.concat(F.lit("**Prompt:** "), prompt, F.lit("\n\n**Generated:**\n```python\n"), generated,
                    F.lit("\n```"))


def auto_run_name(started: Column | str) -> Column:
    """Name of a run that was given none: its start time."""
    return F.date_format(started, "'run_'yyyyMMdd_HHmmss")


def append_samples(df: DataFrame, path: str) -> None:
    shape_samples(df).write.mode("append").partitionBy("run").parquet(path)
