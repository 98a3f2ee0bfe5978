"""Corpus totals and token statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.codecs import PART, token_label
from tokenloom.plans.joins import lookup_join


#: Bits of a sketch's register number, and the relative error that its estimate keeps.
SKETCH_BITS, SKETCH_ERROR = 12, 0.05


def corpus_totals(df: DataFrame, n_tokens: Column, n_chars: Column | None = None,
                  by: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """Samples, tokens, characters and mean tokens per sample."""
    n_chars = F.length("text") if n_chars is None else n_chars
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    return (grouped.agg(F.count("*").alias("samples"),
                        F.sum(n_tokens.cast("bigint")).alias("tokens"),
                        F.sum(n_chars.cast("bigint")).alias("chars"))
            .withColumn("avg_tokens", F.try_divide(F.col("tokens"), F.col("samples"))))


def token_counts(df: DataFrame, column: str, vocab_size: int = 256) -> DataFrame:
    """Occurrences of each token id.

    ``column`` is an array of ids, or a text that the byte codec turns into ids. Each task
    counts its Arrow batches as they come and emits one row per distinct id, so neither
    ids nor exploded rows are shuffled.
    """
    is_text = dict(df.dtypes)[column] == "string"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(0, np.int64)
        for batch in batches:
            values = batch.column(0)
            flat = _octets(values) if is_text else values.flatten().to_numpy(zero_copy_only=False)
            for at in range(0, len(flat), PART):
                ids = flat[at:at + PART]
                found = np.bincount(np.minimum(ids, vocab_size - 1) if is_text else ids)
                width = max(len(found), len(totals))
                totals = np.pad(totals, (0, width - len(totals)))
                totals[:len(found)] += found
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(totals[seen], pa.int64())], ["token_id", "n"])

    partial = df.select(column).mapInArrow(count, "token_id int, n bigint")
    return partial.groupBy("token_id").agg(F.sum("n").alias("n"))


def _octets(texts: pa.Array) -> np.ndarray:
    """All bytes of the non-null texts of a batch, without copying."""
    raw = texts.cast(pa.large_binary())
    if raw.buffers()[2] is None:
        return np.empty(0, np.uint8)
    bounds = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    return np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]


def token_stats(counts: DataFrame) -> DataFrame:
    """Total, smallest and largest id and exact number of distinct ids."""
    return counts.agg(F.sum("n").alias("total_tokens"), F.min("token_id").alias("min_id"),
                      F.max("token_id").alias("max_id"), F.count("*").alias("distinct_ids"))


def distinct_sketches(df: DataFrame, ids: Column, by: Sequence[str] = ()) -> DataFrame:
    """A mergeable sketch of the distinct values of an array column, per group or file.

    Sketches of 2**12 registers: their estimate is within 5 % (three standard errors), and exact up to
    some hundred values. They are stored beside a corpus and joined with those of corpora that come later.
    """
    values = df.select(*by, F.explode(F.array_distinct(ids)).alias("_value"))
    return values.groupBy(*by).agg(F.hll_sketch_agg("_value", F.lit(SKETCH_BITS)).alias("sketch"))


def approximate_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The number of distinct values that sketches have seen together."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_ids"))


def token_frequency(counts: DataFrame, k: int = 20, text: Column | None = None) -> DataFrame:
    """The ``k`` most frequent ids with their share; equal counts go to the smaller id.

    ``text`` decodes a single id for the label; without a vocabulary there is none. The
    window spans the counts table, which has at most one row per vocabulary entry.
    """
    whole = Window.partitionBy()
    return (counts.withColumn("pct", F.col("n") / F.sum("n").over(whole) * 100)
            .orderBy(F.desc("n"), F.asc("token_id")).limit(k)
            .withColumn("label", token_label("token_id", text)))


def throughput(points: DataFrame, runs: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Tokens seen, tokens per second and epochs at each logged point.

    ``points`` has run, iteration and elapsed seconds; ``runs`` has batch_size,
    block_size and grad_accum_steps. Micro-batches are counted; the effective figure
    multiplies by gradient accumulation. Points of a run without settings stay, with nulls.
    """
    joined = lookup_join(points, runs, ["run"])
    seen = (F.col("iteration") * F.col("batch_size") * F.col("block_size")).cast("bigint")
    result = joined.select(
        "run", "iteration", seen.alias("tokens_seen"),
        (seen * F.col("grad_accum_steps")).alias("effective_tokens"),
        F.try_divide(seen, F.col("elapsed")).alias("tok_per_s"))
    if total_tokens is not None:
        result = result.withColumn("epochs", F.try_divide(F.col("tokens_seen"), F.lit(total_tokens)))
    return result
