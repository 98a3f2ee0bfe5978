"""Prefixes of an ordered corpus: size budgets, sample limits, progress, context crop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import budget_unit
from tokenloom.plans.ordered import key_tuple, row_index, running_sums

# Up to this many rows a top-k merge in one task is cheaper than numbering the table.
TOP_K_ROWS = 10_000


def take_budget(df: DataFrame, key: Sequence[str], max_size: int | None,
                kind: str = "byte_level", column: str = "text") -> DataFrame:
    """Non-empty documents in key order until the running size reaches the budget.

    The document that crosses the budget is kept, and so is the first one. Buckets that
    start beyond the budget are dropped before the shuffle.
    """
    kept = df.where(F.length(column) > 0)
    if max_size is None:
        return kept
    sized = running_sums(kept, key, {"_start": budget_unit(kind, column)}, keys=df,
                         below=("_start", max_size))
    return sized.where((F.col("_start") < max_size) | (F.col("_start") == 0)).drop("_start")


def take_samples(df: DataFrame, key: Sequence[str], max_samples: int | None = None,
                 column: str = "text") -> DataFrame:
    """The first ``max_samples`` non-empty rows in key order; ``None`` or 0 keeps all.

    Keys alone decide: the last one that is taken is found first, and becomes a filter. Of rows
    that share it any are taken.
    """
    kept = df.where(F.length(column) > 0)
    if not max_samples:
        return kept
    keys = kept.select(*key)
    if max_samples <= TOP_K_ROWS:
        top = keys.orderBy(*key).limit(max_samples)
    else:
        numbered = running_sums(keys, key, {"_i": F.lit(1).cast("bigint")}, keys=df.select(*key), below=("_i", max_samples))
        top = numbered.where(F.col("_i") < max_samples)
    at = key_tuple(df, key)
    last = top.groupBy(at.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).limit(1)
    found = last.select(F.to_json("k"), "n").first()
    if found is None:
        return kept
    border = F.from_json(F.lit(found[0]), last.schema["k"].dataType)
    return kept.where(at < border).unionAll(kept.where(at == border).limit(found[1]))


def progress_points(df: DataFrame, key: Sequence[str], n_tokens: Column,
                    every: int = 1000, column: str = "text") -> DataFrame:
    """Rows seen and tokens so far at every ``every``-th input row that holds text.

    Skipped rows count towards the row number but report nothing.
    """
    usable = F.coalesce(F.length(column) > 0, F.lit(False))
    tokens = F.when(usable, n_tokens).otherwise(0).cast("bigint")
    slim = df.select(*key, usable.alias("_usable"), tokens.alias("_tokens"))
    counted = running_sums(slim, key, {"_row": F.lit(1).cast("bigint"), "_before": F.col("_tokens")})
    return (counted.where(((F.col("_row") + 1) % every == 0) & F.col("_usable"))
            .select((F.col("_row") + 1).alias("rows_seen"),
                    (F.col("_before") + F.col("_tokens")).alias("tokens_so_far")))


def crop_context(ids: Column | str, block_size: int) -> Column:
    """The last ``block_size`` ids of a context."""
    n = F.size(ids)
    return F.slice(ids, F.greatest(n - block_size, F.lit(0)) + 1, F.lit(block_size))


__all__ = ["crop_context", "progress_points", "row_index", "take_budget", "take_samples"]
