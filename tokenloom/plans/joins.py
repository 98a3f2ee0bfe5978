"""Lookup joins whose strategy follows a checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(facts: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join facts to a lookup table that has one row per key.

    A table within ``max_rows`` is broadcast. A larger one is shuffled with ``salts``
    copies of every key, so that one hot key is shared by as many tasks.
    """
    if how not in ("inner", "left"):
        raise ValueError("a lookup join is inner or left")
    if fits(table, max_rows):
        return facts.join(F.broadcast(table), list(on), how)
    return salted_join(facts, table, on, how, salts)


def salted_join(facts: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
                salts: int = 16) -> DataFrame:
    """Shuffle join in which the rows of one key are spread over ``salts`` tasks."""
    salted = facts.withColumn(
        "_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
