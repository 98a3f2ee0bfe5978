"""Sampling documents so that token shares reach given marginals, by iterative proportional fitting.

Tokens are summed into cells, one for each combination of margins (source, language, topic) that
occurs. In a sweep each margin in turn scales its cells so that their sums reach its targets, until
no sum is further than a tolerance from its target. The ratio of a cell's fitted to its found share
is the weight of its documents; over the largest ratio it is a probability of being kept, so that the
expected token shares are the fitted ones. Documents are only ever compared with their own cell.

No document is repeated, so a cell that is lifted far would thin all others. Where targets are tempered
found shares, the most lifted cells that hold at most ``SPARE`` of the tokens together are kept whole
instead, and stay below their targets; how much is kept then does not depend on single odd documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .words import WORD

SWEEPS = 40
TOLERANCE = 1e-9
#: Sweeps of one job.
STEP = 5
#: Up to so many cells are swept in one task, without shuffles between the margins.
CELLS_OF_A_TASK = 100_000
#: Share of the tokens whose cells may stay below their tempered targets, so that the rest is not thinned for them.
SPARE = 0.01


def word_count(text: Column) -> Column:
    """Words of a whole text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def topic(text: Column) -> Column:
    """A coarse topic from what a text looks like, as no table names one.

    ``figures``: a fifth or more of its characters are digits or one of ``|=<>{}#$%&*``;
    ``brief``: fewer than 100 words; ``long``: 2,000 words or more; else ``prose``.
    """
    plain = F.coalesce(text, F.lit(""))
    marks = F.char_length(plain) - F.char_length(F.regexp_replace(plain, r"[0-9|=<>{}#$%&*]", ""))
    count = word_count(plain)
    return (F.when((marks > 0) & (marks * 5 >= F.char_length(plain)), "figures").when(count < 100, "brief")
            .when(count >= 2000, "long").otherwise("prose"))


def token_cells(docs: DataFrame, margins: Mapping[str, Column], tokens: Column) -> DataFrame:
    """Documents and tokens of every combination that occurs. Null is a value of its own."""
    return (docs.select(*[c.alias(m) for m, c in margins.items()], tokens.alias("tokens"))
            .groupBy(*margins).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame | float], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with ``share`` fitted to all targets, for each margin a table or a power.

    A table has its margin and ``target``. A power below one makes the targets of the found shares,
    and lifts small ones. Targets of values without tokens are left out and the others scaled up to
    one; cells whose value has no target get none. If targets contradict each other the last sweep
    stands. Every few sweeps make a stored table of the cells, which are far fewer than documents.
    """
    filled, columns = cells.where("tokens > 0"), [*cells.columns, "share"]
    number, total = filled.agg(F.count("*"), F.sum("tokens")).first()
    together = number <= CELLS_OF_A_TASK
    # Goals are joined once, by a merge: a broadcast for each of many small joins adds up on the driver.
    for i, (m, wanted) in enumerate(targets.items()):
        if isinstance(wanted, DataFrame):
            goal = wanted.select(F.col(m).alias("_value"), F.col("target").alias("_goal"))
            filled = filled.join(goal.hint("merge"), F.col(m).eqNullSafe(F.col("_value")), "left").select(
                *filled.columns, F.coalesce("_goal", F.lit(0.0)).alias(f"_goal{i}"))
    filled = filled.coalesce(1) if together else filled
    for i, (m, wanted) in enumerate(targets.items()):
        filled = filled.withColumn(f"_found{i}", F.sum("tokens").over(Window.partitionBy(m)))
        if not isinstance(wanted, DataFrame):
            filled = filled.withColumn(f"_goal{i}", F.pow(F.col(f"_found{i}").cast("double"), F.lit(wanted)))
    filled = written(filled, "cells")
    # The cells of a value carry its goal together, each its part of the value's tokens.
    whole = filled.agg(*[F.sum(F.col(f"_goal{i}") * F.col("tokens") / F.col(f"_found{i}")) for i in range(len(targets))]).first()
    current = filled.select(*cells.columns, (F.col("tokens") / F.lit(float(total or 0))).alias("share"),
                            *[(F.col(f"_goal{i}") / F.lit(w) if w else F.lit(0.0)).alias(f"_goal{i}") for i, w in enumerate(whole)])
    done = 0
    while done < sweeps:
        # Some sweeps are one job; each leaves its shares and how far its sums were from the targets.
        several, swept = min(STEP, sweeps - done), current.coalesce(1) if together else current
        for k in range(several):
            away = F.lit(0.0)
            for i, m in enumerate(targets):
                found, goal = F.sum("share").over(Window.partitionBy(m)), F.col(f"_goal{i}")
                swept = swept.withColumns({"share": F.when(found > 0, F.col("share") * goal / found).otherwise(0.0),
                                           f"_away{k}": F.greatest(away, F.abs(goal - found))})
                away = F.col(f"_away{k}")
            swept = swept.withColumn(f"_share{k}", F.col("share"))
        stored = written(swept, "sweeps")
        worst = stored.agg(*[F.max(f"_away{k}") for k in range(several)]).first()
        last = next((k for k, w in enumerate(worst) if w is None or w <= tolerance), several - 1)
        current = stored.withColumn("share", F.col(f"_share{last}")).select(*current.columns)
        done += several
        if worst[last] is None or worst[last] <= tolerance:
            break
    return current.select(*columns)


def keep_rates(raked: DataFrame, spare: float = 0.0) -> DataFrame:
    """Cells with ``rate``: fitted over found share, divided by the largest such ratio, at most one.

    The largest ratio is taken without the cells at the top that hold a share ``spare`` of the tokens.
    """
    ratio = F.col("share") / F.col("tokens")
    largest = F.percentile(ratio, F.lit(1.0 - spare), F.col("tokens")) if spare else F.max(ratio)
    most = raked.where(ratio > 0).agg(largest).first()[0]
    return raked.withColumn("rate", F.least(ratio / F.lit(most or 1.0), F.lit(1.0)))


def draw(key: Column, seed: int) -> Column:
    """A number from 0 to 1 fixed by the key and the seed, in steps of 2**-52."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(docs: DataFrame, key: str, margins: Mapping[str, Column], tokens: Column, targets: Mapping[str, DataFrame] | float,
        seed: int = 0, keep_all: bool = False, spare: float | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns; with ``keep_all`` every row and its decision.

    ``targets``: a table per margin, or a power that tempers the found shares. Tables are met as they
    are, tempered shares but for ``spare`` (see ``keep_rates``) of the tokens. A row is kept if the
    draw of its key is below its cell's rate, so rows repeated under one key share one fate, as null
    keys do. Documents without tokens weigh nothing and are kept. With ``keep_all`` the columns
    ``_cell`` (the margins' values), ``_tokens``, ``_rate`` and ``_kept`` are added. The margins,
    not the texts, are joined with the few cells. An empty table gives an empty result.
    """
    names = [f"m{i}" for i in range(len(margins))]
    values = dict(zip(names, margins.values()))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         draw(F.col(f"`{key}`"), seed).alias("_draw"), tokens.alias("tokens"),
                         *[c.alias(n) for n, c in values.items()])
    cells = written(packed.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), "cells")
    if isinstance(targets, Mapping):
        wanted = {n: targets[m].select(F.col(m).alias(n), "target") for n, m in zip(names, margins)}
    else:
        wanted = dict.fromkeys(names, targets)
    if spare is None:
        spare = 0.0 if isinstance(targets, Mapping) else SPARE
    rates = keep_rates(rake(cells, wanted), spare).select(*[F.col(n).alias(f"c_{n}") for n in names], "rate")
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"c_{n}"))
    joined = packed.join(rates, on, "left").withColumn(
        "rate", F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("rate", F.lit(0.0))))
    kept = F.col("_draw") < F.col("rate")
    if keep_all:
        cell = F.struct(*[F.col(n).alias(m) for n, m in zip(names, margins)])
        return joined.select("_row.*", cell.alias("_cell"), F.col("tokens").alias("_tokens"),
                             F.col("rate").alias("_rate"), kept.alias("_kept"))
    return joined.where(kept).select("_row.*")
