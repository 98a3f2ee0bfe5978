"""Instruction-tuning data: pairs, prompts, label masks, length-grouped batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.plans.ordered import row_index
from tokenloom.session import written

# The prompt template, the label of ignored positions, the length limit.
PREAMBLE = ("Below is an instruction that describes a task. "
            "Write a response that appropriately completes the request.")
INSTRUCTION_MARK, INPUT_MARK, RESPONSE_MARK = "### Instruction:\n", "### Input:\n", "### Response:\n"
IGNORED_LABEL = -100
MAX_LENGTH = 1024
#: Texts of one conversation that a task's window may hold, and what a turn takes besides its text.
GROUP_BYTES, ROW_BYTES = 64 << 20, 32


def pair_turns(turns: DataFrame, size: int = GROUP_BYTES) -> DataFrame:
    """Each user turn that an assistant turn follows directly, as instruction and output.

    While the texts of every conversation together are within ``size`` bytes, a conversation is
    one task's window. Beyond it turns are numbered, and a user turn is joined with the assistant
    turn of the next number, so that no task holds more of a conversation than its own pairs.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    held = rows.groupBy("conv_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + ROW_BYTES).alias("held"))
    if (held.agg(F.max("held")).first()[0] or 0) <= size:
        following = Window.partitionBy("conv_id").orderBy("turn")
        paired = rows.withColumns({"_role": F.lead("role").over(following), "output": F.lead("text").over(following)})
        return (paired.where((F.col("role") == "user") & (F.col("_role") == "assistant"))
                .select("conv_id", "turn", F.col("text").alias("instruction"), "output"))
    # Numbered without the texts of other roles, and stored, as both sides of the join read it.
    spoken = F.when(F.col("role").isin("user", "assistant"), F.col("text"))
    numbered = written(row_index(rows.withColumn("text", spoken), ["turn"], "_i", ["conv_id"]), "turns")
    users = numbered.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"), (F.col("_i") + 1).alias("_next"))
    replies = numbered.where("role = 'assistant'").select(F.col("conv_id").alias("_conv"), "_i", F.col("text").alias("output"))
    return (users.join(replies, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_next") == F.col("_i")))
            .select("conv_id", "turn", "instruction", "output"))


def prompt_text(instruction: str = "instruction", extra: str | None = None) -> Column:
    """Everything before the response. ``extra`` names an optional input column."""
    parts = [F.lit(f"{PREAMBLE}\n\n{INSTRUCTION_MARK}"), _shown(instruction)]
    if extra:
        given = F.length(extra) > 0
        parts.append(F.when(given, F.concat(F.lit(f"\n\n{INPUT_MARK}"), F.col(extra))).otherwise(""))
    return F.concat(*parts, F.lit(f"\n\n{RESPONSE_MARK}"))


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("None"))


def render_sft(df: DataFrame, extra: str | None = None, out: str = "text") -> DataFrame:
    """Fill the prompt template; the ``input`` column is ignored unless named."""
    return df.withColumn(out, F.concat(prompt_text(extra=extra), _shown("output")))


def apply_formatter(df: DataFrame, fn: Callable[[dict[str, list]], list[str]],
                    columns: Sequence[str], out: str = "text") -> DataFrame:
    """A user's formatting callback: column lists in, one text per row out."""

    def run(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(fn({c: batch[c].tolist() for c in columns}), index=batch.index)

    run.__annotations__ = {"batch": pd.DataFrame, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(run, "string")(F.struct(*columns)))


def mask_prompt(prompt_ids: Column | str, response_ids: Column | str) -> tuple[Column, Column]:
    """Input ids and labels; only response positions carry a label."""
    ignored = F.array_repeat(F.lit(IGNORED_LABEL), F.size(prompt_ids))
    return F.concat(prompt_ids, response_ids), F.concat(ignored, response_ids)


def truncate_pad(ids: Column | str, length: int = MAX_LENGTH, pad_id: int = 0) -> Column:
    """Cut to the length limit and fill up with the pad id."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad_id), F.greatest(length - F.size(ids), F.lit(0))))


def attention_mask(ids: Column | str, length: int = MAX_LENGTH) -> Column:
    used = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), length - used))


def length_group_batches(df: DataFrame, key: Sequence[str], length: str, batch_size: int = 4,
                         pool: int = 50, seed: int = 0) -> DataFrame:
    """Batches of similar length.

    Rows are put into a seeded pseudo-random order and cut into pools of ``pool`` batches;
    inside a pool rows are sorted by falling length. Pools bound both the sort and the
    padding, so neither needs the whole table.
    """
    mixed = df.select(*key, length).withColumn("_mix", mix(seed, *key))
    drawn = row_index(mixed, ["_mix", *key], "_i")
    rows = pool * batch_size
    pooled = drawn.withColumn("_pool", F.expr(f"_i div {rows}"))
    falling = Window.partitionBy("_pool").orderBy(F.desc(length), *key)
    return (pooled.withColumn("_rank", F.row_number().over(falling) - 1)
            .select(*key, length,
                    (F.col("_pool") * pool + F.expr(f"_rank div {batch_size}")).alias("batch_id")))


def padding_waste(batches: DataFrame, length: str) -> DataFrame:
    """Rows, longest row and padding per batch."""
    return (batches.groupBy("batch_id")
            .agg(F.count("*").alias("rows"), F.max(length).alias("max_len"), F.sum(length).alias("used"))
            .withColumn("padding", F.col("rows") * F.col("max_len") - F.col("used")))


def mix(seed: int, *key: str) -> Column:
    """52 pseudo-random bits per key, the same on every engine and partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
