"""Autoregressive sampling for a table of prompts from n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.codecs import decode_bytes, encode_bytes
from tokenloom.operators.budgets import crop_context
from tokenloom.plans.joins import fits, salted_join
from tokenloom.session import bucketed, scratch_path, written

# Fixed value: the newline id of the GPT-2 vocabulary, which ends a test completion.
NEWLINE_ID = 198
BACKOFF = -1
#: Bytes of a prompt whose ids still fit one row (four bytes each).
LONGEST_PROMPT = 256 << 20
BROADCAST_CANDIDATES = 2_000_000


def continuations(counts: DataFrame, temperature: float = 1.0, top_k: int | None = None) -> DataFrame:
    """One row per context: candidate ids and their cumulative probabilities.

    The logit of a candidate is the log of its count, so ``exp(logit / T)`` is a power.
    Candidates are ordered by falling count and rising id; ties at the k-th count stay.
    An extra row, context -1, holds the unconditional distribution for unseen contexts.
    """
    marginal = counts.groupBy("token_id").agg(F.sum("n").alias("n"))
    table = counts.unionByName(
        marginal.select(F.lit(BACKOFF).cast("bigint").alias("context"), "token_id", "n"))
    one = Window.partitionBy("context")
    falling = one.orderBy(F.desc("n"), "token_id")
    if top_k is not None:
        table = (table.withColumn("_rank", F.rank().over(one.orderBy(F.desc("n"))))
                 .where(F.col("_rank") <= top_k).drop("_rank"))
    weight = F.pow(F.col("n").cast("double"), F.lit(1.0 / temperature))
    summed = (table.withColumn("_w", weight)
              .withColumn("_place", F.row_number().over(falling))
              .withColumn("_cum", F.sum("_w").over(falling.rowsBetween(Window.unboundedPreceding, 0))
                          / F.sum("_w").over(one)))
    listed = F.sort_array(F.collect_list(F.struct("_place", "token_id", "_cum")))
    return (summed.groupBy("context").agg(listed.alias("c"))
            .select("context", F.col("c.token_id").alias("tokens"), F.col("c._cum").alias("cum")))


def draw(seed: int, prompt_id: str, step: Column) -> Column:
    """A uniform number per prompt and step that no partitioning can change."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(prompt_id).cast("string"), step.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2 ** 52)


def context_code(ids: Column | str, n: int, vocab: int) -> Column:
    """The last ``n - 1`` ids as one number; shorter histories have no context yet."""
    kept = crop_context(ids, n - 1) if n > 1 else F.array().cast("array<int>")
    code = F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, i: a * vocab + i)
    return F.when(F.size(ids) >= n - 1, code).otherwise(F.lit(BACKOFF).cast("bigint"))


def generate(prompts: DataFrame, model: DataFrame, n: int = 2, vocab: int = 256, max_new: int = 256,
             seed: int = 0, stop_id: int | None = None,
             max_candidates: int = BROADCAST_CANDIDATES) -> DataFrame:
    """Continue ``prompts(prompt_id, ids[, max_new])`` by up to ``max_new`` ids each.

    The context is always the last ``n - 1`` ids. A stop id ends a prompt and is not
    emitted. Within ``max_candidates`` entries the model is broadcast and all steps of a
    prompt run in one task; beyond it every step is one join of the prompts that still go on with
    the contexts they are in. Both give the same ids. Prompt ids are distinct.
    """
    if model.where(F.col("context") == BACKOFF).isEmpty():
        raise ValueError("the model is empty: it has no distribution for unseen contexts")
    if "max_new" not in prompts.columns:
        prompts = prompts.withColumn("max_new", F.lit(max_new))
    state = prompts.select("prompt_id", "ids", "max_new")
    if fits(model.select(F.explode("tokens")), max_candidates):
        return _in_tasks(state, model, n, vocab, seed, stop_id)
    return _by_joins(state, model, n, vocab, seed, stop_id)


def _in_tasks(state: DataFrame, model: DataFrame, n: int, vocab: int, seed: int,
              stop_id: int | None) -> DataFrame:
    table = {r["context"]: (np.array(r["tokens"]), np.array(r["cum"])) for r in model.toLocalIterator()}
    shared = state.sparkSession.sparkContext.broadcast(table)
    steps = F.when(F.col("max_new") > 0, F.sequence(F.lit(1), F.col("max_new")))
    draws = F.transform(F.coalesce(steps, F.array().cast("array<int>")), lambda s: draw(seed, "prompt_id", s))
    kind = state.schema["prompt_id"].dataType.simpleString()

    def walk(ids: np.ndarray, draws_: np.ndarray) -> list[int]:
        known = shared.value
        history = [int(i) for i in ids[max(len(ids) - n + 1, 0):]] if n > 1 else []
        produced: list[int] = []
        for u in draws_:
            code = BACKOFF if len(history) < n - 1 else 0
            if code == 0:
                for i in history:
                    code = code * vocab + i
            tokens, cum = known.get(code, known[BACKOFF])
            token = int(tokens[min(np.searchsorted(cum, u), len(tokens) - 1)])
            if token == stop_id:
                break
            produced.append(token)
            history = [*history, token][-(n - 1):] if n > 1 else []
        return produced

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "prompt_id": batch["prompt_id"], "ids": batch["ids"],
                "produced": [walk(i, u) for i, u in zip(batch["ids"], batch["draws"])]})

    return state.withColumn("draws", draws).mapInPandas(
        run, f"prompt_id {kind}, ids array<int>, produced array<int>")


def _by_joins(state: DataFrame, model: DataFrame, n: int, vocab: int, seed: int,
              stop_id: int | None) -> DataFrame:
    """One step at a time. What moves is a number for the context of each prompt that is still going on.

    The model is stored bucketed by context and stays where it is: a step picks the contexts that its
    prompts are in, and only those are copied for the salted join. The ids that a step draws go to a
    table of their own; the prompts meet them at the end.
    """
    spark = state.sparkSession
    state = written(state, "prompts")
    model = bucketed(model, "model", "context")
    unseen = written(model.where(F.col("context") == BACKOFF), "unseen")
    path, span = scratch_path(spark, "drawn"), vocab ** max(n - 2, 0)
    kept = crop_context("ids", n - 1) if n > 1 else F.array().cast("array<int>")
    # The last ids as one number, and how many they are: the contexts of a short prompt are not full yet.
    live = state.where("max_new > 0").select("prompt_id", "max_new", F.size(kept).alias("have"), F.aggregate(
        kept, F.lit(0).cast("bigint"), lambda code, i: code * vocab + i).alias("code"))
    kind = f"prompt_id {state.schema['prompt_id'].dataType.simpleString()}, step int, token int"
    spark.createDataFrame([], kind).write.parquet(path)
    step = 0
    while True:
        step += 1
        at = live.withColumn("context", F.when(F.col("have") >= n - 1, F.col("code")).otherwise(F.lit(BACKOFF).cast("bigint")))
        needed = model.join(at.select("context").distinct(), "context", "left_semi")
        found = salted_join(at, needed, ["context"])
        # One row, at most one entry per vocabulary id.
        other = unseen.select(F.lit(True).alias("_missed"), F.col("tokens").alias("_bt"), F.col("cum").alias("_bc"))
        both = found.withColumn("_missed", F.col("tokens").isNull()).join(F.broadcast(other), ["_missed"], "left")
        drawn = (both.withColumns({"_t": F.coalesce("tokens", "_bt"), "_c": F.coalesce("cum", "_bc"),
                                   "_u": draw(seed, "prompt_id", F.lit(step))})
                 .withColumn("_place", F.size(F.filter("_c", lambda c: c < F.col("_u"))))
                 .select("prompt_id", "max_new", "have", "code",
                         F.get("_t", F.least(F.col("_place"), F.size("_t") - 1)).cast("int").alias("token")))
        if stop_id is not None:
            drawn = drawn.where(F.col("token") != stop_id)
        # Stored before anything depends on it, so that a lost executor cannot change a step.
        drawn = written(drawn, "step")
        drawn.select("prompt_id", F.lit(step).alias("step"), "token").write.mode("append").parquet(path)
        following = (F.col("code") % span) * vocab + F.col("token") if n > 1 else F.lit(0).cast("bigint")
        live = drawn.where(F.col("max_new") > step).select(
            "prompt_id", "max_new", F.least(F.col("have") + 1, F.lit(max(n - 1, 0))).alias("have"), following.alias("code"))
        if live.isEmpty():
            break
    steps = spark.read.schema(kind).parquet(path)
    ids = steps.groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("step", "token")))["token"].alias("produced"))
    return state.join(ids.withColumnRenamed("prompt_id", "_id"), F.col("prompt_id").eqNullSafe(F.col("_id")), "left").select(
        "prompt_id", "ids", F.coalesce("produced", F.array().cast("array<int>")).alias("produced"))


def completed_text(df: DataFrame) -> DataFrame:
    """Prompt and continuation as one text (byte-level ids)."""
    return df.withColumn("text", decode_bytes(F.concat("ids", "produced")))


def run_prompt_suite(suite: DataFrame, model: DataFrame, n: int = 2, vocab: int = 256, seed: int = 0,
                     stop_id: int | None = NEWLINE_ID) -> DataFrame:
    """Complete named prompts ``(name, prompt, max_tokens)``; a failing one reports its error.

    A prompt fails if it has no token to continue, if its limit is missing or negative, or if it is
    so long that its ids would not fit a row. The others are completed all the same. The draws of a prompt follow from its name,
    text and limit, so equal rows get equal texts; a null name is a name of its own.
    """
    error = (F.when(F.coalesce(F.length("prompt"), F.lit(0)) == 0, F.lit("empty prompt"))
             .when(F.col("max_tokens").isNull(), F.lit("no token limit"))
             .when(F.col("max_tokens") < 0, F.concat(F.lit("negative token limit: "), F.col("max_tokens")))
             .when(F.octet_length("prompt") > LONGEST_PROMPT, F.lit("prompt too long")))
    usable = error.isNull()
    entry = suite.select("name", "prompt", "max_tokens", F.to_json(F.struct("name", "prompt", "max_tokens")).alias("_entry"))
    repeated = entry.groupBy("name").agg(F.count_distinct("_entry").alias("_n"))
    # A name that stands for one prompt seeds its draws alone.
    keyed = (entry.alias("e").join(repeated.alias("r"), F.expr("e.name <=> r.name"))
             .select("e.*", F.when((F.col("_n") == 1) & F.col("e.name").isNotNull(), F.col("e.name"))
                     .otherwise(F.col("_entry")).alias("_id")))
    keyed = written(keyed, "suite")
    prompts = keyed.where(usable).groupBy(F.col("_id").alias("prompt_id")).agg(
        F.any_value("prompt").alias("prompt"), F.any_value("max_tokens").alias("max_new")).select(
        "prompt_id", "max_new", encode_bytes("prompt", vocab).alias("ids"))
    done = completed_text(generate(prompts, model, n, vocab, seed=seed, stop_id=stop_id))
    texts = done.select(F.col("prompt_id").alias("_id"), F.col("text").alias("output"))
    return keyed.join(texts, "_id", "left").select("name", "prompt", "output", error.alias("error"))
