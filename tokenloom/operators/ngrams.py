"""Next-token model as count tables, its loss, and next-token distributions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.codecs import PART, row_parts
from tokenloom.plans.joins import BROADCAST_ROWS, fits, lookup_join

DENSE_CODES = 1 << 20


def _codes(values: pa.Array, n: int, vocab: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """n-grams of a batch that stay inside one row: their numbers and their rows, up to ``PART`` at a time.

    An n-gram is the base-``vocab`` number of its ids; the last digit is the target.
    """
    is_text = pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
    if is_text:
        raw = values.cast(pa.large_binary())
        bounds = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        data = raw.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data else np.empty(0, np.uint8)
        ends = bounds[1:] - bounds[0]
    else:
        flat = values.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    for begin in range(0, len(flat) - n + 1, PART):
        span = min(PART, len(flat) - n + 1 - begin)
        ids = flat[begin:begin + span + n - 1]
        ids = np.minimum(ids, vocab - 1) if is_text else ids
        # The rows that these ids lie in; ids of one row have the same number.
        first, last = np.searchsorted(ends, [begin, begin + len(ids) - 1], "right")
        inner = np.clip(ends[first:last + 1] - begin, 0, len(ids))
        rows = np.repeat(np.arange(first, last + 1), np.diff(inner, prepend=0))
        code = np.zeros(span, np.int64)
        for j in range(n):
            code = code * vocab + ids[j:j + span]
        inside = rows[:span] == rows[n - 1:]
        yield code[inside], rows[:span][inside]


def _check(n: int, vocab: int) -> None:
    if n < 1 or vocab ** n >= 2 ** 63:
        raise ValueError("n-grams of this order and vocabulary exceed 64 bits")


def fit_ngrams(df: DataFrame, column: str, n: int = 2, vocab: int = 256) -> DataFrame:
    """Counts ``(context, token_id, n)`` of each id after each ``n - 1`` ids.

    Every task counts its Arrow batches, a part at a time, before anything is shuffled. ``column`` is an
    array of ids, or a text read as byte-level ids.
    """
    _check(n, vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, _ in _codes(batch.column(0), n, vocab):
                seen, times = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen // vocab), pa.array((seen % vocab).astype(np.int32)), pa.array(times)],
                    ["context", "token_id", "n"])

    partial = df.select(column).mapInArrow(count, "context bigint, token_id int, n bigint")
    return partial.groupBy("context", "token_id").agg(F.sum("n").alias("n"))


def row_ngrams(df: DataFrame, key: str, column: str, n: int = 2, vocab: int = 256) -> DataFrame:
    """The same counts per row of the input, identified by ``key``."""
    _check(n, vocab)
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(
        "context bigint, token_id int, n bigint").fields])

    def counted(keys: pa.Array, run: pa.Array) -> Iterator[pa.RecordBatch]:
        found = list(_codes(run, n, vocab))
        if not found:
            return
        codes, rows = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.lexsort((codes, rows))
        codes, rows = codes[order], rows[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(codes)))
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(rows[at])), pa.array(codes[at] // vocab),
             pa.array((codes[at] % vocab).astype(np.int32)), pa.array(times)],
            [key, "context", "token_id", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            # Whole rows at a time, so that a row has each of its n-grams once.
            for run in row_parts(batch.column(1)):
                yield from counted(batch.column(0).slice(at, len(run)), run)
                at += len(run)

    return df.select(key, column).mapInArrow(count, schema)


def cross_entropy(df: DataFrame, key: str, column: str, counts: DataFrame, n: int = 2,
                  vocab: int = 256, add_k: float = 1.0, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mean negative log-likelihood per key under add-k smoothed counts.

    One row per key that has an n-gram, null included; rows that share a key are summed. A count table within ``max_rows`` is broadcast and each row is scored where it is
    read: nothing is shuffled. A larger table is joined with the rows' n-grams on salted
    keys; those of one row leave one task together, so the final sum shuffles little.
    """
    if fits(counts, max_rows):
        each = _scored_in_tasks(df, key, column, counts, n, vocab, add_k)
        return (each.groupBy(key)
                .agg(F.sum("n_pairs").alias("n_pairs"), F.sum(F.col("loss") * F.col("n_pairs")).alias("_nll"))
                .select(key, "n_pairs", (F.col("_nll") / F.col("n_pairs")).alias("loss")))
    pairs = counts.select("context", "token_id", F.col("n").alias("_pair"))
    contexts = counts.groupBy("context").agg(F.sum("n").alias("_context"))
    seen = lookup_join(row_ngrams(df, key, column, n, vocab), pairs, ["context", "token_id"], max_rows=max_rows)
    seen = lookup_join(seen, contexts, ["context"], max_rows=max_rows)
    p = ((F.coalesce("_pair", F.lit(0)) + F.lit(add_k))
         / (F.coalesce("_context", F.lit(0)) + F.lit(add_k * vocab)))
    return (seen.groupBy(key)
            .agg(F.sum("n").alias("n_pairs"), F.sum(-F.log(p) * F.col("n")).alias("_nll"))
            .select(key, "n_pairs", (F.col("_nll") / F.col("n_pairs")).alias("loss")))


def _scored_in_tasks(df: DataFrame, key: str, column: str, counts: DataFrame, n: int, vocab: int,
                     add_k: float) -> DataFrame:
    _check(n, vocab)
    table = counts.select((F.col("context") * vocab + F.col("token_id")).alias("code"), "n").toPandas()
    table = table.sort_values("code")
    codes, times = table["code"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    contexts, first = np.unique(codes // vocab, return_index=True)
    totals = np.add.reduceat(times, first) if len(times) else times
    shared = df.sparkSession.sparkContext.broadcast((codes, times, contexts, totals))
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("n_pairs bigint, loss double").fields])

    # A small code space is scored through one dense table, a larger one by binary search.
    dense = vocab ** n <= DENSE_CODES

    def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def losses(wanted: np.ndarray) -> np.ndarray:
        codes_, times_, contexts_, totals_ = shared.value
        p = ((look_up(codes_, times_, wanted) + add_k)
             / (look_up(contexts_, totals_, wanted // vocab) + add_k * vocab))
        return -np.log(p)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = losses(np.arange(vocab ** n)) if dense else None
        for batch in batches:
            pairs, nll = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for wanted, rows in _codes(batch.column(1), n, vocab):
                pairs += np.bincount(rows, minlength=len(batch))
                nll += np.bincount(rows, weights=table[wanted] if dense else losses(wanted), minlength=len(batch))
            kept = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), pa.array(pairs[kept]),
                 pa.array(nll[kept] / pairs[kept])], [key, "n_pairs", "loss"])

    return df.select(key, column).mapInArrow(score, schema)


def total_loss(per_row: DataFrame) -> DataFrame:
    """Corpus loss: rows weigh as much as they have predictions."""
    return per_row.agg(F.sum("n_pairs").alias("n_pairs"),
                       (F.sum(F.col("loss") * F.col("n_pairs")) / F.sum("n_pairs")).alias("loss"))


def next_token_probs(logits: DataFrame, group: Sequence[str] = ("prompt_id",), temperature: float = 1.0,
                     top_k: int | None = None) -> DataFrame:
    """Softmax of scaled logits over the ids whose logit is at least the k-th largest.

    Ids tied with the k-th stay. A group has at most one row per vocabulary entry.
    """
    whole = Window.partitionBy(*group)
    scaled = logits.withColumn("_z", F.col("logit") / temperature)
    if top_k is not None:
        falling = whole.orderBy(F.desc("_z"))
        scaled = scaled.withColumn("_rank", F.rank().over(falling)).where(F.col("_rank") <= top_k)
    raised = scaled.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(whole)))
    return raised.select(*group, "token_id", (F.col("_e") / F.sum("_e").over(whole)).alias("prob"))
