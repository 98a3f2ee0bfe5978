"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded sample of the labelled documents, cut into shards. A round runs the
online learner over every shard in parallel, each from the common state, and adds what the
shards changed, feature by feature. The state has one row per hashed feature, so its size is
set by ``bits`` and not by the data; weights that L1 leaves at zero are not part of the model.
Scoring is one narrow pass with the broadcast weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .words import gram_hashes, small_batches, word_hashes, words

#: Word n-grams and skip-grams, as places relative to the first word.
GRAMS = ((0,), (0, 1), (0, 2), (0, 3))


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled documents that are read for training; 2**bits features."""

    sample: int = 20_000
    bits: int = 20
    shards: int = 6
    rounds: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    seed: int = 0


def features(text: bytes | None, bits: int) -> np.ndarray:
    """Distinct hashed features of a whole text. Punctuation around a word is not part of it."""
    found = [w for w in (w.strip(b".,;:!?\"'()[]|*#-") for w in words(text)) if w]
    hashes = word_hashes(found)
    grams = [gram_hashes(hashes, g) for g in GRAMS]
    return np.unique(np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Model:
    """Sparse weights by feature, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """The proximal step: L1 keeps a coordinate at zero until its gradients outweigh it."""
    rate = (s.beta + np.sqrt(n)) / s.alpha + s.l2
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / rate)


def _learn(z: np.ndarray, n: np.ndarray, rows: Iterable[tuple[np.ndarray, int, float]], s: Settings) -> None:
    """One pass of the online learner. The last coordinate is the intercept, which L1 spares."""
    last = len(z) - 1
    for index, label, importance in rows:
        at = np.append(index, last)
        zi, ni = z[at], n[at]
        w = _weights(zi, ni, s)
        w[-1] = -zi[-1] / ((s.beta + math.sqrt(ni[-1])) / s.alpha + s.l2)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum())))))
        g = (p - label) * importance
        grown = ni + g * g
        z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / s.alpha * w
        n[at] = grown


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, *,
                  folds: int, held_out: int, settings: Settings) -> DataFrame:
    """Texts and labels of at most ``settings.sample`` labelled documents outside the held-out fold.

    The fold is the CRC-32 of the key as text modulo ``folds``. The sample is the smallest hashes
    of the keys; a key with several different labels is not used. Keys and labels decide what is
    learned but are no inputs of a score.
    """
    marked = (labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
              .where(F.crc32(F.col("id").cast("string").cast("binary")) % folds != held_out)
              .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
              .where("label = other").select("id", "label"))
    picked = marked.orderBy(F.xxhash64("id", F.lit(settings.seed)), "id").limit(settings.sample)
    read = (docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
            .join(F.broadcast(picked), "id")
            # Of repeated keys one text is used, so that nothing counts twice.
            .groupBy("id", "label").agg(F.min("text").alias("text")))
    return (read.withColumn("turn", F.xxhash64("id", F.lit(settings.seed + 1)))
            .withColumn("shard", F.pmod(F.col("turn"), F.lit(settings.shards)).cast("int")))


def fit(rows: DataFrame, settings: Settings) -> Model:
    """Train on labelled texts. A class weighs with the root of how rare it is.

    Features are made again in each round: they take several times the space of the texts.

    Without rows of both classes there is nothing to tell apart: all weights stay zero and
    every score is the share of label 1 (0 without rows).
    """
    s = settings
    spark = rows.sparkSession
    rows = written(rows, "labelled")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / max(total, 1)
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), 40.0 if share else -40.0, s.bits)
    weight = {label: math.sqrt(total / (2 * count)) for label, count in counts.items()}
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(s.rounds):
        index = np.flatnonzero(n).astype(np.int32)
        state = spark.sparkContext.broadcast((index, z[index], n[index]))

        def run(group: pd.DataFrame) -> pd.DataFrame:
            z, n = np.zeros(size), np.zeros(size)
            at, z0, n0 = state.value
            z[at], n[at] = z0, n0
            before_z, before_n = z.copy(), n.copy()
            group = group.sort_values(["turn", "id"])
            _learn(z, n, ((features(t, s.bits), y, weight[y]) for t, y in zip(group["text"], group["label"])), s)
            moved = np.flatnonzero(n != before_n).astype(np.int32)
            return pd.DataFrame({"feature": moved, "z": (z - before_z)[moved], "n": (n - before_n)[moved]})

        changed = (rows.groupBy("shard").applyInPandas(run, "feature int, z double, n double")
                   .groupBy("feature").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))).toArrow()
        at = changed["feature"].to_numpy()
        z[at] += changed["z"].to_numpy() / s.shards
        n[at] += changed["n"].to_numpy() / s.shards
        # Frees the driver's copy too; the next round sends a new one.
        state.destroy()
        del changed, at
    weights = _weights(z, n, s)
    kept = np.flatnonzero(weights[:-1]).astype(np.int32)
    intercept = -z[-1] / ((s.beta + math.sqrt(n[-1])) / s.alpha + s.l2)
    return Model(kept, weights[kept].astype(np.float32), float(intercept), s.bits)


def score(df: DataFrame, text: str, model: Model, out: str = "score") -> DataFrame:
    """Add the probability of label 1 for every whole text; null and empty texts get the intercept's.

    A column named ``out`` is replaced; all other columns and all rows stay. Narrow.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != out]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"),
                       F.col(f"`{text}`").cast("binary").alias("_in"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = model.dense()
        for batch in batches:
            logits = [model.intercept + float(weights[features(t, model.bits)].sum(dtype=np.float64))
                      for t in batch.column(1).to_pylist()]
            found = 1 / (1 + np.exp(-np.clip(np.array(logits, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["_row", out])

    fields = T.StructType([packed.schema["_row"], T.StructField(out, T.DoubleType())])
    return packed.mapInArrow(run, fields).select("_row.*", out)


def toxicity_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", *,
                   folds: int = 5, held_out: int = 0, settings: Settings = Settings()) -> Model:
    return fit(training_rows(docs, labels, key, text, label, folds=folds, held_out=held_out, settings=settings), settings)
