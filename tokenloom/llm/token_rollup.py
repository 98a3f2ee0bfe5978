"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A store is a folder of batches. A batch turns changes into signed rows: an insert adds a document's
count, a delete takes back what stands, a revision takes back the old count and adds the new one,
also where the document moved to another source or language. Totals are sums over all batches,
so they are additive and the order of batches does not matter to readers. A batch is committed
when its folder has the writer's success mark; applying it again does nothing, and what a writer
that failed left behind is not read and is overwritten by the next attempt.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")
DELTA = "key string, source string, lang string, tokenizer string, documents bigint, tokens bigint"


def _folder(spark: SparkSession, store: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def committed(spark: SparkSession, store: str) -> list[str]:
    """Identifiers of the batches that are complete, in order."""
    system, path = _folder(spark, store)
    if not system.exists(path):
        return []
    child = spark._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in system.listStatus(path)]
    return sorted(p.getName().removeprefix("batch=") for p in found
                  if p.getName().startswith("batch=") and system.exists(child(p, "deltas/_SUCCESS")))


def _read(spark: SparkSession, store: str, batches: list[str]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], DELTA)
    return spark.read.schema(DELTA).parquet(*[f"{store}/batch={b}/deltas" for b in batches])


def standing(deltas: DataFrame) -> DataFrame:
    """What counts now for every key and tokenizer version."""
    return (deltas.groupBy("key", *GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .where("documents <> 0 OR tokens <> 0"))


def changes(rows: DataFrame, op: str, key: str, tokenizer: str, tokens: Column, source: str = "source", lang: str = "lang") -> DataFrame:
    """Change rows from a table of documents; ``op`` is insert, revise or delete."""
    if op not in ("insert", "revise", "delete"):
        raise ValueError(f"unknown change {op}")
    return rows.select(
        F.lit(op).alias("op"), F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{source}`").cast("string").alias("source"),
        F.col(f"`{lang}`").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"),
        F.coalesce(tokens, F.lit(0)).cast("bigint").alias("tokens"))


def signed(changed: DataFrame, before: DataFrame) -> DataFrame:
    """Signed rows for changes against what stands.

    An insert of a key that stands is a revision, and a revision of one that does not is an insert;
    a delete of what does not stand does nothing. Changes of one key and tokenizer within a batch:
    a delete wins, else the largest count (then source and language). Rows without a key cannot be
    found again: inserts of them add up, revisions and deletes of them do nothing.
    """
    named = changed.where(F.col("key").isNotNull())
    wish = F.max(F.struct((F.col("op") == "delete").alias("gone"), "tokens", "source", "lang")).alias("new")
    wanted = named.groupBy("key", "tokenizer").agg(wish).select("key", "tokenizer", "new.*")
    old = before.where(F.col("key").isNotNull()).join(wanted.select("key", "tokenizer"), ["key", "tokenizer"], "left_semi")
    back = old.select("key", *GROUP, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))
    new = wanted.where(~F.col("gone")).select("key", *GROUP, F.lit(1).cast("bigint").alias("documents"), "tokens")
    nameless = (changed.where(F.col("key").isNull() & (F.col("op") == "insert")).groupBy("key", *GROUP)
                .agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens")))
    # What is taken back and added to the same group nets out to one row.
    return standing(back.unionByName(new)).unionByName(nameless)


def apply_batch(spark: SparkSession, store: str, batch: str, changed: DataFrame) -> bool:
    """Commit a batch of changes; False and no work if that batch was committed before.

    Batches of one store are applied one at a time.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError("a batch identifier has letters, digits, dot, dash and underscore")
    done = committed(spark, store)
    if batch in done:
        return False
    deltas = signed(changed, standing(_read(spark, store, done)))
    deltas.select("key", *GROUP, "documents", "tokens").write.mode("overwrite").parquet(f"{store}/batch={batch}/deltas")
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Documents and tokens of every source, language and tokenizer version that has any.

    Null sources and languages are groups of their own. The sum is formed from partial sums of each
    file, so a hot source costs one row per task.
    """
    sums = _read(spark, store, committed(spark, store)).groupBy(*GROUP).agg(
        F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return sums.where("documents <> 0 OR tokens <> 0")
