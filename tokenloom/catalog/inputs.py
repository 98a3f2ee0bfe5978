"""Operator inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import PREPARER_FIELDS
from tokenloom.plans.ordered import row_index
from tokenloom.sources.records import spread_few_files

# Invented run settings. The run "view" logs without any, and two runs with settings log nothing.
RUN_COLUMNS = ("run string, vocab_size int, block_size int, n_layers int, d_model int, n_heads int, "
               "dropout double, batch_size int, lr double, grad_accum_steps int, warmup_ratio double, "
               "min_lr_ratio double, iterations bigint")
RUNS = [
    ("signup", 300, 96, 3, 48, 2, 0.05, 24, 7e-4, 1, 0.02, 0.2, 90000),
    ("error", 300, 160, 5, 80, 4, 0.15, 12, 6e-4, 2, 0.05, 0.05, 120000),
    ("click", 700, 224, 7, 112, 7, 0.2, 6, 4.5e-4, 3, 0.1, 0.1, 600000),
    ("purchase", 700, 288, 9, 144, 9, 0.25, 3, 3.5e-4, 5, 0.04, 0.15, 750000),
    ("quiet_a", 900, 352, 11, 176, 11, 0.3, 2, 2.5e-4, 6, 0.03, 0.25, 810000),
    ("quiet_b", 900, 416, 13, 208, 13, 0.35, 1, 1.5e-4, 7, 0.01, 0.3, 990000),
]

# A small BPE vocabulary of all bytes and ten merged tokens, in rank order.
TOY_MERGES = ["th", "he", "in", "er", "an", "the", "ing", "on", "ti", "tion"]
TOY_RANKS = {**{bytes([b]): b for b in range(256)},
             **{t.encode(): 256 + i for i, t in enumerate(TOY_MERGES)}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and texts, spread for encoders and counters."""
    return spread_few_files(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the text in one of six fields, the others null or empty."""
    d = documents(spark, sf_dir)
    hole = F.when(F.col("doc_id") % 2 == 0, "")
    fields = [F.when((F.col("doc_id") % 17 != 0) & (F.col("doc_id") % 6 == i), F.col("text"))
              .otherwise(hole).alias(name) for i, name in enumerate(PREPARER_FIELDS)]
    return d.select("doc_id", "lang", *fields)


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, RUN_COLUMNS)


def log_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged point per event: a run per event type, every 100 iterations."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    slim = e.select(F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("loss"),
                    k.alias("k"))
    totals = slim.groupBy("run").agg((F.count("*") * 100).alias("total"))
    return (row_index(slim, ["ts", "event_id"], "_i", ["run"]).join(totals, "run")
            .select("run", ((F.col("_i") + 1) * 100).alias("iteration"), "total", "loss", "k", "ts",
                    "event_id", ((F.col("_i") + 1) * 100).alias("line_no"),
                    (F.col("k") / 64).alias("time_per_iter"),
                    (F.col("k") * F.lit(1e-6)).alias("lr")))


def train_lines(points: DataFrame) -> DataFrame:
    """Points as the trainer prints them, each followed by a line of noise."""
    line = F.concat(F.lit("Iter "), F.format_string("%5d", "iteration"), F.lit("/"),
                    F.col("total").cast("string"), F.lit(" | Loss: "), F.format_string("%.4f", "loss"),
                    F.lit(" | PPL: "), F.format_string("%.2f", F.col("loss") + 1), F.lit(" | LR: "),
                    F.col("k").cast("string"), F.lit("e-06 | "), F.format_number(F.col("k") * 1234, 0),
                    F.lit(" tok/s"))
    noise = F.concat(F.lit("Iter note | Loss: none "), F.col("iteration").cast("string"))
    return _two_lines(points, line, noise)


def monitor_lines(points: DataFrame) -> DataFrame:
    """Points as the monitor expects them; time and rate are missing or broken in places."""
    time = F.when(F.col("k") % 5 == 0, "").otherwise(
        F.concat(F.lit(" | Time: "), F.col("k").cast("string"), F.lit(".25s")))
    lr = (F.when(F.col("k") % 7 == 0, "").when(F.col("k") % 11 == 0, " | LR: 1.5e")
          .otherwise(F.concat(F.lit(" | LR: "), F.col("k").cast("string"), F.lit("e-05"))))
    line = F.concat(F.lit("Iteration "), F.col("iteration").cast("string"), F.lit("/"),
                    F.col("total").cast("string"), F.lit(" | Loss: "), F.format_string("%.4f", "loss"), time, lr)
    noise = F.concat(F.lit("Iteration finished | Loss pending "), F.col("iteration").cast("string"))
    return _two_lines(points, line, noise)


def _two_lines(points: DataFrame, line, noise) -> DataFrame:
    both = F.explode(F.array(F.struct(F.lit(0).alias("o"), line.alias("line")),
                             F.struct(F.lit(1).alias("o"), noise.alias("line")))).alias("l")
    return (points.select("run", "line_no", both)
            .select("run", (F.col("line_no") * 2 + F.col("l.o")).alias("line_no"), "l.line"))


def event_lines(points: DataFrame) -> DataFrame:
    """One of six event lines per point, chosen by its telemetry number."""
    it, loss, k = F.col("iteration").cast("string"), F.format_string("%.4f", "loss"), F.col("k")
    c = k.cast("string")
    line = (F.when(k % 7 == 0, F.concat(F.lit("✅ Best checkpoint saved: models/best_"), it, F.lit(".pt (Loss: "), loss, F.lit(")")))
            .when(k % 7 == 1, F.concat(F.lit("📊 No improvement | Patience: "), c, F.lit("/100 | Best Loss: "), loss))
            .when(k % 7 == 2, F.concat(F.lit("Training stopped at iteration "), it, F.lit("/"), F.col("total").cast("string")))
            .when(k % 7 == 3, F.concat(F.lit("Best loss: "), loss))
            .when(k % 7 == 4, F.concat(F.lit("No improvement for "), it, F.lit(" iterations")))
            .when(k % 7 == 5, F.concat(F.lit("--- Sample after iter "), it, F.lit(" ---")))
            .otherwise("---"))
    return points.select("run", "line_no", line.alias("line"))


def gpu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPU tool lines; some have a word for a number, some are short, some have extras."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    text = [x.cast("string") for x in (k, k * 1000, F.lit(80000), 40 + k % 60, k * 7)]
    good = F.concat_ws(", ", *text)
    line = (F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("[N/A], "), good))
            .when(F.col("event_id") % 17 == 0, F.concat_ws(", ", *text[:3]))
            .when(F.col("event_id") % 19 == 0, F.concat(good, F.lit(", P0"))).otherwise(good))
    return e.select("event_id", F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("ts"),
                    line.alias("line"))
