"""Registered queries: instruction data, next-token model, logs, metrics, telemetry, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.catalog.corpus import md5_ids
from tokenloom.catalog.inputs import (documents, event_lines, gpu_lines, log_points, monitor_lines, runs,
                                      table, texts, train_lines)
from tokenloom.functions.codecs import encode_bytes
from tokenloom.functions.numeric import apply_schedule, format_duration, lr_multiplier, perplexity
from tokenloom.operators import early_stop, generate, instruct, metrics, ngrams, runlog, telemetry
from tokenloom.session import scratch_path, written
from tokenloom.sources import logs
from tokenloom.sources import metrics as metric_tables
from tokenloom.streaming import corpus as stream_corpus
from tokenloom.streaming import early_stop as stream_stop
from tokenloom.streaming import logs as stream_logs
from tokenloom.streaming import telemetry as stream_gpu

RUN_TAGS = ["click", "error", "purchase", "signup", "view"]
NOW = "2024-06-01 12:00:00"
STREAM_WIDTH, STREAM_LATENESS = "1 hour", "10 minutes"


# Instruction data ------------------------------------------------------------------

def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return instruct.pair_turns(table(spark, sf, "conversations"))


def render_sft(spark, sf):
    r = instruct.render_sft(_pairs(spark, sf))
    return r.select("conv_id", "turn", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def pair_turns(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", F.md5("instruction").alias("instruction_md5"),
                                    F.md5("output").alias("output_md5"))


def _masked(spark, sf):
    ids = _pairs(spark, sf).select("conv_id", "turn", encode_bytes(instruct.prompt_text()).alias("p"),
                                   encode_bytes("output").alias("r"))
    both, labels = instruct.mask_prompt("p", "r")
    return ids.select("conv_id", "turn", both.alias("ids"), labels.alias("labels"))


def mask_prompt(spark, sf):
    return _masked(spark, sf).select("conv_id", "turn", md5_ids("ids").alias("ids_md5"),
                                     md5_ids("labels").alias("labels_md5"))


def truncate_pad(spark, sf):
    return _masked(spark, sf).select(
        "conv_id", "turn", md5_ids(instruct.truncate_pad("ids", pad_id=0)).alias("ids_md5"),
        md5_ids(instruct.truncate_pad("labels", pad_id=instruct.IGNORED_LABEL)).alias("labels_md5"),
        F.aggregate(instruct.attention_mask("ids"), F.lit(0), lambda a, x: a + x).alias("used"))


def _batches(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.octet_length("text").alias("n"))
    return instruct.length_group_batches(docs, ["doc_id"], "n", batch_size=4)


def length_group_batches(spark, sf):
    return _batches(spark, sf)


def padding_waste(spark, sf):
    return instruct.padding_waste(_batches(spark, sf), "n")


def apply_formatter(spark, sf):
    def dialogue(columns):
        return [f"Q ({len(q)}): {q}\nA: {a}" for q, a in zip(columns["instruction"], columns["output"])]

    done = instruct.apply_formatter(_pairs(spark, sf), dialogue, ["instruction", "output"])
    return done.select("conv_id", "turn", F.md5("text").alias("text_md5"))


# Next-token model ------------------------------------------------------------------

def fit_ngrams(spark, sf):
    return ngrams.fit_ngrams(texts(spark, sf), "text", 2)


def fit_trigrams(spark, sf):
    return ngrams.fit_ngrams(texts(spark, sf), "text", 3)


def _losses(spark, sf):
    docs = texts(spark, sf)
    return ngrams.cross_entropy(docs, "doc_id", "text", written(ngrams.fit_ngrams(docs, "text"), "counts"))


def cross_entropy(spark, sf):
    return _losses(spark, sf).select("doc_id", "n_pairs", F.round("loss", 6).alias("loss"))


def cross_entropy_total(spark, sf):
    return ngrams.total_loss(_losses(spark, sf)).select(
        "n_pairs", F.round("loss", 6).alias("loss"), F.round(perplexity("loss"), 6).alias("ppl"))


def ppl(spark, sf):
    e = table(spark, sf, "events").withColumn("loss", F.col("value") / 10)
    return e.select("event_id", F.round(perplexity("loss"), 3).alias("ppl"),
                    F.round(perplexity(F.col("loss") / 10, base=2), 6).alias("ppl_base2"))


def next_token_probs(spark, sf):
    logits = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("prompt_id"), F.posexplode("embedding").alias("token_id", "logit"))
    logits = logits.withColumn("logit", F.col("logit").cast("double") * 10)
    probs = ngrams.next_token_probs(logits, temperature=0.8, top_k=40)
    return probs.select("prompt_id", "token_id", F.round("prob", 8).alias("prob"))


def _model(spark, sf, temperature, top_k):
    counts = written(ngrams.fit_ngrams(texts(spark, sf), "text"), "counts")
    return written(generate.continuations(counts, temperature, top_k), "model")


def continuations(spark, sf):
    return _model(spark, sf, 0.8, 40).select(
        "context", F.array_join("tokens", ",").alias("tokens"),
        F.array_join(F.transform("cum", lambda c: F.floor(c * 1e6 + 0.5).cast("string")), ",").alias("cum_millionths"))


def generated(spark, sf):
    prompts = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"),
                                                   encode_bytes("text").alias("ids"))
    done = generate.generate(prompts, _model(spark, sf, 0.8, 40), max_new=64, seed=7)
    return done.select("prompt_id", F.size("ids").alias("n_prompt"),
                       F.array_join("produced", ",").alias("produced"))


def prompt_suite(spark, sf):
    items = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("name"),
        F.when(F.col("item_id") % 10 == 3, "").otherwise(F.col("text")).alias("prompt"),
        F.when(F.col("item_id") % 10 == 7, -F.col("item_id")).when(F.col("item_id") % 10 != 8, F.lit(100) + F.col("item_id") % 3 * 50)
        .cast("int").alias("max_tokens"))
    # Byte 46 is the full stop: with byte-level ids it takes the newline id's part.
    done = generate.run_prompt_suite(items, _model(spark, sf, 0.7, 40), seed=7, stop_id=46)
    return done.select("name", F.md5("output").alias("output_md5"), "error")


# Logs ------------------------------------------------------------------------------

def append_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    points = log_points(spark, sf).select(
        "run", F.col("iteration").alias("step"),
        F.create_map(F.lit("train/loss"), F.col("loss"), F.lit("train/k"), F.col("k").cast("double")).alias("metrics"))
    metric_tables.append_metrics(metric_tables.explode_metrics(points), path)
    return spark.read.parquet(path).select("run", "tag", "step", "value")


def append_samples(spark, sf):
    path = scratch_path(spark, "samples")
    made = _pairs(spark, sf).select(F.lit("sft").alias("run"), (F.col("conv_id") * 100 + F.col("turn")).alias("step"),
                                    F.col("instruction").alias("prompt"), F.col("output").alias("generated"))
    metric_tables.append_samples(made, path)
    return spark.read.parquet(path).select("run", "step", F.md5("prompt").alias("prompt_md5"),
                                           F.md5("generated").alias("generated_md5"), "display")


#: Lines of one landed log file.
FILE_LINES = 20_000


def _numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Trainer lines numbered from 0: a point every 100 iterations has two of them."""
    return train_lines(log_points(spark, sf)).withColumn("line_no", F.expr("2 * (line_no div 200 - 1) + line_no % 200"))


def _log_files(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Lines as text files in order, of ``FILE_LINES`` lines each; the folders name run and part."""
    parted = lines.withColumn("part", F.expr(f"line_no div {FILE_LINES}"))
    (parted.repartition("run", "part").sortWithinPartitions("run", "part", "line_no")
     .select("run", "part", "line").write.mode(mode).partitionBy("run", "part").text(path))


def _named_by_folder(lines: DataFrame) -> DataFrame:
    """Run and part from the path below the log folder."""
    folder = r"^run=([^/]*)/part=(\d+)/"
    return lines.withColumns({"part": F.regexp_extract("run", folder, 2).cast("bigint"), "run": F.regexp_extract("run", folder, 1)})


def read_log(spark, sf):
    """Lines written as text files are read back, named by their folders and numbered within each file."""
    path = scratch_path(spark, "logs")
    _log_files(_numbered_lines(spark, sf), path)
    return _named_by_folder(logs.read_log(spark, path)).select("run", "part", "line_no", "line")


def read_telemetry(spark, sf):
    return logs.read_telemetry(gpu_lines(spark, sf)).select("event_id", *logs.GPU_FIELDS)


def parse_train_lines(spark, sf):
    p = runlog.parse_train_lines(train_lines(log_points(spark, sf)))
    return p.select("run", "iteration", "total", "loss", "ppl", "lr", "tok_per_s")


def parse_monitor_lines(spark, sf):
    p = runlog.parse_monitor_lines(monitor_lines(log_points(spark, sf)))
    return p.select("run", "iteration", "total", "loss", "time_per_iter", "lr")


def parse_points(spark, sf):
    points = log_points(spark, sf)
    p = runlog.parse_points(train_lines(points).unionByName(monitor_lines(points)))
    return p.groupBy("run", "iteration").agg(F.count("*").alias("lines"), F.max("loss").alias("loss"))


def parse_events(spark, sf):
    return runlog.parse_events(event_lines(log_points(spark, sf))).drop("line_no")


def tail_lines(spark, sf):
    return runlog.tail_lines(train_lines(log_points(spark, sf)))


def current_status(spark, sf):
    s = runlog.current_status(log_points(spark, sf).withColumn("loss", F.col("loss") / 64))
    return s.select("run", "iteration", "total", "loss", "lr", "time_per_iter",
                    F.round("progress_pct", 6).alias("progress_pct"), F.round("ppl", 6).alias("ppl"),
                    F.round("ppl_base2", 6).alias("ppl_base2"))


def loss_change(spark, sf):
    c = runlog.loss_change(log_points(spark, sf))
    return c.select("run", "iteration", F.round("change", 6).alias("change"), "trend")


def sparkline(spark, sf):
    return runlog.sparkline(log_points(spark, sf))


def eta(spark, sf):
    points = log_points(spark, sf).withColumn("total", F.col("total") * 2)
    status = runlog.current_status(points)
    found = runlog.eta(status, F.lit(NOW).cast("timestamp"))
    return found.select("run", F.round("eta_seconds", 6).alias("eta_seconds"), "eta", "completion")


def format_durations(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") * 37 + F.lit(0.26)).alias("s"))
    return e.select("event_id", format_duration("s").alias("took"))


def recent_history(spark, sf):
    points = log_points(spark, sf).withColumn("time_per_iter", F.when(F.col("k") % 2 == 0, F.col("k") + F.lit(0.25)))
    return runlog.recent_history(points).select("run", "iteration", "loss", "time_text")


def lr_audit(spark, sf):
    a = metrics.lr_audit(log_points(spark, sf), runs(spark))
    return a.select("run", "iteration", "scheduler_step", F.round("expected_lr", 12).alias("expected_lr"),
                    F.round("abs_diff", 12).alias("abs_diff"))


def early_stopping(spark, sf):
    e = early_stop.early_stopping(log_points(spark, sf))
    return e.select("run", "iteration", F.round("recent_avg", 6).alias("recent_avg"), "improved",
                    F.round("best_loss", 6).alias("best_loss"), "best_iteration", "counter", "stopped")


def rolling_loss(spark, sf):
    r = early_stop.rolling_loss(log_points(spark, sf), 10)
    return r.select("run", "iteration", F.round("recent_avg", 6).alias("recent_avg"))


def best_checkpoint(spark, sf):
    b = early_stop.best_checkpoint(early_stop.early_stopping(log_points(spark, sf)), runs(spark))
    return b.select("run", "iteration", F.round("loss", 6).alias("loss"), "vocab_size", "block_size",
                    "n_layers", "d_model", "n_heads", "dropout")


def early_stop_savings(spark, sf):
    s = early_stop.early_stop_savings(early_stop.early_stopping(log_points(spark, sf)), runs(spark))
    return s.select("run", "planned", "iterations_run", F.round("saved_share", 6).alias("saved_share"),
                    "idle_iterations", F.round("planned_cost", 6).alias("planned_cost"), F.round("cost", 6).alias("cost"))


def auto_step(spark, sf):
    calls = log_points(spark, sf).select(
        "run", F.col("event_id").alias("call_no"), F.when(F.col("k") % 3 > 0, F.col("iteration")).alias("step"),
        F.col("loss").alias("value"))
    return metrics.auto_step(calls).select("run", "call_no", "step", "value")


def l2_norm(spark, sf):
    n = metrics.l2_norm(table(spark, sf, "embeddings"), "embedding", ["label"])
    return n.select("label", F.round("norm", 6).alias("norm"))


def value_histograms(spark, sf):
    h = metrics.value_histograms(table(spark, sf, "embeddings"), "embedding", ["label"])
    return h.select("label", "bin", "n")


def _metric_rows(spark, sf):
    return log_points(spark, sf).select("run", F.lit("train/loss").alias("tag"),
                                        F.col("iteration").alias("step"), F.col("loss").alias("value"))


def compare_runs(spark, sf):
    return metrics.compare_runs(_metric_rows(spark, sf), "train/loss")


def runs_with_config(spark, sf):
    r = metrics.runs_with_config(_metric_rows(spark, sf), runs(spark))
    return r.select("run", "name", "n_layers", "d_model", "lr", "tag", "last_step", "last_value")


def schedule(spark, sf):
    def halves(step: int) -> float:
        return 0.5 ** (step // 50000)

    p = log_points(spark, sf)
    return p.select("run", "iteration", apply_schedule("iteration", halves).alias("multiplier"),
                    F.round(lr_multiplier("iteration", 450, 250000), 9).alias("cosine"))


# Telemetry -------------------------------------------------------------------------

def _gpu(spark, sf):
    return logs.read_telemetry(gpu_lines(spark, sf))


def gpu_panel(spark, sf):
    p = telemetry.gpu_panel(_gpu(spark, sf))
    return p.select("event_id", F.round("mem_pct", 6).alias("mem_pct"), "temp_status", "gpu_bar", "mem_bar",
                    "temp_bar", "power_bar")


def cost_tracking(spark, sf):
    c = telemetry.cost_tracking(_gpu(spark, sf), planned_hours=800)
    return c.select("run", *[F.round(x, 6).alias(x) for x in ("hours", "cost", "estimated_cost", "remaining_hours")])


def run_liveness(spark, sf):
    points = _gpu(spark, sf)
    last = points.agg(F.max("ts")).first()[0]
    return telemetry.run_liveness(points, F.lit(last), 600).select("run", "status")


# Streams ---------------------------------------------------------------------------

def _drained(stream: DataFrame, mode: str = "append", path: str | None = None, state: str | None = None) -> DataFrame:
    """Run a stream over all that is present, into Parquet in the shared folder; it resumes from a given state."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("checkpointLocation", state or scratch_path(spark, "stream-state"))
             .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _landed(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def stream_log_points(spark, sf):
    """Logs that arrive in two instalments, followed by one stream that is stopped and started again."""
    lines = written(_numbered_lines(spark, sf), "lines")
    path, out, state = (scratch_path(spark, label) for label in ("live-logs", "points", "stream-state"))
    for turn in (0, 1):
        _log_files(lines.where(F.expr(f"line_no div {FILE_LINES} % 2 = {turn}")), path, "append")
        found = _drained(stream_logs.stream_log_points(spark, path), path=out, state=state)
    return _named_by_folder(found).select("run", "part", "position", "iteration", "total", "loss", "ppl", "lr", "tok_per_s")


def _gpu_stream(spark, sf):
    records = _gpu(spark, sf)
    return spark.readStream.schema(records.schema).parquet(_landed(records, "gpu"))


def stream_telemetry(spark, sf):
    """Windows closed by the watermark; those still open stay in the stream's state."""
    w = _drained(stream_gpu.stream_telemetry(_gpu_stream(spark, sf), STREAM_WIDTH, STREAM_LATENESS))
    return _rounded_windows(w)


def batch_telemetry(spark, sf):
    return _rounded_windows(stream_gpu.telemetry_windows(_gpu(spark, sf), STREAM_WIDTH))


def _rounded_windows(w: DataFrame) -> DataFrame:
    return w.select("run", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "readings",
                    *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in logs.GPU_FIELDS], "max_temp")


def stream_early_stopping(spark, sf):
    """Points dealt over files without any order, in three micro-batches; every point is waited for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    points = log_points(spark, sf).select("run", "iteration", "loss")
    files = max(6, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = points.repartition(files, F.xxhash64("iteration", F.lit(1)))
    arriving = (spark.readStream.schema(points.schema).option("maxFilesPerTrigger", -(-files // 3))
                .parquet(_landed(dealt, "points")))
    e = _drained(stream_stop.stream_early_stopping(arriving, arrival=stream_stop.Arrival(log_interval=100, first=100)))
    return e.select("run", "iteration", F.round("recent_avg", 6).alias("recent_avg"), "improved",
                    F.round("best_loss", 6).alias("best_loss"), "best_iteration", "counter", "stopped", "late_points")


def stream_token_totals(spark, sf):
    """Complete mode with one row per language: the result stays small whatever arrives."""
    docs = documents(spark, sf).select("doc_id", "lang", "text")
    stream = stream_corpus.stream_documents(spark, _landed(docs, "arriving"), docs.schema, max_files=2)
    name = "totals_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    query = (stream_corpus.stream_token_totals(stream, F.octet_length("text"), ["lang"]).writeStream
             .format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.table(name).withColumn("avg_tokens", F.round("avg_tokens", 6))


QUERIES = {
    "f1_render_sft": render_sft,
    "f2_pair_turns": pair_turns,
    "f3_mask_prompt": mask_prompt,
    "f4_truncate_pad": truncate_pad,
    "f5_length_group_batches": length_group_batches,
    "f5_padding_waste": padding_waste,
    "u1_apply_formatter": apply_formatter,
    "m1_fit_ngrams": fit_ngrams,
    "m1_fit_trigrams": fit_trigrams,
    "m2_cross_entropy": cross_entropy,
    "m2_cross_entropy_total": cross_entropy_total,
    "m3_perplexity": ppl,
    "m4_next_token_probs": next_token_probs,
    "m5_continuations": continuations,
    "m5_generate": generated,
    "m6_prompt_suite": prompt_suite,
    "s8_append_metrics": append_metrics,
    "s9_append_samples": append_samples,
    "s10_read_log": read_log,
    "s11_read_telemetry": read_telemetry,
    "l1_parse_train_lines": parse_train_lines,
    "l2_parse_monitor_lines": parse_monitor_lines,
    "l1_l2_parse_points": parse_points,
    "l3_parse_events": parse_events,
    "l4_tail_lines": tail_lines,
    "l5_current_status": current_status,
    "l6_loss_change": loss_change,
    "l7_sparkline": sparkline,
    "l8_eta": eta,
    "l9_format_duration": format_durations,
    "l10_recent_history": recent_history,
    "l11_lr_audit": lr_audit,
    "l12_early_stopping": early_stopping,
    "l13_rolling_loss": rolling_loss,
    "l14_best_checkpoint": best_checkpoint,
    "l15_early_stop_savings": early_stop_savings,
    "l16_auto_step": auto_step,
    "l17_l2_norm": l2_norm,
    "l18_value_histograms": value_histograms,
    "l19_compare_runs": compare_runs,
    "l20_runs_with_config": runs_with_config,
    "u2_apply_schedule": schedule,
    "g1_g2_g3_gpu_panel": gpu_panel,
    "g4_cost_tracking": cost_tracking,
    "g5_run_liveness": run_liveness,
    "r1_stream_log_points": stream_log_points,
    "r2_stream_telemetry": stream_telemetry,
    "r2_batch_telemetry": batch_telemetry,
    "r3_stream_early_stopping": stream_early_stopping,
    "r4_stream_token_totals": stream_token_totals,
}
