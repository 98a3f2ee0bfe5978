import datetime
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.numeric import apply_schedule
from tokenloom.operators import early_stop, metrics, runlog, telemetry
from tokenloom.operators.early_stop import StopRule
from tokenloom.sources import logs
from tokenloom.streaming import corpus as stream_corpus
from tokenloom.streaming import early_stop as stream_stop
from tokenloom.streaming import logs as stream_logs
from tokenloom.streaming import telemetry as stream_gpu

TIMELINE = [3.45, 2.89, 2.54, 2.38, 2.27, 2.24, 2.23, 2.24, 2.25, 2.26, 2.25, 2.27]


def lines(spark, rows, run="r"):
    return spark.createDataFrame([(run, i, t) for i, t in enumerate(rows)], "run string, line_no long, line string")


def points(spark, losses, step=100, run="r"):
    return spark.createDataFrame([(run, step * (i + 1), float(v)) for i, v in enumerate(losses)],
                                 "run string, iteration long, loss double")


def test_trainer_lines(spark):
    df = lines(spark, ["Iter   100/15000 | Loss: 3.4560 | PPL: 31.69 | LR: 1.50e-04 | 12,345 tok/s",
                       "Iter 200/15000 | Loss: nan | PPL: nan | LR: 0.00e+00 | 0 tok/s", "Iter", "\n--- Sample ---"])
    rows = runlog.parse_train_lines(df).orderBy("line_no").collect()
    assert (rows[0]["iteration"], rows[0]["loss"], rows[0]["lr"], rows[0]["tok_per_s"]) == (100, 3.456, 1.5e-4, 12345)
    assert len(rows) == 2 and rows[1]["loss"] != rows[1]["loss"]


def test_monitor_lines(spark):
    df = lines(spark, ["Iteration 100/15000 | Loss: 3.456 | Time: 1.23s | LR: 0.00015", "Iteration 200/15000 | Loss: 3.2",
                       "Iteration 300/15000 | Loss: 1.2.3", "Iteration 400/15000 | Loss: 3 | LR: 1e-", "Loss: 3 Iteration 5/6",
                       "Iteration x | Loss: 3"])
    rows = runlog.parse_monitor_lines(df).orderBy("line_no").collect()
    assert [(r["iteration"], r["total"], r["loss"], r["time_per_iter"], r["lr"]) for r in rows] == [
        (100, 15000, 3.456, 1.23, 0.00015), (200, 15000, 3.2, None, None), (5, 6, 3.0, None, None)]


def test_event_lines(spark):
    df = lines(spark, ["✅ Best checkpoint saved: a/b.pt (Loss: 2.2340)", "📊 No improvement | Patience: 1/5 | Best Loss: 2.2340",
                       "Training stopped at iteration 6000/15000", "Best loss: 2.2340", "No improvement for 2500 iterations",
                       "--- Sample after iter 500 ---", "other"])
    rows = runlog.parse_events(df).orderBy("line_no").collect()
    assert [r["event"] for r in rows] == list(runlog.EVENT_LINES)
    assert rows[0]["path"] == "a/b.pt" and rows[0]["loss"] == 2.234
    assert (rows[1]["counter"], rows[1]["limit"], rows[1]["loss"]) == (1, 5, 2.234)
    assert (rows[2]["iteration"], rows[2]["limit"]) == (6000, 15000)
    assert rows[4]["idle_iterations"] == 2500 and rows[5]["iteration"] == 500


def test_dashboard_golden(spark):
    losses = [(1230, 2.8687, 1.21), (1231, 2.8621, 1.22), (1232, 2.8554, 1.24), (1233, 2.8502, 1.23), (1234, 2.8453, 1.23)]
    df = lines(spark, [f"Iteration {i}/15000 | Loss: {v} | Time: {t}s | LR: 1.48e-04" for i, v, t in losses])
    p = runlog.parse_monitor_lines(runlog.tail_lines(df))
    status = runlog.current_status(p)
    row = status.first()
    assert round(row["progress_pct"], 1) == 8.2 and round(row["ppl"], 2) == 17.21 and row["lr"] == 1.48e-4
    later = runlog.eta(status, F.lit("2026-03-06 18:30:45").cast("timestamp")).first()
    assert later["eta"] == "4.7h" and later["completion"] == "2026-03-06 23:12"
    change = runlog.loss_change(p).orderBy(F.desc("line_no")).first()
    assert round(change["change"], 4) == -0.0049 and change["trend"] == "down"
    assert runlog.recent_history(p).count() == 5
    assert runlog.recent_history(p.where("line_no > 0")).count() == 0


def test_eta_without_time(spark):
    df = runlog.parse_monitor_lines(lines(spark, ["Iteration 1/10 | Loss: 1", "Iteration 2/10 | Loss: 1 | Time: 0s"]))
    assert runlog.eta(runlog.current_status(df), F.lit("2026-01-01").cast("timestamp")).count() == 0


def test_tail(spark):
    df = lines(spark, [str(i) for i in range(250)])
    assert sorted(r["line_no"] for r in runlog.tail_lines(df).collect()) == list(range(150, 250))
    assert "WindowGroupLimit" in runlog.tail_lines(df)._jdf.queryExecution().executedPlan().toString()


def sparkline(values, width=20):
    if len(values) < 2 or max(values) == min(values):
        return "─" * width
    low, high = min(values), max(values)
    return "".join("▁▂▃▄▅▆▇█"[int((v - low) / (high - low) * 7)] for v in values[::max(1, len(values) // width)][:width])


@pytest.mark.parametrize("values, last, width", [
    ([5.0], 20, 20), ([2.0, 2.0], 20, 20), ([3.0, 1.0], 20, 20), (TIMELINE, 20, 20), ([float(i % 7) for i in range(60)], 20, 20),
    ([float(i % 11) for i in range(60)], 50, 20), ([float(i % 5) for i in range(60)], 30, 12)])
def test_sparkline(spark, values, last, width):
    df = points(spark, values)
    got = runlog.sparkline(df, "iteration", last, width).first()["sparkline"]
    assert got == sparkline(values[-last:], width)


def test_log_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for run, n in (("big", 5000), ("small", 3)):
        (tmp_path / "logs" / f"{run}.log").write_text("".join(f"{run} line {i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = logs.read_log(spark, str(tmp_path / "logs"))
        assert df.count() == 5003
        assert df.where("line <> concat(run, ' line ', line_no)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert logs.read_log(spark, str(tmp_path / "none")).count() == 0


def reference_stop(losses, step, rule):
    """Plain walk over one run; `step` is the log interval."""
    best, best_at, counter, history, out = float("inf"), None, 0, [], []
    for it in range(1, len(losses) * step + 1):
        if it % step == 0:
            history.append(losses[it // step - 1])
        if it % rule.checkpoint_interval == 0 and len(history) >= rule.patience:
            mean = 0.0
            for v in history[-rule.patience:]:
                mean += v
            mean /= rule.patience
            if mean < best - rule.min_delta:
                best, best_at, counter, better = mean, it, 0, True
            else:
                counter, better = counter + 1, False
            out.append((it, better, best_at, counter, counter >= rule.limit))
            if counter >= rule.limit:
                break
    return out


def outcome(df):
    rows = df.orderBy("iteration").collect()
    return [(r["iteration"], r["improved"], r["best_iteration"], r["counter"], r["stopped"]) for r in rows]


def test_documented_timeline(spark):
    rule = StopRule(checkpoint_interval=500, patience=1, limit=5, min_delta=0.01)
    rows = early_stop.early_stopping(points(spark, TIMELINE, 500), rule).orderBy("iteration").collect()
    assert [r["counter"] for r in rows] == [0] * 7 + [1, 2, 3, 4, 5]
    assert rows[-1]["stopped"] and rows[-1]["iteration"] == 6000
    assert rows[-1]["best_loss"] == 2.23 and rows[-1]["best_iteration"] == 3500


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("step, every", [(100, 100), (100, 500), (100, 250), (300, 100)])
def test_segments_do_not_change_the_outcome(spark, seed, step, every):
    rnd = random.Random(seed)
    losses = [4.0 - 0.03 * i + rnd.choice([0, 0.2, 0.5]) for i in range(60)] + [2.4] * 30
    rule = StopRule(checkpoint_interval=every, patience=3, limit=4, min_delta=0.02)
    want = reference_stop(losses, step, rule)
    df = points(spark, losses, step).unionByName(points(spark, losses[::-1], step, "other"))
    for size in (5, 1000):
        got = early_stop.early_stopping(df, rule, size=size)
        assert outcome(got.where("run = 'r'")) == want
        assert outcome(got.where("run = 'other'")) == reference_stop(losses[::-1], step, rule)


def test_too_few_points_and_no_improvement_at_all(spark):
    rule = StopRule(checkpoint_interval=100, patience=3, limit=2)
    assert early_stop.early_stopping(points(spark, [1, 2]), rule).count() == 0
    stuck = [float("inf")] * 8
    for size in (3, 1000):
        assert outcome(early_stop.early_stopping(points(spark, stuck), rule, size=size)) == [
            (300, False, None, 1, False), (400, False, None, 2, True)]


def test_best_checkpoint_and_savings(spark):
    rule = StopRule(checkpoint_interval=500, patience=1)
    evals = early_stop.early_stopping(points(spark, TIMELINE, 500), rule)
    runs = spark.createDataFrame([("r", 15000, 32), ("unlogged", 100, 1)], "run string, iterations long, n_layers int")
    best = early_stop.best_checkpoint(evals, runs).first()
    assert (best["iteration"], best["loss"], best["n_layers"]) == (3500, 2.23, 32)
    saved = {r["run"]: r for r in early_stop.early_stop_savings(evals, runs, rule).collect()}
    assert round(saved["r"]["saved_share"], 3) == 0.6 and saved["r"]["idle_iterations"] == 2500
    assert (saved["r"]["planned_cost"], saved["r"]["cost"]) == pytest.approx((50, 20))
    assert saved["unlogged"]["saved_share"] == 0


@pytest.mark.parametrize("size", [4, 1000])
def test_rolling_loss(spark, size):
    rows = early_stop.rolling_loss(points(spark, range(12)), 4, size=size).orderBy("iteration").collect()
    assert [r["recent_avg"] for r in rows] == [None] * 3 + [i - 1.5 for i in range(3, 12)]


def test_auto_step(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 7), ("a", 2, None), ("b", 3, None), ("a", 4, None)],
                               "run string, call_no long, step long")
    got = {r["call_no"]: r["step"] for r in metrics.auto_step(df).collect()}
    assert got == {0: 0, 1: 7, 2: 1, 3: 0, 4: 2}


def test_norms_and_histograms(spark):
    df = spark.createDataFrame([("w", [3.0, 0.0]), ("w", [4.0]), ("b", [1.0, 1.0])], "tag string, v array<float>")
    assert {r["tag"]: round(r["norm"], 6) for r in metrics.l2_norm(df, "v", ["tag"]).collect()} == {"w": 5.0, "b": 1.414214}
    rows = metrics.value_histograms(df, "v", ["tag"], bins=4).collect()
    assert {(r["tag"], r["bin"]): r["n"] for r in rows} == {("w", 0): 1, ("w", 3): 2, ("b", 0): 2}


def test_run_tables(spark):
    m = spark.createDataFrame([("a", "l", 1, 5.0), ("a", "l", 2, 4.0), ("b", "l", 1, 6.0), ("b", "x", 1, 9.0)],
                              "run string, tag string, step long, value double")
    wide = {r["step"]: (r["a"], r["b"]) for r in metrics.compare_runs(m, "l", ["a", "b"]).collect()}
    assert wide == {1: (5.0, 6.0), 2: (4.0, None)}
    runs = spark.createDataFrame([("a", 32, 2560), ("c", 6, 384)], "run string, n_layers int, d_model int")
    rows = {r["run"]: r for r in metrics.runs_with_config(m, runs).collect()}
    assert rows["a"]["name"] == "32L-2560d" and rows["a"]["last_value"] == 4.0 and rows["c"]["tag"] is None


def test_lr_audit_steps_once_per_accumulation(spark):
    runs = spark.createDataFrame([("r", 1.5e-4, 15000, 0.03, 0.1, 8)],
                                 "run string, lr double, iterations long, warmup_ratio double, min_lr_ratio double, grad_accum_steps int")
    p = spark.createDataFrame([("r", 3600, 1.5e-4), ("r", 1800, 7.5e-5)], "run string, iteration long, lr double")
    rows = {r["iteration"]: r for r in metrics.lr_audit(p, runs).collect()}
    assert rows[3600]["scheduler_step"] == 450 and rows[3600]["abs_diff"] < 1e-12 and rows[1800]["abs_diff"] < 1e-12


def test_user_schedule(spark):
    got = spark.range(4).select(apply_schedule("id", lambda s: 1 / (1 + s))).collect()
    assert [r[0] for r in got] == [1, 1 / 2, 1 / 3, 1 / 4]


def test_gpu_lines(spark):
    df = spark.createDataFrame([("97, 1, 2, 3, 4",), ("97, 1, 2, 3",), ("[N/A], 1, 2, 3, 4",), (" 9, 1, 2, 3, 4.5, x\n",), ("",),
                                ("97,1,2,3,4",)], "line string")
    rows = logs.read_telemetry(df).collect()
    assert [(r["gpu_util"], r["power"]) for r in rows] == [(97.0, 4.0), (9.0, 4.5)]


def test_cost_and_liveness(spark):
    start = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([("a", start), ("a", start + datetime.timedelta(hours=9)), ("b", start)], "run string, ts timestamp")
    cost = {r["run"]: r for r in telemetry.cost_tracking(df).collect()}
    assert cost["a"]["cost"] == pytest.approx(24.21) and cost["a"]["remaining_hours"] == 0
    assert cost["b"]["remaining_hours"] == 7 and cost["b"]["estimated_cost"] == pytest.approx(18.83)
    live = telemetry.run_liveness(df, F.lit(start + datetime.timedelta(hours=9, seconds=5)), 10)
    assert {r["run"]: r["status"] for r in live.collect()} == {"a": "TRAINING", "b": "STOPPED"}


def drain(stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")) \
        .trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_streamed_points(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"run{i}.log").write_text(f"Iteration {i}/9 | Loss: 1.{i}\nnoise\n")
    rows = drain(stream_logs.stream_log_points(spark, str(tmp_path / "in")), tmp_path).collect()
    assert sorted((r["run"], r["iteration"], r["loss"]) for r in rows) == [("run0", 0, 1.0), ("run1", 1, 1.1), ("run2", 2, 1.2)]


@pytest.mark.parametrize("step", [100, 300])
def test_streamed_stop_equals_batch(spark, tmp_path, step):
    rnd = random.Random(step)
    rule = StopRule(checkpoint_interval=200, patience=3, limit=4, min_delta=0.02)
    df = None
    for run in "abc":
        part = points(spark, [3 - 0.02 * i + rnd.choice([0, 0.1]) for i in range(40)] + [2.5] * 30, step, run)
        df = part if df is None else df.unionByName(part)
    for i in range(3):
        low, high = i * 25 * step, (i + 1) * 25 * step if i < 2 else 10**9
        df.where((F.col("iteration") > low) & (F.col("iteration") <= high)).orderBy(F.rand(i)).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(stream_stop.stream_early_stopping(files, rule), tmp_path).drop("late_points")
    want = early_stop.early_stopping(df, rule)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.where("stopped").count() == 3


def test_streamed_windows(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    rows = [("a", start + datetime.timedelta(seconds=s), 1.0 * s, 2.0, 3.0, 4.0 + s, 5.0) for s in range(120)]
    df = spark.createDataFrame(rows, "run string, ts timestamp, gpu_util double, mem_used double, mem_total double, temp double, power double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = drain(stream_gpu.stream_telemetry(files, "5 seconds", "10 seconds"), tmp_path)
    closed = stream_gpu.telemetry_windows(df).where(F.col("window_end") <= F.lit(start + datetime.timedelta(seconds=109)))
    assert sorted(map(str, got.collect())) == sorted(map(str, closed.collect())) and got.count() == 21


def test_streamed_totals(spark, tmp_path):
    df = spark.createDataFrame([(i, "en" if i % 3 else "fr", "é" * i) for i in range(30)], "doc_id long, lang string, text string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = stream_corpus.stream_token_totals(
        stream_corpus.stream_documents(spark, str(tmp_path / "in"), df.schema, 1), F.octet_length("text"), ["lang"])
    stream.writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {r["lang"]: (r["samples"], r["tokens"], r["chars"]) for r in spark.table("seen").collect()}
    assert got == {"fr": (9, 270, 135), "en": (20, 600, 300)}
