"""Training-log lines to points and events, and the figures of a live monitor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.numeric import format_duration, perplexity
from tokenloom.plans.ordered import SEGMENT_ROWS, own_rows, reach_partition, reach_windows
from tokenloom.session import written

# What the trainer prints, what the monitor looks for, and the glyphs and
# window lengths of the monitor.
TRAIN_LINE = (r"^Iter\s+(\d+)/(\d+) \| Loss: (\d+\.?\d*|nan|inf) \| PPL: ([\d.]+|nan|inf) "
              r"\| LR: ([\d.e+-]+) \| ([\d,]+) tok/s")
MONITOR_ITERATION = r"Iteration (\d+)/(\d+)"
MONITOR_LOSS = r"Loss: ([\d.]+)"
MONITOR_TIME = r"Time: ([\d.]+)s"
MONITOR_LR = r"LR: ([\d.e-]+)"
EVENT_LINES = {
    "best_checkpoint": r"Best checkpoint saved: (.*) \(Loss: ([\d.]+)\)",
    "no_improvement": r"No improvement \| Patience: (\d+)/(\d+) \| Best Loss: ([\d.]+)",
    "stopped": r"Training stopped at iteration (\d+)/(\d+)",
    "best_loss": r"^Best loss: ([\d.]+)",
    "idle": r"No improvement for (\d+) iterations",
    "sample": r"^--- Sample after iter (\d+) ---",
}
SPARK_BLOCKS = "▁▂▃▄▅▆▇█"
SPARK_FLAT = "─"
TAIL_LINES, TREND_POINTS, SPARK_WIDTH, HISTORY_POINTS = 100, 20, 20, 5


def _part(pattern: str, group: int, column: str = "line") -> Column:
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def _number(text: Column, kind: str = "double") -> Column:
    return text.try_cast(kind)


def parse_train_lines(lines: DataFrame) -> DataFrame:
    """Points from the trainer's own progress lines.

    One replacement turns a matching line into its six fields; the regular expression is
    not run again for every field.
    """
    fields = F.split(F.regexp_replace("line", TRAIN_LINE + ".*$", "$1 $2 $3 $4 $5 $6"), " ")
    get = {name: F.get("_fields", F.lit(i)) for i, name in enumerate(
        ("iteration", "total", "loss", "ppl", "lr", "tok"))}
    return (lines.where(F.col("line").rlike(TRAIN_LINE))
            .select("run", "line_no", fields.alias("_fields"))
            .select("run", "line_no",
                    _number(get["iteration"], "bigint").alias("iteration"),
                    _number(get["total"], "bigint").alias("total"),
                    _number(get["loss"]).alias("loss"), _number(get["ppl"]).alias("ppl"),
                    _number(get["lr"]).alias("lr"), F.lit(None).cast("double").alias("time_per_iter"),
                    _number(F.replace(get["tok"], F.lit(","), F.lit("")), "bigint").alias("tok_per_s")))


def parse_monitor_lines(lines: DataFrame) -> DataFrame:
    """Points from lines that name an iteration and a loss; time and rate are optional.

    A number that is present but malformed voids the line.
    """
    time, lr = _part(MONITOR_TIME, 1), _part(MONITOR_LR, 1)
    parsed = (lines.where(F.col("line").rlike(MONITOR_ITERATION) & F.col("line").rlike(MONITOR_LOSS))
              .select("run", "line_no",
                      _number(_part(MONITOR_ITERATION, 1), "bigint").alias("iteration"),
                      _number(_part(MONITOR_ITERATION, 2), "bigint").alias("total"),
                      _number(_part(MONITOR_LOSS, 1)).alias("loss"),
                      F.lit(None).cast("double").alias("ppl"), _number(lr).alias("lr"),
                      _number(time).alias("time_per_iter"),
                      F.lit(None).cast("bigint").alias("tok_per_s"),
                      time.alias("_time"), lr.alias("_lr")))
    sound = (F.col("iteration").isNotNull() & F.col("total").isNotNull() & F.col("loss").isNotNull()
             & (F.col("_time").isNull() | F.col("time_per_iter").isNotNull())
             & (F.col("_lr").isNull() | F.col("lr").isNotNull()))
    return parsed.where(sound).drop("_time", "_lr")


def parse_points(lines: DataFrame) -> DataFrame:
    """Both grammars as one table."""
    return parse_train_lines(lines).unionByName(parse_monitor_lines(lines))


def parse_events(lines: DataFrame) -> DataFrame:
    """Checkpoint, patience, stop and sample lines as typed rows."""
    p = EVENT_LINES
    event = F.lit(None).cast("string")
    for name, pattern in reversed(p.items()):
        event = F.when(F.col("line").rlike(pattern), name).otherwise(event)
    whole = {name: _part(p[name], 1).try_cast("bigint") for name in ("no_improvement", "stopped", "idle", "sample")}
    return (lines.withColumn("event", event).where(F.col("event").isNotNull())
            .select(
                "run", "line_no", "event",
                F.coalesce(whole["stopped"], whole["sample"]).alias("iteration"),
                F.coalesce(_part(p["best_checkpoint"], 2), _part(p["no_improvement"], 3),
                           _part(p["best_loss"], 1)).try_cast("double").alias("loss"),
                whole["no_improvement"].alias("counter"),
                F.coalesce(_part(p["no_improvement"], 2), _part(p["stopped"], 2)).try_cast("bigint").alias("limit"),
                whole["idle"].alias("idle_iterations"),
                _part(p["best_checkpoint"], 1).alias("path")))


def tail_lines(lines: DataFrame, n: int = TAIL_LINES, order: str = "line_no") -> DataFrame:
    """The last ``n`` rows of each run; every map task keeps at most ``n`` per run."""
    latest = Window.partitionBy("run").orderBy(F.desc(order))
    return (lines.withColumn("_rank", F.row_number().over(latest))
            .where(F.col("_rank") <= n).drop("_rank"))


def current_status(points: DataFrame, order: str = "line_no") -> DataFrame:
    """Latest point of each run with progress and the monitor's perplexity."""
    latest = F.max_by(F.struct("iteration", "total", "loss", "lr", "time_per_iter"), order).alias("p")
    return (points.groupBy("run").agg(latest).select("run", "p.*")
            .withColumns({"progress_pct": F.try_divide(F.col("iteration"), F.col("total")) * 100,
                          "ppl_base2": perplexity("loss", base=2), "ppl": perplexity("loss")}))


def loss_change(points: DataFrame, order: str = "line_no", size: int = SEGMENT_ROWS) -> DataFrame:
    """Difference to the previous point; the trend is up only for a positive difference."""
    # Stored, because counting, numbering and the window each read the points, whatever made them.
    stored = written(points.select(*dict.fromkeys(["run", order, "iteration", "loss"])), "points")
    laid = reach_windows(stored, ["run"], [order], before=1, size=size)
    previous = F.lag("loss").over(Window.partitionBy(*reach_partition(["run"])).orderBy(order))
    changed = own_rows(laid.withColumn("change", F.col("loss") - previous))
    return (changed.where(F.col("change").isNotNull())
            .withColumn("trend", F.when(F.col("change") > 0, "up").otherwise("down")))


def sparkline(points: DataFrame, order: str = "line_no", last: int = TREND_POINTS,
              width: int = SPARK_WIDTH) -> DataFrame:
    """The latest losses of each run as a line of eight block heights."""
    recent = tail_lines(points.select("run", order, "loss"), last, order)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct(order, "loss"))), lambda s: s["loss"])
    listed = recent.groupBy("run").agg(in_order.alias("v"))
    n, low, high = F.size("v"), F.array_min("v"), F.array_max("v")
    stride = F.greatest(F.lit(1), F.floor(n / width).cast("int"))
    picked = F.slice(F.filter("v", lambda x, i: i % stride == 0), 1, width)
    top = len(SPARK_BLOCKS) - 1

    def block(x: Column) -> Column:
        return F.substring(F.lit(SPARK_BLOCKS), ((x - low) / (high - low) * top).cast("int") + 1, F.lit(1))

    drawn = F.array_join(F.transform(picked, block), "")
    return listed.select("run", F.when((n < 2) | (high == low), SPARK_FLAT * width)
                         .otherwise(drawn).alias("sparkline"))


def eta(status: DataFrame, now: Column) -> DataFrame:
    """Remaining seconds and completion time of runs that report a time per iteration."""
    seconds = (F.col("total") - F.col("iteration")) * F.col("time_per_iter")
    return (status.where(F.coalesce(F.col("time_per_iter") != 0, F.lit(False)))
            .withColumn("eta_seconds", seconds)
            .withColumns({"eta": format_duration("eta_seconds"),
                          "completion": F.date_format(
                              F.timestamp_millis(F.unix_millis(now) + (F.col("eta_seconds") * 1000).cast("bigint")),
                              "yyyy-MM-dd HH:mm")}))


def recent_history(points: DataFrame, order: str = "line_no", n: int = HISTORY_POINTS) -> DataFrame:
    """The last five points of runs that have that many; a missing time shows as N/A."""
    recent = tail_lines(points.select("run", order, "iteration", "loss", "time_per_iter"), n, order)
    enough = F.count("*").over(Window.partitionBy("run")) >= n
    shown = F.when(F.coalesce(F.col("time_per_iter") != 0, F.lit(False)),
                   F.format_string("%.2fs", "time_per_iter")).otherwise("N/A")
    return (recent.withColumn("_enough", enough).where("_enough").drop("_enough")
            .withColumn("time_text", shown))
