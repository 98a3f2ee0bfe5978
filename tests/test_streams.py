"""Streams over input that grows, moves and arrives out of order."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import early_stop
from tokenloom.operators.early_stop import StopRule
from tokenloom.sources import logs
from tokenloom.streaming import early_stop as stream_stop
from tokenloom.streaming import tail
from tokenloom.streaming.logs import stream_log_points


class Follower:
    """A stream that is started again for every look at the folder."""

    def __init__(self, spark, tmp_path, make):
        self.spark, self.make, self.seen = spark, make, 0
        self.out, self.state = str(tmp_path / "out"), str(tmp_path / "state")

    def new(self):
        """Rows that this start added."""
        stream = self.make()
        stream.writeStream.format("parquet").option("checkpointLocation", self.state).trigger(availableNow=True) \
            .start(self.out).awaitTermination()
        rows = self.spark.read.schema(stream.schema).parquet(self.out).select("*", F.col("_metadata.file_path").alias("f")).collect()
        fresh = [r for r in rows if r.f not in getattr(self, "files", set())]
        self.files = {r.f for r in rows}
        return sorted((tuple(r)[:-1] for r in fresh), key=str)


@pytest.fixture
def followed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    return folder, Follower(spark, tmp_path, lambda: tail.stream_lines(spark, str(folder), block_bytes=16))


def lines(rows):
    return sorted((run, position, line) for run, _, position, line in rows)


def test_appended_lines_are_seen_once(followed):
    folder, stream = followed
    log = folder / "a.log"
    log.write_text("first\nsecond line that is longer than a block\nno end")
    assert lines(stream.new()) == [("a", 0, "first"), ("a", 6, "second line that is longer than a block")]
    assert stream.new() == []
    with log.open("a") as out:
        out.write(" yet\r\nthird\n\nrest")
    (folder / "b").mkdir()
    (folder / "b" / "a.log").write_text("other file of that name é\n")
    assert lines(stream.new()) == [("a", 46, "no end yet"), ("a", 58, "third"), ("a", 64, ""), ("b/a", 0, "other file of that name é")]
    with log.open("a") as out:
        out.write("\n")
    assert lines(stream.new()) == [("a", 65, "rest")]


def test_a_replaced_file_is_read_from_its_start(followed):
    folder, stream = followed
    log = folder / "a.log"
    log.write_text("one\ntwo\n")
    assert len(stream.new()) == 2
    log.write_text("new\n")
    assert lines(stream.new()) == [("a", 0, "new")]
    log.write_text("as\nlong\nand longer\n")
    assert [r[2] for r in lines(stream.new())] == ["as", "long", "and longer"]


def test_a_renamed_file_is_read_on(followed):
    folder, stream = followed
    log = folder / "a.log"
    log.write_text("one\ntwo\n")
    assert len(stream.new()) == 2
    with log.open("a") as out:
        out.write("three\n")
    log.rename(folder / "a.log.1")
    log.write_text("fresh\n")
    assert lines(stream.new()) == [("a", 0, "fresh"), ("a", 8, "three")]


def test_blocks_give_every_line_once(spark, tmp_path):
    rnd = random.Random(3)
    text = "".join("x" * rnd.choice([0, 1, 5, 40]) + "\n" for _ in range(300))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(text)
    for size in (7, 64, 10**6):
        stream = Follower(spark, tmp_path / str(size), lambda: tail.stream_lines(spark, str(tmp_path / "in"), size))
        rows = lines(stream.new())
        assert [r[2] for r in rows] == text.split("\n")[:-1]
        assert all(text[p:p + len(line)] == line for _, p, line in rows)


def test_hidden_files_and_no_folder(spark, tmp_path):
    stream = Follower(spark, tmp_path, lambda: tail.stream_lines(spark, "file:" + str(tmp_path / "in")))
    assert stream.new() == []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "_SUCCESS").write_text("x\n")
    (tmp_path / "in" / "x y+z.log").write_text("line\n")
    assert lines(stream.new()) == [("x y+z", 0, "line")]


def test_points_of_a_growing_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "r.log"
    stream = Follower(spark, tmp_path, lambda: stream_log_points(spark, str(tmp_path / "in")).select("run", "iteration", "loss"))
    log.write_text("Iteration 1/9 | Loss: 1.5\nnoise\nIteration 2/9 | Lo")
    assert stream.new() == [("r", 1, 1.5)]
    with log.open("a") as out:
        out.write("ss: 1.25\n")
    assert stream.new() == [("r", 2, 1.25)]


def test_logs_of_one_name_are_different_runs(spark, tmp_path):
    for folder in ("a", "b c+d"):
        (tmp_path / "logs" / folder).mkdir(parents=True)
        (tmp_path / "logs" / folder / "train.log").write_text(f"line of {folder}\nsecond\n")
    for path in (str(tmp_path / "logs"), "file://" + str(tmp_path / "logs"), str(tmp_path / "logs") + "/*/"):
        rows = {tuple(r) for r in logs.read_log(spark, path).collect()}
        assert rows == {("a/train", 0, "line of a"), ("a/train", 1, "second"), ("b c+d/train", 0, "line of b c+d"), ("b c+d/train", 1, "second")}
    assert {r.run for r in logs.read_log(spark, str(tmp_path / "logs" / "a" / "train.log")).collect()} == {"train"}


RULE = StopRule(checkpoint_interval=200, patience=3, limit=4, min_delta=0.02)


def shuffled(spark, folder, rows, files, seed=0):
    """Rows dealt at random over files of their own."""
    rnd = random.Random(seed)
    for i in range(files):
        part = [r for k, r in enumerate(rows) if rnd.random() * (files - i) < 1 and not r[3]]
        for r in part:
            r[3] = True
        spark.createDataFrame([r[:3] for r in part] or [["none", None, None]], "run string, iteration long, loss double") \
            .coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)


def run_rows(seed=5, n=60):
    rnd = random.Random(seed)
    return [[run, 100 * (i + 1), 3 - 0.02 * min(i, 35) + rnd.choice([0, 0.1]), False] for run in "abc" for i in range(n)]


def stopped_stream(spark, tmp_path, folder, arrival, per_trigger=1, **more):
    files = spark.readStream.schema("run string, iteration long, loss double").option("maxFilesPerTrigger", per_trigger).parquet(folder)
    stream = stream_stop.stream_early_stopping(files, RULE, arrival, **more)
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True) \
        .start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_shuffled_files_stop_as_the_table_does(spark, tmp_path):
    rows = run_rows()
    table = spark.createDataFrame([r[:3] for r in rows], "run string, iteration long, loss double")
    folder = str(tmp_path / "in")
    shuffled(spark, folder, rows, 5)
    got = stopped_stream(spark, tmp_path, folder, stream_stop.Arrival(log_interval=100, first=100))
    want = early_stop.early_stopping(table, RULE).withColumn("late_points", F.lit(0).cast("bigint"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.where("stopped").count() == 3 and want.count() > 20


def test_a_gap_is_given_up_beyond_the_horizon_and_late_points_are_counted(spark, tmp_path):
    rows = [[r[0], r[1], r[2], False] for r in run_rows() if r[0] == "a"]
    missing = rows.pop(4)
    folder = str(tmp_path / "in")
    one = "run string, iteration long, loss double"
    spark.createDataFrame([r[:3] for r in reversed(rows)], one).coalesce(1).write.parquet(folder)
    arrival = stream_stop.Arrival(log_interval=100, first=100, horizon=1000)
    got = stopped_stream(spark, tmp_path, folder, arrival, report_late=True)
    table = spark.createDataFrame([r[:3] for r in rows], one)
    want = early_stop.early_stopping(table, RULE)
    seen = got.drop("late_points").collect()
    # The last points are within the horizon of the furthest; regular ones wait for nothing.
    assert sorted(map(str, seen)) == sorted(map(str, want.collect()))
    spark.createDataFrame([missing[:3], rows[0][:3]], one).coalesce(1).write.mode("append").parquet(folder)
    if not want.where("stopped").count():
        again = stopped_stream(spark, tmp_path, folder, arrival, report_late=True)
        assert again.where("recent_avg is null").agg(F.max("late_points")).first()[0] == 2


def test_late_points_are_rows_on_request(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in ([("a", 200, 1.0), ("a", 300, 1.0)], [("a", 100, 1.0), ("a", 300, 2.0), ("a", 400, 1.0)], [("a", 500, 1.0)]):
        spark.createDataFrame(part, "run string, iteration long, loss double").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.1)
    rows = stopped_stream(spark, tmp_path, folder, stream_stop.Arrival(), report_late=True).orderBy("iteration", "late_points").collect()
    assert [(r.iteration, r.late_points) for r in rows if r.recent_avg is None] == [(100, 1), (300, 2)]
    assert [(r.iteration, r.recent_avg, r.late_points) for r in rows if r.recent_avg is not None] == [(400, 1.0, 2)]


def test_idle_runs_give_up_waiting(spark, tmp_path):
    """Timers fire while the query runs, so this one is not an ``availableNow`` run."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    one = "run string, iteration long, loss double"
    spark.createDataFrame([("a", i, 1.0) for i in (100, 300, 400, 600)], one).coalesce(1).write.parquet(folder)
    arrival = stream_stop.Arrival(log_interval=100, first=100, idle_ms=100)
    stream = stream_stop.stream_early_stopping(spark.readStream.schema(one).parquet(folder), RULE, arrival)
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
             .trigger(processingTime="1 second").start(out))
    try:
        end, rows = time.time() + 60, []
        while time.time() < end and len(rows) < 2:
            time.sleep(1)
            rows = spark.read.schema(stream.schema).parquet(out).orderBy("iteration").collect() if (tmp_path / "out").exists() else []
    finally:
        query.stop()
    assert [(r.iteration, r.counter) for r in rows] == [(400, 0), (600, 1)]
