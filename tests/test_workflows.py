import pytest
from pyspark.sql import functions as F

from tokenloom import workflows
from tokenloom.catalog.inputs import TOY_RANKS
from tokenloom.operators.early_stop import StopRule
from tokenloom.sources.metrics import auto_run_name, generation_note

TEXTS = [f"the {i} thing in the nation" for i in range(40)] + ["", None]


def records(spark):
    return spark.createDataFrame([(i, None, t) for i, t in enumerate(TEXTS)], "id long, text string, func_code_string string")


def test_prepare_inspect_and_draw_bytes(spark, tmp_path):
    path = str(tmp_path / "d")
    workflows.prepare(records(spark), ["id"], path, "toy", chunk_size=32)
    stream = "".join(TEXTS[:40]).encode()
    found = workflows.inspect(spark, path, 4, 30, chunk_size=32)
    assert found["metadata"].first()["samples_processed"] == 40
    assert found["statistics"].first()["total_tokens"] == len(stream)
    for r in found["samples"].collect():
        assert r["text"].encode() == stream[r["range_start"]:r["range_end"]]
    drawn = workflows.batches(spark, path, 3, 4, 16, 2, seed=1, chunk_size=32).collect()
    assert len(drawn) == 12 and {r["step"] for r in drawn} == {0, 1, 2}
    assert all(bytes(r["x"])[1:] == bytes(r["y"])[:-1] for r in drawn)


def test_prepare_bpe_with_separator_and_limits(spark, tmp_path):
    path = str(tmp_path / "d")
    workflows.prepare(records(spark), ["id"], path, "toy", max_samples=3, ranks=TOY_RANKS, eos_id=999, chunk_size=16)
    found = workflows.inspect(spark, path, 2, 8, ranks={**TOY_RANKS, b"|": 999}, chunk_size=16)
    meta = found["metadata"].first()
    assert meta["samples_processed"] == 3 and meta["tokenizer"] == "tiktoken_gpt2"
    assert meta["total_tokens"] == found["statistics"].first()["total_tokens"]
    counts = {r["token_id"]: (r["n"], r["label"]) for r in found["frequency"].collect()}
    assert counts[999] == (3, "|") and counts[261] == (6, "the") and found["samples"].count() == 2
    with pytest.raises(Exception):
        workflows.prepare(records(spark), ["id"], path, "toy")


def test_monitor(spark, tmp_path):
    (tmp_path / "run.log").write_text("".join(
        f"Iteration {i * 100}/15000 | Loss: {3 if i > 20 else 5 - i / 10} | Time: 1.5s\n" for i in range(1, 151)))
    shown = workflows.monitor(spark, str(tmp_path), F.lit("2026-01-01").cast("timestamp"), StopRule())
    status = shown["status"].first()
    assert (status["iteration"], status["progress_pct"]) == (15000, 100.0)
    assert shown["eta"].first()["eta"] == "0s" and shown["history"].count() == 5
    assert shown["trend"].first()["sparkline"] == "─" * 20 and shown["change"].count() == 99
    end = shown["early_stopping"].orderBy(F.desc("iteration")).first()
    assert end["stopped"] and end["counter"] == 5 and end["best_iteration"] == 3000


def test_notes(spark):
    row = spark.sql("SELECT 'a' p, 'b' g, timestamp'2026-01-02 03:04:05' t").select(
        generation_note("p", "g"), auto_run_name("t")).first()
    assert row[0] == "**Prompt:** a\n\n**Generated:**\n```python\nb\n```" and row[1] == "run_20260102_030405"
