import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import codecs
from tokenloom.operators import budgets, layout, stats
from tokenloom.sources import datasets, metrics, records
from tokenloom.session import shared_folder


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def kept(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize("budget, want", [(0, [1]), (1, [1]), (3, [1]), (4, [1, 2]), (7, [1, 2, 3]), (None, [1, 2, 3, 5])])
def test_budget_keeps_the_crossing_document(spark, budget, want):
    df = docs(spark, ["", "abc", "def", "é", None, "zz"])
    assert kept(budgets.take_budget(df, ["doc_id"], budget)) == want


def test_budget_unit_follows_the_tokenizer(spark):
    df = docs(spark, ["éé", "ab", "cd"])
    assert kept(budgets.take_budget(df, ["doc_id"], 4)) == [0]
    assert kept(budgets.take_budget(df, ["doc_id"], 4, kind="tiktoken_gpt2")) == [0, 1]


@pytest.mark.parametrize("n, want", [(0, [1, 3, 4]), (None, [1, 3, 4]), (2, [1, 3]), (9, [1, 3, 4])])
def test_sample_limit_counts_processed_rows(spark, n, want, monkeypatch):
    df = docs(spark, ["", "a", None, "b", "c"])
    assert kept(budgets.take_samples(df, ["doc_id"], n)) == want
    monkeypatch.setattr(budgets, "TOP_K_ROWS", 0)
    assert kept(budgets.take_samples(df, ["doc_id"], n)) == want


def test_progress_skips_empty_rows(spark):
    df = docs(spark, ["a", "bb", "", "", "eee", "f"])
    got = budgets.progress_points(df, ["doc_id"], F.octet_length("text"), every=2).collect()
    assert sorted(map(tuple, got)) == [(2, 3), (6, 7)]


def test_crop(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), ([1],)], "ids array<int>")
    assert [r[0] for r in df.select(budgets.crop_context("ids", 2)).collect()] == [[2, 3], [], [1]]


def test_counts_on_text_and_ids_agree(spark):
    df = docs(spark, ["abca", "", None, "éb"])
    text = stats.token_counts(df, "text", 150)
    ids = stats.token_counts(df.select(codecs.encode_bytes("text", 150).alias("ids")), "ids")
    want = [(97, 2), (98, 2), (99, 1), (149, 2)]
    assert sorted(map(tuple, text.collect())) == sorted(map(tuple, ids.collect())) == want
    assert tuple(stats.token_stats(text).first()) == (7, 97, 149, 4)
    top = stats.token_frequency(text, 2).collect()
    assert [(r["token_id"], round(r["pct"], 3), r["label"]) for r in top] == [
        (97, 28.571, "<token_97>"), (98, 28.571, "<token_98>")]


def test_empty_corpus_totals(spark):
    row = stats.corpus_totals(docs(spark, ["x"]).where("false"), F.octet_length("text")).first()
    assert row["samples"] == 0 and row["avg_tokens"] is None


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk", [1, 4, 16])
def test_chunks_are_slices_of_the_stream(spark, seed, chunk):
    rnd = random.Random(seed)
    # One-token documents, documents over several chunks, documents ending on a border.
    texts = ["".join(rnd.choice("abcé") for _ in range(rnd.choice([0, 1, 2, 4, 16, 70]))) for _ in range(60)]
    stream = list("".join(texts).encode())
    df = docs(spark, texts)
    by_bytes = {r["chunk_id"]: r["ids"] for r in layout.byte_chunks(df, chunk, ["doc_id"]).collect()}
    arrays = df.select("doc_id", codecs.encode_bytes("text").alias("ids"))
    by_ids = {r["chunk_id"]: r["ids"] for r in layout.chunk_layout(arrays, chunk, ["doc_id"]).collect()}
    want = {i // chunk: stream[i:i + chunk] for i in range(0, len(stream), chunk)}
    assert by_bytes == want and by_ids == want


def test_one_document_larger_than_everything(spark):
    df = docs(spark, ["a" * 10, "b" * 5000, "c"])
    got = {r["chunk_id"]: bytes(r["ids"]) for r in layout.byte_chunks(df, 64, ["doc_id"]).collect()}
    assert b"".join(got[i] for i in sorted(got)) == b"a" * 10 + b"b" * 5000 + b"c"


@pytest.mark.parametrize("block", [1, 5, 8])
def test_windows_are_slices_of_the_stream(spark, block):
    rnd = random.Random(block)
    texts = ["".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 30))) for _ in range(20)]
    stream = list("".join(texts).encode())
    chunks = layout.byte_chunks(docs(spark, texts), 8, ["doc_id"])
    last = len(stream) - block - 1
    starts = spark.createDataFrame([(i, s) for i, s in enumerate([0, last, *(rnd.randint(0, last) for _ in range(40))])],
                                   "sample_id long, start long")
    rows = layout.gather_windows(starts, chunks, 8, block).collect()
    assert len(rows) == 42
    for r in rows:
        i = r["start"]
        assert r["x"] == stream[i:i + block] and r["y"] == stream[i + 1:i + block + 1]


def test_starts(spark):
    got = [r["start"] for r in layout.sample_starts(spark, 500, 20, 5).collect()]
    assert min(got) >= 0 and max(got) <= 14
    seeded = [r["start"] for r in layout.sample_starts(spark, 500, 20, 5, seed=3).collect()]
    assert set(seeded) == set(range(15))
    for total in (5, 4):
        with pytest.raises(ValueError):
            layout.sample_starts(spark, 1, total, 5)
    with pytest.raises(ValueError):
        layout.gather_tokens(layout.sample_starts(spark, 1, 50, 20), None, 8, 21)


def test_batches(spark):
    windows = spark.range(12).withColumnRenamed("id", "sample_id")
    rows = layout.make_batches(windows, 2, 3).orderBy("sample_id").collect()
    assert [r["step"] for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [r["optimizer_step"] for r in rows] == [0] * 6 + [1] * 6
    assert [r["updates"] for r in rows][::2] == [False, False, True, False, False, True]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz\xff")
    rows = records.read_text_files(spark, str(tmp_path)).collect()
    assert rows[0]["text"] == "x\ny\nz�"
    assert records.read_text_files(spark, str(tmp_path), 2).first()["text"] == "x\n"


def test_synthetic_corpus(spark):
    df = records.synthetic_corpus(spark, 1000)
    assert stats.token_stats(stats.token_counts(df, "text")).first()["total_tokens"] == 62_000


def test_split_reads_only_its_partition(spark, tmp_path):
    path = str(tmp_path / "ds")
    spark.range(20).selectExpr("id", "if(id % 2 = 0, 'python', 'go') config", "if(id < 15, 'train', 'test') split") \
        .write.partitionBy("config", "split").parquet(path)
    df = records.read_split(spark, path, "python")
    assert sorted(r["id"] for r in df.collect()) == list(range(0, 15, 2))
    assert "PartitionFilters: [isnotnull(config" in df._jdf.queryExecution().executedPlan().toString()


def test_dataset_with_and_without_metadata(spark, tmp_path):
    df = docs(spark, ["abcdef", "gh"])
    chunks = layout.byte_chunks(df, 4, ["doc_id"])
    meta = datasets.dataset_metadata(df, F.octet_length("text"), "d", kind="byte")
    datasets.write_token_dataset(chunks, meta, str(tmp_path / "a"))
    datasets.write_token_dataset(chunks, None, str(tmp_path / "b"))
    chunks.write.parquet(str(tmp_path / "bare"))
    back, info = datasets.read_token_dataset(spark, str(tmp_path / "a"))
    assert layout.stream_length(back) == 8
    assert (info.first()["total_tokens"], info.first()["tokenizer"], info.first()["config"]) == (8, "byte_level", None)
    assert datasets.read_token_dataset(spark, str(tmp_path / "b"))[1] is None
    assert datasets.read_token_dataset(spark, str(tmp_path / "bare"))[0].count() == 2
    assert datasets.dataset_size(spark, str(tmp_path / "bare")).first()["bytes"] > 0


def test_file_metadata(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hé")
    row = datasets.file_metadata(records.read_text_files(spark, str(tmp_path)), F.octet_length("text"), 256, "byte").first()
    assert (row["total_tokens"], row["total_chars"], row["tokenizer"]) == (3, 2, "byte_level")


def test_appended_metrics_and_samples(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, {"a": 1.0, "b": 2.0})], "run string, step long, metrics map<string,double>")
    for _ in range(2):
        metrics.append_metrics(metrics.explode_metrics(df), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    made = spark.createDataFrame([("r", 1, "p", "x" * 600), ("r", 2, "p", "y" * 256)],
                                 "run string, step long, prompt string, generated string")
    rows = metrics.shape_samples(made).orderBy("step").collect()
    assert len(rows[0]["generated"]) == 512 and rows[0]["display"] == "x" * 256 + "..."
    assert rows[1]["display"] == "y" * 256


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
