"""Results that must not depend on size, and stored corpora that cannot be misread."""

import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tokenloom import workflows
from tokenloom.catalog import corpus
from tokenloom.functions import codecs, numeric
from tokenloom.operators import early_stop, generate, layout, metrics, ngrams, stats
from tokenloom.sources import datasets, records


def test_a_run_without_a_name_is_walked_in_segments(spark):
    draw = random.Random(1)
    rows = [(run, i * 100, draw.random()) for run in (None, "a") for i in range(60)]
    points = spark.createDataFrame(rows, "run string, iteration long, loss double")
    rule = early_stop.StopRule(limit=8)
    whole, cut = (sorted(early_stop.early_stopping(points, rule, size=n).collect(), key=str) for n in (1000, 12))
    assert whole == cut and any(r.run is None for r in cut)


@pytest.mark.parametrize("max_rows", [1000, 1])
def test_cross_entropy_has_one_row_per_key(spark, max_rows):
    docs = spark.createDataFrame([(1, "abab"), (1, "ba"), (2, "aab"), (None, "ab"), (3, "x")], "k long, text string")
    counts = ngrams.fit_ngrams(docs, "text").cache()
    got = {r.k: (r.n_pairs, round(r.loss, 9)) for r in ngrams.cross_entropy(docs, "k", "text", counts, max_rows=max_rows).collect()}
    assert {k: n for k, (n, _) in got.items()} == {1: 4, 2: 2, None: 1}
    assert got[1][1] == round(sum(x.n_pairs * x.loss for x in ngrams.cross_entropy(
        docs.where("k = 1").withColumn("k", F.length("text").cast("long")), "k", "text", counts).collect()) / 4, 9)


def test_points_of_runs_without_settings_stay(spark):
    points = spark.createDataFrame([("a", 100, 5.0, 0.1), ("b", 100, 5.0, 0.1), (None, 100, 5.0, 0.1)],
                                   "run string, iteration long, elapsed double, lr double")
    runs = spark.createDataFrame([("a", 2, 3, 4, 0.5, 1000, 0.1, 0.1)], "run string, batch_size int, block_size int, "
                                 "grad_accum_steps int, lr double, iterations long, warmup_ratio double, min_lr_ratio double")
    assert {r.run: r.tokens_seen for r in stats.throughput(points, runs).collect()} == {"a": 600, "b": None, None: None}
    assert {r.run: r.scheduler_step for r in metrics.lr_audit(points, runs).collect()} == {"a": 25, "b": None, None: None}


def test_all_runs_are_compared_without_a_list(spark):
    rows = spark.createDataFrame([("a", "l", 1, 0.5), ("z", "l", 1, 0.25)], "run string, tag string, step long, value double")
    assert metrics.compare_runs(rows, "l").first().asDict() == {"step": 1, "a": 0.5, "z": 0.25}


@pytest.mark.parametrize("most", [1000, 0])
def test_an_empty_model_is_one_error(spark, most):
    prompts = spark.createDataFrame([(1, [1, 2])], "prompt_id int, ids array<int>")
    model = spark.createDataFrame([], "context long, tokens array<int>, cum array<double>")
    with pytest.raises(ValueError, match="empty"):
        generate.generate(prompts, model, max_new=2, max_candidates=most)


def test_suite_rows_keep_their_own_output(spark):
    docs = spark.createDataFrame([("the cat and the dog",)], "text string")
    model = generate.continuations(ngrams.fit_ngrams(docs, "text"))
    suite = spark.createDataFrame([("x", "the ", 5), ("x", "dog", 5), (None, "cat", 5), ("y", "", 5)],
                                  "name string, prompt string, max_tokens int")
    rows = generate.run_prompt_suite(suite, model, stop_id=None).collect()
    assert len(rows) == 4 and all(r.output.startswith(r.prompt) and r.error is None for r in rows if r.prompt)
    assert [r.error for r in rows if not r.prompt] == ["empty prompt"]


def test_starts_of_very_large_corpora(spark):
    room, ids = 10**14 - 512, [0, 1, 8_358_173_645, 9_000_000_000, 200_000_000_000]
    rows = spark.createDataFrame([(i,) for i in ids], "sample_id long").withColumn(
        "start", layout.repeatable_start(F.col("sample_id"), room)).collect()
    assert [r.start for r in rows] == [(i * 1103515245 + 12345) % room for i in ids]


def test_a_stored_corpus_knows_its_chunk_size(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} of many. ") for i in range(200)], "doc_id long, text string")
    path = str(tmp_path / "c")
    workflows.prepare(docs, ["doc_id"], path, "docs", chunk_size=64)
    whole = "".join(r.text for r in docs.orderBy("doc_id").collect())
    for r in workflows.inspect(spark, path, num_samples=6, sample_length=40)["samples"].collect():
        assert r.text == whole[r.range_start:r.range_end]
    drawn = workflows.batches(spark, path, steps=3, batch_size=2, block_size=30).collect()
    assert len(drawn) == 6 and all(bytes(r.x).decode() == whole[r.start:r.start + 30] for r in drawn)
    with pytest.raises(ValueError, match="64"):
        workflows.batches(spark, path, steps=1, batch_size=1, block_size=30, chunk_size=128)
    chunks, meta = datasets.read_token_dataset(spark, path)
    with pytest.raises(ValueError, match="name it"):
        datasets.stored_chunk_size(chunks, None)
    with pytest.raises(ValueError, match="not of 100"):
        datasets.stored_chunk_size(chunks, None, 100)
    starts = spark.createDataFrame([(0, 3)], "sample_id long, start long")
    with pytest.raises(Exception, match="lacks tokens"):
        layout.gather_windows(starts, chunks.where("chunk_id <> 0"), 64, 30).collect()


def test_unknown_splits_fail(spark, tmp_path):
    spark.range(3).selectExpr("id", "'train' AS split").write.partitionBy("split").parquet(str(tmp_path / "a"))
    spark.range(3).write.parquet(str(tmp_path / "b"))
    assert records.read_split(spark, str(tmp_path / "a")).count() == 3
    for path, split in (("a", "test"), ("b", "train")):
        with pytest.raises(ValueError, match="split"):
            records.read_split(spark, str(tmp_path / path), split=split)


def test_durations_round_half_to_even(spark):
    seconds = [0.5, 1.5, 2.5, 90.0, 150.0, 4140.0, 4500.0, 8100.0, 16932.0, 86400 * 1.25, 1e8]
    got = [r.d for r in spark.createDataFrame(list(enumerate(seconds)), "i int, s double").orderBy("i").select(
        numeric.format_duration("s").alias("d")).collect()]

    def plain(s):
        if s < 60:
            return f"{s:.0f}s"
        if s < 3600:
            return f"{s / 60:.0f}m"
        return f"{s / 3600:.1f}h" if s / 3600 < 24 else f"{s / 3600 / 24:.1f}d"

    assert got == [plain(s) for s in seconds]


def test_labels_escape_what_does_not_print(spark):
    texts = ["\x0b\x1b", "​", "a\\b\n\t", "é", "�", "it's", "x" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(
        codecs.token_label("i", F.col("t")).alias("label")).collect()
    assert [r.label for r in rows] == [repr(t)[1:-1][:20] for t in texts]


def test_bpe_equals_a_reference_encoder(spark):
    draw = random.Random(4)
    ranks = {bytes([b]): b for b in range(256)}
    tokens = list(ranks)
    for _ in range(3000):
        # Join two known tokens of a text, as merges are learned.
        a, b = (draw.choice([t for t in tokens[97:] if t in " then thing nothing é日本".encode()]) for _ in range(2))
        if len(a + b) <= 8 and a + b not in ranks and a + b in " then thing nothing é日本 thenothing anthe".encode():
            ranks[a + b] = len(ranks)
            tokens.append(a + b)
    assert len(ranks) > 290
    library = tiktoken.Encoding("t", pat_str=codecs.GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(draw.choices("thenothing é日本'sll  \n12!?", k=draw.randint(0, 80))) for _ in range(400)] + ["", "th" * 2000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("t", codecs.encode_bpe(spark, "t", ranks).alias("ids")).collect()
    assert all(r.ids == (None if r.t is None else library.encode_ordinary(r.t)) for r in rows)


def test_text_files_grow_in_number_with_the_text(spark, tmp_path, monkeypatch):
    """One outlying id, yet no file is large, and every file has its own digest."""
    rows = [(i, f"text {i} " * 20 + ("\r" if i % 3 else "")) for i in range(300)] + [(10**9, "far")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, read = [], records.read_text_files
    monkeypatch.setattr(records, "read_text_files", lambda *a: seen.append(read(*a)) or seen[-1])
    monkeypatch.setattr(corpus, "FILE_BYTES", 2000)
    got = {r.file: (r.chars, r.text_md5) for r in corpus.read_text_files(spark, str(tmp_path)).collect()}
    files, start = {}, 0
    for _, text in rows:
        files[start // 2000] = files.get(start // 2000, "") + text.rstrip("\r") + "\n"
        start += len(text) + 1
    assert got == {f: (len(t), hashlib.md5(t.encode()).hexdigest()) for f, t in files.items()}
    sizes = [len(r.text) for r in seen[0].collect()]
    assert len(sizes) == len(files) > start // 2500 and max(sizes) < 2500
