import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tokenloom import workflows
from tokenloom.functions import codecs
from tokenloom.operators import budgets, layout, stats
from tokenloom.sources import datasets

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_public_vocabulary_equals_the_library(spark):
    ranks = codecs.read_ranks(spark, RANKS)
    assert ranks == codecs.load_ranks(RANKS) == {
        base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb") if line.strip())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["", " ", "Hello  world\n\n don't", "naïve 你好 \U0001F600", "x" * 3000, None,
             *["".join(rnd.choice("aeiou nrst.,'1é好\n\t") for _ in range(300)) for _ in range(60)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    ids = df.select("i", codecs.encode_bpe(spark, "t", ranks).alias("ids"))
    got = {r.i: r.ids for r in ids.collect()}
    assert got == {i: None if t is None else library.encode_ordinary(t) for i, t in enumerate(texts)}
    back = {r.i: r.t for r in ids.where("ids is not null").select("i", codecs.decode_bpe(spark, "ids", ranks).alias("t")).collect()}
    assert back == {i: t for i, t in enumerate(texts) if t is not None}


def test_the_table_of_pieces_is_bounded(monkeypatch):
    pieces = codecs._Pieces({bytes([b]): b for b in range(256)} | {b"ab": 256}, codecs.GPT2_PATTERN)
    monkeypatch.setattr(codecs._Pieces, "LIMIT", 50)
    for k in range(6):
        texts = [f"w{k}x{i} ab" for i in range(30)] + [None, ""]
        sizes, ids = pieces.batch(texts)
        assert sizes.tolist()[-2:] == [0, 0] and sizes.sum() == len(ids)
        assert ids[:sizes[0]].tolist() == [*f"w{k}x0 ".encode(), 256]
        assert len(pieces.number) < 150


def test_vocabularies_take_each_others_place(spark):
    df = spark.createDataFrame([("ab",)], "t string")
    plain = {bytes([b]): b for b in range(256)}
    for extra, want in (({}, [97, 98]), ({b"ab": 300}, [300]), ({b"ab": 301}, [301])):
        assert df.select(codecs.encode_bpe(spark, "t", plain | extra)).first()[0] == want


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A corpus of 4,000 chunks in small row groups."""
    path = str(tmp_path_factory.mktemp("corpus") / "tokens")
    chunks = spark.range(4000).select(F.col("id").alias("chunk_id"), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("id") * 64 + i).cast("int")).alias("ids"))
    held = datasets.ROW_GROUP_BYTES
    datasets.ROW_GROUP_BYTES = 16 << 10
    try:
        datasets.write_token_dataset(chunks, None, path, chunk_size=64)
    finally:
        datasets.ROW_GROUP_BYTES = held
    return spark.read.parquet(path + "/tokens")


def scanned_rows(df):
    """Rows that the scans of an executed plan put out."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_few_windows_read_few_chunks(spark, stored):
    assert layout.stream_length(stored) == 256_000 and datasets.stored_chunk_size(stored, None, 64) == 64
    starts = layout.sample_starts(spark, 5, 256_000, 64)
    found = layout.gather_tokens(starts, stored, 64, 64)
    assert all(r.ids == list(range(r.start, r.start + 64)) for r in found.collect())
    assert 0 < scanned_rows(found) < 800
    many = layout.gather_tokens(layout.sample_starts(spark, 3000, 256_000, 64, seed=1), stored, 64, 64)
    assert all(r.ids == list(range(r.start, r.start + 64)) for r in many.collect())


def test_sizes_are_known_without_ids(spark, stored):
    read = stored.agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in read.split("ReadSchema")[1]


def test_a_window_without_its_chunk_is_an_error(spark, stored):
    starts = spark.createDataFrame([(0, 640), (1, 6400)], "sample_id long, start long")
    with pytest.raises(Exception, match="sample 1 lacks tokens"):
        layout.gather_tokens(starts, stored.where("chunk_id <> 100"), 64, 64).collect()


def test_windows_of_bytes(spark):
    docs = spark.createDataFrame([(i, "é" * i + "x") for i in range(40)], "k long, t string")
    full = "".join("é" * i + "x" for i in range(40)).encode()
    chunks = layout.octet_chunks(docs, 32, ["k"], "t")
    starts = layout.sample_starts(spark, 20, len(full), 32, seed=3)
    for r in layout.gather_windows(starts, chunks, 32, 32, "octets").collect():
        assert bytes(r.x) == full[r.start:r.start + 32] and bytes(r.y) == full[r.start + 1:r.start + 33]


@pytest.mark.parametrize("limit", [0, 10_000])
def test_samples_by_their_last_key(spark, monkeypatch, limit):
    monkeypatch.setattr(budgets, "TOP_K_ROWS", limit)
    rows = [(None if i % 10 == 0 else f"k{i % 7}", i if i % 4 else None, "t" if i % 5 else "") for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b int, text string").repartition(5)
    order = sorted((r for r in rows if r[2]), key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    for n in (1, 7, 55, 160, 500):
        got = sorted(map(str, (tuple(r) for r in budgets.take_samples(df, ["a", "b"], n).collect())))
        assert got == sorted(map(str, order[:n]))
    assert budgets.take_samples(df.where("false"), ["a", "b"], 5).count() == 0


def test_sketches_of_corpora_are_joined(spark):
    docs = spark.range(20_000).select((F.col("id") % 3).alias("source"), F.array((F.col("id") * 7919) % 9001, F.col("id") % 50).alias("ids"))
    parts = [stats.distinct_sketches(docs.where(f"source = {i}"), F.col("ids"), ["source"]) for i in range(3)]
    joined = stats.approximate_distinct(parts[0].unionAll(parts[1]).unionAll(parts[2])).first()[0]
    exact = docs.select(F.explode("ids").alias("i")).agg(F.countDistinct("i")).first()[0]
    assert abs(joined - exact) <= exact * stats.SKETCH_ERROR
    assert stats.approximate_distinct(stats.distinct_sketches(docs.where("false"), F.col("ids"))).first()[0] in (0, None)


def test_text_files_are_prepared_in_order_of_their_paths(spark, tmp_path):
    folder = tmp_path / "files"
    (folder / "b").mkdir(parents=True)
    parts = {"b/2.txt": b"two\r\nlines\r", "a.txt": "é\n".encode(), "b/10.txt": b"bad \xff byte"}
    for name, content in parts.items():
        (folder / name).write_bytes(content)
    out = str(tmp_path / "out")
    workflows.prepare_files(spark, str(folder) + "/{*.txt,*/*.txt}", out, chunk_size=4)
    want = "".join(parts[n].decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n") for n in sorted(parts)).encode()
    chunks, meta = datasets.read_token_dataset(spark, out)
    assert bytes(b for r in chunks.orderBy("chunk_id").collect() for b in r.ids) == want
    assert meta.first()["total_tokens"] == len(want)
    files = spark.read.json(out + "/files").collect()
    assert sorted(r.source_file.rsplit("/", 1)[-1] for r in files) == ["10.txt", "2.txt", "a.txt"]
    assert {"source_file", "total_tokens", "total_chars", "vocab_size", "tokenizer"} == set(files[0].asDict())
