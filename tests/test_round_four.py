import hashlib
import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tokenloom.catalog import corpus
from tokenloom.functions import codecs
from tokenloom.operators import early_stop, layout, ngrams, runlog
from tokenloom.sources import datasets
from tokenloom.streaming import early_stop as stream_stop


def test_distinct_pairs_of_a_long_text_take_linear_time(spark, tmp_path):
    """A substring at every place walked the text from its start: minutes for 300,000 characters."""
    text = "".join(chr(97 + i * i % 23) for i in range(300_000)) + "é\U0001F600é"
    rows = [(1, "en", "a", text), (2, "en", "b", "x"), (3, "en", "b", "ab"), (4, "de", "a", "\U0001F600a"), (5, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = {r.lang: (r.exact, r.within_error) for r in corpus.approximate_distinct(spark, str(tmp_path)).collect()}
    assert got == {"en": (len({*zip(text, text[1:]), ("a", "b")}), True), "de": (1, True)}
    assert time.time() - began < 30


def test_documents_keep_their_order_in_text_files(spark, tmp_path, monkeypatch, request):
    """The writer sorts by folders; the order of documents within a file was lost."""
    rows = [(i, "ab"[i % 5 > 0], None if i % 97 == 0 else f"{i} é\r\n" * (i % 90)) for i in range(6_000)]
    (spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
     .write.parquet(str(tmp_path / "documents.parquet")))
    monkeypatch.setattr(corpus, "FILE_BYTES", 1 << 17)

    def files(rows):
        found, start = {}, 0
        for _, _, text in rows:
            found[start >> 17] = found.get(start >> 17, "") + (text or "").replace("\r\n", "\n") + "\n"
            start += len((text or "").encode()) + 1
        return found

    # Small tables would end in one task, where the order stays by chance.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    got = {r.file: r.text_md5 for r in corpus.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {f: hashlib.md5(t.encode()).hexdigest() for f, t in files(rows).items()}
    stream = "".join(t for lang in "ab" for _, t in sorted(files([r for r in rows if r[1] == lang]).items())).encode()
    chunks = {r.chunk_id: r.ids_md5 for r in corpus.prepare_text_files(spark, str(tmp_path)).collect()}
    want = [stream[i:i + corpus.CHUNK] for i in range(0, len(stream), corpus.CHUNK)]
    assert chunks == {i: hashlib.md5(",".join(map(str, w)).encode()).hexdigest() for i, w in enumerate(want)}


def test_memory_of_ngrams_does_not_follow_the_batch():
    """Numbers and rows of all n-grams of a batch took dozens of times its text."""
    values = pa.array(["ab" * 4_000_000, None, "", "cd" * 4_000_000])
    tracemalloc.start()
    try:
        found = sum(len(codes) for codes, _ in ngrams._codes(values, 2, 256))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 2 * (8_000_000 - 1) and peak < 80 << 20


def test_parts_of_a_batch_give_what_the_batch_gives(monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abé 1.\n") for _ in range(rnd.choice([0, 1, 2, 30, 700]))) for _ in range(200)] + [None]
    text, lists = pa.array([None, *texts])[1:], pa.array([None, *[t and list(t.encode()) for t in texts]], pa.list_(pa.int32()))[1:]
    want = [(code, i) for i, t in enumerate(texts) for code in
            [a * 65536 + b * 256 + c for a, b, c in zip(*[(t or "").encode()[j:] for j in range(3)])]]
    table = codecs._Pieces({bytes([b]): b for b in range(256)} | {b"ab": 256, b" a": 257}, codecs.GPT2_PATTERN)
    sizes, ids = table.batch(texts)
    for part in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(codecs, "PART", part)
        monkeypatch.setattr(ngrams, "PART", part)
        monkeypatch.setattr(codecs._Pieces, "RUN", max(part // 4, 1))
        for values in (text, lists):
            assert [(int(c), int(r)) for cs, rs in ngrams._codes(values, 3, 256) for c, r in zip(cs, rs)] == want
            runs = list(codecs.row_parts(values))
            assert [x for run in runs for x in run.to_pylist()] == values.to_pylist()
            assert all(len(run) == 1 or sum(len(x.encode() if isinstance(x, str) else x) for x in run.to_pylist() if x) <= part for run in runs)
        got = [table.batch(run.to_pylist()) for run in codecs.row_parts(text)]
        assert np.array_equal(np.concatenate([g[0] for g in got]), sizes) and np.array_equal(np.concatenate([g[1] for g in got]), ids)


def test_points_are_made_once(spark):
    """Counting, numbering and the window each made them anew; now all read the stored ones."""
    points = spark.range(300).select(F.lit("r").alias("run"), F.col("id").alias("line_no"), (F.col("id") * 500).alias("iteration"),
                                     (F.col("id") * F.col("id")).cast("double").alias("loss"))
    changes = runlog.loss_change(points, size=100)
    assert {r.line_no: r.change for r in changes.collect()} == {i: 2.0 * i - 1 for i in range(1, 300)}
    found = early_stop.evaluations(points, size=100)
    assert len(found.collect()) == 291
    assert all(df.inputFiles() and all("/points-" in f for f in df.inputFiles()) for df in (changes, found))


def test_a_long_document_is_cut_in_linear_time(spark):
    """Each of its chunks copied the whole document: 16 MB took 32,768 copies of 16 MB."""
    text = "".join(chr(97 + i * i % 23) for i in range(1 << 20)) * 16
    docs = spark.createDataFrame([(1, "xé"), (2, text), (3, None), (4, "y")], "doc_id long, text string")
    began = time.time()
    got = {r.chunk_id: bytes(r.octets) for r in layout.octet_chunks(docs, 512, ["doc_id"]).collect()}
    stream = f"xé{text}y".encode()
    assert got == {i // 512: stream[i:i + 512] for i in range(0, len(stream), 512)}
    assert time.time() - began < 25


def test_chunks_are_made_once_and_stored_in_order(spark, tmp_path):
    """A sample of the chunk numbers made all chunks, and their ids, a second time."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def seen(octets):
        made.add(1)
        return octets

    chunks = spark.range(1000).repartition(3).select(
        "id", seen(F.encode(F.format_string("%08d", "id"), "UTF-8")).alias("octets")).withColumnRenamed("id", "chunk_id")
    docs = spark.createDataFrame([(8000 - 3, "x")], "n long, text string")
    meta = datasets.dataset_metadata(docs, F.col("n"), "numbers", kind="byte")
    datasets.write_token_dataset(chunks, meta, str(tmp_path / "c"), chunk_size=8, ids=codecs.encode_bytes("octets"))
    assert made.value == 1000
    back, noted = datasets.read_token_dataset(spark, str(tmp_path / "c"))
    assert (noted.first()["total_tokens"], noted.first()["chunk_size"]) == (7997, 8)
    files = {}
    for r in back.select("*", F.input_file_name().alias("f")).collect():
        assert bytes(r.ids) == b"%08d" % r.chunk_id and r.n == 8
        files.setdefault(r.f, []).append(r.chunk_id)
    parts = sorted(files.values())
    assert len(parts) == 4 and [i for p in parts for i in p] == list(range(1000))


def test_batches_of_registered_queries_are_bounded_in_bytes(spark, request):
    """Batches were bounded in rows only: 10,000 texts and their ids were in a worker at once, whatever their length."""
    import __spark_entry__

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    request.addfinalizer(lambda: spark.conf.set(setting, before))
    spark.conf.set(setting, "256m")

    def query(session, _):
        texts = session.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
        return texts.select(F.arrow_udf(lambda a: pa.array([a.nbytes] * len(a)), "long")("text").alias("n"))

    sizes = [r.n for r in __spark_entry__._registered(query)(spark, "").collect()]
    assert len(sizes) == 40 and max(sizes) < 6 << 20


class _Store:
    """A value and a map of the state store, which count the calls to the map."""

    def __init__(self):
        self.value, self.entries, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return _Entries(self)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Entries:
    def __init__(self, store):
        self.store = store

    def exists(self):
        return bool(self.store.entries)

    def keys(self):
        return iter(list(self.store.entries))

    def getValue(self, key):
        self.store.calls += 1
        return self.store.entries[key]

    def updateValue(self, key, value):
        self.store.calls += 1
        self.store.entries[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        del self.store.entries[key]

    def clear(self):
        self.store.entries.clear()


def test_waiting_points_take_few_calls_to_the_state_store():
    """Each waiting point took three calls, and every Arrow batch sorted all that waited."""
    rnd = random.Random(4)
    points = [(100 * (i + 1), rnd.random()) for i in range(30_000)]

    def walked(turns):
        store, found = _Store(), []
        for turn in turns:
            stopper = stream_stop._stopper(early_stop.StopRule(limit=10**6), stream_stop.Arrival(log_interval=100, first=100), False)
            stopper.init(store)
            frames = [pd.DataFrame(turn[i:i + 1000], columns=["iteration", "loss"]) for i in range(0, len(turn), 1000)]
            found += [row for frame in stopper.handleInputRows(("a",), iter(frames), None) for row in frame.itertuples(index=False)]
        return store, found

    def plain(found):
        return [tuple(row)[:-1] for row in found]

    store, want = walked([points])
    assert len(want) == 5_999 and store.calls == 0
    mixed = rnd.sample(points, len(points))
    again = mixed[15_000]
    store, got = walked([mixed[:10_000], [*mixed[10_000:20_000], again], mixed[20_000:]])
    assert plain(got) == plain(want)
    assert store.calls < 60 and not store.entries and store.value[-1] == 1
