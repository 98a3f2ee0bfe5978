"""Registered queries: sources, projections, tokenizers, statistics, sequence layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom import workflows
from tokenloom.catalog.inputs import TOY_RANKS, documents, log_points, raw_records, runs, texts
from tokenloom.functions import codecs, text
from tokenloom.functions.sql import register_sql
from tokenloom.operators import budgets, layout, stats
from tokenloom.session import scratch_path, written
from tokenloom.sources import datasets, records

CHUNK = 512
BLOCK = 512
#: Text of a file; one that ends with a longer document holds that whole.
FILE_BYTES = 1 << 20
N_BYTES = F.octet_length


def md5_ids(ids: Column | str) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return layout.byte_chunks(documents(spark, sf), CHUNK, ["doc_id"])


def _octets(spark: SparkSession, sf: str) -> DataFrame:
    return layout.octet_chunks(documents(spark, sf), CHUNK, ["doc_id"])


def _total(spark: SparkSession, sf: str) -> int:
    return documents(spark, sf).agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0]


def _starts(spark: SparkSession, sf: str) -> DataFrame:
    """As many windows as fit the stream, so that sampling grows with the corpus."""
    total = _total(spark, sf)
    return layout.sample_starts(spark, total // BLOCK, total, BLOCK)


def read_split(spark, sf):
    path = scratch_path(spark, "split")
    (documents(spark, sf)
     .select("doc_id", "text", F.col("lang").alias("config"),
             F.when(F.col("n_chars") > 1000, "train").otherwise("validation").alias("split"))
     .write.partitionBy("config", "split").parquet(path))
    both = records.read_split(spark, path).unionByName(records.read_split(spark, path, split="validation"))
    return both.select("doc_id", "config", "split", F.md5("text").alias("text_md5"))


def _text_files(spark: SparkSession, sf: str, group: list[str], path: str) -> None:
    """Documents in order as text files of ``FILE_BYTES`` below folders named by group and number.

    A file is one row when it is written. Its documents are ordered in that row, because the
    writer sorts rows by its folders and keeps no other order.
    """
    docs = documents(spark, sf).select("doc_id", *group, F.coalesce("text", F.lit("")).alias("text"))
    sized = docs.withColumn("n", F.octet_length("text").cast("bigint") + 1)
    placed = layout.global_offsets(sized, ["doc_id"], "n", group=group).withColumn("file", F.expr(f"start div {FILE_BYTES}"))
    lines = F.sort_array(F.collect_list(F.struct("start", "text")))["text"]
    (placed.groupBy(*group, "file").agg(F.array_join(lines, "\n").alias("text"))
     .withColumn("file", F.format_string("%09d", "file")).write.partitionBy(*group, "file").text(path))


def read_text_files(spark, sf):
    """Documents as files of one MB, each read back as one row."""
    path = scratch_path(spark, "files")
    _text_files(spark, sf, [], path)
    read = records.read_text_files(spark, f"{path}/*/*.txt")
    return read.select(F.regexp_extract("source_file", r"file=(\d+)", 1).cast("bigint").alias("file"),
                       F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("text_md5"))


def prepare_text_files(spark, sf):
    """Text files of every language through the preparation, in order of their paths; chunks of the result."""
    files, path = scratch_path(spark, "files"), scratch_path(spark, "prepared")
    _text_files(spark, sf, ["lang"], files)
    workflows.prepare_files(spark, f"{files}/*/*/*.txt", path, vocab_size=256, chunk_size=CHUNK)
    chunks, _ = datasets.read_token_dataset(spark, path)
    return chunks.select("chunk_id", "n", md5_ids("ids").alias("ids_md5"))


def prepared_file_metadata(spark, sf):
    """The metadata of the same preparation: a row per file."""
    files, path = scratch_path(spark, "files"), scratch_path(spark, "prepared")
    _text_files(spark, sf, ["lang"], files)
    workflows.prepare_files(spark, f"{files}/*/*/*.txt", path, vocab_size=256, chunk_size=CHUNK)
    found = spark.read.json(f"{path}/files")
    return found.select(F.regexp_extract("source_file", r"lang=([^/]*)/", 1).alias("lang"),
                        F.regexp_extract("source_file", r"file=(\d+)", 1).cast("bigint").alias("file"),
                        "total_tokens", "total_chars", "vocab_size", "tokenizer")


def token_dataset(spark, sf):
    path = scratch_path(spark, "tokens")
    meta = datasets.dataset_metadata(documents(spark, sf), F.octet_length("text"), "documents", kind="byte")
    datasets.write_token_dataset(_octets(spark, sf), meta, path, chunk_size=CHUNK, ids=codecs.encode_bytes("octets"))
    chunks, meta = datasets.read_token_dataset(spark, path)
    datasets.stored_chunk_size(chunks, meta)
    return chunks.select("chunk_id", F.size("ids").alias("n"), md5_ids("ids").alias("ids_md5"))


def token_dataset_metadata(spark, sf):
    path = scratch_path(spark, "tokens")
    meta = datasets.dataset_metadata(documents(spark, sf), F.octet_length("text"), "documents",
                                     vocab_size=256, kind="byte")
    datasets.write_token_dataset(_chunks(spark, sf), meta, path)
    back = datasets.read_token_dataset(spark, path)[1]
    return back.select("dataset_name", "split", "samples_processed", "total_tokens", "total_chars",
                       "vocab_size", "tokenizer")


def dataset_metadata(spark, sf):
    docs = text.drop_empty_text(text.resolve_text(raw_records(spark, sf), text.PREPARER_FIELDS))
    meta = datasets.dataset_metadata(docs, F.octet_length("text"), "documents", "all", vocab_size=256, kind="byte")
    return meta.withColumn("as_json", F.to_json(F.struct("dataset_name", "samples_processed", "tokenizer")))


def dataset_size(spark, sf):
    path = scratch_path(spark, "lines")
    documents(spark, sf).select("text").write.text(path)
    return datasets.dataset_size(spark, path).select("bytes", F.round("mb", 6).alias("mb"))


def samples_json(spark, sf):
    path = scratch_path(spark, "samples")
    found = layout.sample_records(_starts(spark, sf), _octets(spark, sf), CHUNK, BLOCK, column="octets")
    datasets.write_samples_json(found, path)
    back = spark.read.schema("token_ids array<int>, start_index bigint, text string").json(path)
    return back.select("start_index", F.array_join("token_ids", ",").alias("token_ids"),
                       F.md5("text").alias("text_md5"))


def resolve_loader(spark, sf):
    r = text.resolve_text(raw_records(spark, sf), text.LOADER_FIELDS)
    return r.select("doc_id", F.md5("text").alias("text_md5"))


def resolve_preparer(spark, sf):
    r = text.resolve_text(raw_records(spark, sf), text.PREPARER_FIELDS)
    return r.select("doc_id", F.md5("text").alias("text_md5"))


def drop_empty(spark, sf):
    r = text.resolve_text(raw_records(spark, sf), text.LOADER_FIELDS)
    return text.drop_empty_text(r).select("doc_id", "lang")


def text_lengths(spark, sf):
    return text.text_lengths(documents(spark, sf)).select("doc_id", "chars", "utf8_bytes")


def take_budget(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    kept = budgets.take_budget(docs, ["doc_id"], 1_000_000)
    return kept.select("doc_id", F.octet_length("text").alias("utf8_bytes"))


def take_budget_chars(spark, sf):
    docs = text.resolve_text(raw_records(spark, sf), text.PREPARER_FIELDS).select("doc_id", "text")
    kept = budgets.take_budget(docs, ["doc_id"], 500_000, kind="tiktoken_gpt2")
    return kept.select("doc_id", F.length("text").alias("chars"))


def take_samples(spark, sf):
    docs = text.resolve_text(raw_records(spark, sf), text.PREPARER_FIELDS)
    return budgets.take_samples(docs, ["doc_id"], 700).select("doc_id", F.length("text").alias("chars"))


def crop_context(spark, sf):
    ids = texts(spark, sf).select("doc_id", codecs.encode_bytes("text").alias("ids"))
    return (ids.withColumn("ids", budgets.crop_context("ids", 512))
            .select("doc_id", F.size("ids").alias("n"), md5_ids("ids").alias("ids_md5")))


def encode_bytes(spark, sf):
    ids = texts(spark, sf).select("doc_id", codecs.encode_bytes("text").alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n"), md5_ids("ids").alias("ids_md5"))


def encode_bytes_clamped(spark, sf):
    ids = texts(spark, sf).select("doc_id", codecs.encode_bytes("text", 100).alias("ids"))
    return ids.select("doc_id", md5_ids("ids").alias("ids_md5"))


def encode_bytes_builtin(spark, sf):
    ids = texts(spark, sf).select("doc_id", codecs.encode_bytes_expr("text", 100).alias("ids"))
    return ids.select("doc_id", md5_ids("ids").alias("ids_md5"))


def encode_bpe(spark, sf):
    ids = texts(spark, sf).select("doc_id", codecs.encode_bpe(spark, "text", TOY_RANKS).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n"), md5_ids("ids").alias("ids_md5"))


def bpe_token_frequency(spark, sf):
    ids = texts(spark, sf).select(codecs.encode_bpe(spark, "text", TOY_RANKS).alias("ids"))
    counts = stats.token_counts(ids, "ids", 266)
    decoded = codecs.decode_bpe(spark, F.array("token_id"), TOY_RANKS)
    return (stats.token_frequency(counts, 20, decoded)
            .select("token_id", "n", F.round("pct", 6).alias("pct"), "label"))


def decode_bpe(spark, sf):
    ids = texts(spark, sf).select("doc_id", codecs.encode_bpe(spark, "text", TOY_RANKS).alias("ids"))
    return ids.select("doc_id", F.md5(codecs.decode_bpe(spark, "ids", TOY_RANKS)).alias("text_md5"))


def _public_ranks(spark: SparkSession) -> dict[bytes, int]:
    """The public byte-level vocabulary, read by Spark; only these queries need its package."""
    import public_tokenizers

    return codecs.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def encode_public_bpe(spark, sf):
    ids = texts(spark, sf).select("doc_id", codecs.encode_bpe(spark, "text", _public_ranks(spark)).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n"), md5_ids("ids").alias("ids_md5"))


def decode_public_bpe(spark, sf):
    ranks = _public_ranks(spark)
    ids = texts(spark, sf).select("doc_id", codecs.encode_bpe(spark, "text", ranks).alias("ids"))
    return ids.select("doc_id", F.md5(codecs.decode_bpe(spark, "ids", ranks)).alias("text_md5"))


def encode_codepoints(spark, sf):
    ids = texts(spark, sf).select("doc_id", codecs.encode_codepoints("text").alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n"), md5_ids("ids").alias("ids_md5"))


def decode_bytes(spark, sf):
    ids = texts(spark, sf).select("doc_id", codecs.encode_bytes("text").alias("ids"))
    return ids.select("doc_id", F.md5(codecs.decode_bytes("ids")).alias("text_md5"))


def decode_codepoints(spark, sf):
    ids = texts(spark, sf).select("doc_id", codecs.encode_codepoints("text").alias("ids"))
    return ids.select("doc_id", F.md5(codecs.decode_codepoints("ids")).alias("text_md5"))


def token_label(spark, sf):
    counts = stats.token_counts(documents(spark, sf), "text")
    shown = codecs.decode_bytes(F.array("token_id"))
    return counts.select("token_id", "n", codecs.token_label("token_id", shown).alias("label"),
                         codecs.token_label("token_id").alias("bare_label"))


def tokenizer_label(spark, sf):
    return documents(spark, sf).groupBy("lang").agg(F.count("*").alias("docs")).select(
        "lang", "docs", codecs.tokenizer_label("byte").alias("byte_label"),
        codecs.tokenizer_label("bpe").alias("bpe_label"))


def corpus_totals(spark, sf):
    t = stats.corpus_totals(documents(spark, sf), N_BYTES("text"), by=["lang", "source"])
    return t.withColumn("avg_tokens", F.round("avg_tokens", 6))


def corpus_totals_rollup(spark, sf):
    t = stats.corpus_totals(documents(spark, sf), N_BYTES("text"), by=["lang", "source"], rollup=True)
    return t.withColumn("avg_tokens", F.round("avg_tokens", 6))


def token_stats(spark, sf):
    return stats.token_stats(stats.token_counts(documents(spark, sf), "text"))


def approximate_distinct(spark, sf):
    """Distinct pairs of neighbouring characters: sketches per source, joined per language and checked by the exact count."""
    # Characters are cut once: a substring at every place would walk the text from its start each time.
    chars = F.split("text", "")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b))
    spread = records.spread_few_files(documents(spark, sf).select("doc_id", "lang", "source", "text"), "doc_id")
    docs = written(spread.where(F.length("text") > 1).select("lang", "source", F.array_distinct(pairs).alias("pairs")), "pairs")
    sketches = written(stats.distinct_sketches(docs, F.col("pairs"), ["lang", "source"]), "sketches")
    found = stats.approximate_distinct(sketches, ["lang"])
    exact = docs.select("lang", F.explode("pairs").alias("p")).groupBy("lang").agg(F.countDistinct("p").alias("exact"))
    near = F.abs(F.col("distinct_ids") - F.col("exact")) <= F.col("exact") * stats.SKETCH_ERROR
    return found.join(exact, "lang").select("lang", "exact", near.alias("within_error"))


def token_frequency(spark, sf):
    """Read, resolve, drop empty, encode, count: the whole preparation and inspection path."""
    docs = text.drop_empty_text(text.resolve_text(documents(spark, sf), text.PREPARER_FIELDS))
    found = stats.token_frequency(stats.token_counts(docs, "text"), 20)
    return found.select("token_id", "n", F.round("pct", 6).alias("pct"), "label")


def progress_points(spark, sf):
    docs = text.resolve_text(raw_records(spark, sf), text.PREPARER_FIELDS)
    return budgets.progress_points(docs, ["doc_id"], F.octet_length("text"), every=50)


def throughput(spark, sf):
    points = log_points(spark, sf).withColumn("elapsed", F.col("iteration") * 1.25)
    t = stats.throughput(points, runs(spark), total_tokens=46_187_514)
    return t.select("run", "iteration", "tokens_seen", "effective_tokens",
                    F.round("tok_per_s", 6).alias("tok_per_s"), F.round("epochs", 6).alias("epochs"))


def global_offsets(spark, sf):
    slim = documents(spark, sf).select("doc_id", F.octet_length("text").alias("n"))
    return layout.global_offsets(slim, ["doc_id"], "n")


def chunk_layout(spark, sf):
    return _chunks(spark, sf).select("chunk_id", F.size("ids").alias("n"), md5_ids("ids").alias("ids_md5"))


def chunk_layout_ids(spark, sf):
    """The array form, on BPE ids."""
    # Stored, as the layout reads lengths and values in separate passes.
    ids = written(texts(spark, sf).select("doc_id", codecs.encode_bpe(spark, "text", TOY_RANKS).alias("ids")), "ids")
    chunks = layout.chunk_layout(ids, CHUNK, ["doc_id"])
    return chunks.select("chunk_id", F.size("ids").alias("n"), md5_ids("ids").alias("ids_md5"))


def sample_starts(spark, sf):
    return _starts(spark, sf)


def _windows(spark, sf):
    return layout.gather_windows(_starts(spark, sf), _octets(spark, sf), CHUNK, BLOCK, "octets")


def gather_windows(spark, sf):
    return _windows(spark, sf).select("sample_id", "start", md5_ids("x").alias("x_md5"),
                                      md5_ids("y").alias("y_md5"))


def make_batches(spark, sf):
    b = layout.make_batches(_windows(spark, sf), 8, 4)
    return b.select("sample_id", "step", "row", "optimizer_step", "updates", md5_ids("x").alias("x_md5"))


def inspect_samples(spark, sf):
    s = layout.inspect_samples(_starts(spark, sf), _octets(spark, sf), CHUNK, BLOCK, column="octets")
    return s.select("sample_id", "range_start", "range_end", "truncated", F.md5("text").alias("text_md5"))


def sample_records(spark, sf):
    s = layout.sample_records(_starts(spark, sf), _octets(spark, sf), CHUNK, BLOCK, column="octets")
    return s.select("sample_id", "start_index", F.array_join("token_ids", ",").alias("token_ids"))


def sql_functions(spark, sf):
    register_sql(spark)
    documents(spark, sf).createOrReplaceTempView("tokenloom_documents")
    return spark.sql("""
        SELECT doc_id, round(perplexity(n_chars / 10000D), 6) AS ppl,
               format_duration(n_chars + 0.25D) AS took,
               md5(decode_bytes(encode_bytes(text))) AS text_md5,
               size(encode_codepoints(text)) AS n_codepoints
        FROM tokenloom_documents""")


QUERIES = {
    "s1_read_split": read_split,
    "s2_read_text_files": read_text_files,
    "s2_prepare_text_files": prepare_text_files,
    "s6_file_metadata": prepared_file_metadata,
    "s4_s5_token_dataset": token_dataset,
    "s5_token_dataset_metadata": token_dataset_metadata,
    "s6_dataset_metadata": dataset_metadata,
    "s7_dataset_size": dataset_size,
    "s12_samples_json": samples_json,
    "p1_resolve_text": resolve_loader,
    "p2_resolve_text_preparer": resolve_preparer,
    "p3_drop_empty_text": drop_empty,
    "p4_take_budget_bytes": take_budget,
    "p4_take_budget_chars": take_budget_chars,
    "p5_take_samples": take_samples,
    "p6_crop_context": crop_context,
    "p7_text_lengths": text_lengths,
    "k1_encode_bytes": encode_bytes,
    "k1_encode_bytes_clamped": encode_bytes_clamped,
    "k1_encode_bytes_builtin": encode_bytes_builtin,
    "k2_encode_bpe": encode_bpe,
    "k2_bpe_token_frequency": bpe_token_frequency,
    "k2_encode_public_bpe": encode_public_bpe,
    "k5_decode_public_bpe": decode_public_bpe,
    "k3_encode_codepoints": encode_codepoints,
    "k4_decode_bytes": decode_bytes,
    "k5_decode_bpe": decode_bpe,
    "k6_decode_codepoints": decode_codepoints,
    "k7_token_label": token_label,
    "k8_tokenizer_label": tokenizer_label,
    "a1_corpus_totals": corpus_totals,
    "a1_corpus_totals_rollup": corpus_totals_rollup,
    "a2_token_stats": token_stats,
    "a2_approximate_distinct": approximate_distinct,
    "a3_token_frequency": token_frequency,
    "a4_progress_points": progress_points,
    "a5_throughput": throughput,
    "w1_global_offsets": global_offsets,
    "w2_chunk_layout": chunk_layout,
    "w2_chunk_layout_bpe": chunk_layout_ids,
    "w3_sample_starts": sample_starts,
    "w4_gather_windows": gather_windows,
    "w5_make_batches": make_batches,
    "w6_inspect_samples": inspect_samples,
    "w7_sample_records": sample_records,
    "u3_sql_functions": sql_functions,
}
