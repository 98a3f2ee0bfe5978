"""The four jobs a user runs end to end: prepare, inspect, draw batches, monitor."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.codecs import decode_bpe, decode_bytes, encode_bpe, encode_bytes
from tokenloom.functions.text import PREPARER_FIELDS, resolve_text
from tokenloom.operators import budgets, layout, runlog, stats
from tokenloom.operators.early_stop import StopRule, early_stopping
from tokenloom.session import written
from tokenloom.sources import datasets, logs
from tokenloom.sources.records import read_text_files

CHUNK_SIZE = 2048


def prepare(records: DataFrame, key: Sequence[str], path: str, name: str, config: str | None = None,
            split: str = "train", fields: Sequence[str] = PREPARER_FIELDS, max_samples: int | None = None,
            max_size: int | None = None, vocab_size: int = 256, ranks: Mapping[bytes, int] | None = None,
            eos_id: int | None = None, chunk_size: int = CHUNK_SIZE) -> None:
    """Resolve, filter, limit, tokenize, lay out and store a corpus with its metadata.

    Byte-level ids unless a BPE vocabulary is given. The size budget counts characters
    under BPE and bytes otherwise. Documents follow each other without a separator unless
    ``eos_id`` names one.
    """
    spark = records.sparkSession
    kind = "byte" if ranks is None else "bpe"
    docs = resolve_text(records, fields, "text").select(*key, "text")
    docs = budgets.take_budget(docs, key, max_size, "byte_level" if kind == "byte" else "tiktoken_gpt2")
    docs = budgets.take_samples(docs, key, max_samples)
    if max_size is not None or max_samples:
        # The layout and the metadata both read the selection, so it is made once.
        docs = written(docs, "selected")
    ids = None
    if kind == "byte" and eos_id is None:
        chunks, n_tokens, ids = layout.octet_chunks(docs, chunk_size, key), F.octet_length("text"), encode_bytes("octets", vocab_size)
    else:
        docs = _tokenized(spark, docs, vocab_size, ranks, eos_id)
        chunks, n_tokens = layout.chunk_layout(docs, chunk_size, key), F.size("ids")
    metadata = datasets.dataset_metadata(docs, n_tokens, name, config, split, vocab_size, kind)
    datasets.write_token_dataset(chunks, metadata, path, chunk_size=chunk_size, ids=ids)


def prepare_files(spark: SparkSession, files: str, path: str, vocab_size: int = 256,
                  ranks: Mapping[bytes, int] | None = None, chunk_size: int = CHUNK_SIZE,
                  max_chars: int | None = None) -> None:
    """Tokenize text files, lay them out in order of their paths and store them with a line of metadata each.

    Bytes that are no UTF-8 become replacement characters, line ends become line feeds. The texts are
    stored after that, because the layout and the metadata read them several times.
    """
    docs, ids = read_text_files(spark, files, max_chars), None
    if ranks is None:
        docs = written(docs, "texts")
        chunks, n_tokens, kind = layout.octet_chunks(docs, chunk_size, ["source_file"]), F.octet_length("text"), "byte"
        ids = encode_bytes("octets", vocab_size)
    else:
        docs = _tokenized(spark, docs, vocab_size, ranks, None)
        chunks, n_tokens, kind = layout.chunk_layout(docs, chunk_size, ["source_file"]), F.size("ids"), "bpe"
    metadata = datasets.dataset_metadata(docs, n_tokens, files, vocab_size=vocab_size, kind=kind)
    datasets.write_token_dataset(chunks, metadata, path, chunk_size=chunk_size, ids=ids)
    datasets.write_file_metadata(datasets.file_metadata(docs, n_tokens, vocab_size, kind), path)


def _tokenized(spark: SparkSession, docs: DataFrame, vocab_size: int, ranks: Mapping[bytes, int] | None,
               eos_id: int | None) -> DataFrame:
    """Documents with their ids, stored once: the layout needs their lengths and their values."""
    ids: Column = encode_bytes("text", vocab_size) if ranks is None else encode_bpe(spark, "text", ranks)
    if eos_id is not None:
        ids = F.concat(ids, F.array(F.lit(eos_id)))
    return written(docs.withColumn("ids", ids), "tokenized")


def inspect(spark: SparkSession, path: str, num_samples: int = 5, sample_length: int = 512, k: int = 20,
            ranks: Mapping[bytes, int] | None = None, seed: int | None = None,
            chunk_size: int | None = None) -> dict[str, DataFrame | None]:
    """Metadata, statistics, random decoded samples and token frequencies of a stored corpus."""
    chunks, metadata = datasets.read_token_dataset(spark, path)
    chunk_size = datasets.stored_chunk_size(chunks, metadata, chunk_size)
    counts = stats.token_counts(chunks, "ids")
    starts = layout.sample_starts(spark, num_samples, layout.stream_length(chunks), sample_length, seed)
    label = None if ranks is None else decode_bpe(spark, F.array("token_id"), ranks)
    decode = decode_bytes if ranks is None else (lambda ids: decode_bpe(spark, ids, ranks))
    return {"metadata": metadata, "statistics": stats.token_stats(counts),
            "samples": layout.inspect_samples(starts, chunks, chunk_size, sample_length, decode),
            "frequency": stats.token_frequency(counts, k, label)}


def batches(spark: SparkSession, path: str, steps: int, batch_size: int, block_size: int, grad_accum: int = 1,
            seed: int | None = None, chunk_size: int | None = None) -> DataFrame:
    """Random training windows of a stored corpus with step, row and optimizer step."""
    chunks, metadata = datasets.read_token_dataset(spark, path)
    chunk_size = datasets.stored_chunk_size(chunks, metadata, chunk_size)
    starts = layout.sample_starts(spark, steps * batch_size, layout.stream_length(chunks), block_size, seed)
    return layout.make_batches(layout.gather_windows(starts, chunks, chunk_size, block_size), batch_size, grad_accum)


def monitor(spark: SparkSession, path: str, now: Column | None = None, rule: StopRule = StopRule()) -> dict[str, DataFrame]:
    """What a live monitor shows of each log, and where the run would have stopped."""
    lines = logs.read_log(spark, path)
    points = written(runlog.parse_points(lines), "points")
    recent = runlog.parse_points(runlog.tail_lines(lines))
    status = runlog.current_status(recent)
    return {"status": status, "trend": runlog.sparkline(recent), "change": runlog.loss_change(recent),
            "eta": runlog.eta(status, F.current_timestamp() if now is None else now),
            "history": runlog.recent_history(recent), "events": runlog.parse_events(lines),
            "early_stopping": early_stopping(points, rule)}
