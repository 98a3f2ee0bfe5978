"""Prepared datasets on storage: tokens, metadata, size, samples."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.codecs import tokenizer_label
from tokenloom.session import written


#: Row groups of stored chunks: what a reader of one window reads at least.
ROW_GROUP_BYTES = 8 << 20


def dataset_metadata(docs: DataFrame, n_tokens: Column, name: str, config: str | None = None,
                     split: str = "train", vocab_size: int = 50257, kind: str = "bpe") -> DataFrame:
    """One row describing a prepared split."""
    return docs.agg(
        F.count("*").alias("samples_processed"),
        F.coalesce(F.sum(n_tokens.cast("bigint")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)).alias("total_chars"),
    ).select(F.lit(name).alias("dataset_name"), F.lit(config).cast("string").alias("config"),
             F.lit(split).alias("split"), "samples_processed", "total_tokens", "total_chars",
             F.lit(vocab_size).alias("vocab_size"), tokenizer_label(kind).alias("tokenizer"))


def file_metadata(files: DataFrame, n_tokens: Column, vocab_size: int = 50257,
                  kind: str = "bpe") -> DataFrame:
    """One row per text file (the five-field form)."""
    return files.select("source_file", n_tokens.cast("bigint").alias("total_tokens"),
                        F.length("text").cast("bigint").alias("total_chars"),
                        F.lit(vocab_size).alias("vocab_size"), tokenizer_label(kind).alias("tokenizer"))


def write_file_metadata(metadata: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The five-field form of a corpus of text files: one JSON line per file, in order of the files.

    The rows are stored before they are ordered, which would make them a second time for its sample.
    """
    written(metadata, "file-metadata").repartitionByRange("source_file").sortWithinPartitions("source_file").write.mode(mode).option(
        "ignoreNullFields", False).json(f"{path}/files")


def write_token_dataset(chunks: DataFrame, metadata: DataFrame | None, path: str,
                        mode: str = "errorifexists", chunk_size: int | None = None, ids: Column | None = None) -> None:
    """Chunk table as Parquet, metadata as readable JSON next to it.

    Chunks are stored in order of their number, so that readers of a few windows skip most
    of them, with their number of tokens ``n`` beside the ids, so that sizes are known without
    reading these. ``chunk_size`` becomes part of the metadata. With it and the metadata's number of
    tokens the place of a chunk is known; otherwise the chunks are made a second time for a sample.
    ``ids`` makes the ids of chunks that hold something smaller, as bytes, once they are in order.
    """
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    metadata = None if metadata is None else written(metadata, "metadata")
    if metadata is not None and chunk_size is not None:
        last = max(metadata.first()["total_tokens"] - 1, 0) // chunk_size
        dealt = chunks.repartitionById(parts, F.expr(f"cast(least(chunk_id * {parts} div {last + 1}, {parts - 1}) as int)"))
    else:
        dealt = chunks.repartitionByRange(parts, "chunk_id")
    (dealt.sortWithinPartitions("chunk_id").select("chunk_id", (F.col("ids") if ids is None else ids).alias("ids"))
     .withColumn("n", F.size("ids")).write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/tokens"))
    if metadata is not None:
        if chunk_size is not None:
            metadata = metadata.withColumn("chunk_size", F.lit(chunk_size))
        metadata.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(f"{path}/metadata")


def read_token_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Chunks and metadata; a dataset without metadata, or a bare token table, is fine."""
    try:
        chunks = spark.read.parquet(f"{path}/tokens")
    except AnalysisException:
        return spark.read.parquet(path), None
    try:
        return chunks, spark.read.json(f"{path}/metadata")
    except AnalysisException:
        return chunks, None


def stored_chunk_size(chunks: DataFrame, metadata: DataFrame | None, given: int | None = None) -> int:
    """The chunk size of a stored corpus, checked against the chunks themselves.

    All chunks but the last have that size. A corpus that does not say so, and for which none
    is given, cannot be read: windows would silently come from the wrong places.
    """
    noted = metadata.first()["chunk_size"] if metadata is not None and "chunk_size" in metadata.columns else None
    size = given if noted is None else noted
    if size is None:
        raise ValueError("the corpus does not record its chunk size; name it")
    if given is not None and given != size:
        raise ValueError(f"the corpus has chunks of {size} tokens, not {given}")
    n = F.col("n") if "n" in chunks.columns else F.size("ids")
    found = chunks.agg(F.max("chunk_id").alias("last"), F.count("*").alias("n"),
                       F.max(F.when(F.col("chunk_id") == 0, n)).alias("first"), F.max(n).alias("longest")).first()
    if found["n"] and (found["longest"] > size or (found["last"] > 0 and found["first"] != size)):
        raise ValueError(f"the chunks are not of {size} tokens")
    return size


def dataset_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and MiB of the stored files, from their listing: no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return (files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
            .withColumn("mb", F.col("bytes") / (1024 * 1024)))


def write_samples_json(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    samples.select("token_ids", "start_index", "text").write.mode(mode).json(path)
