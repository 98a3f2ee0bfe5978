"""The global token stream: offsets, fixed chunks, sampled windows and batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.codecs import decode_bytes, encode_bytes
from tokenloom.plans.ordered import BUCKET, running_sums

# Multiplier and increment of the repeatable start generator, the display
# length of a decoded sample, and the ids stored with a sample record.
LCG_MULTIPLIER, LCG_INCREMENT = 1103515245, 12345
SAMPLE_CHARS = 500
RECORD_IDS = 100
#: Up to so many chunks the scan is told which ones are wanted, in so many ranges.
FEW_CHUNKS, RANGES = 2_000, 32


def global_offsets(df: DataFrame, key: Sequence[str], n_col: str, out: str = "start",
                   **options) -> DataFrame:
    """Position of each document's first token in the concatenated stream."""
    return running_sums(df, key, {out: F.col(n_col).cast("bigint")}, **options)


def octet_chunks(docs: DataFrame, chunk_size: int, key: Sequence[str], text: str = "text") -> DataFrame:
    """Chunks ``(chunk_id, octets)`` of the UTF-8 bytes of all texts in order."""
    octets = docs.select(*key, F.col(text).cast("binary").alias("octets"))
    return chunk_layout(octets, chunk_size, key, "octets")


def byte_chunks(docs: DataFrame, chunk_size: int, key: Sequence[str], text: str = "text",
                vocab_size: int = 256) -> DataFrame:
    """Chunks of byte-level ids. UTF-8 bytes are cut and shuffled; ids exist only at the end."""
    return octet_chunks(docs, chunk_size, key, text).select("chunk_id", encode_bytes("octets", vocab_size).alias("ids"))


def chunk_layout(docs: DataFrame, chunk_size: int, key: Sequence[str], column: str = "ids") -> DataFrame:
    """Cut the stream into chunks ``(chunk_id, column)`` of ``chunk_size`` tokens.

    ``column`` holds one token per array element, or per byte of a binary value.

    The documents are shuffled once, by order bucket. Chunks inside a bucket are assembled
    there without another exchange. Only the pieces of chunks that straddle a bucket
    border (at most two chunks per bucket) are shuffled again, by chunk.
    """
    binary = dict(docs.dtypes)[column] == "binary"
    n = F.octet_length(column) if binary else F.size(column)
    sized = docs.select(*key, column, n.cast("bigint").alias("_n")).where(F.col("_n") > 0)
    placed = (global_offsets(sized, key, "_n", "_at", keys=docs, keep_bucket=True)
              .withColumns({"_first": F.expr(f"_at div {chunk_size}"),
                            "_last": F.expr(f"(_at + _n - 1) div {chunk_size}")}))

    def straddles(chunk: Column) -> Column:
        return (chunk * chunk_size < F.col("_at_lo")) | ((chunk + 1) * chunk_size > F.col("_at_hi"))

    inner = _fragments(placed, chunk_size, column, binary, lambda c: ~straddles(c))
    near = placed.where(straddles(F.col("_first")) | straddles(F.col("_last")))
    border = _fragments(near, chunk_size, column, binary, straddles)
    joined = _joined_octets() if binary else _joined()
    return (inner.groupBy(BUCKET, "chunk_id").agg(*_assembled())
            .select("chunk_id", joined.alias(column))
            .unionByName(border.groupBy("chunk_id").agg(*_assembled())
                         .select("chunk_id", joined.alias(column))))


def _fragments(placed: DataFrame, size: int, column: str, binary: bool,
               wanted: Callable[[Column], Column]) -> DataFrame:
    """One row per piece of a document that falls into a wanted chunk."""
    start, n = F.col("_at"), F.col("_n")
    take = F.substring if binary else F.slice

    def cut(chunk: Column, whole: Column) -> Column:
        begin = F.greatest(chunk * size - start, F.lit(0))
        end = F.least((chunk + 1) * size - start, n)
        piece = take(whole, (begin + 1).cast("int"), (end - begin).cast("int"))
        return F.struct(chunk.alias("chunk_id"),
                        F.struct((start + begin - chunk * size).cast("int").alias("off"),
                                 piece.alias("piece")).alias("part"))

    # The pieces are cut before the explode, which would otherwise copy the whole
    # document into each of its rows. As an array's element the document is read from its row
    # once; as a column it would be copied for each piece, in time with the square of its length.
    chunks = F.filter(F.sequence("_first", "_last"), wanted)
    cuts = F.flatten(F.transform(F.array(column), lambda whole: F.transform(chunks, lambda c: cut(c, whole))))
    pieces = placed.select(BUCKET, F.explode(cuts).alias("f"))
    return pieces.select(BUCKET, "f.chunk_id", "f.part")


def _assembled() -> list[Column]:
    return [F.sort_array(F.collect_list("part")).alias("parts")]


def _joined() -> Column:
    return F.flatten(F.transform("parts", lambda p: p["piece"]))


def _joined_octets() -> Column:
    return F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["piece"]))


def stream_length(chunks: DataFrame) -> int:
    """Tokens of all chunks. Stored chunks have a column ``n``, so that no ids are read for it."""
    n = F.col("n") if "n" in chunks.columns else F.size("ids")
    return chunks.agg(F.sum(n.cast("bigint")).alias("n")).first()["n"] or 0


def repeatable_start(sample_id: Column, room: int) -> Column:
    """The start that belongs to a sample id, below ``room``.

    In decimals, as the product passes 64 bits beyond some 8e9 samples.
    """
    wide = sample_id.cast("decimal(20,0)") * F.lit(LCG_MULTIPLIER).cast("decimal(10,0)") + F.lit(LCG_INCREMENT)
    return (wide % F.lit(room).cast("decimal(20,0)")).cast("bigint")


def sample_starts(spark: SparkSession, n: int, total: int, block: int, seed: int | None = None) -> DataFrame:
    """``n`` window starts with replacement, uniform in ``[0, total - block)``.

    Without a seed a linear congruence of the sample id gives the same starts anywhere.
    """
    room = total - block
    if room <= 0:
        raise ValueError(f"the stream has {total} tokens, too few for windows of {block}")
    ids = spark.range(n).withColumnRenamed("id", "sample_id")
    start = (repeatable_start(F.col("sample_id"), room) if seed is None
             else F.floor(F.rand(seed) * room))
    return ids.withColumn("start", start.cast("bigint"))


def _only_touched(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """For few windows the chunks between their chunk numbers, as a filter that reaches the scan.

    Stored chunks are sorted by number, so row groups without a wanted one are not read. Close
    numbers share a range; there are at most ``RANGES`` of them.
    """
    ids = sorted(r[0] for r in wanted.select("chunk_id").distinct().limit(FEW_CHUNKS + 1).collect())
    if len(ids) > FEW_CHUNKS:
        return chunks
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i] - ids[i - 1], reverse=True)[:RANGES - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    inside = [F.col("chunk_id").between(ids[a], ids[b - 1]) for a, b in zip(cuts, cuts[1:]) if a < b]
    return chunks.where(reduce(or_, inside, F.lit(False)))


def gather_tokens(starts: DataFrame, chunks: DataFrame, chunk_size: int, length: int, column: str = "ids",
                  vocab_size: int = 256) -> DataFrame:
    """``length`` tokens from each start, by an equi-join on chunk id.

    A window no longer than a chunk plus one token touches at most two chunks. Only its
    own part of a chunk is carried into the second shuffle, by sample. A chunk that is
    missing, or shorter than the window needs, is an error. A ``column`` of bytes is carried
    as bytes, and turned into byte-level ids at the end.
    """
    if length > chunk_size + 1:
        raise ValueError("chunks must be at least as long as the window")
    first, last = F.expr(f"start div {chunk_size}"), F.expr(f"(start + {length - 1}) div {chunk_size}")
    wanted = starts.select("sample_id", "start", F.explode(F.sequence(first, last)).alias("chunk_id"))
    chunks = _only_touched(chunks.select("chunk_id", column), wanted)
    binary = dict(chunks.dtypes)[column] == "binary"
    take = F.substring if binary else F.slice
    begin = F.greatest(F.col("start") - F.col("chunk_id") * chunk_size, F.lit(0))
    end = F.least(F.col("start") + length - F.col("chunk_id") * chunk_size, F.lit(chunk_size))
    part = F.struct(F.col("chunk_id").alias("c"),
                    take(F.col(column), (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    pieces = wanted.join(chunks, "chunk_id").select("sample_id", "start", part.alias("part"))
    # The starts themselves go along, so that a window without any piece is noticed.
    every = pieces.unionByName(starts.select("sample_id", "start"), allowMissingColumns=True)
    whole = (every.groupBy("sample_id", "start").agg(*_assembled())
             .select("sample_id", "start", (_joined_octets() if binary else _joined()).alias("whole")))
    short = F.raise_error(F.format_string("sample %d lacks tokens of its window", "sample_id"))
    size = F.octet_length("whole") if binary else F.size("whole")
    checked = whole.select("sample_id", "start", F.when(size == length, F.col("whole")).otherwise(
        short.cast("binary" if binary else "array<int>")).alias("ids"))
    return checked.withColumn("ids", encode_bytes("ids", vocab_size)) if binary else checked


def gather_windows(starts: DataFrame, chunks: DataFrame, chunk_size: int, block: int, column: str = "ids") -> DataFrame:
    """Inputs ``x`` and next-token targets ``y`` of ``block`` tokens for each start."""
    both = gather_tokens(starts, chunks, chunk_size, block + 1, column)
    return both.select("sample_id", "start", F.slice("ids", 1, block).alias("x"),
                       F.slice("ids", 2, block).alias("y"))


def make_batches(windows: DataFrame, batch_size: int, grad_accum: int = 1) -> DataFrame:
    """Step, row and optimizer-step numbers; weights update on a step's last micro-batch."""
    step = F.expr(f"sample_id div {batch_size}")
    return windows.withColumns({
        "step": step,
        "row": F.pmod("sample_id", F.lit(batch_size)).cast("int"),
        "optimizer_step": F.expr(f"sample_id div {batch_size * grad_accum}"),
        "updates": (step + 1) % grad_accum == 0})


def inspect_samples(starts: DataFrame, chunks: DataFrame, chunk_size: int, length: int = 512,
                    decode: Callable[[str], Column] = decode_bytes, column: str = "ids") -> DataFrame:
    """Sampled windows as text: the first 500 characters and whether more followed."""
    return (gather_tokens(starts, chunks, chunk_size, length, column)
            .select("sample_id", F.col("start").alias("range_start"),
                    (F.col("start") + length).alias("range_end"), decode("ids").alias("_text"))
            .select("sample_id", "range_start", "range_end",
                    F.left("_text", F.lit(SAMPLE_CHARS)).alias("text"),
                    (F.length("_text") > SAMPLE_CHARS).alias("truncated")))


def sample_records(starts: DataFrame, chunks: DataFrame, chunk_size: int, length: int = 512,
                   decode: Callable[[str], Column] = decode_bytes, column: str = "ids") -> DataFrame:
    """Sample records: the first 100 ids, their text and the start index."""
    shown = gather_tokens(starts, chunks, chunk_size, length, column).withColumn(
        "token_ids", F.slice("ids", 1, RECORD_IDS))
    return shown.select("sample_id", "token_ids", F.col("start").alias("start_index"),
                        decode("token_ids").alias("text"))
