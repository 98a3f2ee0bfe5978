"""Tokenizers and their inverses as column functions."""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections import deque
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Tokenizer labels, label width, and the pre-split pattern of GPT-2 BPE.
TOKENIZER_LABELS = {"bpe": "tiktoken_gpt2", "byte": "byte_level"}
LABEL_WIDTH = 20
GPT2_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY = 1_000_000
#: Bytes of text, or ids, that a function works on at a time, however many a batch holds.
PART = 1 << 20


def row_parts(values: pa.Array) -> Iterator[pa.Array]:
    """A batch of texts or lists in runs of rows of up to ``PART`` bytes or ids; a longer row is a run of its own."""
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(values):
        limit = (ends[at - 1] if at else 0) + PART
        stop = max(int(np.searchsorted(ends, limit, "right")), at + 1)
        yield values.slice(at, stop - at)
        at = stop


def encode_bytes(text: Column | str, vocab_size: int = 256) -> Column:
    """UTF-8 bytes as ids, each at most ``vocab_size - 1``.

    An Arrow function: the string buffer is reinterpreted as a whole batch, no row loop.
    """
    return octet_encoder(vocab_size)(text)


def octet_encoder(vocab_size: int = 256):
    """The encoder as a function that can also be registered for SQL."""
    top = vocab_size - 1

    def encode(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary())
        bounds = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        data = raw.buffers()[2]
        octets = (np.empty(0, np.uint8) if data is None
                  else np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]])
        ids = np.minimum(octets, top).astype(np.int32) if top < 255 else octets.astype(np.int32)
        if bounds[-1] - bounds[0] > np.iinfo(np.int32).max:
            raise ValueError("a batch of texts exceeds 2 GiB; lower spark.sql.execution.arrow.maxBytesPerBatch")
        offsets = pa.array((bounds - bounds[0]).astype(np.int32),
                           mask=np.append(_null_mask(texts), False) if texts.null_count else None)
        return pa.ListArray.from_arrays(offsets, pa.array(ids))

    return F.arrow_udf(encode, "array<int>")


def _null_mask(values: pa.Array) -> np.ndarray:
    return values.is_null().to_numpy(zero_copy_only=False)


def encode_bytes_expr(text: Column | str, vocab_size: int = 256) -> Column:
    """The same ids by built-in expressions only; slower, for plans without Python."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(
        pairs, lambda p: F.least(F.conv(p, 16, 10).cast("int"), F.lit(vocab_size - 1)))


def decode_bytes(ids: Column | str) -> Column:
    """``id % 256`` as bytes, decoded as UTF-8 with replacement characters.

    A batch that is valid UTF-8 throughout is never touched row by row.
    """

    def decode(batch: pa.Array) -> pa.Array:
        flat = batch.flatten().to_numpy(zero_copy_only=False)
        return _utf8_rows(batch, pa.py_buffer((flat % 256).astype(np.uint8)), _row_bounds(batch))

    return F.arrow_udf(decode, "string")(ids)


def _row_bounds(batch: pa.Array) -> np.ndarray:
    """Where each list of a batch starts in its flattened values."""
    sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _utf8_rows(batch: pa.Array, octets: pa.Buffer, bounds: np.ndarray) -> pa.Array:
    """Texts from one run of bytes, null where the batch is."""
    valid = pa.py_buffer(np.packbits(~_null_mask(batch), bitorder="little")) if batch.null_count else None
    raw = pa.Array.from_buffers(pa.large_binary(), len(batch), [valid, pa.py_buffer(bounds), octets])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in raw.to_pylist()],
                        pa.string())


def decode_bytes_expr(ids: Column | str) -> Column:
    """The same text by built-in expressions only."""
    digits = F.transform(ids, lambda i: F.lpad(F.hex(F.pmod(i, F.lit(256))), 2, "0"))
    return F.make_valid_utf8(F.unhex(F.array_join(digits, "")).cast("string"))


def encode_codepoints(text: Column | str) -> Column:
    """One id per character: its code point, at most 255."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""),
                       lambda c: F.least(F.ascii(c), F.lit(255)))


def decode_codepoints(ids: Column | str) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.char(F.least(i, F.lit(255)))), "")


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a vocabulary file with one ``base64(token) rank`` pair per line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The same file read by Spark, from any storage that it knows."""
    rows = (spark.read.text(path).where(F.length(F.trim("value")) > 0)
            .select(F.split(F.trim("value"), " ").alias("p"))
            .select(F.unbase64(F.col("p")[0]).alias("token"), F.col("p")[1].cast("int").alias("rank")).limit(MAX_VOCABULARY + 1))
    return _checked({bytes(r["token"]): r["rank"] for r in rows.collect()})


def _checked(ranks: Mapping[bytes, int]) -> dict[bytes, int]:
    if not ranks:
        raise ValueError("a BPE vocabulary is required; there is no silent byte fallback")
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary above {MAX_VOCABULARY} entries cannot be broadcast")
    return dict(ranks)


def encode_bpe(spark: SparkSession, text: Column | str, ranks: Mapping[bytes, int],
               pattern: str = GPT2_PATTERN) -> Column:
    """Byte-pair ids without special tokens.

    Map-only: the vocabulary is the one broadcast value and its size is checked. Pieces
    repeat heavily, so a join on pieces would meet hot keys; encoding inside the batch
    needs no shuffle at all.
    """
    checked = _checked(ranks)
    shared = spark.sparkContext.broadcast(checked)
    digest = hashlib.sha256(repr((pattern, sorted(checked.items()))).encode()).hexdigest()

    def encode(texts: pa.Array) -> pa.Array:
        table = _pieces(digest, shared, pattern)
        done = deque(table.batch(run.to_pylist()) for run in row_parts(texts))
        sizes = np.concatenate([s for s, _ in done]) if done else np.empty(0, np.int32)
        ids, at = np.empty(int(sizes.sum()), np.int32), 0
        while done:
            # Each run is freed as it is copied, so that the ids are held once.
            run = done.popleft()[1]
            ids[at:at + len(run)] = run
            at += len(run)
        if len(ids) > np.iinfo(np.int32).max:
            raise ValueError("a batch has too many ids; lower spark.sql.execution.arrow.maxBytesPerBatch")
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        offsets = pa.array(bounds, mask=np.append(_null_mask(texts), False) if texts.null_count else None)
        return pa.ListArray.from_arrays(offsets, pa.array(ids))

    return F.arrow_udf(encode, "array<int>")(text)


#: Merged pieces of this Python process, for one vocabulary at a time.
_KNOWN: dict[str, _Pieces] = {}


class _Pieces:
    """Splits texts by the pattern and merges each distinct piece once.

    Merged pieces are numbered, and their ids lie one after the other in one array, from
    which a run of pieces takes its ids at once. The table is emptied before a run that finds it
    full, of pieces or of ids.
    """

    LIMIT, MOST_IDS = 500_000, 4_000_000
    #: Pieces of one run; longer texts are encoded run by run.
    RUN = 200_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self._empty()

    def _empty(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.length = np.empty(1 << 12, np.int32), np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64)
        self.used = 0

    def _learn(self, pieces: Iterable[str]) -> None:
        for piece in pieces:
            merged = self._merge(piece.encode())
            at, end = len(self.number), self.used + len(merged)
            while end > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            if at == len(self.start):
                self.start, self.length = (np.concatenate([a, np.empty_like(a)]) for a in (self.start, self.length))
            self.ids[self.used:end] = merged
            self.start[at], self.length[at] = self.used, len(merged)
            self.used, self.number[piece] = end, at

    def _ids(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids up to every piece, and all ids."""
        if len(self.number) >= self.LIMIT or self.used >= self.MOST_IDS:
            self._empty()
        self._learn(dict.fromkeys(p for p in pieces if p not in self.number))
        numbers = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.length[numbers]
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        return upto, self.ids[np.repeat(self.start[numbers] - upto + lengths, lengths) + np.arange(total)]

    def batch(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every text, and all ids."""
        if len(texts) == 1 and texts[0] is not None and len(texts[0]) > PART // 4:
            found = (m.group() for m in self.split.finditer(texts[0]))
            ids = np.concatenate([self._ids(run)[1] for run in iter(lambda: list(itertools.islice(found, self.RUN)), [])])
            return np.array([len(ids)]), ids
        found = [[] if t is None else self.split.findall(t) for t in texts]
        upto, ids = self._ids(list(itertools.chain.from_iterable(found)))
        stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return np.diff(np.concatenate([[0], upto])[stops], prepend=0), ids

    def _merge(self, piece: bytes) -> list[int]:
        """Join the neighbours whose token has the lowest rank, leftmost first, while there are any."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        # Node i stands for the token that starts at byte i; a heap holds the pairs that may join.
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := self.ranks.get(piece[i:end[j]])) is not None:
                heapq.heappush(pairs, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while pairs:
            rank, i, stop = heapq.heappop(pairs)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


def _pieces(digest: str, shared: Broadcast, pattern: str) -> _Pieces:
    """The table of merged pieces of this worker; another vocabulary takes its place."""
    if digest not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[digest] = _Pieces(shared.value, pattern)
    return _KNOWN[digest]


def decode_bpe(spark: SparkSession, ids: Column | str, ranks: Mapping[bytes, int]) -> Column:
    """Ids back to text through the vocabulary, with replacement characters.

    Taking all ids of a batch from the vocabulary lays their bytes out in order; an id
    without an entry is an error.
    """
    known = {i: t for t, i in _checked(ranks).items()}
    shared = spark.sparkContext.broadcast(
        pa.array([known.get(i) for i in range(max(known) + 1)], pa.large_binary()))

    def decode_run(batch: pa.Array) -> pa.Array:
        flat = batch.flatten().to_numpy(zero_copy_only=False)
        table = shared.value
        inside = not len(flat) or (flat.min() >= 0 and flat.max() < len(table))
        tokens = table.take(pa.array(flat)) if inside else None
        if tokens is None or tokens.null_count:
            raise ValueError("an id has no entry in the vocabulary")
        if not len(tokens):
            return _utf8_rows(batch, pa.py_buffer(b""), _row_bounds(batch))
        at = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1)
        return _utf8_rows(batch, tokens.buffers()[2], at[_row_bounds(batch)])

    def decode(batch: pa.Array) -> pa.Array:
        return pa.concat_arrays([decode_run(run) for run in row_parts(batch)] or [pa.array([], pa.string())])

    return F.arrow_udf(decode, "string")(ids)


def token_label(token_id: Column | str, text: Column | None = None) -> Column:
    """Escaped token text cut to 20 characters; ``<token_id>`` where there is no text.

    Control and other characters that do not print are escaped as in a string literal. The
    tables of tokens that are labelled have at most one row per vocabulary entry.
    """
    token_id = F.col(token_id) if isinstance(token_id, str) else token_id
    bare = F.format_string("<token_%d>", token_id)
    if text is None:
        return F.left(bare, F.lit(LABEL_WIDTH))
    escaped = F.arrow_udf(_escaped, "string")(text)
    return F.left(F.coalesce(escaped, bare), F.lit(LABEL_WIDTH))


def _escaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else repr(t)[1:-1] for t in texts.to_pylist()], pa.string())


def tokenizer_label(kind: str) -> Column:
    return F.lit(TOKENIZER_LABELS[kind])
