"""Benchmark passages in training documents, found through suffix arrays of the training text.

Training words are numbered by the benchmark's vocabulary; a word that no item has ends a
suffix, as no item can match across it. Every shard (a stretch of documents in one task) sorts
the suffixes of its numbered words, by prefix doubling, as deep as the longest item, and each
suffix of the benchmark is binary-searched in it. The range of suffixes that share its first
words gives all occurrences of a window, the neighbours of its place its longest verbatim match.

A pass over the documents is narrow: a shard's suffix array lives in the task that reads the
shard, and every document's marks come from there. The benchmark is broadcast in blocks of at
most ``BLOCK_BYTES`` of text (or one item); with more blocks than one, passes follow each other
and carry the marks on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import running_sums
from .words import small_batches

#: Words of a window.
WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Positions whose suffixes are sorted together; longer stretches overlap by the longest item.
SHARD = 2_000_000
#: Bytes that are split into words at a time.
PIECE = 1 << 20
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text, a stretch at a time: runs of ASCII letters (lower-cased), digits and all beyond ASCII."""
    plain = (text or b"").translate(_LETTERS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


@dataclass
class Benchmark:
    """A block of items as numbers."""

    ids: list[str | None]
    vocabulary: dict[bytes, int]
    #: Codes of all items, one after the other; a pattern is a start in them and a number of words.
    codes: np.ndarray
    #: Distinct windows, and the items of window k: ``items[first[k]:first[k + 1]]``.
    window_at: np.ndarray
    width: np.ndarray
    first: np.ndarray
    items: np.ndarray
    #: Suffixes at least as long as their item's window: start, words to the item's end, item, place in it.
    suffix_at: np.ndarray
    length: np.ndarray
    item: np.ndarray
    place: np.ndarray
    longest: int


def numbered(rows: list[tuple[str | None, bytes | None]], window: int) -> Benchmark:
    """A block of benchmark items; items without words have no windows."""
    split = [[w for part in pieces(text) for w in part] for _, text in rows]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}), 1)}
    codes = np.array([vocabulary[w] for ws in split for w in ws], np.int32)
    starts = np.cumsum([0, *map(len, split)])
    owners: dict[bytes, set[int]] = {}
    where: dict[bytes, tuple[int, int]] = {}
    suffixes = []
    for item, ws in enumerate(split):
        least = min(window, len(ws))
        for at in range(len(ws) - least + 1 if ws else 0):
            start = int(starts[item]) + at
            name = codes[start:start + least].tobytes()
            where.setdefault(name, (start, least))
            owners.setdefault(name, set()).add(item)
            suffixes.append((start, len(ws) - at, item, at))
    windows = np.array(list(where.values()), np.int64).reshape(-1, 2)
    listed = np.array(suffixes, np.int64).reshape(-1, 4)
    return Benchmark([r[0] for r in rows], vocabulary, codes, windows[:, 0], windows[:, 1],
                     np.cumsum([0, *(len(owners[w]) for w in where)]),
                     np.array([i for w in where for i in sorted(owners[w])], np.int64),
                     *listed.T, max(map(len, split), default=0))


def suffix_array(codes: np.ndarray, n: int, bits: int, depth: int) -> np.ndarray:
    """Positions below ``n`` with a code, sorted by the codes that follow up to the first zero.

    ``codes`` may go on beyond ``n``; positions there are no suffixes but part of them. The order
    is exact for the first ``depth`` codes; suffixes equal so far are in any order.
    """
    padded = np.concatenate([codes, np.zeros(depth + 64, codes.dtype)])
    total = len(codes)
    per_key = max(1, min(63 // bits, depth))
    alive = padded[:total] > 0
    key = padded[:total].astype(np.int64)
    for j in range(1, per_key):
        following = padded[j:j + total]
        alive = alive & (following > 0)
        key = (key << bits) | np.where(alive, following, 0)
    # All positions are ranked, as suffixes look past n; those below n are returned.
    order = np.flatnonzero(padded[:total] > 0)
    order = order[np.argsort(key[order])]
    sorted_key = key[order]
    count = len(order)
    starts = np.ones(count, bool)
    starts[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.maximum.accumulate(np.where(starts, np.arange(count), 0))
    rank = np.zeros(total + depth + 64, np.int64)
    rank[order] = group + 1
    tied = ~starts
    tied[:-1] |= ~starts[1:]
    active = np.flatnonzero(tied & ((sorted_key & ((1 << bits) - 1)) > 0))
    width = per_key
    while width < depth and len(active):
        places = order[active]
        second = rank[places + width]
        turn = np.lexsort((second, rank[places]))
        places, second = places[turn], second[turn]
        first = rank[places]
        order[active] = places
        starts = np.ones(len(active), bool)
        starts[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[places] = active[np.maximum.accumulate(np.where(starts, np.arange(len(active)), 0))] + 1
        tied = ~starts
        tied[:-1] |= ~starts[1:]
        # Suffixes that have both ended are equal for good.
        active = active[tied & (second > 0)]
        width *= 2
    return order[order < n] if n < total else order


def _compared(codes: np.ndarray, places: np.ndarray, wanted: np.ndarray, at: np.ndarray,
              width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of the suffix at each place against the pattern at ``wanted[at:at + width]``, and how many codes they share."""
    sign = np.zeros(len(places), np.int8)
    shared = np.zeros(len(places), np.int64)
    open_ = np.flatnonzero(width > 0)
    j = 0
    while len(open_):
        a, b = codes[places[open_] + j], wanted[at[open_] + j]
        same = a == b
        sign[open_[~same]] = np.where(a[~same] < b[~same], -1, 1)
        open_ = open_[same]
        j += 1
        shared[open_] = j
        open_ = open_[width[open_] > j]
    return sign, shared


def bounds(codes: np.ndarray, order: np.ndarray, wanted: np.ndarray, at: np.ndarray, width: np.ndarray,
           above: bool) -> np.ndarray:
    """First place in the suffix array whose suffix is not below (or, with ``above``, is above) each pattern."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while len(todo := np.flatnonzero(low < high)):
        middle = (low[todo] + high[todo]) >> 1
        sign, _ = _compared(codes, order[middle], wanted, at[todo], width[todo])
        right = sign <= 0 if above else sign < 0
        low[todo[right]] = middle[right] + 1
        high[todo[~right]] = middle[~right]
    return low


class Shard:
    """Documents of one Arrow batch as numbers, with the suffix arrays of their stretches."""

    def __init__(self, texts: list[bytes | None], benchmark: Benchmark):
        self.benchmark = benchmark
        get = benchmark.vocabulary.get
        parts, sizes = [], []
        for text in texts:
            found = [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)) for words in pieces(text)]
            sizes.append(sum(map(len, found)))
            parts += [*found, _END]
        self.sizes = np.array(sizes, np.int64)
        #: Every document ends with a zero, so that nothing matches from one into the next.
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.codes = np.concatenate([*parts, np.zeros(benchmark.longest + 1, np.int32)])
        self.bits = max(1, len(benchmark.vocabulary).bit_length())

    def stretches(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Start, codes and suffix array of every stretch."""
        deep = self.benchmark.longest
        for at in range(0, len(self.codes), SHARD):
            codes = self.codes[at:at + SHARD + deep]
            order = suffix_array(codes, min(SHARD, len(codes)), self.bits, deep)
            yield at, np.concatenate([codes, np.zeros(deep + 1, np.int32)]), order

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a window stands, and the window."""
        b = self.benchmark
        places, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, codes, order in self.stretches():
            low = bounds(codes, order, b.codes, b.window_at, b.width, False)
            some = np.flatnonzero(low < len(order))
            sign, _ = _compared(codes, order[low[some]], b.codes, b.window_at[some], b.width[some])
            some = some[sign == 0]
            n = bounds(codes, order, b.codes, b.window_at[some], b.width[some], True) - low[some]
            base = np.repeat(low[some] - np.cumsum(n) + n, n)
            places.append(order[base + np.arange(int(n.sum()))] + at)
            which.append(np.repeat(some, n))
        return np.concatenate(places), np.concatenate(which)

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def marks(self) -> tuple[list[np.ndarray], list[set[str]]]:
        """Per document which words are hit, and the ids of the items whose windows occur."""
        b = self.benchmark
        places, which = self.occurrences()
        change = np.zeros(len(self.codes) + 1, np.int32)
        np.add.at(change, places, 1)
        np.add.at(change, places + b.width[which], -1)
        hit = np.cumsum(change[:-1]) > 0
        masks = [hit[a:a + n] for a, n in zip(self.starts, self.sizes)]
        found: list[set[str]] = [set() for _ in masks]
        pairs = np.unique(self.document_of(places) * len(b.window_at) + which)
        for pair in pairs.tolist():
            document, window = divmod(pair, len(b.window_at))
            names = (b.ids[i] for i in b.items[b.first[window]:b.first[window + 1]].tolist())
            found[document].update(n for n in names if n is not None)
        return masks, found

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that share words with this shard, how many at most, and a position of those."""
        b = self.benchmark
        best, where = np.zeros(len(b.suffix_at), np.int64), np.zeros(len(b.suffix_at), np.int64)
        for at, codes, order in self.stretches():
            if not len(order):
                continue
            # The neighbours of a suffix's place share the most with it.
            low = bounds(codes, order, b.codes, b.suffix_at, b.length, False)
            for beside in (low - 1, low):
                place = order[np.clip(beside, 0, len(order) - 1)]
                _, shared = _compared(codes, place, b.codes, b.suffix_at, b.length)
                more = shared > best
                best[more], where[more] = shared[more], place[more] + at
        kept = np.flatnonzero(best)
        return kept, best[kept], where[kept]


_END = np.zeros(1, np.int32)


def _benchmark_blocks(items: DataFrame, item: str, text: str, window: int):
    """Broadcast blocks of the benchmark, one at a time. Blocks follow the running size of the texts."""
    context = items.sparkSession.sparkContext
    rows = items.select(F.col(f"`{item}`").cast("string").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    sized = running_sums(rows.where(F.octet_length("text") > 0), ["id", "text"], {"at": F.octet_length("text").cast("bigint")})
    blocks = sized.select("id", "text", F.expr(f"at div {BLOCK_BYTES}").alias("block"))
    for number, in blocks.select("block").distinct().orderBy("block").collect():
        found = blocks.where(F.col("block") == number).select("id", "text").toArrow()
        yield context.broadcast(numbered(list(zip(found["id"].to_pylist(), found["text"].to_pylist())), window))


def _merged(old: bytes, new: np.ndarray) -> bytes:
    return (np.packbits(new) | np.frombuffer(old, np.uint8)).tobytes() if old else np.packbits(new).tobytes()


def marked(docs: DataFrame, text: str, items: DataFrame, item: str = "item_id", item_text: str = "text", *,
           window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` in ``_row``, with ``n_words``, ``n_hit`` and ``items``.

    A window is ``window`` consecutive words of an item, or all words of a shorter item. ``n_hit``
    counts the document's words inside any occurrence of a window, ``items`` lists the ids (as text,
    sorted) of the items with such windows. Null and empty texts have no words; items without words
    are ignored; rows of one id are one item; an item without an id hits words but is not listed.
    Repeated documents are marked each. Without items nothing is hit.
    """
    small_batches(docs.sparkSession, rows=4000)
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("_row"), F.col(f"`{text}`").cast("binary").alias("_text"),
                       F.lit(b"").alias("_hits"), F.array().cast("array<string>").alias("items"),
                       F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"))
    blocks = list(_benchmark_blocks(items, item, item_text, window)) or [
        docs.sparkSession.sparkContext.broadcast(numbered([], window))]
    for block in blocks:
        rows = rows.mapInArrow(_marking(block), rows.schema)
    return rows.select("_row", "n_words", "n_hit", "items")


def _marking(block):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = Shard(batch.column("_text").to_pylist(), block.value)
            masks, found = shard.marks()
            hits = [_merged(old, new) for old, new in zip(batch.column("_hits").to_pylist(), masks)]
            items = [sorted(ids.union(old)) for ids, old in zip(found, batch.column("items").to_pylist())]
            counts = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_text"), pa.array(hits, pa.binary()),
                 pa.array(items, pa.list_(pa.string())), pa.array(shard.sizes), pa.array(counts, pa.int64())],
                ["_row", "_text", "_hits", "items", "n_words", "n_hit"])

    return run


def decontaminated(docs: DataFrame, text: str, items: DataFrame, item: str = "item_id", item_text: str = "text", *,
                   window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    return marked(docs, text, items, item, item_text, window=window).where("n_hit = 0").select("_row.*")


def longest_matches(docs: DataFrame, key: str, text: str, items: DataFrame, item: str = "item_id", item_text: str = "text", *,
                    window: int = WINDOW) -> DataFrame:
    """For every benchmark suffix its longest verbatim match among all documents.

    Of rows with one id the longest counts. Rows: ``item_id`` (as text), ``item_at`` (the word where the suffix starts), ``n_words`` shared,
    and one place where they stand: the key of the document (the smallest of several, null last) and
    ``doc_at``, the word there. Suffixes shorter than a window, and those whose first word no document
    has, have no row. Every shard reports one match per suffix; the best of all shards is kept.
    """
    small_batches(docs.sparkSession, rows=4000)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    fields = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_at", T.LongType()),
                           T.StructField("n_words", T.LongType()), rows.schema["key"], T.StructField("doc_at", T.LongType())])
    all_ = None
    for block in _benchmark_blocks(items, item, item_text, window):
        found = rows.mapInArrow(_longest(block), fields)
        all_ = found if all_ is None else all_.unionAll(found)
    if all_ is None:
        return docs.sparkSession.createDataFrame([], T.StructType([
            *fields[:3], T.StructField(key, fields["key"].dataType), fields["doc_at"]]))
    order = F.struct(F.col("n_words").alias("n"), F.col("key").isNotNull().alias("named"))
    best = all_.groupBy("item_id", "item_at").agg(F.max(order).alias("best"))
    held = all_.join(best.select(F.col("item_id").alias("i"), F.col("item_at").alias("a"), "best"),
                     F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_at") == F.col("a"))
                     & (F.col("n_words") == F.col("best.n")) & (F.col("key").isNotNull() == F.col("best.named")))
    return (held.groupBy("item_id", "item_at", "n_words").agg(F.min(F.struct("key", "doc_at")).alias("at"))
            .select("item_id", "item_at", "n_words", F.col("at.key").alias(key), "at.doc_at"))


def _longest(block):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            shard = Shard(batch.column("text").to_pylist(), b)
            suffix, shared, places = shard.longest()
            document = shard.document_of(places)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.ids[i] for i in b.item[suffix]], pa.string()), pa.array(b.place[suffix]), pa.array(shared),
                 batch.column("key").take(pa.array(document, pa.int64())), pa.array(places - shard.starts[document])],
                ["item_id", "item_at", "n_words", "key", "doc_at"])

    return run
