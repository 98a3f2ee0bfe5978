"""A language model over subword lattices, with the marginal probability of whole documents.

The vocabulary is a public one: its pieces and their scores exist. A word's lattice has an edge
for every piece that spells a part of it, and an edge for the word as one token if training saw
it; the probability of the word is the sum over all paths, by a forward recursion in logs. No
piece reaches across white space, so a document's lattice is that of its words in a row, and its
marginal probability their product with that of the end.

Pieces start from the order that their scores give and are re-estimated on the distinct training
words by expectation-maximisation; whole words get absolutely discounted relative frequencies, and
the discounted mass goes to the paths through pieces. All probabilities of words sum to one.

The word table is as large as the corpus makes it and is never broadcast. Of all words the
``HEAD`` most frequent are; what a document holds beyond them is counted in the task and joined
with the word table by a shuffle. Without the head no word is frequent enough to be a hot key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .words import small_batches, words

HEAD = 65_536
#: Distinct words that a task counts before it hands them on.
TABLE = 200_000
ROUNDS = 3
#: Words that a recursion takes at once: its array steps cost the same for few words as for many.
BATCH = 50_000
#: Words up to this length go through arrays, longer ones through a loop of their own.
ARRAY_LENGTH = 40
_START = "▁"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """Log probabilities (natural) of pieces that start a word, of others, of bytes, and of stopping.

    Starting pieces sum to one; other pieces, bytes and the stop together sum to one.
    """

    start: dict[str, float]
    inner: dict[str, float]
    byte: list[float]
    stop: float


def load_pieces(path: str) -> Pieces:
    """Pieces of a vocabulary file. A score of -r means the r-th most useful piece.

    Control and unknown pieces are left out, and so are pieces with a word start inside them.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    start, inner = {}, {}
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        weight = 1.0 / (50.0 + min(-model.get_score(i), 1e6))
        if piece.startswith(_START) and _START not in piece[1:]:
            start[piece[1:]] = weight
        elif _START not in piece:
            inner[piece] = weight
    start.setdefault("", 1e-6)
    return normalised(start, inner, [1e-6] * 256, sum(inner.values()) / 2)


def normalised(start: dict[str, float], inner: dict[str, float], byte: list[float], stop: float) -> Pieces:
    """Log probabilities from weights; no weight may keep a piece from being used at all."""
    least = 1e-3
    first = sum(start.values()) + least * len(start)
    rest = sum(inner.values()) + sum(byte) + stop + least * (len(inner) + len(byte) + 1)
    return Pieces({p: math.log((w + least) / first) for p, w in start.items()},
                  {p: math.log((w + least) / rest) for p, w in inner.items()},
                  [math.log((w + least) / rest) for w in byte], math.log((stop + least) / rest))


class Lattice:
    """Forward and backward recursions over the words of a batch."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.lengths = sorted({len(p) for p in pieces.inner}), sorted({len(p) for p in pieces.start})
        self.index, self.score = [], []
        for table in (pieces.inner, pieces.start):
            names = list(table)
            keys = np.array([self._key(p) for p in names], np.uint64)
            order = np.argsort(keys)
            self.index.append((keys[order], np.arange(len(names), dtype=np.int32)[order]))
            self.score.append(np.array([table[p] for p in names]))
        self.names = list(pieces.inner), list(pieces.start)
        self.places = tuple({p: i for i, p in enumerate(names)} for names in self.names)
        self.chars: dict[int, tuple[float, bool]] = {}

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_MULTIPLIER)) & (2**64 - 1)
        return h

    def _lookup(self, kind: int, keys: np.ndarray) -> np.ndarray:
        known, ids = self.index[kind]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, ids[at], -1)

    def spelled(self, char: int) -> float:
        """Log probability of a character by its bytes, for those that are no piece; else none."""
        found = self.chars.get(char)
        if found is None:
            text = chr(char)
            if text in self.pieces.inner:
                found = -math.inf
            else:
                found = sum(self.pieces.byte[b] for b in text.encode("utf-8", "surrogateescape"))
            self.chars[char] = found
        return found

    def _edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """From, to, kind, rows and pieces of all edges of words with one length, by their start."""
        length = codes.shape[1]
        longest = self.lengths[0][-1]
        for i in range(length):
            h = np.zeros(len(codes), np.uint64)
            for j in range(i, min(length, i + longest)):
                h = (h + codes[:, j] + np.uint64(1)) * _MULTIPLIER
                for kind in ((0, 1) if i == 0 else (0,)):
                    found = self._lookup(kind, h)
                    rows = np.flatnonzero(found >= 0)
                    if len(rows):
                        yield i, j + 1, kind, rows, found[rows]

    def word_logs(self, found: list[str], counts: tuple[np.ndarray, ...] | None = None,
                  spelled: Counter | None = None) -> np.ndarray:
        """Log probability of each word; with ``counts`` also adds each piece's expected number."""
        out = np.empty(len(found))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(found):
            by_length.setdefault(len(w), []).append(i)
        for length, places in by_length.items():
            if length > ARRAY_LENGTH:
                for i in places:
                    out[i] = self._long_word(found[i], counts, spelled)
                continue
            joined = "".join([found[i] for i in places])
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(places), length)
            out[places] = self._same_length(codes.astype(np.uint64), counts, spelled)
        return out

    def _same_length(self, codes: np.ndarray, counts: tuple[np.ndarray, ...] | None, spelled: Counter | None) -> np.ndarray:
        m, length = codes.shape
        empty = self.pieces.start[""]
        # Node 0 is the start of the word's letters after the lone start piece; ``direct`` holds whole starting pieces.
        forward = np.full((length + 1, m), -np.inf)
        forward[0] = empty
        singles, where = np.unique(codes, return_inverse=True)
        by_bytes = np.array([self.spelled(int(c)) for c in singles])[where.reshape(m, length)]
        edges = list(self._edges(codes))
        at = 0
        for i in range(length):
            while at < len(edges) and edges[at][0] == i:
                _, j, kind, rows, ids = edges[at]
                step = self.score[kind][ids] + (0.0 if kind else forward[i, rows])
                forward[j, rows] = np.logaddexp(forward[j, rows], step)
                at += 1
            forward[i + 1] = np.logaddexp(forward[i + 1], forward[i] + by_bytes[:, i])
        total = forward[length] + self.pieces.stop
        if counts is None:
            return total
        backward = np.full((length + 1, m), -np.inf)
        backward[length] = self.pieces.stop
        at = len(edges) - 1
        for i in range(length - 1, -1, -1):
            backward[i] = backward[i + 1] + by_bytes[:, i]
            while at >= 0 and edges[at][0] == i:
                _, j, kind, rows, ids = edges[at]
                step = self.score[kind][ids] + backward[j, rows]
                if kind:
                    share = np.exp(step - total[rows])
                else:
                    share = np.exp(forward[i, rows] + step - total[rows])
                    backward[i, rows] = np.logaddexp(backward[i, rows], step)
                counts[kind][:] += np.bincount(ids, share, len(counts[kind]))
                at -= 1
            used = np.flatnonzero(np.isfinite(by_bytes[:, i]))
            if len(used):
                share = np.exp(forward[i, used] + by_bytes[used, i] + backward[i + 1, used] - total[used])
                for c, x in zip(codes[used, i].tolist(), share.tolist()):
                    spelled[c] += x
        counts[1][self.places[1][""]] += float(np.exp(forward[0] + backward[0] - total).sum())
        return total

    def _long_word(self, word: str, counts: tuple[np.ndarray, ...] | None = None, spelled: Counter | None = None) -> float:
        """The same recursions for one word of any length."""
        n, p = len(word), self.pieces
        forward = [-math.inf] * (n + 1)
        forward[0] = p.start[""]
        starts = [(length, s) for length in self.lengths[1]
                  if 0 < length <= n and (s := p.start.get(word[:length])) is not None]
        for length, s in starts:
            forward[length] = s
        for i in range(n):
            a = forward[i]
            if a == -math.inf:
                continue
            for length in self.lengths[0]:
                if i + length > n:
                    break
                s = p.inner.get(word[i:i + length])
                if s is not None:
                    forward[i + length] = _log_sum(forward[i + length], a + s)
            s = self.spelled(ord(word[i]))
            if s != -math.inf:
                forward[i + 1] = _log_sum(forward[i + 1], a + s)
        total = forward[n] + p.stop
        if counts is None:
            return total
        backward = [-math.inf] * n + [p.stop]
        for i in range(n - 1, -1, -1):
            a = forward[i] - total
            for length in self.lengths[0]:
                if i + length > n:
                    break
                piece = word[i:i + length]
                s = p.inner.get(piece)
                if s is not None:
                    s += backward[i + length]
                    counts[0][self.places[0][piece]] += math.exp(a + s)
                    backward[i] = _log_sum(backward[i], s)
            s = self.spelled(ord(word[i]))
            if s != -math.inf:
                s += backward[i + 1]
                spelled[ord(word[i])] += math.exp(a + s)
                backward[i] = _log_sum(backward[i], s)
        for length, s in starts:
            counts[1][self.places[1][word[:length]]] += math.exp(s + backward[length] - total)
        counts[1][self.places[1][""]] += math.exp(forward[0] + backward[0] - total)
        return total


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def as_text(word: bytes) -> str:
    return word.decode("utf-8", "surrogateescape")


def word_counts(docs: DataFrame, text: str, train: Column) -> DataFrame:
    """Every distinct word of all documents, how often training documents hold it, and how often all do.

    The end of a document is the empty word. A task adds up its own words before the shuffle.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(f"`{text}`").cast("binary").alias("text"), train.alias("train"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trained = Counter(), Counter()

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()), pa.array([trained[w] for w in total], pa.int64()),
                 pa.array(list(total.values()), pa.int64())], ["word", "c", "n"])
            total.clear()
            trained.clear()
            return out

        for batch in batches:
            for value, learns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(value)
                found.append(b"")
                total.update(found)
                if learns:
                    trained.update(found)
                if len(total) > TABLE:
                    yield table()
        if total:
            yield table()

    return (read.mapInArrow(run, "word binary, c bigint, n bigint")
            .groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))


def fit_pieces(table: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Expectation-maximisation over all distinct training words; each round is one pass.

    What comes back to the driver has a row per piece of the vocabulary at most.
    """
    spark = table.sparkSession
    small_batches(spark, rows=BATCH)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(shared.value)
            counts = np.zeros(len(lattice.names[0])), np.zeros(len(lattice.names[1]))
            spelled: Counter = Counter()
            seen = 0
            for batch in batches:
                found = [as_text(w) for w in batch.column(0).to_pylist()]
                lattice.word_logs(found, counts, spelled)
                seen += len(found)
            kinds, names, values = ["stop"], [""], [float(seen)]
            for kind, name in ((0, "inner"), (1, "start")):
                used = np.flatnonzero(counts[kind])
                kinds += [name] * len(used)
                names += [lattice.names[kind][i] for i in used]
                values += counts[kind][used].tolist()
            for char, x in spelled.items():
                for b in chr(char).encode("utf-8", "surrogateescape"):
                    kinds.append("byte")
                    names.append(str(b))
                    values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(names), pa.array(values)], ["kind", "name", "x"])

        sums = (table.where("c > 0 AND word != X''").select("word").mapInArrow(run, "kind string, name string, x double")
                .groupBy("kind", "name").agg(F.sum("x").alias("x")).collect())
        shared.unpersist()
        got = {(r["kind"], r["name"]): r["x"] for r in sums}
        if not got.get(("stop", "")):
            return pieces
        pieces = normalised({p: got.get(("start", p), 0.0) for p in pieces.start},
                            {p: got.get(("inner", p), 0.0) for p in pieces.inner},
                            [got.get(("byte", str(b)), 0.0) for b in range(256)], got["stop", ""])
    return pieces


@dataclass
class Totals:
    """Sums over the word table: tokens, distinct tokens, ends, distinct words, words seen once and twice."""

    tokens: int
    distinct: int
    ends: int
    types: int
    once: int
    twice: int

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))

    def log10_word(self, c: np.ndarray, lattice_log: np.ndarray) -> np.ndarray:
        """log10 of the sum over the one-token path and all paths through pieces."""
        seen = self.tokens - self.ends
        going_on = math.log1p(-(self.ends + 0.5) / (self.tokens + 1.0))
        if not seen:
            return (lattice_log + going_on) / math.log(10)
        discount = min(max(self.once / (self.once + 2 * self.twice) if self.once else 0.5, 0.1), 0.9)
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(c - discount, 0) / seen)
        parts = math.log(discount * self.types / seen) + lattice_log
        return (np.logaddexp(whole, parts) + going_on) / math.log(10)

    def log10_end(self) -> float:
        return math.log10((self.ends + 0.5) / (self.tokens + 1.0))


def totals(table: DataFrame) -> Totals:
    word = F.col("word") != F.lit(b"")
    row = table.where("c > 0").agg(
        F.sum("c").alias("tokens"), F.count("*").alias("distinct"), F.sum(F.when(~word, F.col("c"))).alias("ends"),
        F.count_if(word).alias("types"), F.count_if(word & (F.col("c") == 1)).alias("once"),
        F.count_if(word & (F.col("c") == 2)).alias("twice")).first()
    return Totals(*[int(x or 0) for x in row])


def scored_words(table: DataFrame, pieces: Pieces, sums: Totals) -> DataFrame:
    """The word table with the model's and the base model's log10 probability of each word."""
    small_batches(table.sparkSession, rows=BATCH)
    shared = table.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            found = batch.column(0).to_pylist()
            c = batch.column(1).to_numpy().astype(float)
            logs = sums.log10_word(c, lattice.word_logs([as_text(w) for w in found]))
            logs[[i for i, w in enumerate(found) if not w]] = sums.log10_end()
            yield batch.append_column("score", pa.array(logs)).append_column("base", pa.array(sums.base(c)))

    return table.mapInArrow(run, "word binary, c bigint, n bigint, score double, base double")


def document_parts(docs: DataFrame, key: str, text: str, held_out: Column, head: dict[bytes, tuple]) -> DataFrame:
    """Per document one row with the sums over frequent words, and one for each other distinct word.

    ``row`` numbers the documents of the stored result, as keys may repeat or be null.
    """
    small_batches(docs.sparkSession)
    index = {w: i for i, w in enumerate(head)}
    values = np.array(list(head.values()) or np.empty((0, 3)), float).reshape(-1, 3)
    shared = docs.sparkSession.sparkContext.broadcast((index, values))
    read = docs.select(F.col(f"`{key}`").alias("key"), held_out.alias("held_out"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values = shared.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, owners, rest, times, sums, sizes = [], [], [], [], [], []
            for i, value in enumerate(batch.column(2).to_pylist()):
                found = words(value)
                found.append(b"")
                at = [index.get(w, -1) for w in found]
                other = Counter([w for w, a in zip(found, at) if a < 0]) if -1 in at else {}
                places = np.array(at)
                sums.append(values[places[places >= 0]].sum(axis=0))
                sizes.append(len(found))
                rows += [number + i] * (1 + len(other))
                owners += [i] + [None] * len(other)
                rest += [None, *other]
                times += [1, *other.values()]
            number += batch.num_rows
            take = pa.array(owners, pa.int32())
            table = np.array(sums).reshape(-1, 3)
            columns = [pa.array(rows, pa.int64()), batch.column(0).take(take), batch.column(1).take(take),
                       pa.array(rest, pa.binary()), pa.array(times, pa.int64()), pa.array(sizes, pa.int64()).take(take)]
            columns += [pa.array(table[:, k]).take(take) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = T.StructType([T.StructField("row", T.LongType())])
    for name, kind in (("key", read.schema["key"].dataType), ("held_out", T.BooleanType()),
                       ("word", T.BinaryType()),
                       ("times", T.LongType()), ("tokens", T.LongType()), ("known", T.DoubleType()),
                       ("score", T.DoubleType()), ("base", T.DoubleType())):
        fields.add(name, kind)
    names = fields.names
    return read.mapInArrow(run, fields)


def score_documents(docs: DataFrame, key: str, text: str, train: Column, vocabulary: str) -> DataFrame:
    """One row per document: ``held_out`` (not ``train``), ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, both log10.

    Tokens are the words of the text, A-Z lower-cased, and one end. The base model is add-one
    smoothing over the training tokens. A null or empty text is an end alone. Repeated rows are
    documents of their own; a null ``train`` counts as false. Other columns are not read. Without
    training documents only the paths through pieces are left. An empty table gives an empty result.
    """
    train = F.coalesce(train, F.lit(False))
    table = written(word_counts(docs, text, train), "words")
    sums = totals(table)
    pieces = fit_pieces(table, load_pieces(vocabulary))
    scored = written(scored_words(table, pieces, sums), "scored")
    top = scored.orderBy(F.desc("n"), "word").limit(HEAD).select("word", (F.col("c") > 0).cast("int").alias("known"), "score", "base")
    head = {bytes(r["word"]): (r["known"], r["score"], r["base"]) for r in top.collect()}
    parts = written(document_parts(docs, key, text, ~train, head), "parts")
    whole = parts.where("word IS NULL").select("row", "key", "held_out", "tokens", "known", "score", "base")
    rare = parts.where("word IS NOT NULL").select("row", "word", "times").join(
        scored.select("word", "c", F.col("score").alias("s"), F.col("base").alias("b")), "word")
    added = rare.select(
        "row", F.lit(None).cast(whole.schema["key"].dataType).alias("key"), F.lit(None).cast("boolean").alias("held_out"),
        F.lit(None).cast("bigint").alias("tokens"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).cast("double").alias("known"),
        (F.col("times") * F.col("s")).alias("score"), (F.col("times") * F.col("b")).alias("base"))
    return (whole.unionByName(added).groupBy("row").agg(
                F.max(F.struct(F.col("tokens").isNotNull().alias("own"), "key", "held_out", "tokens")).alias("doc"),
                F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
            .select(F.col("doc.key").alias(key), F.col("doc.held_out").alias("held_out"), F.col("doc.tokens").alias("n_tokens"),
                    F.col("known").cast("bigint").alias("n_known"), F.lit(sums.tokens).cast("bigint").alias("train_tokens"),
                    F.col("base").alias("base_score"), F.col("score")))
