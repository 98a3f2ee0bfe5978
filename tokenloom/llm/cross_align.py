"""Where the tokens of two tokenizers end together, and how often their ids overlap.

Both tokenizers cut the same bytes (a blank and the text), so a token is known by the byte
where it ends. The common ends are found by galloping: each end of the shorter list starts
at its proportional place in the longer one, goes on in doubling steps until it is enclosed,
and is then found by halving; all ends of a batch take their steps together. Common ends
slice both lists into groups, and the difference of two ranks is the range of tokens that one
token overlaps.

Counts of id pairs are corpus-wide, so there are two passes. The first encodes and aligns a
batch of texts and stores it as one row, a *pack*: the documents' results, the distinct pairs
of the pack with their counts, and every link as the number of its pair. Only distinct pairs
are summed and looked up; the second pass reads the packs with the sums of their pairs.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .forced_bpe import byte_letters
from .words import small_batches

#: Characters after which a very long text is encoded in parts.
STRETCH = 1 << 18
#: A single blank between other characters: no token of either tokenizer holds its left side and itself.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PAIRS: dict[str, TokenizerPair] = {}


def load_byte_bpe(path: str) -> dict:
    """Rank and name of every token of a byte-level BPE file, without its special tokens.

    Refused are files whose merges are not ranked by the ids that they make, as the encoder
    takes the id for the rank.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    special = {t["content"] for t in spec["added_tokens"]}
    names = {n: i for n, i in model["vocab"].items() if n not in special}
    made = [names["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if (model["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"]
            or not split["use_regex"] or model["dropout"] or model["unk_token"] or model["byte_fallback"]
            or made != sorted(made) or sorted(names.values()) != list(range(len(names)))):
        raise ValueError("vocabulary file of an unsupported kind")
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    return {bytes(byte_of[c] for c in name): i for name, i in names.items()}


class TokenizerPair:
    """Both encoders, and the bytes of their tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = [t for t, _ in sorted(ranks.items(), key=lambda r: r[1])]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_length = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)
        #: Decimal ids with what follows them: inside a side, after side A, after a group.
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.names = [b"%d%s" % (i, mark) for size, marks in ((n, (b",", b"|")), (m, (b",", b";"))) for mark in marks for i in range(size)]
        # Cutting at blanks is exact as long as no piece holds a blank behind anything else.
        if any("▁" in p.lstrip("▁") for p in map(self.b.id_to_piece, range(m))):
            raise ValueError("pieces that hold a blank inside are not supported")

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: Sequence[bytes | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every text. None where either side does not spell out a blank and the text."""
        parts, sizes = [], []
        for text in texts:
            try:
                found = list(_stretches((text or b"").decode()))
            except UnicodeDecodeError:
                found = []
            parts += found
            sizes.append(len(found))
        encode = self.a.encode_ordinary
        left = [encode(" " + p) for p in parts]
        right = self.b.encode(parts, num_threads=1)
        a, b, at = [], [], 0
        for text, size in zip(texts, sizes):
            # Without a text, or with characters that a side spells differently, there are no tokens.
            x = [i for p in left[at:at + size] for i in p] if size != 1 else left[at]
            y = [i for p in right[at:at + size] for i in p] if size != 1 else right[at]
            at += size
            wanted = b" " + (text or b"")
            same = text and b"".join(map(self.a_bytes.__getitem__, x)) == wanted == b"".join(map(self.b_bytes.__getitem__, y))
            a.append(np.array(x if same else [], np.int64))
            b.append(np.array(y if same else [], np.int64))
        return a, b


def _stretches(text: str) -> Iterator[str]:
    """Parts of a text, cut at single blanks (which belong to no part)."""
    at = 0
    while text and at <= len(text):
        cut = _CUT.search(text, at + STRETCH) if len(text) - at > STRETCH else None
        yield text[at:cut.start() if cut else len(text)]
        if not cut:
            return
        at = cut.end()


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every value of ``short`` how many values of the rising ``long`` are below it, sought from ``start`` on."""
    n = len(long)
    low, high = start - 1, start.copy()
    inside = start < n
    below = np.zeros(len(short), bool)
    below[inside] = long[start[inside]] < short[inside]
    # Upwards: low is below the value. Downwards: high is not.
    low[below], high[below] = start[below], start[below] + 1
    step = np.ones(len(short), np.int64)
    rising, falling = np.flatnonzero(below), np.flatnonzero(~below)
    while len(rising):
        rising = rising[high[rising] < n]
        rising = rising[long[high[rising]] < short[rising]]
        low[rising] = high[rising]
        high[rising] += step[rising]
        step[rising] *= 2
    while len(falling):
        falling = falling[low[falling] >= 0]
        falling = falling[long[low[falling]] >= short[falling]]
        high[falling] = low[falling]
        low[falling] -= step[falling]
        step[falling] *= 2
    np.maximum(low, -1, out=low)
    np.minimum(high, n, out=high)
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        right = long[middle] < short[open_]
        low[open_[right]] = middle[right]
        high[open_[~right]] = middle[~right]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


@dataclass
class Alignment:
    """Token lists of a batch, one text after the other; all arrays speak of the whole batch."""

    #: Whether a token's end is common.
    a_common: np.ndarray
    b_common: np.ndarray
    #: Links as numbers of tokens, ordered by text.
    link_a: np.ndarray
    link_b: np.ndarray
    n_links: np.ndarray


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def align(a_length: np.ndarray, b_length: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Alignment:
    """Align texts given the byte lengths of their tokens and the number of tokens of each text.

    A text has the same bytes on both sides, or no tokens at all.
    """
    ends = np.cumsum(a_length), np.cumsum(b_length)
    common = np.zeros(len(a_length), bool), np.zeros(len(b_length), bool)
    counts = n_a, n_b
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_links = np.zeros(len(n_a), np.int64)
    # The shorter list of a text drives; texts are taken by which one that is.
    for s, texts in ((0, n_a <= n_b), (1, n_a > n_b)):
        o = 1 - s
        mine = np.flatnonzero(np.repeat(texts, counts[s]))
        other = np.flatnonzero(np.repeat(texts, counts[o]))
        short, long = ends[s][mine], ends[o][other]
        ns, no = counts[s][texts], counts[o][texts]
        place = np.arange(len(mine)) - np.repeat(_ends(ns), ns)
        start = np.repeat(_ends(no), ns) + place * np.repeat(no, ns) // np.maximum(np.repeat(ns, ns), 1)
        rank = gallop(short, long, start)
        same = long[rank] == short if len(long) else np.zeros(0, bool)
        common[s][mine[same]] = True
        common[o][other[rank[same]]] = True
        # A token overlaps from the first end behind its start up to the first end not before its own.
        first = np.concatenate([[0], (rank + same)[:-1]]) if len(rank) else rank
        n = rank - first + 1
        partner = np.repeat(first - _ends(n), n) + np.arange(int(n.sum()))
        pair = np.repeat(mine, n), other[partner]
        owner = np.repeat(np.flatnonzero(texts), ns)
        n_links += np.bincount(owner, n, len(n_a)).astype(np.int64)
        links.append((np.repeat(owner, n), *(pair if s == 0 else pair[::-1])))
    text = np.concatenate([x[0] for x in links])
    turn = np.argsort(text, kind="stable")
    return Alignment(*common, np.concatenate([x[1] for x in links])[turn], np.concatenate([x[2] for x in links])[turn], n_links)


def group_names(pair: TokenizerPair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray,
                found: Alignment) -> list[bytes]:
    """Groups of every text, written as ``a1,a2|b1;a3|b2,b3``."""
    sizes = len(pair.a_bytes), len(pair.b_bytes)
    # A group's ids of A stand before its ids of B, behind all earlier groups of both.
    group_a = np.cumsum(found.a_common) - found.a_common
    group_b = np.cumsum(found.b_common) - found.b_common
    upto_a, upto_b = np.flatnonzero(found.a_common) + 1, np.flatnonzero(found.b_common) + 1
    named = np.empty(len(a) + len(b), np.int64)
    named[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = a + found.a_common * sizes[0]
    named[np.arange(len(b)) + upto_a[group_b]] = b + 2 * sizes[0] + found.b_common * sizes[1]
    listed = named.tolist()
    stops = np.cumsum(n_a + n_b).tolist()
    names = pair.names.__getitem__
    return [b"".join(map(names, listed[i:j]))[:-1] for i, j in zip([0, *stops], stops)]


class _Batch:
    """Encoded and aligned texts of an Arrow batch."""

    def __init__(self, pair: TokenizerPair, texts: Sequence[bytes | None]):
        left, right = pair.encode(texts)
        self.n_a, self.n_b = (np.array(list(map(len, side)), np.int64) for side in (left, right))
        self.a, self.b = (np.concatenate([np.empty(0, np.int64), *side]) for side in (left, right))
        self.found = align(pair.a_length[self.a], pair.b_length[self.b], self.n_a, self.n_b)

    def n_groups(self) -> np.ndarray:
        texts = np.repeat(np.arange(len(self.n_a)), self.n_a)
        return np.bincount(texts, self.found.a_common, len(self.n_a)).astype(np.int64)


def _shared_pair(digest: str, shared) -> TokenizerPair:
    """The encoders of this Python process; built once and used by all its tasks."""
    if digest not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[digest] = TokenizerPair(*shared.value)
    return _PAIRS[digest]


def _sent(df: DataFrame, a_path: str, pattern: str, b_path: str):
    """Both vocabularies, read on the driver: their size is fixed by the tokenizers."""
    with open(b_path, "rb") as file:
        model = file.read()
    ranks = load_byte_bpe(a_path)
    digest = hashlib.sha256(b"".join([*ranks, pattern.encode(), model])).hexdigest()
    return digest, df.sparkSession.sparkContext.broadcast((ranks, pattern, model))


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    # Tokens and links of a batch take some hundred times its text.
    small_batches(docs.sparkSession, size=1 << 20)
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))


def alignments(docs: DataFrame, key: str, text: str, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """Per document its key, the ids of both tokenizers and where groups end in them.

    ``a_ends`` and ``b_ends`` list, group by group, how many ids of each side have passed. A text that
    is null, empty or not spelled out by both sides has no ids. Rows stay as they are; narrow.
    """
    rows = _read(docs, key, text)
    digest, shared = _sent(docs, a_path, pattern, b_path)
    names = ("a_ids", "b_ids", "a_ends", "b_ends")
    fields = T.StructType([rows.schema["key"], *[T.StructField(n, T.ArrayType(T.LongType())) for n in names]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _Batch(_shared_pair(digest, shared), batch.column("text").to_pylist())
            cut = [np.split(x, np.cumsum(n)[:-1]) for x, n in (
                (made.a, made.n_a), (made.b, made.n_b), (made.found.a_common, made.n_a), (made.found.b_common, made.n_b))]
            cut[2:] = [[np.flatnonzero(c) + 1 for c in side] for side in cut[2:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(side, pa.list_(pa.int64())) for side in cut]], ["key", *names])

    return rows.mapInArrow(run, fields).withColumnRenamed("key", key)


def _packs(rows: DataFrame, digest: str, shared) -> DataFrame:
    """One row per Arrow batch of texts."""
    kinds = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string"}
    doc = T.StructType([rows.schema["key"], *[T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items()]])
    fields = T.StructType([
        T.StructField("pack", T.LongType()), T.StructField("docs", T.ArrayType(doc)), T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _shared_pair(digest, shared)
        first = TaskContext.get().partitionId() << 32
        for turn, batch in enumerate(batches):
            made = _Batch(pair, batch.column("text").to_pylist())
            names = group_names(pair, made.a, made.b, made.n_a, made.n_b, made.found)
            links = made.a[made.found.link_a] << 32 | made.b[made.found.link_b]
            pairs, which, counts = np.unique(links, return_inverse=True, return_counts=True)
            docs = pa.StructArray.from_arrays(
                [batch.column("key"), pa.array(made.n_a), pa.array(made.n_b), pa.array(made.n_groups()), pa.array(made.found.n_links),
                 pa.array([hashlib.sha256(n).hexdigest() if n else "" for n in names])], ["key", *kinds])

            def one(values, kind=None):
                flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
                return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

            # Halves of the numbers apart: the upper ones are nearly all zero.
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + turn]), one(docs), one(pairs, pa.int64()), one(counts, pa.int64()),
                 pa.array([(which & 0xFFFF).astype("<u2").tobytes()], pa.binary()), pa.array([(which >> 16).astype("<u2").tobytes()], pa.binary())],
                ["pack", "docs", "pairs", "counts", "low", "high"])

    return rows.mapInArrow(run, fields)


def link_counts(docs: DataFrame, key: str, text: str, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """Per document its key, ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256``, ``n_links``, ``n_best``, ``count_sum``.

    A link is a pair of overlapping token occurrences, an id pair's count its links in all documents.
    ``n_best`` counts links whose count is the highest of their B id, ties included; ``count_sum`` adds
    all links' counts. Texts that are null, empty or not spelled out by both sides have zeros and an
    empty digest. Rows, repeated ones too, stay; null keys stay null; other columns are not read. An
    empty table gives an empty result.
    """
    rows = _read(docs, key, text)
    packs = written(_packs(rows, *_sent(docs, a_path, pattern, b_path)), "packs")
    listed = packs.select("pack", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "e")).select(
        "pack", "at", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n"))
    # One row per pack and distinct pair, so even the commonest pair has as many rows as there are packs.
    summed = written(listed.select("pack", "at", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"),
                                   F.sum("n").over(Window.partitionBy("pair")).alias("total")), "pairs")
    # One row per id of tokenizer B.
    top = summed.groupBy("b").agg(F.max("total").alias("top"))
    rated = (summed.join(F.broadcast(top), "b").groupBy("pack")
             .agg(F.sort_array(F.collect_list(F.struct("at", "total", (F.col("total") == F.col("top")).alias("best")))).alias("rated")))
    both = packs.select("pack", "docs", "low", "high").join(rated, "pack", "left").select(
        "docs", "low", "high", F.coalesce(F.col("rated.total"), F.array().cast("array<bigint>")).alias("total"),
        F.coalesce(F.col("rated.best"), F.array().cast("array<boolean>")).alias("best"))
    doc = packs.schema["docs"].dataType.elementType
    fields = T.StructType([*doc.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                docs = one.column("docs").flatten()
                which = (np.frombuffer(one.column("low")[0].as_py(), "<u2").astype(np.int64)
                         | np.frombuffer(one.column("high")[0].as_py(), "<u2").astype(np.int64) << 16)
                total = one.column("total").flatten().to_numpy()
                best = one.column("best").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                stops = np.cumsum(docs.field("n_links").to_numpy())

                def per_doc(values):
                    upto = np.concatenate([[0], np.cumsum(values[which])])[stops]
                    return pa.array(np.diff(upto, prepend=0), pa.int64())

                yield pa.RecordBatch.from_arrays([*docs.flatten(), per_doc(best), per_doc(total)], fields.names)

    return both.mapInArrow(run, fields).withColumnRenamed("key", key)
