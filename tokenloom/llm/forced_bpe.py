"""BPE encoding that first cuts where no merge can reach, and the way back from ids.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up in
one token, so the text between two such pairs encodes on its own. White space occurs in
no token at all; inside a word the table of pairs marks further cuts. Words repeat far
more often than texts, so each is merged once per worker and looked up from then on.

The vocabulary file is read once on the driver and broadcast: its size is fixed by the
tokenizer, not by the corpus. Supported are the files of the tokenizers library with a BPE
model over byte letters, an end-of-word suffix, the normalizers and the pre-tokenizer
pattern found in them, and no decoder (tokens are joined by blanks).
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import small_batches

#: Words and chunks kept in a worker; a table is emptied when it is full.
CACHE_ENTRIES = 500_000
#: Rank of a pair that is never merged.
_NEVER = 1 << 62
#: Longest chunk that is kept.
CACHE_CHARS = 64
#: Encoded vocabularies of this Python process, by broadcast id.
_CODERS: dict[int, Coder] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary.

    Printable Latin-1 bytes stand for themselves, all others for U+0100 upwards.
    """
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What the coder needs of a vocabulary file, after checks that its parts are supported."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, steps = spec["model"], spec["normalizer"]["normalizers"]
    split, letters = spec["pre_tokenizer"]["pretokenizers"]
    if (model["type"] != "BPE" or not model["end_of_word_suffix"] or model["byte_fallback"]
            or model["continuing_subword_prefix"] or model["dropout"] or spec["decoder"]
            or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]
            or split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed"
            or letters["type"] != "ByteLevel" or letters["add_prefix_space"] or letters["use_regex"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])):
        raise ValueError("vocabulary file of an unsupported kind")
    return {
        "vocab": model["vocab"], "merges": [tuple(m) for m in model["merges"]],
        "suffix": model["end_of_word_suffix"], "pattern": split["pattern"]["Regex"],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class Coder:
    """Encodes and decodes with one vocabulary; keeps what it has merged."""

    def __init__(self, spec: dict):
        self.vocab, self.suffix = spec["vocab"], spec["suffix"]
        # Merges on numbers: a pair as one integer, its rank, and the token that a rank makes.
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(spec["merges"]):
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.letters = dict(enumerate(byte_letters()))
        self.words = regex.compile(spec["pattern"])
        self.special = spec["special"]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.names = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for name, number in {**self.vocab, **self.special}.items():
            self.names[number] = name
        inside = set()
        for token in self.vocab:
            plain = token.removesuffix(self.suffix)
            inside.update(map("".join, itertools.pairwise(plain)))
        self.inside = inside
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def cut(self, letters: str) -> list[str]:
        """Fragments of one word: cut wherever two letters occur together in no token."""
        places = [i for i, pair in enumerate(map("".join, itertools.pairwise(letters)), 1) if pair not in self.inside]
        return [letters[i:j] for i, j in zip([0, *places], [*places, len(letters)])]

    def _start(self, fragment: str, ends: bool) -> list[int]:
        """Token of every letter. A letter without one is left out, as without an unknown token."""
        letters = list(fragment)
        if ends:
            letters[-1] += self.suffix
        return [self.vocab[letter] for letter in letters if letter in self.vocab]

    def _merged(self, fragment: str, ends: bool) -> bytes:
        """Ids of one fragment: lowest rank first, leftmost of equals, as the merges were learned."""
        parts = self._start(fragment, ends)
        ranks, made = self.ranks, self.made
        found = [ranks.get(a << 32 | b, _NEVER) for a, b in itertools.pairwise(parts)]
        while found and (least := min(found)) != _NEVER:
            i = found.index(least)
            parts[i:i + 2] = [made[least]]
            del found[i]
            if i:
                found[i - 1] = ranks.get(parts[i - 1] << 32 | parts[i], _NEVER)
            if i < len(found):
                found[i] = ranks.get(parts[i] << 32 | parts[i + 1], _NEVER)
        return struct.pack(f"<{len(parts)}I", *parts)

    def _merged_long(self, fragment: str, ends: bool) -> bytes:
        """The same result for a long fragment, with a heap of pairs: n log n instead of n squared."""
        parts: list[int] = self._start(fragment, ends)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks
        heap = [(r, i, a, b) for i, (a, b) in enumerate(itertools.pairwise(parts))
                if (r := ranks.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[rank], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y < n and (r := ranks.get(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        kept = [p for p in parts if p >= 0]
        return struct.pack(f"<{len(kept)}I", *kept)

    def _word(self, word: str) -> bytes:
        """Ids of a word: of its fragments one after the other."""
        letters = word.encode().decode("latin-1").translate(self.letters)
        pieces = self.cut(letters)
        last = len(pieces) - 1
        return b"".join([(self._merged if len(p) <= 256 else self._merged_long)(p, i == last)
                         for i, p in enumerate(pieces)])

    def _plain_chunk(self, chunk: str) -> bytes:
        # Lower case letter by letter: without the context rule for a final sigma.
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        out = []
        for word in self.words.findall(chunk):
            found = self.known.get(word)
            if found is None:
                found = self._word(word)
                if len(word) <= CACHE_CHARS:
                    if len(self.known) >= CACHE_ENTRIES:
                        self.known.clear()
                    self.known[word] = found
            out.append(found)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space."""
        found = self.chunks.get(chunk)
        if found is None:
            found = self._plain_chunk(chunk)
            if len(chunk) <= CACHE_CHARS:
                if len(self.chunks) >= CACHE_ENTRIES:
                    self.chunks.clear()
                self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        out = []
        marked = any(name in text for name in self.special)
        for i, part in enumerate(self.specials.split(text) if marked else (text,)):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                known = self.chunks
                out += [known.get(c) or self._chunk(c) for c in _WHITE.split(part) if c]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])



#: White space as the vocabulary's patterns define it (fixed value).
_WHITE = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _shared_coder(digest: str, shared) -> Coder:
    """The coder of this Python process; built once and used by all its tasks."""
    if digest not in _CODERS:
        _CODERS.clear()
        _CODERS[digest] = Coder(shared.value)
    return _CODERS[digest]


def _mapped(df: DataFrame, column: str, out: dict[str, pa.DataType], vocabulary: str, work) -> DataFrame:
    """Add columns that ``work(coder, value)`` yields for each value of ``column``.

    All input columns travel as one struct, so their names cannot clash with anything.
    """
    spec = load_vocabulary(vocabulary)
    digest = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(spec)
    names, kinds = list(out), list(out.values())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _shared_coder(digest, shared)
        for batch in batches:
            made = [work(coder, v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]],
                ["_row", *names])

    kept = [c for c in df.columns if c not in out]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{column}`").alias("_in"))
    spark_kind = {pa.binary(): "binary", pa.string(): "string", pa.int64(): "bigint"}
    fields = T.StructType([packed.schema["_row"], *[
        T.StructField(n, T._parse_datatype_string(spark_kind[k])) for n, k in out.items()]])
    return packed.mapInArrow(run, fields).select("_row.*", *names)


def encode_texts(df: DataFrame, text: str, vocabulary: str, ids: str = "ids", count: str = "n_tokens",
                 decoded: str | None = None) -> DataFrame:
    """Add the token ids of every whole text, their number and, if named, the decoded text.

    ``ids`` holds little-endian unsigned 32-bit numbers. A null or empty text has no ids.
    Special tokens written out in a text get their own ids; white space is dropped. Result
    columns replace columns of the same name; rows, repeated ones too, and all other columns
    stay. The decoded text is made from the ids. Narrow: no shuffle.
    """
    small_batches(df.sparkSession)
    out = {ids: pa.binary(), count: pa.int64(), **({decoded: pa.string()} if decoded else {})}

    def work(coder: Coder, value: str | None):
        found = coder.encode(value or "")
        return found, len(found) // 4, coder.decode(found) if decoded else None

    return _mapped(df, text, out, vocabulary, work)


def decode_ids(df: DataFrame, ids: str, vocabulary: str, out: str = "decoded") -> DataFrame:
    """Add the text of ids as ``encode_texts`` stores them; null ids decode to an empty text."""
    small_batches(df.sparkSession)
    return _mapped(df, ids, {out: pa.string()}, vocabulary, lambda coder, value: (coder.decode(value or b""),))
