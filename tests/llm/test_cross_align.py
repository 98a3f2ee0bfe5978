import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tokenloom.llm import cross_align, queries

from .conftest import LONG

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


class Library:
    """Both tokenizers as their own libraries run them."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
        kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        letters = [chr(b) for b in range(256) if b in kept]
        self.byte = dict(zip(letters, sorted(kept))) | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - kept))}

    def tokens(self, text):
        """Ids and bytes of both sides, or nothing."""
        if not text:
            return [], [], [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        wa = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        wb = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(self.b.id_to_piece, b))]
        if not b"".join(wa) == b"".join(wb) == (" " + text).encode():
            return [], [], [], []
        return a, b, wa, wb


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    library = Library()
    made, corpus = [], Counter()
    for key, text in rows:
        a, b, wa, wb = library.tokens(text)
        sa, sb = spans(wa), spans(wb)
        links, j0 = [], 0
        for i, (x, y) in enumerate(sa):
            while j0 < len(sb) and sb[j0][1] <= x:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][0] < y:
                links.append((a[i], b[j]))
                j += 1
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        names, at = [], [0, 0]
        for end in common:
            sides = []
            for side, (ids, ends) in enumerate(((a, sa), (b, sb))):
                first = at[side]
                while ends[at[side]][1] < end:
                    at[side] += 1
                at[side] += 1
                sides.append(",".join(map(str, ids[first:at[side]])))
            names.append("|".join(sides))
        made.append((key, a, b, names, links))
        corpus.update(links)
    top = {}
    for (_, b), n in corpus.items():
        top[b] = max(n, top.get(b, 0))
    return sorted([(key, len(a), len(b), len(names), len(links), sum(corpus[p] == top[p[1]] for p in links), sum(corpus[p] for p in links),
                    hashlib.sha256(";".join(names).encode()).hexdigest() if names else "") for key, a, b, names, links in made], key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", " ", "  ", "a", "▁x", "x▁y", "a  b\n\n c\t", "<|endoftext|> </s><s><unk> <0x41>", "naïve 你好 \U0001F600‍\U0001F468", "a\x00b",
       "é ﬁ ｆｕｌｌ", " 　x", "don't WON'T we'll", "1234567890 " * 30, "x" * 3000, " " * 500 + "y"]


def of_query(spark, monkeypatch, df):
    monkeypatch.setattr(queries, "_table", lambda *_: df)
    found = queries.op13_alignment(spark, "")
    assert sorted(found.columns) == sorted(COLUMNS)
    return sorted(map(tuple, found.select(COLUMNS).collect()), key=str)


def test_rows_of_every_kind(spark, hard, monkeypatch):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert of_query(spark, monkeypatch, hard) == brute(rows)
    assert of_query(spark, monkeypatch, hard.limit(0)) == []


def test_documents_and_odd_texts(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-i, t) for i, t in enumerate(ODD, 1)] + [(None, None), (-3, ODD[3]), (None, ODD[11])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert of_query(spark, monkeypatch, df) == brute(rows)


def test_alignments(spark):
    library = Library()
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    for r in cross_align.alignments(df, "k", "t", *PATHS).collect():
        a, b, wa, wb = library.tokens(ODD[r.k] if r.k is not None else None)
        assert (r.a_ids, r.b_ids) == (a, b)
        sides = [[e for _, e in spans(w)] for w in (wa, wb)]
        assert [sides[0][i - 1] for i in r.a_ends] == [sides[1][i - 1] for i in r.b_ends] == sorted(set(sides[0]) & set(sides[1]))


@given(st.lists(st.integers(1, 400), max_size=60), st.lists(st.integers(1, 400), max_size=60), st.randoms(use_true_random=False))
@settings(max_examples=300, deadline=None)
def test_gallop_equals_search(short, long, rnd):
    a, b = np.unique(np.array(short, np.int64)), np.unique(np.array(long, np.int64))
    start = np.array([rnd.randint(0, len(b)) for _ in a], np.int64)
    assert cross_align.gallop(a, b, start).tolist() == np.searchsorted(b, a).tolist()


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_long_texts_are_cut_where_nothing_changes(monkeypatch, stretch):
    library = Library()
    pair = cross_align.TokenizerPair(cross_align.load_byte_bpe(PATHS[0]), PATHS[1], open(PATHS[2], "rb").read())
    rnd = random.Random(stretch)
    texts = ODD + [LONG[:3000]] + ["".join(rnd.choice(" ab .,'1é好\n\t▁") for _ in range(200)) for _ in range(40)]
    monkeypatch.setattr(cross_align, "STRETCH", stretch)
    a, b = pair.encode([t.encode() for t in texts])
    for x, y, t in zip(a, b, texts):
        wanted = library.tokens(t)
        assert (x.tolist(), y.tolist()) == wanted[:2]


def test_links_of_repeated_pairs_are_counted_once_each(spark):
    df = spark.createDataFrame([(i, "the same words") for i in range(50)], "k long, t string").repartition(8)
    rows = cross_align.link_counts(df, "k", "t", *PATHS).collect()
    assert {(r.n_links, r.n_best, r.count_sum) for r in rows} == {(3, 3, 150)}
