import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import lattice_lm, queries


@pytest.fixture(scope="module")
def pieces():
    return lattice_lm.load_pieces(queries.vocabulary("piece_bpe_32k.model"))


def all_paths(pieces, word):
    """The sum over every way to spell the word, one by one."""
    def rest(i):
        if i == len(word):
            return math.exp(pieces.stop)
        total = sum(math.exp(pieces.inner[word[i:j]]) * rest(j) for j in range(i + 1, len(word) + 1) if word[i:j] in pieces.inner)
        if word[i] not in pieces.inner:
            total += math.exp(sum(pieces.byte[b] for b in word[i].encode())) * rest(i + 1)
        return total
    return math.log(sum(math.exp(pieces.start[word[:j]]) * rest(j) for j in range(len(word) + 1) if word[:j] in pieces.start))


WORDS = ["the", "a", "thention", "é", "日本x", "\U0001F600", "x▁y", "zz", "ououeau.", "thinking"]


def test_forward_recursion_sums_all_paths(pieces):
    lattice = lattice_lm.Lattice(pieces)
    want = [all_paths(pieces, w) for w in WORDS]
    assert lattice.word_logs(WORDS) == pytest.approx(want)
    assert [lattice._long_word(w) for w in WORDS] == pytest.approx(want)


def test_expected_counts_add_up_and_training_helps(pieces):
    lattice = lattice_lm.Lattice(pieces)
    counts, spelled = (np.zeros(len(lattice.names[0])), np.zeros(len(lattice.names[1]))), Counter()
    before = lattice.word_logs(WORDS, counts, spelled).sum()
    assert counts[1].sum() == pytest.approx(len(WORDS))
    letters = sum(len(n) * c for names, row in zip(lattice.names, counts) for n, c in zip(names, row)) + sum(spelled.values())
    assert letters == pytest.approx(sum(map(len, WORDS)))
    byte = [0.0] * 256
    for char, x in spelled.items():
        for b in chr(char).encode():
            byte[b] += x
    trained = lattice_lm.normalised(dict(zip(lattice.names[1], counts[1])), dict(zip(lattice.names[0], counts[0])), byte, len(WORDS))
    assert lattice_lm.Lattice(trained).word_logs(WORDS).sum() > before


def test_long_words_count_as_short_ones_do(pieces, monkeypatch):
    lattice, found = lattice_lm.Lattice(pieces), []
    for length in (lattice_lm.ARRAY_LENGTH, 0):
        monkeypatch.setattr(lattice_lm, "ARRAY_LENGTH", length)
        counts, spelled = (np.zeros(len(lattice.names[0])), np.zeros(len(lattice.names[1]))), Counter()
        lattice.word_logs(WORDS, counts, spelled)
        found.append((*counts, spelled))
    assert found[1][0] == pytest.approx(found[0][0]) and found[1][1] == pytest.approx(found[0][1])
    assert dict(found[1][2]) == pytest.approx({c: x for c, x in found[0][2].items()})


def test_training_learns_from_words_of_any_length(spark, pieces):
    long = ["日本語の文章には空白がありません" * 4, "https://example.org/" + "thinking/" * 9, "é" * 50]
    docs = spark.createDataFrame([(w,) for w in long], "text string")
    fitted = lattice_lm.fit_pieces(lattice_lm.word_counts(docs, "text", F.lit(True)), pieces, rounds=1)
    before, after = (lattice_lm.Lattice(p).word_logs(long) for p in (pieces, fitted))
    assert all(len(w) > lattice_lm.ARRAY_LENGTH for w in long) and (after > before).all()


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_documents_match_plain_sums(docs, monkeypatch):
    """The same scores whether words come from the broadcast head or from the join."""
    def scored():
        return lattice_lm.score_documents(docs, "doc_id", "text", queries.fold("doc_id", 7) != 2,
                                          queries.vocabulary("piece_bpe_32k.model")).collect()

    found = scored()
    monkeypatch.setattr(lattice_lm, "HEAD", 5)
    assert {r.doc_id: r.score for r in scored()} == pytest.approx({r.doc_id: r.score for r in found})
    rows = {r.doc_id: r.text for r in docs.collect()}
    seen = Counter()
    for key, text in rows.items():
        if zlib.crc32(str(key).encode()) % 7 != 2:
            seen.update(tokens(text))
    total, distinct = sum(seen.values()), len(seen)
    assert len(found) == len(rows)
    for r in found:
        own = tokens(rows[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(t in seen for t in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((seen[t] + 1) / (total + distinct + 1)) for t in own))
        assert r.score < 0


def test_word_probabilities_add_up_to_less_than_one():
    sums = lattice_lm.Totals(tokens=110, distinct=9, ends=10, types=8, once=3, twice=2)
    c = np.array([50.0, 20, 10, 10, 5, 2, 1, 1, 1])
    whole = (10 ** sums.log10_word(c, np.full(9, -1e9))).sum()
    assert whole + 10 ** sums.log10_end() < 1


def test_hard_rows(hard):
    found = lattice_lm.score_documents(hard, "doc_id", "text", F.lit(True), queries.vocabulary("piece_bpe_32k.model")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted((str(r.doc_id), len(tokens(r.text))) for r in hard.collect())
    assert all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in found)
    none = lattice_lm.score_documents(hard, "doc_id", "text", F.lit(None).cast("boolean"), queries.vocabulary("piece_bpe_32k.model")).collect()
    assert all(r.held_out and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert lattice_lm.score_documents(hard.limit(0), "doc_id", "text", F.lit(True), queries.vocabulary("piece_bpe_32k.model")).count() == 0
