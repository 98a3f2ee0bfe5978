import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tokenloom.llm import forced_bpe, queries

POOL = ("abc ABCs' tΣσςİıßÉé́éñ 1234567٣५½\t\n\r\x0b\x0c\x85\xa0 　​,!?'''sS'Re'lLKǅ"
        "\U0001F600日本語한글\x00\x1c\x1f-_=<|>﻿ͅẞᾀﬁ")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    found.no_padding()
    return found


def test_ids_and_text_equal_the_library(library):
    coder = forced_bpe.Coder(forced_bpe.load_vocabulary(queries.vocabulary("word_bpe_49k.json")))
    draw = random.Random(1)
    texts = ["".join(draw.choices(POOL, k=draw.randint(0, 60))) for _ in range(3000)]
    texts += ["", "a<|endoftext|>B <|startoftext|>", "<|endoftext|><|endoftext|>é", "<|ENDOFTEXT|>", "x" * 5000,
              "ab" * 3000, "in" * 400 + "!" * 900, "the and of " * 50]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_cuts_never_split_a_token(library):
    coder = forced_bpe.Coder(forced_bpe.load_vocabulary(queries.vocabulary("word_bpe_49k.json")))
    for name in list(coder.vocab)[::97]:
        plain = name.removesuffix(coder.suffix)
        assert len(plain) < 2 or coder.cut(plain) == [plain]


def test_hard_rows(hard, library):
    path = queries.vocabulary("word_bpe_49k.json")
    coded = forced_bpe.encode_texts(hard, "text", path, decoded="tree")
    assert coded.columns == [c for c in hard.columns if c != "tree"] + ["ids", "n_tokens", "tree"]
    rows = coded.collect()
    assert len(rows) == hard.count()
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.tree == library.decode(want, skip_special_tokens=False)
    back = forced_bpe.decode_ids(coded.select("doc_id", "ids", "tree"), "ids", path, out="again").collect()
    assert all(r.again == r.tree for r in back)
    assert forced_bpe.encode_texts(hard.limit(0), "text", path).count() == 0
