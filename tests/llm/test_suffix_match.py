import hashlib
import random
import re

import numpy as np
import pytest

from tokenloom.llm import queries, suffix_match

from .conftest import LONG

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    """Contract columns by comparing every window with every place."""
    out = []
    for key, text in docs:
        ws = words(text)
        hit, found = set(), set()
        for item, wanted in items:
            vs = words(wanted)
            n = min(10, len(vs))
            windows = {tuple(vs[i:i + n]) for i in range(len(vs) - n + 1)} if vs else set()
            for at in range(len(ws) - n + 1):
                if tuple(ws[at:at + n]) in windows:
                    hit.update(range(at, at + n))
                    found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        out.append((key, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "one Two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ITEMS = [
    (1, PASSAGE), (10, PASSAGE.upper() + " fifteen"), (2, "short item"), (3, "short item"), (4, ""), (5, None), (6, "... --- !"),
    (None, "nameless rows of just ten words or some more here too"), (7, "weiß Äpfel naïve 你好 x1"), (1, "another text under the first id"),
    (8, "a a a a a a a a a a a a"), (9, "two paragraphs"),
]
DOCS = [
    (1, "before, " + PASSAGE.replace(" ", ", ") + " after"), (2, PASSAGE + " " + PASSAGE), (3, " ".join(PASSAGE.split()[:9])),
    (4, "a " * 15), (5, "short-item short_item SHORT\x00ITEM"), (6, "Weiß äpfel NAÏVE 你好 X1 weiß Äpfel naïve 你好 x1"), (7, None), (8, ""),
    (9, "nameless rows of just ten words or some more"), (None, "another TEXT under the first id"), (2, PASSAGE + " " + PASSAGE),
    (10, "six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (11, "unrelated"), (12, LONG + " short item"),
]


def of_query(spark, monkeypatch, docs, items):
    tables = {"documents": docs, "benchmark": items}
    monkeypatch.setattr(queries, "_table", lambda _s, _d, name: tables[name])
    return sorted(map(tuple, queries.op12_decontamination(spark, "").collect()), key=str)


@pytest.fixture
def planted(spark):
    return (spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3),
            spark.createDataFrame(ITEMS, "item_id long, text string"))


def test_planted_passages(spark, monkeypatch, planted):
    assert of_query(spark, monkeypatch, *planted) == brute(DOCS, ITEMS)


def test_blocks_and_stretches_give_the_same(spark, monkeypatch, planted):
    """Every item a broadcast block of its own."""
    monkeypatch.setattr(suffix_match, "BLOCK_BYTES", 40)
    assert of_query(spark, monkeypatch, *planted) == brute(DOCS, ITEMS)


def test_small_stretches(monkeypatch):
    monkeypatch.setattr(suffix_match, "SHARD", 13)
    monkeypatch.setattr(suffix_match, "PIECE", 5)
    rows = [(None if i is None else str(i), t and t.encode()) for i, t in ITEMS]
    block = suffix_match.numbered(rows, 10)
    shard = suffix_match.Shard([t and t.encode() for _, t in DOCS], block)
    masks, found = shard.marks()
    got = [(k, int(n), int(m.sum()), len(f), hashlib.sha256(",".join(sorted(f)).encode()).hexdigest(), bool(m.any()))
           for (k, _), n, m, f in zip(DOCS, shard.sizes, masks, found)]
    assert sorted(got, key=str) == brute(DOCS, ITEMS)


def test_rows_of_every_kind(spark, hard, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert of_query(spark, monkeypatch, hard, items) == brute(rows, ITEMS)
    assert of_query(spark, monkeypatch, hard.limit(0), items) == []
    assert of_query(spark, monkeypatch, hard, items.limit(0)) == brute(rows, [])


def test_suffix_arrays_are_sorted():
    rnd = random.Random(2)
    for depth in (1, 3, 10, 40):
        codes = np.array([rnd.choice([0, 1, 1, 1, 2, 3, 9]) for _ in range(600)] + [1] * 100 + [1, 2] * 60 + [0], np.int32)
        for n in (len(codes), 500):
            order = suffix_match.suffix_array(codes, n, 4, depth)
            assert sorted(order) == [i for i in range(n) if codes[i]]

            def prefix(i):
                part = codes[i:i + depth].tolist()
                return part[:part.index(0)] if 0 in part else part

            assert all(prefix(a) <= prefix(b) for a, b in zip(order, order[1:]))


def test_longest_matches(spark, planted):
    docs, items = planted
    got = {(r.item_id, r.item_at): (r.n_words, r.doc_id, r.doc_at)
           for r in suffix_match.longest_matches(docs, "doc_id", "text", items.where("item_id not in (1)")).collect()}
    want = {}
    for item, text in ITEMS:
        vs = words(text)
        for at in range(len(vs) - min(10, len(vs)) + 1 if vs and item not in (None, 1) else 0):
            best = max((next((k for k in range(min(len(vs) - at, len(ws) - p)) if vs[at + k] != ws[p + k]), min(len(vs) - at, len(ws) - p)),
                        key is not None, -(key or 0)) for key, text in DOCS for ws in [words(text)] for p in range(len(ws)))
            if best[0]:
                want[str(item), at] = best[0], -best[2]
    assert {k: v[:2] for k, v in got.items()} == want
    texts = {str(i): words(t) for i, t in ITEMS}
    for (item, at), (n, doc, place) in got.items():
        assert texts[item][at:at + n] == words(dict(DOCS)[doc])[place:place + n]


def test_affected_documents_leave(spark, planted):
    docs, items = planted
    clean = suffix_match.decontaminated(docs.selectExpr("doc_id", "text", "1 as n_hit", "2 as items", "3 as _row"), "text", items)
    assert clean.columns == ["doc_id", "text", "n_hit", "items", "_row"]
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((r[0] for r in brute(DOCS, ITEMS) if not r[5]), key=str)
