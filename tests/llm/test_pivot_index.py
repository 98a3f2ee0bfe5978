import math
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import pivot_index


def brute(rows, asks, k, scale=1024):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in fine:
        if q is None or not asks(q):
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in fine if i != q]
        out[q] = [(r + 1, None if n else i, -s) for r, (s, n, i) in enumerate(sorted(scores)[:k])]
    return out


def check(spark, rows, k=10, every=20, size=None, monkeypatch=None):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("mine")).repartition(3)
    found = {}
    for r in pivot_index.top_k(table, "vec_id", "embedding", F.col("vec_id") % every == 0, k).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, lambda i: i % every == 0, k)
    assert {q: sorted(v) for q, v in found.items()} == {q: v for q, v in want.items() if v}


def test_clusters_ties_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    monkeypatch.setattr(pivot_index, "PACK", 4)
    draw = random.Random(2)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + draw.gauss(0, 0.2) for c in centres[i % 6]]) for i in range(400)]
    rows += [(1000 + i, list(centres[0])) for i in range(200)]
    check(spark, rows)


def test_unequal_lengths_and_few_rows(spark):
    draw = random.Random(4)
    check(spark, [(i, [draw.gauss(0, 3 ** (i % 4)) for _ in range(5)]) for i in range(120)], every=7)
    check(spark, [(0, [1.0, 0.0]), (20, [0.5])], k=10)


def test_nulls_non_finite_repeated_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, float("nan")]), (2, [None, 1.0]), (3, None), (4, [float("inf"), 0.0]), (None, [1.0, 2.0]),
            (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [-1.0, 0.25]), (7, []), (8, [1.0]), (0, [1.0, 2.0])]
    check(spark, rows, k=4)
    assert pivot_index.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding",
                             F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_stay_exact(spark):
    draw = random.Random(8)
    check(spark, [(i, [float(draw.randrange(2**19)), float(-draw.randrange(2**19))]) for i in range(60)], k=3)


@pytest.mark.parametrize("k", [1, 3])
def test_fewer_answers_than_asked(spark, k):
    check(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])], k=k)
