import pytest
from pyspark.sql import functions as F

from tokenloom.llm import token_rollup
from tokenloom.session import scratch_path


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")


def apply(spark, store, batch, op, rows, tokenizer="t1"):
    return token_rollup.apply_batch(spark, store, batch, token_rollup.changes(table(spark, rows), op, "doc_id", tokenizer, F.col("n")))


def found(spark, store):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in token_rollup.totals(spark, store).collect()}


def test_inserts_deletes_revisions_and_replays(spark):
    store = scratch_path(spark, "rollup")
    assert found(spark, store) == {}
    assert apply(spark, store, "b1", "insert", [(1, "a", "en", 5), (2, "a", "en", 7), (3, "b", None, 1), (3, "b", None, 1)])
    assert found(spark, store) == {("a", "en", "t1"): (2, 12), ("b", None, "t1"): (1, 1)}
    assert not apply(spark, store, "b1", "insert", [(1, "a", "en", 5)])
    assert apply(spark, store, "b2", "revise", [(2, "b", "en", 9), (9, "c", "en", 4)])
    assert found(spark, store) == {("a", "en", "t1"): (1, 5), ("b", None, "t1"): (1, 1), ("b", "en", "t1"): (1, 9), ("c", "en", "t1"): (1, 4)}
    assert apply(spark, store, "b3", "delete", [(1, "a", "en", 0), (77, "a", "en", 0)])
    assert apply(spark, store, "b4", "insert", [(3, "b", None, 6)], tokenizer="t2")
    assert found(spark, store) == {("b", None, "t1"): (1, 1), ("b", "en", "t1"): (1, 9), ("c", "en", "t1"): (1, 4), ("b", None, "t2"): (1, 6)}
    assert token_rollup.committed(spark, store) == ["b1", "b2", "b3", "b4"]


def test_an_unfinished_batch_does_not_count(spark):
    import os

    store = scratch_path(spark, "rollup")
    apply(spark, store, "b1", "insert", [(1, "a", "en", 5)])
    apply(spark, store, "b2", "insert", [(2, "a", "en", 5)])
    os.rename(f"{store}/batch=b2/deltas/_SUCCESS", f"{store}/batch=b2/deltas/_gone")
    assert found(spark, store) == {("a", "en", "t1"): (1, 5)}
    assert apply(spark, store, "b2", "insert", [(2, "a", "en", 8)])
    assert found(spark, store) == {("a", "en", "t1"): (2, 13)}


def test_hard_rows(hard, spark):
    store = scratch_path(spark, "rollup")
    counted = token_rollup.changes(hard, "insert", "doc_id", "chars", F.char_length("text"))
    assert token_rollup.apply_batch(spark, store, "all", counted)
    rows = hard.collect()
    distinct = {r.doc_id: len(r.text or "") for r in rows if r.doc_id is not None}
    nameless = [len(r.text or "") for r in rows if r.doc_id is None]
    total = found(spark, store)
    assert sum(d for d, _ in total.values()) == len(distinct) + len(nameless)
    assert sum(t for _, t in total.values()) == sum(distinct.values()) + sum(nameless)
    assert token_rollup.apply_batch(spark, store, "none", counted.limit(0)) and found(spark, store) == total
    with pytest.raises(ValueError):
        token_rollup.changes(hard, "upsert", "doc_id", "chars", F.lit(1))
