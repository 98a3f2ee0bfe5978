import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tokenloom.llm import mixing, queries, secrets

from .conftest import DATA
from .test_near_dedup import brute as groups
from .test_secrets import brute as found_spans
from .test_secrets import masked


@pytest.fixture(scope="module")
def staged(spark):
    """What each stage gets, and what the last one returns."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], DATA).cache())
    return seen


def test_filters_keep_the_columns_and_lose_no_clean_document(staged, spark):
    docs, clean, unique = staged[:3]
    assert docs.columns == clean.columns == unique.columns == staged[3].columns == staged[4].columns
    harmless = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()}
    left = {r.doc_id for r in clean.collect()}
    # So few labels are toxic here that nothing may be rejected; test_toxicity has held-out accuracy.
    assert len(harmless & left) >= 0.95 * len(harmless)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert {r.doc_id for r in unique.collect()} == {c for k, _, c in groups(rows, 5, 80)}


def test_secrets_are_gone_and_nothing_else(staged):
    before = {r.doc_id: r.text for r in staged[2].collect()}
    after = {r.doc_id: r for r in staged[3].collect()}
    assert before.keys() == after.keys()
    for key, text in before.items():
        assert after[key].text == masked(text, found_spans(text)) and after[key].n_chars == len(after[key].text)
    assert not any(found_spans(r.text) for r in after.values()) and secrets.RULES


def test_mixture_and_tokens(staged):
    every = mixing.mix(staged[3], "doc_id", queries.margins(), mixing.word_count(F.col("text")), queries.TEMPER, keep_all=True)
    assert {r.doc_id for r in every.where("_kept").collect()} == {r.doc_id for r in staged[4].collect()}
    texts = {r.doc_id: r.text for r in staged[4].collect()}
    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    rows = staged[5].collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_rows_of_the_stages(staged, spark):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(r.doc_id for r in staged[5].collect())


def with_odd_columns(df):
    """Columns whose names the stages or operators use themselves, or that need quoting."""
    return df.select("doc_id", "text", "lang", "source", "n_chars", F.lit("mine").alias("_toxicity"), F.lit(1).alias("toxicity"),
                     F.lit(2).alias("a.b"), F.lit(3).alias("row"), F.lit(4).alias("_row"), F.lit(5).alias("score"), F.lit(6).alias("blob"))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_rows_of_every_kind(spark, hard, stage):
    given = with_odd_columns(hard)
    got = stage(spark, given, DATA)
    assert got.columns == given.columns
    rows = got.collect()
    assert all(tuple(r)[5:] == ("mine", 1, 2, 3, 4, 5, 6) for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in given.collect()}
    empty = stage(spark, given.limit(0), DATA)
    assert empty.columns == given.columns and empty.count() == 0


def test_last_stage_takes_rows_of_every_kind(spark, hard):
    rows = corpus_pipeline.encode(spark, with_odd_columns(hard), DATA).collect()
    assert len(rows) == hard.count() and all(r.n_tokens == len(r.ids) // 4 for r in rows)
    assert corpus_pipeline.encode(spark, with_odd_columns(hard).limit(0), DATA).count() == 0


def test_toxic_documents_leave(spark, tmp_path):
    """Labelled rows of two plain vocabularies; unlabelled toxic ones leave, harmless and wordless ones stay."""
    bad, good = "vile slur hate filth curse".split(), "garden bread river lamp stone".split()
    rows = [(i, " ".join((bad if i % 4 == 0 else good)[(i * 7 + j * j) % 5] for j in range(12)), "en", "a", 0) for i in range(800)]
    rows += [(900, None, "en", "a", None), (901, "", "en", "a", 0)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in range(800) if i % 4} | {900, 901}


def test_mixture_equals_plain_raking(staged):
    """Cells, margins, sweeps and draws in plain Python, by the stage's rule."""
    rows = staged[3].select("doc_id", "source", "lang", mixing.topic(F.col("text")).alias("topic"),
                            mixing.word_count(F.col("text")).alias("tokens")).collect()
    cells = {}
    for r in rows:
        cells[r[1:4]] = cells.get(r[1:4], 0) + r.tokens
    cells = {c: t for c, t in cells.items() if t}
    total = sum(cells.values())
    goals = []
    for i in range(3):
        sums = {v: sum(t for c, t in cells.items() if c[i] == v) for v in {c[i] for c in cells}}
        lifted = {v: t ** queries.TEMPER for v, t in sums.items()}
        goals.append({v: x / sum(lifted.values()) for v, x in lifted.items()})
    share = {c: t / total for c, t in cells.items()}
    for _ in range(mixing.SWEEPS):
        for i, goal in enumerate(goals):
            sums = {v: sum(x for c, x in share.items() if c[i] == v) for v in goal}
            share = {c: x * goal[c[i]] / sums[c[i]] for c, x in share.items()}
    expanded = sorted((share[c] / t, t) for c, t in cells.items())
    at, seen, largest = (total - 1) * (1 - mixing.SPARE), 0, None
    for ratio, t in expanded:
        seen += t
        if seen > at:
            largest = ratio
            break
    kept = set()
    for r in rows:
        chance = 1.0 if not r.tokens else min(1.0, share[r[1:4]] / cells[r[1:4]] / largest)
        number = int(hashlib.md5(f"{r.doc_id}:0".encode()).hexdigest()[:13], 16) / 2 ** 52
        if number < chance:
            kept.add(r.doc_id)
    assert kept == {r.doc_id for r in staged[4].collect()}
