import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.codecs import encode_bytes
from tokenloom.operators import generate, instruct, ngrams


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def brute(rows, n, vocab=256):
    out = collections.Counter()
    for t in rows:
        ids = list(t.encode())
        for i in range(len(ids) - n + 1):
            context = 0
            for x in ids[i:i + n - 1]:
                context = context * vocab + x
            out[(context, ids[i + n - 1])] += 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_counts_match_brute_force(spark, n):
    rnd = random.Random(n)
    rows = ["".join(rnd.choice("abé") for _ in range(rnd.randint(0, 12))) for _ in range(40)]
    df = texts(spark, rows).repartition(3)
    want = brute(rows, n)
    by_text = {(r["context"], r["token_id"]): r["n"] for r in ngrams.fit_ngrams(df, "text", n).collect()}
    ids = df.select(encode_bytes("text").alias("ids"))
    by_ids = {(r["context"], r["token_id"]): r["n"] for r in ngrams.fit_ngrams(ids, "ids", n).collect()}
    assert by_text == by_ids == dict(want)
    rowwise = ngrams.row_ngrams(df, "doc_id", "text", n).groupBy("context", "token_id").agg(F.sum("n").alias("n"))
    assert {(r["context"], r["token_id"]): r["n"] for r in rowwise.collect()} == dict(want)


def test_order_and_vocabulary_must_fit_64_bits(spark):
    with pytest.raises(ValueError):
        ngrams.fit_ngrams(texts(spark, ["a"]), "text", 5, 50257)


@pytest.mark.parametrize("max_rows, dense", [(1000, 1 << 20), (1000, 0), (0, 0)])
def test_loss_of_unseen_text(spark, max_rows, dense, monkeypatch):
    monkeypatch.setattr(ngrams, "DENSE_CODES", dense)
    df = texts(spark, ["aab"])
    loss = ngrams.cross_entropy(texts(spark, ["ac", "zz", "aa", "x", "", "aab"]), "doc_id", "text",
                                ngrams.fit_ngrams(df, "text"), max_rows=max_rows)
    got = {r["doc_id"]: r["loss"] for r in loss.collect()}
    # Context "a" was seen twice, "z" never; texts of one token predict nothing.
    assert got == pytest.approx({0: -math.log(1 / 258), 1: -math.log(1 / 256), 2: -math.log(2 / 258),
                                 5: -math.log(2 / 258)})
    total = ngrams.total_loss(loss).first()
    assert total["n_pairs"] == 5
    assert total["loss"] == pytest.approx((got[0] + got[1] + got[2] + 2 * got[5]) / 5)


def test_top_k_keeps_ties_and_sums_to_one(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([3.0, 1.0, 2.0, 2.0, 2.0])],
                               "prompt_id long, token_id int, logit double")
    kept = {r["token_id"]: r["prob"] for r in ngrams.next_token_probs(df, top_k=2).collect()}
    assert sorted(kept) == [0, 2, 3, 4] and sum(kept.values()) == pytest.approx(1)
    assert ngrams.next_token_probs(df, top_k=99).count() == 5
    cold = {r["token_id"]: r["prob"] for r in ngrams.next_token_probs(df, temperature=0.01).collect()}
    assert cold[0] == pytest.approx(1)


def setup_model(spark, n, top_k=None):
    rows = ["the cat sat on the mat.", "a cat ate the rat.", "thé end"]
    return generate.continuations(ngrams.fit_ngrams(texts(spark, rows), "text", n), 0.8, top_k)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_both_generation_plans_agree(spark, n):
    model = setup_model(spark, n, 3)
    prompts = spark.createDataFrame([(0, "the"), (1, "q"), (2, "a ca"), (3, "")], "prompt_id long, t string") \
        .select("prompt_id", encode_bytes("t").alias("ids"), (F.lit(9) + F.col("prompt_id").cast("int")).alias("max_new"))

    def run(**options):
        done = generate.generate(prompts, model, n, stop_id=46, seed=5, **options)
        return {r["prompt_id"]: r["produced"] for r in done.collect()}

    in_tasks = run()
    assert in_tasks == run(max_candidates=0)
    assert all(46 not in p and len(p) <= 9 + i for i, p in in_tasks.items())
    assert any(in_tasks.values())


def test_generation_repeats_under_any_partitioning(spark):
    model = setup_model(spark, 2)
    prompts = spark.range(20).select(F.col("id").alias("prompt_id"), F.array(F.lit(116)).alias("ids"))
    runs = [sorted((r["prompt_id"], tuple(r["produced"])) for r in
                   generate.generate(prompts.repartition(k), model, max_new=12).collect()) for k in (1, 6)]
    assert runs[0] == runs[1] and len({p for _, p in runs[0]}) > 5


def test_draws_follow_the_probabilities(spark):
    model = generate.continuations(ngrams.fit_ngrams(texts(spark, ["ab" * 3 + "ac"]), "text"))
    prompts = spark.range(4000).select(F.col("id").alias("prompt_id"), F.array(F.lit(97)).alias("ids"))
    first = generate.generate(prompts, model, max_new=1).groupBy(F.col("produced")[0].alias("t")).count()
    share = {r["t"]: r["count"] / 4000 for r in first.collect()}
    assert share[98] == pytest.approx(0.75, abs=0.03) and share[99] == pytest.approx(0.25, abs=0.03)


def test_prompt_suite_reports_errors(spark):
    suite = spark.createDataFrame([("a", "the", 5), ("b", "", 5), ("c", None, 5), ("d", "on", 0)],
                                  "name string, prompt string, max_tokens int")
    got = {r["name"]: (r["output"], r["error"]) for r in
           generate.run_prompt_suite(suite, setup_model(spark, 2), stop_id=None).collect()}
    assert len(got["a"][0]) == 8 and got["a"][0].startswith("the") and got["a"][1] is None
    assert got["b"] == got["c"] == (None, "empty prompt") and got["d"] == ("on", None)


def test_a_failing_prompt_leaves_the_others_alone(spark, monkeypatch):
    monkeypatch.setattr(generate, "LONGEST_PROMPT", 20)
    suite = spark.createDataFrame([("a", "the", 5), ("b", "the", None), ("c", "the", -2), ("d", "t" * 21, 5)],
                                  "name string, prompt string, max_tokens int")
    got = {r["name"]: (r["output"], r["error"]) for r in
           generate.run_prompt_suite(suite, setup_model(spark, 2), stop_id=None).collect()}
    assert len(got["a"][0]) == 8 and got["a"][1] is None
    assert [got[k] for k in "bcd"] == [(None, "no token limit"), (None, "negative token limit: -2"), (None, "prompt too long")]


def test_a_step_moves_no_model(spark):
    """Beyond the broadcast limit the bucketed model is read in place: no exchange of all its rows."""
    from tokenloom.session import bucketed

    model = bucketed(setup_model(spark, 2), "model", "context")
    needed = model.join(spark.range(50).selectExpr("id as context").hint("merge"), "context", "left_semi")
    plan = needed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan


TURNS = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (1, 3, "user"), (1, 4, "user"), (1, 5, "assistant"),
         (1, 6, "user"), (2, 0, "assistant"), (2, 1, "user"), (3, 0, "user"), (3, 9, "assistant")]


@pytest.mark.parametrize("size", [1, 100, 100_000])
def test_pairs(spark, size):
    df = spark.createDataFrame([(*t, f"{t[0]}-{t[1]}") for t in TURNS],
                               "conv_id long, turn long, role string, text string").repartition(4)
    got = sorted(map(tuple, instruct.pair_turns(df, size=size).collect()))
    assert got == [(1, 1, "1-1", "1-2"), (1, 4, "1-4", "1-5"), (3, 0, "3-0", "3-9")]


def test_template(spark):
    df = spark.createDataFrame([("Add", "1 2", "3"), ("Go", "", None)], "instruction string, input string, output string")
    plain, with_input = ([r["text"] for r in instruct.render_sft(df, extra=e).collect()] for e in (None, "input"))
    head = ("Below is an instruction that describes a task. Write a response that appropriately completes the "
            "request.\n\n### Instruction:\n")
    assert plain == [head + "Add\n\n### Response:\n3", head + "Go\n\n### Response:\nNone"]
    assert with_input[0] == head + "Add\n\n### Input:\n1 2\n\n### Response:\n3" and with_input[1] == plain[1]


def test_masks_and_padding(spark):
    df = spark.createDataFrame([([1, 2], [3, 4])], "p array<int>, r array<int>")
    ids, labels = instruct.mask_prompt("p", "r")
    row = df.select(ids.alias("i"), labels.alias("l")).select(
        "i", "l", instruct.truncate_pad("i", 3).alias("cut"), instruct.truncate_pad("i", 6, 9).alias("pad"),
        instruct.attention_mask("i", 6).alias("m"), instruct.attention_mask("i", 3).alias("m3")).first()
    assert row["i"] == [1, 2, 3, 4] and row["l"] == [-100, -100, 3, 4]
    assert row["cut"] == [1, 2, 3] and row["pad"] == [1, 2, 3, 4, 9, 9]
    assert row["m"] == [1, 1, 1, 1, 0, 0] and row["m3"] == [1, 1, 1]


def test_length_batches_keep_every_row_and_waste_less(spark):
    rnd = random.Random(0)
    rows = [(i, rnd.randint(1, 500)) for i in range(401)]
    df = spark.createDataFrame(rows, "id long, n int").repartition(5)
    batches = instruct.length_group_batches(df, ["id"], "n", 4, pool=20)
    assert sorted(r["id"] for r in batches.collect()) == list(range(401))
    waste = instruct.padding_waste(batches, "n")
    sizes = collections.Counter(r["rows"] for r in waste.collect())
    assert sizes[4] == 100 and sizes[1] == 1
    padding = waste.agg(F.sum("padding")).first()[0]
    naive = sum(4 * max(n for _, n in rows[i:i + 4]) - sum(n for _, n in rows[i:i + 4]) for i in range(0, 400, 4))
    assert padding < naive / 4


def test_formatter(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "d")], "x string, y string")
    got = instruct.apply_formatter(df, lambda c: [p + q for p, q in zip(c["x"], c["y"])], ["x", "y"]).collect()
    assert [r["text"] for r in got] == ["ab", "cd"]
