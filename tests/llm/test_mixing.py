import pytest
from pyspark.sql import functions as F

from tokenloom.llm import mixing, queries


def shares(rows, margin, weight):
    out, total = {}, sum(weight(r) for r in rows)
    for r in rows:
        out[r[margin]] = out.get(r[margin], 0) + weight(r) / total
    return out


def test_raking_meets_every_marginal(spark):
    cells = spark.createDataFrame(
        [(s, g, t, (i * 37 + j * 11 + k * 5) % 23 + 1) for i, s in enumerate("abc") for j, g in enumerate("xyz")
         for k, t in enumerate([None, "p"])], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.2, "y": 0.2, "z": 0.6}, "topic": {None: 0.4, "p": 0.6}}
    tables = {m: spark.createDataFrame(list(t.items()), f"{m} string, target double") for m, t in targets.items()}
    raked = mixing.keep_rates(mixing.rake(cells, tables)).collect()
    for margin, want in targets.items():
        got = shares(raked, margin, lambda r: r.share)
        assert got == pytest.approx(want, abs=1e-8)
        assert shares(raked, margin, lambda r: r.rate * r.tokens) == pytest.approx(want, abs=1e-8)
    assert max(r.rate for r in raked) == pytest.approx(1.0)


def test_values_without_tokens_or_targets(spark):
    cells = spark.createDataFrame([("a", 5), ("b", 5), ("c", 0)], "source string, tokens long")
    target = spark.createDataFrame([("a", 0.25), ("c", 0.5), ("d", 0.25)], "source string, target double")
    found = {r.source: r.share for r in mixing.rake(cells, {"source": target}).collect()}
    assert found == {"a": 1.0, "b": 0.0}


def test_the_sample_follows_the_rates(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"),
                                      F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("source"))
    goal = spark.createDataFrame([("rare", 0.5), ("common", 0.5)], "source string, target double")
    kept = mixing.mix(docs, "doc_id", {"source": F.col("source")}, mixing.word_count(F.col("text")), {"source": goal})
    count = {r["source"]: r["count"] for r in kept.groupBy("source").count().collect()}
    assert count["rare"] == 2000 and abs(count["common"] - 2000) < 200


def test_hard_rows(hard):
    tokens = mixing.word_count(F.col("text"))
    every = mixing.mix(hard, "doc_id", queries.margins(), tokens, 0.5, keep_all=True).collect()
    assert len(every) == hard.count() and all(r._tokens == len((r.text or "").split()) for r in every)
    assert all(0 <= r._rate <= 1 for r in every) and all(r._kept for r in every if not r._tokens)
    assert len({(r._rate, r._kept) for r in every if r.doc_id == 7}) == 1
    sample = mixing.mix(hard, "doc_id", queries.margins(), tokens, 0.5)
    assert sample.columns == hard.columns and sample.count() == sum(r._kept for r in every)
    assert mixing.mix(hard.limit(0), "doc_id", queries.margins(), tokens, 0.5).count() == 0


def test_one_odd_document_does_not_thin_the_rest(spark):
    """Rates against raking in plain Python, without and with one document of a source and language of its own."""
    def rates(rows):
        cells = {}
        for _, s, g in rows:
            cells[s, g] = cells.get((s, g), 0) + 50
        found = [{v: sum(t for c, t in cells.items() if c[i] == v) for v in {c[i] for c in cells}} for i in (0, 1)]
        goals = [{v: t ** 0.9 / sum(x ** 0.9 for x in sums.values()) for v, t in sums.items()} for sums in found]
        share = {c: t / sum(cells.values()) for c, t in cells.items()}
        for _ in range(mixing.SWEEPS):
            for i, goal in enumerate(goals):
                sums = {v: sum(x for c, x in share.items() if c[i] == v) for v in goal}
                share = {c: x * goal[c[i]] / sums[c[i]] for c, x in share.items()}
        left, total = mixing.SPARE * sum(cells.values()), 0
        for ratio, tokens in sorted(((share[c] / t, t) for c, t in cells.items()), reverse=True):
            total += tokens
            if total > left:
                return {c: min(1.0, share[c] / t / ratio) for c, t in cells.items()}

    rows = [(i, "abc"[min(i % 7, 2)], "xy"[i % 5 == 0]) for i in range(3000)]
    text, kept = F.array_join(F.array_repeat(F.lit("word"), 50), " "), []
    for sample in (rows, [*rows, (3000, "odd", "odder")]):
        docs = spark.createDataFrame(sample, "doc_id long, source string, lang string").withColumn("text", text)
        every = mixing.mix(docs, "doc_id", {"source": F.col("source"), "lang": F.col("lang")},
                           mixing.word_count(F.col("text")), 0.9, keep_all=True).collect()
        want = rates(sample)
        assert [r._rate for r in every] == pytest.approx([want[r.source, r.lang] for r in every])
        kept.append(sum(r._rate for r in every if r.source != "odd") / len(rows))
    assert every[-1]._rate == 1.0 and every[-1].source == "odd"
    assert abs(kept[0] - kept[1]) < 0.005


def test_a_mixture_takes_few_jobs(spark):
    """Each job's plans stay in the driver's memory for a while; tempered targets need neither jobs of a margin nor joins."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"),
                                   *[(F.col("id") % k).cast("string").alias(m) for m, k in (("a", 2), ("b", 3), ("c", 5))])
    context = spark.sparkContext
    context.setJobGroup("few-jobs", "mixture")
    try:
        mixing.mix(docs, "doc_id", {m: F.col(m) for m in "abc"}, mixing.word_count(F.col("text")), 0.9)
        assert len(context.statusTracker().getJobIdsForGroup("few-jobs")) <= 15
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_a_power_makes_the_targets_of_the_found_shares(spark):
    rows = [(s, g, (i * 37 + j * 11) % 23 + 1) for i, s in enumerate(["a", None, "c"]) for j, g in enumerate([1, 2, None, 4])]
    cells = spark.createDataFrame([*rows, ("d", 1, 0)], "source string, lang int, tokens long")
    tables = {}
    for i, m in enumerate(("source", "lang")):
        lifted = {v: sum(r[2] for r in rows if r[i] == v) ** 0.5 for v in {r[i] for r in rows}}
        tables[m] = spark.createDataFrame([(v, x / sum(lifted.values())) for v, x in lifted.items()],
                                          f"{m} {cells.schema[m].dataType.simpleString()}, target double")
    got, want = ({(r.source, r.lang): r.share for r in mixing.rake(cells, wanted).collect()}
                 for wanted in (dict.fromkeys(tables, 0.5), tables))
    assert len(got) == 12 and got == pytest.approx(want)
