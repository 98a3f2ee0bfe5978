import random

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import queries, toxicity

SMALL = toxicity.Settings(sample=400, bits=16, shards=2)


@pytest.fixture(scope="module")
def marked(spark):
    """Invented words; those with a bad word, or a bad pair of harmless words, are toxic."""
    draw = random.Random(9)
    rows = []
    for i in range(600):
        words = [f"w{draw.randrange(300)}" for _ in range(draw.randint(10, 60))]
        bad = draw.random() < 0.3
        if bad:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(["vile", "foul"]))
        rows.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy_and_sparsity(marked):
    model = toxicity.toxicity_model(marked.select("doc_id", "text"), marked.select("doc_id", "toxic"), settings=SMALL)
    assert 0 < len(model.index) < 2000
    held = toxicity.score(marked.where(queries.fold("doc_id", 5) == 0), "text", model).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in held)
    assert len(held) > 80 and right >= 0.95 * len(held)


def test_held_out_labels_and_other_columns_are_no_inputs(marked):
    flipped = marked.withColumn("toxic", F.when(queries.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.toxicity_model(marked.select("doc_id", "text"), labels.select("doc_id", "toxic"), settings=SMALL)
                for labels in (marked, flipped))
    assert one.intercept == two.intercept and (one.index == two.index).all() and (one.weight == two.weight).all()


def test_skip_grams_see_words_apart():
    near, far = (set(toxicity.features(t, 20).tolist()) for t in (b"you are vile", b"you are very vile"))
    assert len(near & far) >= 4


def test_one_class_or_no_labels(marked, spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    texts = marked.select("doc_id", "text")
    for labels, want in ((empty, 0), (marked.select("doc_id", F.lit(1).alias("toxic")), 1)):
        model = toxicity.toxicity_model(texts, labels, settings=SMALL)
        assert {int(r.score >= 0.5) for r in toxicity.score(texts, "text", model).collect()} == {want}


def test_hard_rows(hard, marked):
    labels = marked.select("doc_id", "toxic").unionAll(marked.select(F.lit(None).cast("long"), F.lit(1))).unionAll(
        marked.limit(1).select("doc_id", (1 - F.col("toxic")).cast("int")))
    model = toxicity.toxicity_model(marked.select("doc_id", "text").unionAll(hard.select("doc_id", "text")), labels, settings=SMALL)
    scored = toxicity.score(hard, "text", model, out="tree")
    assert scored.columns == [c for c in hard.columns if c != "tree"] + ["tree"] and scored.count() == hard.count()
    by = {r.doc_id: r.tree for r in scored.collect()}
    assert by[1] == by[2] == by[4] and all(0 <= s <= 1 for s in by.values())
    assert toxicity.score(hard.limit(0), "text", model).count() == 0


def plain_ftrl(rows, s):
    """The learner coordinate by coordinate, with dictionaries; shards start alike and their changes are averaged."""
    import math

    counts = [sum(1 for r in rows if r["label"] == y) for y in (0, 1)]
    importance = [math.sqrt(len(rows) / (2 * c)) for c in counts]
    z, n = {}, {}
    for _ in range(s.rounds):
        moved_z, moved_n = {}, {}
        for shard in range(s.shards):
            own_z, own_n = dict(z), dict(n)
            for r in sorted((r for r in rows if r["shard"] == shard), key=lambda r: (r["turn"], r["id"])):
                keys = [*toxicity.features(bytes(r["text"]), s.bits).tolist(), "intercept"]
                weights = []
                for k in keys:
                    zi, ni = own_z.get(k, 0.0), own_n.get(k, 0.0)
                    rate = (s.beta + math.sqrt(ni)) / s.alpha + s.l2
                    small = k != "intercept" and abs(zi) <= s.l1
                    pull = 0.0 if k == "intercept" else math.copysign(s.l1, zi)
                    weights.append(0.0 if small else -(zi - pull) / rate)
                p = 1 / (1 + math.exp(-sum(weights)))
                g = (p - r["label"]) * importance[r["label"]]
                for k, w in zip(keys, weights):
                    ni = own_n.get(k, 0.0)
                    own_z[k] = own_z.get(k, 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / s.alpha * w
                    own_n[k] = ni + g * g
            for k in own_n:
                moved_z[k] = moved_z.get(k, 0.0) + own_z[k] - z.get(k, 0.0)
                moved_n[k] = moved_n.get(k, 0.0) + own_n[k] - n.get(k, 0.0)
        for k in moved_n:
            z[k] = z.get(k, 0.0) + moved_z[k] / s.shards
            n[k] = n.get(k, 0.0) + moved_n[k] / s.shards
    out = {}
    for k in z:
        if k == "intercept":
            out[k] = -z[k] / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)
        elif abs(z[k]) > s.l1:
            out[k] = -(z[k] - math.copysign(s.l1, z[k])) / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)
    return out


def test_weights_equal_a_plain_learner(spark):
    settings = toxicity.Settings(bits=10, shards=2, rounds=2, l1=0.5)
    bad, good = "vile slur hate filth".split(), "garden bread river lamp".split()
    rows = [(i, " ".join((bad if i % 3 == 0 else good)[(i * 5 + j * j) % 4] for j in range(6))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    train = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", folds=5, held_out=0, settings=settings).cache()
    model = toxicity.fit(train, settings)
    want = plain_ftrl([r.asDict() for r in train.collect()], settings)
    assert abs(model.intercept - want.pop("intercept")) < 1e-6
    assert sorted(model.index.tolist()) == sorted(want) and len(want) > 10
    assert all(abs(w - want[i]) < 1e-5 for i, w in zip(model.index.tolist(), model.weight.tolist()))
