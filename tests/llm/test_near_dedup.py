import random

import numpy as np
import pytest

from tokenloom.llm import near_dedup
from tokenloom.llm.words import shingle_set


def brute(rows, words, percent):
    """Smallest key reachable, by comparing every pair of texts."""
    sets = [shingle_set((t or "").encode(), words) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                group[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)]


def sort(found):
    return sorted(found, key=str)


def check(spark, rows, words=4, percent=80):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near_dedup.near_duplicates(table, "doc_id", "text", words=words, percent=percent).collect()
    assert sort((r.doc_id, r.n_shingles, r.component_id) for r in found) == sort(brute(rows, words, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    kept = near_dedup.deduplicated(table, "doc_id", "text", words=words, percent=percent).collect()
    empty = sum(1 for _, t in rows if not (t or "").split())
    wordy = {(r.doc_id, r.text) for r in kept if (r.text or "").split()}
    assert len(wordy) == len({r.component_id for r in found if r.n_shingles}) and len(kept) == len(wordy) + empty
    return found


def family(draw, base, copies, most):
    """Copies of a text with up to ``most`` words changed: links lie on both sides of the threshold."""
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(draw.randint(0, most)):
            words[draw.randrange(len(words))] = f"n{draw.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def test_random_copies_match_all_pairs(spark):
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(400)}" for _ in range(draw.randint(1, 120))) for _ in range(60)]
    texts += [t for base in texts[:25] for t in family(draw, base.split(), 3, 3)]
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize("hot", [64, 3])
def test_large_families_and_common_passages(spark, monkeypatch, hot):
    """The same groups whether the lists are short or hot."""
    monkeypatch.setattr(near_dedup, "LIST", hot)
    draw = random.Random(6)
    base = [f"b{i}" for i in range(70)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = family(draw, base, 110, 8)
    texts += [passage + " " + " ".join(f"q{draw.randrange(10**6)}" for _ in range(draw.randint(0, 60))) for _ in range(90)]
    check(spark, list(enumerate(texts)))


def test_small_sets_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LIST", 2)
    texts = [" ".join(f"a{i}" for i in range(n)) for n in range(1, 16)] * 2
    check(spark, [(i * 3 % 31, t) for i, t in enumerate(texts)])


def test_hard_rows(hard, spark):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    found = near_dedup.near_duplicates(hard, "doc_id", "text").collect()
    assert sort((r.doc_id, r.n_shingles, r.component_id) for r in found) == sort(brute(rows, 5, 80))
    kept = near_dedup.deduplicated(hard, "doc_id", "text")
    assert kept.columns == hard.columns
    assert sort((r.doc_id, (r.text or "")[:20]) for r in kept.collect()) == sort(
        (i, t[:20]) for i, t in [(3, "the SAME words appear here"), (None, "A text without an id"), (1, ""), (2, ""), (4, " \t\n "),
                                 (-5, "x"), (2**62, rows_text(rows, 2**62)), (9, rows_text(rows, 9)), (11, "x" * 20),
                                 (12, rows_text(rows, 12))])
    empty = hard.limit(0)
    assert near_dedup.near_duplicates(empty, "doc_id", "text").count() == 0
    assert near_dedup.deduplicated(empty, "doc_id", "text").count() == 0


def rows_text(rows, key):
    return next(t for i, t in rows if i == key)


def test_every_word_of_a_long_shingle_counts():
    one, other = (shingle_set(f"a b c d e f g {last}".encode(), 8) for last in "hi")
    assert len(one) == len(other) == 1 and one[0] != other[0]


def test_a_shared_passage_makes_no_pairs(spark):
    """Texts of one 90-word passage and 12 words of their own link with nothing, and meet nowhere."""
    passage = " ".join(f"p{i}" for i in range(90))
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(12)) + " " + passage) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = near_dedup.class_table(near_dedup.sketched(docs, "doc_id", "text", 4)).cache()
    sets = near_dedup.full_sets(docs, "doc_id", "text", 4, classes, classes.select("cls"))
    lists = near_dedup.prefix_lists(sets, 80).cache()
    none = spark.createDataFrame([], "node binary, label binary")
    assert lists.count() >= 150 * 5
    assert lists.where("place * 180 <= n * 20").count() == 0
    assert near_dedup.remaining_pairs(lists, none, 80).count() == 0
    found = near_dedup.near_duplicates(docs, "doc_id", "text", words=4).collect()
    assert all(r.kept for r in found) and len(found) == 150


def test_sets_of_different_sizes_meet_in_hot_lists(spark):
    """Prefix lists alone, without hubs or sketches, find every link between groups."""
    draw = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(family(draw, base, 40, 3) + family(draw, base[:52], 40, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = near_dedup.class_table(near_dedup.sketched(docs, "doc_id", "text", 4)).cache()
    sets = near_dedup.full_sets(docs, "doc_id", "text", 4, classes, classes.select("cls")).cache()
    none = spark.createDataFrame([], "node binary, label binary")
    pairs = near_dedup.confirmed(near_dedup.remaining_pairs(near_dedup.prefix_lists(sets, 80), none, 80), sets, 80)
    got = {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in pairs.collect()}
    held = {bytes(r.cls): np.frombuffer(bytes(r.shingles), np.uint64) for r in sets.collect()}
    want = set()
    for a in held:
        for b in held:
            same = len(np.intersect1d(held[a], held[b], assume_unique=True))
            if a < b and 100 * same >= 80 * (len(held[a]) + len(held[b]) - same):
                want.add((a, b))
    assert got == want and want


def test_groups_join_without_walking_old_links(spark, monkeypatch):
    """Links between groups change the labels of all their members; nodes without a label take part."""
    kind, node = "a binary, b binary", lambda x: x.encode()
    labels = near_dedup.components(spark.createDataFrame([(node(a), node(b)) for a, b in ("fe", "ed", "dc", "mn", "no", "xy")], kind))
    assert {(bytes(r.node), bytes(r.label)) for r in labels.collect()} == {
        (node(a), node(b)) for a, b in ("cc", "dc", "ec", "fc", "mm", "nm", "om", "xx", "yx")}
    walked = []
    monkeypatch.setattr(near_dedup, "components", lambda links, run=near_dedup.components: walked.append(links.count()) or run(links))
    more = spark.createDataFrame([(node(a), node(b)) for a, b in ("cm", "mk", "pq")], "la binary, lb binary")
    joined = near_dedup.joined_groups(labels, more)
    assert sort((bytes(r.node), bytes(r.label)) for r in joined.collect()) == sort(
        (node(a), node(b)) for a, b in ("cc", "dc", "ec", "fc", "mc", "nc", "oc", "kc", "xx", "yx", "pp", "qp"))
    assert walked == [3]


def test_few_tables_are_read_at_once(spark, monkeypatch):
    """Every table and shuffle that starts with a job takes memory of the driver."""
    read = []

    def stored(df, *where):
        read.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return run(df, *where)

    run = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", stored)
    monkeypatch.setattr(near_dedup, "LIST", 3)
    draw = random.Random(6)
    texts = family(draw, [f"b{i}" for i in range(70)], 40, 8) + family(draw, [f"c{i}" for i in range(40)], 20, 6)
    near_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()
    assert max(read) <= 6
