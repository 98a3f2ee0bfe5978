import hashlib
import random

from pyspark.sql import functions as F

from tokenloom.llm import merkle


def brute(rows):
    """n_chars and digest of the edited text, by going through the sorted rows."""
    out = []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        out.append((key, len(text), hashlib.sha256((text[:len(text) - cut] + following[:cut]).encode()).hexdigest()))
    return out


def test_documents_match_a_walk_over_the_sorted_rows(docs):
    found = merkle.fingerprints_with_edits(docs, "doc_id", "text").collect()
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == brute(rows)
    texts = dict(rows)
    prints = {}
    for r in found:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(prints.values())) == len(prints)
    long = [r for r in found if r.n_chars >= 40]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.98 * len(long)
    assert sum(r.near_edited for r in long) / len(long) > 0.6 > 0.2 > sum(r.near_next for r in long) / len(long)


def test_differing_branches_locate_edits(spark):
    before = "one a\ntwo b\n\nthree c\nfour d\n\nfive e"
    after = "one a\ntwo b\n\nthree c\nFOUR d\nnew\n\nfive e"
    row = spark.createDataFrame([(before, after, before)], "x string, y string, z string").select(
        merkle.edited_paragraphs(merkle.tree(F.col("x")), merkle.tree(F.col("y"))).alias("xy"),
        merkle.edited_paragraphs(merkle.tree(F.col("x")), merkle.tree(F.col("z"))).alias("xz")).first()
    assert [tuple(p) for p in row.xy] == [(1, 1), (1, 2)] and row.xz == []


def test_roots_differ_wherever_texts_do(spark):
    texts = ["", "\n", "\n\n", "a\nb", "a\n\nb", "a b", "a\n b", "ab", "a\n\n\nb", " a b"]
    found = merkle.fingerprints(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()
    assert len({r.tree.digest for r in found}) == len(texts)


def test_hard_rows(hard):
    found = merkle.fingerprints_with_edits(hard, "doc_id", "text").collect()
    rows = [(r.doc_id, r.text or "") for r in hard.collect()]
    assert sorted((str(r.doc_id), r.n_chars) for r in found) == sorted((str(i), len(t)) for i, t in rows)
    numbered = {(r.doc_id, r.edited_sha256) for r in found if r.doc_id is not None and r.doc_id != 7}
    order = sorted((i, t) for i, t in rows if i is not None)
    want = {(i, d) for i, _, d in brute(order)[:-1] if i != 7}
    assert want <= numbered
    alike = {r.fingerprint for r in found if r.doc_id == 7}
    assert len(alike) == 1
    assert merkle.fingerprints_with_edits(hard.limit(0), "doc_id", "text").count() == 0
    alone = merkle.fingerprints_with_edits(hard.where("doc_id = 12"), "doc_id", "text").first()
    assert alone.near_next == 1.0


def test_a_hot_key_is_cut_into_buckets(spark):
    rows = spark.range(600).select(F.when(F.col("id") < 400, 5).when(F.col("id") < 500, F.col("id")).alias("key"),
                                   F.concat(F.lit("text "), F.col("id")).alias("text"))
    placed = merkle.with_buckets(rows.withColumn("hash", F.xxhash64("text")), ["key", "hash"], 16)
    most = placed.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert most < 60
    assert merkle.fingerprints_with_edits(rows, "key", "text").count() == 600


def test_close_keys_of_sixty_bits_and_text_keys(spark):
    """Keys that share one double, and keys that are no numbers."""
    for key, kind in ((lambda i: 2**60 + i, "long"), (lambda i: f"k{i:05d}", "string")):
        rows = [(key(i), f"text {i} " + "word " * (i % 9)) for i in range(1500)]
        found = merkle.fingerprints_with_edits(spark.createDataFrame(rows, f"key {kind}, text string").repartition(5), "key", "text")
        assert sorted((r.key, r.n_chars, r.edited_sha256) for r in found.collect()) == brute(rows)


def test_an_inserted_character_moves_no_later_block(spark):
    """One paragraph of Chinese characters, the same with one more at its start, and another text."""
    rnd = random.Random(4)
    text, other = ("".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(3000)) for _ in range(2))
    row = spark.createDataFrame([(text, "新" + text, other)], "a string, b string, c string").select(
        *[merkle.phrases(merkle.tree(F.col(c))).alias(c) for c in "abc"]).select(
        merkle.likeness(F.col("a"), F.col("b")).alias("near"), merkle.likeness(F.col("a"), F.col("c")).alias("far"), F.size("a").alias("n")).first()
    assert row.near > 0.95 and row.far < 0.05 and row.n > 50
