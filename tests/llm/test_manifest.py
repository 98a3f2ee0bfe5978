import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import manifest, queries

from .conftest import DATA


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(leaves):
    """Levels of the tree over a list of digests."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1:a + 8])))
        i //= 8
    return out


def leaf_of(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def expected(rows):
    """Contract columns of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = brute([x[2] for x in groups[g]])
    top = brute([trees[g][-1][0] for g in names])
    out = []
    for gi, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(groups[g]):
            steps = siblings(trees[g], i) + siblings(top, gi)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = leaf_of(*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in steps:
                node = h(left + node + right)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def query_rows(spark, monkeypatch, df):
    monkeypatch.setattr(queries, "_table", lambda *_: df)
    found = queries.op11_manifest(spark, "")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=str)


def test_rows_of_every_kind(spark, hard, monkeypatch):
    rows = [tuple(r) for r in hard.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = query_rows(spark, monkeypatch, hard)
    assert got == expected(rows) and len({r[6] for r in got}) == 2


def test_documents(spark, docs, monkeypatch):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert query_rows(spark, monkeypatch, docs.repartition(5)) == expected(rows)


def test_empty_and_single(spark, docs, monkeypatch):
    assert query_rows(spark, monkeypatch, docs.limit(0)) == []
    one = docs.where("doc_id = 3")
    rows = [tuple(r) for r in one.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert query_rows(spark, monkeypatch, one) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 100, 512, 513])
def test_blocks_join_to_the_same_tree(spark, monkeypatch, n):
    """With blocks of 8 leaves the trees have up to four stored levels."""
    monkeypatch.setattr(manifest, "HEIGHT", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    leaves = [h(str(i)) for i in range(n)]
    root, blocks = [], [manifest.grown(leaves[i:i + 8], i // 8) for i in range(0, n, 8)]
    root = [b[0] for b in blocks]
    witness = [w for b in blocks for w in b[1]]
    while len(root) > 1:
        above = [manifest.grown(root[i:i + 8], i // 8) for i in range(0, len(root), 8)]
        upper = [w for b in above for w in b[1]]
        span = -(-n // len(root))
        size = 8
        while size < span:
            size *= 8
        witness = [w + upper[i // size] for i, w in enumerate(witness)]
        root = [b[0] for b in above]
    levels = brute(leaves)
    assert root == levels[-1] and [[tuple(s) for s in w] for w in witness] == [siblings(levels, i) for i in range(n)]


def test_more_leaves_than_a_block(spark):
    """One hot group of more than two blocks, small ones beside it, and keys in any order."""
    n = 9000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.when(F.col("id") * 7919 % n < 8700, "hot").otherwise(
        F.concat(F.lit("g"), (F.col("id") * 7919 % n % 90).cast("string"))).alias("lang"))
    got = {r["k"]: r for r in manifest.manifest(df.repartition(6), "k", "lang", {"leaf": manifest.leaf([F.col("k")])}).collect()}
    groups = {}
    for k in range(n):
        groups.setdefault("hot" if k < 8700 else f"g{k % 90}", []).append(k)
    names = sorted(groups)
    trees = {g: brute([leaf_of(k) for k in groups[g]]) for g in names}
    top = brute([trees[g][-1][0] for g in names])
    rnd = random.Random(1)
    for k in [0, 4095, 4096, 8191, 8192, 8699, *rnd.sample(range(n), 300)]:
        g = "hot" if k < 8700 else f"g{k % 90}"
        i = groups[g].index(k)
        r = got[k]
        assert (r.lang, r.position, r.subroot, r.root) == (g, i, trees[g][-1][0], top[-1][0])
        assert [tuple(s) for s in r.witness] == siblings(trees[g], i) + siblings(top, names.index(g))


def test_witnesses_are_extended_by_later_siblings():
    tree = manifest.Witnesses()
    for i in range(7):
        tree.append(h(str(i)))
    assert all(w == [] for w in tree.partial)
    tree.append(h("7"))
    assert all(len(w) == 1 for w in tree.partial)
    for i in range(8, 64):
        tree.append(h(str(i)))
    assert all(len(w) == 2 for w in tree.partial) and len(tree.open[2]) == 1


def test_whole_table_of_the_query(spark):
    got = queries.op11_manifest(spark, DATA)
    assert got.select("root").distinct().count() == 1
    assert got.where("verified").count() < got.count()
