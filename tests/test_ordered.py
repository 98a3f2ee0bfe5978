import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenloom.plans import ordered
from tokenloom.plans.joins import lookup_join


def skewed(n=400, seed=1):
    """A third and more of the rows belong to one group; keys have gaps and negatives."""
    rnd = random.Random(seed)
    keys = rnd.sample(range(-10_000, 10_000), n)
    return [("hot" if i % 3 else f"g{i % 40}", k, rnd.randint(0, 9)) for i, k in enumerate(keys)]


def test_running_sums_without_group(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    got = {r["k"]: r["s"] for r in ordered.running_sums(df, ["k"], {"s": F.col("v")}).collect()}
    total = 0
    for _, k, v in sorted(rows, key=lambda r: r[1]):
        assert got[k] == total
        total += v


def test_running_sums_by_group(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    got = {(r["g"], r["k"]): (r["s"], r["i"]) for r in ordered.running_sums(
        df, ["k"], {"s": F.col("v"), "i": F.lit(1)}, ["g"]).collect()}
    assert len(got) == len(rows)
    seen = {}
    for g, k, v in sorted(rows, key=lambda r: (r[0], r[1])):
        total, count = seen.get(g, (0, 0))
        assert got[(g, k)] == (total, count)
        seen[g] = total + v, count + 1


def test_null_groups_and_null_keys_are_kept(spark):
    rows = [(None if i % 3 else "g", None if i == 5 else i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, k long, t long")
    got = {r["t"]: r["i"] for r in ordered.row_index(df, ["k", "t"], "i", ["g"]).collect()}
    for name in (None, "g"):
        ranked = sorted((t for g, _, t in rows if g == name), key=lambda t: (t != 5, t))
        assert [got[t] for t in ranked] == list(range(len(ranked)))
    laid = ordered.own_rows(ordered.reach_windows(df, ["g"], ["k", "t"], before=1, size=2))
    assert laid.count() == 60


def test_a_map_is_no_order_key(spark):
    with pytest.raises(TypeError):
        ordered.row_index(spark.createDataFrame([({"a": 1},)], "k map<string,int>"), ["k"], "i")


def bucket_sizes(df):
    return [r[1] for r in df.groupBy(ordered.BUCKET).count().collect()]


def checked_order(spark, df, order):
    """Row numbers equal Spark's own order, and buckets rise with it."""
    placed = ordered.with_buckets(df, order)
    rows = placed.orderBy(*order).select(ordered.BUCKET).collect()
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)
    return bucket_sizes(placed)


def test_text_keys(spark):
    names = ["", "a", "a\u0000", "ab", "b", 'q"uote\\', "é", "\U0001F600", None, *[f"dir/{i % 7}/file{i}.txt" for i in range(3000)]]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "k string, t int").repartition(5)
    sizes = checked_order(spark, df, ["k"])
    assert len(sizes) > 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = {r["t"]: r["i"] for r in ordered.row_index(df, ["k"], "i").collect()}
    want = [i for _, i in sorted(((n is not None, (n or "").encode()), i) for i, n in enumerate(names))]
    assert [got[t] for t in want] == list(range(len(names)))


def test_half_of_the_rows_under_one_first_key(spark):
    rows = [("same" if i % 2 else f"k{i}", i if i % 3 else None, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "a string, b int, t int").repartition(6)
    sizes = checked_order(spark, df, ["a", "b", "t"])
    assert len(sizes) > 8 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_ties_are_split_by_a_row_hash(spark):
    rows = [(None if i % 2 else i, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, t int").repartition(6)
    placed = ordered.with_buckets(df, ["k"])
    sizes = bucket_sizes(placed)
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    got = [r["i"] for r in ordered.row_index(df, ["k"], "i").orderBy("i").collect()]
    assert got == list(range(6000))


def test_close_large_keys_spread(spark):
    df = spark.range(4000).select((F.lit(2**60) + F.col("id")).alias("k"), "id").repartition(5)
    sizes = checked_order(spark, df, ["k"])
    assert len(sizes) > 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert ordered.row_index(df, ["k"], "i").where("i <> id").count() == 0


def test_numbers_that_json_writes_as_words(spark):
    values = [float("-inf"), -0.0, 0.0, 1e-300, 0.1, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values * 40)], "k double, t int")
    checked_order(spark, df, ["k", "t"])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "g string, k long")
    assert ordered.row_index(empty, ["k"], "i", ["g"]).count() == 0
    assert ordered.row_index(empty, ["k"], "i").count() == 0


def test_a_hot_group_is_spread_over_buckets(spark):
    df = spark.createDataFrame([("hot", i) for i in range(4000)], "g string, k long")
    largest = ordered.with_buckets(df, "k").groupBy("g", ordered.BUCKET).count().agg(F.max("count")).first()[0]
    assert largest < 4000 / 8


@pytest.mark.parametrize("kind, value", [
    ("date", lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)),
    ("timestamp", lambda i: datetime.datetime(2024, 3, 31) + datetime.timedelta(minutes=17 * i)),
    ("timestamp_ntz", lambda i: datetime.datetime(2024, 3, 31) + datetime.timedelta(minutes=17 * i)),
    ("double", lambda i: i / 7), ("decimal(20,2)", None)])
def test_order_key_types(spark, kind, value):
    df = spark.range(300).select(F.col("id"), F.col("id").cast("decimal(20,2)").alias("k")) if value is None \
        else spark.createDataFrame([(i, value(i)) for i in range(300)], f"id long, k {kind}")
    got = ordered.row_index(df.repartition(5), ["k"], "i").where("i <> id").count()
    assert got == 0


def test_equal_keys_share_a_bucket(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(50)], "k int, t int")
    got = ordered.row_index(df, ["k", "t"], "i").where("i <> (k - 1) * 50 + t").count()
    assert got == 0


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_windows_over_segments(spark, size):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, k long, v long")
    laid = ordered.reach_windows(df, ["g"], ["k"], before=2, after=1, size=size)
    w = Window.partitionBy(*ordered.reach_partition(["g"])).orderBy("k")
    cut = ordered.own_rows(laid.withColumns({
        "back": F.sum("v").over(w.rowsBetween(-2, 0)), "ahead": F.lead("v").over(w)}))
    plain = Window.partitionBy("g").orderBy("k")
    want = df.withColumns({"back": F.sum("v").over(plain.rowsBetween(-2, 0)), "ahead": F.lead("v").over(plain)})
    assert sorted(map(str, cut.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_lookup_join_has_the_same_rows_either_way(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = lookup_join(facts, lookup, ["k"])
    large = lookup_join(facts, lookup, ["k"], max_rows=10)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
