"""Windows over an ordered table without one task holding a whole group.

A window ``PARTITION BY run`` (or with no partition at all) puts every row of the
group into one task. The helpers here cut the order into buckets whose bounds are
splitters: a sorted sample of whole key tuples, compared exactly and in full. The
splitters are literals, so the bucket of a row depends on its key alone: retried tasks
and the second pass over the table always agree. A group holding any share of the rows
is spread over all buckets, and so are rows that share the first key, as long as a later
key tells them apart. Where whole tuples repeat so often that they would fill buckets, a
hash of the row is taken as one key more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
GROUP = "_group"
SEGMENT = "_segment"
OWN = "_own"
TIE = "_tie"
SEGMENT_ROWS = 1_000_000

MAX_BUCKETS = 20_000
#: Sampled key tuples per bucket: buckets then differ by some 15 % in size.
SAMPLED = 48


def bucket_count(df: DataFrame) -> int:
    """Four buckets per shuffle partition, so that hashing them spreads evenly.

    The cap keeps the sample and the table of splitters small at any setting.
    """
    return min(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)


def _plain_key(df: DataFrame, key: str) -> Column:
    """The key in a type that JSON holds exactly and that sorts alike, in any session time zone."""
    kind = df.schema[key].dataType
    if isinstance(kind, (T.MapType, T.VariantType)):
        raise TypeError(f"order key {key} cannot be a {kind.simpleString()}: it has no order")
    if isinstance(kind, T.DateType):
        return F.unix_date(key)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', `{key}`)")
    if isinstance(kind, T.FloatType):
        return F.col(key).cast("double")
    return F.col(key)


def key_tuple(df: DataFrame, order: Sequence[str]) -> Column:
    """The keys as one value that compares as the order does."""
    return F.struct(*[_plain_key(df, k).alias(f"k{i}") for i, k in enumerate(order)])


def splitters(df: DataFrame, order: Sequence[str], buckets: int) -> tuple[Column, int, bool]:
    """At most ``buckets - 1`` key tuples that cut the order into about equal parts.

    Returned are a sorted literal array of structs, its length, and whether one tuple filled
    several parts. Every row has the same chance to be sampled; the sample is bounded by the
    number of buckets, not by the table.
    """
    keys = df.select(key_tuple(df, order).alias("k"))
    rows = keys.count()
    wanted = SAMPLED * buckets
    sample = keys if rows <= wanted else keys.sample(fraction=wanted / rows, seed=7)
    found = [r[0] for r in sample.orderBy("k").select(F.to_json("k")).collect()]
    picked = [found[i * len(found) // buckets] for i in range(1, buckets)] if found else []
    distinct = list(dict.fromkeys(picked))
    literal = F.sort_array(F.from_json(F.lit(f"[{','.join(distinct)}]"), T.ArrayType(keys.schema["k"].dataType)))
    # A tuple that is three parts' bound fills two of them; of fewer rows than parts none is hot.
    hot = rows > buckets and any(a == b for a, b in zip(picked, picked[2:]))
    return literal, len(distinct), hot


def _place(key: Column, bounds: Column, n: int) -> Column:
    """How many of the ``n`` sorted bounds are at most the key: a binary search by rising bits."""
    steps = F.lit([1 << i for i in reversed(range(max(n, 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))


def with_buckets(df: DataFrame, order: str | Sequence[str], buckets: int | None = None,
                 keys: DataFrame | None = None) -> DataFrame:
    """Add a bucket number that rises with the order of the keys; null keys come first.

    Keys are of any type that can be sorted. ``keys`` may name a cheaper table with about
    the same keys to take the splitters from. Where whole tuples are too frequent, a column
    ``_tie`` is added, a hash of the row that splits them and belongs to the order as its
    last key; rows that are equal in every column stay together.
    """
    order = [order] if isinstance(order, str) else list(order)
    n = buckets or bucket_count(df)
    bounds, found, hot = splitters(df if keys is None else keys, order, n)
    if hot:
        df = df.withColumn(TIE, F.xxhash64(*df.columns))
        order = [*order, TIE]
        bounds, found, _ = splitters(df, order, n)
    return df.withColumn(BUCKET, _place(key_tuple(df, order), bounds, found) if found else F.lit(0))


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    values: Mapping[str, Column],
    group: Sequence[str] = (),
    *,
    bucket: Column | None = None,
    buckets: int | None = None,
    keys: DataFrame | None = None,
    below: tuple[str, int] | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """Exclusive running sums in two passes.

    Pass 1 sums every (group, bucket) with map-side combine and turns those few totals
    into the sum carried into each bucket. Pass 2 runs a window inside the bucket and
    adds the carry. ``bucket`` replaces the sampled buckets by an expression that is
    already monotone in the order. ``below=(out, limit)`` skips buckets that start at or
    beyond the limit before anything is shuffled; the caller still filters rows.
    ``keep_bucket`` leaves the bucket and the ``{out}_lo``/``{out}_hi`` sums at its ends
    in the result. Null groups form a group, and null keys come first.
    """
    cut = with_buckets(df, order, buckets, keys) if bucket is None else df.withColumn(BUCKET, bucket)
    order = [*order, TIE] if TIE in cut.columns and TIE not in df.columns else order
    names = {out: f"_v{i}" for i, out in enumerate(values)}
    by = []
    if group:
        # As a struct, so that the join on it also matches null groups.
        cut, by = cut.withColumn(GROUP, F.struct(*group)), [GROUP]
    for out, name in names.items():
        cut = cut.withColumn(name, values[out])
    totals = cut.groupBy(*by, BUCKET).agg(*[F.sum(v).alias(v) for v in names.values()])
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *by, BUCKET,
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}c") for v in names.values()],
        *([F.col(v).alias(f"{v}t") for v in names.values()] if keep_bucket else []))
    if not by and bucket is None:
        # One row per bucket: bounded by the bucket count, whatever the table size.
        carry = F.broadcast(carry)
    joined = cut.join(carry, [*by, BUCKET])
    if below:
        start = F.col(f"{names[below[0]]}c")
        joined = joined.where((start < below[1]) | (start == 0))
    inside = (Window.partitionBy(*by, BUCKET).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    kept = [F.col(BUCKET)] if keep_bucket else []
    for out, v in names.items():
        if keep_bucket:
            kept += [F.col(f"{v}c").alias(f"{out}_lo"),
                     (F.col(f"{v}c") + F.col(f"{v}t")).alias(f"{out}_hi")]
        kept.append((F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"{v}c")).alias(out))
    return joined.select(*df.columns, *kept)


def row_index(
    df: DataFrame, order: Sequence[str], out: str, group: Sequence[str] = (), **options,
) -> DataFrame:
    """0-based position of each row in its group."""
    return running_sums(df, order, {out: F.lit(1).cast("bigint")}, group, **options)


def with_segments(df: DataFrame, index: str, before: int = 0, after: int = 0,
                  size: int = SEGMENT_ROWS) -> DataFrame:
    """Cut numbered rows into segments and copy border rows into the neighbours.

    A window over (group, ``_segment``) then sees ``before`` earlier and ``after`` later
    rows for every row with ``_own``; copies have ``_own`` false and are filtered out.
    """
    if size < max(before, after):
        raise ValueError("segment size must cover the window reach")
    home = F.expr(f"`{index}` div {size}")
    place = F.col(index) % size
    targets = [home]
    if before:
        targets.append(F.when(place >= size - before, home + 1))
    if after:
        targets.append(F.when((place < after) & (home > 0), home - 1))
    return (df.withColumn("_home", home)
            .withColumn(SEGMENT, F.explode(F.array_compact(F.array(*targets))))
            .withColumn(OWN, F.col(SEGMENT) == F.col("_home"))
            .drop("_home"))


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group; counted with map-side combine on the key columns alone."""
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def reach_windows(df: DataFrame, group: Sequence[str], order: Sequence[str], before: int = 0,
                  after: int = 0, size: int = SEGMENT_ROWS) -> DataFrame:
    """Prepare a window that looks a bounded number of rows back or ahead.

    Where every group is known to be small, the group is the window partition and the
    order needs one shuffle. Otherwise rows are numbered and groups cut into segments.
    Either way: window over ``reach_partition(group)``, then ``own_rows``.
    """
    if largest_group(df, group) <= size:
        return df.withColumns({SEGMENT: F.lit(0).cast("bigint"), OWN: F.lit(True)})
    numbered = row_index(df, order, "_index", group)
    return with_segments(numbered, "_index", before, after, size).drop("_index")


def reach_partition(group: Sequence[str]) -> list[str]:
    return [*group, SEGMENT]


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(OWN, SEGMENT)
