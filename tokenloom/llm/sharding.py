"""Shards by jump consistent hashing, and a manifest with the place of every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF
#: Multiplier of the published generator, as two 32-bit halves (fixed value).
_M1, _M0 = divmod(2862933555777941757, 1 << 32)
#: Steps unrolled for every row; the few rows that jump more often take a loop.
_STEPS = 12


def _low_product(a: Column, b: int) -> Column:
    """The low 32 bits of the product of two 32-bit numbers, with no overflow on the way."""
    high = F.shiftright(a, 16) * F.lit(b)
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + low).bitwiseAND(F.lit(_LOW))


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """``state * multiplier + 1`` modulo 2**64 on 32-bit halves."""
    upper = F.shiftright(low, 16) * F.lit(_M0)
    lower = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(_M0) + F.lit(1)
    sum_low = lower + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(sum_low, 32) + F.shiftright(upper, 16)
    new_high = carry + _low_product(low, _M1) + _low_product(high, _M0)
    return new_high.bitwiseAND(F.lit(_LOW)), sum_low.bitwiseAND(F.lit(_LOW))


def key_number(df: DataFrame, key: str) -> Column:
    """The 64-bit number that is hashed: whole numbers stand for themselves, all else by xxhash64.

    A null key counts as 0, so null rows share one shard as the rows of any key do.
    """
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    number = F.col(f"`{key}`").cast("bigint") if whole else F.xxhash64(F.col(f"`{key}`"))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def jump_path(number: Column, shards: int) -> Column:
    """The buckets below ``shards`` that a key visits as shards are appended one by one.

    The last element is the key's shard; the last below any smaller count is its shard
    for that count. A key moves only to a new shard, with probability 1 / (new count).
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(state: Column) -> Column:
        def moved(bucket, high, low):
            new_high, new_low = _next_state(high, low)
            # The top 31 of the 64 bits, plus one.
            draw = F.shiftright(new_high, 1) + F.lit(1)
            target = ((bucket + F.lit(1)).cast("double")
                      * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("bigint")
            return F.struct(
                target.alias("bucket"), new_high.alias("high"), new_low.alias("low"),
                F.when(target < shards, F.concat(state["path"], F.array(target)))
                .otherwise(state["path"]).alias("path"))
        return F.when(state["bucket"] >= shards, state).otherwise(
            moved(state["bucket"], state["high"], state["low"]))

    start = F.struct(
        F.lit(0).cast("bigint").alias("bucket"),
        F.shiftright(number, 32).bitwiseAND(F.lit(_LOW)).alias("high"),
        number.bitwiseAND(F.lit(_LOW)).alias("low"),
        F.array(F.lit(0).cast("bigint")).alias("path"))
    # A jump goes up by at least one, so `shards` steps always suffice; few rows need more than some.
    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(_STEPS, shards))), start, lambda s, _: step(s))
    if shards <= _STEPS:
        return first["path"]
    rest = F.sequence(F.lit(_STEPS + 1), F.lit(shards))
    return F.aggregate(
        F.array(first), F.array().cast("array<bigint>"),
        lambda _, s: F.when(s["bucket"] >= shards, s["path"]).otherwise(
            F.aggregate(rest, s, lambda t, _: step(t))["path"]))


def assign_shards(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """Add the shard of every row. Narrow: no shuffle, no ring table.

    An existing column ``out`` is replaced; every other column and every row stays, repeated
    rows included. Null keys: see ``key_number``. An empty table stays empty.
    """
    path = jump_path(key_number(df, key), shards)
    return df.withColumn(out, F.element_at(path, -1).cast("int"))


def shard_manifest(df: DataFrame, key: str, text: str, shards: int, *, grown: int | None = None,
                   overhead: int = 16, chunk: int = 100_000, buckets: int = 256) -> DataFrame:
    """One row per row of ``df``: key, size, checksum, shard, place in the shard.

    Size is the text's UTF-8 bytes (none for null) plus ``overhead``; ``text_crc32`` is the
    unsigned CRC-32 of the bytes. ``slot`` counts from 0 without gaps in each shard, by
    bucket, key, size and checksum, where the bucket is the sum of key number and checksum modulo
    ``buckets``; rows that agree in all of these are interchangeable. ``grown_shard`` is the shard for ``grown`` shards (default one more).
    Other columns of ``df`` are not read, whatever their names. The text never leaves its
    task: equal rows are counted before the shuffle and spread out again after it, in chunks,
    so neither a hot shard nor a hot key is held by one task.
    """
    grown = shards + 1 if grown is None else grown
    if grown < shards:
        raise ValueError("grown must not be less than shards")
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint") + overhead
    rows = df.select(
        F.col(f"`{key}`").alias("_key"), size.alias("_size"),
        F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(0).cast("bigint")).alias("_crc"),
        F.element_at(F.array(jump_path(key_number(df, key), grown)), 1).alias("_path"))
    rows = rows.select(
        "_key", "_size", "_crc",
        F.array_max(F.filter("_path", lambda b: b < shards)).cast("int").alias("_shard"),
        F.array_max("_path").cast("int").alias("_grown"))
    counted = rows.groupBy("_shard", "_grown", "_key", "_size", "_crc").agg(F.count("*").alias("_n"))
    number = key_number(counted, "_key")
    counted = counted.withColumn("_bucket", (F.pmod(number, F.lit(buckets)) + F.col("_crc") % buckets) % buckets)
    totals = counted.groupBy("_shard", "_bucket").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_shard", "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy("_shard", "_bucket").orderBy("_key", "_size", "_crc")
              .rowsBetween(Window.unboundedPreceding, -1))
    # One row per shard and bucket: a number set by the parameters, not by the data.
    placed = counted.join(F.broadcast(starts), ["_shard", "_bucket"]).withColumn(
        "_first", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    repeated = (placed.where(F.col("_n") > chunk)
                .withColumn("_from", F.explode(F.expr(f"sequence(0L, _n - 1, {chunk}L)")))
                .repartition("_shard", "_key", "_from"))
    single = placed.where(F.col("_n") <= chunk).withColumn("_from", F.lit(0).cast("bigint"))
    spread = single.unionByName(repeated).withColumn(
        "_place", F.explode(F.expr(f"sequence(_from, least(_from + {chunk}L, _n) - 1)")))
    return spread.select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"), F.col("_shard").alias("shard"),
        (F.col("_first") + F.col("_place")).alias("slot"), F.col("_grown").alias("grown_shard"))
