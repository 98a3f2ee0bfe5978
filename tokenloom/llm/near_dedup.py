"""Near-duplicate groups from bottom-k sketches of one hash function.

Texts with equal shingle sets form a class, and all further work is on classes. A class
keeps the ``SKETCH`` smallest hashes of its set. Two sets of Jaccard similarity 0.8 share
each of the smallest hashes of their union with probability 0.8, so:

* A retained value held by at most ``LIST`` classes is *cold*. Classes that share one of
  their first ``COLD`` cold values are candidates; a value makes at most ``LIST`` / 2 pairs
  per member. The chance that a link shares none is below 0.4 ** 20 = 1e-8 when at least half
  of one sketch is cold (for sets no larger than a sketch it is zero).
* Classes of which at least half of the sketch is *hot* are large families of copies, or texts
  that consist mostly of a widespread passage. Their whole sets are ordered by how many of these
  classes hold a shingle, rarest first; linked sets must meet in the first fifth or so of that
  order, and not too late in it. In each such list all members are compared with one hub, the
  member with the fewest rare shingles. Once the groups found so far are known, members outside
  the list's main group are compared with those in other groups: the smaller set through its short
  *index* prefix (the places where it can still link with a set no smaller), the larger through the
  whole prefix, within blocks of similar size, if they meet early enough. Texts that share a passage
  without being alike have it behind their index prefix and do not meet. Members of one group need no
  comparison. So a family of copies costs a few comparisons per member, and no link between groups is
  missed.
* Candidates whose union sketch estimates a similarity ``DEVIATIONS`` standard deviations below
  the threshold are dropped (at 0.8 those that share at most 19 of 48 values; the chance that a
  link does is 1.1e-9); all others are confirmed on the full sets.

Values are counted over all classes. Every step is a join or an aggregate with partial sums;
hot join keys are left to the skew handling of adaptive execution. Tables of classes grow with
the data, so their joins are merges by hint: none is collected to the driver for a broadcast
because it happens to be small.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, written, written_to
from .words import shingle_set, small_batches

SKETCH = 48
COLD = 20
LIST = 64
DEVIATIONS = 6.8
_PAD = np.uint64(2**64 - 1)


def _class_of(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def sketched(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """One row per document: its key, a hash of its text, set size, class and sketch. Narrow."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"),
                       F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_class_of(s) for s in sets], pa.binary()),
                 pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["id", "h", "n", "cls", "sketch"])

    fields = T.StructType([read.schema["id"], read.schema["h"], T.StructField("n", T.LongType()),
                           T.StructField("cls", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    return read.mapInArrow(run, fields)


def class_table(rows: DataFrame) -> DataFrame:
    """One row per class with the smallest key in it (null keys last)."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "n", "sketch")).alias("first")
    return rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(first).select("cls", "first.*")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """Per class the retained values that other classes hold too: position, value, hot or not."""
    values = classes.select("cls", "n", F.size("sketch").alias("k"), F.posexplode("sketch").alias("pos", "value"))
    members = values.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    entry = F.struct("pos", "value", (F.col("members") > LIST).alias("hot"))
    return (values.join(members.hint("merge"), "value").groupBy("cls")
            .agg(F.first("n").alias("n"), F.first("k").alias("k"), F.sort_array(F.collect_list(entry)).alias("entries")))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sets whose sizes differ too much cannot reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def cold_pairs(lists: DataFrame, percent: int) -> DataFrame:
    cold = F.slice(F.transform(F.filter("entries", lambda e: ~e["hot"]), lambda e: e["value"]), 1, COLD)
    members = lists.select("cls", "n", F.explode(cold).alias("value"))
    left = members.select(F.col("cls").alias("a"), F.col("n").alias("na"), "value")
    right = members.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "value")
    return (left.join(right.hint("merge"), "value").where((F.col("a") < F.col("b")) & _may_link("na", "nb", percent))
            .select("a", "b").distinct())


def hot_classes(lists: DataFrame) -> DataFrame:
    """Classes of which at least half of the sketch is hot."""
    hot = F.size(F.filter("entries", lambda e: e["hot"]))
    return lists.where(hot * 2 >= F.col("k")).select("cls")


def prefix_lists(sets: DataFrame, percent: int) -> DataFrame:
    """For whole sets the shingles in which a set that links must meet, and their places.

    Shingles are in order of how many of the sets hold them. ``place`` counts the shingles before
    one in its set, those that no other set holds included. ``common`` tells how widespread the
    first shingles of the set are.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
            sizes = [len(s) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))),
                 pa.array(np.repeat(np.array(sizes, np.int64), sizes)), pa.array(np.concatenate(found))],
                ["cls", "n", "value"])

    values = sets.mapInArrow(run, "cls binary, n bigint, value bigint")
    held = values.groupBy("value").agg(F.count("*").alias("held")).where("held > 1")
    ordered = values.join(held.hint("merge"), "value").groupBy("cls", "n").agg(
        F.sort_array(F.collect_list(F.struct("held", "value"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    first = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    kept = ordered.withColumn("alone", alone).withColumn("shared", F.slice("shared", F.lit(1), F.greatest(first, F.lit(0))))
    common = F.aggregate("shared", F.col("alone").cast("bigint"), lambda t, e: t + e["held"]) / F.col("n")
    return kept.select("cls", "n", "alone", common.alias("common"), F.posexplode("shared").alias("at", "entry")).select(
        "cls", "n", "common", (F.col("alone") + F.col("at")).alias("place"), F.col("entry.value").alias("list"))


def _meet_early(na: str, pa_: str, nb: str, pb: str, percent: int) -> Column:
    """Sets that meet first at these places can still share enough shingles to link."""
    left = F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
    return left * (100 + percent) >= (F.col(na) + F.col(nb)) * percent


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    hubs = lists.groupBy("list").agg(F.max(F.struct("common", "cls", "n", "place")).alias("hub")).select(
        "list", F.col("hub.cls").alias("h"), F.col("hub.n").alias("nh"), F.col("hub.place").alias("ph"))
    return (lists.join(hubs.hint("merge"), "list").where((F.col("cls") != F.col("h")) & _meet_early("n", "place", "nh", "ph", percent))
            .select(F.least("cls", "h").alias("a"), F.greatest("cls", "h").alias("b")).distinct())


def remaining_pairs(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of a hot list that are in different groups; one of them is outside the list's main group.

    Of two sets that link, the smaller one (n shingles) shares at least ``2t / (1 + t) * n`` of them,
    so they first meet within its index prefix. Sizes differ by a factor of at most ``1 / t``, so they
    are in one block of a logarithmic scale or in neighbouring ones. ``la`` and ``lb`` are the two groups.
    """
    grouped = (lists.join(labels.hint("merge"), lists["cls"] == labels["node"], "left")
               .select("cls", "n", "place", "list", F.coalesce("label", "cls").alias("label")))
    sizes = grouped.groupBy("list", "label").agg(F.count("*").alias("size"))
    main = (sizes.groupBy("list").agg(F.max(F.struct("size", "label")).alias("main"), F.count("*").alias("groups"))
            .where("groups > 1").select("list", F.col("main.label").alias("main")))
    # The base is a hair above the largest factor, so that rounding cannot part two sets by two blocks.
    block = F.floor(F.log("n") / math.log(100 / percent * (1 + 1e-9)))
    mixed = written(grouped.join(main.hint("merge"), "list").select(
        "list", "cls", "n", "place", "label", (F.col("label") == F.col("main")).alias("in_main"), block.alias("block")), "mixed")
    # Members of the main group meet the others only, the others meet both.
    sides = F.when(F.col("in_main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    index = mixed.where(F.col("place") * (100 + percent) <= F.col("n") * (100 - percent)).select(
        "list", "block", F.explode(sides).alias("side"), F.col("cls").alias("a"), F.col("n").alias("na"),
        F.col("place").alias("ia"), F.col("label").alias("la"))
    probe = mixed.select("list", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"), F.col("in_main").alias("side"),
                         F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("place").alias("ib"), F.col("label").alias("lb"))
    # A shuffle in any case: no side is collected, and a hot list is split by adaptive execution.
    return (index.join(probe.hint("merge"), ["list", "block", "side"])
            .where((F.col("na") <= F.col("nb")) & (F.col("la") != F.col("lb")) & _meet_early("na", "ia", "nb", "ib", percent))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                    F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).distinct())


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated on the smallest hashes of each union; rows are padded sketches."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    first = ~twice & (both != _PAD)
    rank = np.cumsum(first, axis=1)
    shared = (twice & (rank <= SKETCH)).sum(axis=1)
    return shared / np.maximum(np.minimum(rank[:, -1], SKETCH), 1)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidates with the estimate of their union sketch, without those far below the threshold.

    Further columns of ``pairs`` stay.
    """
    share, width = percent / 100, len(pairs.columns)
    least = share - DEVIATIONS * math.sqrt(share * (1 - share) / SKETCH)

    def padded(column: pa.ListArray) -> np.ndarray:
        sizes = np.diff(column.offsets.to_numpy())
        out = np.full((len(column), SKETCH), _PAD, np.uint64)
        out[np.arange(SKETCH) < sizes[:, None]] = column.flatten().to_numpy().view(np.uint64)
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = estimates(padded(batch.column(width)), padded(batch.column(width + 1)))
            kept = batch.select(range(width)).append_column("estimate", pa.array(found))
            yield kept.filter(pa.array(found >= least))

    left = classes.select(F.col("cls").alias("a"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(*pairs.columns, "sa", "sb")
    return both.mapInArrow(run, T.StructType([*both.schema.fields[:width], T.StructField("estimate", T.DoubleType())]))


def full_sets(docs: DataFrame, key: str, text: str, size: int, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The whole shingle set of each of the given classes, made again from one text of the class."""
    wanted = classes.join(nodes.hint("merge"), "cls", "left_semi").select("id", "h")
    read = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"),
                       F.col(f"`{text}`").cast("binary").alias("text")).alias("d")
    found = read.join(wanted.hint("merge").alias("w"), F.expr("d.id <=> w.id AND d.h = w.h"), "left_semi").select("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["cls", "shingles"])

    return found.mapInArrow(run, "cls binary, shingles binary").dropDuplicates(["cls"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity. Further columns of ``pairs`` stay."""
    width = len(pairs.columns)

    def linked(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        same = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * same >= percent * (len(a) + len(b) - same)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [linked(x, y) for x, y in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())]
            yield batch.select(range(width)).filter(pa.array(found, pa.bool_()))

    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(*pairs.columns, "sa", "sb")
    return both.mapInArrow(run, T.StructType(both.schema.fields[:width]))


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from every linked node.

    Every round takes the smallest label around a node and then the label's own label, so the
    rounds grow with the logarithm of the longest chain. Each round is a stored table. An edge of
    every node to itself brings its own label to it, so a round reads the edges and the labels once.
    """
    ends = F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x in "ab" for y in "ab"])
    edges = written(links.select(F.inline(ends)).distinct(), "edges")
    labels = written(edges.groupBy("node").agg(F.min("other").alias("label")), "labels")
    while True:
        own = F.min(F.when(F.col("e.node") == F.col("e.other"), F.col("l.label")))
        nearer = (edges.alias("e").join(labels.hint("merge").alias("l"), F.col("e.other") == F.col("l.node"))
                  .groupBy("e.node").agg(own.alias("own"), F.min("l.label").alias("near")))
        least = F.least("r.near", "l.label")
        labels = written(nearer.alias("r").join(labels.hint("merge").alias("l"), F.col("r.near") == F.col("l.node")).select(
            "r.node", least.alias("label"), (least != F.col("r.own")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def joined_groups(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links`` between the groups ``la`` and ``lb``; only the links are walked.

    A node without a label is a group of its own until a link names it.
    """
    roots = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    found = labels.alias("l").join(roots.hint("merge").alias("r"), F.col("l.label") == F.col("r.node"), "left").select(
        "l.node", F.coalesce("r.label", "l.label").alias("label"))
    alone = roots.alias("r").join(labels.hint("merge").alias("l"), F.col("r.node") == F.col("l.node"), "left_anti")
    return written(found.unionAll(alone.select("node", "label")), "labels")


def grouped(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Per row its key ``id``, text hash ``h``, set size ``n``, class ``cls`` (null without words) and
    ``least``: key and text hash of the first row of its group, null keys last.
    """
    rows = written(sketched(docs, key, text, words), "sketches")
    classes = written(class_table(rows), "classes")
    lists = written(inverted_lists(classes), "lists")
    hot = hot_classes(lists)
    stored = scratch_path(docs.sparkSession, "pairs")
    cold = written_to(estimated(cold_pairs(lists, percent), classes, percent), f"{stored}/cold")
    nodes = cold.select(F.explode(F.array("a", "b")).alias("cls")).unionAll(hot).distinct()
    sets = written(full_sets(docs, key, text, words, classes, nodes), "sets")
    prefixes = written(prefix_lists(sets.join(hot.hint("merge"), "cls", "left_semi"), percent), "prefixes")
    hubs = hub_pairs(prefixes, percent).join(cold.hint("merge"), ["a", "b"], "left_anti")
    pairs = written_to(estimated(hubs, classes, percent), f"{stored}/hubs", f"{stored}/cold")
    # The best candidate of every class first: they join most of a group, and pairs inside a group need no proof.
    sides = pairs.select("a", "b", "estimate", F.explode(F.array("a", "b")).alias("node"))
    best = written(sides.groupBy("node").agg(F.max(F.struct("estimate", "a", "b")).alias("best"))
                   .select("best.a", "best.b").distinct(), "best")
    labels = components(written(confirmed(best, sets, percent), "links"))
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    # Candidates and proofs are jobs of their own: tables and shuffles that start at once add up on the driver.
    apart = written(pairs.join(best.hint("merge"), ["a", "b"], "left_anti").join(left.hint("merge"), "a", "left")
                    .join(right.hint("merge"), "b", "left")
                    .select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).where("la != lb"), "apart")
    more = written(confirmed(apart, sets, percent), "links")
    if not more.isEmpty():
        labels = joined_groups(labels, more)
    tested = written(remaining_pairs(prefixes, labels, percent).join(pairs.hint("merge"), ["a", "b"], "left_anti"), "tested")
    if not tested.isEmpty():
        last = written(confirmed(estimated(tested, classes, percent).drop("estimate"), sets, percent), "links")
        if not last.isEmpty():
            labels = joined_groups(labels, last)
    named = classes.select("cls", F.struct("no_id", "id", "h").alias("first"))
    linked = named.join(labels.hint("merge"), named["cls"] == labels["node"]).select("cls", "first", "label")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    of_class = linked.join(least.hint("merge"), "label").select("cls", "least")
    assigned = named.join(of_class.hint("merge"), "cls", "left").select("cls", F.coalesce("least", "first").alias("least"))
    return rows.select("id", "h", "n", "cls").join(assigned.hint("merge"), "cls", "left")


def near_duplicates(docs: DataFrame, key: str, text: str, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: its key, ``n_shingles``, ``component_id`` and ``kept``.

    Documents whose sets of ``words``-word shingles satisfy ``100 * intersection >= percent *
    union`` are linked; ``component_id`` is the smallest key reachable. A text with fewer words
    is one shingle; one without words (or null) has none, is linked with nothing and keeps its
    own key. Rows without a key take part through their text; a component of such rows alone has
    a null id. Repeated rows give repeated results. Other columns of ``docs`` are not read. An
    empty table gives an empty result.
    """
    found = grouped(docs, key, text, words, percent)
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("least.id"))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, key: str, text: str, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of every group, the one with the smallest key, with all its columns.

    Rows equal in key and text count as one document. Texts without words are in no group and stay.
    """
    found = written(grouped(docs, key, text, words, percent).select("id", "h", "cls", "least"), "groups")
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("h") == F.col("least.h"))
    kept = found.where(F.col("cls").isNull() | first).groupBy("id", "h").agg(F.count("*").alias("rows"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*names).alias("_row"), F.col(f"`{key}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    joined = packed.join(kept.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")))
    single = joined.where("rows = 1").select("_row")
    if kept.where("rows > 1").isEmpty():
        return single.select("_row.*")
    repeated = joined.where("rows > 1").groupBy("_id", "_h").agg(F.any_value("_row").alias("_row")).select("_row")
    return single.unionAll(repeated).select("_row.*")
