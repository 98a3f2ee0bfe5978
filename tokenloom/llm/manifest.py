"""A Merkle manifest of a dataset: per group a tree over its rows, and a root over the groups.

A tree joins every ``ARITY`` consecutive nodes; its last run may be shorter. Witnesses (the
siblings on the way from a leaf to the root) are made incrementally: a leaf is appended with
an empty witness, a subtree stays open until its run is complete, and every completion
extends the witnesses of all leaves below the run. Appends are aligned: a *block* is the
subtree of ``BLOCK`` consecutive leaves, so blocks are built by different tasks, and their
roots are appended in turn as leaves of the tree above, in blocks again, until one is left.
The witnesses of a block's root then extend those of its leaves.

Positions come from running counts over sampled splitters, so no task sees a whole group, and
a block has a fixed number of leaves. Texts are read once, to hash them; after that a row is a
key and digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import row_index
from ..session import written
from .words import small_batches

ARITY = 8
#: Levels of a block, and its leaves.
HEIGHT = 4
BLOCK = ARITY ** HEIGHT
WITNESS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of texts joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field is ``-`` if null, else its UTF-8 bytes' number, ``:`` and itself."""
    def written_out(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*[written_out(c) for c in fields])


class Witnesses:
    """An append-only tree. ``partial`` holds the witness of every leaf as far as it is known."""

    def __init__(self):
        self.partial: list[list[tuple[str, str]]] = []
        #: Per level the closed subtrees whose run is still open: digest, first leaf, end.
        self.open: list[list[tuple[str, int, int]]] = []

    def append(self, found: str) -> None:
        self.partial.append([])
        self._arrive(0, found, len(self.partial) - 1, len(self.partial))

    def _arrive(self, level: int, found: str, first: int, end: int) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((found, first, end))
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        texts = [r[0] for r in run]
        for k, (_, first, end) in enumerate(run):
            step = "".join(texts[:k]), "".join(texts[k + 1:])
            for witness in self.partial[first:end]:
                witness.append(step)
        self._arrive(level + 1, hashlib.sha256("".join(texts).encode()).hexdigest(), run[0][1], run[-1][2])

    def close(self, height: int | None = None) -> str:
        """Complete what is open, up to a height or until one node is left, and return that node."""
        level = 0
        while level < (len(self.open) if height is None else height):
            last = level == len(self.open) - 1 and len(self.open[level]) == 1
            if height is None and last:
                break
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def grown(digests: Sequence[str], block: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and witnesses of one block. Only the first block can be a whole tree of less than full height."""
    tree = Witnesses()
    for found in digests:
        tree.append(found)
    return tree.close(None if block == 0 and len(digests) < BLOCK else HEIGHT), tree.partial


def _members(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Number and digests of the blocks in a batch."""
    digests = batch.column("rows").flatten().field("digest").to_pylist()
    at = 0
    for block, size in zip(batch.column("block").to_pylist(), batch.column("size").to_pylist()):
        yield block, digests[at:at + size]
        at += size


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes ``(g, i, digest, row)`` with their rows in order and their root."""
    member = F.struct((F.col("i") % BLOCK).cast("int").alias("at"), "digest", "row")
    blocks = (nodes.groupBy("g", F.expr(f"i div {BLOCK}").alias("block"))
              .agg(F.sort_array(F.collect_list(member)).alias("rows")).withColumn("size", F.size("rows")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("root", pa.array([grown(d, b)[0] for b, d in _members(batch)], pa.string()))

    return blocks.mapInArrow(run, T.StructType([*blocks.schema.fields, T.StructField("root", T.StringType())]))


def tree(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The stored levels of the trees of all groups; the last has one block and so the root of each.

    ``nodes`` has ``g`` (a struct, so that null groups join), ``i`` (gapless from 0 in the group),
    ``digest`` and ``row`` (a struct that is carried along).
    """
    small_batches(nodes.sparkSession)
    levels = []
    while True:
        levels.append(written(_blocks(nodes), label))
        if levels[-1].where("block > 0").isEmpty():
            return levels
        nodes = levels[-1].select("g", F.col("block").alias("i"), F.col("root").alias("digest"),
                                  F.struct("block").alias("row"))


def _extended(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Rows ``(g, i, row, witness, tag)`` of blocks, given the witness and tag of every block's root."""
    joined = blocks.join(above, ["g", "block"]).select("g", "block", "size", "rows", "witness", "tag")
    row = blocks.schema["rows"].dataType.elementType["row"]
    fields = T.StructType([joined.schema["g"], T.StructField("i", T.LongType()), T.StructField("row", row.dataType),
                           T.StructField("witness", WITNESS), joined.schema["tag"]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (block, digests) in enumerate(_members(batch)):
                one = batch.slice(k, 1)
                upper = [(s["left"], s["right"]) for s in one.column("witness")[0].as_py()]
                n = len(digests)
                same = pa.array([0] * n)
                steps = [[{"left": a, "right": b} for a, b in own + upper] for own in grown(digests, block)[1]]
                yield pa.RecordBatch.from_arrays(
                    [one.column("g").take(same), pa.array(range(block * BLOCK, block * BLOCK + n), pa.int64()),
                     one.column("rows").flatten().field("row"), pa.array(steps, _STEPS), one.column("tag").take(same)],
                    ["g", "i", "row", "witness", "tag"])

    return joined.mapInArrow(run, fields)


def attached(levels: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Rows of the lowest level with whole witnesses; ``above`` has ``g``, ``witness`` and ``tag`` of each tree's root."""
    above = above.withColumn("block", F.lit(0).cast("bigint"))
    for blocks in reversed(levels[1:]):
        above = _extended(blocks, above).select("g", F.col("i").alias("block"), "witness", "tag")
    return _extended(levels[0], above)


def manifest(docs: DataFrame, key: str, group: str, digests: dict[str, Column]) -> DataFrame:
    """Every row's key, group, digests, ``position`` in its group, ``subroot``, ``root`` and ``witness``.

    ``digests`` names one or more digests of a row; the first is its leaf. Leaves are in order of
    the key (null first), and of their digest where keys are equal; groups in order of their value,
    null first. The witness lists, from the leaf upwards, what stands left and right of the node in
    its run. Repeated rows are leaves of their own. A null key or group is a value like any other.
    Names of other columns do not matter. An empty table gives an empty result.
    """
    names = list(digests)
    read = docs.select(F.col(f"`{key}`").alias("key"), F.struct(F.col(f"`{group}`").alias("group")).alias("g"),
                       *[c.alias(f"d{i}") for i, c in enumerate(digests.values())])
    leaves = written(read, "leaves")
    numbered = row_index(leaves, ["key", *[f"d{i}" for i in range(len(names))]], "i", ["g"])
    payload = F.struct("key", *[f"d{i}" for i in range(len(names))]).alias("row")
    levels = tree(numbered.select("g", "i", F.col("d0").alias("digest"), payload), "blocks")
    roots = levels[-1].select("g", F.col("root").alias("subroot"))
    ordered = row_index(roots.select("g.group", "g", "subroot"), ["group"], "i")
    top = tree(ordered.select(F.struct(F.lit(0).alias("all")).alias("g"), "i", F.col("subroot").alias("digest"),
                              F.struct("g", "subroot").alias("row")), "subroots")
    start = top[-1].select("g", F.array().cast(WITNESS).alias("witness"), F.struct("root").alias("tag"))
    above = attached(top, start).select("row.g", "witness", F.struct("row.subroot", "tag.root").alias("tag"))
    rows = attached(levels, above)
    return rows.select(F.col("row.key").alias(key), F.col("g.group").alias(group),
                       *[F.col(f"row.d{i}").alias(n) for i, n in enumerate(names)],
                       F.col("i").alias("position"), "tag.subroot", "tag.root", "witness")


def proof(witness: Column) -> Column:
    """Digest of all siblings, level by level, from left to right."""
    return digest(F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(found: Column, witness: Column) -> Column:
    """The root that a leaf leads to along a witness."""
    return F.aggregate(witness, found, lambda node, s: digest(s["left"], node, s["right"]))
