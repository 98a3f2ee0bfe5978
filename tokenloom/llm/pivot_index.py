"""Exact top-k by inner product with a pivot-distance index.

One more coordinate, the square root of what a vector's squared length lacks to the largest one,
makes all vectors equally long; then the largest inner products with a query are the smallest
distances. Each vector is keyed by its nearest pivot and its distance from it, and rings of
distance around the pivots are the cells of the index. For a query at distance d from a pivot, a
cell whose vectors are between a and b away from it holds nothing nearer than max(a - d, d - b).

Cells are taken in the order of that bound. The first ones give every query k answers; after
them all cells, and inside them all blocks, whose bound does not exceed the k-th distance are
looked at. Nothing else can hold an answer, so results are exact.

Pivots come from a bounded sample; every row is indexed. Vectors of a cell are packed into
blocks of at most ``BLOCK`` rows and queries into packs of about ``PACK``, so a cell may hold
any share of all rows: work is dealt out by block and pack.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .words import small_batches

#: Rows that pivots are fitted on, pivots, and rings around each.
SAMPLE = 4096
PIVOTS = 32
RINGS = 8
BLOCK = 512
PACK = 256
#: Answers of different queries that a task holds before it hands them on.
HELD = 20_000


@dataclass
class Layout:
    """Pivots in the space with one more coordinate, ring widths, dimension, largest squared length."""

    pivots: np.ndarray
    widths: np.ndarray
    dim: int
    longest: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest - (vectors * vectors).sum(axis=1), 0.0))
        return np.column_stack([vectors, rest])

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = ((points * points).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)
                   - 2 * points @ self.pivots.T)
        return np.sqrt(np.maximum(squares, 0.0))

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-5 * (1.0 + math.sqrt(self.longest))


@dataclass
class Cells:
    """Number, pivot, nearest and farthest distance and number of vectors of each cell."""

    cell: np.ndarray
    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    size: np.ndarray

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        d = to_pivots[:, self.pivot]
        return np.maximum(np.maximum(self.near - d, d - self.far), 0.0)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; shorter vectors are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = np.floor(scale * column.flatten().to_numpy().astype(np.float64))
    return out


def _stored(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def _loaded(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def fit_layout(rows: DataFrame, scale: int, sample: int = SAMPLE, pivots: int = PIVOTS) -> Layout | None:
    """Pivots by a few rounds of k-means on the rows with the smallest hashes."""
    # At least the squared length of the rounded vector: rounding down adds less than one to a size.
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.abs(F.lit(float(scale)) * x) + 1, F.lit(2.0)))
    found = rows.agg(F.max(F.size("vector")).alias("dim"), F.max(length).alias("longest")).first()
    if found["dim"] is None:
        return None
    dim = max(found["dim"], 1)
    taken = rows.orderBy(F.xxhash64("id", "vector")).limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    layout = Layout(np.zeros((1, dim + 1)), np.ones(1), dim, float(found["longest"] or 0.0))
    points = layout.lifted(_matrix(taken, dim, scale))
    step = max(1, len(points) // pivots)
    layout.pivots = points[::step][:pivots].copy()
    for _ in range(8):
        nearest = layout.distances(points).argmin(axis=1)
        for p in range(len(layout.pivots)):
            if (nearest == p).any():
                layout.pivots[p] = points[nearest == p].mean(axis=0)
    away = layout.distances(points)
    nearest, least = away.argmin(axis=1), away.min(axis=1)
    layout.widths = np.array([max(least[nearest == p].max(initial=0.0) / RINGS, 1e-9) for p in range(len(layout.pivots))])
    return layout


def index_rows(rows: DataFrame, layout: Layout, scale: int) -> DataFrame:
    """Every row with its whole-number vector, cell and distance from the cell's pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        for batch in batches:
            vectors = _matrix(batch.column(1), layout.dim, scale)
            away = layout.distances(layout.lifted(vectors))
            pivot = away.argmin(axis=1)
            least = away[np.arange(len(away)), pivot]
            ring = np.minimum((least / layout.widths[pivot]).astype(np.int64), RINGS - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _stored(vectors), pa.array((pivot * RINGS + ring).astype(np.int32)), pa.array(least)],
                ["id", "vector", "cell", "away"])

    fields = T.StructType([rows.schema["id"], T.StructField("vector", T.BinaryType()),
                           T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    return rows.mapInArrow(run, fields)


def packed_blocks(index: DataFrame, dim: int) -> DataFrame:
    """Rows of a cell in order of distance, packed into blocks. Range partitions split any cell."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.repartitionByRange(parts, "cell", "away", "id").sortWithinPartitions("cell", "away", "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy()
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            cuts = [c for a, b in zip(starts, [*starts[1:], len(cell)]) for c in range(a, b, BLOCK)]
            for a, b in zip(cuts, [*cuts[1:], len(cell)]):
                part = batch.slice(a, b - a)
                away = part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(cell[a])], pa.int32()), pa.array([float(away[0])]), pa.array([float(away[-1])]),
                     pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                     pa.array([b"".join(part.column(1).to_pylist())], pa.binary())],
                    ["cell", "near", "far", "ids", "vectors"])

    return ordered.select("id", "vector", "cell", "away").mapInArrow(
        run, "cell int, near double, far double, ids array<bigint>, vectors binary")


def cell_table(index: DataFrame) -> Cells:
    """At most ``PIVOTS`` * ``RINGS`` rows, whatever the number of vectors."""
    found = index.groupBy("cell").agg(F.min("away").alias("near"), F.max("away").alias("far"),
                                      F.count("*").alias("size")).orderBy("cell").collect()
    cell = np.array([r["cell"] for r in found], np.int32)
    return Cells(cell, cell // RINGS, *[np.array([r[c] for r in found], float) for c in ("near", "far", "size")])


def _visits(queries: DataFrame, layout: Layout, cells: Cells, k: int, later: bool) -> DataFrame:
    """The cells that each query looks at: the first ones, or with ``later`` all others that may matter.

    ``queries`` has id, vector and, for the later cells, ``kth``: the k-th best score so far.
    """
    shared = queries.sparkSession.sparkContext.broadcast((layout, cells))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, cells = shared.value
        for batch in batches:
            vectors = _loaded(batch.column(1), layout.dim)
            to_pivots = layout.distances(np.column_stack([vectors, np.zeros(len(vectors))]))
            bounds = cells.bounds(to_pivots)
            order = np.argsort(bounds, axis=1, kind="stable")
            # Cells in the order of their bounds until there are answers enough besides the query's own row.
            before = np.cumsum(cells.size[order], axis=1) - cells.size[order]
            first = np.zeros(bounds.shape, bool)
            np.put_along_axis(first, order, before < k + 1, axis=1)
            limit = np.full(len(vectors), np.inf)
            if later:
                kth = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                reach = (vectors * vectors).sum(axis=1) + layout.longest - 2 * kth
                limit = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(reach, 0.0)) + layout.slack)
                chosen = ~first & (bounds <= limit[:, None])
            else:
                chosen = first
            rows, columns = np.nonzero(chosen)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(cells.cell[columns]),
                 pa.array(to_pivots[rows, cells.pivot[columns]]), pa.array(limit[rows])],
                ["query", "vector", "cell", "away", "reach"])

    fields = T.StructType([T.StructField("query", T.LongType()), T.StructField("vector", T.BinaryType()),
                           T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()),
                           T.StructField("reach", T.DoubleType())])
    return queries.mapInArrow(run, fields)


def _best(visits: DataFrame, blocks: DataFrame, layout: Layout, k: int, packs: int) -> DataFrame:
    """The best candidates of every query among the blocks of the cells it visits."""
    dim, exact, slack = layout.dim, layout.longest < 2**53, layout.slack
    pack = F.pmod(F.xxhash64("query"), F.lit(packs))
    packed = (visits.groupBy("cell", pack.alias("pack"))
              .agg(F.collect_list(F.struct("query", "vector", "away", "reach")).alias("queries"))
              .select("cell", F.col("queries.query").alias("query"), F.col("queries.vector").alias("vector"),
                      F.col("queries.away").alias("away"), F.col("queries.reach").alias("reach")))
    pairs = packed.join(blocks, "cell").select("query", "vector", "away", "reach", "near", "far", "ids", "vectors")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bool, int]]] = {}

        def answers() -> pa.RecordBatch:
            rows = [(q, i, s) for q, found in held.items() for s, i in found]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64())], ["query", "id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                queries, away, reach = (np.array(batch.column(c)[row].as_py()) for c in (0, 2, 3))
                near, far = batch.column(4)[row].as_py(), batch.column(5)[row].as_py()
                reached = np.flatnonzero(np.maximum(near - away, away - far) <= reach + slack)
                if not len(reached):
                    continue
                asked = np.frombuffer(b"".join(batch.column(1)[row].as_py()), np.float64).reshape(-1, dim)[reached]
                names = batch.column(6)[row].as_py()
                stored = np.frombuffer(batch.column(7)[row].as_py(), np.float64).reshape(-1, dim)
                ids = np.array([np.iinfo(np.int64).max if i is None else i for i in names])
                if exact:
                    scores = (asked @ stored.T).astype(np.int64)
                else:
                    whole = [[int(x) for x in v] for v in stored]
                    scores = np.array([[sum(int(a) * b for a, b in zip(q, v)) for v in whole] for q in asked], object)
                for at, line in zip(queries[reached].tolist(), scores):
                    order = np.lexsort((ids, -line)) if len(ids) <= 4 * k or not exact else None
                    if order is None:
                        some = np.argpartition(-line, k)
                        some = np.flatnonzero(line >= line[some[k]])
                        order = some[np.lexsort((ids[some], -line[some]))]
                    found = [(int(line[o]), names[o]) for o in order[:k + 1] if names[o] != at]
                    # A repeated id of the query's own fills places too: look further then.
                    if len(found) < min(k, int((ids != at).sum())):
                        order = np.lexsort((ids, -line))
                        found = [(int(line[o]), names[o]) for o in order if names[o] != at]
                    both = held.get(at, []) + found[:k]
                    both.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
                    held[at] = both[:k]
            if len(held) > HELD:
                yield answers()
        yield answers()

    found = pairs.mapInArrow(run, "query bigint, id bigint, score bigint")
    return _top(found, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best of all other rows for every query row: query_id, rank, key, score.

    Vectors become floor(scale * x); the score is their inner product in whole numbers, ties go to
    the smaller key. Rows that are null or hold a null or non-finite component take no part.
    Shorter vectors count as filled up with zeros. A query's own rows are those with its key; rows
    repeated under one key are candidates of their own, and ask once. Rows without a key are
    candidates that lose ties and do not ask. Other columns are not read. Scores must fit in 64 bits.
    """
    small_batches(vectors.sparkSession)
    rows = (vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"),
                           F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(F.col("vector"))))
    layout = fit_layout(rows, scale)
    names = [F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score"]
    if layout is None:
        return vectors.sparkSession.createDataFrame([], "query bigint, rank int, id bigint, score bigint").select(*names)
    index = written(index_rows(rows.select("id", "vector"), layout, scale), "index")
    blocks = written(packed_blocks(index, layout.dim), "blocks")
    cells = cell_table(index)
    asking = rows.where(F.col("asks") & F.col("id").isNotNull()).select("id", "vector")
    queries = written(index_rows(asking, layout, scale).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    packs = max(1, math.ceil(queries.count() / PACK))
    first = written(_best(_visits(queries, layout, cells, k, later=False), blocks, layout, k, packs), "first")
    kth = first.where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("kth"))
    again = queries.join(kth, "id", "left").select("id", "vector", "kth")
    second = _best(_visits(again, layout, cells, k, later=True), blocks, layout, k, packs)
    both = first.select("query", "id", "score").unionAll(second.select("query", "id", "score"))
    return _top(both, k).select(*names)
