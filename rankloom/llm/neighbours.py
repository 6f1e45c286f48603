"""Approximate nearest neighbours by collision counting over single projections.

Vectors are scaled to length one (with one more coordinate where their lengths differ, which turns
the largest inner product into the smallest distance) and projected on ``projections`` random
directions.  A block of vectors keeps one sorted array for each direction.  A query's windows are
centred on its own projections; all candidates in a window collide with it there.  Virtual
rehashing widens all windows together, from ``width`` by steps of ``growth``, until enough vectors have collided
on at least ``share`` of the directions; every one of these is verified on its original vector, in
double precision.  There is no limit on how many are.

Queries and candidates are dealt into blocks and each task holds one block of either.  Blocks hand
on their nearest only, and these are merged in two steps.  Vectors of one dimension meet each other
only.  Vectors that are null, zero, or hold null or non-finite components take no part; repeated
ids are separate candidates, except that a query never returns its own id.  Components of any size are
allowed; a product that overflows is the infinity that double precision gives, or the lowest if it is no number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin, stage

PROJECTIONS = 64
#: Half width of the first window, and its growth; in units of a projection's spread.
WIDTH, GROWTH = 0.5, 1.15
#: Share of the directions on which a candidate has to collide.
SHARE = 0.7
#: A query's windows widen until so many times ``k`` vectors of a block have collided often enough.
ENOUGH = 60
#: At most 65,535 vectors, as places are 16-bit.
BLOCK, QUERY_BLOCK = 8192, 512


def directions(dimension: int, projections: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dimension, projections)).astype(np.float32)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows give equal results wherever they stand."""
    return (x * q).sum(axis=1)


class Block:
    """Sorted projections of a block of vectors, which are given in units of ``top``, the largest ``longest`` long."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, longest: float, projections: int = PROJECTIONS):
        self.ids, self.vectors, self.length = ids, vectors, top * longest
        scaled = vectors / top / longest
        rest = np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))
        self.axes = directions(vectors.shape[1] + 1, projections)
        at = (np.column_stack([scaled, rest]).astype(np.float32) @ self.axes).T
        order = np.argsort(at, axis=1, kind="stable")
        # The sorted arrays lie one after the other, far enough apart to be searched as one.
        self.reach = 2 * float(np.abs(at).max()) + 1
        self.shift = np.arange(len(at)) * 2 * self.reach
        self.base = np.arange(len(at)) * len(ids)
        self.sorted = (np.take_along_axis(at, order, axis=1).astype(np.float64) + self.shift[:, None]).ravel()
        # Where each vector stands in each sorted array: it collides if its place lies in the window.
        self.place = np.empty(at.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
        self.width = WIDTH * (float(at.std(axis=1).mean()) or 1.0)

    def _collisions(self, centre: np.ndarray, width: float) -> np.ndarray:
        """On how many directions each vector lies within ``width`` of the centre."""
        low = np.maximum(np.searchsorted(self.sorted, centre - width, "left") - self.base, 0)
        high = np.minimum(np.searchsorted(self.sorted, centre + width, "right") - self.base, len(self.ids))
        # Places below the window wrap around to large numbers.
        inside = (self.place - low.astype(np.uint16)[:, None]) < np.maximum(high - low, 0).astype(np.uint16)[:, None]
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if len(inside) < 256 else np.uint16)

    def nearest(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the block's best ``k`` for a query among all that collide often enough."""
        n, width = len(self.ids), self.width
        unit = query / np.abs(query).max()
        centre = np.append(unit / np.sqrt(unit @ unit), 0.0).astype(np.float32) @ self.axes + self.shift
        need, goal = int(np.ceil(SHARE * len(centre))), min(n, ENOUGH * k)
        hits = self._collisions(centre, width)
        # A window of full reach holds every vector.
        while np.count_nonzero(hits >= need) < goal and width < self.reach:
            width = min(width * GROWTH, self.reach)
            hits = self._collisions(centre, width)
        found = np.flatnonzero(hits >= need)
        # The next query starts where this one has ended, or one step below if that was wide.
        self.width = width / GROWTH if len(found) > 2 * goal else width
        found = found[self.ids[found] != own]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = self.vectors[found] @ query
            slack = 1e-10 * self.length * np.sqrt(query @ query)
            if len(found) > k and np.isfinite(rough).all() and np.isfinite(slack):
                found = found[rough >= np.partition(rough, -k)[-k] - slack]  # far more than what rounding can move
            scores = exact(self.vectors[found], query)
        scores = np.where(np.isnan(scores), -np.inf, scores)
        if len(found) > k:  # ties with the last one stay for the exact order
            best = scores >= np.partition(scores, -k)[-k]
            found, scores = found[best], scores[best]
        order = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][order], scores[order]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v (double) of the vectors that take part, with their dimension."""
    v = F.col("v")
    return (vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                   & F.exists(v, lambda x: x != 0)).withColumn("dimension", F.size(v)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest; both inputs have id, v and dimension."""
    tops = vectors.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top")))
    sizes = stage(vectors.join(tops, "dimension").groupBy("dimension", "n", "top").agg(F.max(F.sqrt(squares)).alias("longest")))
    asked = queries.groupBy("dimension").agg(F.count(F.lit(1)).alias("q"))
    grid = sizes.join(asked, "dimension").select("dimension", "top", "longest", F.ceil(F.col("n") / block).alias("blocks"),
                                                 F.ceil(F.col("q") / query_block).alias("askers"))
    stored = (vectors.join(grid, "dimension").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")))
              .select("dimension", "top", "longest", "i", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("j"), "id", "v", F.lit(0).alias("side")))
    asking = (queries.join(grid, "dimension").withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), F.col("askers")))
              .select("dimension", "top", "longest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "j", "id", "v", F.lit(1).alias("side")))
    tasks = (stored.unionByName(asking).repartition("dimension", "i", "j").sortWithinPartitions("dimension", "i", "j", "side", "id")
             .select("dimension", "i", "j", "side", "top", "longest", "id", "v"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, made = None, [], None
        for batch in batches:
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in ("dimension", "i", "j", "side", "top", "longest", "id")]
            values, offsets = batch["v"].flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(columns[0])])
            out = []
            for r, (dimension, i, j, side, top, longest, name) in enumerate(zip(*columns)):
                v = values[offsets[r] : offsets[r + 1]]
                if (dimension, i, j) != at:
                    at, held, made = (dimension, i, j), [], None
                if side == 0:
                    held.append((name, v))
                elif held:
                    made = made or Block(np.array([x for x, _ in held]), np.stack([x for _, x in held]), float(top), float(longest))
                    ids, scores = made.nearest(int(name), v, k)
                    out.append((np.full(len(ids), name), ids, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    found = tasks.mapInArrow(scan, "query_id bigint, vec_id bigint, score double")
    order = "ORDER BY score DESC, vec_id"
    # Two steps, so that no task has to take all blocks' rows of many queries at once.
    first = found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(8))).withColumn(
        "rank", F.expr(f"row_number() OVER (PARTITION BY query_id, salt {order})")).where(F.col("rank") <= k)
    return first.drop("salt").withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY query_id {order})")).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The search of all vectors for those whose id is divisible by ``every``."""
    begin(vectors.sparkSession)
    good = usable(vectors, "vec_id", "embedding")
    return search(good, good.where(F.col("id") % every == 0), k)
