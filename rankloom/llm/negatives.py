"""Hard-negative mining by a secondary-sort shuffle.

Every component x of a vector becomes floor(256 * x); a pair's score is the inner product of these
integers.  An anchor's positives are its first ``positives`` other rows of the same label, by falling
score, then id.  For each positive of score p, the first ``negatives`` rows of other labels whose
score n has ``low`` * p <= 100 * n <= 100 * p are its hard negatives.

Anchors and rows are dealt into blocks; a task scores one block of either.  It hands on what may be
needed: first each anchor's best rows of its label, and then, once its positives are known, the best
rows of other labels under each of them.  These pairs are shuffled by anchor and sorted within
their partitions by the key (anchor, falling score, positives first, id), the DataFrame form of
repartitionAndSortWithinPartitions.  One pass over the sorted rows opens a window at each positive,
gives each negative to the windows that are open, and closes a window that is full or has been
passed, so nothing of an anchor is held but its open windows.

Rows with a null id, label or vector, or with a null or non-finite component take no part; vectors of
different lengths never meet.  Rows that repeat an id are rows of their own, anchors too; a row is
never its own positive.  Scores are exact whatever the components; a pair whose score does not fit in
64 bits is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin, stage

#: Components of a block of rows, and of a block of anchors.
BLOCK, ANCHOR_BLOCK = 1 << 19, 1 << 16
_SCALE, _LONG = 256, 1 << 63

PAIRS = "anchor bigint, anchor_id bigint, score bigint, kind int, id bigint, row bigint"


def usable(rows: DataFrame, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """id, label, v and dimension of the rows that take part, each with a number of its own."""
    v = F.col("v")
    named = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
                        F.col(vector_column).cast("array<double>").alias("v"))
    good = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
                       & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return stage(good.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", F.size(v).alias("dimension")))


def integers(v: np.ndarray) -> np.ndarray:
    """floor(256 * v): doubles where they are exact in products of all usual sizes, else Python integers."""
    if not v.size or np.abs(v).max() < 2.0**44:
        return np.floor(_SCALE * v)
    # From 2 ** 44 on a double times 256 is an integer, and may be too large for a double.
    return np.array([[int(x) * _SCALE if abs(x) >= 2.0**44 else int(np.floor(_SCALE * x)) for x in row] for row in v], object)


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact inner products of the rows of a and b as 64-bit integers, and where they fit."""
    if a.dtype != object and b.dtype != object and a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2.0**53:
        out = a @ b.T
        return out.astype(np.int64), np.ones(out.shape, bool)
    whole = [np.array([[int(x) for x in row] for row in m], object) for m in (a, b)]
    out = whole[0] @ whole[1].T
    fits = ((out >= -_LONG) & (out < _LONG)).astype(bool)
    return np.where(fits, out, 0).astype(np.int64), fits


def first_of(scores: np.ndarray, ids: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """The places in ``where`` of the n highest scores, equal ones by id."""
    if len(where) > n:
        own = scores[where]
        where = where[own >= np.partition(own, -n)[-n]]
    return where[np.lexsort((ids[where], -scores[where]))[:n]]


def in_blocks(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Blocks of anchors beside blocks of rows, each (dimension, i, j) in one partition, its rows first."""
    sizes = stage(rows.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")))
    asked = anchors.groupBy("dimension").agg(F.count(F.lit(1)).alias("m"))
    grid = sizes.join(asked, "dimension").select(
        "dimension", F.ceil(F.col("n") * F.col("dimension") / BLOCK).alias("blocks"),
        F.ceil(F.col("m") * F.col("dimension") / ANCHOR_BLOCK).alias("askers"))

    def dealt(side: int, own: str, other: str, places: str, copies: str) -> tuple:
        return (F.lit(side).alias("side"), F.pmod(F.xxhash64("row"), F.col(places)).alias(own),
                F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)).alias(other))

    columns = ["dimension", "i", "j", "side", "row", "id", "label", "v", "under"]
    held = rows.join(grid, "dimension").select("dimension", *dealt(0, "i", "j", "blocks", "askers"), "row", "id", "label", "v",
                                               F.lit(None).cast("array<bigint>").alias("under")).select(*columns)
    asking = anchors.join(grid, "dimension").select("dimension", *dealt(1, "j", "i", "askers", "blocks"), "row", "id", "label", "v",
                                                    "under").select(*columns)
    return held.unionByName(asking).repartition("dimension", "i", "j").sortWithinPartitions("dimension", "i", "j", "side")


def best_pairs(rows: DataFrame, anchors: DataFrame, n: int, low: int | None) -> DataFrame:
    """Pairs of anchors and rows that a block hands on.

    Without ``low``, each anchor's first n rows of its label (kind 0); else its first n rows of other
    labels in the window of each score in ``under`` (kind 1).
    """

    def chosen(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, same: np.ndarray, itself: np.ndarray, under: list) -> np.ndarray:
        if low is None:
            return first_of(scores, ids, np.flatnonzero(fits & same & ~itself), n)
        where = np.flatnonzero(fits & ~same)
        own, found = scores[where], [np.zeros(0, np.int64)]
        for p in {p for p in under if p >= 0}:  # a window under a negative score is empty
            found.append(first_of(scores, ids, where[(own <= p) & (own >= -(-low * p // 100))], n))
        return np.unique(np.concatenate(found))

    def answered(held: list, asking: list) -> pa.RecordBatch:
        out = []
        if held and asking:
            names, ids, labels = (np.array([x[c] for x in held], np.int64) for c in (0, 1, 2))
            stored = integers(np.stack([x[3] for x in held]))
            for first in range(0, len(asking), 64):
                part = asking[first : first + 64]
                scores, fits = products(integers(np.stack([x[3] for x in part])), stored)
                for s, f, (row, own, label, _, under) in zip(scores, fits, part):
                    got = chosen(s, f, ids, labels == label, names == row, under)
                    out.append((np.full(len(got), row), np.full(len(got), own), s[got], np.full(len(got), int(low is not None), np.int32),
                                ids[got], names[got]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)] + [np.zeros(0, np.int64)] * 2
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "anchor_id", "score", "kind", "id", "row"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, asking = None, [], []
        for batch in batches:
            dimension, i, j, side, row, name, label = (batch[c].to_numpy(zero_copy_only=False) for c in ("dimension", "i", "j", "side", "row", "id", "label"))
            values, under = batch["v"].flatten().to_numpy(zero_copy_only=False), batch["under"].to_pylist()
            ends = np.cumsum(dimension)
            for r in range(len(row)):
                if (dimension[r], i[r], j[r]) != at:
                    if asking:
                        yield answered(held, asking)
                    at, held, asking = (dimension[r], i[r], j[r]), [], []
                (asking if side[r] else held).append((row[r], name[r], label[r], values[ends[r] - dimension[r] : ends[r]], under[r] or []))
        if asking:
            yield answered(held, asking)

    return in_blocks(rows, anchors).mapInArrow(scan, PAIRS)


def first_rows(pairs: DataFrame, n: int) -> DataFrame:
    """Each anchor's first n pairs, in two steps, so that no task takes all blocks' rows of an anchor at once."""
    order = "ORDER BY score DESC, id, row"
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(8))).withColumn(
        "place", F.expr(f"row_number() OVER (PARTITION BY anchor, salt {order})")).where(F.col("place") <= n)
    return salted.drop("salt").withColumn("place", F.expr(f"row_number() OVER (PARTITION BY anchor {order})")).where(
        F.col("place") <= n).drop("place")


def windows_of(pairs: DataFrame, n: int, low: int) -> DataFrame:
    """The hard negatives, from one pass over the pairs in the order of their keys."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, windows = None, []  # open ones: positive's id, its score, negatives so far
        for batch in batches:
            out = []
            for anchor, anchor_id, score, kind, name in zip(*(batch[c].to_pylist() for c in ("anchor", "anchor_id", "score", "kind", "id"))):
                if anchor != at:
                    at, windows = anchor, []
                if kind == 0:
                    windows.append([name, score, 0])
                    continue
                windows = [w for w in windows if w[2] < n and low * w[1] <= 100 * score]
                for w in windows:
                    w[2] += 1
                    out.append((anchor_id, w[0], w[2], name, w[1], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    keyed = pairs.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "id", "row")
    return keyed.mapInArrow(stream, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def mined(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; ``rows`` are as from ``usable``, ``anchors`` some of them."""
    first = stage(first_rows(best_pairs(rows, anchors.withColumn("under", F.lit(None).cast("array<bigint>")), positives, None), positives))
    goals = first.groupBy("anchor").agg(F.collect_list("score").alias("under"))
    asking = stage(anchors.join(goals, F.col("row") == F.col("anchor")).drop("anchor"))
    return windows_of(first.unionByName(best_pairs(rows, asking, negatives, low)), negatives, low)


def report(vectors: DataFrame, every: int = 100) -> DataFrame:
    """The query: every seventh id moves to the next label, ids divisible by ``every`` are anchors."""
    begin(vectors.sparkSession)
    moved = vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    rows = usable(moved, "vec_id", "label", "embedding")
    return mined(rows, rows.where(F.col("id") % every == 0))
