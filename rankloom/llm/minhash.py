"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has t coordinates, filled in rounds.  In each of the first t rounds every shingle is hashed
to one coordinate and a value there; in round t + j every shingle goes to coordinate j, so that none
stays empty.  A coordinate keeps the smallest (round, value), and a document leaves once all its
coordinates are filled.  The coordinates agree with a probability of the Jaccard similarity, with
concentration bounds of t independent hashes, for O(n + t log t) hash evaluations.

Bands of ``rows`` coordinates are taken as many as needed for a pair at the threshold to share none
with a probability of at most ``miss``.  Equal shingle sets are one class and only classes are compared.  In each
bucket all classes are compared with the one that shares most buckets with others, and confirmed on
whole sets.  Whatever then still lies in one bucket but in different components is compared
block by block inside tasks that return only links, so no candidate is left out.

Texts with no words (null, empty, white space) have an empty set and no link.  Rows that repeat a ``doc_id``
are one document with the sets of all its texts: it is linked where one of them is, and each row gets its
own number of shingles and the document's component.  Rows without an id take no part and are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import SET_FILTER_BITS, begin, bits_of, has_bit
from rankloom.llm.common import stage_by_shuffles as stage
from rankloom.llm.components import components
from rankloom.llm.words import SPACED, Words, byte_chunks, mixed, runs

ROWS = 4
MISS = 1e-6


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    hashes, out = words.hashes(), []
    whole = runs(hashes, size)
    for i in range(len(words.bounds) - 1):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a < size:
            out.append(runs(hashes[a:b], int(b - a)) if b > a else hashes[:0])
            continue
        one = np.sort(whole[a : b - size + 1])
        out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates for each set; those of empty sets mean nothing."""
    n = len(sets)
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    elements = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    base = np.repeat(np.arange(n) * t, [len(s) for s in sets])
    for i in range(2 * t):
        if not len(elements):
            break
        h = mixed(elements + np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64))
        place = (h % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, base + place, np.uint64(i << 55) | (h >> np.uint64(9)))
        filled = (out.reshape(n, t) != np.iinfo(np.uint64).max).all(axis=1)
        left = ~filled[base // t]
        elements, base = elements[left], base[left]
    return out.reshape(n, t)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and one key for each band."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in byte_chunks(batch["text"]):
                sets = shingle_sets(Words(data, at, SPACED), size)
                sketch = sketches(sets, bands * rows).reshape(len(sets), bands, rows)
                keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands)).copy()
                for j in range(rows):
                    keys = mixed(keys * np.uint64(0xC2B2AE3D27D4EB4F) + sketch[:, :, j])
                keys = keys.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id and shingle set of the rows whose id may be in ``ids``; a fixed-size filter spares most others."""
    bits = bits_of(ids.select(F.xxhash64("id").alias("h")), "h", SET_FILTER_BITS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = has_bit(bits, batch["h"].to_numpy(zero_copy_only=False).view(np.uint64))
            kept = batch.filter(pa.array(keep))
            for row, data, at in byte_chunks(kept["text"]):
                sets = shingle_sets(Words(data, at, SPACED), size)
                yield pa.RecordBatch.from_arrays([kept["id"].slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["id", "grams"])

    return (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
            .select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(scan, "id bigint, grams binary"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on whole sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["ga"], batch["gb"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ga", "gb").mapInArrow(scan, "a bigint, b bigint")


def _forest(names: list, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple]:
    """Links between members of different sides (or of side 0 alone) that join all that are linked."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    column = np.cumsum(np.concatenate([[0], tokens[1:] != tokens[:-1]]))
    common = np.bincount(column)[column] > 1
    column, owner = column[common], owner[common]
    rows, cols = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n), np.arange(n))
    both = np.zeros((len(rows), len(cols)), np.float32)
    # Sets as 0/1 rows, some thousand shingles at a time: products are the sizes of intersections.
    edges = np.searchsorted(column, np.arange(0, column[-1] + 4097, 4096)) if len(column) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:]):
        part = np.zeros((n, 4096), np.float32)
        part[owner[a:b], column[a:b] % 4096] = 1
        both += part[rows] @ part[cols].T
    linked = 100 * both >= percent * (sizes[rows][:, None] + sizes[cols][None, :] - both)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(linked).tolist():
        x, y = root(int(rows[i])), root(int(cols[j]))
        if x != y and names[rows[i]] != names[cols[j]]:
            parent[x] = y
            out.append((names[rows[i]], names[cols[j]]))
    return out


def linked_in_families(docs: DataFrame, members: DataFrame, size: int, percent: int, block: int = 512, weight: int = 1 << 20) -> DataFrame:
    """Links (a, b) within families: classes joined through buckets whose members are not yet one component.

    A family is cut into blocks of about ``block`` members and ``weight`` shingles (column n of ``members``) at most
    on average, and a task holds two blocks.  All their
    pairs are compared there, but only links come out, at most one fewer than there are members.
    """
    lowest = members.groupBy("bucket").agg(F.min("id").alias("low"))
    family = components(members.join(lowest, "bucket").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    ids = members.groupBy("id").agg(F.max("n").alias("n"))
    named = stage(ids.join(family, ids.id == family.node, "left").select("id", "n", F.coalesce("root", "id").alias("family")))
    held = named.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / weight)).alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    grid = (named.join(held, "family").withColumn("own", own)
            .select("id", "family", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .select("id", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")))
    sets = stage(sets_of(docs, named.select("id"), size).distinct())
    tasks = grid.join(sets, "id").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, held_sets, sides = None, [], [], []

        def links() -> pa.RecordBatch:
            found = _forest(names, held_sets, np.array(sides), percent) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())],
                                              names=["a", "b"])

        for batch in batches:
            for name, f, i, j, side, grams in zip(*(batch[c].to_pylist() for c in ("id", "family", "i", "j", "side")), batch["grams"]):
                if (f, i, j) != at:
                    if at:
                        yield links()
                    at, names, held_sets, sides = (f, i, j), [], [], []
                names.append(name)
                held_sets.append(np.frombuffer(grams.as_py(), np.uint64))
                sides.append(side)
        if at:
            yield links()

    return tasks.select("id", "family", "i", "j", "side", "grams").mapInArrow(scan, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) of every row."""
    begin(docs.sparkSession)
    signed = stage(signatures(docs, size, bands_for(percent, rows, miss), rows))
    classes = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands"))
    placed = stage(classes.select("id", "n", F.explode("bands").alias("bucket")))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    members = stage(placed.join(shared, "bucket"))
    # The class that shares buckets with most others is the centre of each of its buckets.
    popular = members.groupBy("id").agg(F.sum("held").alias("fame"))
    famed = stage(members.join(popular, "id").select("bucket", "id", "n", "fame"))
    centres = famed.groupBy("bucket").agg(F.max(F.struct("fame", F.col("id").alias("a"), F.col("n").alias("na"))).alias("c"))
    alike = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    star = stage(famed.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb")).join(centres.select("bucket", "c.a", "c.na"), "bucket")
                 .where(f"a <> b AND {alike}").select("a", "b").distinct())
    sets = stage(sets_of(docs, star.select(F.explode(F.array("a", "b")).alias("id")), size).distinct())
    links = stage(verified(star, sets, percent))
    roots = components(links)
    rooted = famed.join(roots, famed.id == roots.node, "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    open_ = stage(rooted.join(split, "bucket"))
    classed = stage(signed.drop("bands").join(classes.select("digest", F.col("id").alias("class_id")), "digest", "left")
                    .withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))))
    # A document with several texts joins their classes.
    own = classed.where("class_id <> doc_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    several = own.join(classed.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count_if(F.col("digest").isNull()).alias("bare"))
                       .where("low <> high OR bare > 0").select(F.col("doc_id").alias("a")), "a", "left_semi")
    found = stage(links.select("a", "b").unionByName(linked_in_families(docs, open_, size, percent)).unionByName(several))
    final = components(found)
    return classed.join(final.hint("merge"), F.col("class_id") == final.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "class_id").alias("component_id"))


def report(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The digest columns of the query."""
    return near_duplicates(docs, size, percent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are linked with a smaller ``doc_id``; null ids stay."""
    gone = report(docs, size, percent).where("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_id"), "left_anti")
