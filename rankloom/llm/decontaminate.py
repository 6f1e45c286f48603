"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item; an item of fewer words, but not none, is
one window.  For each window length L in the benchmark, words are grouped into k-grams, k = (L + 1) // 2,
and the fingerprint of a window is the smallest of its L - k + 1 k-gram hashes.  Consecutive windows
of a document mostly share that k-gram, so one row stands for such a stretch of windows.  A shared
window has the same fingerprint on both sides, hence every shared span of L words meets in the join.
Hits are then extended: the stretch's windows are compared with the benchmark's as text.

Nulls and empty texts have no words.  Items that repeat an id count once per id.  Windows of items with
a null ``item_id`` are hits like any other; only ``n_items`` and ``items_sha256`` need an id.
Documents that repeat an id and its text each get the same row back; a null ``doc_id`` is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin, bits_of, has_bit, same, stage
from rankloom.llm.words import ALNUM, Words, byte_chunks, mixed, runs

#: A key's rows are dealt out over so many partitions before they meet the benchmark.
SALTS = 32

STRETCHES = "struct<fp:bigint,first:int,last:int,length:int,context:string>"


def _fingerprints(hashes: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of each window of ``length`` words, one per start."""
    k = (length + 1) // 2
    grams = mixed(runs(hashes, k) + np.uint64(length))
    width = length - k + 1
    if len(grams) < width:
        return grams[:0]
    return np.lib.stride_tricks.sliding_window_view(grams, width).min(axis=1)


def _stretches(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each stretch with one fingerprint."""
    first = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]])) if len(fps) else np.zeros(0, int)
    return first, np.concatenate([first[1:] - 1, [len(fps) - 1]]) if len(first) else first


def benchmark_windows(items: DataFrame, span: int = 10) -> DataFrame:
    """item_id, length, fp and text of every window of every item."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in byte_chunks(batch["text"]):
                words = Words(data, at, ALNUM)
                hashes = words.hashes()
                for i in range(len(at) - 1):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    length = int(min(span, b - a))
                    if not length:
                        continue
                    fps = _fingerprints(hashes[a:b], length).view(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "item_id": pa.array([batch["item_id"][row + i].as_py()] * len(fps), pa.int64()),
                        "length": pa.array(np.full(len(fps), length), pa.int32()), "fp": fps,
                        "text": [words.text(a + j, a + j + length) for j in range(len(fps))]})

    return (items.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
            .mapInArrow(windows, "item_id bigint, length int, fp bigint, text string").distinct())


def document_stretches(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """doc_id, a key of the row, n_words, and the stretches whose fingerprint may be the benchmark's."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in byte_chunks(batch["text"]):
                words = Words(data, at, ALNUM)
                hashes, found, n = words.hashes(), [], len(at) - 1
                for i in range(n):
                    a, b, own = words.bounds[i], words.bounds[i + 1], []
                    for length in lengths:
                        fps = _fingerprints(hashes[a:b], length)
                        first, last = _stretches(fps)
                        keep = np.flatnonzero(has_bit(bits, fps[first]))
                        own += [{"fp": int(fps[f].view(np.int64)), "first": int(f), "last": int(e), "length": length,
                                 "context": words.text(a + f, a + e + length)} for f, e in zip(first[keep], last[keep])]
                    found.append(own)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(row, n), batch["row_key"].slice(row, n), pa.array(np.diff(words.bounds), pa.int64()),
                     pa.array(found, pa.list_(pa.struct([("fp", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
                                                         ("length", pa.int32()), ("context", pa.string())])))],
                    names=["doc_id", "row_key", "n_words", "stretches"])

    return (docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), "text")
            .mapInArrow(scan, f"doc_id bigint, row_key bigint, n_words bigint, stretches array<{STRETCHES}>"))


def hits(staged: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, row_key, start, length and text of each document window that is a benchmark window."""
    # Merge joins: Spark estimates the salted sides without their copies and would broadcast too much.
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    known = windows.select("fp", "length").distinct().select("fp", "length", salts).hint("merge")
    texts = windows.select("length", "text").distinct().select("length", "text", salts).hint("merge")
    salt = F.pmod(F.xxhash64("doc_id", "row_key", "first"), F.lit(SALTS)).cast("int").alias("salt")
    stretches = (staged.where(F.size("stretches") > 0).select("doc_id", "row_key", F.explode("stretches").alias("s"))
                 .select("doc_id", "row_key", "s.*").withColumn("salt", salt))
    met = stretches.join(known, ["fp", "length", "salt"])
    # A stretch is split once, as the element of a list of one: a run of one word may be a stretch of a whole text.
    extended = met.select("doc_id", "row_key", "length", "salt", F.explode(F.expr(
        "transform(array(split(context, ' ')), w -> transform(sequence(0, last - first), i -> struct(first + i AS start,"
        " array_join(slice(w, i + 1, length), ' ') AS text)))[0]")).alias("w")).select(
        "doc_id", "row_key", "length", "salt", "w.*")
    return extended.join(texts, ["length", "text", "salt"]).drop("salt")


def covered(found: DataFrame) -> DataFrame:
    """Words inside any hit, by document: intervals in order, each counted beyond those before it."""
    before = F.expr("max(start + length) OVER (PARTITION BY doc_id, row_key ORDER BY start, length "
                    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return (found.select("doc_id", "row_key", "start", "length").distinct().withColumn("before", before)
            .groupBy("doc_id", "row_key")
            .agg(F.sum(F.expr("greatest(0, start + length - greatest(start, coalesce(before, 0)))")).cast("long").alias("n_hit")))


def items_met(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Per document the ids of the items whose windows occur, in string order."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    salt = F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(SALTS)).cast("int").alias("salt")
    owners = windows.select("item_id", "length", "text").distinct().select("item_id", "length", "text", salts).hint("merge")
    return (found.select("doc_id", "row_key", "length", "text").distinct().withColumn("salt", salt)
            .join(owners, ["length", "text", "salt"]).groupBy("doc_id", "row_key")
            .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))


def contamination(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) and row_key of every row of ``docs``."""
    begin(docs.sparkSession)
    windows = stage(benchmark_windows(items, span))
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most ``span`` values
    staged = stage(document_stretches(docs, lengths, bits_of(windows, "fp")))
    found = stage(hits(staged, windows))
    extra = covered(found).alias("c").join(items_met(found, windows).alias("m"), same(F.col("c.doc_id"), F.col("m.doc_id"))
                                           & (F.col("c.row_key") == F.col("m.row_key")), "left").select("c.*", "m.items")
    s, e = staged.drop("stretches").alias("s"), extra.alias("e")
    return (s.join(e, same(F.col("s.doc_id"), F.col("e.doc_id")) & (F.col("s.row_key") == F.col("e.row_key")), "left")
            .select("s.doc_id", "s.row_key", "s.n_words", F.coalesce("e.n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("e.items", F.array().cast("array<string>")).alias("items")))


def clean_documents(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """The documents without any word of a benchmark window, all their columns."""
    dirty = (contamination(docs, items, span).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
             .distinct())
    return docs.join(dirty, same(docs["doc_id"].cast("long"), F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key")), "left_anti")


def report(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """The digest columns of the query."""
    return contamination(docs, items, span).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
