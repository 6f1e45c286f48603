"""Ranked lexical search: accumulator-limited term-at-a-time evaluation.

A document with n terms has m = 100 - b + (b * n * N) div L; a term with tf occurrences in it scores
w * ((10^9 * tf) div (1000 * tf + 8 * m)), where w = floor(1000 * ln((2 N + 2) / (2 df + 1))).  N counts the
documents with a term, L all terms.  All but the logarithm is integer arithmetic.

Documents are read once for N, L and postings: each shard of some megabytes of text becomes one row,
an inverted index of those of its terms that items ask for.  Items are dealt into blocks, and every
shard meets every block in an equi-join.  For one item a shard takes the terms rarest first.  A term
opens accumulators for its documents as long as the bounds of the terms from it on together reach the
k-th best partial score; from then on no new document can enter, and the terms that are left only update
accumulators that can still get there.  Bounds are the largest scores of a term in its shard, so each
shard's first k are exact, and so is their merger.

Terms are told apart by a 64-bit hash.  An item's row is one query: rows that repeat an id and its text
are one, other rows of that id are queries of their own.  Items without terms (null, empty, signs)
find nothing, a null item_id is kept.  Documents that repeat a doc_id count and rank as rows of their
own; among equal scores a null doc_id comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin, bits_of, has_bit, stage
from rankloom.llm.words import ALNUM, Words, byte_chunks

#: Bytes of text of a shard, and terms of a block of items.
SHARD, BLOCK = 1 << 24, 1 << 14
#: Shards that share a copy of the blocks.
GROUP = 16
#: Weight of a document's length, in hundredths.
LENGTH_SHARE = 90

INDEX = "shard string, n_terms bigint, n_docs bigint, ids array<bigint>, lengths array<bigint>, terms array<bigint>, ends array<int>, places array<int>, counts array<int>"


def item_terms(items: DataFrame) -> DataFrame:
    """item (a key of the row), item_id and term: the distinct terms of every item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in byte_chunks(batch["text"]):
                words, n = Words(data, at, ALNUM), len(at) - 1
                hashes = words.hashes().view(np.int64)
                terms = [np.unique(hashes[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch["item"].slice(row, n), batch["item_id"].slice(row, n), pa.array(terms, pa.list_(pa.int64()))],
                                                 names=["item", "item_id", "terms"])

    named = items.where("text IS NOT NULL").select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long"), "text")
    return (named.mapInArrow(scan, "item bigint, item_id bigint, terms array<bigint>").groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("terms").alias("terms"))
            .select("item", "item_id", F.explode("terms").alias("term")))


class Shard:
    """Postings of the documents of a shard, gathered chunk by chunk."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.bytes, self.docs, self.n_terms = bits, 0, 0, 0
        self.ids, self.lengths, self.postings = [], [], []

    def add(self, ids: list, data: np.ndarray, at: np.ndarray) -> None:
        words = Words(data, at, ALNUM)
        hashes, n = words.hashes(), np.diff(words.bounds)
        asked = np.flatnonzero(has_bit(self.bits, hashes))
        doc = np.searchsorted(words.bounds, asked, "right") - 1 + self.docs
        order = np.lexsort((doc, hashes[asked].view(np.int64)))
        term, doc = hashes[asked].view(np.int64)[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.zeros(0, int)
        self.postings.append((term[first], doc[first].astype(np.int32), np.diff(np.append(first, len(term))).astype(np.int32)))
        self.ids += ids
        self.lengths.append(n)
        self.docs, self.bytes, self.n_terms = self.docs + len(n), self.bytes + len(data), self.n_terms + int(n.sum())

    def row(self, name: str) -> pa.RecordBatch:
        term, doc, count = (np.concatenate(c) for c in zip(*self.postings))
        order = np.argsort(term, kind="stable")  # chunks come in document order
        term, doc, count = term[order], doc[order], count[order]
        ends = np.flatnonzero(np.append(term[1:] != term[:-1], True)) + 1 if len(term) else np.zeros(0, int)
        lengths = np.concatenate(self.lengths)
        lists = [pa.array(self.ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(term[ends - 1], pa.int64()), pa.array(ends, pa.int32()),
                 pa.array(doc, pa.int32()), pa.array(count, pa.int32())]
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([self.n_terms], pa.int64()), pa.array([int((lengths > 0).sum())], pa.int64())]
            + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists],
            names=["shard", "n_terms", "n_docs", "ids", "lengths", "terms", "ends", "places", "counts"])


def index(docs: DataFrame, vocabulary: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """One row for each shard; a longer text is a shard of its own.

    Terms that a fixed-size filter takes for asked ones are kept too; no item finds them."""
    bits = bits_of(vocabulary, "term")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, made = Shard(bits), 0

        def name() -> str:
            return f"{TaskContext.get().partitionId()}-{made}"

        for batch in batches:
            for row, data, at in byte_chunks(batch["text"]):
                shard.add(batch["doc_id"].slice(row, len(at) - 1).to_pylist(), data, at)
                if shard.bytes >= shard_bytes:
                    yield shard.row(name())
                    shard, made = Shard(bits), made + 1
        if shard.docs:
            yield shard.row(name())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, INDEX)


def weighted(terms: DataFrame, shards: DataFrame) -> tuple[DataFrame, int, int]:
    """The items' terms that occur, with df and w; and N and L."""
    total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = shards.select(F.explode(F.expr(
        "transform(terms, (t, i) -> struct(t AS term, ends[i] - if(i = 0, 0, ends[i - 1]) AS df))")).alias("t")).select("t.*")
    df = held.groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * total[0] + 2) / (2 * F.col("df") + 1))).cast("long")
    return terms.join(df, "term").select("item", "item_id", "term", "df", w.alias("w")), total[0], total[1]


def item_blocks(terms: DataFrame, blocks: int) -> DataFrame:
    """j and its items, each with its terms, rarest first."""
    own = terms.groupBy("item").agg(F.first("item_id").alias("item_id"), F.array_sort(F.collect_list(F.struct("df", "term", "w"))).alias("t"))
    return own.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("j")).agg(F.collect_list(F.struct("item", "item_id", F.col("t.term").alias("term"), F.col("t.w").alias("w"))).alias("items"))


class Searcher:
    """One shard, ready for items."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, counts: np.ndarray, n: int, total: int, share: int):
        self.docs = len(lengths)
        self.at = {t: (a, b) for t, a, b in zip(terms.tolist(), [0, *ends[:-1].tolist()], ends.tolist())}
        m = 100 - share + share * lengths * n // max(1, total)
        self.places = places
        tf = counts.astype(np.int64)
        self.scores = 1_000_000_000 * tf // (1000 * tf + 8 * m[places])
        self.most: dict[int, int] = {}

    def bound(self, term: int) -> int:
        if term not in self.most:
            a, b = self.at[term]
            self.most[term] = int(self.scores[a:b].max())
        return self.most[term]

    def first(self, terms: list[int], weights: list[int], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best k for an item's terms, rarest first; equal scores by ``ids``."""
        own = [(t, w) for t, w in zip(terms, weights) if w > 0 and t in self.at]
        left = np.cumsum([w * self.bound(t) for t, w in own][::-1])[::-1].tolist()
        scores, alive, goal = np.zeros(self.docs, np.int64), None, 0
        for (t, w), rest in zip(own, left):
            a, b = self.at[t]
            places, gain = self.places[a:b], w * self.scores[a:b]
            if alive is None and rest < goal:
                # What has no accumulator by now cannot reach the k-th place.
                alive = np.flatnonzero(scores)
            if alive is None:
                scores[places] += gain
                goal = self._kth(scores[scores > 0], k)
                continue
            alive = alive[scores[alive] + rest >= goal]
            at = np.searchsorted(places, alive)
            at[at == len(places)] = 0
            met = places[at] == alive
            scores[alive[met]] += gain[at[met]]
            goal = self._kth(scores[alive], k)
        found = np.flatnonzero(scores) if alive is None else alive
        own = scores[found]
        if len(found) > k:
            keep = own >= np.partition(own, -k)[-k]
            found, own = found[keep], own[keep]
        order = np.lexsort((ids[found], -own))[:k]
        return found[order], own[order]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> int:
        return int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = SHARD, block: int = BLOCK, share: int = LENGTH_SHARE) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k highest scores above 0."""
    begin(docs.sparkSession)
    asked = stage(item_terms(items))
    shards = stage(index(docs, asked.select("term").distinct(), shard_bytes))
    terms, n, total = weighted(asked, shards)
    terms = stage(terms)
    blocks = max(1, -(-terms.count() // block))
    # Copies of the blocks, one for some shards each, so that no key of this join is hot.
    groups = max(1, -(-shards.count() // GROUP))
    own = shards.withColumn("g", F.pmod(F.xxhash64("shard"), F.lit(groups))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    copies = stage(item_blocks(terms, blocks)).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    tasks = own.join(copies.hint("merge"), ["j", "g"]).select("ids", "lengths", "terms", "ends", "places", "counts", "items")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, *rest = (batch[c][r].values for c in ("ids", "lengths", "terms", "ends", "places", "counts"))
                searcher = Searcher(*(x.to_numpy() for x in rest), n, total, share)
                keys = ids.fill_null(np.iinfo(np.int64).max).to_numpy()  # a null id comes last
                out = []
                for q in batch["items"][r].as_py():
                    places, scores = searcher.first(q["term"], q["w"], keys, k)
                    out += [(q["item"], q["item_id"], int(p), int(x)) for p, x in zip(places, scores)]
                if out:
                    item, item_id, place, score = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(item_id, pa.int64()), ids.take(pa.array(place)), pa.array(score, pa.int64())],
                                                     names=["item", "item_id", "doc_id", "score"])

    found = tasks.mapInArrow(scan, "item bigint, item_id bigint, doc_id bigint, score bigint")
    order = "ORDER BY score DESC, doc_id NULLS LAST"
    # Two steps, so that no task takes all shards' rows of an item at once.
    first = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(8))).withColumn(
        "rank", F.expr(f"row_number() OVER (PARTITION BY item, salt {order})")).where(F.col("rank") <= k)
    return first.drop("salt").withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY item {order})")).where(
        F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
