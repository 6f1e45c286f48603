"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams of words, and of n-grams of word shapes (letters and digits
collapsed to one sign each, other signs kept), hashed into a fixed table.  Each is scaled by the
logarithm of the ratio of its smoothed document shares in the two classes; on these a linear model
with hinge loss is fitted by dual coordinate descent, and a logistic curve maps its margin to 0..1.

The fit reads at most ``sample`` labelled documents (those with the smallest hash of their id), all
in one task; scoring covers every document.  Null and empty texts have no features and get the score
of the intercept.  Labels other than 0 and 1 are not used; an id with contradictory labels counts
as 0.  Without labels of both classes every score is the share of label 1, or 1 without any label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin
from rankloom.llm.words import SPACED, Words, byte_chunks, mixed, runs

TABLE_BITS = 18
SAMPLE = 8000
#: An n-gram counts if it occurs in so many documents of the sample.
MIN_DOCS = 5
THRESHOLD = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = ord("A"), ord("a"), ord("a"), ord("0")
_LETTERS = np.zeros(256, bool)
_LETTERS[[ord("A"), ord("a"), ord("0")]] = True


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _SHAPE[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_LETTERS[kind[1:]]
    keep[offsets[:-1][offsets[:-1] < len(kind)]] = True
    return kind[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(table slot of each n-gram, text it stands in), for each kind of n-gram."""
    out = []
    for number, (d, o) in enumerate(((data, offsets), _shapes(data, offsets))):
        words = Words(d, o, SPACED, lower=False)
        hashes = words.hashes()
        for n in (1, 2):
            h = mixed(runs(hashes, n) + np.uint64(2 * number + n)) & np.uint64((1 << TABLE_BITS) - 1)
            text = np.repeat(np.arange(len(o) - 1), np.diff(words.bounds))[: len(h)]
            if n == 2 and len(h):
                inside = np.arange(len(h)) + 1 < words.bounds[text + 1]
                h, text = h[inside], text[inside]
            out.append((h.astype(np.int64), text))
    return out


def rows_of(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) in that order; ``known`` says which slots matter."""
    keys = []
    for slot, text in grams(data, offsets):
        if known is not None:
            keep = known[slot]
            slot, text = slot[keep], text[keep]
        keys.append(text << TABLE_BITS | slot)
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key >> TABLE_BITS, key & ((1 << TABLE_BITS) - 1)


def descend(rows: list[np.ndarray], ratio: np.ndarray, sign: np.ndarray, cost: np.ndarray, epochs: int = 12) -> np.ndarray:
    """Linear hinge-loss weights by dual coordinate descent; the last weight is the intercept's."""
    w, alpha = np.zeros(len(ratio) + 1), np.zeros(len(rows))
    values = [ratio[r] for r in rows]
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            margin = sign[i] * (w[rows[i]] @ values[i] + w[-1])
            new = min(max(alpha[i] - (margin - 1) / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the label over the margin, by Newton steps."""
    a, b = 1.0, 0.0
    goal = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((label == 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - goal) * margin).sum(), (p - goal).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fitted(texts: pa.Array, label: np.ndarray) -> dict:
    """Model of a bounded sample: weights of the table's slots, intercept, slope and shift."""
    size = 1 << TABLE_BITS
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 1.0
        return {"weights": np.zeros(size, np.float32).tobytes(), "at": 0.0, "slope": 1.0, "shift": float(np.log((share + 1e-6) / (1 - share + 1e-6)))}
    rows = []
    for _, data, at in byte_chunks(texts):
        text, slot = rows_of(data, at)
        rows += np.split(slot, np.searchsorted(text, np.arange(1, len(at) - 1)))
    held = np.bincount(np.concatenate(rows), minlength=size)
    pos = np.bincount(np.concatenate([r for r, y in zip(rows, label) if y == 1]), minlength=size) + 1.0
    neg = np.bincount(np.concatenate([r for r, y in zip(rows, label) if y == 0]), minlength=size) + 1.0
    ratio = np.where(held >= MIN_DOCS, np.log(pos / (label.sum() + 2)) - np.log(neg / ((label == 0).sum() + 2)), 0.0)
    rows = [r[ratio[r] != 0] for r in rows]
    sign, share = np.where(label == 1, 1.0, -1.0), label.mean()
    cost = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) * 0.1
    # The curve is fitted on margins of documents that the weights have not seen.
    fold, margin = np.arange(len(label)) % 3, np.zeros(len(label))
    for f in range(3):
        part = np.flatnonzero(fold != f)
        w = descend([rows[i] for i in part], ratio, sign[part], cost[part])
        for i in np.flatnonzero(fold == f):
            margin[i] = w[rows[i]] @ ratio[rows[i]] + w[-1]
    slope, shift = _curve(margin, label)
    w = descend(rows, ratio, sign, cost)
    return {"weights": (w[:-1] * ratio).astype(np.float32).tobytes(), "at": float(w[-1]), "slope": slope, "shift": shift}


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def model_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The fitted model: one task reads ``sample`` documents at most, the driver gets one row of about 1 MB."""
    chosen = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
              .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    texts = (docs.join(F.broadcast(chosen), docs["doc_id"].cast("long") == F.col("_id"))
             .select("_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
             .groupBy("_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_id")
        return pd.DataFrame([fitted(pa.array(part["text"], pa.string()), part["quality"].to_numpy())])

    found = texts.groupBy().applyInPandas(fit, "weights binary, at double, slope double, shift double").collect()
    return found[0].asDict() if found else fitted(pa.array([], pa.string()), np.zeros(0, int))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` with ``score``: the likelihood of label 1, from the whole text alone."""
    weights = np.frombuffer(bytes(model["weights"]), np.float32)
    names = list(docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights != 0
        for batch in batches:
            for row, data, at in byte_chunks(batch["_text"]):
                n = len(at) - 1
                text, slot = rows_of(data, at, known)
                margin = np.bincount(text, weights[slot], minlength=n) + model["at"]
                score = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["shift"], -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(row, n) for c in batch.schema.names[:-1]), pa.array(score)],
                                                 names=[*batch.schema.names[:-1], "_score"])

    # Columns get neutral names on the way, so that none can clash.
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text").alias("_text"))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)] + ["_score double"])
    return inner.mapInArrow(scan, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_score").alias("score"))


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The digest columns of the query."""
    begin(docs.sparkSession)
    return scored(docs.select("doc_id", "text"), model_of(docs, labels, sample)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, all their columns."""
    begin(docs.sparkSession)
    names = list(docs.columns)
    return scored(docs, model_of(docs, labels, sample)).where(F.col("score") >= threshold).select(*names)
