"""Packing documents into sequences: order-preserving dynamic programming over cut places.

The tokens of consecutive documents form one row.  It may be cut where a document or a sentence ends,
and inside a sentence only where it is longer than a sequence.  A sequence between two cuts costs its
padding (none at a power of two) plus ``each``; a cut inside a document costs ``penalty`` more.  With
``f`` the least cost up to a cut and ``p`` its place, f(j) = min over i of f(i) + p(i), plus terms of j
alone, so a queue that stays monotone gives the minimum over the last ``size`` tokens; the few
predecessors at a distance of a power of two are tried by themselves.

A task packs its documents in the table's order, in blocks of about ``block`` tokens, so it holds
one block or one document at a time; only a block's last sequence costs padding for the division.
Sequence ids join the partition's number with a counter, and do not depend on other tasks.

Null and empty texts are one end id.  Null and repeated ids are packed like any other row.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin
from rankloom.llm.tokens import encoder

SIZE = 2048
BLOCK = 1 << 20
PENALTY, EACH = 8, 64
#: Pieces that end a sentence in the vocabularies here.
SENTENCE_ENDS = (".", "!", "?", "!!", "...")
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def cuts_of(places: np.ndarray, inner: np.ndarray, size: int, penalty: int = PENALTY, each: int = EACH) -> list[int]:
    """The chosen cuts among ``places`` (ascending, from 0 to the end, gaps of ``size`` at most)."""
    at, n = places.tolist(), len(places)
    extra = (inner * penalty).tolist()
    exact: dict[int, list[int]] = {}
    for power in range(size.bit_length() - 1):  # below ``size``, which has no padding anyhow if it is a power itself
        before = np.searchsorted(places, places - (1 << power))
        for j in np.flatnonzero((before < n) & (places[np.minimum(before, n - 1)] == places - (1 << power))).tolist():
            exact.setdefault(j, []).append(int(before[j]))
    least, via = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, n):
        here = at[j]
        while at[queue[0][1]] < here - size:
            queue.popleft()
        best, i = queue[0]
        best += size - here
        for k in exact.get(j, ()):
            if least[k] < best:
                best, i = least[k], k
        least[j] = best = best + extra[j] + each
        via[j] = i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    chosen, j = [], n - 1
    while j:
        chosen.append(at[j])
        j = via[j]
    return chosen[::-1]


def _places(sizes: np.ndarray, ids: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut places of a block and whether each lies inside a document."""
    total = int(sizes.sum())
    documents = np.cumsum(sizes)
    marked = np.flatnonzero(ends[ids]) + 1
    places = np.unique(np.concatenate([[0], documents, marked]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > size)
    if len(wide):
        places = np.unique(np.concatenate([places, *[np.arange(places[g], places[g + 1], size) for g in wide]]))
    inner = ~np.isin(places, documents)
    inner[0] = False
    return places[places <= total], inner[places <= total]


def pieces(docs: DataFrame, path: str, end_id: int, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document: where its ids lie in the document and in a sequence."""
    begin(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        ends = np.zeros(1 << 16, bool)
        ends[[i for s in SENTENCE_ENDS for i in encode.library.encode(s, add_special_tokens=False).ids[-1:]]] = True
        last, base, numbered = np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId() << 40, 0

        def packed(names: list, parts: list[bytes]) -> pa.RecordBatch:
            nonlocal numbered
            sizes = np.array([len(p) // 2 for p in parts])
            ids = np.frombuffer(b"".join(parts), "<u2")
            cuts = cuts_of(*_places(sizes, ids, ends, size), size)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            wide, edges = ids.astype("<u4"), np.unique(np.concatenate([starts, cuts]))
            begin_, end_ = edges[:-1], edges[1:]
            doc = np.searchsorted(starts, begin_, "right") - 1
            number = np.searchsorted(cuts, begin_, "right")
            opened = np.concatenate([[0], cuts])[number]
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(begin_.tolist(), end_.tolist())]
            out = pa.RecordBatch.from_arrays(
                [pa.array([names[d] for d in doc.tolist()], pa.int64()), *(pa.array(v, pa.int64()) for v in (
                    begin_ - starts[doc], end_ - begin_, crc, sizes[doc], base + numbered + number, begin_ - opened))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            numbered += len(cuts)
            return out

        names, parts, held = [], [], 0
        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                names.append(name)
                parts.append(encode(text.as_py() or "") + last)
                held += len(parts[-1]) // 2
                if held >= block:
                    yield packed(names, parts)
                    names, parts, held = [], [], 0
        if parts:
            yield packed(names, parts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, PIECES)
