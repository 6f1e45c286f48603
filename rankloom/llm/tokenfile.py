"""Token-id files: zstandard with a shared dictionary, one frame for each document.

A file holds consecutive documents in ascending doc_id order:

    magic "TOKZ1\\0"       6 bytes
    width                  u16, bytes of an id (2 or 4)
    documents              u64
    dictionary hash        u64, xxh3 of the dictionary's bytes
    doc_ids                i64 for each document (null ids: the smallest value)
    tokens                 u64 for each document
    frame ends             u64 for each document, from the end of this index
    frames                 each document's ids, little-endian, compressed by itself

so any document is read with two short reads: the index, then its frame.  The dictionary is trained on
bounded slices of the id arrays of a sample of documents; its hash ties files to it.

Files lie in a folder that all tasks share, or under any URI that pyarrow's file systems open.  A task writes
each under a name of its own attempt and only then returns a row with its path.  The table of these
rows, written by Spark, names the files that count; what a lost or repeated attempt left is named by none.
A one-row table beside it holds the dictionary.

Null and empty texts hold only the end id.  Null ids come first.  Rows that repeat an id stay
separate documents, in the order of their text's hash.
"""

from __future__ import annotations

import struct
import zlib
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin, stage
from rankloom.session import new_folder
from rankloom.llm.tokens import encoder

MAGIC, _HEAD = b"TOKZ1\0", struct.Struct("<6sHQQ")
NO_ID = -(1 << 63)
#: The dictionary's size, the documents it is trained on, and the characters and ids of one document at most there.
DICTIONARY_BYTES, SAMPLE, SAMPLE_IDS = 1 << 16, 1000, 4096
#: A file is closed after so many bytes of frames.
FILE_BYTES = 1 << 22
#: Bytes of text that one writing task takes, and files that one reading task does.
PART_BYTES, PART_FILES = 1 << 24, 2
LEVEL = 3


def dictionary_hash(dictionary: bytes) -> int:
    return xxhash.xxh3_64_intdigest(dictionary)


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; empty if they are too few for one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def file_bytes(names: list[int | None], sizes: list[int], frames: list[bytes], dictionary: int, width: int = 2) -> bytes:
    ends = np.cumsum([len(f) for f in frames], dtype="<u8")
    return b"".join([_HEAD.pack(MAGIC, width, len(names), dictionary), np.array([NO_ID if n is None else n for n in names], "<i8").tobytes(),
                     np.array(sizes, "<u8").tobytes(), ends.tobytes(), *frames])


def opened(path: str):
    """The file system and the path in it; Spark writes local ones as ``file:/…``."""
    if path.startswith("file:") or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), unquote(urlparse(path).path) if path.startswith("file:") else path
    return pyarrow.fs.FileSystem.from_uri(path)


def stored(folder: str, name: str, content: bytes) -> str:
    """Writes a whole file and returns its path."""
    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{name}") as out:
        out.write(content)
    return f"{folder}/{name}"


class TokenFile:
    """Reads an open file (with ``seek`` and ``read``): its index at once, ids by one read of their frame."""

    def __init__(self, source, dictionary: bytes):
        self.source = source
        magic, self.width, n, tied = _HEAD.unpack(source.read(_HEAD.size))
        if magic != MAGIC or tied != dictionary_hash(dictionary):
            raise ValueError("not a token file, or written with another dictionary")
        index = source.read(24 * n)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.sizes = np.frombuffer(index, "<u8", n, 8 * n)
        self.ends = np.frombuffer(index, "<u8", n, 16 * n)
        self.base = _HEAD.size + 24 * n
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        self.source.seek(self.base + a)
        return np.frombuffer(self.reader.decompress(self.source.read(b - a)), f"<u{self.width}")

    def of(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that id."""
        name = NO_ID if doc_id is None else doc_id
        return [self.ids(i) for i in range(*np.searchsorted(self.doc_ids, [name, name + 1]))]


def train(docs: DataFrame, path: str, end_id: int) -> bytes:
    """The shared dictionary, trained in one task on at most ``SAMPLE`` documents.

    Of a text of more than ``SAMPLE_IDS`` characters, a slice at a place that follows from its hash takes part.
    """
    place = F.pmod("h", F.greatest(F.lit(1), F.length("text") - SAMPLE_IDS + 1)).cast("int") + 1
    chosen = (docs.where("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("h"), "text")
              .select("h", F.substr("text", place, F.lit(SAMPLE_IDS)).alias("text")).orderBy("h").limit(SAMPLE))
    last = np.array([end_id], "<u2").tobytes()

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        encode = encoder(path)
        return pd.DataFrame({"raw": [trained([(encode(t) + last)[:2 * SAMPLE_IDS] for t in part.sort_values("h")["text"]])]})

    rows = chosen.groupBy().applyInPandas(fit, "raw binary").collect()
    return bytes(rows[0].raw) if rows else b""


def write(docs: DataFrame, path: str, end_id: int, dictionary: bytes, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes the files of all documents, in ascending doc_id order: part, number, n_tokens, first_id, last_id and path of each.

    The number of parts follows from the bytes of text, and their bounds from ids and hashes of texts, so that rows
    of one id can lie in several.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tied = encoder(path), dictionary_hash(dictionary)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        last, part, number, attempt = np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId(), 0, uuid.uuid4().hex
        names, sizes, frames, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            at = stored(folder, f"{part:06d}-{number:06d}-{attempt}.tokz", file_bytes(names, sizes, frames, tied))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_tokens": pa.array([sum(sizes)], pa.int64()),
                "first_id": pa.array(names[:1], pa.int64()), "last_id": pa.array(names[-1:], pa.int64()), "path": pa.array([at])})

        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                raw = encode(text.as_py() or "") + last
                names.append(name)
                sizes.append(len(raw) // 2)
                frames.append(press.compress(raw))
                held += len(frames[-1])
                if held >= FILE_BYTES:
                    yield closed()
                    names, sizes, frames, held, number = [], [], [], 0, number + 1
        if names:
            yield closed()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    parts = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes + 1
    ordered = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return ordered.mapInArrow(scan, "part int, number int, n_tokens bigint, first_id bigint, last_id bigint, path string")


def index(files: DataFrame) -> DataFrame:
    """``files`` with ``first``: the tokens of all files before.  One task sees one row for each part."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.expr("coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))
    inner = F.expr("coalesce(sum(n_tokens) OVER (PARTITION BY part ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return (files.withColumn("inner", inner).join(parts, "part")
            .withColumn("first", F.col("before") + F.col("inner")).drop("inner", "before"))


def read(files: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, path in zip(batch["first"].to_pylist(), batch["path"].to_pylist()):
                system, at = opened(path)
                with system.open_input_stream(at) as whole:
                    held = TokenFile(pa.BufferReader(whole.read()), dictionary)
                sizes = held.sizes.astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([None if d == NO_ID else d for d in held.doc_ids.tolist()], pa.int64()),
                    "start": pa.array(first + np.cumsum(sizes) - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(held.ids(i).astype("<u4")) for i in range(len(sizes))], pa.int64())})

    tasks = files.count() // PART_FILES + 1
    spread = index(files).select("part", "number", "first", "path").repartition(tasks, "part", "number")
    return spread.select("first", "path").mapInArrow(scan, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def document(files: DataFrame, dictionary: bytes, doc_id: int | None) -> list[np.ndarray]:
    """The ids of the documents of one doc_id: from the files that may hold it the index and their frames are read."""
    near = "first_id IS NULL" if doc_id is None else f"(first_id IS NULL OR first_id <= {int(doc_id)}) AND last_id >= {int(doc_id)}"
    out = []
    for row in files.where(near).orderBy("part", "number").select("path").collect():
        system, at = opened(row.path)
        with system.open_input_file(at) as source:
            out += TokenFile(source, dictionary).of(doc_id)
    return out


def report(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the files, and returns the digest columns of what is read back."""
    spark = begin(docs.sparkSession)
    dictionary = train(docs, path, end_id)
    stage(spark.createDataFrame([(dictionary_hash(dictionary).to_bytes(8, "little"), dictionary)], "hash binary, raw binary"))
    return read(stage(write(docs, path, end_id, dictionary, new_folder(spark, "tokens"))), dictionary)
