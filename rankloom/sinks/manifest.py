"""Tables made of folders that a small versioned list names: batch sums and replaceable ranges.

A writer adds folders under new names and then publishes the next version of the list with one
rename, so a reader sees the old table or the new one and a writer that dies leaves only folders that nothing
names.  One writer at a time; readers as many as like.  Lists hold a row per folder, not per record.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import stage


class Manifest:
    """The newest version of a JSON value in ``folder/_manifest``."""

    def __init__(self, spark: SparkSession, folder: str):
        self._hadoop = spark._jvm.org.apache.hadoop
        self._folder = self._hadoop.fs.Path(f"{folder}/_manifest")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        if not self._fs.exists(self._folder):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._folder) if f.getPath().getName().startswith("v"))

    def read(self) -> dict | None:
        names = self._versions()
        if not names:
            return None
        with_text = self._fs.open(self._hadoop.fs.Path(self._folder, names[-1]))
        try:
            return json.loads(bytes(with_text.readAllBytes()).decode())
        finally:
            with_text.close()

    def commit(self, value: dict, keep: int = 2) -> None:
        """Publish the next version; the last ``keep`` stay for readers that are under way."""
        names = self._versions()
        name = f"v{int(names[-1][1:]) + 1 if names else 1:012d}"
        target, draft = self._hadoop.fs.Path(self._folder, name), self._hadoop.fs.Path(self._folder, f".{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"another writer has published {target}")
        for old in names[: len(names) + 1 - keep]:
            self._fs.delete(self._hadoop.fs.Path(self._folder, old), False)

    def remove(self, folder: str) -> None:
        self._fs.delete(self._hadoop.fs.Path(folder), True)


class BatchTable:
    """Rows that batches add and ``merge`` combines, in few folders however many batches there were.

    A batch writes its own rows only.  Once ``fan_in`` folders of a level have come together, they become one
    of the next level; the last level takes in its own.  So there are at most ``fan_in * levels``
    folders, and a row is rewritten once a level until it reaches the last.  A batch that is repeated
    after a failure finds its number in the list and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame], fan_in: int = 8, levels: int = 4):
        self.spark, self.folder, self.merge, self.fan_in, self.levels = spark, folder, merge, fan_in, levels
        self.manifest = Manifest(spark, folder)

    def _state(self) -> dict:
        return self.manifest.read() or {"last": -1, "parts": [], "old": [], "schema": None}

    def folders(self) -> list[str]:
        return [p["path"] for p in self._state()["parts"]]

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """``rows`` have to be combined already, one per key."""
        state = self._state()
        if batch_id <= state["last"]:
            return
        schema = rows.schema
        path = f"{self.folder}/parts/batch-{batch_id}"
        rows.write.mode("overwrite").parquet(path)
        parts, gone = [*state["parts"], {"level": 0, "path": path}], []
        for level in range(self.levels):
            own = [p for p in parts if p["level"] == level]
            if len(own) < self.fan_in:
                break
            path = f"{self.folder}/parts/level-{level}-upto-{batch_id}"
            merged = self.merge(self.spark.read.schema(schema).parquet(*[p["path"] for p in own]))
            merged.write.mode("overwrite").parquet(path)
            parts = [p for p in parts if p["level"] != level] + [{"level": min(level + 1, self.levels - 1), "path": path}]
            gone += [p["path"] for p in own]
        # Readers of the version before may still read what was merged just now; it goes next time.
        self.manifest.commit({"last": batch_id, "parts": parts, "old": gone, "schema": schema.json()})
        for path in state["old"]:
            self.manifest.remove(path)

    def read(self) -> DataFrame:
        """One row per key."""
        from pyspark.sql.types import StructType

        state = self._state()
        if not state["parts"]:
            raise FileNotFoundError(f"no batch has been added to {self.folder}")
        schema = StructType.fromJson(json.loads(state["schema"]))
        return self.merge(self.spark.read.schema(schema).parquet(*[p["path"] for p in state["parts"]]))


class RangedTable:
    """Child rows in files by ranges of their parent, of which a replacement rewrites only those it touches (K4, K6).

    Rows are range-partitioned by ``parent`` and ``order``, so a parent with very many rows spans several files.
    The list holds each file with its smallest and largest parent.  ``parent`` is a whole number; rows without
    one are kept in files of their own, which no replacement touches.
    """

    def __init__(self, spark: SparkSession, folder: str, parent: str, order: list[str], rows_per_file: int = 1_000_000):
        self.spark, self.folder, self.parent, self.order, self.rows_per_file = spark, folder, parent, order, rows_per_file
        self.manifest = Manifest(spark, folder)

    def _state(self) -> dict:
        return self.manifest.read() or {"version": 0, "files": [], "old": [], "schema": None}

    def files(self) -> list[str]:
        return [f["path"] for f in self._state()["files"]]

    def _write(self, rows: DataFrame, version: int, slot: Column | None = None) -> list[dict]:
        """The rows as new files and their list entries; rows of different slots share no file."""
        path = f"{self.folder}/data/v{version}"
        placed = rows.withColumn("_slot", F.coalesce(slot if slot is not None else F.lit(0), F.lit(-1)).cast("int"))
        (placed.repartitionByRange("_slot", self.parent, *self.order).sortWithinPartitions("_slot", self.parent, *self.order)
         .write.mode("overwrite").option("maxRecordsPerFile", self.rows_per_file).partitionBy("_slot").parquet(path))
        written = self.spark.read.schema(placed.schema).parquet(path)
        return [{"path": r.path, "low": r.low, "high": r.high} for r in written.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.min(self.parent).alias("low"), F.max(self.parent).alias("high")).collect()]

    def create(self, rows: DataFrame) -> None:
        state = self._state()
        version = state["version"] + 1
        self.manifest.commit({"version": version, "files": self._write(rows, version), "old": [f["path"] for f in state["files"]], "schema": rows.schema.json()})

    def replace(self, parents: DataFrame, fresh: DataFrame) -> None:
        """Drop the rows of ``parents`` (one column of that name) and add ``fresh``; other files keep their names."""
        state = self._state()
        spans = sorted((f["low"], f["high"], f["path"]) for f in state["files"] if f["low"] is not None)
        wanted = parents.select(self.parent).unionByName(fresh.select(self.parent)).where(F.col(self.parent).isNotNull()).distinct()
        lows, highs = pd.Index([s[0] for s in spans], dtype="int64"), pd.Index([s[1] for s in spans], dtype="int64")

        @F.pandas_udf("first int, last int")
        def touched(p: pd.Series) -> pd.DataFrame:
            """Files from ``first`` up to ``last``; none where first > last."""
            return pd.DataFrame({"first": highs.searchsorted(p, "left").astype("int32"), "last": lows.searchsorted(p, "right").astype("int32") - 1})

        hit = wanted.select(touched(F.col(self.parent).cast("long")).alias("t")).select("t.*").distinct().collect()  # at most twice the files
        numbers = sorted({i for r in hit for i in range(r["first"], r["last"] + 1)})
        touched_paths = {spans[i][2] for i in numbers}
        old = self.read(sorted(touched_paths)) if touched_paths else fresh.limit(0)
        kept = old.join(parents.select(self.parent).distinct(), self.parent, "left_anti")
        rows = stage(kept.unionByName(fresh.select(*kept.columns)))
        # New files stay within the gaps between those that are left, so that ranges never come to overlap.
        left = pd.Index([s[0] for i, s in enumerate(spans) if i not in set(numbers)], dtype="int64")

        @F.pandas_udf("int")
        def gap(p: pd.Series) -> pd.Series:
            return pd.Series(left.searchsorted(p, "right"), dtype="int32")

        version = state["version"] + 1
        files = [f for f in state["files"] if f["path"] not in touched_paths]
        slot = F.when(F.col(self.parent).isNotNull(), gap(F.col(self.parent).cast("long")))
        self.manifest.commit({"version": version, "files": files + self._write(rows, version, slot), "old": sorted(touched_paths),
                              "schema": state["schema"] or fresh.schema.json()})
        for path in state["old"]:
            self.manifest.remove(path)

    def read(self, paths: list[str] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        state = self._state()
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = self.files() if paths is None else paths
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)
