"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rankloom.operators.upsert import upsert
from rankloom.plans.rankings import merged_summaries, movement_of, rank_summary
from rankloom.session import stage
from rankloom.sinks.manifest import BatchTable

GSC_QUERY_GRAIN = ["property_id", "date", "query", "country", "device"]
TTL_MICROS = 7 * 86_400 * 1_000_000


def run_batches(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                mode: str = "append") -> None:
    """Process what has arrived, batch by batch, then stop; restarts resume at the checkpoint."""
    job = (rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).foreachBatch(handle).start())
    job.awaitTermination()


def rank_table(spark: SparkSession, folder: str) -> BatchTable:
    return BatchTable(spark, folder, merged_summaries)


def refresh_movements(observations: DataFrame, folder: str) -> None:
    """Each batch adds what it says about its keywords; history is never read again.

    A summary holds a keyword's newest observation, its two newest ranks, best, worst and count.
    Summaries of any split of the observations, in any order, merge to the same one.
    """
    run_batches(observations, lambda batch, batch_id: rank_table(batch.sparkSession, folder).add(rank_summary(batch), batch_id),
                f"{folder}/checkpoint")


def current_movements(spark: SparkSession, folder: str) -> DataFrame:
    """Movement per keyword as of the last batch."""
    return movement_of(rank_table(spark, folder).read())


def sync_search_console(rows: DataFrame, folder: str, grain: list[str], newest_first: list[Column]) -> None:
    """Upsert arriving rows by grain; a late correction just replaces its row.

    The table is partitioned by date, so a batch rewrites only the days it touches.  The merged
    days are written to the side first: the table never overwrites what it is reading.
    """
    table = f"{folder}/table"

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = batch.select("date").distinct()
        columns = batch.columns
        try:
            old = spark.read.parquet(table).join(days, "date", "left_semi").select(*columns)
        except Exception as missing:
            # The first batch finds no table yet.
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            old = batch.limit(0)
        merged = stage(upsert(old, batch, grain, newest_first))
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date").parquet(table))

    run_batches(rows, merge, f"{folder}/checkpoint")


class AcceptedSearches(StatefulProcessor):
    """A key's accepted searches, in order; a search is new unless one lies at most seven days before it."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "at array<bigint>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.accepted.get()
        known, new = list(held[0]) if held else [], []
        for at in sorted({r.at for r in rows if r.at is not None}):
            before = bisect_right(known, at)
            if not before or at - known[before - 1] >= TTL_MICROS:
                known.insert(before, at)
                new.append(Row(cache_key=key[0], at=at))
        if new or self.ttl_ms is not None:
            self.accepted.update((known,))
        yield from new

    def close(self) -> None:
        pass


def _accepted(searches: DataFrame, folder: str, ttl_ms: int | None) -> DataStreamWriter:
    searches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = searches.select("cache_key", F.unix_micros(F.col("searched_at").cast("timestamp")).alias("at")).groupBy("cache_key")
    new = keyed.transformWithState(AcceptedSearches(ttl_ms), "cache_key string, at bigint", "Append", "None" if ttl_ms is None else "ProcessingTime")
    return (new.select("cache_key", F.timestamp_micros("at").alias("searched_at")).writeStream.outputMode("append").format("parquet")
            .option("path", f"{folder}/updates").option("checkpointLocation", f"{folder}/checkpoint"))


def cache_searches(searches: DataFrame, folder: str) -> None:
    """One search per cache key until seven days have passed, however late a search arrives.

    A search is new unless an accepted one lies at most seven days before it.  The accepted searches of
    a key are its state, so a batch reads those of its own keys only; they are kept for good, as a search may
    arrive months late.  A task takes the rows that one batch holds of a key together; the source bounds a batch.
    """
    _accepted(searches, folder, None).trigger(availableNow=True).start().awaitTermination()


def cache_searches_on(searches: DataFrame, folder: str, forget_after: timedelta, every: str = "10 seconds") -> StreamingQuery:
    """T3 as a job that goes on: a key without any search for ``forget_after`` (of the clock) is forgotten."""
    return _accepted(searches, folder, int(forget_after.total_seconds() * 1000)).trigger(processingTime=every).start()


USAGE_GRAIN = ["day", "organization_id", "service"]


def _summed(grain: list[str], sums: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*grain).agg(*[F.sum(c).alias(c) for c in sums])


def usage_table(spark: SparkSession, folder: str) -> BatchTable:
    return BatchTable(spark, folder, _summed(USAGE_GRAIN, ["units", "calls"]))


def meter_usage(usage: DataFrame, folder: str) -> None:
    """T4: each batch's units per organisation, service and day, late events included."""
    def sums(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.col("created_at").cast("date").alias("day"), "organization_id", "service").agg(
            F.sum("units").alias("units"), F.count("*").alias("calls"))

    run_batches(usage, lambda batch, batch_id: usage_table(batch.sparkSession, folder).add(sums(batch), batch_id), f"{folder}/checkpoint")


def daily_usage(spark: SparkSession, folder: str) -> DataFrame:
    """The metered days; a month is summed from its days."""
    return usage_table(spark, folder).read()


def crawl_table(spark: SparkSession, folder: str) -> BatchTable:
    return BatchTable(spark, folder, _summed(["crawl_run_id"], ["pages_crawled", "pages_failed"]))


def count_fetches(fetches: DataFrame, folder: str) -> None:
    """T5: each batch's counters per crawl run."""
    failed = F.col("error").isNotNull() | (F.coalesce("status_code", F.lit(0)) >= 400)

    def sums(batch: DataFrame) -> DataFrame:
        return batch.groupBy("crawl_run_id").agg(F.count("*").alias("pages_crawled"), F.count(F.when(failed, 1)).alias("pages_failed"))

    run_batches(fetches, lambda batch, batch_id: crawl_table(batch.sparkSession, folder).add(sums(batch), batch_id), f"{folder}/checkpoint")


def crawl_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Running counters per crawl run."""
    return crawl_table(spark, folder).read()
