"""Structured Streaming jobs over files that arrive one after the other."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rankloom.plans.rankings import movement
from rankloom.sinks.manifest import BatchTable, Manifest, RangedTable
from rankloom.streaming import jobs

DAY = dt.datetime(2024, 1, 1)


def land(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_rank_stream_refreshes_touched_keywords(spark, tmp_path):
    schema = "tracked_keyword_id int, observed_at timestamp_ntz, event_id int, rank int, ranking_url string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, [(1, DAY, 1, 9, "a"), (2, DAY, 2, 4, "b")], schema, source)
    jobs.refresh_movements(stream(spark, schema, source), out)
    land(spark, [(1, DAY + dt.timedelta(1), 3, 5, "c")], schema, source)
    jobs.refresh_movements(stream(spark, schema, source), out)
    got = {r.tracked_keyword_id: (r.current_rank, r.change) for r in jobs.current_movements(spark, out).collect()}
    assert got == {1: (5, 4), 2: (4, None)}


def test_search_console_stream_takes_late_corrections(spark, tmp_path):
    schema = "property_id int, date date, query string, country string, device string, batch_seq int, clicks int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for clicks, day in ((1, 1), (2, 2)):
        land(spark, [(1, dt.date(2024, 1, day), "q", "usa", "D", clicks, clicks)], schema, source)
        jobs.sync_search_console(stream(spark, schema, source), out, jobs.GSC_QUERY_GRAIN, [F.desc("batch_seq")])
    land(spark, [(1, dt.date(2024, 1, 1), "q", "usa", "D", 3, 30)], schema, source)
    jobs.sync_search_console(stream(spark, schema, source), out, jobs.GSC_QUERY_GRAIN, [F.desc("batch_seq")])
    got = {(str(r.date), r.clicks) for r in spark.read.parquet(f"{out}/table").collect()}
    assert got == {("2024-01-01", 30), ("2024-01-02", 2)}


def test_cache_stream_drops_repeats_within_the_ttl(spark, tmp_path):
    schema = "cache_key string, searched_at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    # The last search arrives four weeks late and opens a week of its own.
    for day in (0, 3, 30, 31, 12):
        land(spark, [("k", DAY + dt.timedelta(day)), (f"only{day}", DAY + dt.timedelta(day))], schema, source)
        jobs.cache_searches(stream(spark, schema, source), out)
    rows = spark.read.parquet(f"{out}/updates")
    assert sorted(r.searched_at.day for r in rows.where("cache_key = 'k'").collect()) == [1, 13, 31]
    assert rows.count() == 8


def test_usage_and_progress_streams_update(spark, tmp_path):
    schema = "organization_id int, service string, units int, created_at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    # The last row arrives three days late and still counts.
    for hour in (1, 2, 72, 3):
        land(spark, [(1, "serp", 5, DAY + dt.timedelta(hours=hour))], schema, source)
        jobs.meter_usage(stream(spark, schema, source), out)
    days = {str(r.day): (r.units, r.calls) for r in jobs.daily_usage(spark, out).collect()}
    assert days == {"2024-01-01": (15, 3), "2024-01-04": (5, 1)}

    schema = "crawl_run_id int, error string, status_code int"
    source, out = str(tmp_path / "in2"), str(tmp_path / "out2")
    land(spark, [(1, None, 200), (1, "timeout", 0)], schema, source)
    jobs.count_fetches(stream(spark, schema, source), out)
    land(spark, [(1, None, 404)], schema, source)
    jobs.count_fetches(stream(spark, schema, source), out)
    (row,) = jobs.crawl_progress(spark, out).collect()
    assert (row.pages_crawled, row.pages_failed) == (3, 2)


def test_rank_stream_equals_the_whole_whatever_the_split(spark, tmp_path):
    schema = "tracked_keyword_id int, observed_at timestamp_ntz, event_id int, rank int, ranking_url string"
    rows = [(i * 7 % 5, DAY + dt.timedelta(hours=(i * 37) % 41), i, None if i % 4 == 0 else i * 13 % 50, f"u{i}") for i in range(60)]
    whole = movement(spark.createDataFrame(rows, schema)).collect()
    for name, cuts in (("one", [0, 60]), ("some", [0, 1, 2, 30, 31, 60]), ("backwards", None)):
        source, out = str(tmp_path / name / "in"), str(tmp_path / name / "out")
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])] if cuts else [rows[40:], rows[20:40], rows[:20]]
        for part in parts:
            land(spark, part, schema, source)
            jobs.refresh_movements(stream(spark, schema, source), out)
        assert sorted(jobs.current_movements(spark, out).collect()) == sorted(whole)


def test_batch_tables_stay_few_and_cost_the_same(spark, tmp_path):
    folder = str(tmp_path / "table")
    table = BatchTable(spark, folder, lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), fan_in=3, levels=3)
    with pytest.raises(FileNotFoundError):
        table.read()
    written, held = [], []
    for batch in range(50):
        rows = spark.createDataFrame([(batch % 4, 1), (9, batch)], "k int, n bigint")
        table.add(rows, batch)
        table.add(rows, batch)  # a repeat after a failure
        written.append(table.folders()[-1])
        held.append(len(table.folders()))
    assert max(held) <= 9
    assert {r.k: r.n for r in table.read().collect()} == {0: 13, 1: 13, 2: 12, 3: 12, 9: sum(range(50))}
    assert len(list((tmp_path / "table" / "parts").iterdir())) <= 9 + 3 and len(list((tmp_path / "table" / "_manifest").glob("v*"))) == 2


def test_a_writer_that_dies_before_publishing_leaves_the_table_as_it_was(spark, tmp_path):
    folder = str(tmp_path / "table")
    table = BatchTable(spark, folder, lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")))
    table.add(spark.createDataFrame([(1, 5)], "k int, n bigint"), 0)
    spark.createDataFrame([(1, 70)], "k int, n bigint").write.parquet(f"{folder}/parts/batch-1")
    assert [r.n for r in table.read().collect()] == [5]
    table.add(spark.createDataFrame([(1, 7)], "k int, n bigint"), 1)
    assert [r.n for r in table.read().collect()] == [12]


def test_cache_keys_are_forgotten_after_a_while_if_asked(spark, tmp_path):
    schema = "cache_key string, searched_at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, [("k", DAY), ("k", DAY), (None, DAY)], schema, source)
    job = jobs.cache_searches_on(stream(spark, schema, source), out, dt.timedelta(milliseconds=1), "100 milliseconds")

    def accepted() -> int:
        try:
            return spark.read.parquet(f"{out}/updates").where("cache_key = 'k'").count()
        except AnalysisException:
            return 0  # nothing is written yet

    try:
        for n in (1, 2):
            end = time.time() + 60
            while accepted() < n and time.time() < end:
                time.sleep(0.5)
            assert accepted() == n
            land(spark, [("k", DAY)], schema, source)
    finally:
        job.stop()


def test_ranged_tables_rewrite_only_what_is_touched(spark, tmp_path):
    rows = [(p, i, f"v{p}-{i}") for p in range(0, 200, 2) for i in range(3)] + [(50, i, "hot") for i in range(3, 400)] + [(None, 1, "none")]
    schema = "parent bigint, seq int, value string"
    table = RangedTable(spark, str(tmp_path / "t"), "parent", ["seq"], rows_per_file=60)
    table.create(spark.createDataFrame(rows, schema))
    before = set(table.files())
    assert len(before) >= 3
    fresh = [(10, 1, "new"), (11, 1, "between"), (900, 1, "beyond")]
    table.replace(spark.createDataFrame([(10,), (12,), (7777,)], "parent bigint"), spark.createDataFrame(fresh, schema))
    want = [r for r in rows if r[0] not in (10, 12)] + fresh
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(want, key=repr)
    assert len(before & set(table.files())) >= len(before) - 2
    # Ranges still do not overlap but at their ends, and a second replacement finds all rows of a hot parent.
    table.replace(spark.createDataFrame([(50,)], "parent bigint"), spark.createDataFrame([(51, 1, "x")], schema))
    want = [r for r in want if r[0] != 50] + [(51, 1, "x")]
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(want, key=repr)
    spans = sorted((f["low"], f["high"]) for f in Manifest(spark, str(tmp_path / "t")).read()["files"] if f["low"] is not None)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    table.replace(spark.createDataFrame([], "parent bigint"), spark.createDataFrame([], schema))
    assert table.read().count() == len(want)
