"""Streaming queries T1–T5: the given files as a stream, processed to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.catalog.ranks import MOVEMENT_CTE
from rankloom.catalog.registry import Tables, query
from rankloom.catalog.scalars import CACHE_KEY_SQL, cache_key_of_search
from rankloom.catalog.search_console import _STORED
from rankloom.catalog.tables import DERIVED, GIVEN
from rankloom.session import new_folder
from rankloom.streaming import jobs


def stream_of(t: Tables, derived: str, given: str) -> DataFrame:
    """A derived table over the stream of a given table's files."""
    source = (t.spark.readStream.schema(GIVEN[given]).option("pathGlobFilter", f"{given}.parquet")
              .parquet(t.sf_dir))
    return t.spark.sql(DERIVED[derived], **{given: source})


@query("t1_rank_stream", f"WITH {MOVEMENT_CTE} SELECT *, previous_rank - current_rank AS change FROM m")
def rank_stream(t: Tables):
    folder = new_folder(t.spark, "ranks")
    jobs.refresh_movements(stream_of(t, "rank_observations", "events"), folder)
    return jobs.current_movements(t.spark, folder).drop("last_checked_at")


@query("t2_search_console_stream", f"""
    WITH q AS ({_STORED.format(dim='query')})
    SELECT property_id, date, query, country, device, clicks, impressions, position FROM q""")
def search_console_stream(t: Tables):
    folder = new_folder(t.spark, "gsc")
    jobs.sync_search_console(stream_of(t, "gsc_rows", "events"), folder, jobs.GSC_QUERY_GRAIN,
                             [F.desc("batch_seq")])
    return t.spark.read.parquet(f"{folder}/table").select(
        *jobs.GSC_QUERY_GRAIN, "clicks", "impressions", "position")


@query("t3_cache_stream", f"SELECT DISTINCT {CACHE_KEY_SQL} AS cache_key FROM {{searches}}")
def cache_stream(t: Tables):
    rows = stream_of(t, "searches", "orders").select(
        cache_key_of_search().alias("cache_key"), F.col("searched_at").cast("timestamp").alias("searched_at"))
    folder = new_folder(t.spark, "cache")
    jobs.cache_searches(rows, folder)
    return t.spark.read.parquet(f"{folder}/updates").select("cache_key").distinct()


@query("t4_usage_stream", """
    SELECT CAST(created_at AS DATE) AS day, organization_id, service, CAST(sum(units) AS BIGINT) AS units, count(*) AS calls
    FROM {provider_usage} GROUP BY CAST(created_at AS DATE), organization_id, service""")
def usage_stream(t: Tables):
    rows = stream_of(t, "provider_usage", "events").withColumn("created_at", F.col("created_at").cast("timestamp"))
    folder = new_folder(t.spark, "usage")
    jobs.meter_usage(rows, folder)
    return jobs.daily_usage(t.spark, folder)


@query("t5_crawl_stream", """
    SELECT crawl_run_id, count(*) AS pages_crawled, count(*) FILTER (WHERE error IS NOT NULL OR status_code >= 400) AS pages_failed
    FROM {fetch_log} GROUP BY crawl_run_id""")
def crawl_stream(t: Tables):
    folder = new_folder(t.spark, "crawl")
    jobs.count_fetches(stream_of(t, "fetch_log", "events"), folder)
    return jobs.crawl_progress(t.spark, folder)
