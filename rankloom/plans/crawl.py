"""Crawl tables and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions.numbers import rounded
from rankloom.operators.ranking import latest
from rankloom.sources.html import page_signals

MAX_RUNTIME_SECONDS = 180


def crawl_pages(fetched: DataFrame) -> DataFrame:
    """Fetched pages with the signals of their markup and an indexability label.

    Only 200 responses with an html body are parsed; the rest keep empty signals.
    """
    parse = F.coalesce((F.col("status_code") == 200) & T.is_html_response(F.col("content_type"))
                       & ~F.coalesce("is_robots_blocked", F.lit(False)), F.lit(False))
    body = fetched.withColumn("html", F.when(parse, F.col("html"))).withColumn("_parsed", parse)
    signals = page_signals(body)
    label = T.indexability(
        F.col("status_code"), F.col("error"), F.coalesce("redirect_target", F.lit("")) != "",
        F.col("is_noindex"), F.col("is_robots_blocked"), F.col("_parsed"))
    # An unparsed page has no content to compare with others.
    return (signals.withColumn("content_hash", F.when(F.col("_parsed"), F.col("content_hash")))
            .withColumn("indexability", label).drop("html", "links", "_parsed"))


def coverage(fetches: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """Crawled, failed, blocked pages, speed and the partial flag per run."""
    failed = F.col("error").isNotNull() | (F.coalesce("status_code", F.lit(0)) >= 400)
    seconds = F.greatest(F.lit(0.1), (F.max("fetched_us") - F.min("fetched_us")) / 1_000_000.0)
    out = fetches.groupBy("crawl_run_id").agg(
        F.count("*").alias("pages_crawled"),
        F.count(F.when(failed, F.lit(1))).alias("pages_failed"),
        F.count(F.when(F.coalesce("is_robots_blocked", F.lit(False)), F.lit(1))).alias("pages_blocked"),
        seconds.alias("elapsed"))
    if discovered is not None:
        out = out.join(discovered.select("crawl_run_id", "pages_discovered"), "crawl_run_id", "left")
    else:
        out = out.withColumn("pages_discovered", F.col("pages_crawled"))
    speed = F.col("pages_crawled") / F.col("elapsed")
    left = F.greatest(F.lit(0), F.col("pages_discovered") - F.col("pages_crawled"))
    done = F.col("pages_crawled") / F.greatest(F.lit(1), F.col("pages_discovered")) * 100
    return out.select(
        "crawl_run_id", "pages_discovered", "pages_crawled", "pages_failed", "pages_blocked",
        rounded(speed, 1).alias("speed"),
        rounded(left / F.greatest(F.lit(0.1), speed), 1).alias("eta_seconds"),
        rounded(F.least(F.lit(100.0), done), 0).cast("int").alias("percent_done"),
        (F.col("elapsed") > MAX_RUNTIME_SECONDS).alias("is_partial"))


def latest_run(runs: DataFrame, completed_only: bool = False) -> DataFrame:
    """Newest run per project, of any status or completed ones only."""
    rows = runs.where(F.col("status") == "COMPLETED") if completed_only else runs
    return latest(rows, ["project_id"], [F.desc("created_at"), F.desc("crawl_run_id")])


def newest_runs_order() -> list[Column]:
    """Newest first."""
    return [F.desc("created_at"), F.desc("crawl_run_id")]
