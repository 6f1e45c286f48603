"""Search-console analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numbers import ratio, rounded
from rankloom.functions.scores import since
from rankloom.functions.text import contains_ci

QUERY_GRAIN = ["property_id", "date", "query", "country", "device"]
PAGE_GRAIN = ["property_id", "date", "page", "country", "device"]


def in_window(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days; the date filter reaches the scan."""
    return rows.where(F.col("date") >= since(as_of, days))


def _measures() -> list[Column]:
    clicks, impressions = F.sum("clicks"), F.sum("impressions")
    weighted = F.sum(F.col("position") * F.col("impressions")) / F.nullif(impressions, F.lit(0))
    return [
        F.coalesce(clicks, F.lit(0)).alias("clicks"),
        F.coalesce(impressions, F.lit(0)).alias("impressions"),
        ratio(clicks, impressions).alias("ctr"),
        # Unweighted mean over rows; the impression-weighted one stands beside it.
        rounded(F.coalesce(F.avg("position"), F.lit(0.0)), 1).alias("position"),
        rounded(F.coalesce(weighted, F.lit(0.0)), 1).alias("weighted_position"),
    ]


def totals(rows: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """Clicks, impressions, ctr and mean position per property."""
    return (in_window(rows, as_of, days).groupBy("property_id").agg(*_measures())
            .withColumnRenamed("position", "avg_position"))


def overview(queries: DataFrame, pages: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """Totals of the query and the page table side by side (Q16)."""
    return (totals(queries, as_of, days).withColumn("section", F.lit("queries"))
            .unionByName(totals(pages, as_of, days).withColumn("section", F.lit("pages"))))


def daily(rows: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """Clicks and impressions per property and day (A10)."""
    return (in_window(rows, as_of, days).groupBy("property_id", "date")
            .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")))


def by_dimension(rows: DataFrame, dimension: str, as_of: Column, days: int = 28,
                 search: str | None = None) -> DataFrame:
    """Measures per query or page, optionally searched."""
    kept = in_window(rows, as_of, days)
    if search:
        kept = kept.where(contains_ci(F.col(dimension), search))
    return kept.groupBy("property_id", dimension).agg(*_measures())


def listing_order(sort: str, dimension: str) -> list[Column]:
    """Order of a query or page listing; ties break on the dimension."""
    keys = {"clicks": F.desc("clicks"), "impressions": F.desc("impressions"),
            "ctr": F.desc("ctr"), "position": F.asc("position"), dimension: F.asc(dimension)}
    return [keys[sort], F.asc("property_id"), F.asc(dimension)]


def striking_distance(rows: DataFrame) -> DataFrame:
    """Queries at mean position 4–15 with at least 500 impressions."""
    return (rows.groupBy("property_id", "query")
            .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                 F.avg("position").alias("position"))
            .where(F.col("position").between(4, 15) & (F.col("impressions") >= 500)))


def click_change(rows: DataFrame, as_of: Column) -> DataFrame:
    """Clicks of the last 28 days against the 28 days before, in one pass."""
    recent, older = F.date_sub(as_of, 28), F.date_sub(as_of, 56)
    is_recent = F.col("date") >= recent
    return (rows.where(F.col("date") >= older).groupBy("property_id", "query")
            .agg(F.sum(F.when(is_recent, F.col("clicks"))).alias("now_clicks"),
                 F.coalesce(F.sum(F.when(~is_recent, F.col("clicks"))), F.lit(0)).alias("was_clicks"),
                 F.count(F.when(is_recent, F.lit(1))).alias("recent_rows"))
            .where(F.col("recent_rows") > 0).drop("recent_rows"))
