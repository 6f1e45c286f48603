"""Rank tracking: movement, history, sparkline, scheduled batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import latest, numbered, top_n


def newest_first() -> list[Column]:
    return [F.desc("observed_at"), F.desc("event_id")]


KEY = "tracked_keyword_id"


def rank_summary(observations: DataFrame) -> DataFrame:
    """What a set of observations says about each keyword, in a form that merges with other sets'.

    ``newest`` and the two newest with a rank are structs in order of time; all but those two are combined before
    the shuffle, and these need two rows of a keyword.
    """
    at = F.struct("observed_at", "event_id", "rank", "ranking_url")
    whole = observations.groupBy(KEY).agg(
        F.max(at).alias("newest"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.count("*").alias("observations"))
    ranked = top_n(observations.where(F.col("rank").isNotNull()), [KEY], newest_first(), 2)
    two = ranked.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("observed_at", "event_id", "rank")), asc=False).alias("ranked"))
    return whole.join(two, KEY, "left")


def merged_summaries(summaries: DataFrame) -> DataFrame:
    """One summary per keyword; a keyword has one in each set, so these are few."""
    pairs = F.sort_array(F.flatten(F.collect_list("ranked")), asc=False)
    return summaries.groupBy(KEY).agg(
        F.max("newest").alias("newest"), F.min("best_rank").alias("best_rank"), F.max("worst_rank").alias("worst_rank"),
        F.sum("observations").alias("observations"), F.slice(pairs, 1, 2).alias("ranked"))


def movement_of(summaries: DataFrame) -> DataFrame:
    """Movement from summaries: the newest row counts as current even without a rank, previous is the first rank after it."""
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    is_newest = (first["observed_at"] == F.col("newest.observed_at")) & (first["event_id"] == F.col("newest.event_id"))
    return (summaries.withColumn("previous_rank", F.when(is_newest, second["rank"]).otherwise(first["rank"]))
            .select(KEY, F.col("newest.rank").alias("current_rank"), F.col("newest.ranking_url").alias("current_url"),
                    F.col("newest.observed_at").alias("last_checked_at"), "previous_rank", "best_rank", "worst_rank", "observations",
                    (F.col("previous_rank") - F.col("newest.rank")).alias("change")))


def movement(observations: DataFrame, newest: int | None = None) -> DataFrame:
    """Current, previous, change, best and worst of all observations, or the ``newest`` ones."""
    return movement_of(rank_summary(observations if newest is None else top_n(observations, [KEY], newest_first(), newest)))


def movement_list(tracked: DataFrame, observations: DataFrame) -> DataFrame:
    """Active tracked keywords with their movement (Q10)."""
    return (tracked.where("is_active")
            .join(movement(observations), "tracked_keyword_id", "left")
            .withColumn("observations", F.coalesce("observations", F.lit(0))))


def name_order() -> list[Column]:
    """Listing order by keyword."""
    return [F.asc("keyword"), F.asc("tracked_keyword_id")]


def current_rank(observations: DataFrame) -> DataFrame:
    """Newest observation per tracked keyword, its rank possibly null."""
    return latest(observations, ["tracked_keyword_id"], newest_first()).select(
        "tracked_keyword_id", F.col("rank").alias("your_rank"))


def history(observations: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Observations of the last days."""
    start = as_of.cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(days)}' DAY")
    return observations.where(F.col("observed_at") >= start)


def sparkline(observations: DataFrame) -> DataFrame:
    """Polyline points of the ranked observations per keyword, oldest first."""
    ranked = observations.where(F.col("rank").isNotNull())
    bounds = ranked.groupBy("tracked_keyword_id").agg(
        F.count("*").alias("_n"), F.min("rank").alias("_low"), F.max("rank").alias("_high"))
    points = numbered(ranked, ["tracked_keyword_id"], [F.asc("observed_at"), F.asc("event_id")], "point")
    span = F.greatest(F.lit(1), F.col("_high") - F.col("_low"))
    return (points.join(bounds, "tracked_keyword_id")
            .withColumn("x", (F.col("point") - 1) / F.greatest(F.lit(1), F.col("_n") - 1) * 100)
            .withColumn("y", 30 - (F.col("rank") - F.col("_low")) / span * 26)
            .select("tracked_keyword_id", "event_id", "point", "x", "y"))


def share_of_max(rows: DataFrame, key: str, value: str, out: str = "share") -> DataFrame:
    """Value over the largest of its series, divisor at least 1.

    The maximum is aggregated (combined before the shuffle) and joined back, so a series is
    never gathered in one window partition.
    """
    peaks = rows.groupBy(key).agg(F.greatest(F.lit(1), F.max(value)).alias("_peak"))
    return rows.join(peaks, key).withColumn(out, F.col(value) / F.col("_peak")).drop("_peak")


# Provider kinds.
PROVIDER_KINDS = {"dataforseo": ["serp", "keyword"], "google_ads": ["keyword"]}


def scheduled_batch(tracked: DataFrame, accounts: DataFrame) -> DataFrame:
    """Active tracked keywords, queued when their organisation can search, else skipped (Q32)."""
    able = [name for name, kinds in PROVIDER_KINDS.items() if "serp" in kinds]
    ready = (accounts.where(F.col("status").isin("CONFIGURED", "ACTIVE")
                            & F.col("provider").isin(able))
             .select("organization_id").distinct().withColumn("_ready", F.lit(True)))
    return (tracked.where("is_active").join(ready, "organization_id", "left")
            .withColumn("state", F.when(F.col("_ready"), "queued").otherwise("skipped_no_provider"))
            .drop("_ready"))


def scheduled_counts(tracked: DataFrame, accounts: DataFrame) -> DataFrame:
    return scheduled_batch(tracked, accounts).groupBy("state").agg(F.count("*").alias("keywords"))
