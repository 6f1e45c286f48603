"""Keyword gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.plans import keywords as KP
from rankloom.plans.rankings import current_rank
from rankloom.plans.serp import find_ranks, latest_searches
from rankloom.session import stage


def used_searches(tracked: DataFrame, searches: DataFrame) -> DataFrame:
    """The latest search of each active tracked keyword, with its project."""
    market = ["project_id", "normalized_keyword", "country", "device"]
    newest = latest_searches(searches).select("serp_search_id", *market)
    wanted = tracked.where("is_active").select("tracked_keyword_id", *market)
    return wanted.join(newest, market).select("tracked_keyword_id", "serp_search_id", "project_id")


def items_of(used: DataFrame, items: DataFrame) -> DataFrame:
    """All result rows of the used searches: others need no numbering, as positions count within a search."""
    return items.join(stage(used.select("serp_search_id").distinct()), "serp_search_id", "left_semi")


def competitor_ranks(tracked: DataFrame, searches: DataFrame, results: DataFrame,
                     competitors: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Rank of each active competitor in the latest search of each active tracked keyword.

    Long form — one row per (tracked keyword, competitor) that ranks — so nothing is gathered
    per keyword.  ``used`` are the ``used_searches``, where the caller has them.
    """
    # Only searches that some tracked keyword uses reach the rank lookup.
    used = used if used is not None else used_searches(tracked, searches)
    active = competitors.where("is_active")
    ranks = find_ranks(results, used.select("serp_search_id", "project_id").distinct(), active,
                       "competitor_id")
    return (used.select("tracked_keyword_id", "serp_search_id").join(ranks, "serp_search_id")
            .select("tracked_keyword_id", "project_id", "competitor_id", "rank"))


def bucket_of(your_rank: Column, best: Column) -> Column:
    """missing: only rivals rank; weak: a rival is ahead; strong: none is; shared: nobody ranks."""
    return (F.when(your_rank.isNull() & best.isNotNull(), "missing")
            .when(your_rank.isNotNull() & best.isNotNull() & (your_rank > best), "weak")
            .when(your_rank.isNotNull(), "strong").otherwise("shared"))


def keyword_gap(tracked: DataFrame, observations: DataFrame, searches: DataFrame,
                results: DataFrame, competitors: DataFrame, keywords: DataFrame,
                metrics: DataFrame, intents: DataFrame,
                ranks: DataFrame | None = None) -> DataFrame:
    """One row per active tracked keyword of every project, unfiltered (Q12)."""
    ranks = ranks if ranks is not None else competitor_ranks(tracked, searches, results, competitors)
    best = ranks.groupBy("tracked_keyword_id").agg(
        F.min("rank").alias("best_competitor_rank"), F.count("*").alias("ranking_competitors"))
    facts = KP.keyword_facts(keywords, metrics, intents).select(
        F.col("keyword_id").alias("matched_keyword_id"), "search_volume", "competition", "intent")
    rows = (KP.match_tracked(tracked.where("is_active"), keywords)
            .join(current_rank(observations), "tracked_keyword_id", "left")
            .join(best, "tracked_keyword_id", "left"))
    rows = KP.left_join_known(rows, facts, "matched_keyword_id")
    scored = KP.with_scores(rows, rank=F.col("your_rank"))
    known = F.col("matched_keyword_id").isNotNull()
    # Without a stored keyword nothing is known: no difficulty, and the score falls back to a
    # volume of zero.
    return scored.select(
        "project_id", "tracked_keyword_id", "keyword", "your_rank", "best_competitor_rank",
        F.coalesce("ranking_competitors", F.lit(0)).alias("ranking_competitors"),
        bucket_of(F.col("your_rank"), F.col("best_competitor_rank")).alias("bucket"),
        "search_volume", F.when(known, F.col("difficulty")).alias("difficulty"), "intent",
        F.when(known, F.col("opportunity")).otherwise(0.0).alias("opportunity"))


def filter_gap(gap: DataFrame, bucket: str | None = None, intent: str | None = None,
               min_volume: int | None = None, max_difficulty: float | None = None) -> DataFrame:
    """The four gap filters; unknown difficulty counts as 101 here."""
    rows = gap
    if bucket:
        rows = rows.where(F.col("bucket") == bucket)
    if intent:
        rows = rows.where(F.col("intent") == intent.upper())
    if min_volume is not None:
        rows = rows.where(F.coalesce("search_volume", F.lit(0)) >= min_volume)
    if max_difficulty is not None:
        rows = rows.where(F.coalesce("difficulty", F.lit(101.0)) <= max_difficulty)
    return rows


def gap_order() -> list[Column]:
    """Opportunity first, then keyword (L2)."""
    return [F.coalesce("opportunity", F.lit(0.0)).desc(), F.asc("keyword"),
            F.asc("tracked_keyword_id")]


def gap_with_ranks(gap: DataFrame, ranks: DataFrame, competitors: DataFrame) -> DataFrame:
    """Gap rows with one row per ranking competitor, of any number (K11 in long form)."""
    named = ranks.select("tracked_keyword_id", "competitor_id", F.col("rank").alias("competitor_rank")).join(
        competitors.select("competitor_id", F.col("domain").alias("competitor")), "competitor_id", "left")
    return gap.join(named, "tracked_keyword_id", "left")


def gap_matrix(gap: DataFrame, ranks: DataFrame, competitors: DataFrame, column: str,
               values: list[str]) -> DataFrame:
    """Gap rows with one rank column per competitor named in ``values``.

    ``column`` is the competitor attribute that heads the columns.
    """
    labelled = ranks.join(competitors.select("competitor_id", column), "competitor_id")
    wide = labelled.groupBy("tracked_keyword_id").pivot(column, values).agg(F.min("rank"))
    named = wide.select("tracked_keyword_id", *[F.col(f"`{v}`").alias(f"comp_{v}") for v in values])
    return gap.join(named, "tracked_keyword_id", "left")
