"""Keyword storage and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import keywords as K
from rankloom.functions.text import contains_ci, strip
from rankloom.operators.ranking import latest, top_n
from rankloom.operators.upsert import insert_if_absent

NATURAL_KEY = ["organization_id", "normalized_keyword", "country", "language"]


def clean_batch(batch: DataFrame) -> DataFrame:
    """Normalised, non-blank batch rows — the input of the three K3 steps below."""
    folded = (batch.withColumn("country", F.upper("country"))
              .withColumn("language", F.lower("language")))
    return (K.with_normalized_keyword(folded).where(F.col("normalized_keyword") != ""))


def stored_keywords(items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Keyword rows after a batch: first spelling of a new natural key wins (K3)."""
    rows = items.select(
        F.col("seq").alias("keyword_id"), *NATURAL_KEY, "project_id",
        strip(F.col("keyword")).alias("keyword"), "created_on")
    if existing is None:
        return latest(rows, NATURAL_KEY, [F.asc("keyword_id")])
    return insert_if_absent(existing, rows, NATURAL_KEY, [F.asc("keyword_id")])


def _trend_of(items: DataFrame) -> Column:
    """The monthly volumes of a batch item, null where the vendor names none."""
    return F.col("trend") if "trend" in items.columns else F.lit(None).cast("array<bigint>")


def trend_shares(metrics: DataFrame, key: str = "keyword_id") -> DataFrame:
    """Each month of a trend as a share of its largest one, divisor at least 1.

    A trend is an array of its row, so the largest month needs no join, and nothing is broadcast.
    """
    rows = metrics.select(key, F.greatest(F.lit(1), F.array_max("trend")).alias("_peak"), F.posexplode("trend").alias("month", "volume"))
    return rows.withColumn("share", F.col("volume") / F.col("_peak")).drop("_peak")


def metric_snapshots(items: DataFrame, keywords: DataFrame) -> DataFrame:
    """One metric row per batch item, attached to its stored keyword (K3)."""
    ids = keywords.select("keyword_id", *NATURAL_KEY)
    return items.join(ids, NATURAL_KEY).select(
        "keyword_id", "seq", F.col("created_on"), "search_volume", "cpc", "competition",
        _trend_of(items).alias("trend"), "provider", K.intent_of(F.col("keyword"))["intent"].alias("intent"))


def keyword_intents(items: DataFrame, keywords: DataFrame) -> DataFrame:
    """Heuristic intent of each keyword, set once by its first item (K3)."""
    ids = keywords.select("keyword_id", *NATURAL_KEY)
    first = latest(items.join(ids, NATURAL_KEY), ["keyword_id"], [F.asc("seq")])
    guess = K.intent_of(F.col("keyword"))
    return first.select("keyword_id", guess["intent"].alias("intent"),
                        guess["confidence"].alias("confidence"), F.lit("heuristic").alias("method"))


def latest_metric(metrics: DataFrame) -> DataFrame:
    """Newest snapshot per keyword."""
    return latest(metrics, ["keyword_id"], [F.desc("created_on"), F.desc("seq")])


def best_intent(intents: DataFrame) -> DataFrame:
    """Most confident intent per keyword."""
    return latest(intents, ["keyword_id"], [F.desc("confidence"), F.asc("method"), F.asc("intent")])


def saturation_by_search(results: DataFrame) -> DataFrame:
    """Share of strong hosts among the first ten results of each search."""
    strong = F.when(K.is_strong_host(F.col("domain")), 1).otherwise(0)
    return (results.where((F.col("result_type") == "organic") & (F.col("position") <= 10))
            .groupBy("serp_search_id")
            .agg((F.sum(strong) / F.count("*")).alias("saturation")))


def with_scores(rows: DataFrame, rank: Column | None = None,
                saturation: Column | None = None) -> DataFrame:
    """Difficulty, its note and opportunity from volume, competition, intent."""
    difficulty = K.keyword_difficulty(F.col("competition"), F.col("search_volume"), saturation)
    return (rows.withColumn("difficulty", difficulty)
            .withColumn("difficulty_note", K.difficulty_note(
                F.col("competition"), F.col("search_volume"), saturation))
            .withColumn("opportunity", K.opportunity_score(
                F.col("search_volume"), F.col("difficulty"), F.col("intent"), rank)))


def keyword_facts(keywords: DataFrame, metrics: DataFrame, intents: DataFrame) -> DataFrame:
    """Keywords with latest metric and intent, before scoring (J6 + J7)."""
    m = latest_metric(metrics).select(
        "keyword_id", "search_volume", "cpc", "competition", "provider",
        F.col("intent").alias("metric_intent"), F.col("created_on").alias("updated_on"))
    i = best_intent(intents).select("keyword_id", F.col("intent").alias("best_intent"),
                                    F.col("confidence").alias("intent_confidence"))
    return (keywords.join(m, "keyword_id", "left").join(i, "keyword_id", "left")
            .withColumn("intent", F.coalesce("best_intent", "metric_intent"))
            .drop("best_intent", "metric_intent"))


def scored_keywords(keywords: DataFrame, metrics: DataFrame, intents: DataFrame,
                    saturation: DataFrame | None = None) -> DataFrame:
    """Every stored keyword with its scores (Q6).

    Result saturation counts as 0.5 unless ``saturation`` (keyword_id, saturation) brings the
    measured one.
    """
    facts = keyword_facts(keywords, metrics, intents)
    if saturation is None:
        return with_scores(facts)
    return with_scores(facts.join(saturation, "keyword_id", "left"), saturation=F.col("saturation"))


def keyword_list(scored: DataFrame, search: str | None = None, intent: str | None = None,
                 min_volume: int | None = None, max_difficulty: float | None = None) -> DataFrame:
    """Filtered keyword listing (Q7); keep a project's and the shared rows with a plain filter."""
    rows = scored
    if search:
        rows = rows.where(contains_ci(F.col("normalized_keyword"), search.strip().lower()))
    if intent:
        rows = rows.where(F.col("intent") == intent.upper())
    if min_volume is not None:
        rows = rows.where(F.coalesce("search_volume", F.lit(0)) >= min_volume)
    if max_difficulty is not None:
        rows = rows.where(F.coalesce("difficulty", F.lit(0.0)) <= max_difficulty)
    return rows


def list_order(sort: str = "opportunity") -> list[Column]:
    """Order of a keyword listing (L3)."""
    first = {"opportunity": F.coalesce("opportunity", F.lit(0.0)).desc(),
             "volume": F.coalesce("search_volume", F.lit(0)).desc(),
             "difficulty": F.coalesce("difficulty", F.lit(101.0)).asc(),
             "keyword": F.asc("keyword"), "updated": F.asc_nulls_first("updated_on")}[sort]
    return [first, F.asc("keyword"), F.asc("keyword_id")]


def metric_history(metrics: DataFrame, newest: int = 30) -> DataFrame:
    """Newest snapshots per keyword."""
    return top_n(metrics, ["keyword_id"], [F.desc("created_on"), F.desc("seq")], newest, "nth_newest")


def left_join_known(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """A left join in which rows without a key, which may be most, bypass the shuffle."""
    columns = [c for c in others.columns if c != key]
    unknown = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(others.schema[c].dataType).alias(c) for c in columns])
    known = rows.where(F.col(key).isNotNull()).join(others, key, "left")
    return known.select(*unknown.columns).unionByName(unknown)


def match_tracked(tracked: DataFrame, keywords: DataFrame) -> DataFrame:
    """Stored keyword of each tracked keyword: by id, else by natural key."""
    by_id = keywords.select("keyword_id", F.col("keyword_id").alias("_id"))
    by_key = keywords.select(F.col("keyword_id").alias("_key_id"), *NATURAL_KEY)
    return (left_join_known(tracked, by_id, "keyword_id")
            .join(by_key, NATURAL_KEY, "left")
            .withColumn("matched_keyword_id", F.coalesce("_id", "_key_id"))
            .drop("_id", "_key_id"))


def untracked(keywords: DataFrame, tracked: DataFrame) -> DataFrame:
    """Keywords a project does not track in any market."""
    return keywords.join(tracked.select("project_id", "normalized_keyword"),
                         ["project_id", "normalized_keyword"], "left_anti")
