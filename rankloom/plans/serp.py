"""Search-result snapshots: rank lookup, cache, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import urls as U
from rankloom.functions.keywords import with_normalized_keyword
from rankloom.functions.numbers import rounded
from rankloom.operators.ranking import latest, top_n
from rankloom.session import stage
from rankloom.sinks.manifest import RangedTable

CACHE_DAYS = 7


def _results_with_project(results: DataFrame, searches: DataFrame) -> DataFrame:
    hits = results.where((F.col("result_type") == "organic") & (F.col("domain") != "")).select(
        "serp_search_id", "position", "url", U.fold_www(F.col("domain")).alias("host"))
    return hits.join(searches.select("serp_search_id", "project_id"), "serp_search_id")


def find_ranks(results: DataFrame, searches: DataFrame, targets: DataFrame,
               target_id: str) -> DataFrame:
    """Best organic rank and URL of each target domain in each search of its project.

    A result belongs to a target when the www-folded hosts are equal or one is a subdomain of
    the other.  That suffix test becomes one equi-join without false partners: a result offers
    every suffix of its host to the targets themselves, and its whole host to the parent domains
    of the targets.  Each pair can meet just once.
    """
    def key(probe: Column, kind: str) -> Column:
        return F.struct(probe.alias("probe"), F.lit(kind).alias("kind"))

    hits = _results_with_project(results, searches)
    offered = F.concat(F.transform(U.host_suffixes(F.col("host")), lambda s: key(s, "target")),
                       F.array(key(F.col("host"), "parent")))
    probes = hits.select("serp_search_id", "project_id", "position", "url",
                         F.explode(offered).alias("k")).select("*", "k.*").drop("k")
    suffixes = U.host_suffixes(F.col("domain"))
    wanted = F.transform(suffixes, lambda s, i: key(s, "parent").withField(
        "kind", F.when(i == 0, "target").otherwise("parent")))
    offers = (targets.where(F.col("domain") != "")
              .select("project_id", target_id, F.explode(wanted).alias("k"))
              .select("project_id", target_id, "k.*"))
    # Small target lists are broadcast by their measured size; larger ones are shuffled, and
    # adaptive execution splits a host that holds a large share of the results.
    met = probes.join(offers, ["project_id", "probe", "kind"])
    best = F.min(F.struct("position", "url"))
    return (met.groupBy("serp_search_id", "project_id", target_id).agg(best.alias("best"))
            .select("serp_search_id", "project_id", target_id,
                    F.col("best.position").alias("rank"), F.col("best.url").alias("url")))


def latest_searches(searches: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Newest search per project, normalised keyword, country and device."""
    rows = with_normalized_keyword(searches)
    if as_of is not None:
        rows = rows.where(F.col("searched_at") <= as_of)
    return latest(rows, ["project_id", "normalized_keyword", "country", "device"],
                  [F.desc_nulls_last("searched_at"), F.asc("serp_search_id")])


def rank_observations(searches: DataFrame, results: DataFrame, features: DataFrame,
                      projects: DataFrame) -> DataFrame:
    """Fresh searches → observation rows with a nullable rank.

    The feature list holds the distinct known types in order, so it has a fixed bound.
    """
    domains = projects.select("project_id", "domain", F.col("project_id").alias("own"))
    own = find_ranks(results, searches, domains, "own")
    kinds = features.groupBy("serp_search_id").agg(
        F.array_sort(F.collect_set("feature_type")).alias("serp_features"))
    return (searches.select("serp_search_id", "project_id", "searched_at")
            .join(own.select("serp_search_id", "rank", F.col("url").alias("ranking_url")),
                  "serp_search_id", "left")
            .join(kinds, "serp_search_id", "left")
            .withColumnRenamed("searched_at", "observed_at"))


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Requests answered by a search of the last seven days, unless forced (K5)."""
    newest = latest(cache.where(F.col("cache_key").isNotNull()), ["cache_key"],
                    [F.desc_nulls_last("searched_at"), F.asc("serp_search_id")])
    fresh = F.col("searched_at") >= as_of - F.expr(f"INTERVAL '{CACHE_DAYS}' DAY")
    hit = F.coalesce(fresh & ~F.col("force_refresh"), F.lit(False))
    return (requests.join(newest.select("cache_key", "serp_search_id", "searched_at"),
                          "cache_key", "left")
            .withColumn("from_cache", hit)
            .withColumn("reused_search_id", F.when(hit, F.col("serp_search_id")))
            .drop("serp_search_id", "searched_at"))


def replace_snapshots(searches: DataFrame) -> DataFrame:
    """Newest snapshot per cache key under the first row's id (K4).

    Returns ``snapshot_id`` (whose results count now) and ``serp_search_id`` (the identity that
    stays).
    """
    kept = searches.groupBy("cache_key").agg(F.min("serp_search_id").alias("_first"))
    newest = latest(searches, ["cache_key"], [F.desc_nulls_last("searched_at"), F.desc("serp_search_id")])
    return (newest.withColumnRenamed("serp_search_id", "snapshot_id").join(kept, "cache_key")
            .withColumnRenamed("_first", "serp_search_id"))


def refresh_snapshots(arrived: DataFrame, tables: list[tuple[RangedTable, DataFrame]]) -> None:
    """Replace the rows of the cache keys among ``arrived`` by their newest search's, in each stored table (K4).

    ``arrived`` are all searches of these keys; a table comes with the rows that the searches have now, and only
    those of its files that hold some of them are rewritten.
    """
    kept = stage(replace_snapshots(arrived).select("snapshot_id", F.col("serp_search_id").alias("_kept")))
    for table, rows in tables:
        fresh = (rows.join(kept, F.col("serp_search_id") == F.col("snapshot_id")).drop("serp_search_id", "snapshot_id")
                 .withColumnRenamed("_kept", "serp_search_id").select(*rows.columns))
        table.replace(arrived.select("serp_search_id"), fresh)


def competitor_overview(results: DataFrame, searches: DataFrame,
                        competitors: DataFrame) -> DataFrame:
    """Appearances and mean rank per competitor."""
    ranks = find_ranks(results, searches, competitors, "competitor_id")
    seen = ranks.groupBy("project_id", "competitor_id").agg(
        F.count("*").alias("serp_appearances"), rounded(F.avg("rank"), 1).alias("avg_position"))
    return (competitors.select("project_id", "competitor_id", "domain")
            .join(seen, ["project_id", "competitor_id"], "left")
            .withColumn("serp_appearances", F.coalesce("serp_appearances", F.lit(0))))


def competitor_top_pages(results: DataFrame, searches: DataFrame, competitors: DataFrame,
                         n: int = 20) -> DataFrame:
    """Pages of a competitor that rank for most searches."""
    ranks = find_ranks(results, searches, competitors, "competitor_id")
    pages = (ranks.where(F.coalesce("url", F.lit("")) != "")
             .groupBy("project_id", "competitor_id", "url")
             .agg(F.count("*").alias("keywords"), F.min("rank").alias("best_rank")))
    return top_n(pages, ["project_id", "competitor_id"],
                 [F.desc("keywords"), F.asc("best_rank"), F.asc("url")], n)


def serp_history(searches: DataFrame, results: DataFrame, features: DataFrame) -> DataFrame:
    """Searches with their number of results and features."""
    n = results.groupBy("serp_search_id").agg(F.count("*").alias("results"))
    f = features.groupBy("serp_search_id").agg(F.count("*").alias("features"))
    return (searches.join(n, "serp_search_id", "left").join(f, "serp_search_id", "left")
            .withColumn("results", F.coalesce("results", F.lit(0)))
            .withColumn("features", F.coalesce("features", F.lit(0))))


def serp_detail(searches: DataFrame, results: DataFrame) -> DataFrame:
    """Result rows of each search, one row per result rather than one list per search (Q15)."""
    return searches.select("serp_search_id", "project_id", "keyword").join(
        results.select("serp_search_id", "position", "result_type", "domain", "url"),
        "serp_search_id")


def serp_detail_features(searches: DataFrame, features: DataFrame) -> DataFrame:
    """Features of each search beside its results: one row per feature, in its place (Q15)."""
    return searches.select("serp_search_id", "project_id", "keyword").join(features, "serp_search_id")
