"""Rank-tracking queries: W1, W4, W7, A19, Q10, Q11, Q32, L7."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import Tables, half_up, query
from rankloom.functions.numbers import rounded
from rankloom.operators.ranking import page_of
from rankloom.plans import rankings

MOVEMENT_CTE = """
    o AS (SELECT *, row_number() OVER (PARTITION BY tracked_keyword_id ORDER BY observed_at DESC, event_id DESC) AS rn
          FROM {rank_observations}),
    prev AS (SELECT tracked_keyword_id, min(rn) AS rn FROM o WHERE rn >= 2 AND rank IS NOT NULL GROUP BY tracked_keyword_id),
    m AS (SELECT o.tracked_keyword_id, max(CASE WHEN o.rn = 1 THEN rank END) AS current_rank,
                 max(CASE WHEN o.rn = 1 THEN ranking_url END) AS current_url,
                 max(CASE WHEN o.rn = p.rn THEN rank END) AS previous_rank, min(rank) AS best_rank, max(rank) AS worst_rank,
                 count(*) AS observations
          FROM o LEFT JOIN prev p ON p.tracked_keyword_id = o.tracked_keyword_id
          GROUP BY o.tracked_keyword_id)"""


@query("w1_movement", f"WITH {MOVEMENT_CTE} SELECT *, previous_rank - current_rank AS change FROM m")
def movement(t: Tables):
    return rankings.movement(t.rank_observations).drop("last_checked_at")


@query("q10_movement_list", f"""
    WITH {MOVEMENT_CTE}
    SELECT t.tracked_keyword_id, project_id, keyword, country, device, current_rank, previous_rank,
           previous_rank - current_rank AS change, best_rank, worst_rank, coalesce(observations, 0) AS observations
    FROM {{tracked_keywords}} t LEFT JOIN m ON m.tracked_keyword_id = t.tracked_keyword_id WHERE is_active""")
def movement_list(t: Tables):
    return rankings.movement_list(t.tracked_keywords, t.rank_observations).select(
        "tracked_keyword_id", "project_id", "keyword", "country", "device", "current_rank",
        "previous_rank", "change", "best_rank", "worst_rank", "observations")


@query("l7_tracked_page", """
    SELECT tracked_keyword_id, project_id, keyword FROM {tracked_keywords} WHERE is_active
    ORDER BY keyword, tracked_keyword_id LIMIT 100 OFFSET 100""")
def tracked_page(t: Tables):
    rows = t.tracked_keywords.where("is_active").select("tracked_keyword_id", "project_id", "keyword")
    return page_of(rows, rankings.name_order(), page=2, size=100)


@query("q11_rank_history", """
    SELECT tracked_keyword_id, event_id, rank, ranking_url FROM {rank_observations}
    WHERE observed_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY""")
def rank_history(t: Tables):
    return rankings.history(t.rank_observations, F.lit("2024-01-31").cast("date"), 14).select(
        "tracked_keyword_id", "event_id", "rank", "ranking_url")


@query("w7_sparkline", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY tracked_keyword_id ORDER BY observed_at, event_id) AS i,
                      count(*) OVER (PARTITION BY tracked_keyword_id) AS n, min(rank) OVER (PARTITION BY tracked_keyword_id) AS low,
                      max(rank) OVER (PARTITION BY tracked_keyword_id) AS high
               FROM {{rank_observations}} WHERE rank IS NOT NULL)
    SELECT tracked_keyword_id, event_id, CAST(i AS INTEGER) AS point,
           {half_up('CAST(i - 1 AS DOUBLE) / greatest(1, n - 1) * 100', 3)} AS x,
           {half_up('30 - CAST(rank - low AS DOUBLE) / greatest(1, high - low) * 26', 3)} AS y
    FROM r""")
def sparkline(t: Tables):
    points = rankings.sparkline(t.rank_observations)
    return points.withColumn("x", rounded(F.col("x"), 3)).withColumn("y", rounded(F.col("y"), 3))


@query("q32_scheduled_batch", """
    SELECT CASE WHEN organization_id IN (SELECT organization_id FROM {provider_accounts}
                     WHERE status IN ('CONFIGURED', 'ACTIVE') AND provider = 'dataforseo')
                THEN 'queued' ELSE 'skipped_no_provider' END AS state, count(*) AS keywords
    FROM {tracked_keywords} WHERE is_active GROUP BY 1""")
def scheduled(t: Tables):
    return rankings.scheduled_counts(t.tracked_keywords, t.provider_accounts)
