"""Keyword-gap queries: Q12, K11, L2."""

from __future__ import annotations

from rankloom.catalog.keywords import KEYWORDS_CTE, MATCH_SQL, stored
from rankloom.catalog.registry import Tables, query
from rankloom.catalog.results import LATEST_CTE, RESULTS_CTE, ranks_cte
from rankloom.catalog.scalars import opportunity_sql
from rankloom.operators.ranking import page_of
from rankloom.plans import gap
from rankloom.session import stage
from rankloom.sources import vendor

LABELS = ["brand", "rival", "shop"]
_NEAR = "CASE WHEN your_rank IS NULL THEN 1.0e0 WHEN your_rank BETWEEN 4 AND 15 THEN 1.2e0 WHEN your_rank <= 3 THEN 0.7e0 ELSE 1.0e0 END"

GAP_CTE = f"""
    {KEYWORDS_CTE}, {RESULTS_CTE}, {LATEST_CTE},
    {ranks_cte('ranks', '{competitors}', 'competitor_id', 'latest').replace("r.result_type = 'organic' AND", "r.result_type = 'organic' AND t.is_active AND")},
    own AS (SELECT tracked_keyword_id, rank AS your_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY tracked_keyword_id ORDER BY observed_at DESC, event_id DESC) AS rn FROM {{rank_observations}}) WHERE rn = 1),
    comp AS (SELECT t.tracked_keyword_id, r.competitor_id, r.rank FROM {{tracked_keywords}} t
        JOIN latest l ON l.project_id = t.project_id AND l.normalized_keyword = t.normalized_keyword AND l.country = t.country AND l.device = t.device
        JOIN ranks r ON r.serp_search_id = l.serp_search_id WHERE t.is_active),
    best AS (SELECT tracked_keyword_id, min(rank) AS best_rank, count(*) AS n FROM comp GROUP BY tracked_keyword_id),
    matched AS (SELECT t.*, {MATCH_SQL} AS matched_id FROM {{tracked_keywords}} t WHERE is_active),
    joined AS (SELECT t.project_id, t.tracked_keyword_id, t.keyword, your_rank, best_rank, coalesce(n, 0) AS n, s.keyword_id, search_volume, s.difficulty, s.intent
        FROM matched t LEFT JOIN own ON own.tracked_keyword_id = t.tracked_keyword_id
        LEFT JOIN best ON best.tracked_keyword_id = t.tracked_keyword_id LEFT JOIN scored s ON s.keyword_id = t.matched_id),
    gap AS (SELECT project_id, tracked_keyword_id, keyword, your_rank, best_rank AS best_competitor_rank, n AS ranking_competitors,
        CASE WHEN your_rank IS NULL AND best_rank IS NOT NULL THEN 'missing' WHEN your_rank > best_rank THEN 'weak'
             WHEN your_rank IS NOT NULL THEN 'strong' ELSE 'shared' END AS bucket,
        search_volume, difficulty, intent,
        CASE WHEN keyword_id IS NULL THEN 0.0e0 ELSE {opportunity_sql('difficulty', 'intent', _NEAR)} END AS opportunity FROM joined)"""


def parts(t: Tables):
    """Gap rows and the competitor ranks behind them."""
    used = stage(gap.used_searches(t.tracked_keywords, t.searches))
    results = vendor.renumber_flat_items(gap.items_of(used, t.serp_items))
    ranks = gap.competitor_ranks(t.tracked_keywords, t.searches, results, t.competitors, used)
    rows = gap.keyword_gap(t.tracked_keywords, t.rank_observations, t.searches, None, t.competitors,
                           *stored(t), ranks=ranks)
    return rows, ranks


@query("q12_keyword_gap", f"WITH {GAP_CTE} SELECT * FROM gap")
def keyword_gap(t: Tables):
    return parts(t)[0]


@query("q12_keyword_gap_filtered", f"""
    WITH {GAP_CTE} SELECT * FROM gap WHERE bucket = 'shared' AND search_volume >= 5000 AND difficulty <= 60 AND intent = 'INFORMATIONAL'""")
def keyword_gap_filtered(t: Tables):
    return gap.filter_gap(parts(t)[0], bucket="shared", intent="informational", min_volume=5000, max_difficulty=60)


@query("l2_gap_page", f"""
    WITH {GAP_CTE} SELECT tracked_keyword_id, keyword, opportunity FROM gap ORDER BY opportunity DESC, keyword, tracked_keyword_id LIMIT 50""")
def gap_page(t: Tables):
    return page_of(parts(t)[0], gap.gap_order()).select("tracked_keyword_id", "keyword", "opportunity")


@query("q12_competitor_ranks", f"""
    WITH {GAP_CTE} SELECT t.project_id, c.tracked_keyword_id, c.competitor_id, c.rank
    FROM comp c JOIN {{tracked_keywords}} t ON t.tracked_keyword_id = c.tracked_keyword_id""")
def competitor_ranks(t: Tables):
    return parts(t)[1].select("project_id", "tracked_keyword_id", "competitor_id", "rank")


@query("k11_gap_export", f"""
    WITH {GAP_CTE} SELECT g.project_id, g.tracked_keyword_id, keyword, your_rank, bucket, x.domain AS competitor, c.rank AS competitor_rank
    FROM gap g LEFT JOIN comp c ON c.tracked_keyword_id = g.tracked_keyword_id LEFT JOIN {{competitors}} x ON x.competitor_id = c.competitor_id""")
def gap_export(t: Tables):
    rows, ranks = parts(t)
    return gap.gap_with_ranks(rows, ranks, t.competitors).select(
        "project_id", "tracked_keyword_id", "keyword", "your_rank", "bucket", "competitor", "competitor_rank")


@query("k11_gap_matrix", f"""
    WITH {GAP_CTE}, wide AS (
        SELECT tracked_keyword_id, {', '.join(f"min(rank) FILTER (WHERE label = '{x}') AS comp_{x}" for x in LABELS)}
        FROM comp JOIN {{competitors}} c ON c.competitor_id = comp.competitor_id GROUP BY tracked_keyword_id)
    SELECT g.tracked_keyword_id, keyword, your_rank, bucket, search_volume, difficulty, intent, opportunity, {', '.join('comp_' + x for x in LABELS)}
    FROM gap g LEFT JOIN wide w ON w.tracked_keyword_id = g.tracked_keyword_id""")
def gap_matrix(t: Tables):
    rows, ranks = parts(t)
    wide = gap.gap_matrix(rows, ranks, t.competitors, "label", LABELS)
    return wide.select("tracked_keyword_id", "keyword", "your_rank", "bucket", "search_volume", "difficulty",
                       "intent", "opportunity", *[f"comp_{x}" for x in LABELS])
