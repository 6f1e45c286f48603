"""Recommendation queries: Q19–Q27, A17, L6, U2."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.audits import ISSUES_CTE, issues_of
from rankloom.catalog.gaps import GAP_CTE, parts
from rankloom.catalog.keywords import KEYWORDS_CTE, scored
from rankloom.catalog.ranks import MOVEMENT_CTE
from rankloom.catalog.registry import CHECKS, Tables, half_up, query
from rankloom.catalog.search_console import _STORED, stored_queries
from rankloom.catalog.tables import check_sql
from rankloom.functions.scores import CATEGORY_EFFORT, SEVERITY_IMPACT
from rankloom.operators.ranking import page_of
from rankloom.plans import overview
from rankloom.plans import recommend as R


_STORED_QUERIES = _STORED.format(dim="query")
SHOWN = ["project_id", "type", "source", "severity", "impact", "effort", "confidence", "score", "title",
         "description", "why", "recommended_action", "related_url", "related_keyword", "status"]

# What users read beside a finding, written out once more for the checks.
_WHY = {
    "audit": ("The last completed crawl found this problem on pages of the site.", "Open the issue, repair the listed pages and crawl the site again."),
    "ctr": ("The query is shown often near the first page, yet few searchers choose the result.",
            "Sharpen title and description, and answer the query early on the page."),
    "drop": ("The query brings far fewer visits than in the period before.", "Compare the page with those that now rank above it, then refresh it."),
    "keywords": ("The keyword has demand and is within reach, but is not tracked.", "Plan a page for the keyword and start tracking it."),
    "ranks": ("The page has lost places since the last check.", "Look for changes of the page and of the results, and strengthen its links."),
    "gap": ("Competitors reach searchers here that the site misses.", "Create or extend a page that serves the query better than theirs."),
}


def decline_as_of():
    """Splits the thirty given days into eight recent and twenty-two prior ones."""
    return F.lit("2024-02-20").cast("date")


def _score(impact: str, confidence: float, effort: str) -> str:
    return half_up(f"least(100.0e0, greatest(0.0e0, {impact} * {confidence}e0 * 10.0e0 / least(5.0e0, greatest(0.5e0, {effort}))))", 1)


def _shape(project: str, kind: str, source: str, severity: str, impact: str, effort: str, confidence: float, title: str,
           description: str, guidance: str, keyword: str = "NULL", url: str = "NULL") -> str:
    return (f"{project} AS project_id, '{kind}' AS type, '{source}' AS source, {severity} AS severity, CAST({impact} AS DOUBLE) AS impact, "
            f"CAST({effort} AS DOUBLE) AS effort, {confidence}e0 AS confidence, {_score(impact, confidence, effort)} AS score, {title} AS title, "
            f"{description} AS description, '{_WHY[guidance][0]}' AS why, '{_WHY[guidance][1]}' AS recommended_action, CAST({url} AS VARCHAR) AS related_url, CAST({keyword} AS VARCHAR) AS related_keyword, 'OPEN' AS status")


_IMPACT = "CASE severity " + " ".join(f"WHEN '{s}' THEN {v}e0" for s, v in SEVERITY_IMPACT.items()) + " ELSE 3.0e0 END"
_EFFORT = "CASE category " + " ".join(f"WHEN '{c}' THEN {v}e0" for c, v in CATEGORY_EFFORT.items()) + " ELSE 2.0e0 END"

_AUDIT = f"""
    WITH {ISSUES_CTE}
    SELECT {_shape('project_id', 'TECHNICAL', 'AUDIT', 'severity', _IMPACT, _EFFORT, 0.9, 'message', 'message', 'audit')}
    FROM (SELECT i.*, r.project_id, row_number() OVER (PARTITION BY r.project_id ORDER BY affected_count DESC, code) AS rn
          FROM issues i JOIN {{page_runs}} r ON r.crawl_run_id = i.crawl_run_id) WHERE rn <= 15"""


@query("q19_from_audit", _AUDIT)
def from_audit(t: Tables):
    return R.from_audit(issues_of(t), t.page_runs, n=15)


@query("q20_from_striking_distance", f"""
    WITH q AS ({_STORED_QUERIES}),
    g AS (SELECT p.project_id, query, sum(clicks) AS clicks, sum(impressions) AS impressions, avg(position) AS position
          FROM q JOIN {{gsc_properties}} p ON p.property_id = q.property_id AND is_selected GROUP BY p.project_id, query
          HAVING avg(position) BETWEEN 4 AND 15 AND sum(impressions) >= 500),
    top AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY impressions DESC, query) AS rn FROM g)
    SELECT {_shape('project_id', 'CONTENT', 'GSC', "'WARNING'", '7.0e0', '2.0e0', 0.75, "'Striking-distance query needs CTR work: ' || query",
        f"'Position ' || CAST({half_up('position', 1)} AS VARCHAR) || ' with ' || format('{{:,}}', CAST(impressions AS BIGINT)) || ' impressions but ' || printf('%.1f', {half_up('CAST(clicks AS DOUBLE) / impressions * 100', 1)}) || '% CTR.'", 'ctr', 'query')}
    FROM top WHERE rn <= 10 AND CAST(clicks AS DOUBLE) / impressions < 0.05""")
def from_striking_distance(t: Tables):
    return R.from_striking_distance(stored_queries(t), t.gsc_properties, largest_of=10)


@query("q21_from_decliners", f"""
    WITH q AS ({_STORED_QUERIES}),
    c AS (SELECT p.project_id, query, coalesce(sum(clicks) FILTER (WHERE date >= DATE '2024-01-23'), 0) AS now_c,
                 coalesce(sum(clicks) FILTER (WHERE date < DATE '2024-01-23'), 0) AS was_c
          FROM q JOIN {{gsc_properties}} p ON p.property_id = q.property_id AND is_selected WHERE date >= DATE '2023-12-26'
          GROUP BY p.project_id, query HAVING count(*) FILTER (WHERE date >= DATE '2024-01-23') > 0),
    top AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY was_c - now_c DESC, query) AS rn FROM c WHERE was_c >= 50)
    SELECT {_shape('project_id', 'CONTENT', 'GSC', "'WARNING'", '6.0e0', '3.0e0', 0.65, "'Declining query needs attention: ' || query",
        "'Clicks fell from ' || format('{:,}', CAST(was_c AS BIGINT)) || ' to ' || format('{:,}', CAST(now_c AS BIGINT)) || ' in 28 days.'", 'drop', 'query')}
    FROM top WHERE rn <= 10 AND CAST(was_c - now_c AS DOUBLE) / was_c >= 0.3""")
def from_decliners(t: Tables):
    return R.from_decliners(stored_queries(t), t.gsc_properties, decline_as_of(), largest_of=10)


@query("q22_from_keywords", f"""
    WITH {KEYWORDS_CTE},
    c AS (SELECT s.* EXCLUDE (project_id), p.project_id FROM scored s JOIN {{projects}} p ON p.organization_id = s.organization_id AND NOT p.is_deleted
          WHERE s.project_id IS NULL
          UNION ALL SELECT s.* EXCLUDE (project_id), s.project_id FROM scored s WHERE s.project_id IS NOT NULL),
    top AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY opportunity DESC, keyword, keyword_id) AS rn FROM c
            WHERE opportunity >= 40 AND search_volume >= 500 AND NOT EXISTS (
                SELECT 1 FROM {{tracked_keywords}} t WHERE t.project_id = c.project_id AND t.normalized_keyword = c.normalized_keyword))
    SELECT {_shape('project_id', 'CONTENT', 'KEYWORDS', "'NOTICE'", half_up('opportunity / 10', 1), '3.0e0', 0.6, "'Content opportunity: ' || keyword",
        f"'Opportunity ' || CAST(CAST({half_up('opportunity', 0)} AS BIGINT) AS VARCHAR) || ', volume ' || format('{{:,}}', search_volume) || ', difficulty ' || CAST(difficulty AS VARCHAR) || ', intent ' || intent || '.'", 'keywords', 'keyword')}
    FROM top WHERE rn <= 10""")
def from_keywords(t: Tables):
    return R.from_keywords(scored(t), t.tracked_keywords, t.projects)


@query("q23_from_ranks", f"""
    WITH {MOVEMENT_CTE}
    SELECT {_shape('project_id', 'RANKING', 'RANK_TRACKING', "'WARNING'", '6.5e0', '2.5e0', 0.7, "'Ranking slipped for: ' || keyword",
        "'Now #' || CAST(current_rank AS VARCHAR) || ' (was #' || CAST(previous_rank AS VARCHAR) || ').'", 'ranks', 'keyword', 'current_url')}
    FROM {{tracked_keywords}} t JOIN m ON m.tracked_keyword_id = t.tracked_keyword_id WHERE is_active AND previous_rank - current_rank <= -3""")
def from_ranks(t: Tables):
    return R.from_ranks(t.tracked_keywords, t.rank_observations)


@query("q24_from_gap", f"""
    WITH {GAP_CTE},
    head AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY opportunity DESC, keyword, tracked_keyword_id) AS rn FROM gap),
    picked AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rn) AS pick FROM head
               WHERE rn <= 25 AND bucket IN ('missing', 'weak') AND opportunity >= 50)
    SELECT {_shape('project_id', 'COMPETITOR', 'GAP', "'NOTICE'", half_up('opportunity / 10', 1), '3.0e0', 0.55, "'Close the gap on: ' || keyword",
        "'Competitors rank #' || CAST(coalesce(best_competitor_rank, 0) AS VARCHAR) || ' while you are at #' || coalesce(CAST(your_rank AS VARCHAR), '–') || '.'", 'gap', 'keyword')}
    FROM picked WHERE pick <= 10""")
def from_gap(t: Tables):
    return R.from_gap(parts(t)[0], head=25, n=10)


# The complete lists: every finding that qualifies, whatever its place.
@query("q19_every_audit_finding", _AUDIT.replace("WHERE rn <= 15", ""))
def every_audit_finding(t: Tables):
    return R.from_audit(issues_of(t), t.page_runs)


@query("q20_every_striking_distance", CHECKS["q20_from_striking_distance"].replace("WHERE rn <= 10 AND", "WHERE"))
def every_striking_distance(t: Tables):
    return R.from_striking_distance(stored_queries(t), t.gsc_properties)


@query("q21_every_decliner", CHECKS["q21_from_decliners"].replace("WHERE rn <= 10 AND", "WHERE"))
def every_decliner(t: Tables):
    return R.from_decliners(stored_queries(t), t.gsc_properties, decline_as_of())


@query("q22_every_keyword", CHECKS["q22_from_keywords"].replace("WHERE rn <= 10", ""))
def every_keyword(t: Tables):
    return R.from_keywords(scored(t), t.tracked_keywords, t.projects, n=None)


@query("q24_every_gap", CHECKS["q24_from_gap"].replace("rn <= 25 AND", "").replace("WHERE pick <= 10", ""))
def every_gap(t: Tables):
    return R.from_gap(parts(t)[0])


# No open gap of the given tables is worth 50; many are worth 20.
@query("q24_gaps_worth_20", CHECKS["q24_from_gap"].replace("rn <= 25 AND", "").replace("WHERE pick <= 10", "").replace("opportunity >= 50", "opportunity >= 20"))
def gaps_worth_20(t: Tables):
    return R.from_gap(parts(t)[0], least=20.0)


_COLLECTED = " UNION ALL ".join(
    f"SELECT project_id, source FROM ({CHECKS[name]})" for name in (
        "q19_from_audit", "q20_from_striking_distance", "q21_from_decliners", "q22_from_keywords",
        "q23_from_ranks", "q24_from_gap"))


@query("q25_u2_recalculate", f"""
    SELECT project_id, source, count(*) AS recommendations FROM ({_COLLECTED}
        UNION ALL SELECT * FROM ({check_sql("SELECT project_id, source FROM {recommendations} WHERE status <> 'OPEN'")}))
    GROUP BY project_id, source""")
def recalculate(t: Tables):
    rows = stored_queries(t)
    existing = t.recommendations.select(*SHOWN[:8], "title", *[F.lit("").alias(c) for c in ("description", "why", "recommended_action")],
                                        F.lit(None).cast("string").alias("related_url"),
                                        F.lit(None).cast("string").alias("related_keyword"), "status")
    fresh = [R.from_audit(issues_of(t), t.page_runs, n=15), R.from_striking_distance(rows, t.gsc_properties, largest_of=10),
             R.from_decliners(rows, t.gsc_properties, decline_as_of(), largest_of=10),
             R.from_keywords(scored(t), t.tracked_keywords, t.projects),
             R.from_ranks(t.tracked_keywords, t.rank_observations), R.from_gap(parts(t)[0], head=25, n=10)]
    return R.source_counts(R.recalculate(existing, fresh))


@query("q26_recommendation_list", """
    SELECT recommendation_id, project_id, score, severity,
           CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'NOTICE' THEN 3 ELSE 9 END AS severity_rank
    FROM {recommendations} WHERE type = 'CONTENT' AND source = 'GSC' AND severity = 'WARNING' AND status = 'OPEN' AND score >= 40""")
def recommendation_list(t: Tables):
    rows = R.recommendation_list(t.recommendations, kind="content", source="gsc", severity="warning", status="open", min_score=40)
    return rows.select("recommendation_id", "project_id", "score", "severity", "severity_rank")


@query("l9_recommendation_page", """
    SELECT recommendation_id, score, severity FROM {recommendations}
    ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'NOTICE' THEN 3 ELSE 9 END,
             score DESC, project_id, title LIMIT 50""")
def recommendation_page(t: Tables):
    return page_of(R.recommendation_list(t.recommendations), R.list_order("severity")).select(
        "recommendation_id", "score", "severity")


@query("l9_recent_recommendations", """
    SELECT recommendation_id, score, created_at FROM {recommendations} ORDER BY created_at DESC, project_id, title LIMIT 50""")
def recent_recommendations(t: Tables):
    return page_of(R.recommendation_list(t.recommendations), R.list_order("recent")).select("recommendation_id", "score", "created_at")


@query("a17_status_counts", "SELECT project_id, status, count(*) AS recommendations FROM {recommendations} GROUP BY project_id, status")
def status_counts(t: Tables):
    return R.status_counts(t.recommendations)


@query("q27_worklists", """
    SELECT recommendation_id, CASE WHEN score >= 70 THEN 'high_priority' ELSE 'quick_win' END AS worklist FROM {recommendations}
    WHERE score >= 70 OR (effort <= 1.5 AND impact >= 6 AND score < 70)""")
def worklists(t: Tables):
    return R.worklists(t.recommendations).select("recommendation_id", "worklist")


@query("l6_top_opportunities", """
    SELECT project_id, title, score, CAST(place AS INTEGER) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, title, source) AS place FROM {recommendations} WHERE status = 'OPEN') WHERE place <= 3""")
def top_opportunities(t: Tables):
    return overview.top_opportunities(t.recommendations).select("project_id", "title", "score", "place")
