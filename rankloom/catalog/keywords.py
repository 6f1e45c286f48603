"""Keyword queries: K3, S7, S10, S11, J3, J6–J8, W5, L3, Q6–Q9."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import Tables, half_up, query
from rankloom.catalog.results import LATEST_CTE, RESULTS_CTE
from rankloom.catalog.scalars import DIFFICULTY, _intent_case, opportunity_sql
from rankloom.functions.numbers import rounded
from rankloom.operators.ranking import latest, page_of
from rankloom.plans import keywords as KP
from rankloom.plans import serp
from rankloom.session import stage
from rankloom.sources import vendor

NORM = "trim(regexp_replace(trim(lower(keyword)), '\\s+', ' ', 'g'), ' .,;:!?\"''()[]{}')"
KEYWORDS_CTE = f"""
    batch AS (SELECT * EXCLUDE (country, language), upper(country) AS country, lower(language) AS language, {NORM} AS normalized_keyword
              FROM {{keyword_batch}} WHERE {NORM} <> ''),
    numbered AS (SELECT *, min(seq) OVER (PARTITION BY organization_id, normalized_keyword, country, language) AS keyword_id FROM batch),
    keywords AS (SELECT keyword_id, organization_id, normalized_keyword, country, language, project_id, trim(keyword) AS keyword
                 FROM numbered WHERE seq = keyword_id),
    intents AS (SELECT keyword_id, {_intent_case('intent')} AS intent, CAST({_intent_case('confidence')} AS DOUBLE) AS confidence
                FROM numbered WHERE seq = keyword_id),
    metrics AS (SELECT keyword_id, seq, created_on, search_volume, cpc, competition, provider FROM numbered),
    newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY created_on DESC, seq DESC) AS rn FROM metrics) WHERE rn = 1),
    facts AS (SELECT k.*, m.search_volume, m.cpc, m.competition, m.provider, i.intent, i.confidence AS intent_confidence
              FROM keywords k JOIN newest m ON m.keyword_id = k.keyword_id JOIN intents i ON i.keyword_id = k.keyword_id),
    graded AS (SELECT *, {DIFFICULTY} AS difficulty FROM facts),
    scored AS (SELECT *, {opportunity_sql('difficulty', 'intent')} AS opportunity FROM graded)"""


def stored_from(batch):
    """Keywords, metrics and intents after a batch; each is written once, then read."""
    items = stage(KP.clean_batch(batch))
    keywords = stage(KP.stored_keywords(items))
    return keywords, KP.metric_snapshots(items, keywords), KP.keyword_intents(items, keywords)


def stored(t: Tables):
    return stored_from(t.keyword_batch)


def scored(t: Tables):
    return KP.scored_keywords(*stored(t))


@query("k3_stored_keywords", f"WITH {KEYWORDS_CTE} SELECT * FROM keywords")
def stored_keywords(t: Tables):
    items = KP.clean_batch(t.keyword_batch)
    early = KP.stored_keywords(items.where(F.col("seq") < 700))
    return KP.stored_keywords(items.where(F.col("seq") >= 700), early).drop("created_on")


@query("k3_intents", f"WITH {KEYWORDS_CTE} SELECT *, 'heuristic' AS method FROM intents")
def intents(t: Tables):
    return stored(t)[2]


@query("j6_latest_metric", f"WITH {KEYWORDS_CTE} SELECT keyword_id, seq, search_volume, competition FROM newest")
def latest_metric(t: Tables):
    return KP.latest_metric(stored(t)[1]).select("keyword_id", "seq", "search_volume", "competition")


@query("w5_metric_history", f"""
    WITH {KEYWORDS_CTE}
    SELECT keyword_id, seq, search_volume, CAST(rn AS INTEGER) AS nth_newest FROM (
        SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY created_on DESC, seq DESC) AS rn FROM metrics) WHERE rn <= 30""")
def metric_history(t: Tables):
    return KP.metric_history(stored(t)[1]).select("keyword_id", "seq", "search_volume", "nth_newest")


@query("q6_scored_keywords", f"""
    WITH {KEYWORDS_CTE}
    SELECT keyword_id, organization_id, keyword, intent, intent_confidence, search_volume, cpc, competition, provider, difficulty, opportunity FROM scored""")
def scored_keywords(t: Tables):
    return scored(t).select("keyword_id", "organization_id", "keyword", "intent", "intent_confidence", "search_volume",
                            "cpc", "competition", "provider", "difficulty", "opportunity")


_SATURATION = f"""
    sat AS (SELECT serp_search_id, avg(CASE WHEN len(string_split(domain, '.')) <= 2 AND length(domain) <= 20 THEN 1.0e0 ELSE 0.0e0 END) AS saturation
            FROM results WHERE result_type = 'organic' AND position <= 10 GROUP BY serp_search_id),
    seen AS (SELECT k.keyword_id, l.serp_search_id, row_number() OVER (PARTITION BY k.keyword_id ORDER BY l.searched_at DESC, l.serp_search_id) AS rn
             FROM keywords k JOIN latest l ON l.project_id = k.project_id AND l.normalized_keyword = k.normalized_keyword AND l.country = k.country),
    measured AS (SELECT keyword_id, saturation FROM seen JOIN sat ON sat.serp_search_id = seen.serp_search_id WHERE rn = 1)"""


@query("q6_scored_with_saturation", f"""
    WITH {KEYWORDS_CTE}, {RESULTS_CTE}, {LATEST_CTE}, {_SATURATION}
    SELECT f.keyword_id, {DIFFICULTY.replace("0.40e0 * 0.5e0", "0.40e0 * coalesce(saturation, 0.5e0)")} AS difficulty
    FROM facts f LEFT JOIN measured m ON m.keyword_id = f.keyword_id""")
def scored_with_saturation(t: Tables):
    keywords, metrics, guesses = stored(t)
    newest = serp.latest_searches(t.searches).select(
        "serp_search_id", "project_id", "normalized_keyword", "country", "searched_at")
    seen = latest(keywords.select("keyword_id", "project_id", "normalized_keyword", "country")
                  .join(newest, ["project_id", "normalized_keyword", "country"]), ["keyword_id"],
                  [F.desc("searched_at"), F.asc("serp_search_id")])
    measured = seen.join(KP.saturation_by_search(vendor.renumber_flat_items(t.serp_items)), "serp_search_id")
    rows = KP.scored_keywords(keywords, metrics, guesses, measured.select("keyword_id", "saturation"))
    return rows.select("keyword_id", "difficulty")


@query("q7_keyword_list", f"""
    WITH {KEYWORDS_CTE}
    SELECT keyword_id, project_id, keyword, intent, search_volume, difficulty, opportunity FROM scored
    WHERE normalized_keyword ILIKE '%et%' AND intent = 'TRANSACTIONAL' AND search_volume >= 1000 AND difficulty <= 55""")
def keyword_list(t: Tables):
    rows = KP.keyword_list(scored(t), search=" ET ", intent="transactional", min_volume=1000, max_difficulty=55)
    return rows.select("keyword_id", "project_id", "keyword", "intent", "search_volume", "difficulty", "opportunity")


@query("l3_keyword_page", f"""
    WITH {KEYWORDS_CTE}
    SELECT keyword_id, keyword, opportunity FROM scored ORDER BY opportunity DESC, keyword, keyword_id LIMIT 50""")
def keyword_page(t: Tables):
    return page_of(scored(t), KP.list_order("opportunity")).select("keyword_id", "keyword", "opportunity")


@query("q8_keyword_detail", f"""
    WITH {KEYWORDS_CTE},
    h AS (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY created_on DESC, seq DESC) AS rn FROM metrics)
    SELECT s.keyword_id, s.opportunity, s.difficulty, h.seq, h.search_volume AS seen_volume, CAST(h.rn AS INTEGER) AS nth_newest
    FROM scored s JOIN h ON h.keyword_id = s.keyword_id WHERE rn <= 30""")
def keyword_detail(t: Tables):
    keywords, metrics, guesses = stored(t)
    view = KP.scored_keywords(keywords, metrics, guesses).select("keyword_id", "opportunity", "difficulty")
    history = KP.metric_history(metrics).select(
        "keyword_id", "seq", F.col("search_volume").alias("seen_volume"), "nth_newest")
    return view.join(history, "keyword_id")


def _vendor_items(t: Tables):
    n = F.col("p_partkey")
    months = F.transform(F.sequence(F.lit(1), (n % 15).cast("int") + 1), lambda m: F.struct(
        F.lit(2024).alias("year"), m.alias("month"), (m * n).alias("search_volume")))
    item = F.to_json(F.struct(
        F.when(n % 9 > 0, F.col("p_name")).otherwise("").alias("keyword"), (n * 10).alias("search_volume"),
        (n % 101).alias("competition_index"), months.alias("monthly_searches")))
    return t.part.select(n.alias("seq"), F.from_json(item, vendor.KEYWORD_ITEM).alias("item"))


@query("s7_s11_keyword_metrics", """
    SELECT p_partkey AS seq, CASE WHEN p_partkey % 9 > 0 THEN p_name ELSE '' END AS keyword, p_partkey * 10 AS search_volume,
           CAST(p_partkey % 101 AS DOUBLE) / 100.0e0 AS competition, CAST(least(12, p_partkey % 15 + 1) AS INTEGER) AS months,
           p_partkey * greatest(1, p_partkey % 15 + 1 - 11) AS oldest, p_partkey * (p_partkey % 15 + 1) AS newest
    FROM part""")
def keyword_metrics(t: Tables):
    m = vendor.keyword_metrics(_vendor_items(t))
    return m.select("seq", "keyword", "search_volume", "competition", F.size("trend").alias("months"),
                    F.element_at("trend", 1).alias("oldest"), F.element_at("trend", -1).alias("newest"))


@query("w10_keyword_trend", f"""
    WITH m AS (SELECT p_partkey AS seq, p_partkey % 15 + 1 AS n, unnest(range(greatest(1, p_partkey % 15 - 10), p_partkey % 15 + 2)) AS k FROM part)
    SELECT seq, CAST(k - greatest(1, n - 11) AS INTEGER) AS month, k * seq AS volume,
           {half_up('CAST(k * seq AS DOUBLE) / greatest(1, n * seq)', 4)} AS share FROM m""")
def keyword_trend(t: Tables):
    shares = KP.trend_shares(vendor.keyword_metrics(_vendor_items(t)), "seq")
    return shares.withColumn("share", rounded(F.col("share"), 4))


@query("s10_suggestion_batch", """
    SELECT seq, keyword, request FROM (
        SELECT p_partkey AS seq, p_name AS keyword, p_partkey % 7 AS request,
               row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey DESC) AS rn
        FROM part WHERE p_partkey % 9 > 0) WHERE rn <= 1500""")
def suggestions(t: Tables):
    rows = vendor.keyword_metrics(_vendor_items(t))
    asked = rows.withColumn("request", F.col("seq") % 7)
    return vendor.suggestion_batch(asked, ["request"], [F.desc("seq")], 1500).select("seq", "keyword", "request")


@query("q9_keyword_research", f"""
    WITH {KEYWORDS_CTE}
    SELECT keyword_id, organization_id, project_id, normalized_keyword, difficulty, opportunity FROM scored""")
def keyword_research(t: Tables):
    items = t.keyword_batch.select(
        "seq", "organization_id", "project_id", "country", "language", "created_on",
        F.from_json(F.to_json(F.struct("keyword", "search_volume", "cpc",
                                       (F.col("competition") * 100).alias("competition_index"))),
                    vendor.KEYWORD_ITEM).alias("item"))
    rows = KP.scored_keywords(*stored_from(vendor.keyword_metrics(items)))
    return rows.select("keyword_id", "organization_id", "project_id", "normalized_keyword", "difficulty", "opportunity")


MATCH_SQL = """coalesce(CASE WHEN t.keyword_id IN (SELECT keyword_id FROM keywords) THEN t.keyword_id END,
    (SELECT keyword_id FROM keywords k WHERE k.organization_id = t.organization_id AND k.normalized_keyword = t.normalized_keyword
     AND k.country = t.country AND k.language = t.language))"""


@query("j3_match_tracked", f"""
    WITH {KEYWORDS_CTE} SELECT t.tracked_keyword_id, {MATCH_SQL} AS matched_keyword_id FROM {{tracked_keywords}} t""")
def match_tracked(t: Tables):
    return KP.match_tracked(t.tracked_keywords, stored(t)[0]).select("tracked_keyword_id", "matched_keyword_id")


@query("j8_untracked_keywords", f"""
    WITH {KEYWORDS_CTE}
    SELECT keyword_id, project_id, normalized_keyword FROM keywords k
    WHERE NOT EXISTS (SELECT 1 FROM {{tracked_keywords}} t WHERE t.project_id = k.project_id AND t.normalized_keyword = k.normalized_keyword)""")
def untracked_keywords(t: Tables):
    return KP.untracked(stored(t)[0], t.tracked_keywords).select("keyword_id", "project_id", "normalized_keyword")
