"""Table-maintenance queries: S12, U4, K6, K9, K12–K18, F26."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.keywords import KEYWORDS_CTE, scored
from rankloom.catalog.registry import Tables, query
from rankloom.functions import urls as U
from rankloom.operators import upsert as UP
from rankloom.plans import usage
from rankloom.session import new_folder
from rankloom.sinks.files import usage_rows, view_rows
from rankloom.sinks.manifest import RangedTable
from rankloom.sources import vendor


_BACKFILL = """
    WITH e AS (SELECT project_id, organization_id, unnest(from_json(competitors, '["VARCHAR"]')) AS entry FROM {projects} WHERE NOT is_deleted),
    d AS (SELECT *, regexp_replace(regexp_extract(regexp_replace(lower(trim(entry)), '^https?://', ''), '^[^/?#:]*'), '^www[.]', '') AS domain FROM e WHERE trim(entry) <> '')
    SELECT project_id, organization_id, domain, min(trim(entry)) AS original_input, TRUE AS is_active FROM d
    WHERE regexp_matches(domain, '^[a-z0-9-]{1,63}([.][a-z0-9-]{1,63})*[.][a-z]{2,}$')
      AND (project_id, domain) NOT IN (SELECT project_id, domain FROM {competitors})
    GROUP BY project_id, organization_id, domain"""


@query("s12_every_competitor", _BACKFILL)
@query("s12_u4_competitor_backfill", _BACKFILL)
def competitor_backfill(t: Tables):
    return vendor.competitor_backfill(t.projects, t.competitors)


@query("k6_replace_run_results", """
    SELECT crawl_run_id, from_url, normalized_to_url FROM {links} WHERE crawl_run_id <> 2
    UNION ALL SELECT crawl_run_id, from_url, concat(normalized_to_url, '?v=2') FROM {links} WHERE crawl_run_id = 2""")
def replace_run(t: Tables):
    old = t.links.select("crawl_run_id", "from_url", "normalized_to_url")
    table = RangedTable(t.spark, new_folder(t.spark, "runs"), "crawl_run_id", ["from_url", "normalized_to_url"], rows_per_file=100_000)
    table.create(old)
    fresh = table.read().where(F.col("crawl_run_id") == 2).withColumn(
        "normalized_to_url", F.concat("normalized_to_url", F.lit("?v=2")))
    table.replace(fresh.select("crawl_run_id"), fresh)
    return table.read()


@query("k9_replace_open", """
    SELECT recommendation_id, project_id, status, title FROM {recommendations} WHERE status <> 'OPEN'
    UNION ALL SELECT recommendation_id + 1000000, project_id, 'OPEN', 'fresh' FROM {recommendations} WHERE score >= 90""")
def replace_open(t: Tables):
    rows = t.recommendations.select("recommendation_id", "project_id", "status", "title", "score")
    fresh = rows.where(F.col("score") >= 90).select(
        (F.col("recommendation_id") + 1000000).alias("recommendation_id"), "project_id",
        F.lit("OPEN").alias("status"), F.lit("fresh").alias("title"))
    return UP.replace_open(rows.drop("score"), fresh)


@query("k12_keyword_export", f"""
    WITH {KEYWORDS_CTE}
    SELECT keyword, intent, search_volume AS volume, cpc, difficulty, opportunity, provider, count(*) AS copies FROM scored GROUP BY ALL""")
def keyword_export(t: Tables):
    rows = view_rows(scored(t), "keywords")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


@query("k13_usage_rows", """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'serp' WHEN 'view' THEN 'keywords' ELSE 'exports' END AS service,
           CAST(CASE WHEN event_type IN ('click', 'view') THEN greatest(1, (event_id % 120) // 10) ELSE 1 END AS INTEGER) AS units
    FROM events""")
def metered(t: Tables):
    kind = F.col("event_type")
    service = F.when(kind == "click", "serp").when(kind == "view", "keywords").otherwise("exports")
    return usage_rows(t.events.select("event_id", service.alias("service"), (F.col("event_id") % 120).alias("size")))


@query("k14_add_competitors", """
    WITH asked AS (
        SELECT * FROM (SELECT c_custkey AS seq, c_custkey % 25 AS project_id,
                    's' || CAST(c_custkey % 400 AS VARCHAR) || '.com' AS domain, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE '' END AS label,
                    row_number() OVER (PARTITION BY c_custkey % 25, c_custkey % 400 ORDER BY c_custkey) AS rn FROM {customer}) WHERE rn = 1),
    good AS (SELECT a.* FROM asked a JOIN {projects} p ON p.project_id = a.project_id AND p.domain <> a.domain)
    SELECT coalesce(c.project_id, g.project_id) AS project_id, coalesce(c.domain, g.domain) AS domain,
           CASE WHEN c.domain IS NULL THEN g.label WHEN g.domain IS NOT NULL AND NOT c.is_active AND g.label <> '' THEN g.label ELSE c.label END AS label,
           g.domain IS NOT NULL OR c.is_active AS is_active
    FROM (SELECT project_id, domain, label, is_active FROM {competitors}) c
    FULL JOIN good g ON g.project_id = c.project_id AND g.domain = c.domain""")
def add_competitors(t: Tables):
    n = F.col("c_custkey")
    asked = t.customer.select(
        n.alias("request_seq"), (n % 25).alias("project_id"),
        U.normalize_domain(F.concat(F.lit("https://www.S"), (n % 400).cast("string"), F.lit(".com/"))).alias("domain"),
        F.when(n % 3 == 0, "new").otherwise("").alias("label"))
    own = t.projects.select("project_id", "domain")
    first = UP.latest_by_grain(asked.where(U.is_valid_domain(F.col("domain"))), ["project_id", "domain"], [F.asc("request_seq")])
    # A project cannot compete with itself.
    good = first.join(own, ["project_id", "domain"], "left_anti")
    existing = t.competitors.select("project_id", "domain", "label", "is_active")
    return UP.add_or_reactivate(existing, good, ["project_id", "domain"], ["label"])


@query("k15_deactivate", """
    SELECT tracked_keyword_id, project_id, is_active AND tracked_keyword_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error') AS is_active
    FROM {tracked_keywords}""")
def deactivate(t: Tables):
    ids = t.events.where(F.col("event_type") == "error").select(F.col("event_id").alias("tracked_keyword_id"))
    return UP.deactivate(t.tracked_keywords, ids, "tracked_keyword_id").select(
        "tracked_keyword_id", "project_id", "is_active")


@query("k16_select_property", """
    SELECT property_id, project_id % 10 AS project_id,
           CASE WHEN project_id % 10 < 5 THEN property_id = (project_id % 10) + 10 ELSE is_selected END AS is_selected
    FROM {gsc_properties}""")
def select_property(t: Tables):
    rows = t.gsc_properties.select("property_id", (F.col("project_id") % 10).alias("project_id"), "is_selected")
    choices = rows.where((F.col("project_id") < 5) & (F.col("property_id") == F.col("project_id") + 10))
    return UP.select_one(rows, choices.select("project_id", "property_id"), "project_id", "property_id")


@query("k17_change_status", """
    SELECT recommendation_id, CASE recommendation_id % 4 WHEN 0 THEN 'DISMISSED' WHEN 1 THEN status ELSE status END AS status FROM {recommendations}""")
def change_status(t: Tables):
    n = F.col("recommendation_id")
    rows = t.recommendations.select("recommendation_id", "status")
    changes = rows.where(n % 4 < 2).select(
        "recommendation_id", F.when(n % 4 == 0, "DISMISSED").otherwise("LATER").alias("new_status"))
    return UP.change_status(rows, changes, "recommendation_id")


@query("k18_export_state", """
    SELECT report_id, export_no, export_part, created_at + INTERVAL 7 DAY < TIMESTAMP '1998-06-01 00:00:00' AS is_expired, count(*) AS copies
    FROM {report_exports} GROUP BY ALL""")
def export_state(t: Tables):
    rows = usage.export_state(t.report_exports, F.lit("1998-06-01").cast("date"))
    return rows.groupBy("report_id", "export_no", "export_part", "is_expired").agg(F.count("*").alias("copies"))


@query("f26_slugs", """
    WITH b AS (SELECT organization_id, trim(substr(regexp_replace(lower(trim(name)), '[^a-z0-9]', '-', 'g'), 1, 60), '-') AS base FROM {signups}),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY organization_id) AS nth FROM b)
    SELECT organization_id, CASE WHEN nth = 1 THEN base ELSE base || '-' || CAST(nth AS VARCHAR) END AS slug FROM n""")
def slugs(t: Tables):
    return usage.slugs(t.signups).select("organization_id", "slug")
