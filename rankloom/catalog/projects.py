"""Project queries: Q28–Q31, A14–A16, J2, J14–J16."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.catalog.audits import ISSUES_CTE, SCORES_CTE, issues_of
from rankloom.catalog.gaps import GAP_CTE, parts
from rankloom.catalog.keywords import KEYWORDS_CTE, scored
from rankloom.catalog.ranks import MOVEMENT_CTE
from rankloom.catalog.registry import CHECKS, Tables, half_up, query
from rankloom.plans import audit, overview, rankings, usage
from rankloom.session import new_folder, stage
from rankloom.sinks.files import read_report, write_report


def as_of():
    """Reporting date; the events end on 2024-01-30."""
    return F.lit("2024-01-31").cast("date")



@query("q28_project_overview", f"""
    WITH {ISSUES_CTE},
    run AS (SELECT project_id, crawl_run_id AS run_id, status AS run_status FROM {{page_runs}}),
    sev AS (SELECT crawl_run_id, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'ERROR') AS error,
                   count(*) FILTER (WHERE severity = 'WARNING') AS warning, count(*) FILTER (WHERE severity = 'NOTICE') AS notice FROM issues GROUP BY crawl_run_id),
    job AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) AS rn FROM {{jobs}}) WHERE rn = 1)
    SELECT p.project_id, p.domain, run_id, run_status, coalesce(critical, 0) AS critical, coalesce(error, 0) AS error,
           coalesce(warning, 0) AS warning, coalesce(notice, 0) AS notice,
           (SELECT count(*) FROM {{tracked_keywords}} t WHERE t.project_id = p.project_id AND is_active) AS tracked_keywords,
           (SELECT count(*) FROM {{competitors}} c WHERE c.project_id = p.project_id AND is_active) AS competitors,
           (SELECT count(*) FROM {{recommendations}} r WHERE r.project_id = p.project_id AND status = 'OPEN') AS open_recommendations,
           EXISTS (SELECT 1 FROM {{gsc_properties}} g JOIN {{gsc_connections}} c ON c.connection_id = g.connection_id
                   WHERE g.project_id = p.project_id AND is_selected) AS gsc_connected,
           job_type AS latest_job_type, job.status AS latest_job_status
    FROM {{projects}} p LEFT JOIN run ON run.project_id = p.project_id LEFT JOIN sev ON sev.crawl_run_id = run_id
    LEFT JOIN job ON job.project_id = p.project_id""")
def project_overview(t: Tables):
    return overview.project_overview(t.projects, t.page_runs, issues_of(t), t.tracked_keywords, t.competitors,
                                     t.recommendations, t.gsc_properties, t.gsc_connections, t.jobs)


@query("j2_connected_properties", """
    SELECT property_id, project_id FROM {gsc_properties} WHERE is_selected AND connection_id IN (SELECT connection_id FROM {gsc_connections})""")
def connected(t: Tables):
    return overview.connected_projects(t.gsc_properties, t.gsc_connections).select("property_id", "project_id")


@query("q29_a14_usage_summary", """
    SELECT organization_id, provider, service, operation, CAST(sum(units) AS BIGINT) AS units, count(*) AS calls FROM {provider_usage}
    WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY organization_id, provider, service, operation""")
def usage_summary(t: Tables):
    return usage.usage_summary(t.provider_usage, as_of(), 7)


@query("a15_month_to_date", """
    SELECT organization_id, service, CAST(sum(units) AS BIGINT) AS units FROM {provider_usage}
    WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY organization_id, service""")
def month_to_date(t: Tables):
    return usage.month_to_date(t.provider_usage, as_of())


@query("q30_plan_usage", f"""
    WITH limits(plan, limit_name, allowed) AS (VALUES
        ('FREE', 'projects', 3), ('FREE', 'monthly_serp', 100), ('FREE', 'monthly_keywords', 100), ('FREE', 'monthly_exports', 10),
        ('PRO', 'projects', 25), ('PRO', 'monthly_serp', 5000), ('PRO', 'monthly_keywords', 5000), ('PRO', 'monthly_exports', 500),
        ('BUSINESS', 'projects', 200), ('BUSINESS', 'monthly_serp', 50000), ('BUSINESS', 'monthly_keywords', 50000), ('BUSINESS', 'monthly_exports', 5000)),
    orgs AS (SELECT organization_id, CASE WHEN plan = 'LEGACY' THEN 'FREE' ELSE plan END AS plan FROM {{organizations}}),
    used AS (SELECT organization_id, 'projects' AS limit_name, count(*) AS used FROM {{projects}} WHERE NOT is_deleted GROUP BY organization_id
             UNION ALL SELECT organization_id, 'monthly_' || service, CAST(sum(units) AS BIGINT) FROM {{provider_usage}}
             WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY organization_id, service)
    SELECT o.organization_id, o.plan, l.limit_name, allowed, coalesce(used, 0) AS used,
           {half_up('least(100.0e0, CAST(coalesce(used, 0) AS DOUBLE) / allowed * 100)', 1)} AS percent, coalesce(used, 0) >= allowed AS over_limit
    FROM orgs o JOIN limits l ON l.plan = o.plan LEFT JOIN used u ON u.organization_id = o.organization_id AND u.limit_name = l.limit_name""")
def plan_usage(t: Tables):
    return usage.plan_usage(t.organizations, t.projects, t.provider_usage, as_of())


@query("a16_tracked_limits", """
    SELECT p.project_id, (SELECT count(*) FROM {tracked_keywords} t WHERE t.project_id = p.project_id AND is_active) AS used,
           CASE plan WHEN 'PRO' THEN 500 WHEN 'BUSINESS' THEN 5000 ELSE 25 END AS allowed,
           (SELECT count(*) FROM {tracked_keywords} t WHERE t.project_id = p.project_id AND is_active) >= CASE plan WHEN 'PRO' THEN 500 WHEN 'BUSINESS' THEN 5000 ELSE 25 END AS over_limit
    FROM {projects} p JOIN {organizations} o ON o.organization_id = p.organization_id WHERE NOT p.is_deleted""")
def tracked_limits(t: Tables):
    return usage.tracked_limits(t.projects, t.organizations, t.tracked_keywords)


@query("j15_memberships", """
    SELECT m.user_id, m.organization_id, role, o.name FROM {memberships} m JOIN {organizations} o ON o.organization_id = m.organization_id
    JOIN {users} u ON u.user_id = m.user_id WHERE NOT o.is_deleted""")
def memberships(t: Tables):
    return usage.memberships(t.users, t.memberships, t.organizations)


@query("j16_scope", """
    SELECT tracked_keyword_id, t.project_id FROM {tracked_keywords} t
    WHERE (project_id, organization_id) IN (SELECT project_id, organization_id FROM {projects} WHERE NOT is_deleted)""")
def scope(t: Tables):
    return usage.scope(t.tracked_keywords, t.projects).select("tracked_keyword_id", "project_id")


@query("j14_reports_with_exports", """
    SELECT r.report_id, r.type, e.format, count(e.report_id) AS exports FROM {reports} r LEFT JOIN {report_exports} e ON e.report_id = r.report_id
    GROUP BY r.report_id, r.type, e.format""")
def reports_with_exports(t: Tables):
    rows = overview.reports_with_exports(t.reports.drop("created_at"), t.report_exports.drop("created_at"))
    return rows.groupBy("report_id", "type", "format").agg(F.count("export_no").alias("exports"))


@query("q31_report_project", """
    SELECT project_id, unnest(['name', 'domain', 'country', 'language', 'device']) AS field,
           unnest([name, domain, country, language, device]) AS value FROM {projects}""")
def report_project(t: Tables):
    return overview.section_project(t.projects)


@query("q31_report_audit_summary", f"""
    WITH {SCORES_CTE}
    SELECT r.project_id, {half_up('sum(score * weight)', 1)} AS health_score, max(pages_crawled) AS pages_crawled,
           (SELECT count(*) FROM issues i WHERE i.crawl_run_id = r.crawl_run_id) AS rules_firing
    FROM scores s JOIN {{page_runs}} r ON r.crawl_run_id = s.crawl_run_id GROUP BY r.project_id, r.crawl_run_id""")
def report_audit_summary(t: Tables):
    return overview.section_audit_summary(audit.audit_summary(stage(issues_of(t)), t.page_runs), t.page_runs)


@query("q31_report_audit_issues", f"""
    WITH {ISSUES_CTE} SELECT project_id, code AS rule, severity, category, affected_count AS affected
    FROM issues i JOIN {{page_runs}} r ON r.crawl_run_id = i.crawl_run_id""")
def report_audit_issues(t: Tables):
    return overview.section_audit_issues(issues_of(t), t.page_runs).drop("recommendation")


_REPORT_KEYWORDS = f"""
    WITH {KEYWORDS_CTE},
    c AS (SELECT s.* EXCLUDE (project_id), p.project_id FROM scored s JOIN {{projects}} p ON p.organization_id = s.organization_id WHERE s.project_id IS NULL
          UNION ALL SELECT s.* EXCLUDE (project_id), s.project_id FROM scored s WHERE s.project_id IS NOT NULL),
    top AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY opportunity DESC, keyword, keyword_id) AS rn FROM c)
    SELECT project_id, keyword, intent, search_volume AS volume, cpc, difficulty, opportunity, provider FROM top"""


@query("q31_every_report_keyword", _REPORT_KEYWORDS)
@query("q31_report_keywords", _REPORT_KEYWORDS)
def report_keywords(t: Tables):
    return overview.section_keywords(scored(t), t.projects)


@query("q31_first_500_report_keywords", f"{_REPORT_KEYWORDS} WHERE rn <= 500")
def first_report_keywords(t: Tables):
    return overview.section_keywords(scored(t), t.projects, n=500)


@query("q31_report_rankings", f"""
    WITH {MOVEMENT_CTE}
    SELECT project_id, keyword, current_rank AS current, previous_rank AS previous, previous_rank - current_rank AS change, best_rank AS best, worst_rank AS worst
    FROM {{tracked_keywords}} t LEFT JOIN m ON m.tracked_keyword_id = t.tracked_keyword_id WHERE is_active""")
def report_rankings(t: Tables):
    return overview.section_rankings(rankings.movement_list(t.tracked_keywords, t.rank_observations))


@query("q31_report_competitors", "SELECT project_id, domain, coalesce(label, '') AS label FROM {competitors} WHERE is_active")
def report_competitors(t: Tables):
    return overview.section_competitors(t.competitors)


@query("q31_report_gap", f"""
    WITH {GAP_CTE}
    SELECT project_id, keyword, your_rank, bucket, search_volume AS volume, difficulty, opportunity FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY opportunity DESC, keyword, tracked_keyword_id) AS rn FROM gap)""")
def report_gap(t: Tables):
    return overview.section_gap(parts(t)[0])


@query("q31_report_recommendations", """
    SELECT project_id, score, severity, type, source, title FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, title, source) AS rn FROM {recommendations} WHERE status = 'OPEN')""")
def report_recommendations(t: Tables):
    return overview.section_recommendations(t.recommendations)


def _builders(t: Tables) -> dict:
    """The section tables of every project, each built when its report asks for it."""
    return {
        "Project": lambda: report_project(t), "Audit summary": lambda: report_audit_summary(t),
        "Audit issues": lambda: overview.section_audit_issues(issues_of(t), t.page_runs), "Keywords": lambda: report_keywords(t),
        "Rankings": lambda: report_rankings(t), "Competitors": lambda: report_competitors(t), "Keyword gap": lambda: report_gap(t),
        "Recommendations": lambda: report_recommendations(t)}


def _written(t: Tables, kind: str) -> DataFrame:
    """A report type of every project, written as files and read back."""
    folder = new_folder(t.spark, "reports")
    write_report(overview.report(kind, _builders(t), t.projects), t.projects, folder)
    return read_report(t.spark, folder)


def _text(column: str) -> str:
    """SQL of one CSV field."""
    text = f"coalesce(CAST({column} AS VARCHAR), '')"
    return f"""CASE WHEN regexp_matches({text}, '[,"\\r\\n]') THEN '"' || replace({text}, '"', '""') || '"' ELSE {text} END"""


def _section_sql(place: int, title: str, query_name: str, columns: list[str], order: str, empty: str | None = None) -> str:
    """SQL of the lines of one section of every project, from the check of the section's own query."""
    fields = " || ',' || ".join(_text(c) for c in columns)
    none = f"""UNION ALL SELECT project_id, {place}, 2, 0, '{empty}' FROM all_projects WHERE project_id NOT IN (SELECT project_id FROM s{place})""" if empty else ""
    return f"""s{place} AS ({CHECKS[query_name]}),
    l{place} AS (SELECT project_id, {place} AS place, unnest([0, 1, 3]) AS kind, 0 AS n, unnest(['# {title}', '{",".join(columns)}', '']) AS line FROM all_projects
        UNION ALL SELECT project_id, {place}, 2, row_number() OVER (PARTITION BY project_id ORDER BY {order}), {fields} FROM s{place}
        WHERE project_id IN (SELECT project_id FROM all_projects) {none})"""


def _report_sql(*sections: str) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(len(sections)))
    return f"""WITH all_projects AS (SELECT CAST(n_nationkey AS BIGINT) AS project_id FROM nation), {", ".join(sections)}
    SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY place, kind, n) - 1 AS INTEGER) AS line_no, line FROM ({union})"""


_PROJECT_SECTION = _section_sql(0, "Project", "q31_report_project", ["field", "value"], "list_position(['name', 'domain', 'country', 'language', 'device'], field)")
_BEST = "coalesce(opportunity, 0) DESC"


@query("k10_rankings_report", _report_sql(_PROJECT_SECTION, _section_sql(
    1, "Rankings", "q31_report_rankings", ["keyword", "current", "previous", "change", "best", "worst"],
    ", ".join(f"{c} NULLS FIRST" for c in ("keyword", "current", "previous", "best", "worst")), "(no tracked keywords),,,,,")))
def rankings_report(t: Tables):
    return _written(t, "RANKINGS")


@query("k10_competitors_report", _report_sql(
    _PROJECT_SECTION,
    _section_sql(1, "Competitors", "q31_report_competitors", ["domain", "label"], "domain, label", "(none),"),
    _section_sql(2, "Keyword gap", "q31_report_gap", ["keyword", "your_rank", "bucket", "volume", "difficulty", "opportunity"],
                 f"{_BEST}, keyword, your_rank NULLS FIRST, bucket, volume NULLS FIRST, difficulty NULLS FIRST")))
def competitors_report(t: Tables):
    return _written(t, "COMPETITORS")


@query("k10_keywords_report", _report_sql(_PROJECT_SECTION, _section_sql(
    1, "Keywords", "q31_report_keywords", ["keyword", "intent", "volume", "cpc", "difficulty", "opportunity", "provider"],
    f"{_BEST}, " + ", ".join(f"{c} NULLS FIRST" for c in ("keyword", "intent", "volume", "cpc", "difficulty", "provider")))))
def keywords_report(t: Tables):
    return _written(t, "KEYWORDS")


# Its audit and recommendation parts have advice texts that no check repeats; tests compare their lines.
@query("k10_overview_report")
def overview_report(t: Tables):
    return _written(t, "SEO_OVERVIEW")
