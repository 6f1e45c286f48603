"""Project overview and report sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import SEVERITIES
from rankloom.operators.ranking import latest, top_n
from rankloom.plans import crawl
from rankloom.session import stage
from rankloom.sinks.files import Section


def connected_projects(properties: DataFrame, connections: DataFrame) -> DataFrame:
    """Selected properties whose connection exists."""
    return (properties.where("is_selected")
            .join(connections.select("connection_id"), "connection_id", "left_semi"))


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("project_id").agg(F.count("*").alias(name))


def project_overview(projects: DataFrame, runs: DataFrame, issues: DataFrame, tracked: DataFrame,
                     competitors: DataFrame, recommendations: DataFrame, properties: DataFrame,
                     connections: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of module state per project (Q28).

    Every module is aggregated to one row per project before it is joined.
    """
    run = crawl.latest_run(runs).select(
        "project_id", F.col("crawl_run_id").alias("run_id"), F.col("status").alias("run_status"))
    severities = [F.count(F.when(F.col("severity") == s, F.lit(1))).alias(s.lower()) for s in SEVERITIES]
    firing = issues.groupBy(F.col("crawl_run_id").alias("run_id")).agg(*severities)
    job = latest(jobs, ["project_id"], [F.desc("created_at"), F.desc("job_id")]).select(
        "project_id", F.col("job_type").alias("latest_job_type"), F.col("status").alias("latest_job_status"))
    linked = connected_projects(properties, connections).select("project_id").distinct().withColumn(
        "gsc_connected", F.lit(True))
    counts = {
        "tracked_keywords": tracked.where("is_active"),
        "competitors": competitors.where("is_active"),
        "open_recommendations": recommendations.where(F.col("status") == "OPEN"),
    }
    out = projects.select("project_id", "domain").join(run, "project_id", "left").join(firing, "run_id", "left")
    for name, rows in counts.items():
        out = out.join(_count(rows, name), "project_id", "left")
    zeros = [*counts, *[s.lower() for s in SEVERITIES]]
    return (out.join(linked, "project_id", "left").join(job, "project_id", "left")
            .withColumns({n: F.coalesce(n, F.lit(0)) for n in zeros})
            .withColumn("gsc_connected", F.coalesce("gsc_connected", F.lit(False))))


def top_opportunities(recommendations: DataFrame, n: int = 3) -> DataFrame:
    """Best open recommendations per project."""
    return top_n(recommendations.where(F.col("status") == "OPEN"), ["project_id"],
                 [F.desc("score"), F.asc("title"), F.asc("source")], n, "place")


def reports_with_exports(reports: DataFrame, exports: DataFrame) -> DataFrame:
    """Reports with their exports, one row per pair."""
    return reports.join(exports, "report_id", "left")


# Sections of each report type.
REPORT_SECTIONS = {
    "SEO_OVERVIEW": ["Project", "Audit summary", "Audit issues", "Keywords", "Rankings",
                     "Competitors", "Keyword gap", "Recommendations"],
    "AUDIT": ["Project", "Audit summary", "Audit issues"],
    "KEYWORDS": ["Project", "Keywords"],
    "RANKINGS": ["Project", "Rankings"],
    "COMPETITORS": ["Project", "Competitors", "Keyword gap"],
}


# The line of a section that has no rows.
EMPTY_SECTIONS = {
    "Rankings": ["(no tracked keywords)", "", "", "", "", ""],
    "Competitors": ["(none)", ""],
    "Recommendations": ["(none yet — run recalculate)", "", "", "", ""],
}


def section_order(title: str) -> list[Column]:
    """Order of a section's rows."""
    best = F.coalesce("opportunity", F.lit(0.0)).desc()
    return {
        "Project": [F.expr(f"array_position({PROJECT_FIELDS}, field)")],
        "Audit summary": [F.asc("health_score")],
        "Audit issues": [F.desc("affected"), F.asc("rule")],
        "Keywords": [best, *[F.asc(c) for c in ("keyword", "intent", "volume", "cpc", "difficulty", "provider")]],
        "Rankings": [F.asc(c) for c in ("keyword", "current", "previous", "best", "worst")],
        "Competitors": [F.asc("domain"), F.asc("label")],
        "Keyword gap": [best, *[F.asc(c) for c in ("keyword", "your_rank", "bucket", "volume", "difficulty")]],
        "Recommendations": [F.desc("score"), *[F.asc(c) for c in ("title", "source", "type", "severity")]],
    }[title]


def report(kind: str, builders: dict[str, Callable[[], DataFrame]], projects: DataFrame) -> dict[str, Section]:
    """The sections of a report type; only its own builders run (Q31).

    Projects without a completed audit have a section that says so instead of the audit's.
    """
    sections: dict[str, Section] = {}
    audited = None
    for title in REPORT_SECTIONS[kind]:
        rows = builders[title]()
        if title == "Audit summary":
            rows = stage(rows)
            audited = rows.select("project_id").distinct()
            none = projects.select("project_id").join(audited, "project_id", "left_anti")
            sections["Audit"] = Section(none.withColumn("info", F.lit("no completed audit")), [F.asc("info")], owners=none)
        own = audited if title.startswith("Audit") else None
        sections[title] = Section(rows, section_order(title), EMPTY_SECTIONS.get(title), own)
    return sections


PROJECT_FIELDS = "array('name', 'domain', 'country', 'language', 'device')"


def section_project(projects: DataFrame) -> DataFrame:
    fields = ["name", "domain", "country", "language", "device"]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return projects.select("project_id", F.explode(pairs).alias("p")).select("project_id", "p.*")


def section_audit_summary(summary: DataFrame, runs: DataFrame) -> DataFrame:
    run = crawl.latest_run(runs, completed_only=True).select("crawl_run_id", "project_id")
    return summary.join(run, "crawl_run_id").select(
        "project_id", "health_score", "pages_crawled", "rules_firing")


def section_audit_issues(issues: DataFrame, runs: DataFrame) -> DataFrame:
    run = crawl.latest_run(runs, completed_only=True).select("crawl_run_id", "project_id")
    return issues.join(run, "crawl_run_id").select(
        "project_id", F.col("code").alias("rule"), "severity", "category",
        F.col("affected_count").alias("affected"), F.col("advice").alias("recommendation"))


def section_keywords(scored: DataFrame, projects: DataFrame, n: int | None = None) -> DataFrame:
    """The keywords per project, shared ones of its organisation included, or the ``n`` best.

    With ``n``, only an organisation's best ``n`` shared keywords can make a project's list, so no
    more than those meet its projects.
    """
    order = [F.coalesce("opportunity", F.lit(0.0)).desc(), F.asc("keyword"), F.asc("keyword_id")]
    owned = scored.where(F.col("project_id").isNotNull())
    shared = top_n(scored.where(F.col("project_id").isNull()), ["organization_id"], order, n)
    spread = shared.drop("project_id").join(
        projects.select("project_id", "organization_id"), "organization_id")
    return top_n(owned.unionByName(spread.select(*owned.columns)), ["project_id"], order, n).select(
        "project_id", "keyword", "intent", F.col("search_volume").alias("volume"), "cpc",
        "difficulty", "opportunity", "provider")


def section_rankings(movements: DataFrame) -> DataFrame:
    return movements.select(
        "project_id", "keyword", F.col("current_rank").alias("current"),
        F.col("previous_rank").alias("previous"), "change", F.col("best_rank").alias("best"),
        F.col("worst_rank").alias("worst"))


def section_competitors(competitors: DataFrame) -> DataFrame:
    return competitors.where("is_active").select(
        "project_id", "domain", F.coalesce("label", F.lit("")).alias("label"))


def section_gap(gap: DataFrame, n: int | None = None) -> DataFrame:
    order = [F.coalesce("opportunity", F.lit(0.0)).desc(), F.asc("keyword"), F.asc("tracked_keyword_id")]
    return top_n(gap, ["project_id"], order, n).select(
        "project_id", "keyword", "your_rank", "bucket", F.col("search_volume").alias("volume"),
        "difficulty", "opportunity")


def section_recommendations(rows: DataFrame, n: int | None = None) -> DataFrame:
    listed = rows.where(F.col("status") == "OPEN") if n is None else top_opportunities(rows, n)
    return listed.select(
        "project_id", "score", "severity", "type", "source", "title")
