"""Recommendations: five collectors with one shape, replacement and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import scores as S
from rankloom.functions.numbers import rounded
from rankloom.operators.ranking import numbered, top_n
from rankloom.operators.upsert import replace_open
from rankloom.plans import crawl, gsc, rankings
from rankloom.plans import keywords as KP

COLUMNS = ["project_id", "type", "source", "severity", "impact", "effort", "confidence", "score",
           "title", "description", "why", "recommended_action", "related_url", "related_keyword", "status"]

# Titles and descriptions below are part of the result; so are their numbers' formats.

#: Per source: why a finding matters, and what to do about it.
GUIDANCE = {
    "AUDIT": ("The last completed crawl found this problem on pages of the site.",
              "Open the issue, repair the listed pages and crawl the site again."),
    "GSC_CTR": ("The query is shown often near the first page, yet few searchers choose the result.",
                "Sharpen title and description, and answer the query early on the page."),
    "GSC_DROP": ("The query brings far fewer visits than in the period before.",
                 "Compare the page with those that now rank above it, then refresh it."),
    "KEYWORDS": ("The keyword has demand and is within reach, but is not tracked.",
                 "Plan a page for the keyword and start tracking it."),
    "RANK_TRACKING": ("The page has lost places since the last check.",
                      "Look for changes of the page and of the results, and strengthen its links."),
    "GAP": ("Competitors reach searchers here that the site misses.",
            "Create or extend a page that serves the query better than theirs."),
}


def _recommend(rows: DataFrame, kind: str, source: str, severity: Column, impact: Column,
               effort: Column, confidence: float, guidance: str, title: Column, description: Column,
               keyword: Column | None = None, url: Column | None = None) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return (rows.withColumn("_impact", impact.cast("double")).withColumn("_effort", effort.cast("double"))
            .select(
        "project_id", F.lit(kind).alias("type"), F.lit(source).alias("source"),
        severity.alias("severity"), F.col("_impact").alias("impact"),
        F.col("_effort").alias("effort"), F.lit(confidence).alias("confidence"),
        S.priority(F.col("_impact"), F.lit(confidence), F.col("_effort")).alias("score"),
        title.alias("title"), description.alias("description"),
        F.lit(GUIDANCE[guidance][0]).alias("why"), F.lit(GUIDANCE[guidance][1]).alias("recommended_action"),
        F.nullif(url if url is not None else nothing, F.lit("")).alias("related_url"),
        (keyword if keyword is not None else nothing).alias("related_keyword"),
        F.lit("OPEN").alias("status")))


def from_audit(issues: DataFrame, runs: DataFrame, n: int | None = None) -> DataFrame:
    """Issues of each project's latest completed run, or its ``n`` widest ones (Q19)."""
    run = crawl.latest_run(runs, completed_only=True).select("crawl_run_id", "project_id")
    widest = top_n(issues.join(run, "crawl_run_id"), ["project_id"],
                   [F.desc("affected_count"), F.asc("code")], n)
    severity = F.col("severity")
    return _recommend(
        widest, "TECHNICAL", "AUDIT", severity,
        S.lookup(severity, S.SEVERITY_IMPACT, 3.0),
        S.lookup(F.col("category"), S.CATEGORY_EFFORT, 2.0), 0.9, "AUDIT",
        F.col("message"), F.col("message"))


def _selected(properties: DataFrame) -> DataFrame:
    return properties.where("is_selected").select("property_id", "project_id")


def from_striking_distance(rows: DataFrame, properties: DataFrame, largest_of: int | None = None) -> DataFrame:
    """Queries near page one with many impressions but few clicks (Q20).

    With ``largest_of`` only the largest so many queries of a project are looked at, before the
    filter on clicks; without it every query that qualifies is listed.
    """
    near = gsc.striking_distance(rows).join(_selected(properties), "property_id")
    largest = top_n(near, ["project_id"], [F.desc("impressions"), F.asc("query"), F.asc("property_id")], largest_of)
    ctr = F.col("clicks") / F.col("impressions")
    few = largest.where(ctr < 0.05)
    return _recommend(
        few, "CONTENT", "GSC", F.lit("WARNING"), F.lit(7.0), F.lit(2.0), 0.75, "GSC_CTR",
        F.concat(F.lit("Striking-distance query needs CTR work: "), F.col("query")),
        F.concat(F.lit("Position "), rounded(F.col("position"), 1).cast("string"), F.lit(" with "),
                 S.thousands(F.col("impressions")), F.lit(" impressions but "),
                 F.format_number(rounded(ctr * 100, 1), 1), F.lit("% CTR.")),
        keyword=F.col("query"))


def from_decliners(rows: DataFrame, properties: DataFrame, as_of: Column, largest_of: int | None = None,
                   least_clicks: int = 50) -> DataFrame:
    """Queries that lost at least 30 % of their clicks (Q21), or those among the ``largest_of`` drops."""
    change = (gsc.click_change(rows, as_of).where(F.col("was_clicks") >= least_clicks)
              .join(_selected(properties), "property_id"))
    drop = F.col("was_clicks") - F.coalesce("now_clicks", F.lit(0))
    largest = top_n(change.withColumn("drop", drop), ["project_id"],
                    [F.desc("drop"), F.asc("query"), F.asc("property_id")], largest_of)
    fallen = largest.where(F.col("drop") / F.col("was_clicks") >= 0.3)
    return _recommend(
        fallen, "CONTENT", "GSC", F.lit("WARNING"), F.lit(6.0), F.lit(3.0), 0.65, "GSC_DROP",
        F.concat(F.lit("Declining query needs attention: "), F.col("query")),
        F.concat(F.lit("Clicks fell from "), S.thousands(F.col("was_clicks")), F.lit(" to "),
                 S.thousands(F.coalesce("now_clicks", F.lit(0))), F.lit(" in 28 days.")),
        keyword=F.col("query"))


def _shared_candidates(shared: DataFrame, tracked: DataFrame, projects: DataFrame,
                       n: int) -> DataFrame:
    """Shared keywords that can still be among a project's n best untracked ones.

    A project with t tracked keywords finds its n best within the first n + t of its
    organisation, so each project asks for just that many places: the output is linear in
    projects and tracked keywords, and no (keyword, project) product is formed.
    """
    ranked = numbered(shared, ["organization_id"], best_first(), "place")
    sizes = shared.groupBy("organization_id").agg(F.count("*").alias("_size"))
    held = tracked.groupBy("project_id").agg(F.count("*").alias("_held"))
    quota = (projects.where(~F.col("is_deleted")).select("organization_id", "project_id")
             .join(sizes, "organization_id").join(held, "project_id", "left")
             .withColumn("_quota", F.least(F.col("_size"), n + F.coalesce("_held", F.lit(0))))
             .select("organization_id", "project_id", "_quota",
                     F.explode(F.sequence(F.lit(0), F.floor((F.col("_quota") - 1) / 1000))).alias("_k")))
    first = (F.col("_k") * 1000 + 1).cast("int")
    last = F.least((F.col("_k") + 1) * 1000, F.col("_quota")).cast("int")
    places = quota.select("organization_id", "project_id", F.explode(F.sequence(first, last)).alias("place"))
    return ranked.join(places, ["organization_id", "place"]).drop("place")


def best_first() -> list[Column]:
    return [F.desc("opportunity"), F.asc("keyword"), F.asc("keyword_id")]


def from_keywords(scored: DataFrame, tracked: DataFrame, projects: DataFrame,
                  n: int | None = 10, least_opportunity: float = 40, least_volume: int = 500) -> DataFrame:
    """The ``n`` most valuable keywords a project does not track yet, all with ``n=None`` (Q22).

    Shared keywords (no project) are candidates for every project of their organisation.
    """
    good = scored.where((F.col("opportunity") >= least_opportunity) & (F.col("search_volume") >= least_volume)).select(
        "keyword_id", "organization_id", "project_id", "keyword", "normalized_keyword",
        "search_volume", "difficulty", "intent", "opportunity")
    owned = good.where(F.col("project_id").isNotNull())
    shared = good.where(F.col("project_id").isNull()).drop("project_id")
    if n is None:
        reached = projects.where(~F.col("is_deleted")).select("organization_id", "project_id")
        spread = shared.join(reached, "organization_id")
    else:
        spread = _shared_candidates(shared, tracked, projects, n)
    candidates = owned.unionByName(spread)
    best = top_n(KP.untracked(candidates, tracked), ["project_id"], best_first(), n)
    return _recommend(
        best, "CONTENT", "KEYWORDS", F.lit("NOTICE"), rounded(F.col("opportunity") / 10, 1),
        F.lit(3.0), 0.6, "KEYWORDS", F.concat(F.lit("Content opportunity: "), F.col("keyword")),
        F.concat(F.lit("Opportunity "), S.thousands(rounded(F.col("opportunity"), 0)), F.lit(", volume "),
                 S.thousands(F.col("search_volume")), F.lit(", difficulty "),
                 F.col("difficulty").cast("string"), F.lit(", intent "), F.col("intent"), F.lit(".")),
        keyword=F.col("keyword"))


def from_ranks(tracked: DataFrame, observations: DataFrame) -> DataFrame:
    """Active tracked keywords that slipped three places or more (Q23)."""
    slipped = rankings.movement_list(tracked, observations).where(F.col("change") <= -3)
    return _recommend(
        slipped, "RANKING", "RANK_TRACKING", F.lit("WARNING"), F.lit(6.5), F.lit(2.5), 0.7, "RANK_TRACKING",
        F.concat(F.lit("Ranking slipped for: "), F.col("keyword")),
        F.concat(F.lit("Now #"), F.col("current_rank").cast("string"), F.lit(" (was #"),
                 F.col("previous_rank").cast("string"), F.lit(").")),
        keyword=F.col("keyword"), url=F.col("current_url"))


def from_gap(gap: DataFrame, head: int | None = None, n: int | None = None, least: float = 50.0) -> DataFrame:
    """Missing or weak keywords worth ``least`` or more (Q24), or ``n`` of those among the first ``head`` gap rows."""
    order = [F.coalesce("opportunity", F.lit(0.0)).desc(), F.asc("keyword"), F.asc("tracked_keyword_id")]
    first_rows = top_n(gap, ["project_id"], order, head)
    open_rows = first_rows.where(F.col("bucket").isin("missing", "weak") & (F.col("opportunity") >= least))
    first = top_n(open_rows, ["project_id"], order, n)
    return _recommend(
        first, "COMPETITOR", "GAP", F.lit("NOTICE"), rounded(F.col("opportunity") / 10, 1),
        F.lit(3.0), 0.55, "GAP", F.concat(F.lit("Close the gap on: "), F.col("keyword")),
        F.concat(F.lit("Competitors rank #"),
                 F.coalesce("best_competitor_rank", F.lit(0)).cast("string"), F.lit(" while you are at #"),
                 F.coalesce(F.col("your_rank").cast("string"), F.lit("–")), F.lit(".")),
        keyword=F.col("keyword"))


def recalculate(existing: DataFrame, fresh: list[DataFrame]) -> DataFrame:
    """All collectors in one table in place of the old OPEN rows."""
    rows = fresh[0]
    for part in fresh[1:]:
        rows = rows.unionByName(part)
    return replace_open(existing, rows)


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id", "source").agg(F.count("*").alias("recommendations"))


def recommendation_list(rows: DataFrame, kind: str | None = None, source: str | None = None,
                        severity: str | None = None, status: str | None = None,
                        min_score: float | None = None) -> DataFrame:
    """Filtered action list with a severity rank to sort by (Q26)."""
    for name, value in {"type": kind, "source": source, "severity": severity, "status": status}.items():
        if value:
            rows = rows.where(F.col(name) == value.upper())
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    return rows.withColumn("severity_rank", S.severity_rank(F.col("severity")))


def list_order(sort: str = "score") -> list[Column]:
    first = {"score": [F.desc("score")], "recent": [F.desc("created_at")],
             "severity": [F.asc("severity_rank"), F.desc("score")]}[sort]
    return [*first, F.asc("project_id"), F.asc("title")]


def status_counts(rows: DataFrame) -> DataFrame:
    """Recommendations per project and status."""
    return rows.groupBy("project_id", "status").agg(F.count("*").alias("recommendations"))


def worklists(rows: DataFrame) -> DataFrame:
    """High-priority rows and quick wins, named in ``worklist`` (Q27)."""
    quick = (F.col("effort") <= 1.5) & (F.col("impact") >= 6) & (F.col("score") < 70)
    name = F.when(F.col("score") >= 70, "high_priority").when(quick, "quick_win")
    return rows.withColumn("worklist", name).where(F.col("worklist").isNotNull())
