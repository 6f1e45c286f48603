"""Site-audit queries: R1–R26, A4–A8, J1, J9–J11, K6–K8, U1, L4, L5, L8, W2, W3, Q1–Q5."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.pages import TEXT_SQL, TITLE_SQL, UNESCAPE_SQL
from rankloom.catalog.registry import Tables, half_up, query
from rankloom.operators.ranking import page_of
from rankloom.operators.rules import rule_table, upsert_rules
from rankloom.plans import audit, crawl
from rankloom.session import stage
from rankloom.sinks.files import view_rows

CRAWLED_CTE = f"""
    crawled AS (
        SELECT *, status_code = 200 AND content_type = 'text/html' AND NOT is_robots_blocked AS parsed,
               regexp_extract(url, '^https?://[^/]*') AS origin FROM {{fetched_pages}}),
    pg AS (
        SELECT crawl_run_id, page_id, url, depth, status_code, error, response_time_ms, redirect_target, is_robots_blocked,
               CASE WHEN parsed THEN {TITLE_SQL} END AS title,
               CASE WHEN parsed AND page_id % 4 <> 0 THEN 'About page ' || CAST(page_id % 40 AS VARCHAR) || ' & more' || CASE WHEN page_id % 40 >= 33 THEN repeat(' and further things', 9) ELSE '' END END AS meta_description,
               CASE WHEN NOT parsed OR page_id % 11 = 0 THEN NULL WHEN page_id % 11 = 1 THEN origin || '/gone' ELSE url END AS canonical,
               CASE WHEN parsed THEN len(regexp_extract_all(html, '<h1')) ELSE 0 END AS h1_count,
               CASE WHEN parsed THEN len(string_split({TEXT_SQL}, ' ')) ELSE 0 END AS word_count,
               CASE WHEN parsed THEN sha256(lower({TEXT_SQL})) END AS content_hash,
               parsed AND page_id % 19 = 3 AS is_noindex, parsed AND page_id % 4 > 0 AS missing_alt,
               parsed AND page_id % 3 = 0 AS has_schema, parsed AND page_id % 10 = 0 AS bad_language,
               CASE WHEN is_robots_blocked THEN 'ROBOTS_BLOCKED' WHEN error IS NOT NULL AND status_code = 0 THEN 'FETCH_ERROR'
                    WHEN redirect_target IS NOT NULL AND status_code = 301 THEN 'REDIRECTED' WHEN status_code >= 400 THEN 'BROKEN'
                    WHEN parsed AND page_id % 19 = 3 THEN 'NOINDEX' WHEN parsed THEN 'INDEXABLE' ELSE 'UNKNOWN' END AS indexability
        FROM crawled)"""


def _rule(code: str, where: str) -> str:
    return f"SELECT crawl_run_id, url, '{code}' AS code FROM pg WHERE {where}"


def _duplicate(code: str, column: str) -> str:
    return (f"SELECT crawl_run_id, url, '{code}' FROM (SELECT *, count(*) OVER (PARTITION BY crawl_run_id, lower(trim({column}))) AS n "
            f"FROM pg WHERE status_code = 200 AND trim({column}) <> '') WHERE n > 1")


_OK = "status_code = 200"
_INDEXABLE = f"{_OK} AND NOT is_noindex AND NOT is_robots_blocked"
HITS_CTE = f"""{CRAWLED_CTE},
    hits AS (
        {" UNION ".join([
            _rule("SITE_DOWN", "depth = 0 AND status_code >= 500"), _rule("BROKEN_PAGE", "status_code >= 400"),
            _rule("TITLE_MISSING", f"{_OK} AND title IS NULL"), _rule("TITLE_TOO_LONG", f"{_OK} AND length(title) > 60"),
            _rule("TITLE_TOO_SHORT", f"{_OK} AND length(title) BETWEEN 1 AND 29"), _duplicate("DUPLICATE_TITLE", "title"),
            _rule("META_DESCRIPTION_MISSING", f"{_OK} AND meta_description IS NULL"),
            _rule("META_DESCRIPTION_TOO_LONG", f"{_OK} AND length(meta_description) > 160"),
            _duplicate("DUPLICATE_META_DESCRIPTION", "meta_description"), _rule("H1_MISSING", f"{_OK} AND h1_count = 0"),
            _rule("MULTIPLE_H1", f"{_OK} AND h1_count > 1"), _rule("THIN_CONTENT", f"{_INDEXABLE} AND word_count < 300"),
            _duplicate("DUPLICATE_CONTENT", "content_hash"),
            _rule("ORPHAN_PAGE", f"{_OK} AND depth > 0 AND (crawl_run_id, url) NOT IN (SELECT crawl_run_id, normalized_to_url FROM {{links}} WHERE is_internal)"),
            _rule("BROKEN_INTERNAL_LINK", f"{_OK} AND (crawl_run_id, url) IN (SELECT l.crawl_run_id, from_url FROM {{links}} l JOIN pg b "
                  "ON b.crawl_run_id = l.crawl_run_id AND b.url = normalized_to_url AND b.status_code >= 400)"),
            _rule("REDIRECT_CHAIN", "(crawl_run_id, redirect_target) IN (SELECT crawl_run_id, url FROM pg WHERE redirect_target IS NOT NULL)"),
            _rule("REDIRECT_LOOP", "redirect_target = url OR (crawl_run_id, redirect_target, url) IN (SELECT crawl_run_id, url, redirect_target FROM pg)"),
            _rule("CANONICAL_MISSING", f"{_INDEXABLE} AND canonical IS NULL"),
            _rule("CANONICAL_CONFLICT", f"{_OK} AND canonical IS NOT NULL AND (crawl_run_id, canonical) NOT IN (SELECT crawl_run_id, url FROM pg WHERE {_OK})"),
            _rule("NOINDEX_PAGE", "is_noindex"), _rule("ROBOTS_BLOCKED", "is_robots_blocked"),
            _rule("MISSING_IMAGE_ALT", f"{_OK} AND missing_alt"), _rule("HTTP_PAGE", "url LIKE 'http://%'"),
            _rule("SLOW_PAGE", "response_time_ms > 2000"), _rule("MISSING_STRUCTURED_DATA", f"{_INDEXABLE} AND NOT has_schema"),
            _rule("INVALID_HREFLANG", f"{_OK} AND bad_language")])})"""


# Fixed values, also in operators.rules: code, name, severity, category of each rule.
RULE_FACTS = [
    ("SITE_DOWN", "Homepage unreachable", "CRITICAL", "Crawlability"),
    ("BROKEN_PAGE", "Broken page (4xx/5xx)", "ERROR", "Crawlability"),
    ("TITLE_MISSING", "Missing title tag", "ERROR", "Metadata"),
    ("TITLE_TOO_LONG", "Title too long (>60 chars)", "WARNING", "Metadata"),
    ("TITLE_TOO_SHORT", "Title too short (<30 chars)", "WARNING", "Metadata"),
    ("DUPLICATE_TITLE", "Duplicate title tag", "ERROR", "Metadata"),
    ("META_DESCRIPTION_MISSING", "Missing meta description", "ERROR", "Metadata"),
    ("META_DESCRIPTION_TOO_LONG", "Meta description too long (>160 chars)", "WARNING", "Metadata"),
    ("DUPLICATE_META_DESCRIPTION", "Duplicate meta description", "ERROR", "Metadata"),
    ("H1_MISSING", "Missing H1", "ERROR", "Content"),
    ("MULTIPLE_H1", "Multiple H1 tags", "WARNING", "Content"),
    ("THIN_CONTENT", "Thin content (<300 words)", "WARNING", "Content"),
    ("DUPLICATE_CONTENT", "Duplicate content", "ERROR", "Content"),
    ("ORPHAN_PAGE", "Orphan page (no internal inbound links)", "WARNING", "Links"),
    ("BROKEN_INTERNAL_LINK", "Page links to a broken internal URL", "ERROR", "Links"),
    ("REDIRECT_CHAIN", "Redirect chain", "WARNING", "Redirects"),
    ("REDIRECT_LOOP", "Redirect loop", "ERROR", "Redirects"),
    ("CANONICAL_MISSING", "Missing canonical on indexable page", "WARNING", "Canonical"),
    ("CANONICAL_CONFLICT", "Canonical points to uncrawled/broken URL", "ERROR", "Canonical"),
    ("NOINDEX_PAGE", "Noindex page discovered", "WARNING", "Indexability"),
    ("ROBOTS_BLOCKED", "URL blocked by robots.txt", "WARNING", "Crawlability"),
    ("MISSING_IMAGE_ALT", "Images missing alt text", "WARNING", "Images"),
    ("HTTP_PAGE", "Page served over HTTP", "ERROR", "HTTPS"),
    ("SLOW_PAGE", "Slow page (>2s server response)", "WARNING", "Performance"),
    ("MISSING_STRUCTURED_DATA", "No structured data on indexable page", "NOTICE", "Structured Data"),
    ("INVALID_HREFLANG", "Invalid hreflang value", "WARNING", "International"),
]


def rules_cte() -> str:
    """The catalogue as VALUES."""
    rows = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}')" for r in RULE_FACTS)
    return f"rules(code, name, severity, category) AS (VALUES {rows})"


# Fixed values, also in functions.scores: the bucket of each category, and the weight of each bucket.
_BUCKET_CASE = """CASE category WHEN 'Crawlability' THEN 'crawlability' WHEN 'Redirects' THEN 'crawlability' WHEN 'Indexability' THEN 'indexability'
    WHEN 'Canonical' THEN 'indexability' WHEN 'International' THEN 'indexability' WHEN 'HTTPS' THEN 'technical' WHEN 'Structured Data' THEN 'technical'
    WHEN 'Metadata' THEN 'metadata' WHEN 'Content' THEN 'content' WHEN 'Links' THEN 'links' WHEN 'Images' THEN 'links' WHEN 'Performance' THEN 'performance' END"""
_BUCKETS = ("crawlability", "indexability", "technical", "metadata", "content", "links", "performance")
_WEIGHTS = """('crawlability', 0.15e0), ('indexability', 0.15e0), ('technical', 0.20e0), ('metadata', 0.15e0),
    ('content', 0.15e0), ('links', 0.10e0), ('performance', 0.10e0)"""
ISSUES_CTE = f"""{HITS_CTE}, {rules_cte()},
    issues AS (SELECT h.crawl_run_id, r.*, affected_count, r.name || ' — ' || CAST(affected_count AS VARCHAR) || ' page(s) affected' AS message
               FROM (SELECT crawl_run_id, code, count(*) AS affected_count FROM hits GROUP BY crawl_run_id, code) h JOIN rules r ON r.code = h.code)"""
SCORES_CTE = f"""{ISSUES_CTE},
    buckets(bucket, weight) AS (VALUES {_WEIGHTS}),
    lost AS (SELECT i.crawl_run_id, {_BUCKET_CASE} AS bucket,
                    sum(CASE severity WHEN 'CRITICAL' THEN 60.0e0 WHEN 'ERROR' THEN 25.0e0 WHEN 'WARNING' THEN 10.0e0 ELSE 3.0e0 END
                        * least(1.0e0, CAST(affected_count AS DOUBLE) / greatest(1, pages_crawled))) AS deduction
             FROM issues i JOIN {{page_runs}} r ON r.crawl_run_id = i.crawl_run_id GROUP BY i.crawl_run_id, {_BUCKET_CASE}),
    scores AS (SELECT r.crawl_run_id, b.bucket, weight, {half_up('greatest(0.0e0, 100.0e0 - coalesce(deduction, 0.0e0))', 1)} AS score
               FROM {{page_runs}} r CROSS JOIN buckets b LEFT JOIN lost l ON l.crawl_run_id = r.crawl_run_id AND l.bucket = b.bucket)"""


def stored_pages(t: Tables):
    """The crawl_pages table: parsed once, written to the shared folder, read by every rule."""
    return stage(crawl.crawl_pages(t.fetched_pages))


def hits_of(t: Tables):
    return audit.rule_hits(stored_pages(t), t.links)


def issues_of(t: Tables):
    return audit.issues(hits_of(t), rule_table(t.spark))


@query("s2_f17_crawl_pages", f"""
    WITH {CRAWLED_CTE}
    SELECT page_id, url, title, meta_description, canonical, CAST(h1_count AS INTEGER) AS h1_count, CAST(word_count AS INTEGER) AS word_count,
           content_hash, is_noindex, indexability FROM pg""")
def crawl_pages(t: Tables):
    return crawl.crawl_pages(t.fetched_pages).select(
        "page_id", "url", "title", "meta_description", "canonical", "h1_count", "word_count", "content_hash",
        "is_noindex", "indexability")


@query("r1_r26_u1_rule_hits", f"WITH {HITS_CTE} SELECT * FROM hits")
def rule_hits(t: Tables):
    return hits_of(t)


@query("j1_a8_issues", f"WITH {ISSUES_CTE} SELECT * FROM issues")
def issues(t: Tables):
    return issues_of(t).drop("advice", "enabled")


@query("k8_every_instance", f"WITH {HITS_CTE} SELECT crawl_run_id, code, url FROM hits")
@query("k8_q4_instances", f"WITH {HITS_CTE} SELECT crawl_run_id, code, url FROM hits")
def instances(t: Tables):
    return audit.instances(hits_of(t))


# The listing of the first 500 of an issue.
@query("k8_first_500_instances", f"""
    WITH {HITS_CTE} SELECT crawl_run_id, code, url FROM (
        SELECT *, row_number() OVER (PARTITION BY crawl_run_id, code ORDER BY url) AS rn FROM hits) WHERE rn <= 500""")
def first_instances(t: Tables):
    return audit.instances(hits_of(t), 500)


@query("a6_bucket_scores", f"WITH {SCORES_CTE} SELECT crawl_run_id, bucket, score FROM scores")
def bucket_scores(t: Tables):
    return audit.bucket_scores(issues_of(t), t.page_runs)


@query("a7_health_score", f"""
    WITH {SCORES_CTE} SELECT crawl_run_id, {half_up('sum(score * weight)', 1)} AS health_score FROM scores GROUP BY crawl_run_id""")
def health_score(t: Tables):
    return audit.health(audit.bucket_scores(issues_of(t), t.page_runs))


_SUMMARY = f"""
    WITH {SCORES_CTE},
    sev AS (SELECT crawl_run_id, {", ".join(f"count(*) FILTER (WHERE severity = '{s.upper()}') AS {s}" for s in ("critical", "error", "warning", "notice"))},
                   count(*) AS rules_firing, CAST(sum(affected_count) AS BIGINT) AS issues_found FROM issues GROUP BY crawl_run_id),
    wide AS (SELECT crawl_run_id, {", ".join(f"max(score) FILTER (WHERE bucket = '{b}') AS {b}" for b in _BUCKETS)},
                    {half_up('sum(score * weight)', 1)} AS health_score FROM scores GROUP BY crawl_run_id)
    SELECT r.crawl_run_id, pages_crawled, critical, error, warning, notice, rules_firing, issues_found, {", ".join(_BUCKETS)}, health_score
    FROM {{page_runs}} r JOIN sev ON sev.crawl_run_id = r.crawl_run_id JOIN wide ON wide.crawl_run_id = r.crawl_run_id"""


@query("q1_site_audit", _SUMMARY)
def site_audit(t: Tables):
    return audit.audit_summary(stage(issues_of(t)), t.page_runs)


@query("q2_audit_summary", f"""
    WITH {ISSUES_CTE}
    SELECT r.crawl_run_id, pages_crawled, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'ERROR') AS error,
           count(*) FILTER (WHERE severity = 'WARNING') AS warning, count(*) FILTER (WHERE severity = 'NOTICE') AS notice,
           count(i.code) AS rules_firing, CAST(coalesce(sum(affected_count), 0) AS BIGINT) AS issues_found
    FROM {{page_runs}} r LEFT JOIN issues i ON i.crawl_run_id = r.crawl_run_id GROUP BY r.crawl_run_id, pages_crawled""")
def audit_summary(t: Tables):
    return audit.severity_counts(issues_of(t), t.page_runs)


@query("q3_issue_explorer", f"""
    WITH {ISSUES_CTE}
    SELECT crawl_run_id, code, severity, message, affected_count FROM issues
    WHERE severity = 'ERROR' AND category = 'Metadata' AND (message ILIKE '%dup%' OR name ILIKE '%dup%' OR code ILIKE '%dup%')""")
def issue_explorer(t: Tables):
    rows = audit.issue_list(issues_of(t), severity="error", category="Metadata", search="dup")
    return rows.select("crawl_run_id", "code", "severity", "message", "affected_count")


@query("l4_issue_page", f"""
    WITH {ISSUES_CTE}
    SELECT crawl_run_id, code, severity, affected_count FROM issues
    ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'NOTICE' THEN 3 ELSE 9 END,
             affected_count DESC, crawl_run_id, code LIMIT 20""")
def issue_page(t: Tables):
    rows = page_of(audit.issue_list(issues_of(t)), audit.issue_order("severity"), size=20)
    return rows.select("crawl_run_id", "code", "severity", "affected_count")


@query("l4_recent_issues", f"""
    WITH {ISSUES_CTE}, d AS (SELECT i.*, project_id, created_at FROM issues i JOIN {{page_runs}} r ON r.crawl_run_id = i.crawl_run_id)
    SELECT crawl_run_id, code, min(created_at) OVER p AS first_seen, max(created_at) OVER p AS last_seen FROM d
    WINDOW p AS (PARTITION BY project_id, code) ORDER BY last_seen DESC, crawl_run_id, code LIMIT 20""")
def recent_issues(t: Tables):
    rows = audit.seen(issues_of(t), t.page_runs)
    return page_of(audit.issue_list(rows), audit.issue_order("recent"), size=20).select("crawl_run_id", "code", "first_seen", "last_seen")


@query("q5_page_explorer", f"""
    WITH {CRAWLED_CTE}
    SELECT page_id, url, status_code, title, indexability, depth FROM pg
    WHERE status_code = 200 AND indexability = 'INDEXABLE' AND (url ILIKE '%an%' OR title ILIKE '%an%' OR meta_description ILIKE '%an%')""")
def page_explorer(t: Tables):
    rows = audit.page_list(crawl.crawl_pages(t.fetched_pages), status_code=200, indexability="INDEXABLE", search="an")
    return rows.select("page_id", "url", "status_code", "title", "indexability", "depth")


@query("l5_page_page", "SELECT page_id, url, depth FROM {fetched_pages} ORDER BY depth, page_id LIMIT 20")
def page_page(t: Tables):
    return page_of(t.fetched_pages.select("page_id", "url", "depth"), audit.page_order(), size=20)


# A stored rule is switched off where its share of the orders holds an odd number of urgent ones.
@query("k7_rule_upsert", f"""
    WITH {rules_cte()}, numbered AS (SELECT *, row_number() OVER (ORDER BY code) - 1 AS nth FROM rules),
    off AS (SELECT o_orderkey % 26 AS nth, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') % 2 = 1 AS is_off FROM orders GROUP BY o_orderkey % 26)
    SELECT code, name, severity, category, code = 'SITE_DOWN' OR NOT coalesce(is_off, FALSE) AS enabled
    FROM numbered LEFT JOIN off ON off.nth = numbered.nth""")
def rule_upsert(t: Tables):
    fresh = rule_table(t.spark)
    urgent = F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1))
    switched = t.orders.groupBy((F.col("o_orderkey") % 26).cast("int").alias("nth")).agg((urgent % 2 == 0).alias("_on"))
    place = F.expr("row_number() OVER (ORDER BY code) - 1").cast("int")  # the 26 rules
    old = (fresh.withColumn("nth", place).join(switched, "nth", "left").where(F.col("code") != "SITE_DOWN")
           .withColumn("enabled", F.coalesce("_on", F.lit(True))).select(*fresh.columns))
    return upsert_rules(old, fresh).select("code", "name", "severity", "category", "enabled")


@query("w2_w3_latest_runs", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, crawl_run_id DESC) AS any_rn,
                      row_number() OVER (PARTITION BY project_id, status ORDER BY created_at DESC, crawl_run_id DESC) AS status_rn FROM {crawl_runs})
    SELECT project_id, crawl_run_id, 'any' AS kind FROM r WHERE any_rn = 1
    UNION ALL SELECT project_id, crawl_run_id, 'completed' FROM r WHERE status = 'COMPLETED' AND status_rn = 1""")
def latest_runs(t: Tables):
    newest = crawl.latest_run(t.crawl_runs).withColumn("kind", F.lit("any"))
    done = crawl.latest_run(t.crawl_runs, completed_only=True).withColumn("kind", F.lit("completed"))
    return newest.unionByName(done).select("project_id", "crawl_run_id", "kind")


@query("l8_newest_runs", """
    SELECT crawl_run_id, project_id, status FROM {crawl_runs} ORDER BY created_at DESC, crawl_run_id DESC LIMIT 20 OFFSET 20""")
def newest_runs(t: Tables):
    return page_of(t.crawl_runs, crawl.newest_runs_order(), page=2, size=20).select("crawl_run_id", "project_id", "status")


@query("k12_issue_export", f"""
    WITH {ISSUES_CTE} SELECT severity, code AS rule, name, message, affected_count AS urls, count(*) AS copies FROM issues GROUP BY ALL""")
def issue_export(t: Tables):
    rows = view_rows(issues_of(t), "issues").drop("recommendation")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


@query("k12_page_export", f"""
    WITH {CRAWLED_CTE}
    SELECT p.url, p.status_code, indexability, title,
           CASE WHEN NOT parsed THEN NULL WHEN p.page_id % 6 < 2 THEN 'Second head ing' ELSE
                trim({UNESCAPE_SQL.format("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")}) END AS h1,
           CAST(word_count AS INTEGER) AS words, p.response_time_ms AS latency_ms
    FROM pg p JOIN crawled c ON c.page_id = p.page_id""")
def page_export(t: Tables):
    return view_rows(audit.page_list(crawl.crawl_pages(t.fetched_pages)), "pages")
