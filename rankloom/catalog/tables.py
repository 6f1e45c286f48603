"""The given tables, and the domain tables derived from them.

Each derived table is one SQL statement that both Spark and DuckDB run, so a query and its
check start from the same rows.  ``{name}`` stands for a given or another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Declared schemas: no inference, and the scan reads just the named columns.
GIVEN = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
              "props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
}

DERIVED = {
    "organizations": """
        SELECT CAST(r_regionkey AS BIGINT) AS organization_id, r_name AS name,
               CASE r_regionkey % 4 WHEN 0 THEN 'FREE' WHEN 1 THEN 'PRO' WHEN 2 THEN 'BUSINESS'
                    ELSE 'LEGACY' END AS plan, r_regionkey = 4 AS is_deleted
        FROM {region}""",
    "projects": """
        SELECT CAST(n_nationkey AS BIGINT) AS project_id,
               CAST(n_nationkey % 5 AS BIGINT) AS organization_id, n_name AS name,
               concat('s', CAST(n_nationkey AS STRING), '.com') AS domain,
               CASE WHEN n_nationkey % 3 = 0 THEN 'GB' ELSE 'US' END AS country,
               'en' AS language, 'DESKTOP' AS device, n_nationkey % 13 = 12 AS is_deleted,
               concat('["https://www.S', CAST(n_nationkey + 25 AS STRING), '.com/about", "s',
                      CAST(n_nationkey + 25 AS STRING), '.com", "rival', CAST(n_nationkey AS STRING),
                      '.example.org:8080", "not a domain", " "]') AS competitors
        FROM {nation}""",
    "competitors": """
        SELECT CAST(s_suppkey AS BIGINT) AS competitor_id,
               CAST(s_suppkey % 25 AS BIGINT) AS project_id,
               concat('s', CAST(s_suppkey AS STRING), '.com') AS domain,
               CASE s_suppkey % 4 WHEN 0 THEN 'brand' WHEN 1 THEN 'rival' WHEN 2 THEN 'shop' END AS label,
               s_suppkey % 10 <> 9 AS is_active
        FROM {supplier} WHERE s_suppkey >= 25""",
    "memberships": """
        SELECT c_custkey AS user_id, CAST(c_custkey % 5 AS BIGINT) AS organization_id,
               CASE WHEN c_custkey % 7 = 0 THEN 'OWNER' ELSE 'MEMBER' END AS role
        FROM {customer}""",
    "users": "SELECT c_custkey AS user_id, c_name AS display_name FROM {customer}",
    "signups": """
        SELECT c_custkey AS organization_id,
               concat(' ', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN ' & Co. ' ELSE '' END) AS name
        FROM {customer}""",
    "fetched_pages": """
        SELECT 1 + page_id % 3 AS crawl_run_id, page_id,
               concat(CASE WHEN page_id % 17 = 2 THEN 'http' ELSE 'https' END, '://site',
                      CAST(page_id % 3 AS STRING), '.example.com/p', CAST(page_id AS STRING)) AS url,
               concat(CASE WHEN page_id % 17 = 2 THEN 'http' ELSE 'https' END, '://site',
                      CAST(page_id % 3 AS STRING), '.example.com/p', CAST(page_id AS STRING)) AS normalized_url,
               replace(replace(CASE WHEN page_id % 12 = 2
                   THEN '<html lang="en"><head><title>The same page again</title></head><body><h1>Same</h1><p>the same words</p></body></html>'
                   WHEN page_id % 9 = 4 THEN replace(html, '</title>', concat(repeat(' and a longer title', 4), '</title>')) ELSE html END,
                   '<head>', concat('<head>',
                   CASE WHEN page_id % 4 <> 0 THEN concat('<meta name="description" content=" About page ',
                        CAST(page_id % 40 AS STRING), ' &amp; more', CASE WHEN page_id % 40 >= 33 THEN repeat(' and further things', 9) ELSE '' END, ' ">') ELSE '' END,
                   CASE WHEN page_id % 19 = 3 THEN '<META name="robots" content=NOINDEX,nofollow>' ELSE '' END,
                   CASE page_id % 11 WHEN 0 THEN '' WHEN 1 THEN '<link rel="canonical" href="/gone">'
                        ELSE concat('<link href=" /p', CAST(page_id AS STRING), '" rel="canonical"/>') END,
                   concat('<meta property="og:title" content="OG ', CAST(page_id AS STRING), '"><meta name="twitter:card" content="summary">'),
                   CASE WHEN page_id % 5 = 0 THEN '<link rel="alternate" hreflang="EN" href="/en">' ELSE '' END,
                   CASE WHEN page_id % 10 = 0 THEN '<link rel="alternate" hreflang="english" href="/x">' ELSE '' END,
                   CASE WHEN page_id % 3 = 0 THEN concat('<script type="application/ld+json">', chr(123), '"@type":"Person","a":',
                        chr(123), '"@type" : "Article"', chr(125), chr(125), '</script>') ELSE '' END)),
                   '<body>', concat('<body>', CASE WHEN page_id % 6 < 2 THEN '<h1>Second <i>head</i>ing</h1>' ELSE '' END,
                   '<img src="/a.png" alt="ok">', CASE WHEN page_id % 4 > 0 THEN '<img src=/b.png alt=" ">' ELSE '' END,
                   '<a href="https://other.example.org/x?utm_source=y" rel="nofollow">o</a><a href="mailto:a@b.c">m</a><a href="#top">t</a>',
                   '<a href="../up/./d?x=1#f">u</a><a href="//WWW.site', CAST(page_id % 3 AS STRING), '.example.com/w">w</a>')) AS html,
               CASE WHEN page_id < 3 THEN 0 ELSE CAST(1 + page_id % 4 AS INT) END AS depth,
               CASE WHEN page_id = 1 THEN 503 WHEN page_id % 23 = 5 THEN 404
                    WHEN page_id % 23 = 11 THEN 503 WHEN page_id % 23 = 17 THEN 301
                    WHEN page_id % 41 = 9 THEN 0 ELSE 200 END AS status_code,
               CASE WHEN page_id % 41 = 9 THEN 'network error: reset' END AS error,
               CASE WHEN page_id % 31 = 4 THEN 'application/pdf' ELSE 'text/html' END AS content_type,
               CAST(100 + (page_id * 137) % 3000 AS INT) AS response_time_ms,
               CASE WHEN page_id % 46 = 17 THEN concat('https://site', CAST(page_id % 3 AS STRING),
                         '.example.com/p', CAST(page_id + 69 AS STRING))
                    WHEN page_id % 46 = 40 THEN concat('https://site', CAST(page_id % 3 AS STRING),
                         '.example.com/p', CAST(page_id - 69 AS STRING)) END AS redirect_target,
               page_id % 29 = 7 AS is_robots_blocked
        FROM {pages}""",
    "links": """
        SELECT 1 + a.page_id % 3 AS crawl_run_id,
               concat(CASE WHEN a.page_id % 17 = 2 THEN 'http' ELSE 'https' END, '://site',
                      CAST(a.page_id % 3 AS STRING), '.example.com/p', CAST(a.page_id AS STRING)) AS from_url,
               concat(CASE WHEN b.page_id % 17 = 2 THEN 'http' ELSE 'https' END, '://site',
                      CAST(b.page_id % 3 AS STRING), '.example.com/p', CAST(b.page_id AS STRING)) AS normalized_to_url,
               TRUE AS is_internal
        FROM (SELECT page_id, page_id + 3 AS target FROM {pages}
              UNION SELECT page_id, page_id * 4 + 3 FROM {pages} WHERE page_id % 3 = 1
              UNION SELECT page_id, page_id * 4 + 6 FROM {pages} WHERE page_id % 3 <> 1
              UNION SELECT page_id, page_id + 21 FROM {pages}
              UNION SELECT page_id, page_id % 3 FROM {pages}) a
        JOIN {pages} b ON b.page_id = a.target AND b.page_id % 3 = a.page_id % 3
        WHERE b.page_id % 13 <> 4""",
    "page_runs": """
        SELECT 1 + page_id % 3 AS crawl_run_id, page_id % 3 AS project_id, 'COMPLETED' AS status,
               count(*) AS pages_crawled, max(DATE '2024-01-31') AS created_at
        FROM {pages} GROUP BY 1 + page_id % 3, page_id % 3""",
    "crawl_runs": """
        SELECT o_orderkey AS crawl_run_id, o_custkey % 25 AS project_id,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
               o_orderdate AS created_at, CAST(o_orderkey % 101 AS INT) AS pages_crawled
        FROM {orders}""",
    "fetch_log": """
        SELECT user_id % 20 AS crawl_run_id, event_id, ts AS fetched_at,
               CASE WHEN event_type = 'error' THEN 'timeout: read' END AS error,
               CASE WHEN event_type = 'error' THEN 0 WHEN event_id % 11 = 3 THEN 404
                    WHEN event_id % 37 = 5 THEN 503 ELSE 200 END AS status_code,
               event_id % 29 = 7 AS is_robots_blocked
        FROM {events}""",
    "gsc_rows": """
        SELECT user_id % 3 AS property_id, CAST(ts AS DATE) AS date,
               concat('query ', CAST(event_id % 40 AS STRING)) AS query,
               concat('https://site.example.com/p', CAST(event_id % 60 AS STRING)) AS page,
               CASE WHEN event_id % 3 = 0 THEN 'usa' ELSE 'gbr' END AS country,
               CASE WHEN event_id % 2 = 0 THEN 'DESKTOP' ELSE 'MOBILE' END AS device,
               event_id AS batch_seq, CAST(floor(value) AS INT) % 50 AS clicks,
               (CAST(floor(value) AS INT) % 50) * 20 + CAST(event_id % 300 AS INT) AS impressions,
               CAST(1.0 + (event_id * 7 % 40) / 2.0 AS DOUBLE) AS position
        FROM {events}""",
    "gsc_connections": """
        SELECT CAST(r_regionkey AS BIGINT) AS connection_id, CAST(r_regionkey AS BIGINT) AS organization_id
        FROM {region} WHERE r_regionkey <> 3""",
    "gsc_properties": """
        SELECT CAST(n_nationkey AS BIGINT) AS property_id, CAST(n_nationkey % 5 AS BIGINT) AS connection_id,
               CAST(n_nationkey AS BIGINT) AS project_id,
               CASE WHEN n_nationkey % 4 = 1 THEN concat('sc-domain:s', CAST(n_nationkey AS STRING), '.com')
                    WHEN n_nationkey % 11 = 10 THEN ''
                    ELSE concat('https://s', CAST(n_nationkey AS STRING), '.com/') END AS site_url,
               n_nationkey % 4 <> 3 AS is_selected
        FROM {nation}""",
    "rank_observations": """
        SELECT event_id % 90 AS tracked_keyword_id, ts AS observed_at, event_id,
               CASE WHEN event_type = 'error' THEN NULL
                    ELSE 1 + CAST(floor(value) AS INT) % 50 END AS rank,
               concat('https://site.example.com/', event_type) AS ranking_url
        FROM {events}""",
    "provider_usage": """
        SELECT user_id % 5 AS organization_id, 'vendor' AS provider,
               CASE WHEN event_type IN ('click', 'view') THEN 'serp'
                    WHEN event_type = 'purchase' THEN 'exports' ELSE 'keywords' END AS service,
               event_type AS operation, 1 + CAST(event_id % 9 AS INT) AS units, ts AS created_at
        FROM {events}""",
    "provider_accounts": """
        SELECT CAST(r_regionkey AS BIGINT) AS organization_id,
               CASE WHEN r_regionkey = 2 THEN 'google_ads' ELSE 'dataforseo' END AS provider,
               CASE r_regionkey WHEN 1 THEN 'ACTIVE' WHEN 3 THEN 'INVALID' ELSE 'CONFIGURED' END AS status
        FROM {region}""",
    "searches": """
        SELECT o_orderkey AS serp_search_id, o_custkey % 25 AS project_id,
               concat(CASE WHEN o_custkey % 3 = 0 THEN 'Buy ' ELSE '' END, 'Keyword ', CAST(o_custkey % 60 AS STRING),
                      CASE WHEN o_orderkey % 2 = 0 THEN '!' ELSE '' END) AS keyword,
               CASE WHEN o_orderkey % 3 = 0 THEN 'GB' ELSE 'US' END AS country,
               CASE WHEN o_orderkey % 4 = 0 THEN 'MOBILE' ELSE 'DESKTOP' END AS device,
               'google' AS engine, 'en' AS language, 'vendor' AS provider, o_orderdate AS searched_at
        FROM {orders}""",
    "serp_items": """
        SELECT l_orderkey AS serp_search_id, l_linenumber AS rank_absolute,
               CASE WHEN l_returnflag = 'R' THEN 'paid' ELSE 'organic' END AS result_type,
               concat(CASE l_linenumber % 3 WHEN 0 THEN 'www.' WHEN 1 THEN 'Blog.' ELSE '' END,
                      's', CAST(l_suppkey AS STRING), '.com') AS domain,
               concat('https://s', CAST(l_suppkey AS STRING), '.com/p', CAST(l_partkey % 20 AS STRING)) AS url,
               concat(CAST(l_partkey AS STRING), '-', CAST(l_shipdate AS STRING), '-',
                      CAST(l_quantity AS STRING)) AS item_id
        FROM {lineitem}""",
    "serp_features": """
        SELECT l_orderkey AS serp_search_id,
               CASE l_linenumber % 5 WHEN 0 THEN 'images' WHEN 1 THEN 'featured_snippet'
                    WHEN 2 THEN 'video' ELSE 'people_also_ask' END AS feature_type
        FROM {lineitem} WHERE l_linestatus = 'F'""",
    "tracked_keywords": """
        SELECT c_custkey AS tracked_keyword_id, c_custkey % 25 AS project_id,
               (c_custkey % 25) % 5 AS organization_id,
               concat(CASE WHEN c_custkey % 3 = 0 THEN 'buy ' ELSE '' END, 'keyword ', CAST(c_custkey % 60 AS STRING)) AS keyword,
               concat(CASE WHEN c_custkey % 3 = 0 THEN 'buy ' ELSE '' END, 'keyword ', CAST(c_custkey % 60 AS STRING)) AS normalized_keyword,
               CASE WHEN c_custkey % 3 = 0 THEN 'GB' ELSE 'US' END AS country, 'en' AS language,
               'DESKTOP' AS device, 'google' AS engine,
               CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 60 END AS keyword_id,
               c_custkey % 11 <> 0 AS is_active
        FROM {customer}""",
    "keyword_batch": """
        SELECT p_partkey AS seq, p_partkey % 5 AS organization_id,
               CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 25 END AS project_id,
               CASE WHEN p_partkey % 3 = 0 THEN 'gb' ELSE 'us' END AS country, 'EN' AS language,
               CASE WHEN p_partkey % 97 = 50 THEN ' ?! '
                    WHEN p_partkey % 10 < 6 THEN concat(CASE WHEN p_partkey % 4 = 1 THEN '  ' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN 'buy ' ELSE '' END,
                         CASE WHEN p_partkey % 4 = 1 THEN 'Keyword ' ELSE 'keyword ' END, CAST(p_partkey % 60 AS STRING))
                    ELSE concat(CASE p_partkey % 6 WHEN 0 THEN 'buy ' WHEN 1 THEN 'best ' WHEN 2 THEN 'how to '
                         WHEN 3 THEN 'near me ' WHEN 4 THEN 'login ' ELSE '' END, p_name,
                         CASE WHEN p_partkey % 8 = 7 THEN concat(' ', CAST(p_partkey AS STRING)) ELSE '' END) END AS keyword,
               CAST(floor(p_retailprice * p_size) AS BIGINT) AS search_volume,
               CAST(p_partkey % 500 AS DOUBLE) / 100.0 AS cpc,
               CAST((p_partkey % 101) / 100.0 AS DOUBLE) AS competition, 'vendor' AS provider,
               DATE '2024-01-01' + CAST(p_partkey % 30 AS INT) AS created_on
        FROM {part}""",
    "recommendations": """
        SELECT o_orderkey AS recommendation_id, o_custkey % 25 AS project_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'TECHNICAL' WHEN 1 THEN 'CONTENT' WHEN 2 THEN 'RANKING' ELSE 'COMPETITOR' END AS type,
               CASE o_orderkey % 5 WHEN 0 THEN 'AUDIT' WHEN 1 THEN 'GSC' WHEN 2 THEN 'KEYWORDS' WHEN 3 THEN 'RANK_TRACKING' ELSE 'GAP' END AS source,
               CASE o_orderkey % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'NOTICE' ELSE 'WARNING' END AS severity,
               CAST(o_orderkey % 21 AS DOUBLE) / 2.0 AS impact, CAST(o_orderkey % 9 AS DOUBLE) / 2.0 AS effort,
               CAST(5 + o_orderkey % 5 AS DOUBLE) / 10.0 AS confidence,
               CAST((o_orderkey * 37) % 1001 AS DOUBLE) / 10.0 AS score,
               concat('Recommendation ', CAST(o_orderkey AS STRING)) AS title,
               CASE o_orderkey % 7 WHEN 0 THEN 'DISMISSED' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'COMPLETED' ELSE 'OPEN' END AS status,
               o_orderdate AS created_at
        FROM {orders}""",
    "jobs": """
        SELECT o_orderkey AS job_id, o_custkey % 25 AS project_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'RUN_AUDIT' ELSE 'TRACK_RANK' END AS job_type,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
               o_orderdate AS created_at
        FROM {orders}""",
    "reports": """
        SELECT o_orderkey AS report_id, o_custkey % 25 AS project_id,
               CASE o_orderkey % 5 WHEN 0 THEN 'SEO_OVERVIEW' WHEN 1 THEN 'AUDIT' WHEN 2 THEN 'KEYWORDS'
                    WHEN 3 THEN 'RANKINGS' ELSE 'COMPETITORS' END AS type, o_orderdate AS created_at
        FROM {orders}""",
    "report_exports": """
        SELECT l_orderkey AS report_id, l_linenumber AS export_no, l_partkey AS export_part,
               CASE WHEN l_returnflag = 'R' THEN 'PDF' ELSE 'CSV' END AS format, l_shipdate AS created_at
        FROM {lineitem}""",
    "raw_urls": """
        SELECT page_id,
               CASE page_id % 8 WHEN 0 THEN url
                    WHEN 1 THEN concat(' HTTPS://', upper(split_part(url, '/', 3)), '/Path/?utm_source=x&a=1&B=&c#frag ')
                    WHEN 2 THEN concat('http://', split_part(url, '/', 3), ':80/x;p=1?gclid=1')
                    WHEN 3 THEN concat('https://', split_part(url, '/', 3), ':443?q=a%20b+c&UTM_Medium=z&empty&=v')
                    WHEN 4 THEN concat('HTTP://WWW.', split_part(url, '/', 3), ':8080')
                    WHEN 5 THEN concat('https://', split_part(url, '/', 3), '/a;b/c;d=1?x=%7Etilde*&y=%zz&&')
                    WHEN 6 THEN concat('ftp://user:pw@', split_part(url, '/', 3), '/')
                    ELSE concat(url, '?fbclid=9&ref=2&r=%C3%A9') END AS raw
        FROM {pages}""",
    "robots_files": """
        SELECT page_id AS site, concat('https://h', CAST(page_id AS STRING), '.example.com') AS origin,
               concat('# rules of host ', CAST(page_id AS STRING), chr(10),
                      CASE WHEN page_id % 4 = 0 THEN concat('Disallow: /early/', chr(10)) ELSE '' END,
                      CASE WHEN page_id % 5 = 0 THEN concat('User-Agent: otherbot', chr(10), 'Disallow: /', chr(10)) ELSE '' END,
                      CASE WHEN page_id % 4 <> 0 THEN concat(CASE WHEN page_id % 3 = 0 THEN 'user-agent : SEObot' ELSE 'User-agent: *' END, chr(10),
                           'Disallow: /p', CAST(page_id % 7 AS STRING), '*  # private', chr(10), 'Disallow:', chr(10),
                           'Disallow: /fr/', chr(10), 'Crawl-Delay: ', CASE WHEN page_id % 6 = 1 THEN 'soon' ELSE CAST(page_id % 9 AS STRING) END, chr(10),
                           'crawl-delay: 2', chr(10)) ELSE '' END,
                      CASE WHEN page_id % 2 = 0 THEN concat('Sitemap: https://h', CAST(page_id AS STRING), '.example.com/s.xml', chr(10)) ELSE '' END) AS body,
               concat('/', split_part(url, '/', 4), '/', CAST(page_id AS STRING)) AS path
        FROM {pages}""",
    "sitemap_files": """
        SELECT concat('https://h', CAST(page_id AS STRING), '.example.com/', CASE WHEN page_id % 2 = 0 THEN 's.xml' ELSE 'sitemap.xml' END) AS url,
               CASE WHEN page_id % 3 = 0
                    THEN concat('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://h',
                                CAST(page_id + 1 AS STRING), '.example.com/', CASE WHEN page_id % 2 = 1 THEN 's.xml' ELSE 'sitemap.xml' END,
                                ' </loc></sitemap></sitemapindex>')
                    ELSE concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://h',
                                CAST(page_id AS STRING), '.example.com/a</loc></url><url><loc>https://h',
                                CAST(page_id AS STRING), '.example.com/b?x=1&amp;y=', CAST(page_id % 5 AS STRING), '</loc></url></urlset>') END AS body
        FROM {pages}""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table with its declared schema, or a derived one."""
    if name in GIVEN:
        return spark.read.schema(GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name]
    inputs = {t: load(spark, sf_dir, t) for t in placeholders(text)}
    return spark.sql(text, **inputs)


def placeholders(text: str) -> list[str]:
    names = dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", text))
    return [n for n in names if n in GIVEN or n in DERIVED]


def _unbraced(text: str) -> str:
    for name in placeholders(text):
        text = text.replace("{" + name + "}", name)
    return text.strip()


def check_sql(text: str) -> str:
    """Check SQL with every derived table it names spelled out as a WITH clause."""
    needed: dict[str, str] = {}

    def need(name: str) -> None:
        if name in GIVEN or name in needed:
            return
        for inner in placeholders(DERIVED[name]):
            need(inner)
        needed[name] = DERIVED[name]

    for name in placeholders(text):
        need(name)
    plain = _unbraced(text)
    if not needed:
        return plain
    clauses = ",\n".join(f"{n} AS ({_unbraced(sql)})" for n, sql in needed.items())
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", plain)
    if own:
        return f"WITH {own.group(1) or ''}{clauses},\n{plain[own.end():]}"
    return f"WITH {clauses}\n{plain}"
