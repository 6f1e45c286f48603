"""Page, robots, sitemap and link-graph queries: S2–S5, A1, A3, A20, F19, W8, W9, Q33, A21."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import Tables, half_up, query
from rankloom.functions import urls as U
from rankloom.functions.text import content_hash
from rankloom.operators import linkgraph
from rankloom.plans import audit, crawl
from rankloom.sources import html, robots

# Text of a page the way RE2 can say it; the given pages hold four different entities.
TEXT_SQL = """trim(regexp_replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?(</script\\s*>|$)', ' ', 'g'),
        '(?is)<style\\b[^>]*>.*?(</style\\s*>|$)', ' ', 'g'),
        '(?is)<!--(.*?)-->|<!doctype\\s+([^>]*)>|<[/?!]?[a-z][^>]*(?:>|$)', ' \\1\\2 ', 'g'),
    '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))"""
UNESCAPE_SQL = "replace(replace({0}, '&quot;', '\"'), '&amp;', '&')"
TITLE_SQL = "nullif(trim(" + UNESCAPE_SQL.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + "), '')"
NAV_SQL = "len(regexp_extract_all(html, '<li><a href=\"/'))"


@query("s2_page_signals", f"""
    WITH p AS (SELECT *, {TEXT_SQL} AS visible, {TITLE_SQL} AS title FROM {{fetched_pages}})
    SELECT page_id, title, CAST(coalesce(length(title), 0) AS INTEGER) AS title_length,
           CASE WHEN page_id % 4 <> 0 THEN 'About page ' || CAST(page_id % 40 AS VARCHAR) || ' & more' || CASE WHEN page_id % 40 >= 33 THEN repeat(' and further things', 9) ELSE '' END END AS meta_description,
           CASE page_id % 11 WHEN 0 THEN NULL WHEN 1 THEN regexp_extract(url, '^https?://[^/]*') || '/gone' ELSE url END AS canonical,
           CASE WHEN page_id % 19 = 3 THEN 'NOINDEX,nofollow' END AS robots_meta,
           CAST(len(regexp_extract_all(html, '<h1')) AS INTEGER) AS h1_count,
           CASE WHEN page_id % 6 < 2 THEN 'Second head ing' ELSE
                trim({UNESCAPE_SQL.format("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")}) END AS first_h1,
           CAST(len(string_split(visible, ' ')) AS INTEGER) AS word_count, substr(regexp_extract(html, '<html lang="([^"]*)"', 1), 1, 10) AS language,
           CASE WHEN page_id % 4 > 0 THEN 2 ELSE 1 END AS images_count, CASE WHEN page_id % 4 > 0 THEN 1 ELSE 0 END AS images_missing_alt,
           CAST({NAV_SQL} + 2 AS INTEGER) AS internal_links, 1 AS external_links, page_id % 19 = 3 AS is_noindex, page_id % 19 = 3 AS is_nofollow,
           CASE WHEN page_id % 3 = 0 THEN 'Article,Person' END AS schema_types, 'OG ' || CAST(page_id AS VARCHAR) AS og_title, 'summary' AS twitter_card,
           CASE WHEN page_id % 10 = 0 THEN 'en,english' WHEN page_id % 5 = 0 THEN 'en' END AS languages, sha256(lower(visible)) AS content_hash
    FROM p""")
def page_signals(t: Tables):
    s = html.page_signals(t.fetched_pages.select("page_id", "url", "html"))
    return s.select(
        "page_id", "title", "title_length", "meta_description", "canonical", "robots_meta", "h1_count",
        F.try_element_at("h1_text", F.lit(1)).alias("first_h1"), "word_count", "language", "images_count",
        "images_missing_alt", "internal_links", "external_links", "is_noindex", "is_nofollow",
        F.array_join("schema_presence", ",").alias("schema_types"),
        F.try_element_at("open_graph", F.lit("title")).alias("og_title"),
        F.try_element_at("twitter_cards", F.lit("card")).alias("twitter_card"),
        F.array_join(F.array_sort(F.map_keys("hreflang")), ",").alias("languages"), "content_hash")


@query("s2_f19_page_links", """
    WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]*') AS origin, html FROM {fetched_pages}),
    l AS (SELECT page_id, url, origin || unnest(regexp_extract_all(html, '<li><a href="(/[^"]*)"', 1)) AS to_url, TRUE AS is_internal, NULL AS rel FROM p
          UNION ALL SELECT page_id, url, 'https://other.example.org/x?utm_source=y', FALSE, 'nofollow' FROM p
          UNION ALL SELECT page_id, url, origin || '/up/d?x=1#f', TRUE, NULL FROM p
          UNION ALL SELECT page_id, url, regexp_extract(url, '^https?:') || '//WWW.site' || CAST(page_id % 3 AS VARCHAR) || '.example.com/w', TRUE, NULL FROM p)
    SELECT url AS from_url, to_url, CASE WHEN contains(to_url, 'utm_source') THEN 'https://other.example.org/x' WHEN contains(to_url, '#f') THEN replace(to_url, '#f', '')
                ELSE replace(to_url, 'WWW', 'www') END AS normalized_to_url, is_internal, rel, count(*) AS copies
    FROM l GROUP BY ALL""")
def page_links(t: Tables):
    links = html.page_links(html.page_signals(t.fetched_pages.select("url", "html")))
    return links.groupBy("from_url", "to_url", "normalized_to_url", "is_internal", "rel").agg(F.count("*").alias("copies"))


@query("s3_robots_rules", """
    WITH lines AS (
        SELECT site, idx, trim(split_part(line, '#', 1)) AS line
        FROM (SELECT site, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS idx FROM {robots_files})),
    fields AS (SELECT site, idx, lower(trim(split_part(line, ':', 1))) AS field, trim(substr(line, strpos(line, ':') + 1)) AS value FROM lines WHERE contains(line, ':')),
    agents AS (SELECT *, last_value(CASE WHEN field = 'user-agent' THEN lower(value) END IGNORE NULLS) OVER (PARTITION BY site ORDER BY idx) AS agent FROM fields),
    sums AS (
        SELECT site, string_agg(value, '|' ORDER BY idx) FILTER (WHERE field = 'disallow' AND value <> '' AND agent IN ('*', 'seobot')) AS own,
               string_agg(value, '|' ORDER BY idx) FILTER (WHERE field = 'disallow' AND value <> '' AND agent IS NULL) AS early,
               max(TRY_CAST(value AS DOUBLE)) FILTER (WHERE field = 'crawl-delay' AND agent IN ('*', 'seobot')) AS crawl_delay,
               string_agg(value, '|' ORDER BY idx) FILTER (WHERE field = 'sitemap') AS sitemaps
        FROM agents GROUP BY site)
    SELECT f.site, coalesce(own, early, '') AS disallows, crawl_delay, coalesce(sitemaps, '') AS sitemaps
    FROM {robots_files} f LEFT JOIN sums s ON s.site = f.site""")
def robots_rules(t: Tables):
    return robots.robots_rules(t.robots_files).select(
        "site", F.array_join("disallows", "|").alias("disallows"), "crawl_delay",
        F.array_join("sitemaps", "|").alias("sitemaps"))


@query("s4_sitemap_urls", """
    SELECT url, unnest(list_transform(regexp_extract_all(body, '<loc>\\s*([^<]*?)\\s*</loc>', 1), lambda u: replace(u, '&amp;', '&'))) AS listed,
           CASE WHEN contains(body, '<urlset') THEN 'page' ELSE 'sitemap' END AS kind
    FROM {sitemap_files}""")
def sitemap_urls(t: Tables):
    maps = robots.sitemap_urls(t.sitemap_files)
    return (maps.select("url", F.explode("pages").alias("listed"), F.lit("page").alias("kind"))
            .unionByName(maps.select("url", F.explode("nested").alias("listed"), F.lit("sitemap").alias("kind"))))


@query("s5_sitemap_expand", """
    WITH RECURSIVE maps AS (
        SELECT url, unnest(list_transform(regexp_extract_all(body, '<loc>\\s*([^<]*?)\\s*</loc>', 1), lambda u: replace(u, '&amp;', '&'))) AS listed,
               contains(body, '<urlset') AS is_page FROM {sitemap_files}),
    walk AS (
        SELECT site, origin || CASE WHEN site % 2 = 0 THEN '/s.xml' ELSE '/sitemap.xml' END AS url, 0 AS depth FROM {robots_files}
        UNION
        SELECT w.site, m.listed, w.depth + 1 FROM walk w JOIN maps m ON m.url = w.url AND NOT m.is_page WHERE w.depth < 2),
    first AS (SELECT site, url, min(depth) AS depth FROM walk GROUP BY site, url)
    SELECT site, listed AS seed_url, depth FROM first f JOIN maps m ON m.url = f.url AND m.is_page""")
def sitemap_expand(t: Tables):
    rules = robots.robots_rules(t.robots_files).select("site", "origin", "sitemaps")
    return robots.sitemap_expand(rules, robots.sitemap_urls(t.sitemap_files))


@query("a1_inbound_links", """
    SELECT crawl_run_id, normalized_to_url, count(*) AS inbound FROM {links} WHERE is_internal GROUP BY crawl_run_id, normalized_to_url""")
def inbound_links(t: Tables):
    return linkgraph.inbound_links(t.links)


@query("a3_duplicate_documents", """
    WITH h AS (SELECT doc_id, source, sha256(lower(trim(regexp_replace(text, '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')))) AS content_hash FROM documents)
    SELECT doc_id, content_hash, count(*) OVER (PARTITION BY content_hash) > 1 AS is_duplicate FROM h""")
def duplicate_documents(t: Tables):
    docs = t.documents.select("doc_id", "text").select("doc_id", F.lit(1).alias("crawl_run_id"), content_hash(F.col("text")).alias("content_hash"))
    return audit.mark_duplicates(docs).select("doc_id", "content_hash", "is_duplicate")


@query("w8_frontier_dedup", """
    WITH f AS (SELECT crawl_run_id, normalized_to_url AS normalized_url, from_url, CAST(length(from_url) AS INTEGER) AS depth FROM {links})
    SELECT crawl_run_id, normalized_url, depth, from_url FROM (
        SELECT *, row_number() OVER (PARTITION BY crawl_run_id, normalized_url ORDER BY depth, from_url) AS rn FROM f) WHERE rn = 1""")
def frontier_dedup(t: Tables):
    frontier = t.links.select("crawl_run_id", F.col("normalized_to_url").alias("normalized_url"), "from_url",
                              F.length("from_url").alias("depth"), F.col("from_url").alias("seq"))
    return linkgraph.dedup_frontier(frontier).drop("seq")


@query("w9_click_depth", """
    WITH RECURSIVE walk AS (
        SELECT crawl_run_id, url, CASE WHEN depth = 0 THEN 0 ELSE 1 END AS depth FROM {fetched_pages} WHERE page_id < 3 OR page_id % 50 = 7
        UNION
        SELECT w.crawl_run_id, l.normalized_to_url, w.depth + 1 FROM walk w
        JOIN {links} l ON l.crawl_run_id = w.crawl_run_id AND l.from_url = w.url WHERE w.depth < 30)
    SELECT crawl_run_id, url, min(depth) AS depth FROM walk GROUP BY crawl_run_id, url""")
def click_depth(t: Tables):
    pages = t.fetched_pages.where((F.col("page_id") < 3) | (F.col("page_id") % 50 == 7))
    seeds = pages.select("crawl_run_id", "url", F.when(F.col("depth") == 0, 0).otherwise(1).alias("depth"))
    links = t.links.where("is_internal").select("crawl_run_id", "from_url", F.col("normalized_to_url").alias("to_url"))
    return linkgraph.click_depth(seeds, links)


@query("q33_a21_crawl_coverage", f"""
    WITH c AS (
        SELECT crawl_run_id, count(*) AS pages_crawled, count(*) FILTER (WHERE error IS NOT NULL OR status_code >= 400) AS pages_failed,
               count(*) FILTER (WHERE is_robots_blocked) AS pages_blocked,
               greatest(0.1e0, CAST(epoch_us(max(fetched_at)) - epoch_us(min(fetched_at)) AS DOUBLE) / 1000000.0e0) AS elapsed
        FROM {{fetch_log}} GROUP BY crawl_run_id),
    d AS (SELECT *, pages_crawled + crawl_run_id * 10 AS pages_discovered FROM c)
    SELECT crawl_run_id, pages_discovered, pages_crawled, pages_failed, pages_blocked, {half_up('pages_crawled / elapsed', 1)} AS speed,
           {half_up('greatest(0, pages_discovered - pages_crawled) / greatest(0.1e0, pages_crawled / elapsed)', 1)} AS eta_seconds,
           CAST({half_up('least(100.0e0, CAST(pages_crawled AS DOUBLE) / greatest(1, pages_discovered) * 100)', 0)} AS INTEGER) AS percent_done,
           elapsed > 180 AS is_partial
    FROM d""")
def crawl_coverage(t: Tables):
    log = t.fetch_log.withColumn("fetched_us", F.unix_micros(F.col("fetched_at").cast("timestamp")))
    found = log.groupBy("crawl_run_id").agg((F.count("*") + F.first("crawl_run_id") * 10).alias("pages_discovered"))
    return crawl.coverage(log, found)


@query("f1_normalized_page_hosts", """
    SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www[.]', '') AS site, count(*) AS pages
    FROM pages GROUP BY 1""")
def page_hosts(t: Tables):
    site = U.fold_www(U.host_of(U.normalize_url(F.col("url"))))
    return t.pages.groupBy(site.alias("site")).agg(F.count("*").alias("pages"))
