"""robots.txt and sitemap bodies (S3–S5, F14), each handled inside its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import strip, unescape_all
from rankloom.session import stage

AGENT = "seobot"


def _clean_lines(body: Column) -> Column:
    """``field:value`` lines, comments and blanks removed, field lower-cased."""
    lines = F.split(F.coalesce(body, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    bare = F.transform(lines, lambda x: strip(F.substring_index(x, "#", 1)))
    fields = F.filter(bare, lambda x: x.contains(":"))
    return F.transform(fields, lambda x: F.concat(
        F.lower(strip(F.substring_index(x, ":", 1))), F.lit(":"),
        strip(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))))


def _values(text: Column, field: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?m)^{field}:(.+)$"), F.lit(1))


def robots_rules(files: DataFrame, body: str = "body") -> DataFrame:
    """Add disallows, crawl_delay and sitemaps (S3).

    The text is cut at every user-agent line; a section counts when it names ``*`` or our
    agent, and the part before the first user-agent is the fallback for disallows.
    """
    sections = F.split(F.array_join(_clean_lines(F.col(body)), "\n"), r"(?m)^user-agent:")
    named = F.slice(sections, F.lit(2), F.greatest(F.size(sections) - 1, F.lit(0)))
    ours = F.filter(named, lambda s: F.lower(F.substring_index(s, "\n", 1)).isin("*", AGENT))
    rules = F.array_join(ours, "\n")
    own = _values(rules, "disallow")
    delays = F.transform(_values(rules, "crawl-delay"), lambda x: x.try_cast("double"))
    delay = F.array_max(F.transform(F.filter(delays, lambda x: x.isNotNull()),
                                    lambda x: F.greatest(x, F.lit(0.0))))
    return files.select(
        *[c for c in files.columns if c != body],
        F.when(F.size(own) > 0, own).otherwise(_values(F.element_at(sections, 1), "disallow"))
        .alias("disallows"),
        delay.alias("crawl_delay"),
        _values(F.array_join(sections, "\n"), "sitemap").alias("sitemaps"))


def is_allowed(path: Column, disallows: Column) -> Column:
    """False when a rule equals the path or, its trailing ``*`` dropped, begins it."""
    return ~F.coalesce(F.exists(disallows, lambda r: (path == r) | F.startswith(
        path, F.regexp_replace(r, r"\*+$", ""))), F.lit(False))


def sitemap_urls(files: DataFrame, body: str = "body") -> DataFrame:
    """Add all pages and nested sitemaps listed by a sitemap body, and its size."""
    bare = F.regexp_replace(F.col(body), r"(?s)<!--.*?-->", "")
    root = F.lower(F.regexp_extract(bare, r"<(?:[\w.\-]+:)?([a-zA-Z]\w*)", 1))
    whole = bare.rlike(r"(?i)</(?:[\w.\-]+:)?(urlset|sitemapindex)\s*>\s*$")
    found = F.regexp_extract_all(
        bare, F.lit(r"(?is)<(?:[\w.\-]+:)?loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*<"),
        F.lit(1))
    urls = F.filter(unescape_all(found), lambda u: u != "")
    none = F.array().cast("array<string>")
    return (files.withColumn("_root", F.when(whole, root)).withColumn("_urls", urls).select(
        *[c for c in files.columns if c != body],
        F.when(F.col("_root") == "urlset", F.col("_urls"))
        .otherwise(none).alias("pages"),
        F.when(F.col("_root") == "sitemapindex", F.col("_urls"))
        .otherwise(none).alias("nested"), F.octet_length(body).alias("body_bytes")))


def sitemap_expand(robots: DataFrame, sitemaps: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Seed URLs per site by following stored sitemaps (S5), to ``max_depth`` if one is given.

    ``robots``: site, origin, sitemaps; ``sitemaps``: url, pages, nested.  A site whose robots
    file names no sitemap starts at ``/sitemap.xml``.  Each round joins the frontier with the
    stored sitemaps and drops what the site has visited before, so the rounds come to an end.
    """
    start = F.when(F.size("sitemaps") > 0, F.col("sitemaps")).otherwise(
        F.array(F.concat(F.col("origin"), F.lit("/sitemap.xml"))))
    frontier = robots.select("site", F.explode(start).alias("url")).distinct()
    visited, found, depth = frontier, None, 0
    while True:
        hits = stage(frontier.join(sitemaps, "url"))
        seeds = hits.select("site", F.explode("pages").alias("seed_url"), F.lit(depth).alias("depth"))
        found = seeds if found is None else found.unionByName(seeds)
        frontier = stage(hits.select("site", F.explode("nested").alias("url")).distinct()
                         .join(visited, ["site", "url"], "left_anti"))
        if depth == max_depth or frontier.isEmpty():
            return found
        visited, depth = visited.unionByName(frontier), depth + 1
