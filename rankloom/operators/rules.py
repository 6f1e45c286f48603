"""The rule catalogue of the site audit.

A rule is a code, a name, a severity, a category and — for page-local rules — a condition
over the columns of ``crawl_pages``.  The whole catalogue of page-local rules is evaluated in
one scan; rules without a condition need another row and are joins in ``plans.audit``.  New
rules are added by passing a longer list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import is_indexable, is_valid_hreflang, strip

# Thresholds.
TITLE_MAX = 60
TITLE_MIN = 30
DESCRIPTION_MAX = 160
THIN_WORDS = 300
SLOW_MS = 2000


@dataclass(frozen=True)
class Rule:
    code: str
    name: str
    severity: str
    category: str
    advice: str
    condition: Column | None = None


def _blank(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit(""))) == ""


def _size(name: str) -> Column:
    return F.length(F.coalesce(F.col(name), F.lit("")))


def _number(name: str, missing: int = 0) -> Column:
    return F.coalesce(F.col(name), F.lit(missing))


def catalogue() -> list[Rule]:
    """All 26 rules; codes, names, severities and categories are fixed values."""
    ok = F.coalesce(F.col("status_code") == 200, F.lit(False))
    indexable = is_indexable(F.col("status_code"), F.col("is_noindex"), F.col("is_robots_blocked"))
    languages = F.map_keys("hreflang")
    return [
        Rule("SITE_DOWN", "Homepage unreachable", "CRITICAL", "Crawlability",
             "Bring the homepage back: hosting, DNS, certificate, firewall.",
             (_number("depth", 1) == 0) & (_number("status_code") >= 500)),
        Rule("BROKEN_PAGE", "Broken page (4xx/5xx)", "ERROR", "Crawlability",
             "Repair the page, redirect it, or take links to it away.",
             _number("status_code") >= 400),
        Rule("TITLE_MISSING", "Missing title tag", "ERROR", "Metadata",
             "Give the page its own title of 30 to 60 characters.", ok & _blank("title")),
        Rule("TITLE_TOO_LONG", "Title too long (>60 chars)", "WARNING", "Metadata",
             "Cut the title to 60 characters.", ok & (_size("title") > TITLE_MAX)),
        Rule("TITLE_TOO_SHORT", "Title too short (<30 chars)", "WARNING", "Metadata",
             "Say more in the title, at least 30 characters.",
             ok & (_size("title") > 0) & (_size("title") < TITLE_MIN)),
        Rule("DUPLICATE_TITLE", "Duplicate title tag", "ERROR", "Metadata",
             "Tell the pages apart by title, or merge them."),
        Rule("META_DESCRIPTION_MISSING", "Missing meta description", "ERROR", "Metadata",
             "Add a description of 120 to 160 characters.", ok & _blank("meta_description")),
        Rule("META_DESCRIPTION_TOO_LONG", "Meta description too long (>160 chars)", "WARNING",
             "Metadata", "Cut the description to 160 characters.",
             ok & (_size("meta_description") > DESCRIPTION_MAX)),
        Rule("DUPLICATE_META_DESCRIPTION", "Duplicate meta description", "ERROR", "Metadata",
             "Write one description per page."),
        Rule("H1_MISSING", "Missing H1", "ERROR", "Content", "Add one main heading.",
             ok & (_number("h1_count") == 0)),
        Rule("MULTIPLE_H1", "Multiple H1 tags", "WARNING", "Content",
             "Keep one main heading, lower the others.", ok & (_number("h1_count") > 1)),
        Rule("THIN_CONTENT", "Thin content (<300 words)", "WARNING", "Content",
             "Write more, merge the page, or mark it noindex.",
             indexable & (_number("word_count") < THIN_WORDS)),
        Rule("DUPLICATE_CONTENT", "Duplicate content", "ERROR", "Content",
             "Point copies to one page or make them differ."),
        Rule("ORPHAN_PAGE", "Orphan page (no internal inbound links)", "WARNING", "Links",
             "Link to the page from a hub, or drop it."),
        Rule("BROKEN_INTERNAL_LINK", "Page links to a broken internal URL", "ERROR", "Links",
             "Correct or remove the link."),
        Rule("REDIRECT_CHAIN", "Redirect chain", "WARNING", "Redirects",
             "Redirect straight to the last page."),
        Rule("REDIRECT_LOOP", "Redirect loop", "ERROR", "Redirects",
             "Let every redirect end at a live page."),
        Rule("CANONICAL_MISSING", "Missing canonical on indexable page", "WARNING", "Canonical",
             "Name the page itself as its canonical.", indexable & _blank("canonical")),
        Rule("CANONICAL_CONFLICT", "Canonical points to uncrawled/broken URL", "ERROR",
             "Canonical", "Name a live page as canonical."),
        Rule("NOINDEX_PAGE", "Noindex page discovered", "WARNING", "Indexability",
             "Check that noindex is meant.", F.coalesce("is_noindex", F.lit(False))),
        Rule("ROBOTS_BLOCKED", "URL blocked by robots.txt", "WARNING", "Crawlability",
             "Allow the URL or stop linking to it.", F.coalesce("is_robots_blocked", F.lit(False))),
        Rule("MISSING_IMAGE_ALT", "Images missing alt text", "WARNING", "Images",
             "Describe the images.", ok & (_number("images_missing_alt") > 0)),
        Rule("HTTP_PAGE", "Page served over HTTP", "ERROR", "HTTPS",
             "Move the page to HTTPS and redirect.",
             F.coalesce(F.col("url").startswith("http://"), F.lit(False))),
        Rule("SLOW_PAGE", "Slow page (>2s server response)", "WARNING", "Performance",
             "Find out what the server waits for.", _number("response_time_ms") > SLOW_MS),
        Rule("MISSING_STRUCTURED_DATA", "No structured data on indexable page", "NOTICE",
             "Structured Data", "Add schema.org types that fit.",
             indexable & (F.size(F.coalesce("schema_presence", F.array().cast("array<string>"))) == 0)),
        Rule("INVALID_HREFLANG", "Invalid hreflang value", "WARNING", "International",
             "Use two-letter codes: ll or ll-cc.",
             ok & F.coalesce(F.exists(languages, lambda k: ~is_valid_hreflang(k)), F.lit(False))),
    ]


def rule_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a table (K7); 26 rows."""
    rows = [(r.code, r.name, r.severity, r.category, r.advice, True) for r in catalogue()]
    return spark.createDataFrame(rows, "code string, name string, severity string, "
                                       "category string, advice string, enabled boolean")


def upsert_rules(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Refresh rule texts by code; a switched-off rule stays off (K7)."""
    kept = existing.select("code", F.col("enabled").alias("_enabled"))
    return (fresh.join(kept, "code", "left")
            .withColumn("enabled", F.coalesce("_enabled", "enabled")).drop("_enabled"))
