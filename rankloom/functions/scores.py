"""Priorities, severities, plan limits, dates and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.numbers import clamp, rounded
from rankloom.functions.text import strip

# Impact of an issue by severity, effort by category.
SEVERITY_IMPACT = {"CRITICAL": 9.0, "ERROR": 7.0, "WARNING": 4.0, "NOTICE": 2.0}
CATEGORY_EFFORT = {
    "Metadata": 1.0, "Content": 3.0, "Links": 2.0, "Images": 1.0, "Canonical": 2.0,
    "Redirects": 2.0, "HTTPS": 2.0, "Structured Data": 2.0, "Crawlability": 2.5,
    "Indexability": 2.0, "Performance": 4.0, "International": 2.5,
}
# Score deduction of a severity, bucket of a category, weight of a bucket.
SEVERITY_POINTS = {"CRITICAL": 60.0, "ERROR": 25.0, "WARNING": 10.0, "NOTICE": 3.0}
CATEGORY_BUCKET = {
    "Crawlability": "crawlability", "Redirects": "crawlability",
    "Indexability": "indexability", "Canonical": "indexability",
    "International": "indexability", "HTTPS": "technical", "Structured Data": "technical",
    "Metadata": "metadata", "Content": "content", "Links": "links", "Images": "links",
    "Performance": "performance",
}
BUCKET_WEIGHTS = {
    "crawlability": 0.15, "indexability": 0.15, "technical": 0.20, "metadata": 0.15,
    "content": 0.15, "links": 0.10, "performance": 0.10,
}
SEVERITIES = ["CRITICAL", "ERROR", "WARNING", "NOTICE"]

# Vendor location codes by country.
LOCATION_CODES = {
    "US": 2840, "GB": 2826, "IN": 2356, "CA": 2124, "AU": 2036, "DE": 2276, "FR": 2250,
    "ES": 2724, "IT": 2380, "NL": 2528, "BR": 2076, "MX": 2344, "JP": 2392, "SE": 2752,
    "PL": 2616,
}
# Plan limits.
PLAN_LIMITS = {
    "FREE": {"projects": 3, "tracked_per_project": 25, "crawl_pages": 200, "monthly_serp": 100,
             "monthly_keywords": 100, "monthly_exports": 10},
    "PRO": {"projects": 25, "tracked_per_project": 500, "crawl_pages": 2000,
            "monthly_serp": 5000, "monthly_keywords": 5000, "monthly_exports": 500},
    "BUSINESS": {"projects": 200, "tracked_per_project": 5000, "crawl_pages": 10000,
                 "monthly_serp": 50000, "monthly_keywords": 50000, "monthly_exports": 5000},
}


def lookup(key: Column, table: dict, default=None) -> Column:
    """Constant lookup inside the expression — no join for a handful of values."""
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def priority(impact: Column, confidence: Column, effort: Column) -> Column:
    """impact × confidence × 10 ÷ effort, clamped to 0–100."""
    cost = clamp(F.coalesce(F.nullif(effort, F.lit(0.0)), F.lit(1.0)), 0.5, 5.0)
    return rounded(clamp(impact * confidence * 10.0 / cost, 0.0, 100.0), 1)


def cache_key(keyword: Column, engine: Column, country: Column, language: Column,
              device: Column, location: Column, provider: Column, project: Column) -> Column:
    """Identity of a search: SHA-256 over its folded fields."""
    return F.sha2(F.concat_ws(
        "|", F.lower(strip(F.coalesce(keyword, F.lit("")))), F.lower(engine), F.upper(country),
        F.lower(language), F.upper(device), F.lower(strip(F.coalesce(location, F.lit("")))),
        F.lower(provider), F.coalesce(project.cast("string"), F.lit("global"))), 256)


def location_code(country: Column, explicit: Column) -> Column:
    """Vendor location: an explicit code wins, an unknown country is null."""
    known = lookup(F.upper(F.coalesce(F.nullif(country, F.lit("")), F.lit("US"))), LOCATION_CODES)
    return F.coalesce(F.nullif(explicit, F.lit(0)), known)


def location_reject_reason(code: Column, country: Column) -> Column:
    """Why a search cannot be located, null where it can."""
    return F.when(code.isNull(), F.concat(F.lit("no location mapping for country "), F.upper(country)))


def severity_rank(severity: Column) -> Column:
    """0 for critical … 3 for notice, 9 for anything else."""
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)}, 9)


def since(as_of: Column, days: int) -> Column:
    """First day of a reporting window of ``days`` days."""
    if int(days) < 1:
        raise ValueError("a window has one day at least")
    return F.date_sub(as_of, int(days))


def month_start(as_of: Column) -> Column:
    return F.trunc(as_of, "month")


def slug_base(name: Column) -> Column:
    """Lower-case letters and digits, everything else a dash."""
    dashed = F.regexp_replace(F.lower(strip(name)), r"(?U)[^\p{L}\p{N}]", "-")
    bare = F.trim(dashed, F.lit("-"))
    return F.when(bare == "", "org").otherwise(bare)


def plan_or_free(plan: Column) -> Column:
    """Known plan name, FREE otherwise."""
    return F.when(plan.isin(list(PLAN_LIMITS)), plan).otherwise("FREE")


def plan_limit(plan: Column, name: str) -> Column:
    return lookup(plan_or_free(plan), {p: v[name] for p, v in PLAN_LIMITS.items()})


def clamp_crawl_pages(requested: Column, plan: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(requested, F.lit(0)),
                                        plan_limit(plan, "crawl_pages")))


def thousands(value: Column) -> Column:
    """1234567 → 1,234,567."""
    return F.format_number(value, 0)


def issue_message(rule_name: Column, affected: Column) -> Column:
    return F.concat(rule_name, F.lit(" — "), affected.cast("string"), F.lit(" page(s) affected"))


def usage_units(service: Column, size: Column) -> Column:
    """Metered units: depth ÷ 10 or keywords ÷ 10, one at least; one per export."""
    return F.when(service == "exports", F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.floor(size / 10).cast("int")))
