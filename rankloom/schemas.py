"""Declared schemas and natural keys of the domain tables.

Nothing is inferred: readers pass these to ``spark.read.schema``.  Ids are strings in production
tables; flexible payloads are typed arrays, maps and structs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKET = "country string, language string"
_SCORED = "clicks int, impressions int, ctr double, position double"

TABLES = {
    "organizations": "organization_id string, name string, slug string, plan string, is_deleted boolean",
    "users": "user_id string, email string, display_name string",
    "organization_members": "organization_id string, user_id string, role string",
    "projects": f"project_id string, organization_id string, name string, domain string, {_MARKET}, device string, "
                "competitors string, is_archived boolean, is_deleted boolean",
    "competitors": "competitor_id string, organization_id string, project_id string, domain string, original_input string, "
                   "label string, is_active boolean, created_at timestamp",
    "keywords": f"keyword_id string, organization_id string, project_id string, keyword string, normalized_keyword string, {_MARKET}, "
                "source string, created_at timestamp",
    "keyword_metrics": "keyword_id string, created_at timestamp, search_volume bigint, cpc double, competition double, "
                       "trend array<bigint>, intent string, difficulty double, opportunity double, serp_features array<string>, provider string",
    "keyword_intents": "keyword_id string, intent string, confidence double, method string",
    "tracked_keywords": f"tracked_keyword_id string, organization_id string, project_id string, keyword_id string, keyword string, "
                        f"normalized_keyword string, {_MARKET}, device string, engine string, location string, is_active boolean",
    "rank_observations": "tracked_keyword_id string, observed_at timestamp, rank int, ranking_url string, serp_features array<string>",
    "serp_searches": f"serp_search_id string, organization_id string, project_id string, keyword string, engine string, {_MARKET}, "
                     "device string, location string, cache_key string, status string, provider string, provider_search_id string, searched_at timestamp",
    "serp_results": "serp_search_id string, position int, domain string, url string, title string, snippet string, "
                    "result_type string, feature_type string",
    "serp_features": "serp_search_id string, feature_type string, position int, "
                     "data struct<title:string,url:string,domain:string,description:string>",
    "crawl_runs": "crawl_run_id string, organization_id string, project_id string, status string, pages_discovered int, "
                  "pages_crawled int, issues_found bigint, health_score double, config map<string,string>, created_at timestamp, finished_at timestamp",
    "crawl_pages": "crawl_run_id string, url string, normalized_url string, depth int, status_code int, content_type string, "
                   "response_time_ms int, title string, title_length int, meta_description string, meta_description_length int, "
                   "canonical string, robots_meta string, h1_count int, h1_text array<string>, word_count int, language string, "
                   "images_count int, images_missing_alt int, internal_links int, external_links int, redirect_target string, "
                   "indexability string, is_noindex boolean, is_nofollow boolean, is_robots_blocked boolean, is_duplicate boolean, "
                   "schema_presence array<string>, open_graph map<string,string>, twitter_cards map<string,string>, "
                   "hreflang map<string,string>, content_hash string",
    "crawl_links": "crawl_run_id string, from_url string, to_url string, normalized_to_url string, is_internal boolean, rel string",
    "audit_rules": "code string, name string, severity string, category string, advice string, enabled boolean",
    "audit_issues": "crawl_run_id string, code string, name string, severity string, category string, advice string, enabled boolean, "
                    "affected_count bigint, message string",
    "audit_issue_instances": "crawl_run_id string, code string, url string",
    "gsc_connections": "connection_id string, organization_id string",
    "gsc_properties": "property_id string, connection_id string, project_id string, site_url string, property_type string, "
                      "is_selected boolean, last_synced_at timestamp",
    "gsc_query_data": f"property_id string, date date, query string, country string, device string, {_SCORED}",
    "gsc_page_data": f"property_id string, date date, page string, country string, device string, {_SCORED}",
    "recommendations": "recommendation_id string, organization_id string, project_id string, type string, source string, severity string, "
                       "impact double, effort double, confidence double, score double, title string, description string, "
                       "related_url string, related_keyword string, status string, created_at timestamp",
    "reports": "report_id string, organization_id string, project_id string, type string, status string, created_at timestamp",
    "report_exports": "export_id string, report_id string, format string, status string, created_at timestamp, expires_at timestamp",
    "provider_accounts": "organization_id string, provider string, label string, status string",
    "provider_usage": "organization_id string, provider string, service string, operation string, units int, "
                      "estimated_cost double, created_at timestamp",
    "jobs": "job_id string, organization_id string, project_id string, job_type string, status string, progress int, created_at timestamp",
}

NATURAL_KEYS = {
    "organizations": ["slug"],
    "competitors": ["project_id", "domain"],
    "keywords": ["organization_id", "normalized_keyword", "country", "language"],
    "keyword_metrics": ["keyword_id", "created_at"],
    "keyword_intents": ["keyword_id", "method"],
    "tracked_keywords": ["project_id", "normalized_keyword", "country", "device", "engine"],
    "serp_searches": ["cache_key"],
    "crawl_pages": ["crawl_run_id", "normalized_url"],
    "audit_rules": ["code"],
    "audit_issues": ["crawl_run_id", "code"],
    "gsc_properties": ["connection_id", "site_url"],
    "gsc_query_data": ["property_id", "date", "query", "country", "device"],
    "gsc_page_data": ["property_id", "date", "page", "country", "device"],
    "provider_accounts": ["organization_id", "provider", "label"],
}

# Partition columns of the stored tables: the filters every job has.
PARTITIONS = {
    "crawl_pages": ["crawl_run_id"], "crawl_links": ["crawl_run_id"], "audit_issue_instances": ["crawl_run_id"],
    "gsc_query_data": ["date"], "gsc_page_data": ["date"],
}


def read_table(spark: SparkSession, root: str, name: str, **equal) -> DataFrame:
    """A stored table with its declared schema and equality filters."""
    rows = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows


def read_jdbc(spark: SparkSession, url: str, name: str, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 32, equal: dict | None = None, **options) -> DataFrame:
    """The same table from a relational database; a numeric column splits the read.

    Equality filters are evaluated by the database, in each part's query.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0],
                                upperBound=bounds[1], numPartitions=partitions)
    rows = reader.load()
    for column, value in (equal or {}).items():
        rows = rows.where(F.col(column) == value)
    return rows


def write_table(rows: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Store a table under its partitioning; overwriting replaces touched partitions only."""
    writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if name in PARTITIONS:
        writer = writer.partitionBy(*PARTITIONS[name])
    writer.parquet(f"{root}/{name}")


def duplicate_keys(rows: DataFrame, name: str) -> DataFrame:
    """Natural keys that occur more than once — the uniqueness check of a stored table."""
    return rows.groupBy(*NATURAL_KEYS[name]).count().where(F.col("count") > 1)
