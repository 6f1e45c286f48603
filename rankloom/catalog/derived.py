"""Scans of the derived tables (S1) — equality filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import Tables, query


@query("s1_table_scan", """
    SELECT tracked_keyword_id, keyword, country FROM {tracked_keywords}
    WHERE project_id = 3 AND is_active""")
def table_scan(t: Tables):
    return (t.tracked_keywords.where((F.col("project_id") == 3) & F.col("is_active"))
            .select("tracked_keyword_id", "keyword", "country"))
