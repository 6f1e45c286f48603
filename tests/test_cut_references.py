"""Page and audit queries against their check SQL, over pages whose titles are cut inside a character reference."""

from __future__ import annotations

import glob
import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import connect, difference

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["k12_issue_export", "k12_page_export", "k8_every_instance", "k8_first_500_instances", "k8_q4_instances",
         "q19_every_audit_finding", "q19_from_audit", "q1_site_audit", "s2_f17_crawl_pages", "s2_page_signals",
         "q2_audit_summary", "q31_report_audit_issues"]


@pytest.fixture(scope="module")
def cut_pages(tmp_path_factory):
    """The given tables, but titles and first headings end in '&amp': 30 characters, fewer if that were decoded."""
    folder = str(tmp_path_factory.mktemp("cut"))
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        if os.path.basename(path) != "pages.parquet":
            os.symlink(path, f"{folder}/{os.path.basename(path)}")
    cut = "'Books, toys and games ' || lpad(CAST(page_id AS VARCHAR), 4, '0') || '&amp'"
    connect(SF_DIR).execute(f"""
        COPY (SELECT page_id, url, regexp_replace(regexp_replace(html, '<title>[^<]*</title>', '<title>' || {cut} || '</title>'),
                                                  '<h1>[^<]*</h1>', '<h1>' || {cut} || '</h1>') AS html FROM pages)
        TO '{folder}/pages.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_a_cut_reference_matches_the_check(spark, cut_pages, name):
    assert difference(queries()[name](spark, cut_pages), connect(cut_pages), oracle_sql()[name]) is None
