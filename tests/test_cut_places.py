"""Page and audit queries against their check SQL, over titles cut at every place of a character reference."""

from __future__ import annotations

import glob
import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import connect, difference

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
PLACES = [name[:n] for name in ("&amp;", "&quot;") for n in range(1, len(name) + 1)]
NAMES = ["k12_page_export", "k8_every_instance", "s2_f17_crawl_pages", "s2_page_signals"]


@pytest.fixture(scope="module")
def cut_pages(tmp_path_factory):
    """The given tables, but titles and first headings end in '&', '&a' and so on up to '&quot;', a page each in turn."""
    folder = str(tmp_path_factory.mktemp("places"))
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        if os.path.basename(path) != "pages.parquet":
            os.symlink(path, f"{folder}/{os.path.basename(path)}")
    ends = ", ".join(f"'{end}'" for end in PLACES)
    cut = f"'Books, toys and games ' || lpad(CAST(page_id AS VARCHAR), 4, '0') || [{ends}][1 + page_id % {len(PLACES)}]"
    connect(SF_DIR).execute(f"""
        COPY (SELECT page_id, url, regexp_replace(regexp_replace(html, '<title>[^<]*</title>', '<title>' || {cut} || '</title>'),
                                                  '<h1>[^<]*</h1>', '<h1>' || {cut} || '</h1>') AS html FROM pages)
        TO '{folder}/pages.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_every_place_matches_the_check(spark, cut_pages, name):
    assert difference(queries()[name](spark, cut_pages), connect(cut_pages), oracle_sql()[name]) is None
