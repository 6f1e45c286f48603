"""Analyses against known answers and brute force."""

from __future__ import annotations

import csv
import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from rankloom.operators import linkgraph
from rankloom.operators import upsert as UP
from rankloom.operators.ranking import PageIndex, numbered, page_of
from rankloom.operators.rules import catalogue, rule_table, upsert_rules
from rankloom.plans import audit, crawl, gap, gsc, overview, rankings, recommend, serp, usage
from rankloom.plans import keywords as KP
from rankloom.sinks import files

PAGE_SCHEMA = ("crawl_run_id int, url string, normalized_url string, depth int, status_code int, response_time_ms int, "
               "title string, meta_description string, canonical string, h1_count int, word_count int, images_missing_alt int, "
               "is_noindex boolean, is_robots_blocked boolean, schema_presence array<string>, hreflang map<string,string>, "
               "content_hash string, redirect_target string")
LINK_SCHEMA = "crawl_run_id int, from_url string, normalized_to_url string, is_internal boolean"


def page(url, **kw):
    row = {"crawl_run_id": 1, "url": url, "normalized_url": url, "depth": 1, "status_code": 200, "response_time_ms": 100,
           "title": f"A perfectly sized title for {url}"[:60], "meta_description": f"About {url}", "canonical": url, "h1_count": 1,
           "word_count": 500, "images_missing_alt": 0, "is_noindex": False, "is_robots_blocked": False,
           "schema_presence": ["Article"], "hreflang": {}, "content_hash": url, "redirect_target": None}
    row.update(kw)
    return tuple(row[f.split()[0]] for f in PAGE_SCHEMA.split(", "))


def hits(spark, pages, links=()):
    p = spark.createDataFrame(list(pages), PAGE_SCHEMA)
    ls = spark.createDataFrame([(1, a, b, True) for a, b in links], LINK_SCHEMA)
    out = {}
    for r in audit.rule_hits(p, ls).collect():
        out.setdefault(r.code, set()).add(r.url)
    return out


def test_missing_signals(spark):
    got = hits(spark, [page("https://a.com/"), page("https://a.com/bad", title=None, meta_description=" ", h1_count=0, word_count=50,
                                                    images_missing_alt=2, schema_presence=[])], [("x", "https://a.com/"), ("x", "https://a.com/bad")])
    assert got == {c: {"https://a.com/bad"} for c in (
        "TITLE_MISSING", "META_DESCRIPTION_MISSING", "H1_MISSING", "THIN_CONTENT", "MISSING_IMAGE_ALT", "MISSING_STRUCTURED_DATA")}


def test_duplicates_broken_links_and_loops(spark):
    same = {"title": "Zwei Seiten, ein Titel: Werkstatt in Graz", "meta_description": "Gleicher Text", "content_hash": "abc"}
    got = hits(spark, [page("https://a.com/1", **same), page("https://a.com/2", **same), page("https://a.com/gone", status_code=404),
                       page("https://a.com/r1", status_code=301, redirect_target="https://a.com/r2"),
                       page("https://a.com/r2", status_code=301, redirect_target="https://a.com/r1"),
                       page("https://a.com/r3", status_code=301, redirect_target="https://a.com/r1")],
               [("https://a.com/1", "https://a.com/gone"), ("https://a.com/1", "https://a.com/2")])
    both = {"https://a.com/1", "https://a.com/2"}
    assert got["DUPLICATE_TITLE"] == got["DUPLICATE_META_DESCRIPTION"] == got["DUPLICATE_CONTENT"] == both
    assert got["BROKEN_PAGE"] == {"https://a.com/gone"} and got["BROKEN_INTERNAL_LINK"] == {"https://a.com/1"}
    assert got["REDIRECT_LOOP"] == {"https://a.com/r1", "https://a.com/r2"}
    assert got["REDIRECT_CHAIN"] == {"https://a.com/r1", "https://a.com/r2", "https://a.com/r3"}
    assert got["ORPHAN_PAGE"] == {"https://a.com/1"}


def test_other_rules(spark):
    got = hits(spark, [page("https://a.com/", depth=0, status_code=503), page("https://a.com/n", is_noindex=True),
                       page("https://a.com/c", canonical="https://a.com/other"), page("http://a.com/plain"),
                       page("https://a.com/slow", response_time_ms=5000), page("https://a.com/b", is_robots_blocked=True),
                       page("https://a.com/h", hreflang={"en": "x", "EN-us": "y"}), page("https://a.com/t", title="t" * 61, meta_description="m" * 161),
                       page("https://a.com/s", title="short", h1_count=2, canonical=None)])
    assert got["SITE_DOWN"] == {"https://a.com/"} and got["NOINDEX_PAGE"] == {"https://a.com/n"}
    assert got["CANONICAL_CONFLICT"] == {"https://a.com/c"} and got["HTTP_PAGE"] == {"http://a.com/plain"}
    assert got["SLOW_PAGE"] == {"https://a.com/slow"} and got["ROBOTS_BLOCKED"] == {"https://a.com/b"}
    assert got["INVALID_HREFLANG"] == {"https://a.com/h"} and got["TITLE_TOO_LONG"] == {"https://a.com/t"}
    assert got["META_DESCRIPTION_TOO_LONG"] == {"https://a.com/t"} and got["TITLE_TOO_SHORT"] == {"https://a.com/s"}
    assert got["MULTIPLE_H1"] == {"https://a.com/s"} and got["CANONICAL_MISSING"] == {"https://a.com/s"}


def scores(spark, rows, pages):
    issue_rows = spark.createDataFrame([(1, s, "Metadata", n) for s, n in rows], "crawl_run_id int, severity string, category string, affected_count long")
    runs = spark.createDataFrame([(1, pages)], "crawl_run_id int, pages_crawled int")
    buckets = audit.bucket_scores(issue_rows, runs)
    return {r.bucket: r.score for r in buckets.collect()}, audit.health(buckets).first().health_score


def test_scores(spark):
    assert scores(spark, [], 10)[1] == 100.0
    one, health = scores(spark, [("ERROR", 1)], 10)
    assert one["metadata"] == 97.5 and one["links"] == 100.0 and health == 99.6
    assert scores(spark, [("CRITICAL", 5), ("CRITICAL", 5)], 5)[0]["metadata"] == 0.0


def test_rule_catalogue(spark):
    fresh = rule_table(spark)
    assert fresh.count() == len(catalogue()) == 26
    off = fresh.withColumn("enabled", F.col("code") != "SLOW_PAGE")
    assert upsert_rules(off, fresh).where("not enabled").select("code").first()[0] == "SLOW_PAGE"


def test_instances_are_complete_unless_a_listing_asks_for_fewer(spark):
    rows = spark.createDataFrame([(1, f"https://a.com/{i:04d}", "HTTP_PAGE") for i in range(700)], "crawl_run_id int, url string, code string")
    assert audit.instances(rows).count() == 700
    assert audit.instances(rows, 500).count() == 500
    assert audit.issues(rows, rule_table(spark)).first().affected_count == 700


def test_find_rank(spark):
    results = spark.createDataFrame([
        (1, 1, "organic", "other.com", "o"), (1, 2, "organic", "www.Example.com", "p"), (1, 1, "paid", "example.com", "ad"),
        (2, 1, "organic", "blog.example.com", "b"), (3, 4, "organic", "com", "c"), (3, 5, "organic", "notexample.com", "n")],
        "serp_search_id int, position int, result_type string, domain string, url string")
    searches = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "serp_search_id int, project_id int")
    targets = spark.createDataFrame([(9, 1, "example.com"), (9, 2, "www.shop.example.com"), (9, 3, "missing.org")],
                                    "project_id int, competitor_id int, domain string")
    got = {(r.serp_search_id, r.competitor_id): (r.rank, r.url) for r in serp.find_ranks(results, searches, targets, "competitor_id").collect()}

    def fold(d):
        return d.lower().removeprefix("www.")

    want = {}
    for s, pos, kind, host, url in [tuple(r) for r in results.collect()]:
        for _, cid, target in [tuple(r) for r in targets.collect()]:
            h, t = fold(host), fold(target)
            if kind == "organic" and (h == t or h.endswith("." + t) or t.endswith("." + h)):
                want[(s, cid)] = min(want.get((s, cid), (999, "")), (pos, url))
    assert got == want and got[(1, 1)] == (2, "p")


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_movement(spark):
    rows = [(1, at(1), 1, 9, "a"), (1, at(2), 2, None, "b"), (1, at(3), 3, 5, "c"), (2, at(1), 4, 7, "d"), (2, at(2), 5, None, "e")]
    rows += [(3, at(1) + dt.timedelta(hours=i), 100 + i, 1 if i == 0 else 10, "f") for i in range(61)]
    obs = spark.createDataFrame(rows, "tracked_keyword_id int, observed_at timestamp_ntz, event_id int, rank int, ranking_url string")
    got = {r.tracked_keyword_id: r for r in rankings.movement(obs).collect()}
    assert (got[1].current_rank, got[1].previous_rank, got[1].change, got[1].best_rank, got[1].worst_rank, got[1].current_url) == (5, 9, 4, 5, 9, "c")
    assert (got[2].current_rank, got[2].previous_rank, got[2].change) == (None, 7, None)
    assert (got[3].observations, got[3].best_rank) == (61, 1)
    # The oldest observation, the only rank 1, is out of sight of the newest 60.
    newest = {r.tracked_keyword_id: r for r in rankings.movement(obs, newest=60).collect()}
    assert (newest[3].observations, newest[3].best_rank) == (60, 10)


@pytest.fixture()
def gap_rows(spark):
    tracked = spark.createDataFrame([(i, 1, 1, k, k, "US", "en", "DESKTOP", None, True) for i, k in enumerate(["achse", "bremse", "gabel", "deichsel"])],
                                    "tracked_keyword_id int, project_id int, organization_id int, keyword string, normalized_keyword string, "
                                    "country string, language string, device string, keyword_id int, is_active boolean")
    obs = spark.createDataFrame([(0, at(1), 1, 18, ""), (2, at(1), 2, 2, "")],
                                "tracked_keyword_id int, observed_at timestamp_ntz, event_id int, rank int, ranking_url string")
    searches = spark.createDataFrame([(10, 1, "Achse!", "US", "DESKTOP", at(2)), (11, 1, "bremse", "US", "DESKTOP", at(2)), (12, 1, "gabel", "US", "DESKTOP", at(2)),
                                      (13, 1, "achse", "US", "DESKTOP", at(1)), (14, 1, "deichsel", "GB", "DESKTOP", at(1))],
                                     "serp_search_id int, project_id int, keyword string, country string, device string, searched_at timestamp_ntz")
    results = spark.createDataFrame([(10, 3, "organic", "rival.com", "r1"), (11, 3, "organic", "www.rival.com", "r2"), (12, 9, "organic", "rival.com", "r3"),
                                     (13, 1, "organic", "rival.com", "old"), (14, 1, "organic", "rival.com", "gb")],
                                    "serp_search_id int, position int, result_type string, domain string, url string")
    comps = spark.createDataFrame([(1, 5, "rival.com", "rival", True), (1, 6, "idle.com", "idle", False)],
                                  "project_id int, competitor_id int, domain string, label string, is_active boolean")
    batch = spark.createDataFrame([(1, 1, None, "us", "EN", " Buy Achse", 80000, 1.0, 0.1, "v", at(1).date()), (2, 1, None, "us", "EN", "achse", 80000, 1.0, 0.1, "v", at(1).date())],
                                  "seq long, organization_id int, project_id int, country string, language string, keyword string, search_volume long, "
                                  "cpc double, competition double, provider string, created_on date")
    items = KP.clean_batch(batch)
    keywords = KP.stored_keywords(items)
    metrics, intents = KP.metric_snapshots(items, keywords), KP.keyword_intents(items, keywords)
    ranks = gap.competitor_ranks(tracked, searches, results, comps)
    return gap.keyword_gap(tracked, obs, searches, results, comps, keywords, metrics, intents, ranks), ranks, comps, searches, results


def test_gap_buckets(gap_rows):
    rows, ranks, comps, searches, results = gap_rows
    got = {r.keyword: r for r in rows.collect()}
    assert {k: r.bucket for k, r in got.items()} == {"achse": "weak", "bremse": "missing", "gabel": "strong", "deichsel": "shared"}
    assert (got["achse"].best_competitor_rank, got["achse"].search_volume) == (3, 80000)
    assert got["bremse"].difficulty is None and got["bremse"].opportunity == 0.0
    assert [r.keyword for r in gap.filter_gap(rows, max_difficulty=100).collect()] == ["achse"]
    assert [r.keyword for r in page_of(rows, gap.gap_order(), size=2).collect()] == ["achse", "bremse"]
    wide = {r.keyword: r.comp_rival for r in gap.gap_matrix(rows, ranks, comps, "label", ["rival"]).collect()}
    assert wide == {"achse": 3, "bremse": 3, "gabel": 9, "deichsel": None}
    seen = serp.competitor_overview(results.where("serp_search_id < 13"), searches.where("serp_search_id < 13"), comps.where("is_active"))
    assert (seen.first().serp_appearances, seen.first().avg_position) == (3, 5.0)


GSC_SCHEMA = "property_id int, date date, query string, country string, device string, batch_seq int, clicks int, impressions int, position double"


def test_search_console(spark):
    rows = spark.createDataFrame([(1, at(1).date(), "q", "usa", "DESKTOP", 1, 31, 900, 6.0), (1, at(2).date(), "q", "usa", "DESKTOP", 2, 14, 700, 9.0)], GSC_SCHEMA)
    total = gsc.totals(rows, F.lit("2024-01-10").cast("date")).first()
    assert (total.clicks, total.impressions, total.avg_position) == (45, 1600, 7.5)
    assert gsc.daily(rows, F.lit("2024-01-10").cast("date")).count() == 2
    again = UP.upsert(rows, rows.withColumn("clicks", F.lit(99)), gsc.QUERY_GRAIN, [F.desc("batch_seq")])
    assert [r.clicks for r in again.collect()] == [99, 99]
    stats = UP.upsert_stats(rows, rows, gsc.QUERY_GRAIN, ["property_id"]).first()
    assert (stats.inserted, stats.updated) == (0, 2)


def test_recommendations(spark):
    rows = spark.createDataFrame(
        [(1, at(5).date(), "near", "usa", "D", 1, 5, 2100, 8.0), (1, at(5).date(), "fall", "usa", "D", 2, 100, 100, 30.0),
         (1, at(28).date(), "fall", "usa", "D", 3, 40, 100, 30.0)], GSC_SCHEMA)
    props = spark.createDataFrame([(1, 7, True)], "property_id int, project_id int, is_selected boolean")
    near = recommend.from_striking_distance(rows, props).collect()
    assert [(r.related_keyword, r.score, r.description) for r in near] == [("near", 26.3, "Position 8.0 with 2,100 impressions but 0.2% CTR.")]
    fall = recommend.from_decliners(rows, props, F.lit("2024-02-20").cast("date")).collect()
    assert [(r.related_keyword, r.description) for r in fall] == [("fall", "Clicks fell from 100 to 40 in 28 days.")]
    old = spark.createDataFrame([(7, "OPEN", "old"), (7, "DISMISSED", "kept")], "project_id int, status string, title string")
    kept = recommend.recalculate(old, [recommend.from_striking_distance(rows, props)])
    assert {r.title for r in kept.collect()} == {"kept", "Striking-distance query needs CTR work: near"}
    moved = UP.change_status(old.withColumn("id", F.col("title")), spark.createDataFrame([("old", "COMPLETED"), ("kept", "nonsense")], "id string, new_status string"), "id")
    assert {(r.id, r.status) for r in moved.collect()} == {("old", "COMPLETED"), ("kept", "DISMISSED")}


def test_gap_recommendations(gap_rows):
    rows = gap_rows[0].withColumn("opportunity", F.when(F.col("keyword") == "bremse", 72.0).otherwise(F.col("opportunity")))
    (reco,) = recommend.from_gap(rows).collect()
    assert (reco.title, reco.description) == ("Close the gap on: bremse", "Competitors rank #3 while you are at #–.")


def test_shared_keywords_reach_every_project_once(spark):
    scored = spark.createDataFrame([(i, 1, None, f"k{i:04d}", f"k{i:04d}", 1000, 20.0, "LOCAL", 40.0 + i % 50) for i in range(300)] + [(999, 1, 5, "own", "own", 900, 1.0, "LOCAL", 99.0)],
                                   "keyword_id int, organization_id int, project_id int, keyword string, normalized_keyword string, search_volume long, difficulty double, intent string, opportunity double")
    projects = spark.createDataFrame([(p, 1, False) for p in range(1, 7)], "project_id int, organization_id int, is_deleted boolean")
    tracked = spark.createDataFrame([(p, f"k{i:04d}") for p in range(1, 7) for i in range(0, 300, p)], "project_id int, normalized_keyword string")
    got = {}
    for r in recommend.from_keywords(scored, tracked, projects).collect():
        got.setdefault(r.project_id, set()).add(r.related_keyword)
    taken = {(r.project_id, r.normalized_keyword) for r in tracked.collect()}
    for p in range(1, 7):
        rows = [r for r in scored.collect() if r.project_id in (None, p) and (p, r.normalized_keyword) not in taken]
        best = sorted(rows, key=lambda r: (-r.opportunity, r.keyword))[:10]
        assert got.get(p, set()) == {r.keyword for r in best}


def test_every_untracked_keyword_is_recommended_without_a_bound(spark):
    scored = spark.createDataFrame([(i, 1, None, f"k{i:04d}", f"k{i:04d}", 1000, 20.0, "LOCAL", 39.0 + i % 50) for i in range(300)] + [(999, 1, 5, "own", "own", 900, 1.0, "LOCAL", 99.0), (998, 1, 5, "rare", "rare", 499, 1.0, "LOCAL", 99.0)],
                                   "keyword_id int, organization_id int, project_id int, keyword string, normalized_keyword string, search_volume long, difficulty double, intent string, opportunity double")
    projects = spark.createDataFrame([(5, 1, False), (6, 1, False), (7, 1, True), (8, 2, False)], "project_id int, organization_id int, is_deleted boolean")
    tracked = spark.createDataFrame([(5, f"k{i:04d}") for i in range(0, 300, 3)], "project_id int, normalized_keyword string")
    got = sorted((r.project_id, r.related_keyword) for r in recommend.from_keywords(scored, tracked, projects, n=None).collect())
    good = [f"k{i:04d}" for i in range(300) if i % 50]
    assert got == sorted([(5, k) for k in good if int(k[1:]) % 3] + [(5, "own")] + [(6, k) for k in good])


def test_report_keywords_are_complete_unless_a_listing_asks_for_fewer(spark):
    rows = [(i, 1, None, f"s{i:04d}", "LOCAL", 10, 0.1, 20.0, float(i % 90), "v") for i in range(600)]
    rows += [(1000 + i, 1, 1, f"o{i:04d}", "LOCAL", 10, 0.1, 20.0, None, "v") for i in range(550)] + [(5000, 2, None, "else", "LOCAL", 10, 0.1, 20.0, 5.0, "v")]
    scored = spark.createDataFrame(rows, "keyword_id int, organization_id int, project_id int, keyword string, intent string, search_volume long, "
                                         "cpc double, difficulty double, opportunity double, provider string")
    projects = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "project_id int, organization_id int")
    got = sorted((r.project_id, r.keyword) for r in overview.section_keywords(scored, projects).collect())
    shared, own = [f"s{i:04d}" for i in range(600)], [f"o{i:04d}" for i in range(550)]
    assert got == [*[(1, k) for k in own + shared], *[(2, k) for k in shared], (3, "else")]
    best = sorted(range(600), key=lambda i: (-(i % 90), i))[:500]
    short = {(r.project_id, r.keyword) for r in overview.section_keywords(scored, projects, 500).collect()}
    assert short == {(p, f"s{i:04d}") for p in (1, 2) for i in best} | {(3, "else")}


def test_duplicate_marks_on_parsed_pages(spark):
    rows = [(1, i, f"https://a.com/{i}", "<p>same</p>" if i < 3 else f"<p>{i}</p>", 200, None, "text/html", None, False) for i in range(5)]
    fetched = spark.createDataFrame(rows, "crawl_run_id int, page_id int, url string, html string, status_code int, error string, "
                                          "content_type string, redirect_target string, is_robots_blocked boolean")
    marked = audit.mark_duplicates(crawl.crawl_pages(fetched))
    assert {r.page_id for r in marked.where("is_duplicate").collect()} == {0, 1, 2}


def test_numbered_equals_row_number(spark):
    # The group without a key spans several slices and is full of copies.
    data = [(None if i % 4 else 1 + i % 3, (i * 7919) % 50, "copy" if i % 2 else f"u{i:05d}") for i in range(2000)]
    rows = spark.createDataFrame(data, "g int, o int, u string")
    got = numbered(rows, ["g"], [F.asc("o"), F.desc("u")], "n").collect()
    assert len(got) == 2000
    for g in (None, 1, 2, 3):
        numbers = {r.n: (r.o, r.u) for r in got if r.g == g}
        plain = sorted((d[1:] for d in data if d[0] == g), key=lambda d: d[1], reverse=True)
        plain.sort(key=lambda d: d[0])
        assert [numbers[i + 1] for i in range(len(plain))] == plain


def test_click_depth_equals_breadth_first_search(spark):
    edges = [(f"u{i}", f"u{j}") for i in range(60) for j in ((i * 2 + 1) % 80, (i + 7) % 80, 0)]
    links = spark.createDataFrame([(1, a, b) for a, b in edges], "crawl_run_id int, from_url string, to_url string")
    seeds = spark.createDataFrame([(1, "u0", 0), (1, "u50", 1), (1, "lonely", 1)], "crawl_run_id int, url string, depth int")
    got = {r.url: r.depth for r in linkgraph.click_depth(seeds, links).collect()}
    want, level, depth = {"u0": 0}, {"u0"}, 0
    while level or depth < 1:
        depth += 1
        level = {b for a, b in edges if a in level} | ({"u50", "lonely"} if depth == 1 else set())
        level = {u for u in level if u not in want}
        want.update({u: depth for u in level})
    assert got == want


def test_click_depth_of_a_long_chain(spark, monkeypatch):
    # Visited tables are merged several times over; each level holds one URL, and links back are plenty.
    monkeypatch.setattr(linkgraph, "SALTS", 1)
    monkeypatch.setattr(linkgraph, "FAN_IN", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        edges = [(1, f"u{i}", f"u{j}") for i in range(24) for j in (i + 1, i // 2, 0)] + [(2, "a", "b"), (2, "b", "c"), (2, "c", "d")]
        links = spark.createDataFrame(edges, "crawl_run_id int, from_url string, to_url string").coalesce(1)
        seeds = spark.createDataFrame([(1, "u0", 0), (2, "a", 0)], "crawl_run_id int, url string, depth int").coalesce(1)
        got = {(r.crawl_run_id, r.url): r.depth for r in linkgraph.click_depth(seeds, links).collect()}
        assert got == {(1, f"u{i}"): i for i in range(25)} | {(2, u): n for n, u in enumerate("abcd")}
        capped = {(r.crawl_run_id, r.url): r.depth for r in linkgraph.click_depth(seeds, links, max_pages=3).collect()}
        assert capped == {(1, "u0"): 0, (1, "u1"): 1, (1, "u2"): 2, (2, "a"): 0, (2, "b"): 1, (2, "c"): 2}
        assert not [t for t in spark.catalog.listTables() if t.name.startswith(("visited", "edges"))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_duplicates_and_frontier(spark):
    pages = spark.createDataFrame([(1, "a", "h1"), (1, "b", "h1"), (2, "c", "h1"), (1, "d", None)], "crawl_run_id int, url string, content_hash string")
    assert {r.url for r in audit.mark_duplicates(pages).where("is_duplicate").collect()} == {"a", "b"}
    frontier = spark.createDataFrame([(1, "n", 2, 5), (1, "n", 1, 9), (1, "m", 1, 3)], "crawl_run_id int, normalized_url string, depth int, seq int")
    assert {(r.normalized_url, r.depth, r.seq) for r in linkgraph.dedup_frontier(frontier).collect()} == {("n", 1, 9), ("m", 1, 3)}


def test_cache_lookup(spark):
    cache = spark.createDataFrame([("k", 1, at(1)), ("k", 2, at(20)), ("old", 3, at(1))], "cache_key string, serp_search_id int, searched_at timestamp_ntz")
    asked = spark.createDataFrame([("k", False), ("k", True), ("old", False), ("new", False)], "cache_key string, force_refresh boolean")
    got = {(r.cache_key, r.force_refresh): (r.from_cache, r.reused_search_id) for r in serp.cache_lookup(asked, cache, F.lit("2024-01-25").cast("timestamp_ntz")).collect()}
    assert got == {("k", False): (True, 2), ("k", True): (False, None), ("old", False): (False, None), ("new", False): (False, None)}


def test_add_or_reactivate(spark):
    old = spark.createDataFrame([(1, "a.com", "keep", True), (1, "b.com", "gone", False), (1, "c.com", "off", False)], "project_id int, domain string, label string, is_active boolean")
    asked = spark.createDataFrame([(1, "a.com", "x", 1), (1, "b.com", "", 2), (1, "c.com", "new", 3), (1, "d.com", "add", 4), (1, "d.com", "late", 5)],
                                  "project_id int, domain string, label string, request_seq int")
    got = {r.domain: (r.label, r.is_active) for r in UP.add_or_reactivate(old, asked, ["project_id", "domain"], ["label"]).collect()}
    assert got == {"a.com": ("keep", True), "b.com": ("gone", True), "c.com": ("new", True), "d.com": ("add", True)}


def test_coverage_and_exports(spark):
    log = spark.createDataFrame([(1, 0, None, 200, False), (1, 10_000_000, "timeout", 0, False), (1, 200_000_000, None, 404, True)],
                                "crawl_run_id int, fetched_us long, error string, status_code int, is_robots_blocked boolean")
    row = crawl.coverage(log, spark.createDataFrame([(1, 6)], "crawl_run_id int, pages_discovered long")).first()
    assert (row.pages_crawled, row.pages_failed, row.pages_blocked, row.percent_done, row.is_partial) == (3, 2, 1, 50, True)
    made = spark.createDataFrame([(1, at(1)), (2, at(20))], "id int, created_at timestamp_ntz")
    state = {r.id: r.is_expired for r in usage.export_state(made, F.lit("2024-01-21").cast("date")).collect()}
    assert state == {1: True, 2: False}


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b", None), (1, 'say "x"\nagain', 2), (2, "c", 3)], "project_id bigint, keyword string, volume int")
    projects = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "project_id bigint, name string")
    sections = {"Names": files.Section(projects, [F.asc("name")]),
                "Keyword gap": files.Section(rows, [F.asc("keyword")], ["(none)", ""]),
                "Some": files.Section(rows.select("project_id", "volume"), [F.asc("volume")], owners=projects.where("project_id = 2"))}
    for n in (4, files.LINES_PER_FILE):
        path = str(tmp_path / f"report{n}")
        files.write_report(sections, projects, path, n)
        text = {}
        for i in (1, 2, 3):
            parts = sorted(glob.glob(f"{path}/project_id={i}/part=*/*.txt"), key=lambda f: int(f.split("part=")[1].split("/")[0]))
            text[i] = "".join(open(f, newline="").read() for f in parts)
        assert list(csv.reader(text[1].split("\r\n")))[:-1] == [
            ["# Names"], ["name"], ["x"], [], ["# Keyword gap"], ["keyword", "volume"], ["a,b", ""], ['say "x"\nagain', "2"], []]
        assert text[2] == "# Names\r\nname\r\ny\r\n\r\n# Keyword gap\r\nkeyword,volume\r\nc,3\r\n\r\n# Some\r\nvolume\r\n3\r\n\r\n"
        assert text[3].endswith("# Keyword gap\r\nkeyword,volume\r\n(none),\r\n\r\n")
        back = files.read_report(spark, path, n).where("project_id = 2").orderBy("line_no").collect()
        assert [r.line_no for r in back] == list(range(12)) and back[6].line == "c,3"


def test_reports_have_the_sections_of_their_type(spark):
    projects = spark.createDataFrame([(1, "a", "a.com", "US", "en", "D"), (2, "b", "b.com", "US", "en", "D")],
                                     "project_id bigint, name string, domain string, country string, language string, device string")
    summary = spark.createDataFrame([(1, 93.1, 41, 2)], "project_id bigint, health_score double, pages_crawled int, rules_firing int")
    issues = spark.createDataFrame([(1, "R1", "ERROR", "META", 3, "x"), (1, "R2", "ERROR", "META", 9, "y")],
                                   "project_id bigint, rule string, severity string, category string, affected int, recommendation string")
    built = []
    builders = {title: (lambda title=title, rows=rows: built.append(title) or rows) for title, rows in
                {"Project": overview.section_project(projects), "Audit summary": summary, "Audit issues": issues, "Keywords": None}.items()}
    lines = files.report_lines(overview.report("AUDIT", builders, projects), projects).orderBy("line_no").collect()
    assert built == ["Project", "Audit summary", "Audit issues"]
    own = {i: [r.line for r in lines if r.project_id == i] for i in (1, 2)}
    assert own[1][8:] == ["# Audit summary", "health_score,pages_crawled,rules_firing", "93.1,41,2", "", "# Audit issues",
                          "rule,severity,category,affected,recommendation", "R2,ERROR,META,9,y", "R1,ERROR,META,3,x", ""]
    assert own[2][8:] == ["# Audit", "info", "no completed audit", ""]
    assert set(overview.REPORT_SECTIONS) == {"SEO_OVERVIEW", "AUDIT", "KEYWORDS", "RANKINGS", "COMPETITORS"}


def test_deep_pages_open_their_slices_only(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7 % 10).alias("v"))
    index = PageIndex(rows.repartition(4), [F.desc("v"), F.asc("id")])
    want = [r.id for r in rows.orderBy(F.desc("v"), "id").collect()]
    for page, size in ((1, 50), (7, 33), (100, 10), (31, 33), (500, 10), (0, 5)):
        got = index.page(page, size).collect()
        assert [r.id for r in got] == want[(max(page, 1) - 1) * size:][:size] and all(r.total == 1000 for r in got)
    assert PageIndex(rows.limit(0), [F.asc("id")]).page(1).count() == 0


def test_replacing_a_run_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "results")
    files.replace_runs(spark.createDataFrame([(1, "a"), (2, "b")], "crawl_run_id int, url string"), path)
    files.replace_runs(spark.createDataFrame([(2, "c")], "crawl_run_id int, url string"), path)
    assert {(r.crawl_run_id, r.url) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    files.append_rows(spark.createDataFrame([(3, "d")], "crawl_run_id int, url string"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_stored_tables(spark, tmp_path):
    from rankloom import schemas

    root = str(tmp_path)
    for name, ddl in schemas.TABLES.items():
        empty = spark.createDataFrame([], ddl)
        assert set(schemas.NATURAL_KEYS.get(name, [])) <= set(empty.columns)
        assert set(schemas.PARTITIONS.get(name, [])) <= set(empty.columns)
    rows = spark.createDataFrame([("p", at(1).date(), "q", "usa", "D", 1, 2, 0.5, 3.0)] * 2 + [("p", at(2).date(), "q", "usa", "D", 1, 2, 0.5, 3.0)],
                                 schemas.TABLES["gsc_query_data"])
    schemas.write_table(rows, root, "gsc_query_data")
    assert schemas.read_table(spark, root, "gsc_query_data", date=at(2).date()).count() == 1
    assert schemas.duplicate_keys(schemas.read_table(spark, root, "gsc_query_data"), "gsc_query_data").count() == 1


def test_jdbc_reads_in_parts_with_pushed_filters(spark, tmp_path):
    from rankloom import schemas

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(200).select(F.col("id").alias("TRACKED_KEYWORD_ID"), (F.col("id") % 3).alias("PROJECT_ID"), F.concat(F.lit("k"), F.col("id")).alias("KEYWORD"))
    rows.write.format("jdbc").options(url=url, dbtable="TRACKED").save()
    read = schemas.read_jdbc(spark, url, "TRACKED", "TRACKED_KEYWORD_ID", (0, 200), 4, equal={"PROJECT_ID": 1})
    assert read.rdd.getNumPartitions() == 4
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(PROJECT_ID,1)" in plan.replace(" ", "")
    assert sorted(r.TRACKED_KEYWORD_ID for r in read.collect()) == list(range(1, 200, 3))


def test_every_spelling_of_an_address_is_seen(spark):
    from rankloom.functions import urls as U

    same = ["127.0.0.1", "127.1", "127.0.1", "2130706433", "0x7f.1", "0x7f000001", "0177.0.0.1", "017700000001", "0x7F.0.0.1", "127.0.0.1.", "00000177.1", "0x0000007f.0.0.0x1"]
    other = ["8.8.8.8", "134744072", "0x8.8.8.8", "127.example.com", "1.2.3.4.5", "256.1.1.1", "127.0.0.256", "4294967296", "08.1.1.1", "127..1", "0x7g.1", "99999999999999999999"]
    rows = spark.createDataFrame([(h,) for h in same + other], "host string").select("host", U.url_reject_reason(F.concat(F.lit("http://"), "host", F.lit("/"))).alias("reason"))
    assert {r.host for r in rows.where("reason = 'private_ip'").collect()} == set(same)


def test_a_trend_is_scaled_on_its_own_row(spark):
    from rankloom.plans.keywords import trend_shares

    rows = spark.createDataFrame([(1, [2, None, 8]), (2, [0]), (3, [None]), (4, None)], "keyword_id int, trend array<bigint>")
    shares = trend_shares(rows)
    assert sorted((tuple(r) for r in shares.collect()), key=str) == [
        (1, 0, 2, 0.25), (1, 1, None, None), (1, 2, 8, 1.0), (2, 0, 0, 0.0), (3, 0, None, None)]
    # A row for each key on the driver is what a broadcast of the largest months came to.
    assert "Join" not in shares._jdf.queryExecution().toString()


def test_numbering_moves_rows_once_after_slicing(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("g"), F.col("id").alias("o"))
    ranked = numbered(rows, ["g"], [F.asc("o")], "n")
    want = {}
    for r in sorted(ranked.collect(), key=lambda r: r.o):
        want[r.g] = want.get(r.g, 0) + 1
        assert r.n == want[r.g]
    assert want == {None: 1000, 0: 1000, 1: 2000}
    # One row for each slice at most is added by a join that leaves the others in place.
    assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_one_table_is_refreshed_without_the_other(spark, tmp_path):
    from rankloom.sinks.manifest import RangedTable

    features = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "serp_search_id long, feature_type string")
    table = RangedTable(spark, str(tmp_path / "f"), "serp_search_id", ["feature_type"])
    table.create(features)
    arrived = spark.createDataFrame([(1, "k", dt.datetime(2024, 1, 1)), (2, "k", dt.datetime(2024, 1, 2))],
                                    "serp_search_id long, cache_key string, searched_at timestamp_ntz")
    serp.refresh_snapshots(arrived, [(table, features)])
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "b"), (3, "c")]


def test_only_items_of_used_searches_are_numbered(spark):
    market = "project_id long, normalized_keyword string, country string, device string"
    tracked = spark.createDataFrame([(7, True, 1, "k", "US", "D"), (8, False, 1, "x", "US", "D")], "tracked_keyword_id long, is_active boolean, " + market)
    at = dt.datetime(2024, 1, 1)
    searches = spark.createDataFrame([(i, 1, k, "US", "D", at + dt.timedelta(days=i)) for i, k in ((1, "k"), (2, "K"), (3, "x"))],
                                     "serp_search_id long, project_id long, keyword string, country string, device string, searched_at timestamp_ntz")
    used = gap.used_searches(tracked, searches)
    assert [tuple(r) for r in used.collect()] == [(7, 2, 1)]
    items = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1)], "serp_search_id long, rank_absolute int")
    assert sorted(tuple(r) for r in gap.items_of(used, items).collect()) == [(2, 1), (2, 2)]


def test_a_report_computes_each_section_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    @F.udf("string")
    def named(i):
        with open(log, "a") as out:
            out.write(f"{i}\n")
        return f"row {i}"

    rows = spark.range(6, numPartitions=1).select((F.col("id") % 2).alias("project_id"), named("id").alias("name"))
    projects = spark.range(3).select(F.col("id").alias("project_id"))
    lines = files.report_lines({"A": files.Section(rows, [F.asc("name")], ["(none)"]), "B": files.Section(rows.limit(0), [F.asc("name")])}, projects)
    got = {p: [r.line for r in sorted(lines.where(F.col("project_id") == p).collect(), key=lambda r: r.line_no)] for p in (0, 2)}
    assert got == {0: ["# A", "name", "row 0", "row 2", "row 4", "", "# B", "name", ""], 2: ["# A", "name", "(none)", "", "# B", "name", ""]}
    with open(log) as calls:
        assert len(calls.read().split()) == 6
