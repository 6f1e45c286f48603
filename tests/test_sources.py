"""Pages, robots, sitemaps and vendor payloads against known answers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rankloom.schemas import read_jdbc
from rankloom.sources import html, robots, vendor

PAGE = """<!DOCTYPE html>
<html lang='de-AT'>
<head><meta charset="utf-8">
  <title>
    Fahrr&auml;der &amp; Werkstatt
    in Graz
  </title>
  <META NAME="description" CONTENT="  Reparatur,
    Verleih &amp; Kurse  ">
  <meta name=robots content="NOFOLLOW">
  <link href="../werkstatt/?ort=graz&amp;art=rad" rel="canonical">
  <meta property="og:site_name" content="Rad &lt;3"><meta property="og:type" content="website">
  <meta name="twitter:site" content="@radgraz">
  <script type='application/ld+json'>{"@context": "x", "@type": "BikeStore", "offers": {"@type": "Offer"}}</script>
  <link rel=alternate hreflang=SL href="/sl/">
</head>
<body><!-- <h1>Entwurf</h1> <a href="/entwurf">x</a> -->
  <h1>Wir\treparieren <em>jedes</em>
  Rad</h1><h1></h1>
  <img src=1.jpg alt=Werkbank><img src=2.jpg alt=" "><img src=3.jpg>
  <p>Montag bis Freitag, acht bis achtzehn Uhr.</p>
  <a href=" kurse.html?tag=1&amp;zeit=9 ">Kurse</a> <a href='//verleih.example.at/' rel='sponsored nofollow'>Verleih</a>
  <a href="tel:+43316">Anruf</a> <a name="oben">oben</a> <a href="#unten">unten</a>
</body></html>"""
PAGE_URL = "https://rad.example.at/steiermark/index.html"


def signals(spark, *bodies):
    df = spark.createDataFrame([(PAGE_URL, b) for b in bodies], "url string, html string")
    return html.page_signals(df).collect()


def test_page_signals(spark):
    (row,) = signals(spark, PAGE)
    # White space inside a title stays, at its ends it goes.
    assert row.title.split() == ["Fahrräder", "&", "Werkstatt", "in", "Graz"] and row.title_length == len(row.title) == len(row.title.strip())
    assert row.meta_description.split() == ["Reparatur,", "Verleih", "&", "Kurse"] and row.meta_description[0] == "R"
    assert row.canonical == "https://rad.example.at/werkstatt/?ort=graz&art=rad"
    assert row.h1_count == 2 and [h.split() for h in row.h1_text] == [["Wir", "reparieren", "jedes", "Rad"], []]
    assert row.language == "de-AT" and (row.images_count, row.images_missing_alt) == (3, 2)
    assert (row.internal_links, row.external_links) == (1, 1)
    assert [(link.to_url, link.rel) for link in row.links] == [
        ("https://rad.example.at/steiermark/kurse.html?tag=1&zeit=9", None), ("https://verleih.example.at/", "sponsored nofollow")]
    assert (row.is_noindex, row.is_nofollow) == (False, True) and row.schema_presence == ["BikeStore", "Offer"]
    assert row.open_graph == {"site_name": "Rad <3", "type": "website"} and row.twitter_cards == {"site": "@radgraz"}
    assert row.hreflang == {"sl": "/sl/"} and len(row.content_hash) == 64


def test_noindex_empty_and_malformed(spark):
    noindex, empty, none, broken = signals(
        spark, "<html><head><meta name='robots' content='noindex'></head></html>", "", None,
        "<title>Open <p><b>bold<a href=x>y<script>var t='</p>'; <h1>late &amp; <i>hurt")
    assert noindex.is_noindex and noindex.title is None
    assert (empty.word_count, none.word_count) == (0, 0) and empty.content_hash == none.content_hash
    assert broken.h1_count == 0 and broken.title_length > 0


def test_text_keeps_comments_and_drops_raw_blocks(spark):
    body = ("<!DOCTYPE html><p>one&nbsp;two</p><!-- note --><style>p{}</style><noscript>hidden<b>shown</b></noscript>"
            "<svg>x<title>label</title></svg> a &lt; b")
    df = spark.createDataFrame([(body,)], "html string")
    from rankloom.functions.text import visible_text

    assert df.select(visible_text(F.col("html"))).first()[0] == "html one two note shown label a < b"


def test_white_space_and_references_in_real_markup(spark):
    (row,) = signals(spark, "<title>\n    Shop | Demo\n</title><meta name=description content='\tAll &amp; more\n'>"
                            '<link rel="canonical" href="\n/list?a=1&amp;b=2 "><meta property="og:title" content="A &amp; B\u00a0">'
                            '<img alt="&nbsp;"><img alt="ok"><h1>\n One\n<b>two</b>\t</h1>')
    assert (row.title, row.title_length, row.meta_description) == ("Shop | Demo", 11, "All & more")
    assert row.canonical.endswith("/list?a=1&b=2") and row.open_graph == {"title": "A & B"}
    assert (row.images_count, row.images_missing_alt, row.h1_text) == (2, 1, ["One two"])


def test_a_reference_without_its_semicolon_is_text(spark):
    (row,) = signals(spark, "<title>One &amp;&amp</title><meta name=description content='a&copy=1 &quot;'><h1>x&quot &#65 &#x42;&notit;</h1>")
    assert (row.title, row.title_length, row.meta_description) == ("One &&amp", 9, 'a&copy=1 "')
    assert row.h1_text == ["x&quot A B&notit;"]


def test_a_script_inside_a_comment_is_no_script(spark):
    (row,) = signals(spark, '<!-- <script> --><p>three words here</p><a href="/x">link</a><script>var a = "<!--";</script><p>tail</p>'
                            '<!-- <script type="application/ld+json">{"@type": "Ghost"}</script> -->')
    assert len(row.links) == 1 and row.schema_presence is None
    from rankloom.functions.text import visible_text

    text = spark.createDataFrame([("<!-- <script> --><p>three words</p><script>x</script>tail",)], "h string").select(visible_text(F.col("h"))).first()[0]
    assert text == "<script> three words tail"


def test_text_directly_in_hidden_elements_is_skipped(spark):
    from rankloom.functions.text import visible_text

    cases = {"<noscript><b>x</b> MID <i>y</i></noscript>z": "x y z", "<noscript>a<br>BR</noscript>q": "q",
             "<p>1</p><template>t<div>2<img src=a>3</div>u</template><svg>s</svg>4": "1 2 3 4"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.t for r in df.select("h", visible_text(F.col("h")).alias("t")).collect()} == cases


def test_tabs_in_robots_files(spark):
    df = spark.createDataFrame([("User-agent:\t*\nDisallow:\t/private\t\nCrawl-delay:\t2",)], "body string").withColumn("site", F.lit(1))
    (row,) = robots.robots_rules(df).collect()
    assert row.disallows == ["/private"] and row.crawl_delay == 2.0


def test_long_and_deep_sitemaps_are_read_whole(spark):
    many = "".join(f"<url><loc>https://h/{i}</loc></url>" for i in range(10_001))
    rows = [(f"s{i}", f"<sitemapindex><sitemap><loc>s{i + 1}</loc></sitemap></sitemapindex>") for i in range(5)]
    rows += [("s5", f"<urlset>{many}</urlset>"), ("wide", "<sitemapindex>" + "".join(f"<sitemap><loc>n{i}</loc></sitemap>" for i in range(101)) + "</sitemapindex>")]
    maps = robots.sitemap_urls(spark.createDataFrame(rows, "url string, body string"))
    assert {r.url: len(r.nested) for r in maps.collect()}["wide"] == 101
    sites = spark.createDataFrame([(1, "https://h", ["s0"])], "site int, origin string, sitemaps array<string>")
    found = robots.sitemap_expand(sites, maps)
    assert found.count() == 10_001 and found.first().depth == 5
    assert robots.sitemap_expand(sites, maps, max_depth=2).count() == 0


def test_repeated_meta_keys_keep_the_last(spark):
    (row,) = signals(spark, '<meta property="og:title" content="a"><meta property="og:title" content="b">'
                            '<meta name="description"><meta name="description" content="second">')
    assert row.open_graph == {"title": "b"} and row.meta_description is None


ROBOTS = {
    "a": "User-agent: *\nDisallow: /admin/\nSitemap: https://example.com/s.xml\n",
    "b": "Disallow: /early\r\nUser-Agent: other\r\nDisallow: /",
    "c": "user-agent: SEObot # us\nDisallow:\nDisallow: /x*\nCrawl-delay: 3\nCrawl-delay: nope\ncrawl-delay: 1.5\nUser-agent: other\nDisallow: /y",
    "d": None,
}


def test_robots_rules(spark):
    df = spark.createDataFrame(list(ROBOTS.items()), "site string, body string")
    rows = {r.site: r for r in robots.robots_rules(df).collect()}
    assert rows["a"].disallows == ["/admin/"] and rows["a"].sitemaps == ["https://example.com/s.xml"]
    assert rows["b"].disallows == ["/early"]
    assert rows["c"].disallows == ["/x*"] and rows["c"].crawl_delay == 3.0
    assert rows["d"].disallows == [] and rows["d"].crawl_delay is None
    paths = spark.createDataFrame([("/blog",), ("/admin/x",), ("/xyz",)], "p string")
    rules = F.array(F.lit("/admin/"), F.lit("/x*"))
    assert [r[0] for r in paths.select(robots.is_allowed(F.col("p"), rules)).collect()] == [True, False, False]


def test_sitemaps(spark):
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = [
        ("s1", f'<?xml version="1.0"?><urlset {space}><url><loc>https://example.com/a</loc></url></urlset>'),
        ("s2", f"<sitemapindex {space}><sitemap><loc> s1 </loc></sitemap></sitemapindex>"),
        ("s3", "<urlset><url><loc>https://cut"), ("s4", "no xml"),
    ]
    maps = robots.sitemap_urls(spark.createDataFrame(rows, "url string, body string"))
    got = {r.url: (r.pages, r.nested) for r in maps.collect()}
    assert got == {"s1": (["https://example.com/a"], []), "s2": ([], ["s1"]), "s3": ([], []), "s4": ([], [])}
    sites = spark.createDataFrame([(1, "https://h", ["s2", "s1"]), (2, "https://h", [])],
                                  "site int, origin string, sitemaps array<string>")
    seeds = robots.sitemap_expand(sites, maps).collect()
    assert [(r.site, r.seed_url, r.depth) for r in seeds] == [(1, "https://example.com/a", 0)]


LANDED = [
    {"type": "paid", "rank_absolute": 2, "url": "https://anzeige.example.at/x", "title": "Rad kaufen", "description": "ad"},
    {"type": "organic", "rank_absolute": 3, "url": "https://WWW.Rad.example.at/verleih", "title": "Verleih", "description": "v"},
    {"type": "organic", "rank_absolute": 7, "url": "https://blog.example.si/", "title": "Blog", "description": "b"},
    {"type": "people_also_ask", "rank_absolute": 4, "items": [{"title": "Was kostet ein Rad?"}, {"title": "Wo?"}]},
    {"type": "unheard_of", "rank_absolute": 9},
]


def test_vendor_results(spark):
    raw = spark.createDataFrame([(31, json.dumps(LANDED))], "serp_search_id int, j string")
    payload = raw.select("serp_search_id", F.from_json("j", vendor.SERP_ITEMS).alias("items"))
    rows = vendor.serp_results(payload).collect()
    assert sorted((r.position, r.domain) for r in rows if r.result_type == "organic") == [(1, "www.rad.example.at"), (2, "blog.example.si")]
    assert [r.position for r in rows if r.result_type == "paid"] == [1] or [r.position for r in rows if r.result_type == "paid"] == [2]
    (feature,) = vendor.serp_features(payload).collect()
    assert (feature.feature_type, feature.position, feature.data.title) == ("people_also_ask", 4, "Was kostet ein Rad?")


def test_vendor_keyword(spark):
    monthly = [{"year": 2023, "month": m, "search_volume": 1000 - m} for m in range(1, 18)]
    items = [{"keyword": "lastenrad", "search_volume": 880, "competition_index": 40, "monthly_searches": monthly},
             {"keyword": "tandem", "monthly_searches": monthly[:3]}, {}]
    raw = spark.createDataFrame([(json.dumps(i),) for i in items], "j string")
    long, short, bare = vendor.keyword_metrics(raw.select(F.from_json("j", vendor.KEYWORD_ITEM).alias("item"))).collect()
    assert (long.keyword, long.search_volume, long.competition, long.cpc) == ("lastenrad", 880, 0.4, None)
    assert long.trend == [m["search_volume"] for m in monthly[5:]] and short.trend == [999, 998, 997]
    assert (bare.keyword, bare.trend, bare.competition) == ("", None, None)


def test_suggestions_are_limited_per_request(spark):
    rows = spark.createDataFrame([(i, i % 2, f"k{i}" if i % 5 else "") for i in range(3000)], "seq int, request int, keyword string")
    assert vendor.suggestion_batch(rows, ["request"], [F.asc("seq")]).count() == 2400
    few = vendor.suggestion_batch(rows, ["request"], [F.asc("seq")], 3).collect()
    assert sorted((r.request, r.seq) for r in few) == [(0, 2), (0, 4), (0, 6), (1, 1), (1, 3), (1, 7)]


def test_landed_search_console_pages(spark, tmp_path):
    for n, key in enumerate(["2024-01-01", "2024-01-02"]):
        row = {"property_id": 1, "batch_seq": n, "row": {"keys": [key, "q", "", "desktop"], "clicks": 3, "impressions": 10}}
        (tmp_path / f"page{n}.json").write_text(json.dumps(row))
    rows = vendor.read_gsc_pages(spark, str(tmp_path), "query").orderBy("date").collect()
    assert [(str(r.date), r.country, r.device, r.clicks, r.ctr) for r in rows] == [
        ("2024-01-01", "all", "DESKTOP", 3, 0.0), ("2024-01-02", "all", "DESKTOP", 3, 0.0)]


def test_landed_pages_are_streamed_once_across_restarts(spark, tmp_path):
    landed, out = tmp_path / "landed", tmp_path / "rows"
    landed.mkdir()

    def land(n):
        rows = [{"property_id": 1, "batch_seq": n, "row": {"keys": [f"2024-01-{n + 1:02d}", f"q{k}", "at", ""], "clicks": k}} for k in range(3)]
        (tmp_path / "page.json").write_text("\n".join(map(json.dumps, rows)))
        (tmp_path / "page.json").rename(landed / f"page{n}.json")

    def run():
        query = (vendor.stream_gsc_pages(spark, str(landed), "query", 2).writeStream.trigger(availableNow=True)
                 .option("checkpointLocation", str(tmp_path / "state")).format("parquet").start(str(out)))
        query.awaitTermination()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    for n in range(5):
        land(n)
    assert run() == [6, 6, 3]
    land(5)
    assert run() == [3] and run() == []
    got = spark.read.parquet(str(out)).select("batch_seq", "date", "query", "clicks")
    want = vendor.read_gsc_pages(spark, str(landed), "query").select("batch_seq", "date", "query", "clicks")
    assert got.count() == 18 and got.exceptAll(want).isEmpty()


def test_a_database_evaluates_filters_of_each_part(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url, driver = "jdbc:derby:memory:landed;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    stored = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("int").alias("project_id"), (F.col("id") * 3).alias("clicks"))
    stored.coalesce(1).write.jdbc(url, "clicks", properties=driver)
    rows = read_jdbc(spark, url, "clicks", "row_id", (0, 1000), 4, {"project_id": 3}, **driver)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(project_id,3)" in plan.replace("PROJECT_ID", "project_id")
    assert rows.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in rows.collect()) == [(i, 3, 3 * i) for i in range(1000) if i % 7 == 3]
