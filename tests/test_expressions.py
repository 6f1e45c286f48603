"""Scalar expressions against known answers."""

from __future__ import annotations

import urllib.parse

import pytest
from pyspark.sql import functions as F

from rankloom.functions import keywords as K
from rankloom.functions import scores as S
from rankloom.functions import text as T
from rankloom.functions import urls as U


def values(spark, rows, expression, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_normalize_url(spark):
    cases = {
        "https://Example.COM/Path/?utm_source=x&a=1#frag": "https://example.com/Path/?a=1",
        "http://example.com:80/": "http://example.com/",
        "https://example.com": "https://example.com/",
        "https://example.com:443/a;b/c;d=1": "https://example.com/a;b/c",
        "HTTPS://u:p@Example.com:8443/x?b=&&c": "https://example.com:8443/x?b=&c=",
        "http://example.com/?q=a%20b+c&GCLID=1&r=%zz": "http://example.com/?q=a+b+c&r=%25zz",
        " http://example.com/a b ": "http://example.com/a b",
        "http://example.com:bad/": None,
        None: None,
    }
    assert values(spark, list(cases), U.normalize_url(F.col("x"))) == list(cases.values())


def test_query_encoding_agrees_with_the_standard_library(spark):
    raw = ["a=1&b=%7E*&c=é", "x=%E4%BD%A0&y=a/b?c", "k%20k=v+v&=z&w"]
    urls = [f"http://h.example/?{q}" for q in raw]
    expected = ["http://h.example/?" + urllib.parse.urlencode(urllib.parse.parse_qsl(q, keep_blank_values=True))
                for q in raw]
    assert values(spark, urls, U.normalize_url(F.col("x"))) == expected


def test_same_site(spark):
    pairs = [("example.com", "www.example.com"), ("www.example.com", "example.com"),
             ("example.com", "evil.com"), ("example.com", "sub.example.com"), ("", "")]
    got = values(spark, pairs, U.same_site(F.col("a"), F.col("b")), "a string, b string")
    assert got == [True, True, False, False, False]


UNSAFE = {
    "private_ip": ["https://10.255.0.9/a", "http://172.31.0.1:81/", "http://192.168.77.3", "http://100.64.9.9/", "http://198.19.255.255/x?y",
                   "http://169.254.0.7/", "http://127.255.255.254/", "http://0.1.2.3/", "http://255.255.255.255/"],
    "blocked_host": ["https://LOCALHOST./", "http://api.localhost:3000/"], "scheme": ["gopher://a.at/", "data:text/html,x", "//rad.at/", "mailto:x@y.at"],
    "userinfo": ["https://me@rad.at/"], "no_host": ["https:///path"], "length": ["", None, "http://rad.at/" + "x" * 2000],
}


def test_unsafe_urls_are_rejected(spark):
    for reason, urls in UNSAFE.items():
        df = spark.createDataFrame([(u,) for u in urls], "x string")
        assert [r[0] for r in df.select(U.url_reject_reason(F.col("x"))).collect()] == [reason] * len(urls)
    spellings = ["[0:0:0:0:0:0:0:1]", "[::1]", "[::]", "[0:0:0:0:0:ffff:7f00:1]", "[::ffff:127.0.0.1]", "[2001::1]", "[2001:0:ffff::]",
                 "[2001:db8::5]", "[fe80::1%25eth0]", "[FD00::1]", "[0000:0000::0001]", "[64:ff9b:1::9]"]
    assert values(spark, [f"http://{h}/" for h in spellings], U.url_reject_reason(F.col("x"))) == ["private_ip"] * len(spellings)
    assert values(spark, ["http://[1::2::3]/", "http://[12345::]/", "http://[1:2:3]/"], U.url_reject_reason(F.col("x"))) == ["bad_ip"] * 3
    safe = ["https://example.com/some/page", "http://93.184.216.34/", "http://[2606:4700::1111]/", "http://[2001:20::1]/", "http://[2001:200::1]/",
            "http://[2a00:1450:4001:0:0:0:0:200e]/"]
    assert values(spark, safe, U.url_reject_reason(F.col("x"))) == [None] * len(safe)


@pytest.mark.parametrize("href", ["a", "/a", "../a", "./a/../b", "?q=1", "//h.example/x", "https://o.example/y",
                                  "a/./b/..", "#", "../../../up"])
def test_links_resolve_like_the_standard_library(spark, href):
    base = "https://example.com/dir/sub/page?x=1"
    expected = urllib.parse.urljoin(base, href)
    got = values(spark, [href], U.resolve_url(F.lit(base), F.col("x")))[0]
    assert U_strip(got) == U_strip(expected)


def U_strip(url: str) -> str:
    return url.rstrip("#")


def test_normalize_domain(spark):
    raw = ["https://www.Example.com/a?b#c", "example.com:8080", " shop.example.co.uk ", "not a domain", "-a.com"]
    domain = U.normalize_domain(F.col("x"))
    assert values(spark, raw[:3], domain) == ["example.com", "example.com", "shop.example.co.uk"]
    assert values(spark, raw, U.is_valid_domain(domain)) == [True, True, True, False, False]


def test_normalize_keyword(spark):
    cases = {"\tLASTENRAD   Graz?!": "lastenrad graz", "ÖL  für\u00a0Kette": "öl für kette", "?!": "", None: "",
             "Ｅ－Ｂｉｋｅ": "e-bike", "oﬃce rad": "office rad"}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, keyword string")
    got = {r.keyword: r.normalized_keyword for r in K.with_normalized_keyword(df).collect()}
    assert got == cases


INTENTS = {
    "order cargo bike online": "TRANSACTIONAL", "cargo bike review": "COMMERCIAL", "tandem vs trailer": "COMMERCIAL",
    "why do chains rust": "INFORMATIONAL", "guide to bike tours": "INFORMATIONAL", "bike repair near me": "LOCAL", "strava login": "NAVIGATIONAL",
}


def test_intents(spark):
    assert values(spark, list(INTENTS), K.intent_of(F.col("x"))["intent"]) == list(INTENTS.values())
    pairs = ["buy now", "book now", "pros and cons", "who am i", "shoes", "ideal", "laptop"]
    confidence = values(spark, pairs, K.intent_of(F.col("x"))["confidence"])
    assert confidence == [0.6, 0.65, 0.7, 0.6, 0.35, 0.6, 0.6]
    strict = values(spark, ["ideal", "laptop", "top shoes"], K.intent_of(F.col("x"), word_boundary=True)["intent"])
    assert strict == ["INFORMATIONAL", "INFORMATIONAL", "COMMERCIAL"]


def test_difficulty_and_opportunity(spark):
    rows = [(["a.com"] * 10, 0.8, 50000), ([], 0.1, 50)]
    df = spark.createDataFrame(rows, "hosts array<string>, c double, v long")
    hard, easy = [r[0] for r in df.select(K.keyword_difficulty(
        F.col("c"), F.col("v"), K.saturation_of(F.col("hosts")))).collect()]
    assert (hard, easy) == (85.5, 31.0)
    zero = df.select(K.opportunity_score(F.lit(0), F.lit(10.0), F.lit("LOCAL"))).first()[0]
    assert zero == 0.0
    ranks = spark.createDataFrame([(1,), (4,), (15,), (16,), (None,)], "r int")
    near = [r[0] for r in ranks.select(K.opportunity_score(F.lit(9999), F.lit(50.0), F.lit("TRANSACTIONAL"), F.col("r"))).collect()]
    assert near == [28.0, 48.0, 48.0, 40.0, 40.0]


def test_priority(spark):
    rows = [(10.0, 1.0, 0.5), (0.0, 1.0, 1.0), (7.0, 0.9, 1.0), (7.0, 0.9, 0.0), (7.0, 0.9, None)]
    got = values(spark, rows, S.priority(F.col("i"), F.col("c"), F.col("e")), "i double, c double, e double")
    assert got == [100.0, 0.0, 63.0, 63.0, 63.0]


def test_location_codes(spark):
    rows = [("fr", None), ("Jp", None), ("ZZ", 77), ("ZZ", 0), ("", None), ("SE", 5)]
    assert values(spark, rows, S.location_code(F.col("c"), F.col("e")), "c string, e int") == [2250, 2392, 77, None, 2840, 5]


def test_page_labels(spark):
    assert values(spark, ["x-default", "en", "en-us", "en-US", "english", None], T.is_valid_hreflang(F.col("x"))) == [
        True, True, True, False, False, False]
    assert values(spark, [None, "", "text/html; charset=utf-8", "application/pdf"], T.is_html_response(F.col("x"))) == [
        True, True, True, False]
    assert values(spark, [(429, None), (200, "Body error: x"), (404, None)],
                  T.is_transient(F.col("s"), F.col("m")), "s int, m string") == [True, True, False]


def test_slug_and_usage_units(spark):
    assert values(spark, ["  Acme & Co. ", "Ünï", "!!!"], S.slug_base(F.col("x"))) == ["acme---co", "ünï", "org"]
    assert values(spark, [("serp", 5), ("serp", 35), ("exports", 90)],
                  S.usage_units(F.col("s"), F.col("n")), "s string, n int") == [1, 3, 1]
