"""Raw pages → signal columns and outbound links.

The whole extraction is column expressions over the page text; the only Python is the
vectorised decoding of HTML character references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions import urls as U

_TAGS = r"(?i)<(title|meta|link|img|a|html)\b" + T.ATTRS + r">"
_ATTR = r"([^\s=>\"'/]+)\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)"
_H1 = r"(?is)<h1\b" + T.ATTRS + r">(.*?)(?:</h1\s*+>|\z)"
_TITLE = r"(?is)<title\b" + T.ATTRS + r">(.*?)(?:</title\s*+>|\z)"
# Comments and other raw blocks are alternatives of their own, so that nothing inside them counts.
_JSON_LD = (r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*?type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*+>"
            r"(.*?)</script\s*+>|<(script|style)\b[^>]*+>.*?</\2\s*+>")


def _extract_all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _tag_struct(tag: Column) -> Column:
    body = F.regexp_replace(tag, r"^<[a-zA-Z0-9]+", "")
    return F.struct(
        F.lower(F.regexp_extract(tag, r"^<([a-zA-Z0-9]+)", 1)).alias("name"),
        F.transform(_extract_all(body, _ATTR, 1), lambda k: F.lower(k)).alias("keys"),
        _extract_all(body, _ATTR, 2).alias("values"))


def _attr(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, null when it is absent."""
    at = F.array_position(tag["keys"], name)
    raw = F.try_element_at(tag["values"], F.nullif(at, F.lit(0)).cast("int"))
    return F.regexp_replace(raw, r"^[\"']|[\"']$", "")


def _named(tags: Column, name: str) -> Column:
    return F.filter(tags, lambda t: t["name"] == name)


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _meta_content(tags: Column, key: str, value: str) -> Column:
    first = _first(F.filter(_named(tags, "meta"), lambda t: _attr(t, key) == value))
    return F.nullif(_attr(first, "content"), F.lit(""))


def _map_of(entries: Column) -> Column:
    """Map from struct(key, value) entries; of equal keys the last one stays."""
    keys = F.transform(entries, lambda e: e["key"])
    kept = F.filter(entries, lambda e, i: F.array_position(F.reverse(keys), e["key"])
                    == F.size(keys) - i)
    return F.when(F.size(kept) > 0, F.map_from_entries(kept))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), T.strip(F.coalesce(value, F.lit(""))).alias("value"))


def _prefixed(tags: Column, key: str, prefix: str) -> Column:
    hits = F.filter(_named(tags, "meta"), lambda t: _attr(t, key).startswith(prefix))
    return _map_of(F.transform(hits, lambda t: _entry(
        F.substr(_attr(t, key), F.lit(len(prefix) + 1)), _attr(t, "content"))))


def with_page_parts(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Tokenise each page once; everything else reads these parts."""
    markup = F.coalesce(F.col(body), F.lit(""))
    anchors = F.filter(_named(F.col("_tags"), "a"), lambda t: F.array_contains(t["keys"], "href"))
    headings = F.transform(
        _extract_all(F.col("_clean"), _H1, 1),
        lambda h: F.array_join(F.filter(F.transform(F.split(h, T.ANY_TAG), T.strip),
                                        lambda s: s != ""), " "))
    return (pages.withColumn("_bare", T.without_raw_blocks(markup))
            .withColumn("_clean", F.regexp_replace("_bare", T.COMMENT, ""))
            .withColumn("_base", U.url_parts(F.col(url)))
            .withColumn("_host", U.fold_www(U.host_of(F.col(url))))
            .withColumn("_raw_tags", F.transform(_extract_all(F.col("_clean"), _TAGS, 0), _tag_struct))
            .withColumn("_values", T.unescape_lists(F.transform("_raw_tags", lambda t: t["values"])))
            .withColumn("_tags", F.zip_with("_raw_tags", "_values", lambda t, v: F.struct(
                t["name"].alias("name"), t["keys"].alias("keys"), v.alias("values"))))
            .withColumn("_json_ld", F.when(markup.contains("ld+json"), F.filter(
                _extract_all(markup, _JSON_LD, 1), lambda s: s != "")))
            .withColumn("_h1", T.unescape_all(headings))
            .withColumn("_title", T.unescape(F.regexp_extract("_clean", _TITLE, 1)))
            .withColumn("_description", _meta_content(F.col("_tags"), "name", "description"))
            .withColumn("_visible", T.unescape(T.squeeze(T.markup_text(F.col("_bare")))))
            .withColumn("_hrefs", F.transform(anchors, lambda t: T.strip(_attr(t, "href"))))
            .withColumn("_rels", F.transform(anchors, lambda t: F.nullif(_attr(t, "rel"), F.lit("")))))


def _links() -> Column:
    """Outbound links of a page as an array of structs."""
    pairs = F.arrays_zip(F.col("_hrefs").alias("href"), F.col("_rels").alias("rel"))
    kept = F.filter(pairs, lambda p: ~U.is_skipped_href(p["href"]))
    absolute = F.transform(kept, lambda p: F.struct(
        U.resolve_from(F.col("_base"), p["href"]).alias("to_url"), p["rel"].alias("rel")))
    hosted = F.transform(absolute, lambda p: F.struct(
        p["to_url"], p["rel"], U.fold_www(U.host_of(p["to_url"])).alias("host")))
    web = F.filter(hosted, lambda p: p["to_url"].rlike("(?i)^https?:"))
    return F.transform(web, lambda p: F.struct(
        p["to_url"].alias("to_url"), p["rel"].alias("rel"),
        ((p["host"] == F.col("_host")) & (F.col("_host") != "")).alias("is_internal")))


def page_signals(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """All signal columns of S2; malformed markup gives empty signals, never an error."""
    parts = (with_page_parts(pages, url, body).withColumn("links", _links())
             .withColumn("_text", T.squeeze(F.coalesce("_visible", F.lit("")))))
    tags = F.col("_tags")
    title = F.nullif(T.strip(F.col("_title")), F.lit(""))
    description = F.nullif(T.strip(F.col("_description")), F.lit(""))
    canonical_tag = _first(F.filter(_named(tags, "link"), lambda t: F.contains(
        F.coalesce(_attr(t, "rel"), F.lit("")), F.lit("canonical"))))
    canonical = F.nullif(T.strip(_attr(canonical_tag, "href")), F.lit(""))
    robots = T.strip(_meta_content(tags, "name", "robots"))
    images = _named(tags, "img")
    languages = F.filter(_named(tags, "link"), lambda t: F.array_contains(t["keys"], "hreflang"))
    kinds = T.schema_types(F.coalesce("_json_ld", F.array().cast("array<string>")))

    def count(items: Column) -> Column:
        return F.size(items)

    return parts.select(
        *pages.columns,
        title.alias("title"),
        F.coalesce(F.length(title), F.lit(0)).alias("title_length"),
        description.alias("meta_description"),
        F.coalesce(F.length(description), F.lit(0)).alias("meta_description_length"),
        U.resolve_from(F.col("_base"), canonical).alias("canonical"),
        robots.alias("robots_meta"),
        count(F.col("_h1")).alias("h1_count"),
        F.col("_h1").alias("h1_text"),
        T.words_of(F.col("_text")).alias("word_count"),
        F.nullif(_attr(_first(_named(tags, "html")), "lang"), F.lit("")).alias("language"),
        count(images).alias("images_count"),
        count(F.filter(images, lambda t: T.strip(F.coalesce(_attr(t, "alt"), F.lit(""))) == ""))
        .alias("images_missing_alt"),
        count(F.filter("links", lambda x: x["is_internal"])).alias("internal_links"),
        count(F.filter("links", lambda x: ~x["is_internal"])).alias("external_links"),
        T.has_noindex(robots).alias("is_noindex"),
        T.has_nofollow(robots).alias("is_nofollow"),
        F.when(F.size(kinds) > 0, kinds).alias("schema_presence"),
        _prefixed(tags, "property", "og:").alias("open_graph"),
        _prefixed(tags, "name", "twitter:").alias("twitter_cards"),
        _map_of(F.transform(languages, lambda t: _entry(F.lower(_attr(t, "hreflang")), _attr(t, "href"))))
        .alias("hreflang"),
        T.hash_of(F.col("_text")).alias("content_hash"),
        "links")


def page_links(signals: DataFrame, url: str = "url") -> DataFrame:
    """One row per outbound link with its normalised target."""
    carried = [c for c in ("crawl_run_id",) if c in signals.columns]
    links = signals.select(*carried, F.col(url).alias("from_url"), F.explode("links").alias("link"))
    return links.select(
        *carried, "from_url", F.col("link.to_url").alias("to_url"),
        U.normalize_url(F.col("link.to_url")).alias("normalized_to_url"),
        F.col("link.is_internal").alias("is_internal"), F.col("link.rel").alias("rel"))
