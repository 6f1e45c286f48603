"""Landed vendor payloads → typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import strip
from rankloom.functions.urls import host_of, is_valid_domain, normalize_domain
from rankloom.operators.ranking import numbered, top_n

# Result-page elements that count as features.
FEATURE_TYPES = [
    "featured_snippet", "people_also_ask", "local_pack", "video", "images", "news", "shopping",
    "knowledge_graph", "knowledge_graph_shopping", "top_stories", "questions_and_answers",
    "related_searches", "hotels_pack", "jobs", "events", "maps", "tweets", "found_on_web",
]
RESULT_TYPES = ["organic", "paid"]

SERP_ITEMS = (
    "array<struct<type:string,rank_absolute:int,rank_group:int,url:string,title:string,"
    "description:string,items:array<struct<title:string,url:string,domain:string,"
    "description:string>>>>")
KEYWORD_ITEM = (
    "struct<keyword:string,search_volume:bigint,cpc:double,competition_index:double,"
    "monthly_searches:array<struct<year:int,month:int,search_volume:bigint>>>")
GSC_ROW = ("struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>")


def serp_results(payloads: DataFrame, key: str = "serp_search_id",
                 items: str = "items") -> DataFrame:
    """Ranked results of each payload.

    All items of a search sit in one row, so sorting and renumbering need no shuffle: results
    are ordered by vendor position (array order breaks ties), organic ones numbered 1..N,
    paid ones keep the vendor position.
    """
    def vendor_position(i: Column) -> Column:
        return F.coalesce(F.nullif(i["rank_absolute"], F.lit(0)), i["rank_group"], F.lit(0))

    rows = F.transform(F.col(items), lambda i, n: F.struct(
        vendor_position(i).alias("vendor_position"), n.alias("n"),
        F.lower(i["type"]).alias("result_type"), F.coalesce(i["url"], F.lit("")).alias("url"),
        i["title"].alias("title"), i["description"].alias("snippet")))
    ranked = F.array_sort(F.filter(rows, lambda r: r["result_type"].isin(RESULT_TYPES)))
    organic = F.transform(F.filter(ranked, lambda r: r["result_type"] == "organic"),
                          lambda r, n: F.struct((n + 1).alias("position"), r.alias("row")))
    paid = F.transform(F.filter(ranked, lambda r: r["result_type"] == "paid"),
                       lambda r: F.struct(r["vendor_position"].alias("position"), r.alias("row")))
    flat = payloads.select(key, F.explode(F.concat(organic, paid)).alias("r"))
    return flat.select(
        key, F.col("r.position").alias("position"), host_of(F.col("r.row.url")).alias("domain"),
        F.col("r.row.url").alias("url"), F.col("r.row.title").alias("title"),
        F.col("r.row.snippet").alias("snippet"), F.col("r.row.result_type").alias("result_type"))


def serp_features(payloads: DataFrame, key: str = "serp_search_id",
                  items: str = "items") -> DataFrame:
    """Known result-page features of each payload with their first inner item."""
    flat = payloads.select(key, F.explode(items).alias("i"))
    return (flat.withColumn("feature_type", F.lower("i.type"))
            .where(F.col("feature_type").isin(FEATURE_TYPES))
            .select(key, "feature_type",
                    F.coalesce(F.nullif(F.col("i.rank_absolute"), F.lit(0)), "i.rank_group").alias("position"),
                    F.try_element_at("i.items", F.lit(1)).alias("data")))


def renumber_flat_items(items: DataFrame, key: str = "serp_search_id") -> DataFrame:
    """S6 for items that arrive as one row each instead of one array per search.

    A search with very many rows is numbered by many tasks.
    """
    order = [F.asc("rank_absolute"), F.asc("url"), F.asc("domain"), F.asc("item_id")]
    organic = numbered(items.where(F.col("result_type") == "organic"), [key], order, "position")
    paid = items.where(F.col("result_type") == "paid").withColumn("position", F.col("rank_absolute"))
    return organic.unionByName(paid)


def keyword_metrics(payloads: DataFrame, item: str = "item", provider: str = "vendor") -> DataFrame:
    """Vendor keyword items → metrics; keeps the last twelve monthly volumes."""
    i = F.col(item)
    months = F.coalesce(i["monthly_searches"], F.expr("array()").cast("array<struct<year:int,month:int,search_volume:bigint>>"))
    last_year = F.slice(months, F.greatest(F.size(months) - 11, F.lit(1)), F.lit(12))
    trend = F.transform(last_year, lambda m: m["search_volume"])
    return payloads.select(
        *[c for c in payloads.columns if c != item],
        F.coalesce(i["keyword"], F.lit("")).alias("keyword"),
        i["search_volume"].alias("search_volume"), i["cpc"].alias("cpc"),
        (i["competition_index"] / 100.0).alias("competition"),
        F.when(F.size(trend) > 0, trend).alias("trend"), F.lit(provider).alias("provider"))


def suggestion_batch(metrics: DataFrame, request: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """Named suggestions of each request, or the first ``limit`` it asked for."""
    return top_n(metrics.where(F.col("keyword") != ""), request, order, limit)


def gsc_rows(payloads: DataFrame, dimension: str, row: str = "row") -> DataFrame:
    """Search-console rows with keys [date, dimension, country, device]."""
    keys = F.col(row)["keys"]

    def part(n: int) -> Column:
        return F.coalesce(F.nullif(F.try_element_at(keys, F.lit(n)), F.lit("")), F.lit("all"))

    return payloads.select(
        *[c for c in payloads.columns if c != row],
        F.try_element_at(keys, F.lit(1)).try_cast("date").alias("date"),
        F.coalesce(F.try_element_at(keys, F.lit(2)), F.lit("")).alias(dimension),
        F.lower(part(3)).alias("country"), F.upper(part(4)).alias("device"),
        F.coalesce(F.col(row)["clicks"], F.lit(0)).cast("int").alias("clicks"),
        F.coalesce(F.col(row)["impressions"], F.lit(0)).cast("int").alias("impressions"),
        F.coalesce(F.col(row)["ctr"], F.lit(0.0)).alias("ctr"),
        F.coalesce(F.col(row)["position"], F.lit(0.0)).alias("position"))


GSC_PAGE = f"property_id long, batch_seq long, row {GSC_ROW}"


def read_gsc_pages(spark: SparkSession, folder: str, dimension: str) -> DataFrame:
    """All landed result pages of a folder in one scan with a declared schema."""
    return gsc_rows(spark.read.schema(GSC_PAGE).json(folder), dimension)


def stream_gsc_pages(spark: SparkSession, folder: str, dimension: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream: every landed file is read in exactly one batch, also across restarts.

    What has been read is in the checkpoint of the query that writes the rows; a page counts as
    landed once its file is in the folder under its final name.
    """
    raw = spark.readStream.schema(GSC_PAGE).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return gsc_rows(raw, dimension)


def competitor_backfill(projects: DataFrame, existing: DataFrame) -> DataFrame:
    """Legacy JSON competitor lists → competitor rows that do not exist yet."""
    entries = F.explode(F.from_json("competitors", "array<string>"))
    rows = (projects.where(~F.col("is_deleted"))
            .select("organization_id", "project_id", entries.alias("original_input"))
            .where(strip(F.col("original_input")) != "")
            .withColumn("domain", normalize_domain(F.col("original_input")))
            .where(is_valid_domain(F.col("domain"))))
    return (rows.groupBy("organization_id", "project_id", "domain")
            .agg(F.min(strip(F.col("original_input"))).alias("original_input"))
            .withColumn("is_active", F.lit(True))
            .join(existing.select("project_id", "domain"), ["project_id", "domain"], "left_anti"))


def gsc_properties(sites: DataFrame, site_url: str = "site_url") -> DataFrame:
    """Typed property list; ``sc-domain:`` marks a domain property."""
    return (sites.where(F.coalesce(F.col(site_url), F.lit("")) != "")
            .withColumn("property_type", F.when(F.col(site_url).startswith("sc-domain:"), "DOMAIN")
                        .otherwise("URL_PREFIX")))
