"""Search-console queries: A9–A13, W10, Q16–Q18, K1, K2, S8, S9, S13, L1."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import Tables, half_up, query
from rankloom.operators import upsert as UP
from rankloom.operators.ranking import PageIndex, page_of
from rankloom.plans import gsc
from rankloom.plans.rankings import share_of_max
from rankloom.session import new_folder
from rankloom.sources import vendor



def as_of():
    """Reporting date; the events end on 2024-01-30."""
    return F.lit("2024-01-31").cast("date")


_STORED = """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY property_id, date, {dim}, country, device ORDER BY batch_seq DESC) AS rn
        FROM {{gsc_rows}}) WHERE rn = 1"""
_MEASURES = f"""CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
    CASE WHEN sum(impressions) > 0 THEN {half_up('CAST(sum(clicks) AS DOUBLE) / sum(impressions)', 4)} ELSE 0.0e0 END AS ctr,
    {half_up('avg(position)', 1)} AS {{position}},
    {half_up('coalesce(CAST(sum(position * impressions) AS DOUBLE) / nullif(sum(impressions), 0), 0.0e0)', 1)} AS weighted_position"""


def stored_queries(t: Tables):
    return UP.latest_by_grain(t.gsc_rows, gsc.QUERY_GRAIN, [F.desc("batch_seq")])


def stored_pages(t: Tables):
    return UP.latest_by_grain(t.gsc_rows, gsc.PAGE_GRAIN, [F.desc("batch_seq")])


@query("q16_gsc_overview", f"""
    WITH q AS ({_STORED.format(dim='query')}), p AS ({_STORED.format(dim='page')})
    SELECT property_id, 'queries' AS section, {_MEASURES.format(position='avg_position')} FROM q WHERE date >= DATE '2024-01-03' GROUP BY property_id
    UNION ALL
    SELECT property_id, 'pages' AS section, {_MEASURES.format(position='avg_position')} FROM p WHERE date >= DATE '2024-01-03' GROUP BY property_id
    """)
def gsc_overview(t: Tables):
    return gsc.overview(stored_queries(t), stored_pages(t), as_of())


@query("a10_gsc_daily", f"""
    WITH q AS ({_STORED.format(dim='query')})
    SELECT property_id, date, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions
    FROM q WHERE date >= DATE '2024-01-03' GROUP BY property_id, date""")
def gsc_daily(t: Tables):
    return gsc.daily(stored_queries(t), as_of())


@query("w10_daily_share_of_max", f"""
    WITH q AS ({_STORED.format(dim='query')}),
    d AS (SELECT property_id, date, CAST(sum(impressions) AS BIGINT) AS impressions FROM q GROUP BY property_id, date)
    SELECT property_id, date, {half_up('CAST(impressions AS DOUBLE) / greatest(1, max(impressions) OVER (PARTITION BY property_id))', 4)} AS share
    FROM d""")
def daily_share(t: Tables):
    days = stored_queries(t).groupBy("property_id", "date").agg(F.sum("impressions").alias("impressions"))
    shares = share_of_max(days, "property_id", "impressions")
    return shares.select("property_id", "date", F.round(F.col("share").cast("decimal(18,6)"), 4).cast("double").alias("share"))


@query("q17_gsc_queries", f"""
    WITH q AS ({_STORED.format(dim='query')})
    SELECT property_id, query, {_MEASURES.format(position='position')} FROM q
    WHERE date >= DATE '2024-01-03' AND query ILIKE '%RY 1%' GROUP BY property_id, query""")
def gsc_queries(t: Tables):
    return gsc.by_dimension(stored_queries(t), "query", as_of(), search="RY 1")


@query("q18_gsc_pages", f"""
    WITH p AS ({_STORED.format(dim='page')})
    SELECT property_id, page, {_MEASURES.format(position='position')} FROM p
    WHERE date >= DATE '2024-01-03' GROUP BY property_id, page""")
def gsc_pages(t: Tables):
    return gsc.by_dimension(stored_pages(t), "page", as_of())


@query("l1_deep_page", """
    SELECT property_id, date, query, batch_seq, clicks, count(*) OVER () AS total FROM {gsc_rows}
    ORDER BY clicks DESC, batch_seq LIMIT 5 OFFSET 4995""")
def deep_page(t: Tables):
    rows = t.gsc_rows.select("property_id", "date", "query", "batch_seq", "clicks")
    return PageIndex(rows, [F.desc("clicks"), F.asc("batch_seq")]).page(1000, 5)


@query("l1_gsc_queries_page_2", f"""
    WITH q AS ({_STORED.format(dim='query')})
    SELECT property_id, query, {_MEASURES.format(position='position')} FROM q
    WHERE date >= DATE '2024-01-03' GROUP BY property_id, query
    ORDER BY clicks DESC, property_id, query LIMIT 20 OFFSET 20""")
def gsc_queries_page(t: Tables):
    rows = gsc.by_dimension(stored_queries(t), "query", as_of())
    return page_of(rows, gsc.listing_order("clicks", "query"), page=2, size=20)


@query("a13_striking_distance", f"""
    WITH q AS ({_STORED.format(dim='query')})
    SELECT property_id, query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions
    FROM q GROUP BY property_id, query HAVING avg(position) >= 4 AND avg(position) <= 15 AND sum(impressions) >= 500
    """)
def striking_distance(t: Tables):
    return gsc.striking_distance(stored_queries(t)).drop("position")


@query("j12_click_change", f"""
    WITH q AS ({_STORED.format(dim='query')}),
    r AS (SELECT property_id, query, CAST(sum(clicks) AS BIGINT) AS now_clicks FROM q WHERE date >= DATE '2024-01-23' GROUP BY property_id, query),
    o AS (SELECT property_id, query, CAST(sum(clicks) AS BIGINT) AS was_clicks FROM q
          WHERE date >= DATE '2023-12-26' AND date < DATE '2024-01-23' GROUP BY property_id, query)
    SELECT r.property_id, r.query, now_clicks, coalesce(was_clicks, 0) AS was_clicks
    FROM r LEFT JOIN o ON o.property_id = r.property_id AND o.query = r.query""")
def click_change(t: Tables):
    return gsc.click_change(stored_queries(t), F.lit("2024-02-20").cast("date"))


def _upsert_sql(dim: str) -> str:
    grain = f"property_id, date, {dim}, country, device"
    return f"""
    SELECT {grain}, clicks, impressions, position FROM (
        SELECT *, row_number() OVER (PARTITION BY {grain} ORDER BY batch_seq % 3 <> 0 DESC, batch_seq DESC) AS rn FROM {{gsc_rows}})
    WHERE rn = 1"""


def _halves(t: Tables):
    stored = F.col("batch_seq") % 3 == 0
    return t.gsc_rows.where(stored), t.gsc_rows.where(~stored)


@query("k1_upsert_queries", _upsert_sql("query"))
def upsert_queries(t: Tables):
    old, new = _halves(t)
    stored = UP.latest_by_grain(old, gsc.QUERY_GRAIN, [F.desc("batch_seq")])
    return UP.upsert(stored, new, gsc.QUERY_GRAIN, [F.desc("batch_seq")]).select(
        *gsc.QUERY_GRAIN, "clicks", "impressions", "position")


@query("k2_upsert_pages", _upsert_sql("page"))
def upsert_pages(t: Tables):
    old, new = _halves(t)
    return UP.upsert(old, new, gsc.PAGE_GRAIN, [F.desc("batch_seq")]).select(
        *gsc.PAGE_GRAIN, "clicks", "impressions", "position")


@query("k1_upsert_stats", """
    WITH old AS (SELECT DISTINCT property_id, date, query, country, device FROM {gsc_rows} WHERE batch_seq % 3 = 0),
    new AS (SELECT *, row_number() OVER (PARTITION BY property_id, date, query, country, device ORDER BY batch_seq) AS rn
            FROM {gsc_rows} WHERE batch_seq % 3 <> 0)
    SELECT n.property_id, count(*) FILTER (WHERE o.query IS NULL AND rn = 1) AS inserted,
           count(*) FILTER (WHERE o.query IS NOT NULL OR rn > 1) AS updated
    FROM new n LEFT JOIN old o ON o.property_id = n.property_id AND o.date = n.date AND o.query = n.query
         AND o.country = n.country AND o.device = n.device
    GROUP BY n.property_id""")
def upsert_stats(t: Tables):
    old, new = _halves(t)
    return UP.upsert_stats(old, new, gsc.QUERY_GRAIN, ["property_id"])


@query("s8_gsc_rows", """
    SELECT event_id, CAST(ts AS DATE) AS date, event_type AS query, CASE WHEN event_id % 5 = 0 THEN 'all' ELSE 'gbr' END AS country,
           CASE WHEN event_id % 4 = 0 THEN 'ALL' ELSE 'MOBILE' END AS device, CAST(event_id % 50 AS INTEGER) AS clicks,
           CAST(event_id % 900 AS INTEGER) AS impressions, 0.0e0 AS ctr, CAST(event_id % 40 AS DOUBLE) / 2.0e0 AS position
    FROM events""")
def gsc_payload_rows(t: Tables):
    n = F.col("event_id")
    keys = F.array(F.col("ts").cast("date").cast("string"), F.col("event_type"),
                   F.when(n % 5 == 0, "").otherwise("GBR"), F.when(n % 4 == 0, "").otherwise("mobile"))
    payload = F.to_json(F.struct(keys.alias("keys"), (n % 50).alias("clicks"), (n % 900).alias("impressions"),
                                 ((n % 40).cast("double") / 2.0).alias("position")))
    landed = t.events.select("event_id", F.from_json(payload, vendor.GSC_ROW).alias("row"))
    return vendor.gsc_rows(landed, "query")


@query("s13_gsc_properties", """
    SELECT property_id, site_url, CASE WHEN starts_with(site_url, 'sc-domain:') THEN 'DOMAIN' ELSE 'URL_PREFIX' END AS property_type
    FROM {gsc_properties} WHERE site_url <> ''""")
def gsc_properties(t: Tables):
    return vendor.gsc_properties(t.gsc_properties).select("property_id", "site_url", "property_type")


@query("s9_landed_pages", """
    SELECT property_id, batch_seq, date, query, country, device, CAST(clicks AS INTEGER) AS clicks, CAST(impressions AS INTEGER) AS impressions, position
    FROM {gsc_rows}""")
def landed_pages(t: Tables):
    """The rows written as landed vendor pages, then read back in one scan."""
    row = F.struct(F.array(F.col("date").cast("string"), "query", "country", "device").alias("keys"), F.col("clicks").cast("double").alias("clicks"),
                   F.col("impressions").cast("double").alias("impressions"), F.lit(0.0).alias("ctr"), "position")
    folder = new_folder(t.spark, "landed")
    t.gsc_rows.select(F.col("property_id").cast("long"), F.col("batch_seq").cast("long"), row.alias("row")).write.json(folder)
    return vendor.read_gsc_pages(t.spark, folder, "query").drop("ctr")
