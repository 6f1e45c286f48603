"""Link-graph operators: inbound counts, frontier dedup, click depth."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.operators.ranking import latest, top_n
from rankloom.session import new_folder, stage

EDGE = ["crawl_run_id", "from_url"]
URL = ["crawl_run_id", "url"]
#: So many tables of visited URLs of one size become one.
FAN_IN = 4
#: Parts of a page's links: the links of one page may lie in so many buckets.
SALTS = 8


def inbound_links(links: DataFrame) -> DataFrame:
    """Internal links pointing at each URL (A1)."""
    return (links.where("is_internal").groupBy("crawl_run_id", "normalized_to_url")
            .agg(F.count("*").alias("inbound")))


def dedup_frontier(frontier: DataFrame) -> DataFrame:
    """First sighting of each normalised URL, shallowest first."""
    return latest(frontier, ["crawl_run_id", "normalized_url"], [F.asc("depth"), F.asc("seq")])


class Visited:
    """URLs with their depth in tables bucketed by URL; tables of one size are merged once ``FAN_IN`` have come together.

    A lookup joins the asked URLs bucket to bucket, so only they are shuffled.
    """

    def __init__(self, spark: SparkSession, schema: StructType, buckets: int):
        self.spark, self.schema, self.buckets = spark, schema, buckets
        self.tables: list[tuple[int, str, str]] = []  # size class, name, folder

    def add(self, rows: DataFrame, tier: int = 0) -> str:
        """Store rows as a new table and return its folder."""
        name, folder = f"visited_{uuid.uuid4().hex}", new_folder(self.spark, "visited")
        (rows.repartition(self.buckets, *URL).write.bucketBy(self.buckets, *URL).option("path", folder).saveAsTable(name))
        self.tables.append((tier, name, folder))
        return folder

    def merge(self, tier: int = 0) -> None:
        """Make one table of those of a size, if there are enough of them."""
        own = [t for t in self.tables if t[0] == tier]
        if len(own) == FAN_IN:
            self.tables = [t for t in self.tables if t[0] != tier]
            self.add(reduce(DataFrame.unionByName, [self.spark.table(t[1]) for t in own]), tier + 1)
            for _, old, _ in own:
                self.spark.sql(f"DROP TABLE {old}")
            self.merge(tier + 1)

    def unseen(self, asked: DataFrame) -> DataFrame:
        """The asked URLs, each once, that no table holds."""
        asked = asked.select(*URL).distinct()
        if not self.tables:
            return asked
        # The tables stream past the asked URLs; what is found is no more than what was asked.
        seen = reduce(DataFrame.unionByName, [self.spark.table(n).select(*URL).join(asked.hint("shuffle_hash"), URL, "left_semi") for _, n, _ in self.tables])
        return asked.join(seen, URL, "left_anti")

    def close(self) -> DataFrame:
        """All rows; the tables' names go, their files stay."""
        for _, name, _ in self.tables:
            self.spark.sql(f"DROP TABLE {name}")
        return self.spark.read.schema(self.schema).parquet(*[f for _, _, f in self.tables])


def click_depth(seeds: DataFrame, links: DataFrame, max_rounds: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Clicks from the seeds to every reachable URL.

    ``seeds``: crawl_run_id, url, depth (0 homepage, 1 sitemap); ``links``: crawl_run_id,
    from_url, to_url.  One join per level: the URLs of a level meet the edges, those visited
    before drop out.  Edges and visited URLs lie in buckets, so a round shuffles its frontier and nothing else,
    and writes its new URLs only; a lost executor costs one round at most.  The loop ends when a level is empty.

    With ``max_pages``, a run stops at the level that reaches so many URLs and keeps the first of them by depth and URL.
    """
    spark = seeds.sparkSession
    start = stage(seeds.groupBy(*URL).agg(F.min("depth").cast("int").alias("depth")))
    salt = F.pmod(F.xxhash64("to_url"), F.lit(SALTS)).cast("int")
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"edges_{uuid.uuid4().hex}"
    laid = [*EDGE, "salt"]
    (links.select(*EDGE, "to_url").distinct().withColumn("salt", salt).repartition(buckets, *laid)
     .write.bucketBy(buckets, *laid).option("path", new_folder(spark, "edges")).saveAsTable(name))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    visited = Visited(spark, start.schema, buckets)
    sizes = start.limit(0).select("crawl_run_id", F.lit(0).cast("long").alias("n"))

    def read(folder: str) -> DataFrame:
        return spark.read.schema(start.schema).parquet(folder)

    frontier = read(visited.add(start.where(F.col("depth") == 0)))
    level, last_seed = 0, start.agg(F.max("depth")).first()[0] or 0
    while max_rounds is None or level < max_rounds:
        if max_pages is not None:
            sizes = stage(sizes.unionByName(frontier.groupBy("crawl_run_id").agg(F.count("*").alias("n"))).groupBy("crawl_run_id").agg(F.sum("n").alias("n")))
        sources = frontier.select("crawl_run_id", F.col("url").alias("from_url"), salts)
        found = spark.table(name).join(sources, laid).select("crawl_run_id", F.col("to_url").alias("url"))
        level += 1
        # Seeds of this depth join the level they belong to.
        asked = found.unionByName(start.where(F.col("depth") == level).select(*URL))
        if max_pages is not None:
            asked = asked.join(sizes.where(F.col("n") >= max_pages), "crawl_run_id", "left_anti")
        frontier = read(visited.add(visited.unseen(asked).withColumn("depth", F.lit(level))))
        if level >= last_seed and frontier.isEmpty():
            break
        visited.merge()
    spark.sql(f"DROP TABLE {name}")
    out = visited.close()
    return out if max_pages is None else top_n(out, ["crawl_run_id"], [F.asc("depth"), F.asc("url")], max_pages)
