"""Latest-per-group, top-k and full numbering without a task per group.

``top_n`` takes two steps.  Catalyst keeps n rows per group in each map task (WindowGroupLimit);
the first window is over salted groups, so that a group in every map task of a large table is
thinned out by many tasks before one of them sees its last candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.session import new_folder, stage


#: Tasks that share a group in the first step.
SALTS = 16


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int | None,
          rank: str | None = None) -> DataFrame:
    """First n rows per group, all without n; ``order`` must end in a unique key."""
    name = rank or "_rn"
    if n is None:
        return numbered(df, keys, order, rank) if rank else df
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    salted = df.withColumn("_salt", salt) if n > 1 else df
    if n > 1:
        some = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))
        salted = salted.withColumn("_some", some).where(F.col("_some") <= n).drop("_salt", "_some")
    kept = salted.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per group in the given order."""
    return top_n(df, keys, order, 1)


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """``row_number`` over whole groups of any size.

    Rows are range-partitioned by key and order, which cuts a large group into even slices, and
    stored with their slice.  A slice starts where the earlier slices of its group end; as slices follow
    each other, at most one group goes on from one to the next, so those sums are a row for each slice
    at most, and adding them moves no other row.  Every group takes this way, whatever its size.
    """
    ordered = [*[F.col(k) for k in keys], *order]
    sliced = stage(df.repartitionByRange(*ordered).withColumn("_slice", F.spark_partition_id()))
    spread = stage(sliced.groupBy(*keys).agg(F.min("_slice").alias("_low"), F.max("_slice").alias("_high"))
                   .where("_low < _high").select(*[F.col(k).alias(f"_key_{k}") for k in keys]))
    # Null-safe: a missing key is a group of its own, as in a window.
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    before = W.partitionBy(*[f"_key_{k}" for k in keys]).orderBy("_key_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = stage(sliced.select(*keys, "_slice").join(spread, same)
                   .groupBy(*[f"_key_{k}" for k in keys], F.col("_slice").alias("_key_slice")).agg(F.count("*").alias("_size"))
                   .withColumn("_before", F.sum("_size").over(before)).where(F.col("_before") > 0).drop("_size"))
    inside = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order))
    return (sliced.withColumn("_inside", inside).join(starts, same & (F.col("_slice") == F.col("_key_slice")), "left")
            .withColumn(out, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("int")).select(*df.columns, out))


class PageIndex:
    """An ordered listing stored in slices with their sizes, for pages at any depth (L1).

    Rows are range-partitioned by ``order``, which has to end in a unique key, and written slice by slice.  The sizes of
    the slices, a row for each shuffle partition, give the total and the slices that a page lies in: page
    1,000 opens those alone, and no page sorts more than its slices.
    """

    def __init__(self, listing: DataFrame, order: list[Column]):
        spark = listing.sparkSession
        self.order, self.columns = order, listing.columns
        sliced = listing.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()).sortWithinPartitions(*order)
        folder = new_folder(spark, "pages")
        sliced.write.partitionBy("_slice").parquet(folder)
        self.stored = spark.read.schema(sliced.schema).parquet(folder)
        self.starts, self.total = [], 0
        for r in sorted(self.stored.groupBy("_slice").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_slice"]):
            self.starts.append((r["_slice"], self.total, self.total + r["n"]))
            self.total += r["n"]

    def page(self, page: int = 1, size: int = 50) -> DataFrame:
        """The rows of a page, and ``total``: how many the whole listing has."""
        first = (max(1, page) - 1) * size
        touched = [(s, a) for s, a, b in self.starts if a < first + size and b > first]
        rows = self.stored.where(F.col("_slice").isin([s for s, _ in touched]))
        start = touched[0][1] if touched else first
        return (rows.orderBy(*self.order).offset(first - start).limit(size).select(*self.columns)
                .withColumn("total", F.lit(self.total).cast("long")))


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = 50) -> DataFrame:
    """One page near the front of an ordered listing (L1); ``PageIndex`` has deep ones and the total."""
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)
