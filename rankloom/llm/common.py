"""Settings and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import prepare, stage

__all__ = ["begin", "bits_of", "has_bit", "stage", "stage_by_shuffles", "table"]

#: Bits of the fixed-size filters below: 128 KB whatever the data.
FILTER_BITS = 1 << 20
#: For ids of whole sets, of which each one too many is shuffled: 2 MB whatever the data.
SET_FILTER_BITS = 1 << 24
_BLOCK = 32768


def begin(spark: SparkSession) -> SparkSession:
    """Job settings; small Arrow batches, as one text may be long."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return begin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Nothing of a join goes through the driver, and shuffle files go when their write ends, not when the driver collects its garbage.
_SHUFFLES = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def stage_by_shuffles(df: DataFrame) -> DataFrame:
    """``stage`` without broadcasts, whose shuffle files are removed at once: for steps that shuffle more than they write."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in _SHUFFLES}
    try:
        for key, value in _SHUFFLES.items():
            conf.set(key, value)
        return stage(df)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def bits_of(values: DataFrame, column: str, size: int = FILTER_BITS) -> np.ndarray:
    """A fixed-size bit filter of a long column: a row of 4 KB for every 32,768 bits reaches the driver.

    It never misses a value.  With very many values it passes nearly everything, and the join
    behind it does the work.
    """
    low = F.col(column).bitwiseAND(F.lit(size - 1))
    rows = (values.where(F.col(column).isNotNull())
            .select((low / _BLOCK).cast("int").alias("block"), (low % _BLOCK).alias("bit"))
            .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[r.block * (_BLOCK // 8) : (r.block + 1) * (_BLOCK // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def has_bit(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values.astype(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


def same(a: Column, b: Column) -> Column:
    """Equality in which two nulls are equal."""
    return a.eqNullSafe(b)
