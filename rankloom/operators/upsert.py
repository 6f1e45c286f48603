"""Table maintenance as set operations: upserts, replacement, reactivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import latest


def latest_by_grain(rows: DataFrame, grain: list[str], newest_first: list[Column]) -> DataFrame:
    """Last write per grain within one batch."""
    return latest(rows, grain, newest_first)


def upsert(existing: DataFrame, incoming: DataFrame, grain: list[str],
           newest_first: list[Column]) -> DataFrame:
    """Existing rows replaced by incoming rows of the same grain (K1, K2).

    One pass: both sides are tagged and the newest row of each grain stays, so there is a
    single shuffle on the grain and no join.
    """
    both = (existing.withColumn("_src", F.lit(0))
            .unionByName(incoming.withColumn("_src", F.lit(1)), allowMissingColumns=True))
    return latest(both, grain, [F.desc("_src"), *newest_first]).drop("_src")


def upsert_stats(existing: DataFrame, incoming: DataFrame, grain: list[str],
                 by: list[str]) -> DataFrame:
    """How many incoming rows insert and how many update, per ``by`` (K1).

    Repeats of a grain inside the batch count as updates of its first row.
    """
    known = existing.groupBy(*grain).agg(F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_known"))
    fresh = incoming.groupBy(*grain).agg(F.count("*").alias("_n"), F.lit(0).alias("_known"))
    per_grain = (known.unionByName(fresh).groupBy(*grain)
                 .agg(F.sum("_n").alias("_n"), F.max("_known").alias("_known")))
    inserted = F.when((F.col("_known") == 0) & (F.col("_n") > 0), 1).otherwise(0)
    return (per_grain.groupBy(*by)
            .agg(F.sum(inserted).alias("inserted"), F.sum(F.col("_n") - inserted).alias("updated")))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str],
                     first: list[Column]) -> DataFrame:
    """Existing rows plus the first incoming row of every new key."""
    fresh = latest(incoming, key, first).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def replace_children(children: DataFrame, fresh: DataFrame, parent: str,
                     replaced: DataFrame) -> DataFrame:
    """Drop the children of replaced parents and add the new ones (K4, K6)."""
    return children.join(replaced.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def replace_open(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh OPEN rows take the place of old OPEN rows; decided rows stay (K9)."""
    return existing.where(F.col("status") != "OPEN").unionByName(
        fresh, allowMissingColumns=True)


def add_or_reactivate(existing: DataFrame, requests: DataFrame, key: list[str],
                      overwrite: list[str]) -> DataFrame:
    """Switch existing rows on again or add new ones.

    ``overwrite`` columns take a value from the request only when a row is reactivated and
    the request carries a non-empty one.
    """
    rest = [c for c in existing.columns if c not in (*key, "is_active")]
    old = existing.alias("old")
    # Like one request after the other: of several for a key, the first decides.
    asked = latest(requests, key, [F.asc("request_seq")]).alias("new")
    condition = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key]
    joined = old.join(asked, condition, "full")
    is_new = F.col("old.is_active").isNull()
    revived = ~is_new & ~F.col("old.is_active") & F.col(f"new.{key[0]}").isNotNull()

    def value(c: str) -> Column:
        requested = F.col(f"new.{c}") if c in requests.columns else F.lit(None)
        current = F.col(f"old.{c}")
        if c in overwrite:
            given = F.nullif(requested.cast("string"), F.lit(""))
            return F.when(is_new, requested).when(revived & given.isNotNull(), requested).otherwise(current)
        return F.when(is_new, requested).otherwise(current)

    asked_for = F.col(f"new.{key[0]}").isNotNull()
    return joined.select(
        *[F.coalesce(F.col(f"old.{k}"), F.col(f"new.{k}")).alias(k) for k in key],
        *[value(c).alias(c) for c in rest],
        (asked_for | F.coalesce(F.col("old.is_active"), F.lit(False))).alias("is_active"))


def deactivate(rows: DataFrame, ids: DataFrame, key: str, flag: str = "is_active",
               value: bool = False) -> DataFrame:
    """Set a soft-delete flag for the given ids."""
    marked = rows.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return (marked.withColumn(flag, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(flag)))
            .drop("_hit").select(*rows.columns))


def select_one(rows: DataFrame, choices: DataFrame, group: str, key: str) -> DataFrame:
    """Mark the chosen row of each group and clear its siblings."""
    chosen = choices.select(F.col(group).alias("_group"), F.col(key).alias("_chosen"))
    joined = rows.join(chosen, F.col(group) == F.col("_group"), "left")
    flag = F.when(F.col("_group").isNotNull(), F.col(key) == F.col("_chosen")).otherwise(
        F.col("is_selected"))
    return joined.withColumn("is_selected", flag).select(*rows.columns)


RECOMMENDATION_STATES = ["OPEN", "IN_PROGRESS", "DISMISSED", "COMPLETED"]


def change_status(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Apply (key, new_status) changes; unknown states are ignored."""
    legal = changes.where(F.col("new_status").isin(RECOMMENDATION_STATES)).select(key, "new_status")
    return (rows.join(legal, key, "left")
            .withColumn("status", F.coalesce("new_status", "status")).select(*rows.columns))
