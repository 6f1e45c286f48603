"""Metered usage, plan limits, memberships, slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import scores as S
from rankloom.functions.numbers import rounded
from rankloom.operators.ranking import numbered

MONTHLY_LIMITS = {"serp": "monthly_serp", "keywords": "monthly_keywords", "exports": "monthly_exports"}


def usage_summary(usage: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Units and calls per organisation, provider, service and operation."""
    start = as_of.cast("timestamp_ntz") - F.expr(f"INTERVAL '{max(1, int(days))}' DAY")
    return (usage.where(F.col("created_at") >= start)
            .groupBy("organization_id", "provider", "service", "operation")
            .agg(F.sum("units").alias("units"), F.count("*").alias("calls")))


def month_to_date(usage: DataFrame, as_of: Column) -> DataFrame:
    """Units per organisation and service since the first of the month."""
    return (usage.where(F.col("created_at") >= S.month_start(as_of).cast("timestamp_ntz"))
            .groupBy("organization_id", "service").agg(F.sum("units").alias("units")))


def plan_usage(organizations: DataFrame, projects: DataFrame, usage: DataFrame,
               as_of: Column) -> DataFrame:
    """Usage against the plan's limits, one row per organisation and limit."""
    live = (projects.where(~F.col("is_deleted")).groupBy("organization_id")
            .agg(F.count("*").alias("used")).withColumn("limit_name", F.lit("projects")))
    metered = (month_to_date(usage, as_of)
               .withColumn("limit_name", S.lookup(F.col("service"), MONTHLY_LIMITS))
               .where(F.col("limit_name").isNotNull())
               .select("organization_id", F.col("units").alias("used"), "limit_name"))
    names = ["projects", *MONTHLY_LIMITS.values()]
    plan = S.plan_or_free(F.col("plan"))
    allowed = F.array(*[F.struct(F.lit(n).alias("limit_name"), S.plan_limit(F.col("plan"), n).alias("allowed"))
                        for n in names])
    every = organizations.select("organization_id", plan.alias("plan"), F.explode(allowed).alias("l")).select(
        "organization_id", "plan", "l.limit_name", "l.allowed")
    used = F.coalesce("used", F.lit(0))
    return (every.join(live.unionByName(metered), ["organization_id", "limit_name"], "left")
            .withColumn("used", used)
            .withColumn("percent", rounded(F.least(F.lit(100.0), F.col("used") / F.col("allowed") * 100), 1))
            .withColumn("over_limit", F.col("used") >= F.col("allowed")))


def tracked_limits(projects: DataFrame, organizations: DataFrame, tracked: DataFrame) -> DataFrame:
    """Active tracked keywords per project against the plan."""
    active = tracked.where("is_active").groupBy("project_id").agg(F.count("*").alias("used"))
    allowed = S.plan_limit(F.col("plan"), "tracked_per_project")
    return (projects.where(~F.col("is_deleted")).select("project_id", "organization_id")
            .join(organizations.select("organization_id", "plan"), "organization_id", "left")
            .join(active, "project_id", "left")
            .select("project_id", F.coalesce("used", F.lit(0)).alias("used"), allowed.alias("allowed"))
            .withColumn("over_limit", F.col("used") >= F.col("allowed")))


def memberships(users: DataFrame, members: DataFrame, organizations: DataFrame) -> DataFrame:
    """Users with the live organisations they belong to."""
    live = organizations.where(~F.col("is_deleted")).select("organization_id", "name")
    return users.select("user_id").join(members, "user_id").join(live, "organization_id")


def scope(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows that belong to a live project of their organisation."""
    live = projects.where(~F.col("is_deleted")).select("project_id", "organization_id")
    return rows.join(live, ["project_id", "organization_id"], "left_semi")


def slugs(names: DataFrame, key: str = "organization_id") -> DataFrame:
    """Unique slug per organisation: base, then base-2, base-3 … by id.

    A name that very many organisations share is numbered by many tasks.
    """
    rows = names.withColumn("slug_base", S.slug_base(F.col("name")))
    counted = numbered(rows, ["slug_base"], [F.asc(key)], "nth")
    return counted.withColumn("slug", F.when(F.col("nth") == 1, F.col("slug_base")).otherwise(
        F.concat("slug_base", F.lit("-"), F.col("nth").cast("string"))))


def export_state(exports: DataFrame, as_of: Column) -> DataFrame:
    """Exports expire seven days after creation."""
    expires = F.col("created_at") + F.expr("INTERVAL '7' DAY")
    return (exports.withColumn("expires_at", expires)
            .withColumn("is_expired", F.col("expires_at") < as_of.cast("timestamp_ntz")))
