"""Flags that change with time, and conditional column updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _deactivate(deals: DataFrame, due: Column, counted: Column) -> tuple[DataFrame, DataFrame]:
    due = F.coalesce(due, F.lit(False))
    count = deals.agg(F.count_if(F.coalesce(counted, F.lit(False))).alias("flagged"))
    return deals.withColumn("is_active", F.col("is_active") & ~due), count


def purge_expired(deals: DataFrame, before: str, *, count_inactive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Deals past their expiry become inactive.  -> (next table, one-row count).

    ``count_inactive`` also counts expired deals that were inactive already.
    """
    due = F.col("expires_at") < F.lit(before).cast("timestamp")
    return _deactivate(deals, due, due if count_inactive else due & F.col("is_active"))


def mark_stale(deals: DataFrame, now: str, stale_hours: float = 96.0) -> tuple[DataFrame, DataFrame]:
    """Deals not seen for ``stale_hours`` become inactive; never-seen deals are left alone."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(stale_hours * 3600))
    due = F.col("last_seen_at") < cutoff
    return _deactivate(deals, due, due & F.col("is_active"))


def deactivate(deals: DataFrame, ids: DataFrame) -> DataFrame:
    """Deals whose id is in ``ids`` (column id) become inactive."""
    flagged = ids.select("id").distinct().withColumn("_off", F.lit(True))
    return deals.join(flagged, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_off").isNull()).drop("_off")


def update_scores(deals: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite score columns where the update row (by id) has a value."""
    names = [n for n in updates.columns if n != "id"]
    fresh = updates.select("id", *[F.col(n).alias(f"_new_{n}") for n in names])
    out = deals.join(fresh, "id", "left")
    return out.withColumns({n: F.coalesce(f"_new_{n}", n) for n in names}).select(*deals.columns)


def apply_outcomes(table: DataFrame, outcomes: DataFrame, *, stamp: str, success_stamp: str) -> DataFrame:
    """Fold run outcomes (id, at, success) into the health counters of sources or crawl jobs.

    A success resets the failure counter, so only failures after the last success count:
    one aggregate finds the last success, a second counts what came later.
    """
    last = outcomes.groupBy("id").agg(
        F.max("at").alias("_last_at"), F.max(F.when(F.col("success"), F.col("at"))).alias("_last_ok")
    )
    after = outcomes.join(last, "id").filter(~F.col("success") & (F.col("_last_ok").isNull() | (F.col("at") > F.col("_last_ok"))))
    failures = after.groupBy("id").agg(F.count(F.lit(1)).alias("_failures"))
    out = table.join(last, "id", "left").join(failures, "id", "left")
    kept = F.when(F.col("_last_ok").isNull(), F.coalesce("consecutive_failures", F.lit(0))).otherwise(0)
    touched = F.col("_last_at").isNotNull()
    return out.withColumns(
        {
            stamp: F.coalesce("_last_at", stamp),
            success_stamp: F.coalesce("_last_ok", success_stamp),
            "consecutive_failures": F.when(touched, kept + F.coalesce("_failures", F.lit(0))).otherwise(F.col("consecutive_failures")),
        }
    ).select(*table.columns)
