"""User reports -> quality and lifecycle changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import REPORT_TYPES
from .skew import running_counts, running_counts_scan

# --- fixed values -----------------------------------------------------------------
INCORRECT_THRESHOLD = 3
EXPIRED_THRESHOLD = 3
DEMOTION = 0.3
UNKNOWN_SCORE = 0.5
# ----------------------------------------------------------------------------------


def running_reports(
    events: DataFrame, prior: DataFrame | None = None, chunk: Column | None = None, *, rows_per_part: int | None = None
) -> DataFrame:
    """Report events with the counts of both types so far on their deal, in event order.

    ``prior`` (deal_id, n_incorrect, n_expired) holds counts from before these events.
    ``chunk`` cuts the history of a deal into pieces that one task can sort; an hour by default.
    With ``rows_per_part`` pieces are bounded in rows instead, for deals with very many reports
    at one time; this reads and writes the reports once more.
    """
    reports = events.filter(F.col("event_type").isin(*REPORT_TYPES) & F.col("deal_id").isNotNull()).select(
        "event_id", "event_type", "deal_id", "created_at"
    )
    flags = {
        "n_incorrect": F.col("event_type") == REPORT_TYPES[0],
        "n_expired": F.col("event_type") == REPORT_TYPES[1],
    }
    order = ["created_at", "event_id"]
    if rows_per_part is None:
        counted = running_counts(reports, "deal_id", order, F.date_trunc("hour", "created_at") if chunk is None else chunk, flags)
    else:
        counted = running_counts_scan(reports, "deal_id", order, flags, rows_per_part)
    if prior is None:
        return counted
    earlier = prior.select("deal_id", F.col("n_incorrect").alias("_i"), F.col("n_expired").alias("_e"))
    return counted.join(earlier, "deal_id", "left").withColumns(
        {
            "n_incorrect": F.col("n_incorrect") + F.coalesce("_i", F.lit(0)),
            "n_expired": F.col("n_expired") + F.coalesce("_e", F.lit(0)),
        }
    ).drop("_i", "_e")


def report_actions(running: DataFrame) -> DataFrame:
    """What each report event triggers: once three 'incorrect' reports are in, every further
    report of either type demotes again; three 'expired' reports expire the deal."""
    return running.withColumns(
        {
            "demote": F.col("n_incorrect") >= INCORRECT_THRESHOLD,
            "expire": F.col("n_expired") >= EXPIRED_THRESHOLD,
        }
    )


def deal_actions(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Per deal: number of demotions and whether it expires."""
    return report_actions(running_reports(events, prior)).groupBy("deal_id").agg(
        F.count_if("demote").alias("demotions"), F.bool_or("expire").alias("expire")
    )


def apply_actions(deals: DataFrame, actions: DataFrame, now: str) -> DataFrame:
    """Next deals table.  Scores drop by 0.3 per demotion, unknown scores counting as 0.5."""
    at = F.lit(now).cast("timestamp")
    acts = actions.select(F.col("deal_id").alias("id"), F.col("demotions").alias("_n"), F.col("expire").alias("_x"))
    out = deals.join(acts, "id", "left")
    n = F.coalesce("_n", F.lit(0))
    ends = F.coalesce("_x", F.lit(False)) & F.col("is_active")

    def lowered(name: str) -> Column:
        current = F.coalesce(name, F.lit(UNKNOWN_SCORE))
        return F.when(n > 0, F.greatest(F.round(current - n * DEMOTION, 3), F.lit(0.0))).otherwise(F.col(name))

    return out.withColumns(
        {
            "quality_score": lowered("quality_score"),
            "confidence": lowered("confidence"),
            "expires_at": F.when(ends & (F.col("expires_at").isNull() | (F.col("expires_at") > at)), at).otherwise(F.col("expires_at")),
            "is_active": F.col("is_active") & ~ends,
        }
    ).select(*deals.columns)


def apply_reports(deals: DataFrame, events: DataFrame, now: str, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """-> (next deals table, actions per deal that exists)."""
    actions = deal_actions(events, prior)
    known = actions.join(deals.select(F.col("id").alias("deal_id")), "deal_id", "left_semi")
    return apply_actions(deals, actions, now), known
