"""Counts, freshness and report summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from .skew import side_by_side

REPORT_TYPES = ("report_incorrect", "report_expired")


def _before(now: str, hours: float) -> Column:
    return F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(hours * 3600))


def deals_by_category(deals: DataFrame, *, active_only: bool = True, null_label: str | None = "Unknown") -> DataFrame:
    """Most frequent category first."""
    kept = deals.filter("is_active") if active_only else deals
    label = F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).otherwise(null_label) if null_label else F.col("category")
    return kept.groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("deals")).orderBy(F.desc("deals"), "category")


def admin_stats(deals: DataFrame, normalization_log: DataFrame, runs: DataFrame) -> DataFrame:
    """One row; every table is read once."""
    d = deals.agg(F.count(F.lit(1)).alias("total_deals"), F.count_if("is_active").alias("active_deals"))
    n = normalization_log.agg(
        F.count_if(~F.col("fallback_used")).alias("ai_normalized"), F.count_if("fallback_used").alias("fallback_normalized")
    )
    r = runs.agg(F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("status") == "error").alias("failed_runs"))
    return side_by_side(d, n, r)


def source_stats(deals: DataFrame, sources: DataFrame, now: str | None = None) -> DataFrame:
    """Active (and, with ``now``, fresh) deals of every source; sources without any count 0."""
    aggs = [F.count(F.lit(1)).alias("deals_active")]
    if now:
        aggs.append(F.count_if(F.col("last_seen_at") >= _before(now, 24)).alias("deals_fresh_24h"))
    counts = deals.filter("is_active").groupBy(F.col("source_id").alias("id")).agg(*aggs)
    names = [n for n in counts.columns if n != "id"]
    return sources.join(counts, "id", "left").fillna(0, names)


def city_status(deals: DataFrame, cities: DataFrame, now: str) -> DataFrame:
    """Freshness of every city that has an active deal.  Deals never seen do not set the age."""
    at = F.lit(now).cast("timestamp")
    counts = deals.filter("is_active").groupBy(F.col("city_id").alias("id")).agg(
        F.count(F.lit(1)).alias("deals_active"),
        F.count_if(F.col("last_seen_at") >= _before(now, 24)).alias("deals_fresh_24h"),
        F.round(geo.hours_between(F.min("last_seen_at"), at), 1).alias("oldest_deal_hours"),
    )
    return cities.select("id", F.col("name").alias("city_name")).join(counts, "id").withColumnRenamed("id", "city_id")


def cities_with_deals(deals: DataFrame, cities: DataFrame) -> DataFrame:
    return cities.join(deals.filter("is_active").select(F.col("city_id").alias("id")), "id", "left_semi")


def global_status(deals: DataFrame, now: str) -> DataFrame:
    out = deals.filter("is_active").agg(
        F.count(F.lit(1)).alias("total_active_deals"),
        F.count_if(F.col("last_seen_at") >= _before(now, 24)).alias("total_fresh_24h"),
    )
    return out.withColumn("stale", (F.col("total_fresh_24h") == 0) & (F.col("total_active_deals") > 0))


def health(deals: DataFrame, now: str) -> DataFrame:
    """Freshness by fetch time, with a status word."""
    at = F.lit(now).cast("timestamp")
    out = deals.filter("is_active").agg(
        F.count(F.lit(1)).alias("deals_total"),
        F.count_if(F.col("fetched_at") >= _before(now, 24)).alias("deals_fresh_24h"),
        F.round(geo.hours_between(F.min("fetched_at"), at), 1).alias("oldest_deal_hours"),
    )
    stale = (F.col("deals_fresh_24h") == 0) & (F.col("deals_total") > 0)
    return out.withColumn("stale", stale).withColumn("status", F.when(F.col("stale"), "degraded").otherwise("ok"))


def count_events(
    events: DataFrame, *, deal_id: int | None = None, event_type: str | None = None, since: str | None = None
) -> DataFrame:
    out = events
    if deal_id is not None:
        out = out.filter(F.col("deal_id") == deal_id)
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    if since:
        out = out.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return out.agg(F.count(F.lit(1)).alias("events"))


def event_counts(events: DataFrame) -> DataFrame:
    """The table form of ``count_events``."""
    return events.groupBy("deal_id", "event_type").agg(F.count(F.lit(1)).alias("events"))


def venue_details(venues: DataFrame, cities: DataFrame, deals: DataFrame) -> DataFrame:
    """Active venues with their city and the number of their active deals."""
    counts = deals.filter("is_active").groupBy(F.col("venue_id").alias("id")).agg(F.count(F.lit(1)).alias("deal_count"))
    city = cities.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"), F.col("slug").alias("city_slug"))
    return venues.filter("is_active").join(city, "city_id", "left").join(counts, "id", "left").fillna(0, ["deal_count"])


def venue_mapping_counts(venues: DataFrame, mappings: DataFrame) -> DataFrame:
    counts = mappings.groupBy(F.col("venue_id").alias("id")).agg(F.count(F.lit(1)).alias("source_count"))
    return venues.join(counts, "id", "left").fillna(0, ["source_count"])


def report_events(events: DataFrame, deals: DataFrame, cities: DataFrame, city_slug: str | None = None) -> DataFrame:
    """Report events, of one city if the slug is known; an unknown slug filters nothing."""
    reports = events.filter(F.col("event_type").isin(*REPORT_TYPES))
    if not city_slug:
        return reports
    city = cities.filter(F.col("slug") == city_slug).select(F.col("id").alias("city_id"))
    known = city.agg(F.count(F.lit(1))).scalar()
    # A slug names one city, so this side is one row.
    in_city = deals.join(F.broadcast(city), "city_id", "left_semi").select(F.col("id").alias("deal_id"), F.lit(True).alias("_here"))
    return reports.join(in_city, "deal_id", "left").filter(F.col("_here") | (known == 0)).drop("_here")


def reports_per_deal(reports: DataFrame) -> DataFrame:
    """Counts of both types per deal (NULL included) and the first event, which breaks ties."""
    return reports.groupBy("deal_id").agg(
        F.count_if(F.col("event_type") == REPORT_TYPES[0]).alias("incorrect_reports"),
        F.count_if(F.col("event_type") == REPORT_TYPES[1]).alias("expired_reports"),
        F.count(F.lit(1)).alias("total_reports"),
        F.min("event_id").alias("first_event"),
    )


def most_reported(per_deal: DataFrame, deals: DataFrame, sources: DataFrame, cities: DataFrame, limit: int = 20) -> DataFrame:
    """The deals with most reports; among equals the one reported first."""
    ranked = per_deal.filter("deal_id IS NOT NULL").orderBy(F.desc("total_reports"), "first_event")
    top = F.broadcast(ranked.limit(limit))
    detail = deals.select(F.col("id").alias("deal_id"), "title", "source_id", "city_id", "is_active", "quality_score")
    return (
        detail.join(top, "deal_id")
        .join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left")
        .join(cities.select(F.col("id").alias("city_id"), F.col("name").alias("city")), "city_id", "left")
        .drop("source_id", "city_id", "first_event")
    )


def reports_summary(
    events: DataFrame, deals: DataFrame, sources: DataFrame, cities: DataFrame, city_slug: str | None = None, limit: int = 20
) -> DataFrame:
    """Long form (section, key, reports): total, by type, by source and by city of all deals, and the top deals.

    All sections come from the counts per deal, whose shuffle Spark reuses.
    """
    per_deal = reports_per_deal(report_events(events, deals, cities, city_slug))
    sums = per_deal.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("total_reports", "incorrect_reports", "expired_reports")]
    )
    named = F.array(
        *[
            F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), F.col(n).alias("reports"))
            for section, key, n in (
                ("total", "all", "total_reports"),
                ("by_type", REPORT_TYPES[0], "incorrect_reports"),
                ("by_type", REPORT_TYPES[1], "expired_reports"),
            )
        ]
    )
    placed = per_deal.join(deals.select(F.col("id").alias("deal_id"), "source_id", "city_id"), "deal_id")
    parts = []
    for section, table, key in (("by_source", sources, "source_id"), ("by_city", cities, "city_id")):
        counts = placed.groupBy(key).agg(F.sum("total_reports").alias("reports"))
        names = table.select(F.col("id").alias(key), F.col("name").alias("key"))
        parts.append(counts.join(names, key).groupBy("key").agg(F.sum("reports").alias("reports")).select(F.lit(section).alias("section"), "key", "reports"))
    top = most_reported(per_deal, deals, sources, cities, limit)
    parts.append(top.select(F.lit("deal").alias("section"), F.col("deal_id").cast("string").alias("key"), F.col("total_reports").alias("reports")))
    return reduce(DataFrame.unionByName, parts, sums.select(F.inline(named)))


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs of every source."""
    newest = W.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)


def orchestrator_totals(runs: DataFrame) -> DataFrame:
    """One row of sums over a set of finished runs."""
    return runs.agg(
        F.sum("deals_fetched").alias("total_fetched"),
        F.sum("deals_inserted").alias("total_inserted"),
        F.sum("deals_updated").alias("total_updated"),
        F.count("error_msg").alias("total_errors"),
        F.count_distinct("source").alias("sources_run"),
    )


def orchestrator_errors(runs: DataFrame) -> DataFrame:
    """One row per failed run: '<source>: <error>'."""
    failed = runs.filter(F.col("error_msg").isNotNull())
    return failed.select(F.col("id").alias("run_id"), F.concat_ws(": ", "source", "error_msg").alias("error"))
