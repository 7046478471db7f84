"""Counts, freshness, report summaries, row validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as r
from ..operators import validate as val
from .registry import query, rounded, stamp
from .views import NOW

FRESH = f"last_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR"
HOURS = f"round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(min({{}}))) / 3.6e9, 1)"
REPORTS = "event_type IN ('report_incorrect', 'report_expired')"


@query("SELECT coalesce(category, 'Unknown') AS category, count(*) AS deals FROM deals WHERE is_active GROUP BY 1")
def deals_by_category(t):
    return r.deals_by_category(t.deals)


@query("SELECT category, count(*) AS deals FROM deals WHERE is_active GROUP BY 1")
def deals_by_raw_category(t):
    return r.deals_by_category(t.deals, null_label=None)


@query("""SELECT (SELECT count(*) FROM deals) AS total_deals, (SELECT count(*) FROM deals WHERE is_active) AS active_deals,
    (SELECT count(*) FROM normalization_log WHERE NOT fallback_used) AS ai_normalized,
    (SELECT count(*) FROM normalization_log WHERE fallback_used) AS fallback_normalized,
    (SELECT count(*) FROM runs) AS total_runs, (SELECT count(*) FROM runs WHERE status = 'error') AS failed_runs""")
def admin_stats(t):
    return r.admin_stats(t.deals, t.normalization_log, t.runs)


@query(f"""SELECT s.id, s.name, s.is_active, count(d.id) AS deals_active, count(d.id) FILTER ({FRESH}) AS deals_fresh_24h
    FROM sources s LEFT JOIN deals d ON d.source_id = s.id AND d.is_active GROUP BY ALL""")
def source_status(t):
    return r.source_stats(t.deals, t.sources, NOW).select("id", "name", "is_active", "deals_active", "deals_fresh_24h")


@query(f"""SELECT c.id AS city_id, c.name AS city_name, count(*) AS deals_active, count(*) FILTER ({FRESH}) AS deals_fresh_24h,
    {HOURS.format('last_seen_at')} AS oldest_deal_hours FROM cities c JOIN deals d ON d.city_id = c.id WHERE d.is_active GROUP BY c.id, c.name""")
def city_status(t):
    return r.city_status(t.deals, t.cities, NOW)


@query("SELECT id, slug FROM cities c WHERE EXISTS (SELECT 1 FROM deals d WHERE d.city_id = c.id AND d.is_active)")
def cities_with_deals(t):
    return r.cities_with_deals(t.deals, t.cities).select("id", "slug")


@query(f"""SELECT count(*) AS total_active_deals, count(*) FILTER ({FRESH}) AS total_fresh_24h,
    count(*) FILTER ({FRESH}) = 0 AND count(*) > 0 AS stale FROM deals WHERE is_active""")
def ingest_status(t):
    return r.global_status(t.deals, NOW)


@query(f"""SELECT *, CASE WHEN stale THEN 'degraded' ELSE 'ok' END AS status FROM (
    SELECT count(*) AS deals_total, count(*) FILTER (fetched_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS deals_fresh_24h,
    {HOURS.format('fetched_at')} AS oldest_deal_hours,
    count(*) FILTER (fetched_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) = 0 AND count(*) > 0 AS stale FROM deals WHERE is_active)""")
def health(t):
    return r.health(t.deals, NOW)


@query("SELECT count(*) AS events FROM event_log WHERE event_type = 'view' AND created_at >= TIMESTAMP '2024-01-10 00:00:00'")
def count_events(t):
    return r.count_events(t.event_log, event_type="view", since="2024-01-10 00:00:00")


@query("SELECT deal_id, event_type, count(*) AS events FROM event_log GROUP BY 1, 2")
def event_counts(t):
    return r.event_counts(t.event_log)


@query("""SELECT c.slug, e.event_type, count(*) AS events FROM event_log e JOIN deals d ON d.id = e.deal_id JOIN cities c ON c.id = d.city_id GROUP BY 1, 2""")
def events_by_city(t):
    """Events are counted per deal first, so only one row per deal and type is joined."""
    per_deal = r.event_counts(t.event_log)
    city = t.cities.select(F.col("id").alias("city_id"), "slug")
    deals = t.deals.select(F.col("id").alias("deal_id"), "city_id")
    return per_deal.join(deals, "deal_id").join(city, "city_id").groupBy("slug", "event_type").agg(F.sum("events").alias("events"))


@query("""SELECT v.id, count(m.id) AS source_count FROM venues v LEFT JOIN mappings m ON m.venue_id = v.id GROUP BY v.id""")
def venue_mapping_counts(t):
    return r.venue_mapping_counts(t.venues, t.mappings).select("id", "source_count")


@query("""SELECT v.id, v.name, c.slug AS city_slug, count(d.id) AS deal_count FROM venues v LEFT JOIN cities c ON c.id = v.city_id
    LEFT JOIN deals d ON d.venue_id = v.id AND d.is_active WHERE v.is_active GROUP BY ALL""")
def venue_details(t):
    return r.venue_details(t.venues, t.cities, t.deals).select("id", "name", "city_slug", "deal_count")


def _summary_sql(where: str) -> str:
    return f"""WITH rep AS (SELECT e.* FROM event_log e {where}),
    per_deal AS (SELECT deal_id, count(*) AS n, count(*) FILTER (event_type = 'report_incorrect') AS i,
      count(*) FILTER (event_type = 'report_expired') AS x, min(event_id) AS f FROM rep WHERE deal_id IS NOT NULL GROUP BY deal_id),
    top AS (SELECT * FROM per_deal ORDER BY n DESC, f LIMIT 20),
    det AS (SELECT t.*, d.title, d.is_active, d.quality_score, s.name AS source, c.name AS city FROM top t JOIN deals d ON d.id = t.deal_id
      LEFT JOIN sources s ON s.id = d.source_id LEFT JOIN cities c ON c.id = d.city_id),
    everywhere AS (SELECT p.n, s.name AS source, c.name AS city FROM per_deal p JOIN deals d ON d.id = p.deal_id
      LEFT JOIN sources s ON s.id = d.source_id LEFT JOIN cities c ON c.id = d.city_id)"""


_SECTIONS = """
    SELECT 'total' AS section, 'all' AS key, count(*) AS reports FROM rep
    UNION ALL SELECT 'by_type', 'report_incorrect', count(*) FILTER (event_type = 'report_incorrect') FROM rep
    UNION ALL SELECT 'by_type', 'report_expired', count(*) FILTER (event_type = 'report_expired') FROM rep
    UNION ALL SELECT 'by_source', source, CAST(sum(n) AS BIGINT) FROM everywhere WHERE source IS NOT NULL GROUP BY source
    UNION ALL SELECT 'by_city', city, CAST(sum(n) AS BIGINT) FROM everywhere WHERE city IS NOT NULL GROUP BY city
    UNION ALL SELECT 'deal', CAST(deal_id AS VARCHAR), n FROM det"""


@query(_summary_sql(f"WHERE {REPORTS}") + _SECTIONS)
def reports_summary(t):
    return r.reports_summary(t.event_log, t.deals, t.sources, t.cities)


@query(
    _summary_sql(f"JOIN deals d ON d.id = e.deal_id JOIN cities c ON c.id = d.city_id WHERE {REPORTS} AND c.slug = 'nation-4'") + _SECTIONS
)
def reports_summary_city(t):
    return r.reports_summary(t.event_log, t.deals, t.sources, t.cities, city_slug="nation-4")


@query(
    _summary_sql(f"WHERE {REPORTS}")
    + " SELECT deal_id, title, source, city, i AS incorrect_reports, x AS expired_reports, n AS total_reports, is_active, quality_score FROM det"
)
def most_reported(t):
    reports = r.report_events(t.event_log, t.deals, t.cities, "no-such-city")
    return r.most_reported(r.reports_per_deal(reports), t.deals, t.sources, t.cities)


@query("""SELECT id, source_id, status, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, CAST(place AS INT) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS place FROM runs) WHERE place <= 20""")
def recent_runs(t):
    return r.recent_runs(t.runs).select("id", "source_id", "status", stamp("started_at").alias("started_at"), "place")


@query("""SELECT CAST(sum(deals_fetched) AS BIGINT) AS total_fetched, CAST(sum(deals_inserted) AS BIGINT) AS total_inserted,
    CAST(sum(deals_updated) AS BIGINT) AS total_updated, count(error_msg) AS total_errors, count(DISTINCT source) AS sources_run FROM runs""")
def orchestrator_totals(t):
    return r.orchestrator_totals(t.runs)


@query("SELECT id AS run_id, source || ': ' || error_msg AS error FROM runs WHERE error_msg IS NOT NULL")
def orchestrator_errors(t):
    return r.orchestrator_errors(t.runs)


@query("""SELECT event_id, CASE
      WHEN event_type IS NULL OR event_type NOT IN ('click','view','search','filter','report','feedback','ingest_trigger','save','report_incorrect','report_expired','rating') THEN 'type'
      WHEN event_type = 'rating' AND NOT coalesce(TRY_CAST(payload->>'$.value' AS DOUBLE) IN (1, 2, 3, 4, 5), false) THEN 'rating' ELSE 'ok' END AS verdict,
    substr(sha256(ip), 1, 32) AS ip_hash FROM event_log""")
def event_validation(t):
    from ..functions.hashing import ip_hash

    good, bad = val.split_rows(t.event_log, val.event_reason())
    why = F.when(F.col("reject_reason").startswith("rating"), "rating").otherwise("type")
    both = good.select("event_id", F.lit("ok").alias("verdict"), "ip").unionByName(bad.select("event_id", why.alias("verdict"), "ip"))
    return both.select("event_id", "verdict", ip_hash(F.col("ip")).alias("ip_hash"))


@query("""SELECT id, CASE WHEN CAST(id % 10 AS INT) - 1 NOT BETWEEN 0 AND 6 THEN 'day_of_week must be 0 (Mon) - 6 (Sun)'
      WHEN id % 4 = 1 THEN 'Time must be in HH:MM format' WHEN id % 4 = 2 THEN 'Invalid time value' END AS reject_reason FROM schedules""")
def schedule_validation(t):
    broken = F.when(F.col("id") % 4 == 1, F.lit("9h30")).when(F.col("id") % 4 == 2, F.lit("24:10")).otherwise(F.lit("9:30"))
    rows = t.schedules.withColumns({"day_of_week": (F.col("id") % 10 - 1).cast("int"), "start_time": broken})
    return rows.select("id", val.schedule_reason().alias("reject_reason"))


@query("""SELECT session_id, CASE WHEN min_discount_pct NOT BETWEEN 0 AND 100 THEN 'min_discount_pct must be between 0 and 100'
    WHEN radius_miles <= 0 THEN 'radius_miles must be positive' END AS reject_reason FROM preferences""")
def preference_validation(t):
    return t.preferences.select("session_id", val.preference_reason().alias("reject_reason"))


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal / 8e1 NOT BETWEEN -90 AND 90 THEN 'lat must be between -90 and 90'
    WHEN c_acctbal / 3e1 NOT BETWEEN -180 AND 180 THEN 'lon must be between -180 and 180'
    WHEN c_acctbal / 5e0 <= 0 OR c_acctbal / 5e0 > 500 THEN 'radius_miles must be between 0 and 500' END AS reject_reason FROM customer""")
def geo_validation(t):
    rows = t.base("customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 80).alias("lat"), (F.col("c_acctbal") / 30).alias("lon"), (F.col("c_acctbal") / 5).alias("radius")
    )
    return rows.select("id", val.geo_reason(radius="radius").alias("reject_reason"))


@query("""SELECT session_id, CASE WHEN city_id % 2 = 0 THEN city_id + 100 ELSE city_id END AS city_id,
    round(CASE WHEN city_id % 2 = 0 THEN NULL ELSE max_price END, 6) AS max_price, first_choice FROM preferences""")
def preference_update(t):
    updates = t.preferences.filter("city_id % 2 = 0").select(
        "session_id", (F.col("city_id") + 100).alias("city_id"), F.lit(None).cast("double").alias("max_price"), F.lit("ignored").alias("first_choice")
    )
    return val.update_preferences(t.preferences, updates).select("session_id", "city_id", rounded("max_price"), "first_choice")
