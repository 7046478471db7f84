"""Upserts, change detection, ingest jobs, lifecycle and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import feedback, ingest, lifecycle
from ..operators.skew import side_by_side
from .extraction import _DISCOUNT_SQL, _INGEST_SQL
from .registry import query, rounded, stamp
from .views import NOW

LATER = 1_000_000_000
FEEDBACK_NOW = "2024-02-01 00:00:00"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def _k(modulus: int, rest: int = 0):
    return F.col("seq") % modulus == rest


def _repriced(df, price: float):
    return df.withColumn("deal_price", F.lit(price))


def _keyed(t):
    return t.listings.withColumn("source_id", F.col("seq") % 5)


def _stored(listings, at: str):
    return ingest.with_payload(listings).select(
        "source_id", "source_deal_id", "content_hash", F.lit(at).cast("timestamp").alias("fetched_at"), F.col("seq").alias("id")
    )


@query(
    f"""SELECT source_deal_id, seq, seq % 13 = 0 OR seq % 10 = 0 OR seq % 100 = 1 AS changed FROM listings
    UNION ALL SELECT source_deal_id, seq + {LATER}, true FROM listings WHERE seq % 50 = 3
    UNION ALL SELECT source_deal_id, seq + 2 * {LATER}, true FROM listings WHERE seq % 50 = 3"""
)
def change_detection(t):
    """History A (and B for some); the batch repeats A, changes the price, or goes A, B, A."""
    base = _keyed(t)
    history = _stored(base.filter(~_k(13)), "2001-07-01").unionByName(
        _stored(_repriced(base.filter(_k(100, 1)), 77.0), "2001-07-02")
    )
    again = base.filter(_k(50, 3))
    batch = (
        base.withColumn("deal_price", F.when(_k(10), F.lit(99.0)).otherwise(F.col("deal_price")))
        .unionByName(_repriced(again, 55.0).withColumn("seq", F.col("seq") + LATER))
        .unionByName(again.withColumn("seq", F.col("seq") + 2 * LATER))
    )
    return ingest.mark_changed(ingest.with_payload(batch), history).select("source_deal_id", "seq", "changed")


_UPSERTED_SQL = f"""
    SELECT source_deal_id, CASE WHEN id % 4 = 0 THEN 'New ' || title ELSE title END AS title,
      round(CASE WHEN id % 4 = 0 THEN 1.5 ELSE deal_price END, 6) AS deal_price, {TS.format('first_seen_at')},
      CASE WHEN id % 4 = 0 THEN '{NOW}' ELSE strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') END AS last_seen_at FROM deals
    UNION ALL SELECT 'n' || CAST(seq AS VARCHAR), CASE WHEN seq % 20 = 0 THEN 'Second' ELSE 'First' END, 1.5, '{NOW}', '{NOW}' FROM listings WHERE seq % 10 = 0"""


def _upsert(t):
    base = _keyed(t).select("source_id", "source_deal_id", "title", "seq")
    fresh = base.filter(_k(10)).withColumn("source_deal_id", F.concat(F.lit("n"), F.col("seq").cast("string")))
    batch = (
        base.filter(_k(4)).withColumn("title", F.concat(F.lit("New "), "title"))
        .unionByName(fresh.withColumn("title", F.lit("First")))
        .unionByName(fresh.filter(_k(20)).withColumns({"title": F.lit("Second"), "seq": F.col("seq") + LATER}))
        .withColumns({"deal_price": F.lit(1.5), "first_seen_at": F.lit("1999-01-01").cast("timestamp")})
    )
    return ingest.upsert(t.deals, batch, ingest.KEY, NOW)


@query(_UPSERTED_SQL)
def upsert_deals(t):
    return _upsert(t)[0].select(
        "source_deal_id", "title", rounded("deal_price"), stamp("first_seen_at").alias("first_seen_at"), stamp("last_seen_at").alias("last_seen_at")
    )


@query("SELECT 'updated' AS action, count(*) AS rows FROM listings WHERE seq % 4 = 0 UNION ALL SELECT 'inserted', count(*) FROM listings WHERE seq % 10 = 0")
def upsert_action_counts(t):
    return ingest.action_counts(_upsert(t)[1])


@query("""SELECT session_id, city_id FROM preferences UNION ALL SELECT session_id, NULL FROM
    (SELECT DISTINCT session_id || '-new' AS session_id FROM event_log)""")
def get_or_create_preferences(t):
    seen = t.event_log.select("session_id", F.col("event_id").alias("seq"))
    batch = seen.unionByName(seen.withColumn("session_id", F.concat("session_id", F.lit("-new"))))
    known = t.event_log.select("session_id").join(t.preferences.select("session_id"), "session_id", "left_anti")
    wanted = batch.join(known.distinct(), "session_id", "left_anti")
    return ingest.insert_missing(t.preferences, wanted, ["session_id"]).select("session_id", "city_id")


def _collected(t):
    deals = t.deals.withColumn("source_id", F.lit(9).cast("long"))
    fresh = t.listings.filter(_k(13)).withColumn("source_deal_id", F.concat(F.lit("n"), F.col("seq").cast("string")))
    return ingest.ingest_listings(deals, t.listings.unionByName(fresh), 9, NOW)


@query(
    f"""WITH {_INGEST_SQL}, rows_ AS (
      SELECT r.*, d.fetched_at AS f, d.last_seen_at AS ls FROM ruled r JOIN deals d ON d.id = r.seq
      UNION ALL SELECT r.* REPLACE ('n' || CAST(seq AS VARCHAR) AS source_deal_id), TIMESTAMP '{NOW}', NULL FROM ruled r WHERE seq % 13 = 0),
    done AS (SELECT *, {_DISCOUNT_SQL.format(o='orig', d='deal')} AS disc FROM rows_)
    SELECT source_deal_id, cat AS category, round(deal, 6) AS deal_price, disc AS discount_pct, quality AS quality_score, strftime(f, '%Y-%m-%d %H:%M:%S') AS fetched_at,
      strftime(ls, '%Y-%m-%d %H:%M:%S') AS last_seen_at,
      round(0.40 * least(coalesce(disc, 0) / 100, 1.0) + 0.35 * exp(-((epoch_us(TIMESTAMP '{NOW}') - epoch_us(f)) / 3.6e9) / 48.0) + 0.25 * quality, 4) AS rank_score FROM done"""
)
def ingest_listings(t):
    return _collected(t)["deals"].select(
        "source_deal_id", "category", rounded("deal_price"), "discount_pct", "quality_score", stamp("fetched_at").alias("fetched_at"),
        stamp("last_seen_at").alias("last_seen_at"), "rank_score",
    )


@query("SELECT count(*) AS rows, count(*) AS fallback, (SELECT count(*) FROM listings WHERE seq % 13 = 0) AS inserted FROM (SELECT 1 FROM listings UNION ALL SELECT 1 FROM listings WHERE seq % 13 = 0)")
def ingest_log(t):
    out = _collected(t)
    log = out["log"].agg(F.count(F.lit(1)).alias("rows"), F.count_if("fallback_used").alias("fallback"))
    return side_by_side(log, out["inserted"].agg(F.count(F.lit(1)).alias("inserted")))


_FP = "lower(rtrim(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''), '/'))"
_URL_SQL = f"""WITH act AS (SELECT *, {_FP} AS fp FROM deals WHERE is_active),
    win AS (SELECT *, first_value(source_id) OVER (PARTITION BY fp ORDER BY coalesce(quality_score, 0) DESC, fetched_at DESC, id DESC) AS w,
      bool_or(id % 3 = 0) OVER (PARTITION BY fp) AS has_new FROM act)"""


@query(f"{_URL_SQL} SELECT d.id, d.is_active AND NOT coalesce(w.source_id <> w.w, false) AS is_active FROM deals d LEFT JOIN win w ON w.id = d.id")
def url_duplicates(t):
    return ingest.flag_url_duplicates(t.deals)[0].select("id", "is_active")


@query(f"{_URL_SQL} SELECT count(*) FILTER (id % 3 = 0) AS checked, count(*) FILTER (has_new AND source_id <> w) AS flagged FROM win")
def url_duplicates_of_new_deals(t):
    return ingest.flag_url_duplicates(t.deals, t.deals.filter("id % 3 = 0").select("id"))[1]


def _feed(t):
    return t.venues.select(
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("external_id"), "name", F.lit("Old Town").alias("city"), "address", "lat", "lon",
        "category", "phone", F.lit("http://v").alias("website"), F.concat(F.lit("img"), F.col("id").cast("string")).alias("image_url"), F.col("id").alias("seq"),
    )


_FEED_SQL = """WITH m AS (SELECT * FROM mappings WHERE source_id = 2),
    unmapped AS (SELECT v.id, replace(replace(replace(lower(v.name), ' ', '-'), '''', ''), '&', 'and') || '-old-town' AS slug, v.name FROM venues v
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.external_id = 'x' || CAST(v.id AS VARCHAR))),
    firsts AS (SELECT slug, min(id) AS id FROM unmapped GROUP BY slug)"""


@query(f"""{_FEED_SQL} SELECT slug, CASE WHEN m.id IS NOT NULL THEN 'img' || CAST(v.id AS VARCHAR) END AS image_url FROM venues v LEFT JOIN m ON m.venue_id = v.id
    UNION ALL SELECT slug, 'img' || CAST(id AS VARCHAR) FROM firsts""")
def upsert_venues(t):
    return ingest.upsert_venues(t.venues, t.mappings, _feed(t), 2, 7, NOW)[0].select("slug", "image_url")


@query(f"""{_FEED_SQL} SELECT 'x' || CAST(v.id AS VARCHAR) AS external_id, CASE WHEN f.id IS NOT NULL THEN 'inserted' ELSE 'updated' END AS action,
    coalesce(v2.slug, u.slug) AS slug FROM venues v LEFT JOIN firsts f ON f.id = v.id LEFT JOIN unmapped u ON u.id = v.id
    LEFT JOIN m ON m.external_id = 'x' || CAST(v.id AS VARCHAR) LEFT JOIN venues v2 ON v2.id = m.venue_id""")
def venue_feed_actions(t):
    venues, _, actions = ingest.upsert_venues(t.venues, t.mappings, _feed(t), 2, 7, NOW)
    return actions.join(venues.select(F.col("id").alias("venue_id"), "slug"), "venue_id").select("external_id", "action", "slug")


@query(f"""{_FEED_SQL} SELECT source_id, count(*) AS mappings, count(*) FILTER (last_seen_at = TIMESTAMP '{NOW}') AS seen_now FROM (
      SELECT source_id, CASE WHEN source_id = 2 THEN TIMESTAMP '{NOW}' ELSE last_seen_at END AS last_seen_at FROM mappings
      UNION ALL SELECT 2, TIMESTAMP '{NOW}' FROM unmapped) GROUP BY source_id""")
def venue_feed_mappings(t):
    mappings = ingest.upsert_venues(t.venues, t.mappings, _feed(t), 2, 7, NOW)[1]
    seen = F.count_if(F.col("last_seen_at") == F.lit(NOW).cast("timestamp"))
    return mappings.groupBy("source_id").agg(F.count(F.lit(1)).alias("mappings"), seen.alias("seen_now"))


def _venue_batch(t):
    """Source 2: two thirds of the listings are known; a tenth of all has a new price."""
    base = t.listings.withColumn(
        "raw_data",
        F.to_json(
            F.struct(
                F.concat(F.lit("x"), (F.col("seq") % 1000).cast("string")).alias("venue_external_id"),
                F.when(_k(2), F.array(F.lit(0), F.lit(4))).otherwise(F.array().cast("array<int>")).alias("valid_day_indices"),
                F.when(~_k(4, 1), F.lit("10:00")).alias("start_time"), F.lit("12:00").alias("end_time"), F.lit(12.5).alias("discount_pct"),
            )
        ),
    )
    deals = t.deals.filter("id % 13 <> 0").withColumns(
        {"source_id": F.lit(2).cast("long"), "source_url": F.col("url"), "image_url": F.lit(None).cast("string"), "currency": F.lit("USD"), "is_verified": F.lit(False)}
    )
    known = _stored(base.filter(~_k(13)).withColumn("source_id", F.lit(2).cast("long")), "2001-07-01").withColumns(
        {"deal_id": F.col("id"), "raw_payload": F.lit(None).cast("string")}
    )
    log = t.normalization_log.withColumns(
        {"model": F.lit(None).cast("string"), "prompt_tokens": F.lit(None).cast("long"), "completion_tokens": F.lit(None).cast("long"),
         "raw_response": F.lit(None).cast("string"), "normalized_at": F.lit(None).cast("timestamp")}
    )
    state = ingest.VenueState(t.venues, t.mappings, deals, known, t.schedules, log)
    batch = base.withColumn("deal_price", F.when(_k(10), F.lit(99.0)).otherwise(F.col("deal_price")))
    return ingest.ingest_venue_batch(state, _feed(t), batch, 2, 7, NOW)


@query("""SELECT CASE WHEN seq % 13 = 0 THEN 'inserted' WHEN seq % 10 = 0 THEN 'updated' ELSE 'skipped' END AS action, count(*) AS rows FROM listings GROUP BY 1""")
def venue_batch_actions(t):
    return ingest.action_counts(_venue_batch(t)[1])


@query(
    f"""WITH {_INGEST_SQL.replace('FROM listings', "FROM (SELECT * REPLACE (CASE WHEN seq % 10 = 0 THEN 99e0 ELSE deal_price END AS deal_price) FROM listings)")},
    fresh AS (SELECT *, coalesce(nullif({_DISCOUNT_SQL.format(o='orig', d='deal')}, 0), 12.5) AS disc FROM ruled WHERE seq % 13 = 0 OR seq % 10 = 0)
    SELECT source_deal_id, cat AS category, round(deal, 6) AS deal_price, disc AS discount_pct, CAST(0.6 AS DOUBLE) AS confidence, '{NOW}' AS last_seen_at, '{NOW}' AS fetched_at,
      round(0.40 * least(disc / 100, 1.0) + 0.35 + 0.25 * quality, 4) AS rank_score FROM fresh
    UNION ALL SELECT source_deal_id, category, round(deal_price, 6), discount_pct, confidence, '{NOW}', strftime(fetched_at, '%Y-%m-%d %H:%M:%S'), rank_score FROM deals
      WHERE id % 13 <> 0 AND id % 10 <> 0"""
)
def venue_batch_deals(t):
    return _venue_batch(t)[0].deals.select(
        "source_deal_id", "category", rounded("deal_price"), "discount_pct", "confidence", stamp("last_seen_at").alias("last_seen_at"),
        stamp("fetched_at").alias("fetched_at"), "rank_score",
    )


@query("""SELECT d AS day_of_week, CASE WHEN seq % 4 <> 1 THEN '10:00' END AS start_time, count(*) AS rows FROM listings, (VALUES (0), (4)) AS days(d) WHERE seq % 13 = 0 AND seq % 2 = 0 GROUP BY 1, 2
    UNION ALL SELECT NULL, '10:00', count(*) FROM listings WHERE seq % 13 = 0 AND seq % 2 = 1 AND seq % 4 <> 1 GROUP BY 1, 2""")
def venue_batch_schedules(t):
    """Schedule rows are only written for inserted deals; ids tell them from the old ones."""
    after = _venue_batch(t)[0].schedules
    added = after.join(t.schedules.select("id"), "id", "left_anti")
    return added.groupBy("day_of_week", "start_time").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT count(*) AS deals_fetched, count(*) FILTER (seq % 13 = 0) AS deals_inserted, count(*) FILTER (seq % 13 <> 0 AND seq % 10 = 0) AS deals_updated,
    count(*) FILTER (seq % 13 <> 0 AND seq % 10 <> 0) AS deals_skipped, count(*) FILTER (seq % 13 = 0 OR seq % 10 = 0) AS records_raw,
    'success' AS status, CAST(90 AS DOUBLE) AS duration_seconds FROM listings""")
def venue_batch_run(t):
    run = ingest.run_row(_venue_batch(t)[1], 2, NOW, "2001-08-01 12:01:30")
    return run.select("deals_fetched", "deals_inserted", "deals_updated", "deals_skipped", "records_raw", "status", "duration_seconds")


@query(
    f"""SELECT source_deal_id, round(deal_price, 6) AS deal_price, quality_score, CASE WHEN is_active THEN round(0.40 * least(coalesce(discount_pct, 0) / 100, 1.0)
      + 0.35 * exp(-((epoch_us(TIMESTAMP '{NOW}') - epoch_us(fetched_at)) / 3.6e9) / 48.0) + 0.25 * coalesce(quality_score, 0.5), 4) ELSE rank_score END AS rank_score
    FROM (SELECT source_deal_id, deal_price, quality_score, is_active, discount_pct, fetched_at, rank_score FROM deals UNION ALL
      SELECT 'b' || CAST(seq AS VARCHAR), deal_price, 0.75, true, {_DISCOUNT_SQL.format(o='original_price', d='deal_price')}, TIMESTAMP '{NOW}', NULL FROM listings WHERE seq % 6 = 0)"""
)
def backfill(t):
    """Known listings are skipped; those under a new id are inserted."""
    deals = t.deals.withColumn("source_id", F.lit(1).cast("long"))
    fresh = t.listings.filter(_k(6)).withColumn("source_deal_id", F.concat(F.lit("b"), F.col("seq").cast("string")))
    out = ingest.backfill(deals, t.listings.unionByName(fresh), 1, NOW)
    return out.select("source_deal_id", rounded("deal_price"), "quality_score", "rank_score")


@query("""SELECT deal_id, day_of_week, start_time FROM schedules WHERE deal_id % 5 <> 0 UNION ALL SELECT o_orderkey, CAST(6 AS INT), '08:00' FROM orders WHERE o_orderkey % 5 = 0""")
def replace_schedules(t):
    new = t.deals.filter("id % 5 = 0").select(F.col("id").alias("deal_id"), F.lit(6).alias("day_of_week"), F.lit("08:00").alias("start_time"))
    return ingest.replace_schedules(t.schedules, new).select("deal_id", "day_of_week", "start_time")


# --- lifecycle --------------------------------------------------------------------


@query(f"SELECT id, is_active AND NOT coalesce(expires_at < TIMESTAMP '{NOW}', false) AS is_active FROM deals")
def purge_expired(t):
    return lifecycle.purge_expired(t.deals, NOW)[0].select("id", "is_active")


@query(f"""SELECT (SELECT count(*) FROM deals WHERE is_active AND expires_at < TIMESTAMP '{NOW}') AS active_only,
    (SELECT count(*) FROM deals WHERE expires_at < TIMESTAMP '{NOW}') AS with_inactive""")
def purge_expired_counts(t):
    one = lifecycle.purge_expired(t.deals, NOW)[1].withColumnRenamed("flagged", "active_only")
    both = lifecycle.purge_expired(t.deals, NOW, count_inactive=True)[1].withColumnRenamed("flagged", "with_inactive")
    return side_by_side(one, both)


@query(f"SELECT id, is_active AND NOT coalesce(last_seen_at < TIMESTAMP '{NOW}' - INTERVAL 96 HOUR, false) AS is_active FROM deals")
def mark_stale(t):
    return lifecycle.mark_stale(t.deals, NOW)[0].select("id", "is_active")


@query("""SELECT id, is_active AND id % 6 <> 0 AS is_active, CASE WHEN id % 4 = 0 THEN 0.125 ELSE quality_score END AS quality_score, confidence FROM deals""")
def update_scores(t):
    updates = t.deals.filter("id % 4 = 0").select("id", F.lit(0.125).alias("quality_score"), F.lit(None).cast("double").alias("confidence"))
    scored = lifecycle.update_scores(t.deals, updates)
    return lifecycle.deactivate(scored, t.deals.filter("id % 6 = 0").select("id")).select("id", "is_active", "quality_score", "confidence")


@query("""WITH ok AS (SELECT source_id, max(started_at) AS last_ok FROM runs WHERE status = 'success' GROUP BY 1)
    SELECT s.id, strftime((SELECT max(started_at) FROM runs r WHERE r.source_id = s.id), '%Y-%m-%d %H:%M:%S') AS last_fetched_at,
      strftime(ok.last_ok, '%Y-%m-%d %H:%M:%S') AS last_successful_at,
      (SELECT count(*) FROM runs r WHERE r.source_id = s.id AND r.status = 'error' AND r.started_at > ok.last_ok) AS consecutive_failures
    FROM sources s JOIN ok ON ok.source_id = s.id""")
def source_health(t):
    none = F.lit(None).cast("timestamp")
    table = t.sources.select("id", "consecutive_failures", none.alias("last_fetched_at"), none.alias("last_successful_at"))
    outcomes = t.runs.select(F.col("source_id").alias("id"), F.col("started_at").alias("at"), (F.col("status") == "success").alias("success"))
    out = lifecycle.apply_outcomes(table, outcomes, stamp="last_fetched_at", success_stamp="last_successful_at")
    return out.select("id", stamp("last_fetched_at").alias("last_fetched_at"), stamp("last_successful_at").alias("last_successful_at"), "consecutive_failures")


# --- feedback ---------------------------------------------------------------------

_RUNNING_SQL = """WITH rep AS (SELECT * FROM event_log WHERE event_type IN ('report_incorrect', 'report_expired') AND deal_id IS NOT NULL),
    running AS (SELECT event_id, deal_id,
      count(*) FILTER (event_type = 'report_incorrect') OVER w AS n_incorrect, count(*) FILTER (event_type = 'report_expired') OVER w AS n_expired
      FROM rep WINDOW w AS (PARTITION BY deal_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING))"""


@query(f"{_RUNNING_SQL} SELECT event_id, deal_id, n_incorrect, n_expired, n_incorrect >= 3 AS demote, n_expired >= 3 AS expire FROM running")
def report_actions(t):
    out = feedback.report_actions(feedback.running_reports(t.event_log))
    return out.select("event_id", "deal_id", "n_incorrect", "n_expired", "demote", "expire")


@query(
    f"""{_RUNNING_SQL.replace("event_log WHERE", "(SELECT * REPLACE (date_trunc('month', created_at) AS created_at, deal_id % 7 AS deal_id) FROM event_log) WHERE")}
    SELECT event_id, deal_id, n_incorrect, n_expired, n_incorrect >= 3 AS demote, n_expired >= 3 AS expire FROM running"""
)
def report_actions_scan(t):
    """Seven deals with all their reports at one instant, counted in ranges of 200 rows."""
    events = t.event_log.withColumns({"created_at": F.date_trunc("month", "created_at"), "deal_id": F.col("deal_id") % 7})
    out = feedback.report_actions(feedback.running_reports(events, rows_per_part=200))
    return out.select("event_id", "deal_id", "n_incorrect", "n_expired", "demote", "expire")


@query(
    f"""{_RUNNING_SQL}, acts AS (SELECT deal_id, count(*) FILTER (n_incorrect >= 3) AS n, bool_or(n_expired >= 3) AS x FROM running GROUP BY deal_id)
    SELECT id, CASE WHEN coalesce(n, 0) > 0 THEN greatest(round(coalesce(quality_score, 0.5) - 0.3 * n, 3), 0) ELSE quality_score END AS quality_score,
      CASE WHEN coalesce(n, 0) > 0 THEN greatest(round(coalesce(confidence, 0.5) - 0.3 * n, 3), 0) ELSE confidence END AS confidence,
      is_active AND NOT coalesce(x, false) AS is_active,
      strftime(CASE WHEN is_active AND coalesce(x, false) AND (expires_at IS NULL OR expires_at > TIMESTAMP '{FEEDBACK_NOW}') THEN TIMESTAMP '{FEEDBACK_NOW}' ELSE expires_at END, '%Y-%m-%d %H:%M:%S') AS expires_at
    FROM deals LEFT JOIN acts ON acts.deal_id = deals.id"""
)
def apply_reports(t):
    out = feedback.apply_reports(t.deals, t.event_log, FEEDBACK_NOW)[0]
    return out.select("id", "quality_score", "confidence", "is_active", stamp("expires_at").alias("expires_at"))


@query("""SELECT o_orderkey AS id, substr(sha256('feed:d' || CAST(o_orderkey AS VARCHAR)), 1, 16) AS listing_id, substr(sha256(o_orderpriority), 1, 12) AS content_id FROM orders""")
def listing_ids(t):
    k = F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))
    return t.base("orders").select(
        F.col("o_orderkey").alias("id"), hashing.listing_id(F.lit("feed"), k).alias("listing_id"), hashing.content_id(F.col("o_orderpriority")).alias("content_id")
    )
