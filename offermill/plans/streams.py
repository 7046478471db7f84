"""Streaming jobs run to the end over the given tables; their results equal the batch twins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import tables
from ..sources.store import Store
from ..streaming import jobs, keyed, stored
from .extraction import _DISCOUNT_SQL, _INGEST_SQL
from .ingestion import _RUNNING_SQL, LATER
from .registry import query, stamp
from .views import NOW, VIEWS


def _stream(t, base: str, name: str) -> DataFrame:
    """A domain view over a file stream of its base table."""
    schema = t.base(base).schema
    t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{base}*.parquet").createOrReplaceTempView(f"stream_of_{base}")
    return t.spark.sql(VIEWS[name].format(**{base: f"stream_of_{base}"}))


@query(f"{_RUNNING_SQL} SELECT event_id, deal_id, n_incorrect, n_expired, n_incorrect >= 3 AS demote, n_expired >= 3 AS expire FROM running")
def stream_report_actions(t):
    root = tables.shared_folder(t.spark)
    jobs.stream_report_actions(_stream(t, "events", "event_log"), root).awaitTermination()
    return t.spark.read.parquet(f"{root}/report_actions").select("event_id", "deal_id", "n_incorrect", "n_expired", "demote", "expire")


@query(
    """SELECT event_id, substr(sha256(ip), 1, 32) AS ip_hash, coalesce(event_type IN ('report_incorrect', 'report_expired', 'view')
      OR (event_type = 'rating' AND TRY_CAST(payload->>'$.value' AS DOUBLE) IN (1, 2, 3, 4, 5)), false) AS accepted FROM event_log"""
)
def stream_event_intake(t):
    root = tables.shared_folder(t.spark)
    jobs.stream_events(_stream(t, "events", "event_log"), root).awaitTermination()
    part = lambda name, ok: t.spark.read.parquet(f"{root}/{name}").select("event_id", "ip_hash", F.lit(ok).alias("accepted"))
    return part("events", True).unionByName(part("rejected", False))


@query("SELECT source_deal_id, seq, true AS changed FROM listings")
def stream_change_detection(t):
    """Everything is new to an empty history."""
    root = tables.shared_folder(t.spark)
    listings = _stream(t, "orders", "listings").withColumn("source_id", F.col("seq") % 5)
    hashed = ingest.with_payload(listings).select("source_id", "source_deal_id", "seq", "content_hash")
    jobs.stream_changes(hashed, root).awaitTermination()
    return t.spark.read.parquet(f"{root}/changes").select("source_deal_id", "seq", "changed")


@query(
    f"""WITH {_INGEST_SQL} SELECT source_deal_id, cat AS category, round(deal, 6) AS deal_price,
    {_DISCOUNT_SQL.format(o="orig", d="deal")} AS discount_pct, quality AS quality_score FROM ruled"""
)
def stream_ingest(t):
    """One pass of the listing stream over the deals table."""
    root = tables.shared_folder(t.spark)
    deals = t.deals.withColumn("source_id", F.lit(9).cast("long"))
    tables.write_version(deals, root, "deals", 0)
    jobs.stream_ingest(_stream(t, "orders", "listings"), root, 9, lambda batch: NOW).awaitTermination()
    out = tables.read_version(t.spark, root, "deals", 1)
    return out.select("source_deal_id", "category", F.round("deal_price", 6).alias("deal_price"), "discount_pct", "quality_score")


SWEEP_NOW = "1996-01-01 12:00:00"


@query(
    f"""WITH {_INGEST_SQL}, done AS (SELECT r.*, {_DISCOUNT_SQL.format(o="orig", d="deal")} AS disc, d.fetched_at AS f, d.last_seen_at AS ls FROM ruled r JOIN deals d ON d.id = r.seq)
    SELECT source_deal_id, NOT coalesce(expires_at < TIMESTAMP '{SWEEP_NOW}', false) AND NOT coalesce(ls < TIMESTAMP '{SWEEP_NOW}' - INTERVAL 96 HOUR, false) AS is_active,
      strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at,
      round(0.40 * least(coalesce(disc, 0) / 100, 1.0) + 0.35 * exp(-((epoch_us(TIMESTAMP '{SWEEP_NOW}') - epoch_us(f)) / 3.6e9) / 48.0) + 0.25 * quality, 4) AS rank_score FROM done
    WHERE f <= TIMESTAMP '{SWEEP_NOW}'"""
)
def stream_ingest_swept(t):
    """What the sweep of a batch leaves: expired and unseen deals inactive, the rest ranked."""
    root = tables.shared_folder(t.spark)
    deals = t.deals.withColumn("source_id", F.lit(9).cast("long"))
    tables.write_version(deals, root, "deals", 0)
    jobs.stream_ingest(_stream(t, "orders", "listings"), root, 9, lambda batch: SWEEP_NOW).awaitTermination()
    out = tables.read_version(t.spark, root, "deals", 1).filter(F.col("fetched_at") <= F.lit(SWEEP_NOW).cast("timestamp"))
    return out.select("source_deal_id", "is_active", stamp("expires_at").alias("expires_at"), "rank_score")


# --- keyed state ------------------------------------------------------------------


def _landed(t, folder: str, batches) -> Iterator[DataFrame]:
    """Lands one batch after the other and gives the stream over all that has landed, for one start each."""
    for number, batch in enumerate(batches):
        batch.write.mode("overwrite").parquet(f"{folder}/landing={number}")
        yield t.spark.readStream.schema(batch.schema).option("basePath", folder).parquet(f"{folder}/landing=*")


@query(f"{_RUNNING_SQL} SELECT event_id, deal_id, n_incorrect, n_expired, n_incorrect >= 3 AS demote, n_expired >= 3 AS expire FROM running")
def stream_late_reports(t):
    """Reports of a month in three landings, a third of them a landing late; both queries start anew for each landing."""
    root = tables.shared_folder(t.spark)
    turn = F.least(F.floor((F.dayofmonth("created_at") - 1) / 10) + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0), F.lit(2))

    events = t.event_log.select("event_id", "event_type", "deal_id", "created_at")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "created_at"]
    last = events.agg((F.max("created_at") + F.expr("INTERVAL 60 DAYS")).alias("created_at")).select(*nothing, "created_at")
    batches = [events.filter(turn == number) for number in range(3)] + [last]  # the last moves the watermark over the month
    for stream in _landed(t, f"{root}/in", batches):
        keyed.slice_reports(stream, root, slice_seconds=7 * 86_400, delay="12 days").awaitTermination()
        keyed.report_actions(t.spark, root).awaitTermination()
    out = t.spark.read.parquet(f"{root}/report_actions")
    return out.select("event_id", "deal_id", "n_incorrect", "n_expired", "demote", "expire")


@query(
    f"""SELECT source_deal_id, seq, true AS changed FROM listings
    UNION ALL SELECT source_deal_id, seq + {LATER}, seq % 10 = 0 FROM listings WHERE seq % 2 = 0
    UNION ALL SELECT source_deal_id, seq + 2 * {LATER}, seq % 10 = 0 AND seq % 20 <> 0 FROM listings WHERE seq % 5 = 0"""
)
def stream_changes_there_and_back(t):
    """Listings at price A; half of them again, a tenth at price B; a fifth again, half of the tenth back at A."""
    root = tables.shared_folder(t.spark)

    rows = t.listings.withColumn("source_id", F.col("seq") % 5)
    repriced = lambda modulus: F.when(F.col("seq") % modulus == 0, F.lit(99.0)).otherwise(F.col("deal_price"))
    batches = [
        rows,
        rows.filter("seq % 2 = 0").withColumn("deal_price", repriced(10)),
        rows.filter("seq % 5 = 0").withColumn("deal_price", repriced(20)),
    ]
    for stream in _landed(t, f"{root}/in", batches):
        hashed = ingest.with_payload(stream).withColumn("seq", F.col("seq") + F.col("landing").cast("long") * LATER)
        keyed.changes(hashed, root).awaitTermination()
    return t.spark.read.parquet(f"{root}/changes").select("source_deal_id", "seq", "changed")


# --- bucketed store ---------------------------------------------------------------


def _ingested(t) -> Store:
    """Two thirds of the deals as version 0; the listings of the last third, then a tenth of all, as two batches."""
    root = tables.shared_folder(t.spark)
    store = Store(t.spark, root)
    store.create({"deals": (t.deals.filter("id % 3 <> 0").withColumn("source_id", F.lit(9).cast("long")), ingest.KEY)}, buckets=16)
    batches = [t.listings.filter("seq % 3 = 0"), t.listings.filter("seq % 10 = 0")]
    for stream in _landed(t, f"{root}/in", batches):
        listings = stream.select(batches[0].columns)
        stored.stream_ingest(listings, root, 9, lambda batch: NOW).awaitTermination()
    return store


_VERSIONS_SQL = f"""WITH {_INGEST_SQL}, fresh AS (SELECT source_deal_id, seq, cat, round(deal, 6) AS deal, {_DISCOUNT_SQL.format(o="orig", d="deal")} AS disc, quality FROM ruled),
    old AS (SELECT source_deal_id, id AS seq, category AS cat, round(deal_price, 6) AS deal, discount_pct AS disc, quality_score AS quality FROM deals)"""


@query(
    f"""{_VERSIONS_SQL} SELECT 0 AS version, * EXCLUDE (seq) FROM old WHERE seq % 3 <> 0
    UNION ALL SELECT 1, * EXCLUDE (seq) FROM (SELECT * FROM old WHERE seq % 3 <> 0 UNION ALL SELECT * FROM fresh WHERE seq % 3 = 0)
    UNION ALL SELECT 2, * EXCLUDE (seq) FROM (SELECT * FROM old WHERE seq % 3 <> 0 AND seq % 10 <> 0 UNION ALL SELECT * FROM fresh WHERE seq % 3 = 0 OR seq % 10 = 0)"""
)
def stream_ingest_versions(t):
    """All three versions of the table, the old ones read after the last was written."""
    store = _ingested(t)
    return reduce(DataFrame.unionByName, [
        store.read("deals", version).select(
            F.lit(version).alias("version"), "source_deal_id", F.col("category").alias("cat"), F.round("deal_price", 6).alias("deal"),
            F.col("discount_pct").alias("disc"), F.col("quality_score").alias("quality"),
        )
        for version in range(3)
    ])


@query("""SELECT CAST(1 AS INT) AS version, 'inserted' AS action, count(*) AS rows FROM listings WHERE seq % 3 = 0
    UNION ALL SELECT 2, 'updated', count(*) FROM listings WHERE seq % 10 = 0
    UNION ALL SELECT v, 'raw', count(*) FILTER (seq % CASE v WHEN 1 THEN 3 ELSE 10 END = 0) FROM listings, (VALUES (1), (2)) AS x(v) GROUP BY v
    UNION ALL SELECT v, 'logged', count(*) FILTER (seq % CASE v WHEN 1 THEN 3 ELSE 10 END = 0) FROM listings, (VALUES (1), (2)) AS x(v) GROUP BY v""")
def stream_ingest_logs(t):
    """What the two batches appended: actions, raw rows, normalization log."""
    store = _ingested(t)
    parts = [
        store.log("actions").select("version", "action"),
        store.log("deals_raw").filter("length(content_hash) = 16 AND raw_payload IS NOT NULL").select("version", F.lit("raw").alias("action")),
        store.log("normalization_log").select("version", F.lit("logged").alias("action")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("version", "action").agg(F.count(F.lit(1)).alias("rows"))
