"""Structured Streaming forms of the ingest and feedback jobs.

Each job is a ``foreachBatch`` step over the batch operators.  State lives in tables keyed
by the batch number: a step reads what earlier batches left and overwrites its own folder,
so a batch that is replayed after a failure gives the same result.  Keyed state operators
would hand one busy deal to one task; the batch operators split it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import ip_hash
from ..operators import feedback, ingest, lifecycle, ranking, validate
from ..operators.reports import REPORT_TYPES
from ..session import cut_lineage
from ..sources import tables

# --- fixed values -----------------------------------------------------------------
INGEST_INTERVAL = "7200 seconds"
# ----------------------------------------------------------------------------------


def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None) -> StreamingQuery:
    def cached(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            step(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(cached).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def sweep(deals: DataFrame, now: str, *, stale_hours: float = 96.0) -> DataFrame:
    """Expiry, staleness and rank of all deals at one instant."""
    expired, _ = lifecycle.purge_expired(deals, now)
    fresh, _ = lifecycle.mark_stale(expired, now, stale_hours)
    return ranking.rank_stored(fresh, now)


def stream_ingest(
    listings: DataFrame, root: str, source_id: int, clock: Callable[[int], str], *, interval: str | None = None, swept: bool = True
) -> StreamingQuery:
    """Listings -> next version of ``deals`` per batch, with the normalization log.

    ``clock`` gives the time of a batch from its number and must not change on a replay.
    Version 0 of the table has to exist.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        now = clock(batch_id)
        deals = tables.read_version(batch.sparkSession, root, "deals", batch_id)
        out = ingest.ingest_listings(deals, batch, source_id, now)
        deals = cut_lineage(out["deals"])
        losers = cut_lineage(ingest.url_losers(deals, out["inserted"])[0])
        following = ingest.deactivate_losers(deals, ingest.few_broadcast(losers))
        tables.write_version(sweep(following, now) if swept else following, root, "deals", batch_id + 1)
        tables.append_batch(out["log"], root, "normalization_log", batch_id)
        tables.append_batch(out["actions"], root, "actions", batch_id)

    return _start(listings, step, f"{root}/checkpoint-ingest", interval)


def stream_events(events: DataFrame, root: str, *, interval: str | None = None) -> StreamingQuery:
    """Event intake: the address is hashed, invalid events go to ``rejected`` with a reason."""

    def step(batch: DataFrame, batch_id: int) -> None:
        hashed = batch.withColumn("ip_hash", ip_hash(F.col("ip"))).drop("ip")
        good, bad = validate.split_rows(hashed, validate.event_reason())
        tables.append_batch(good, root, "events", batch_id)
        tables.append_batch(bad, root, "rejected", batch_id)

    return _start(events, step, f"{root}/checkpoint-events", interval)


COUNTS = "deal_id bigint, n_incorrect bigint, n_expired bigint"


def stream_report_actions(events: DataFrame, root: str, *, interval: str | None = None) -> StreamingQuery:
    """Demote and expire actions per report event; counts carry over the batches.

    Every batch leaves its own counts per deal, and the counts so far are their sum over the
    deals of the batch.  Events of a deal must not arrive in an earlier batch than older ones.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = batch.select("deal_id").distinct()
        prior = (
            tables.read_log(spark, root, "report_counts", COUNTS, before=batch_id)
            .join(touched, "deal_id", "left_semi")
            .groupBy("deal_id")
            .agg(F.sum("n_incorrect").alias("n_incorrect"), F.sum("n_expired").alias("n_expired"))
        )
        actions = feedback.report_actions(feedback.running_reports(batch, prior))
        tables.append_batch(actions, root, "report_actions", batch_id)
        reports = batch.filter(F.col("event_type").isin(*REPORT_TYPES) & F.col("deal_id").isNotNull())
        counts = reports.groupBy("deal_id").agg(
            F.count_if(F.col("event_type") == REPORT_TYPES[0]).alias("n_incorrect"),
            F.count_if(F.col("event_type") == REPORT_TYPES[1]).alias("n_expired"),
        )
        tables.append_batch(counts, root, "report_counts", batch_id)

    return _start(events, step, f"{root}/checkpoint-reports", interval)


HASHES = "source_id bigint, source_deal_id string, content_hash string, fetched_at timestamp, id bigint"


def stream_changes(listings: DataFrame, root: str, *, interval: str | None = None) -> StreamingQuery:
    """Rows (source_id, source_deal_id, seq, content_hash) with ``changed`` against the last hash of
    their key, in this batch or an earlier one.  Each batch leaves the last hash per key."""

    def step(batch: DataFrame, batch_id: int) -> None:
        history = tables.read_log(batch.sparkSession, root, "hashes", HASHES, before=batch_id)
        marked = ingest.mark_changed(batch, history.drop("batch"))
        tables.append_batch(marked, root, "changes", batch_id)
        last = batch.groupBy(*ingest.KEY).agg(F.max_by("content_hash", "seq").alias("content_hash"))
        stamped = last.withColumns({"fetched_at": F.timestamp_seconds(F.lit(batch_id)), "id": F.lit(batch_id).cast("long")})
        tables.append_batch(stamped, root, "hashes", batch_id)

    return _start(listings, step, f"{root}/checkpoint-changes", interval)
