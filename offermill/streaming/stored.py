"""Incremental ingest over a bucketed store: a batch rewrites the buckets of the keys it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..session import cut_lineage
from ..sources.store import Store
from .jobs import sweep

SEEN = ["id", "source_id", "source_deal_id", "url", "quality_score", "fetched_at", "is_active"]
ACTIONS = ("inserted", "updated")


def ingest_step(store: Store, batch: DataFrame, version: int, source_id: int, now: str, *, swept: bool = False) -> dict:
    """Listings -> one version of ``deals`` with the logs ``actions``, ``normalization_log`` and ``deals_raw``.

    New deals may take another source's deal out behind the same URL, in whatever bucket it lies; those buckets are
    rewritten as well.  A sweep changes the rank of every deal and so rewrites all of them.  Gives the commit.
    """
    if version in store.versions():
        return store.commit_of(version)
    stored = store.commit_of(version - 1)["tables"]["deals"]
    keyed = batch.withColumn("source_id", F.lit(source_id).cast("long"))
    touched = store.buckets_of("deals", keyed)
    out = ingest.ingest_listings(store.read("deals", version - 1, touched), batch, source_id, now)
    deals = store.set_aside("deals", version, out["deals"])
    rest = set(map(int, stored["at"])) - touched
    untouched = store.read("deals", version - 1, rest)
    losers, _ = ingest.url_losers(deals.select(SEEN).unionByName(untouched.select(SEEN)), out["inserted"])
    losers = cut_lineage(losers)
    more = rest if swept else store.buckets_of("deals", losers) - touched
    changed = deals.unionByName(store.read("deals", version - 1, more))
    following = ingest.deactivate_losers(changed, ingest.few_broadcast(losers))
    raw = ingest.with_payload(keyed).select("source_id", "source_deal_id", "seq", "raw_payload", "content_hash", F.lit(now).cast("timestamp").alias("fetched_at"))
    commit = store.write(
        version,
        {"deals": (sweep(following, now) if swept else following, touched | more)},
        {"actions": out["actions"], "normalization_log": out["log"], "deals_raw": raw},
        {"actions": {a: F.count_if(F.col("action") == a) for a in ACTIONS}},
    )
    store.clear(version)
    return commit


def stream_ingest(
    listings: DataFrame, root: str, source_id: int, clock: Callable[[int], str], *, sweep_every: int = 0, interval: str | None = None
) -> StreamingQuery:
    """One version of the store at ``root`` per micro-batch.  Version 0 has to exist (``Store.create``).

    ``clock`` gives the time of a batch from its number and must not change on a replay.  With ``sweep_every`` n, every
    n-th batch also expires, retires and ranks all deals.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            due = bool(sweep_every) and (batch_id + 1) % sweep_every == 0
            ingest_step(Store(batch.sparkSession, root), batch, batch_id + 1, source_id, clock(batch_id), swept=due)
        finally:
            batch.unpersist()

    writer = listings.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/_checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
