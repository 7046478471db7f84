"""Streaming jobs whose state is kept per key in the RocksDB state store.

The cost of a micro-batch depends on its own keys: of what earlier batches left, only their state is read again.

Report counts run over two queries, because a deal may be reported without end and a task should never hold it whole:

``slice_reports``   keyed by (deal, slice of event time).  Reports wait in a list until the watermark has passed their
                    slice, are then put in event order and numbered, and leave with one row of sums per slice.
``report_actions``  keyed by deal, fed with the sums alone.  A value per deal carries the counts of all earlier slices,
                    and the slice's own reports are joined to it where they lie.

A report that arrives up to ``delay`` late is counted where it belongs.  Reports behind the watermark are left out, and
Spark counts them (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import feedback
from ..operators.reports import REPORT_TYPES
from ..session import ship_package
from ..sources import tables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICE_SECONDS = 86_400
DELAY = "1 day"


def _prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship_package(spark)


def _started(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


# --- reports ----------------------------------------------------------------------

SLICED = (
    "deal_id bigint, slice bigint, event_id bigint, event_type string, created_at timestamp, n_incorrect bigint, n_expired bigint"
)


class SliceOrder(StatefulProcessor):
    """Reports of one (deal, slice): held back until the watermark has passed the slice, then numbered in event order.

    The last row has no event and holds the sums of the slice.
    """

    def __init__(self, slice_seconds: int):
        self.slice_seconds = slice_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "event_id bigint, event_type string, created_at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.held.appendList([(r.event_id, r.event_type, r.created_at) for r in rows])
        self.handle.registerTimer((key[1] + 1) * self.slice_seconds * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        incorrect = expired = 0
        for event_id, event_type, created_at in sorted(self.held.get(), key=lambda r: (r[2], r[0])):
            incorrect += event_type == REPORT_TYPES[0]
            expired += event_type == REPORT_TYPES[1]
            yield Row(
                deal_id=key[0], slice=key[1], event_id=event_id, event_type=event_type, created_at=created_at,
                n_incorrect=incorrect, n_expired=expired,
            )
        yield Row(deal_id=key[0], slice=key[1], event_id=None, event_type=None, created_at=None, n_incorrect=incorrect, n_expired=expired)
        self.held.clear()

    def close(self) -> None:
        pass


def slice_reports(
    events: DataFrame, root: str, *, slice_seconds: int = SLICE_SECONDS, delay: str = DELAY, interval: str | None = None
) -> StreamingQuery:
    """Events -> ``{root}/slices``: finished slices of every deal, as (SLICED) partitioned by slice.

    All events move the watermark; those that are no report or name no deal go no further.
    """
    _prepared(events.sparkSession)
    report = F.col("event_type").isin(*REPORT_TYPES) & F.col("deal_id").isNotNull()
    # The condition hangs on the time, so that Spark does not move it in front of the watermark.
    slice_ = F.when(report, F.floor(F.unix_timestamp("created_at") / slice_seconds).cast("long"))
    reports = (
        events.withWatermark("created_at", delay)
        .select("deal_id", slice_.alias("slice"), "event_id", "event_type", "created_at")
        .filter("slice IS NOT NULL")
    )
    sliced = reports.groupBy("deal_id", "slice").transformWithState(
        SliceOrder(slice_seconds), outputStructType=SLICED, outputMode="Append", timeMode="EventTime"
    )
    writer = sliced.writeStream.format("parquet").option("path", f"{root}/slices").partitionBy("slice")
    return _started(writer, f"{root}/checkpoint-slices", interval)


CARRIED = "deal_id bigint, slice bigint, earlier_incorrect bigint, earlier_expired bigint"


class Carried(StatefulProcessor):
    """Counts of one deal before each of its slices; slices of a deal arrive in their order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n_incorrect bigint, n_expired bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        incorrect, expired = self.sums.get() or (0, 0)
        for row in sorted(rows, key=lambda r: r.slice):
            yield Row(deal_id=key[0], slice=row.slice, earlier_incorrect=incorrect, earlier_expired=expired)
            incorrect, expired = incorrect + row.n_incorrect, expired + row.n_expired
        self.sums.update((incorrect, expired))

    def close(self) -> None:
        pass


def report_actions(spark: SparkSession, root: str, *, interval: str | None = None) -> StreamingQuery:
    """Finished slices -> ``{root}/report_actions``: demote and expire actions per report event.

    A batch reads the reports of its own slices only: the folders of their slices, and in them their deals.
    """
    _prepared(spark)
    slices = spark.readStream.schema(SLICED).parquet(f"{root}/slices")
    sums = slices.filter("event_id IS NULL").select("deal_id", "slice", "n_incorrect", "n_expired")
    carried = sums.groupBy("deal_id").transformWithState(Carried(), outputStructType=CARRIED, outputMode="Append", timeMode="None")

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()
        try:
            days = [r.slice for r in batch.select("slice").distinct().collect()]  # slices of one batch, not of the history
            stored = session.read.schema(SLICED).parquet(f"{root}/slices")
            counted = stored.filter(F.col("slice").isin(days) & F.col("event_id").isNotNull()).join(batch, ["deal_id", "slice"])
            running = counted.withColumns(
                {
                    "n_incorrect": F.col("n_incorrect") + F.col("earlier_incorrect"),
                    "n_expired": F.col("n_expired") + F.col("earlier_expired"),
                }
            ).select("event_id", "event_type", "deal_id", "created_at", "n_incorrect", "n_expired")
            tables.append_batch(feedback.report_actions(running), root, "report_actions", batch_id)
        finally:
            batch.unpersist()

    return _started(carried.writeStream.foreachBatch(step), f"{root}/checkpoint-actions", interval)


# --- changes ----------------------------------------------------------------------

HASHED = ["source_id", "source_deal_id", "seq", "content_hash"]
CHANGED = "source_id string, source_deal_id string, seq bigint, content_hash string, changed boolean"
HASH_BUCKETS = 1024
NO_SEQ = -(2**63)
STATE = pa.schema([(n, pa.string()) for n in ("source_id", "source_deal_id", "content_hash")])


def _strings(column: pd.Series) -> list[str | None]:
    return column.astype(object).where(column.notna(), None).tolist()


class LastHash(StatefulProcessor):
    """Rows of the listing keys of one bucket with ``changed`` against the hash before them; the state is the last hash
    of every key, in one value per bucket.

    A call to the state store costs far more than a row, so a bucket is read and written once per micro-batch.  Within a
    micro-batch rows go by ``seq``.  A bucket in which no hash changes is not written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "hashes binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.held.get()
        last: dict[tuple, str | None] = {}
        if stored:
            ids, deals, hashes = pa.ipc.open_stream(bytes(stored[0])).read_all().to_pydict().values()
            last = dict(zip(zip(ids, deals), hashes))
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        changed = []
        for listing, found in zip(zip(_strings(batch["source_id"]), _strings(batch["source_deal_id"])), _strings(batch["content_hash"])):
            changed.append(found != last.get(listing))
            last[listing] = found
        yield batch[HASHED].assign(changed=changed)
        if any(changed):
            columns = [[k[0] for k in last], [k[1] for k in last], list(last.values())]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, STATE) as out:
                out.write_table(pa.table(dict(zip(STATE.names, columns)), schema=STATE))
            self.held.update((sink.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass


def changes(hashed: DataFrame, root: str, *, buckets: int = HASH_BUCKETS, interval: str | None = None) -> StreamingQuery:
    """Rows (source_id, source_deal_id, seq, content_hash) -> ``{root}/changes`` with ``changed``.

    A listing that turns from A to B and back to A has changed twice, in one micro-batch or over several.  Keys lie in
    ``buckets`` by their hash, and that number must stay for the life of a checkpoint: a micro-batch reads and writes the
    buckets of its own keys.  The rows of one bucket in one micro-batch are held by one task: bound a micro-batch at its
    source (``maxFilesPerTrigger``).  Rows without ``seq`` come first.
    """
    _prepared(hashed.sparkSession)
    bucket = F.pmod(F.xxhash64("source_id", "source_deal_id"), F.lit(buckets)).cast("int").alias("bucket")
    # pandas has no long with nulls, so ids go as text and a missing seq as the smallest long
    rows = hashed.select(bucket, F.col("source_id").cast("string"), "source_deal_id", F.coalesce("seq", F.lit(NO_SEQ)).alias("seq"), "content_hash")
    marked = rows.groupBy("bucket").transformWithStateInPandas(LastHash(), outputStructType=CHANGED, outputMode="Append", timeMode="None")
    out = marked.withColumns({"source_id": F.col("source_id").cast("bigint"), "seq": F.nullif("seq", F.lit(NO_SEQ))})
    return _started(out.writeStream.format("parquet").option("path", f"{root}/changes"), f"{root}/checkpoint-changes", interval)
