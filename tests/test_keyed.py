"""Keyed streaming state: late reports, restarts between micro-batches, changes over several batches."""

import random

from pyspark.sql import functions as F

from offermill.operators import feedback
from offermill.streaming import keyed

EVENTS = "event_id long, event_type string, deal_id long, created_at timestamp"
HASHED = "source_id long, source_deal_id string, seq long, content_hash string"


def land(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).select(
        *[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]
    ).coalesce(1).write.parquet(f"{folder}/{number:03d}")


def at(minutes):
    return f"2024-01-{1 + minutes // 1440:02d} {minutes // 60 % 24:02d}:{minutes % 60:02d}:00"


def run(spark, folder, root):
    """One start of both queries over what has landed since."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    keyed.slice_reports(events, root, slice_seconds=3600, delay="3 hours").awaitTermination()
    keyed.report_actions(spark, root).awaitTermination()


def test_late_reports_and_restarts_equal_the_batch_form(spark, tmp_path):
    r = random.Random(6)
    rows = [
        (i, r.choice(["report_incorrect", "report_expired", "view"]), None if r.random() < 0.05 else 7 if r.random() < 1 / 3 else r.randrange(5), 5 * i + r.randrange(9))
        for i in range(200)
    ]
    batches = [[], [], [], []]
    for row in rows:  # a third arrives up to three hours late, which can be a batch later
        batches[min(3, (row[3] + (170 if row[0] % 3 == 0 else 0)) // 260)].append((*row[:3], at(row[3])))
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    for number, batch in enumerate(batches[:2]):
        land(spark, folder, number, batch, EVENTS)
    run(spark, folder, root)
    first = {x.event_id for x in spark.read.parquet(f"{root}/report_actions").collect()}
    for number, batch in enumerate(batches[2:], 2):
        land(spark, folder, number, batch, EVENTS)
        run(spark, folder, root)
    land(spark, folder, 9, [(-1, "view", None, at(3000))], EVENTS)  # a last event moves the watermark over everything
    run(spark, folder, root)

    stored = spark.read.schema(EVENTS).parquet(f"{folder}/*")
    want = feedback.report_actions(feedback.running_reports(stored))
    names = ["event_id", "deal_id", "n_incorrect", "n_expired", "demote", "expire"]
    got = sorted(map(tuple, spark.read.parquet(f"{root}/report_actions").select(names).collect()))
    assert got == sorted(map(tuple, want.select(names).collect()))
    assert 0 < len(first) < len(got)
    arrival = F.regexp_extract("_metadata.file_path", r"/(\d{3})/", 1).cast("long") * 1000 + F.col("event_id")
    by_arrival = feedback.running_reports(stored.withColumn("created_at", F.timestamp_seconds(arrival)))
    assert got != sorted(map(tuple, feedback.report_actions(by_arrival).select(names).collect()))


def test_changes_there_and_back(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [(1, "a", 1, "A"), (1, "b", 2, "A"), (2, "a", 3, "A")],
        [(1, "a", 4, "B"), (1, "b", 5, "A"), (1, "c", 6, "A"), (1, "c", 7, "B"), (1, "c", 8, "A")],
        [(1, "a", 9, "A"), (1, "b", 10, "A"), (1, "c", 11, "A"), (2, "a", 12, "C"), (2, "a", 13, "C")],
    ]
    for number, batch in enumerate(batches):
        land(spark, folder, number, batch, HASHED)
        keyed.changes(spark.readStream.schema(HASHED).parquet(f"{folder}/*"), root).awaitTermination()
    got = {x.seq: x.changed for x in spark.read.parquet(f"{root}/changes").collect()}
    assert got == dict(zip(range(1, 14), [True, True, True, True, False, True, True, True, True, False, False, True, False]))


def test_changes_keep_one_state_per_bucket(spark, tmp_path):
    """Calls to the state store go with the buckets, not with the listings; odd keys and hashes count as before."""
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    r = random.Random(2)
    sources, names = [None, 2**53, 2**53 + 1, -1], [None, "", "a", *(f"d{i}" for i in range(400))]
    batches = [[(r.choice(sources), r.choice(names), 10_000 * b + i, r.choice(["A", "B", None])) for i in range(1500)] for b in range(3)]
    for number, batch in enumerate(batches):
        land(spark, folder, number, r.sample(batch, len(batch)), HASHED)
        stream = spark.readStream.schema(HASHED).parquet(f"{folder}/*")
        query = keyed.changes(stream, root, buckets=16)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 16
    last, want = {}, []
    for source, name, seq, found in (row for batch in batches for row in batch):
        want.append((source, name, seq, found, found != last.get((source, name))))
        last[source, name] = found
    got = spark.read.parquet(f"{root}/changes").select(*keyed.HASHED, "changed").collect()
    assert sorted(map(tuple, got), key=lambda x: x[2]) == want
