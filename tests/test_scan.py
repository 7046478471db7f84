"""Running counts over ranges bounded in rows."""

import random

from pyspark.sql import functions as F

from offermill.operators import feedback, skew

EVENT = "event_id long, event_type string, deal_id long, created_at timestamp"


def events(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["report_incorrect", "report_expired", "view"]), 1 if i % 3 else r.choice([2, 3, None]), "2024-01-01 10:00:00" if i % 2 else f"2024-01-0{1 + i % 9} 00:00:00") for i in range(4000)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, EVENT.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at")).repartition(5)


def test_scan_equals_chunks(spark):
    df = events(spark)
    want = sorted(map(tuple, feedback.running_reports(df).collect()))
    for rows in (37, 500, 10**6):
        assert sorted(map(tuple, feedback.running_reports(df, rows_per_part=rows).collect())) == want
    prior = spark.createDataFrame([(1, 5, 7)], "deal_id long, n_incorrect long, n_expired long")
    assert sorted(map(tuple, feedback.running_reports(df, prior, rows_per_part=100).collect())) == sorted(map(tuple, feedback.running_reports(df, prior).collect()))


def test_a_hot_deal_at_one_instant_is_cut(spark):
    df = events(spark).filter("deal_id = 1 AND minute(created_at) = 0")
    parts = skew.range_parts(df, "deal_id", ["created_at", "event_id"], 200).groupBy("_part").count().collect()
    assert len(parts) >= df.count() / 400 and max(p["count"] for p in parts) <= 600


def test_no_events(spark):
    assert feedback.running_reports(spark.createDataFrame([], EVENT), rows_per_part=10).count() == 0
