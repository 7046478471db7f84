"""Week bitmaps against the schedule rules row by row."""

import datetime
import random

from pyspark.sql import functions as F

from offermill.functions import schedule
from offermill.operators import opening

R = random.Random(2)
SCHEDULE = "deal_id long, day_of_week int, start_time string, end_time string, valid_from timestamp, valid_until timestamp"


def test_equals_the_schedule_rules(spark):
    start = datetime.datetime(2024, 6, 3)
    times = [None, "", "00:00", "09:30", "12:00", "12:01", "23:59", "24:00", "7:5"]
    when = lambda: R.choice([None, None, start + datetime.timedelta(minutes=R.randrange(20_000))])
    rows = [(R.randrange(40), R.choice([None, 0, 3, 6, 9]), R.choice(times), R.choice(times), when(), when()) for _ in range(300)]
    rows += [(100, 0, "10:00", "11:00", None, None)] * 3
    schedules = spark.createDataFrame(rows, SCHEDULE)
    asked = [(d, start + datetime.timedelta(minutes=R.randrange(20_000), seconds=R.randrange(60))) for d in [*range(45), 100] * 25]
    asked += [(100, start + datetime.timedelta(hours=h)) for h in (9, 10, 11, 12)] * 2
    df = spark.createDataFrame(asked, "id long, at timestamp")
    fields = {n: F.col(n) for n in ("day_of_week", "start_time", "end_time", "valid_from", "valid_until")}
    covers = F.coalesce(schedule.schedule_open(fields, F.col("at")), F.lit(False))
    want = df.distinct().join(schedules, F.col("id") == F.col("deal_id")).groupBy("id", "at").agg(F.bool_or(covers).alias("is_open_now"))
    got = sorted(map(tuple, opening.open_each(df, schedules).select("id", "at", "is_open_now").collect()))
    assert got == sorted(map(tuple, want.collect())) and {g[2] for g in got} == {True, False}
    ranges = opening.date_ranges(schedules)
    assert opening.week_bitmaps(ranges).count() <= ranges.select("week").distinct().count() < ranges.count()


def test_nothing_asked(spark):
    schedules = spark.createDataFrame([], SCHEDULE)
    assert opening.open_each(spark.createDataFrame([(1, datetime.datetime(2024, 1, 1))], "id long, at timestamp"), schedules).count() == 0


def test_hours_of_a_deal(spark):
    """``open_in`` over ``deal_hours`` gives what ``open_each`` gives, one row per row asked and no aggregate after the join."""
    start = datetime.datetime(2024, 6, 3)
    when = lambda: R.choice([None, None, start + datetime.timedelta(minutes=R.randrange(20_000))])
    times = [None, "", "00:00", "09:30", "12:01", "23:59", "24:00", "7:5"]
    schedules = spark.createDataFrame([(R.randrange(40), R.choice([None, 0, 3, 6, 9]), R.choice(times), R.choice(times), when(), when()) for _ in range(300)], SCHEDULE)
    asked = spark.createDataFrame([(d, start + datetime.timedelta(minutes=R.randrange(20_000))) for d in [*range(45)] * 20], "id long, at timestamp").distinct()
    joined = asked.join(opening.deal_hours(schedules), "id")
    got = joined.select("id", "at", opening.open_in(F.col("hours"), F.col("at")).alias("o"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, opening.open_each(asked, schedules).select("id", "at", "is_open_now").collect()))


def test_equal_hours_are_put_to_an_instant_once(spark):
    """Deals that keep equal hours share one row of flags a day, with what ``open_in`` says of each instant (F5)."""
    kind = "deal_id long, day_of_week int, start_time string, end_time string, valid_from timestamp, valid_until timestamp"
    a, b = (None, "09:00", "17:00", None, None), (2, None, "12:00", None, None)
    rows = [(i, *h) for i in range(30) for h in ([a, b] if i % 2 else [b, a] if i % 3 else [b])]
    hours = opening.deal_hours(spark.createDataFrame(rows, kind)).withColumn("hours", F.array_sort("hours"))
    moments = ["2024-06-05 08:59:00", "2024-06-05 09:00:00", "2024-06-06 17:01:00", "2024-06-06 17:00:00", "2024-06-06 17:00:00"]
    days = opening.days_of(spark.createDataFrame([(m,) for m in moments], "at string").select(F.col("at").cast("timestamp").alias("at")))
    flags = opening.hours_at(hours, days)
    assert flags.count() == 2 * 2
    got = flags.join(days, "day").select("hours", F.inline(F.arrays_zip("ats", "flags")))
    assert got.count() == 2 * 4
    assert got.filter(~F.col("flags").eqNullSafe(opening.open_in(F.col("hours"), F.col("ats")))).count() == 0
    assert {r.flags for r in got.collect()} == {True, False}
