"""Open or not, for many deals at instants of their own.

The weekly hours of a deal are a bitmap of the 10,080 minutes of a week, one per date range of its schedules.  Equal
hours share one bitmap, so minutes are only ever spelled out for hours that differ; the table of deals refers to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schedule
from ..functions.bitmaps import has_bit

DAY_MINUTES = 1440


def minute_of_week(at: Column) -> Column:
    """1 for Monday 00:00 to 10,080 for Sunday 23:59, in UTC."""
    return F.weekday(at) * DAY_MINUTES + F.hour(at) * 60 + F.minute(at) + 1


def date_ranges(schedules: DataFrame) -> DataFrame:
    """(deal_id, valid_from, valid_until, week): the hours that hold in each date range, as sorted text."""
    hours = F.struct("day_of_week", "start_time", "end_time")
    return schedules.groupBy("deal_id", "valid_from", "valid_until").agg(F.to_json(F.array_sort(F.collect_set(hours))).alias("week"))


def week_bitmaps(ranges: DataFrame) -> DataFrame:
    """(week, minutes) for every different ``week``; a schedule without both times holds all day."""
    kind = "array<struct<day_of_week: int, start_time: string, end_time: string>>"
    each = ranges.select("week").distinct().select("week", F.explode(F.from_json("week", kind)).alias("s")).select("week", "s.*")
    whole = (F.coalesce("start_time", F.lit("")) == "") | (F.coalesce("end_time", F.lit("")) == "")
    first = F.when(whole, 0).otherwise(F.greatest(schedule.minutes(F.col("start_time")), F.lit(0)))
    last = F.when(whole, DAY_MINUTES - 1).otherwise(F.least(schedule.minutes(F.col("end_time")), F.lit(DAY_MINUTES - 1)))
    days = F.when(F.col("day_of_week").isNull(), F.sequence(F.lit(0), F.lit(6))).otherwise(F.array("day_of_week"))
    spelled = (
        each.select("week", F.explode(days).alias("day"), first.alias("first"), last.alias("last"))
        .filter(F.col("first") <= F.col("last"))
        .select("week", "day", F.explode(F.sequence("first", "last")).alias("minute"))
        .filter(F.col("day").between(0, 6))
    )
    number = F.col("day") * DAY_MINUTES + F.col("minute") + 1
    return spelled.groupBy("week").agg(F.bitmap_construct_agg(F.bitmap_bit_position(number.cast("long"))).alias("minutes"))


def deal_hours(schedules: DataFrame) -> DataFrame:
    """(id, hours): the different hours of a deal in one row, so that many instants can be put to it without a join each.

    The times are parsed here, once.  A deal's hours make one value: for deals with very many date ranges take ``open_each``.
    """
    whole = (F.coalesce("start_time", F.lit("")) == "") | (F.coalesce("end_time", F.lit("")) == "")
    first = F.when(whole, 0).otherwise(schedule.minutes(F.col("start_time")))
    last = F.when(whole, DAY_MINUTES).otherwise(schedule.minutes(F.col("end_time")))
    held = F.struct("day_of_week", first.alias("first"), last.alias("last"), "valid_from", "valid_until")
    return schedules.groupBy(F.col("deal_id").alias("id")).agg(F.collect_set(held).alias("hours"))


def open_in(hours: Column, at: Column) -> Column:
    """Whether one of the hours of ``deal_hours`` covers the instant; NULL without hours."""
    minute, day = F.hour(at) * 60 + F.minute(at), F.weekday(at)

    def covers(s: Column) -> Column:
        dated = (s["valid_from"].isNull() | (at >= s["valid_from"])) & (s["valid_until"].isNull() | (at <= s["valid_until"]))
        return F.coalesce(dated & (s["day_of_week"].isNull() | (s["day_of_week"] == day)) & minute.between(s["first"], s["last"]), F.lit(False))

    return F.exists(hours, covers)


def open_each(asked: DataFrame, schedules: DataFrame) -> DataFrame:
    """(id, at) -> also is_open_now, for each different deal and instant that has schedules."""
    wanted = asked.select("id", "at").distinct()
    ranges = date_ranges(schedules.join(wanted.select(F.col("id").alias("deal_id")), "deal_id", "left_semi"))
    at = F.col("at")
    inside = (F.col("valid_from").isNull() | (at >= F.col("valid_from"))) & (F.col("valid_until").isNull() | (at <= F.col("valid_until")))
    held = wanted.join(ranges.withColumnRenamed("deal_id", "id"), "id").join(week_bitmaps(ranges), "week", "left")
    covered = inside & F.coalesce(has_bit(F.col("minutes"), minute_of_week(at).cast("long")), F.lit(False))
    return held.groupBy("id", "at").agg(F.bool_or(covered).alias("is_open_now"))


def hours_at(hours: DataFrame, instants: DataFrame) -> DataFrame:
    """(hours, day, flags): every different ``hours`` of ``deal_hours`` put to every instant (day, ats) of ``days_of``, once.

    ``flags`` lie in the order of ``ats``, so that a deal's answer is one look into them.
    """
    spread = max(int(hours.sparkSession.conf.get("spark.sql.shuffle.partitions")), hours.sparkSession.sparkContext.defaultParallelism)
    different = hours.select("hours").distinct().repartition(spread)
    return different.crossJoin(F.broadcast(instants)).select(
        "hours", "day", F.transform("ats", lambda at: open_in(F.col("hours"), at)).alias("flags")
    )


def days_of(instants: DataFrame) -> DataFrame:
    """(day, ats): the different instants (``at``) of each day in order."""
    return instants.groupBy(F.to_date("at").alias("day")).agg(F.array_sort(F.collect_set("at")).alias("ats"))
