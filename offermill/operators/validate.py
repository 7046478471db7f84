"""Row checks that split a table into accepted and rejected rows by a reason column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
EVENT_TYPES = [
    "click", "feedback", "filter", "ingest_trigger", "rating", "report",
    "report_expired", "report_incorrect", "save", "search", "view",
]
PREFERENCE_COLUMNS = [
    "city_id", "preferred_categories", "excluded_categories", "preferred_merchants",
    "max_price", "min_discount_pct", "radius_miles",
]
MAX_RADIUS_MILES = 500
# ----------------------------------------------------------------------------------


def _reason(checks: list[tuple[Column, str]]) -> Column:
    out = F
    for bad, message in checks:
        out = out.when(F.coalesce(bad, F.lit(False)), message)
    return out.otherwise(F.lit(None).cast("string"))


def event_reason() -> Column:
    """NULL for a valid event.  Ratings need a whole number from 1 to 5 in the payload."""
    rating = F.try_variant_get(F.try_parse_json(F.col("payload")), "$.value", "double")
    known = F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(False))
    return _reason(
        [
            (~known, f"event_type must be one of {EVENT_TYPES}"),
            (
                (F.col("event_type") == "rating") & ~F.coalesce(rating.isin(1.0, 2.0, 3.0, 4.0, 5.0), F.lit(False)),
                "rating events require payload with 'value' between 1 and 5 (inclusive)",
            ),
        ]
    )


def _bad_time(name: str) -> list[tuple[Column, str]]:
    c = F.col(name)
    formed = c.rlike(r"^[0-9]+:[0-9]+$")
    part = lambda i: F.split_part(c, F.lit(":"), F.lit(i)).try_cast("int")
    inside = F.coalesce(part(1).between(0, 23) & part(2).between(0, 59), F.lit(False))
    return [(~formed, "Time must be in HH:MM format"), (c.isNotNull() & formed & ~inside, "Invalid time value")]


def schedule_reason() -> Column:
    day = (~F.col("day_of_week").between(0, 6), "day_of_week must be 0 (Mon) - 6 (Sun)")
    return _reason([day, *_bad_time("start_time"), *_bad_time("end_time")])


def preference_reason() -> Column:
    return _reason(
        [
            (~F.col("min_discount_pct").between(0, 100), "min_discount_pct must be between 0 and 100"),
            (F.col("radius_miles") <= 0, "radius_miles must be positive"),
        ]
    )


def geo_reason(lat: str = "lat", lon: str = "lon", radius: str | None = None) -> Column:
    checks = [
        (~F.col(lat).between(-90, 90), "lat must be between -90 and 90"),
        (~F.col(lon).between(-180, 180), "lon must be between -180 and 180"),
    ]
    if radius:
        checks.append(((F.col(radius) <= 0) | (F.col(radius) > MAX_RADIUS_MILES), "radius_miles must be between 0 and 500"))
    return _reason(checks)


def split_rows(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """-> (accepted rows, rejected rows with ``reject_reason``)."""
    checked = df.withColumn("reject_reason", reason)
    return checked.filter("reject_reason IS NULL").drop("reject_reason"), checked.filter("reject_reason IS NOT NULL")


def update_preferences(preferences: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite the allowed columns that the update carries; unknown sessions are ignored."""
    names = [n for n in updates.columns if n in PREFERENCE_COLUMNS]
    fresh = updates.select("session_id", F.lit(True).alias("_hit"), *[F.col(n).alias(f"_new_{n}") for n in names])
    out = preferences.join(fresh, "session_id", "left")
    changed = {n: F.when(F.col("_hit"), F.col(f"_new_{n}")).otherwise(F.col(n)) for n in names}
    return out.withColumns(changed).select(*preferences.columns)
