"""Filters, lookups, paging, cards and detail rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, hashing

# --- fixed values -----------------------------------------------------------------
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# ----------------------------------------------------------------------------------

PAIR_TIES = ("a_id", "b_id")


def _all(conditions: list[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def filter_deals(
    deals: DataFrame,
    *,
    city_id: int | None = None,
    venue_id: int | None = None,
    category: str | None = None,
    max_price: float | None = None,
    min_discount: float | None = None,
    is_online: bool | None = None,
    location: str | None = None,
    active_only: bool = True,
) -> DataFrame:
    """Optional filters, all joined by AND.  ``location`` 'online' means no location."""
    c = F.col
    place = None
    if location:
        place = c("location").isNull() if location.lower() == "online" else c("location").ilike(f"%{location}%")
    return deals.filter(
        _all(
            [
                c("is_active") if active_only else None,
                c("city_id") == city_id if city_id is not None else None,
                c("venue_id") == venue_id if venue_id is not None else None,
                c("category") == category if category else None,
                c("deal_price") <= max_price if max_price is not None else None,
                c("discount_pct") >= min_discount if min_discount is not None else None,
                c("is_online") == is_online if is_online is not None else None,
                place,
            ]
        )
    )


def search_deals(
    deals: DataFrame,
    cities: DataFrame,
    *,
    q: str | None = None,
    city: str | None = None,
    lat: float | None = None,
    lon: float | None = None,
    radius_m: float | None = None,
    **filters,
) -> DataFrame:
    """Text search over title, description and merchant; geography by box only."""
    out = filter_deals(deals, **filters)
    if q:
        term = f"%{q}%"
        out = out.filter(reduce(lambda a, b: a | b, [F.col(n).ilike(term) for n in ("title", "description", "merchant")]))
    if city:
        slugs = cities.filter(F.col("slug").ilike(f"%{city}%")).select(F.col("id").alias("city_id"))
        out = out.join(slugs, "city_id", "left_semi")
    if lat is not None and lon is not None and radius_m is not None:
        bounds = geo.box(lat, lon, radius_m * geo.METERS_TO_MILES)
        out = out.filter(geo.in_box(F.col("lat"), F.col("lon"), bounds))
    return out


def page(deals: DataFrame, sort: str = "rank_score", limit: int = 50, offset: int = 0, *, tie: str = "id") -> DataFrame:
    """Descending, NULLs last, then one page; ``tie`` makes the order total, for pairs both ids do.

    Any column of the frame can be the order; an unknown name falls back to the rank.
    """
    by = sort if sort in deals.columns else "rank_score"
    ties = [tie] if tie in deals.columns else [c for c in PAIR_TIES if c in deals.columns]
    ordered = deals.orderBy(F.col(by).desc_nulls_last(), *ties)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def total_matches(filtered: DataFrame) -> DataFrame:
    return filtered.agg(F.count(F.lit(1)).alias("total"))


def stale_deals(deals: DataFrame, now: str, max_age_hours: float = 48.0) -> DataFrame:
    """Active deals last seen before the cutoff, or never."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(max_age_hours * 3600))
    return deals.filter(F.col("is_active") & (F.col("last_seen_at").isNull() | (F.col("last_seen_at") < cutoff)))


def active_by_name(table: DataFrame, *, active_only: bool = True, **equals) -> DataFrame:
    """Cities, sources or venues by name."""
    out = table.filter("is_active") if active_only else table
    for name, value in equals.items():
        if value:
            out = out.filter(F.col(name) == value)
    return out.orderBy("name", "id")


def lookup(table: DataFrame, **keys) -> DataFrame:
    """Rows by id, slug, name, session or a pair of source keys."""
    return table.filter(_all([F.col(k) == v for k, v in keys.items()]))


def venue_for_mapping(venues: DataFrame, mappings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source_id, external_id) rows -> their venue, NULL when unmapped."""
    ids = mappings.select("source_id", "external_id", "venue_id")
    return wanted.join(ids, ["source_id", "external_id"], "left").join(
        venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name")), "venue_id", "left"
    )


def with_source_name(deals: DataFrame, sources: DataFrame) -> DataFrame:
    return deals.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left")


def deal_cards(deals: DataFrame, sources: DataFrame) -> DataFrame:
    """List rows: source name joined, tags parsed."""
    return with_source_name(deals, sources).withColumn("tags", hashing.tags_array(F.col("tags")))


def weekly_hours(schedules: DataFrame) -> DataFrame:
    """The distinct weekly windows of each deal with day names, Monday first.

    Collected as a set: repeated rows collapse in every task before they are shuffled.
    """
    day = F.get(F.array(*[F.lit(d) for d in DAY_NAMES]), F.col("day_of_week"))
    window = F.struct("day_of_week", day.alias("day_name"), "start_time", "end_time")
    return schedules.groupBy(F.col("deal_id").alias("id")).agg(F.array_sort(F.collect_set(window)).alias("schedules"))


def deal_details(
    deals: DataFrame, sources: DataFrame, venues: DataFrame, schedules: DataFrame, normalization_log: DataFrame
) -> DataFrame:
    """Detail rows: cards plus venue, weekly hours, and whether an extractor was used."""
    used = normalization_log.groupBy(F.col("deal_id").alias("id")).agg(F.bool_or(~F.col("fallback_used")).alias("ai_normalized"))
    venue = venues.select(F.col("id").alias("venue_id"), F.struct("name", "slug", "address", "phone").alias("venue"))
    return (
        deal_cards(deals, sources)
        .join(venue, "venue_id", "left")
        .join(weekly_hours(schedules), "id", "left")
        .join(used, "id", "left")
        .withColumn("ai_normalized", F.coalesce("ai_normalized", F.lit(False)))
    )


def display_flags(cards: DataFrame, now: str) -> DataFrame:
    """Badges and display texts of a card."""
    c = F.col
    left = geo.hours_between(F.lit(now).cast("timestamp"), c("expires_at"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    out = cards.withColumns(
        {
            "discount_badge": yes(c("discount_pct") >= 15),
            "ends_soon": yes((left > 0) & (left <= 24)),
            "verified_badge": yes(c("quality_score") >= 0.8),
            "strike_price": yes((c("deal_price") != 0) & (c("original_price") != 0) & (F.abs(c("original_price") - c("deal_price")) > 0.01)),
            "hours_left": F.round(left, 1),
        }
    )
    return out.withColumn("distance_text", geo.distance_text(c("distance_m"))) if "distance_m" in cards.columns else out
