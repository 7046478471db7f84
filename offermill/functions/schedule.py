"""Weekday and time-window expressions over free text, and the open-at test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has, let, match_groups

# --- fixed values -----------------------------------------------------------------
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
DAY_SETS = {"weekdays": [0, 1, 2, 3, 4], "weekends": [5, 6], "daily": [0, 1, 2, 3, 4, 5, 6]}
DAY_ABBREVIATIONS = {"Mon": 0, "Tue": 1, "Wed": 2, "Thu": 3, "Fri": 4, "Sat": 5, "Sun": 6}
DAY_NAME = (
    r"(mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:r(?:s(?:day)?)?)?|"
    r"fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
)
EVERY_DAY = r"\bdaily\b|\bevery\s+day\b|\ball\s+week\b|\b7\s+days\b"
WEEKDAYS = r"\bweekdays?\b|\bmon(?:day)?\s*(?:–|-|through|to)\s*fri(?:day)?\b|\bm\s*[-–]\s*f\b"
WEEKENDS = r"\bweekends?\b|\bsat(?:urday)?\s*(?:and|&|to|–|-|through)\s*sun(?:day)?\b"
DAY_RANGE = r"(?iU)\b" + DAY_NAME + r"\s*(?:through|–|-|to)\s*" + DAY_NAME + r"\b"
ONE_DAY = r"(?iU)\b" + DAY_NAME + r"\b"
CLOCK = r"([0-9]{1,2})(?::([0-9]{2}))?\s*(am|pm|a\.m\.|p\.m\.)"
AFTER = r"(?iU)\bafter\s+" + CLOCK + r"?"
UNTIL = r"(?iU)\b(?:until|before|by)\s+" + CLOCK + r"?"
TIME_RANGE = r"(?iU)" + CLOCK + r"?\s*(?:–|-|to|through|until)\s*" + CLOCK + r"?"
ONE_TIME = r"(?iU)" + CLOCK
HH_MM = r"^[0-9]{2}:[0-9]{2}$"
# ----------------------------------------------------------------------------------


def _array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _day_index(c: Column) -> Column:
    """Every accepted spelling is told apart by its first three letters."""
    prefixes = _array([d[:3] for d in DAYS])
    return (F.array_position(prefixes, F.lower(F.substring(c, 1, 3))) - 1).cast("int")


def _day_names(indices: Column) -> Column:
    return F.transform(indices, lambda i: F.get(_array(DAYS), i))


def _collapse(indices: Column) -> Column:
    ordered = F.array_sort(indices)
    return (
        F.when(ordered == _array(DAY_SETS["weekdays"]), _array(["weekdays"]))
        .when(ordered == _array(DAY_SETS["weekends"]), _array(["weekends"]))
        .otherwise(_day_names(indices))
    )


def detect_days(text: Column) -> Column:
    """Day names mentioned in the text, as an ordered array."""

    def span(g: Column) -> Column:
        first, last = _day_index(F.get(g, F.lit(0))), _day_index(F.get(g, F.lit(1)))
        run = F.when(first <= last, F.sequence(first, last)).otherwise(
            F.concat(F.sequence(first, F.lit(6)), F.sequence(F.lit(0), last))
        )
        return F.when(g.isNotNull(), run)

    mentions = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ONE_DAY), F.lit(1)), _day_index))
    named = let(F.coalesce(let(match_groups(text, DAY_RANGE, 2), span), mentions), _collapse)

    def choose(s: Column) -> Column:
        return (
            F.when(s["week"] & s["ends"], _array(["daily"]))
            .when(s["week"], _array(["weekdays"]))
            .when(s["ends"], _array(["weekends"]))
            .otherwise(named)
        )

    sets = F.struct(has(text, WEEKDAYS).alias("week"), has(text, WEEKENDS).alias("ends"))
    return F.when(has(text, EVERY_DAY), _array(["daily"])).otherwise(let(sets, choose))


def expand_days(names: Column) -> Column:
    """Day and day-set names -> sorted weekday numbers, 0 = Monday; unknown names drop out."""
    table = {day: [i] for i, day in enumerate(DAYS)} | DAY_SETS
    entries = [part for name, days in table.items() for part in (F.lit(name), _array(days))]
    lookup = F.create_map(*entries)
    numbers = F.transform(names, lambda n: F.coalesce(F.try_element_at(lookup, F.lower(n)), F.array().cast("array<int>")))
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(numbers))), F.array().cast("array<int>"))


def abbreviations_to_days(names: Column) -> Column:
    """['Mon', 'Fri'] -> [0, 4], order kept."""
    lookup = F.create_map(*[F.lit(x) for pair in DAY_ABBREVIATIONS.items() for x in pair])
    return F.array_compact(F.transform(names, lambda n: F.try_element_at(lookup, n)))


def _clock(g: Column, half: Column | None = None, at: int = 0) -> Column:
    """HH:MM of the groups (hour, minute, am/pm) at a place, NULL when out of range.

    Hours up to nine without am/pm are evening hours.
    """
    part = lambda i: F.get(g, F.lit(at + i))
    half = F.replace(F.lower(part(2) if half is None else half), F.lit("."), F.lit(""))
    fields = F.struct(
        part(0).cast("int").alias("h"),
        F.when(part(1) == "", F.lit(0)).otherwise(part(1).cast("int")).alias("m"),
        half.alias("half"),
    )

    def hours(f: Column) -> Column:
        h = f["h"]
        return (
            F.when((f["half"] == "pm") & (h != 12), h + 12)
            .when((f["half"] == "am") & (h == 12), F.lit(0))
            .when((f["half"] == "") & (h <= 9), h + 12)
            .otherwise(h)
        )

    def shown(f: Column, h: Column) -> Column:
        text = F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(f["m"].cast("string"), 2, "0"))
        return F.when(h.between(0, 23) & f["m"].between(0, 59), text)

    return let(fields, lambda f: let(hours(f), lambda h: shown(f, h)))


def parse_time_range(text: Column) -> Column:
    """struct(start_time, end_time) as HH:MM text; either may be NULL.

    A window wins over 'after', 'until' and a single time; each of these is only searched
    when the ones before it found nothing.
    """
    none = F.lit(None).cast("string")

    def both(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start_time"), end.alias("end_time"))

    def window(g: Column) -> Column:
        part = lambda i: F.get(g, F.lit(i))
        shared = (part(2) == "") & (part(0).cast("int") <= part(3).cast("int"))
        half = F.when(shared, part(5)).otherwise(part(2))
        return F.when(g.isNotNull(), both(_clock(g, half), _clock(g, at=3)))

    def edge(t: Column, pattern: str, place) -> Column:
        return let(match_groups(t, pattern + r"\b", 3, pattern), lambda g: F.when(g.isNotNull(), place(_clock(g))))

    def parsed(t: Column) -> Column:
        return F.coalesce(
            let(match_groups(t, TIME_RANGE, 6), window),
            edge(t, AFTER, lambda c: both(c, none)),
            edge(t, UNTIL, lambda c: both(none, c)),
            edge(t, ONE_TIME, lambda c: both(c, none)),
            both(none, none),
        )

    t = F.regexp_replace(text, r"(?iU)\bnoon\b", "12:00pm")
    return let(F.regexp_replace(t, r"(?iU)\bmidnight\b", "00:00am"), parsed)


def canonical_time(c: Column) -> Column:
    return F.when(c.rlike(HH_MM), c)


def minutes(hhmm: Column) -> Column:
    return F.split_part(hhmm, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(hhmm, F.lit(":"), F.lit(2)).cast("int")


def schedule_open(s: Column, at: Column, *, overnight: bool = False) -> Column:
    """Whether one schedule struct covers the instant.  All comparisons are in UTC."""
    now_min = F.hour(at) * 60 + F.minute(at)
    start, end = minutes(s["start_time"]), minutes(s["end_time"])
    inside = now_min.between(start, end)
    if overnight:
        inside = F.when(start > end, (now_min >= start) | (now_min <= end)).otherwise(inside)
    windowed = (F.coalesce(s["start_time"], F.lit("")) != "") & (F.coalesce(s["end_time"], F.lit("")) != "")
    return (
        (s["valid_from"].isNull() | (at >= s["valid_from"]))
        & (s["valid_until"].isNull() | (at <= s["valid_until"]))
        & (s["day_of_week"].isNull() | (s["day_of_week"] == F.weekday(at)))
        & (~windowed | inside)
    )


def open_at(schedules: Column, at: Column, *, overnight: bool = False) -> Column:
    """True when a collected schedule array is empty or has one that covers the instant."""
    none = F.coalesce(F.size(schedules), F.lit(0)) <= 0
    return none | F.coalesce(F.exists(schedules, lambda s: schedule_open(s, at, overnight=overnight)), F.lit(False))
