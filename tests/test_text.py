"""Text, price, schedule and item expressions against expectations worked out from the rules."""

import pytest
from pyspark.sql import functions as F

from offermill.functions import geo, hashing, price, schedule, text
from offermill.operators import extract


def values(spark, expr, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("t"))).collect()]


PRICES = {
    "$8": (8.0, None), "8 dollars": (8.0, None), "12.50 bucks": (12.5, None), "under $10": (None, (0.0, 10.0)),
    "up to 15 dollars": (None, (0.0, 15.0)), "$8-$12": (None, (8.0, 12.0)), "$12 to $8": (None, (8.0, 12.0)),
    "8 to 12 dollars": (None, (8.0, 12.0)), "free wings": (0.0, None), "gluten-free menu": (0.0, None),
    "€1,250": (1250.0, None), "from 5-7pm": (None, None), "$5pm": (None, None), "$12.50pm": (12.0, None), "": (None, None),
    "$8-$12pm": (None, (1.0, 8.0)), "max 21 people": (None, (0.0, 21.0)), "up to 50% off": (None, (0.0, 50.0)),
}


def test_parse_price(spark):
    got = values(spark, price.parse_price, PRICES)
    assert [(r.price, tuple(r.price_range) if r.price_range else None) for r in got] == list(PRICES.values())


def test_parse_price_falls_back_to_feed(spark):
    got = values(spark, lambda t: price.parse_price(t, F.lit(3.0)), ["no signal", "$4"])
    assert [r.price for r in got] == [3.0, 4.0]


def test_currency_order(spark):
    assert values(spark, price.currency, ["€5 or $6", "£3", "¥9", "none"]) == ["USD", "GBP", "JPY", "USD"]


def test_rule_price(spark):
    got = values(spark, price.rule_price, ["$12-$8.50", "$5 and $6", "none", "$10 to $10.25"])
    assert [tuple(r) for r in got] == [(None, "$8.5-$12"), (5.0, None), (None, None), (None, "$10-$10.25")]


def test_price_pair(spark):
    got = values(spark, price.price_pair, ["TV $799.99 (was $1299.99)", "$5 $9", "$5", "none"])
    assert [tuple(r) for r in got] == [(1299.99, 799.99), (9.0, 5.0), (None, 5.0), (None, None)]


DAYS = {
    "daily 5pm": ["daily"], "every day": ["daily"], "weekdays and weekends": ["daily"], "Mon-Fri": ["weekdays"],
    "Monday through Friday": ["weekdays"], "M-F": ["weekdays"], "sat & sun": ["weekends"],
    "Tuesday through Thursday": ["tuesday", "wednesday", "thursday"], "Fri to Mon": ["friday", "saturday", "sunday", "monday"],
    "thurs, mon and thursday": ["thursday", "monday"], "Sunday or saturday": ["weekends"], "sometime": [], "money": [],
    "fri thu wed tue mon": ["weekdays"],
}


def test_detect_days(spark):
    assert values(spark, schedule.detect_days, DAYS) == list(DAYS.values())


def test_expand_days(spark):
    df = spark.createDataFrame([(["weekdays", "Saturday"],), (["nope"],), ([],)], "d array<string>")
    got = [r[0] for r in df.select(schedule.expand_days(F.col("d"))).collect()]
    assert got == [[0, 1, 2, 3, 4, 5], [], []]


TIMES = {
    "5-7pm": ("17:00", "19:00"), "5pm to 7pm": ("17:00", "19:00"), "11am-3pm": ("11:00", "15:00"), "11-2pm": ("11:00", "14:00"),
    "noon to 3": ("12:00", "15:00"), "10pm-midnight": ("22:00", "00:00"), "after 5": ("17:00", None), "until 7:30pm": (None, "19:30"),
    "before 10": (None, "10:00"), "at 8pm": ("20:00", None), "noon": ("12:00", None), "midnight": ("00:00", None),
    "5:30 p.m. - 9 p.m.": ("17:30", "21:00"), "2-3 items": ("14:00", "15:00"), "25-26": (None, None), "nothing": (None, None),
    "12am-12pm": ("00:00", "12:00"), "after 25": (None, None), "5-7 and after 9": ("17:00", "19:00"),
}


def test_time_range(spark):
    assert [tuple(r) for r in values(spark, schedule.parse_time_range, TIMES)] == list(TIMES.values())


def test_offer_type(spark):
    given = ["Happy-Hour", "lunch combo", "midday  special", "earlybird", "tasting menu", "prix fixe dinner special", "lunchtime"]
    assert values(spark, text.offer_type, given) == [
        "happy_hour", "lunch_special", "lunch_special", "early_bird", "prix_fixe", "prix_fixe", "other",
    ]


ITEMS = {
    "including soup, salad and entree. More": ["soup", "salad", "entree"],
    "featuring: Wings & wings + fries not valid Sunday": ["Wings", "fries"],
    "combo: soup, sandwich": ["soup", "sandwich"],
    "limit: two must be 21": [],
    "Menu\n- tacos\n* Beer, tacos\n• ok": ["tacos", "Beer"],
    "with a": [],
}


def test_items(spark):
    assert values(spark, extract.extract_items, ITEMS) == list(ITEMS.values())


def test_all_items_are_kept(spark):
    many = "including " + ", ".join(f"item{i}" for i in range(15))
    assert values(spark, extract.extract_items, [many]) == [[f"item{i}" for i in range(15)]]


def test_restrictions(spark):
    got = values(spark, extract.extract_restrictions, ["Dine in only. Limit 3 per guest, ages 21", "no to-go, no delivery"])
    assert got == [["dine-in only", "21+", "limit 3 per guest"], ["no takeout"]]


def test_clean_text(spark):
    given = ["a &amp; b", "<b>hi</b> there*", "“q” – x — y", "  \n ", "é", "x\n\n\n\ny", "* note *seen", None, "&nbsp;a"]
    assert values(spark, text.clean_text, given) == ["a & b", "hi there", '"q" - x - y', None, "é", "x\n\ny", "note", None, "a"]


def test_slug_and_merchant(spark):
    assert values(spark, text.slug, ["Café Central", "--A b--", None]) == ["caf-central", "a-b", ""]
    given = ["1. The Spotted Dog — Tribeca\nmore", "Blue Smoke\nx", "12 Main", "Abc", "2. Ab", "The Anchor — Tribeca"]
    assert values(spark, text.block_merchant, given) == ["The Spotted Dog", "Blue Smoke", None, None, None, "The Anchor — Tribeca"]


def test_city_helpers(spark):
    assert values(spark, text.city_slug, [" New York, NY "]) == ["new-york-ny"]
    got = [tuple(r) for r in values(spark, text.city_info, ["nyc", "old-town"])]
    assert got == [("New York", "NY", "US"), ("Old Town", None, "US")]


def test_hashes(spark):
    assert values(spark, lambda t: hashing.listing_id(F.lit("golden_test"), t), ["raw-g01"]) == ["0421c86cf9c1e682"]
    a, b, c = values(spark, hashing.content_hash, ['{"a": 1, "b": {"x": 1, "y": 2}}', '{"b":{"y":2,"x":1},"a":1}', '{"a": 2}'])
    assert a == b != c


def test_canonical_url(spark):
    given = ["https://X.com/A/?q=1#f", "http://h/p;v=1", "http://h/", "HTTP://h/a;b/c"]
    assert values(spark, hashing.canonical_url, given) == ["https://x.com/a", "http://h/p", "http://h", "http://h/a;b/c"]


@pytest.mark.parametrize("metres,shown", [(850.4, "850 m"), (1250.0, "1.3 km"), (None, None)])
def test_distance_text(spark, metres, shown):
    df = spark.createDataFrame([(metres,)], "m double")
    assert df.select(geo.distance_text(F.col("m"))).first()[0] == shown


def test_haversine_and_box(spark):
    df = spark.createDataFrame([(40.7128, -74.0060, 34.0522, -118.2437)], "a double, b double, c double, d double")
    miles = df.select(geo.miles_between(*[F.col(n) for n in "abcd"])).first()[0]
    assert abs(miles - 2445.7) < 2
    low_lat, high_lat, [(low_lon, high_lon)] = geo.box(40.0, -74.0, 10)
    assert low_lat < 40 < high_lat and low_lon < -74 < high_lon and high_lon - low_lon > high_lat - low_lat


SCHEDULES = [
    # (day, start, end, from, until) at Wednesday 2024-06-05 17:00
    ((None, "16:00", "18:00", None, None), True), ((2, "17:00", "17:00", None, None), True), ((3, "16:00", "18:00", None, None), False),
    ((2, "17:01", "18:00", None, None), False), ((2, None, None, None, None), True), ((2, "20:00", None, None, None), True),
    ((2, "22:00", "02:00", None, None), False), ((None, None, None, "2024-06-06", None), False), ((None, None, None, None, "2024-06-05"), False),
]


def test_schedule_open(spark):
    rows = [(i, *s) for i, (s, _) in enumerate(SCHEDULES)]
    df = spark.createDataFrame(rows, "i int, d int, s string, e string, f string, u string").orderBy("i")
    made = df.select(
        "i",
        F.array(
            F.struct(
                F.col("d").alias("day_of_week"), F.col("s").alias("start_time"), F.col("e").alias("end_time"),
                F.col("f").cast("timestamp").alias("valid_from"), F.col("u").cast("timestamp").alias("valid_until"),
            )
        ).alias("s"),
    )
    at = F.lit("2024-06-05 17:00:00").cast("timestamp")
    assert [r[0] for r in made.orderBy("i").select(schedule.open_at(F.col("s"), at)).collect()] == [w for _, w in SCHEDULES]
    late = F.lit("2024-06-05 23:00:00").cast("timestamp")
    over = made.filter("i = 6").select(schedule.open_at(F.col("s"), late, overnight=True)).first()[0]
    assert over
