"""Ranking, geo joins, ingest, feedback and streaming jobs on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from offermill.functions import geo
from offermill.functions.scores import RankingConfig
from offermill.operators import feedback, ingest, lifecycle, ranking, skew, validate
from offermill.operators import query as q
from offermill.plans.registry import Tables
from offermill.sources import tables
from offermill.streaming import jobs

NOW = "2024-06-05 12:00:00"
SF = "/root/testdata/sf0.001"
DEAL = """id long, source_id long, source_deal_id string, title string, description string, url string, image_url string, merchant string,
  category string, tags string, original_price double, deal_price double, discount_pct double, expires_at timestamp, fetched_at timestamp,
  first_seen_at timestamp, last_seen_at timestamp, normalized_at timestamp, quality_score double, confidence double, rank_score double,
  is_active boolean, is_online boolean, is_verified boolean, currency string, source_url string, city_id long, venue_id long, lat double, lon double"""
LISTING = "seq long, source_deal_id string, title string, url string, description string, image_url string, merchant string, original_price double, deal_price double, expires_at timestamp, raw_data string"


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def scored(spark, config=RankingConfig(), **kw):
    row = dict(discount_pct=40.0, fetched_at="2024-06-05 12:00:00", last_seen_at=None, quality_score=None, confidence=0.9, category="Bar", deal_type=None,
               is_open_now=True, distance_miles=0.1, venue_source_count=3, preferred_categories=["bar"], preferred_deal_types=[])
    row.update(kw)
    schema = """discount_pct double, fetched_at string, last_seen_at string, quality_score double, confidence double, category string, deal_type string,
      is_open_now boolean, distance_miles double, venue_source_count long, preferred_categories array<string>, preferred_deal_types array<string>"""
    df = spark.createDataFrame([tuple(row.values())], schema)
    df = df.withColumns({n: F.col(n).cast("timestamp") for n in ("fetched_at", "last_seen_at")})
    return ranking.rank_query(df, F.lit(NOW).cast("timestamp"), config).first()


def test_rank_features(spark):
    r = scored(spark)
    want = 0.25 * 0.4 + 0.2 + 0.15 + 0.2 * math.exp(-0.05) + 0.1 * 0.9 + 0.05 * math.log1p(3) / math.log1p(10) + 0.05
    assert r.score == round(want, 4) and r.reasons == ["Open now", "528 ft away", "Posted in the last few hours"]
    assert abs(sum(r.debug.values()) - want) < 1e-12


def test_rank_unknowns(spark):
    r = scored(spark, discount_pct=None, is_open_now=None, distance_miles=None, confidence=None, venue_source_count=1, preferred_categories=[],
               fetched_at="2024-06-03 12:00:00")
    want = 0.1 + 0.15 * math.exp(-1) + 0.1 + 0.05 * math.log1p(1) / math.log1p(10)
    assert r.score == round(want, 4) and r.reasons == ["Posted this week"]
    future = scored(spark, fetched_at="2025-01-01 00:00:00")
    assert future.debug["freshness"] == 0.15
    typed = scored(spark, category=None, deal_type="Happy", preferred_categories=[], preferred_deal_types=["happy"], is_open_now=False,
                   distance_miles=9.0, confidence=0.1, discount_pct=5.0, venue_source_count=1)
    assert "Matches your preference: Happy" in typed.reasons
    assert scored(spark, RankingConfig(deal_value=2.0)).score == 1.0


def test_stored_rank(spark):
    rows = [(1, 50.0, "2024-06-05 12:00:00", 0.8, "A", True, None), (2, None, "2024-06-03 12:00:00", None, "b", True, 0.1), (3, 10.0, NOW, 1.0, "A", False, 0.7)]
    df = spark.createDataFrame(rows, "id long, discount_pct double, f string, quality_score double, category string, is_active boolean, rank_score double")
    out = ranking.rank_stored(df.withColumn("fetched_at", F.col("f").cast("timestamp")), NOW, ["A", "B"]).orderBy("id").collect()
    assert [r.rank_score for r in out] == [round(0.2 + 0.35 + 0.2 + 0.1, 4), round(0.35 * math.exp(-1) + 0.125, 4), 0.7]


@pytest.mark.parametrize("rows_per_task", [skew.ROWS_PER_TASK, 10])
def test_geo_join_equals_cross_join(spark, rows_per_task):
    rng = random.Random(5)
    spots = [(i, *rng.choice([(40.0, -74.0), (rng.uniform(-89, 89), rng.uniform(-180, 180)), (0.1, 179.99), (89.9, 10.0)])) for i in range(150)]
    asks = [(i, *rng.choice([(40.0, -74.01), (0.1, -179.99), (89.95, -170.0), (-88.0, 0.0)]), rng.choice([500.0, 3000.0, 90000.0])) for i in range(40)]
    deals = spark.createDataFrame(spots, "id long, lat double, lon double")
    points = spark.createDataFrame(asks, "query_id long, q_lat double, q_lon double, radius_m double")
    got = {(r.query_id, r.id) for r in ranking.within_radius(points, deals, max_radius_m=5000.0, rows_per_task=rows_per_task).collect()}

    def miles(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 3958.8 * math.asin(math.sqrt(min(1, h)))

    assert got == {(k, i) for k, a, b, r in asks for i, c, d in spots if miles(a, b, c, d) <= r * 0.000621371}


def test_salted_join_and_running_counts(spark):
    rows = [(i, 1 if i % 3 else i % 7, i % 2 == 0) for i in range(300)]
    big = spark.createDataFrame(rows, "n long, k long, flag boolean")
    small = spark.createDataFrame([(k, k * 10) for k in range(7)], "k long, v long")
    got = skew.salted_join(big, small, ["k"], F.col("n"), rows_per_task=20).count()
    assert got == 300
    hot = skew.hot_keys(big, ["k"], 20).collect()
    assert [(r.k, r._parts) for r in hot] == [(1, math.ceil(sum(1 for r in rows if r[1] == 1) / 20))]
    counted = skew.running_counts(big, "k", ["n"], F.floor(F.col("n") / 13), {"c": F.col("flag")}).collect()
    seen: dict = {}
    want = {}
    for n, k, flag in rows:
        seen[k] = seen.get(k, 0) + flag
        want[n] = seen[k]
    assert {r.n: r.c for r in counted} == want
    lagged = skew.previous_value(big, ["k"], "n", "n", F.floor(F.col("n") / 13), "p").collect()
    last: dict = {}
    for n, k, _ in rows:
        want[n], last[k] = last.get(k), n
    assert {r.n: r.p for r in lagged} == want


def listing(spark, *rows):
    return spark.createDataFrame(rows, LISTING)


def test_upsert_keeps_first_seen_and_order(spark):
    target = spark.createDataFrame([(1, 1, "a", "old", None, None)], "id long, source_id long, source_deal_id string, title string, first_seen_at timestamp, last_seen_at timestamp")
    batch = spark.createDataFrame([(1, "a", None, 1), (1, "b", "x", 2), (1, "b", "y", 3)], "source_id long, source_deal_id string, title string, seq long")
    after, actions = ingest.upsert(target, batch, ingest.KEY, NOW)
    rows = {r.source_deal_id: r for r in after.collect()}
    assert rows["a"].title is None and rows["a"].first_seen_at is None and str(rows["a"].last_seen_at) == NOW
    assert rows["b"].title == "y" and str(rows["b"].first_seen_at) == NOW and rows["b"].id is not None
    assert {r.source_deal_id: (r.action, r.n_rows) for r in actions.collect()} == {"a": ("updated", 1), "b": ("inserted", 2)}


def test_venue_batch_twice_skips(spark, tmp_path):
    state = ingest.VenueState(
        empty(spark, "id long, name string, slug string, city_id long, address string, lat double, lon double, category string, phone string, website string, image_url string, confidence double, is_active boolean"),
        empty(spark, "id long, venue_id long, source_id long, external_id string, external_url string, last_seen_at timestamp, confidence double"),
        empty(spark, DEAL),
        empty(spark, "id long, source_id long, source_deal_id string, deal_id long, raw_payload string, content_hash string, fetched_at timestamp"),
        empty(spark, "id long, deal_id long, day_of_week int, start_time string, end_time string, valid_from timestamp, valid_until timestamp, timezone string"),
        empty(spark, "deal_id long, model string, prompt_tokens long, completion_tokens long, raw_response string, fallback_used boolean, normalized_at timestamp"),
    )
    feed = spark.createDataFrame(
        [("e1", "Joe's & Co", "New York", "img1", 1), ("e2", "Joe's & Co", "New York", "img2", 2), ("e3", "Other", "New York", "img3", 3)],
        "external_id string, name string, city string, image_url string, seq long",
    ).select("*", *[F.lit(None).cast("string").alias(n) for n in ("address", "category", "phone", "website")], *[F.lit(None).cast("double").alias(n) for n in ("lat", "lon")])
    rows = listing(
        spark,
        (1, "d1", "Happy hour", "u", None, None, "Joe's", 20.0, 15.0, None, '{"venue_external_id": "e1", "valid_day_indices": [0, 4], "start_time": "17:00", "end_time": "19:00", "discount_pct": 30.0}'),
        (2, "d2", "Lunch", "u", None, None, None, None, None, None, '{"venue_external_id": "nope", "discount_pct": 7.5}'),
    )
    once, first = ingest.ingest_venue_batch(state, feed, rows, 3, 5, "2024-06-01 00:00:00")
    once = tables.write_state(once, str(tmp_path), 1)
    assert sorted(r.action for r in first.collect()) == ["inserted", "inserted"]
    assert sorted(r.slug for r in once.venues.collect()) == ["joes-and-co-new-york", "other-new-york"]
    assert once.mappings.count() == 3 and once.schedules.count() == 2 and once.deals_raw.count() == 2
    deals = {r.source_deal_id: r for r in once.deals.collect()}
    assert deals["d1"].discount_pct == 25.0 and deals["d2"].discount_pct == 7.5 and deals["d2"].venue_id is None and deals["d1"].image_url == "img1"
    twice, second = ingest.ingest_venue_batch(once, feed, rows, 3, 5, NOW)
    twice = tables.write_state(twice, str(tmp_path), 2)
    assert [r.action for r in second.collect()] == ["skipped", "skipped"]
    assert {str(r.last_seen_at) for r in twice.deals.collect()} == {NOW} and twice.deals_raw.count() == 2 and twice.schedules.count() == 2
    cheaper = rows.withColumn("deal_price", F.lit(10.0)).filter("seq = 1")
    third, acted = ingest.ingest_venue_batch(twice, feed, cheaper, 3, 5, "2024-06-06 00:00:00")
    assert [r.action for r in acted.collect()] == ["updated"] and third.schedules.count() == 2 and third.deals_raw.count() == 3
    assert {r.source_deal_id: str(r.first_seen_at) for r in third.deals.collect()} == {"d1": "2024-06-01 00:00:00", "d2": "2024-06-01 00:00:00"}


def reports(spark, *kinds, deal=1):
    rows = [(i, k, deal, f"2024-06-01 0{i % 10}:30:00") for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "event_id long, event_type string, deal_id long, t string").withColumn("created_at", F.col("t").cast("timestamp"))


@pytest.mark.parametrize("kinds,quality,active", [
    ("iii", 0.6, True), ("ii", 0.9, True), ("iiii", 0.3, True), ("iiie", 0.3, True), ("eee", 0.9, False), ("eiiie", 0.3, True), ("iiiiiiiiii", 0.0, True), ("vvv", 0.9, True),
])
def test_report_rules(spark, kinds, quality, active):
    names = {"i": "report_incorrect", "e": "report_expired", "v": "view"}
    deals = spark.createDataFrame([(1, 0.9, None, True, None), (2, None, None, True, None)], "id long, quality_score double, confidence double, is_active boolean, expires_at timestamp")
    out, actions = feedback.apply_reports(deals, reports(spark, *[names[k] for k in kinds]), NOW)
    one, two = out.orderBy("id").collect()
    assert (one.quality_score, one.is_active) == (quality, active) and two.quality_score is None
    assert (str(one.expires_at) == NOW) == (not active)
    if quality < 0.9:
        assert one.confidence == max(0.0, round(0.5 - 0.3 * round((0.9 - quality) / 0.3), 3)) or kinds == "iiiiiiiiii"


def test_source_health(spark):
    table = spark.createDataFrame([(1, 4, None, None), (2, 1, None, None), (3, 9, None, None)], "id long, consecutive_failures long, a timestamp, b timestamp")
    rows = [(1, "2024-01-01", False), (1, "2024-01-02", True), (1, "2024-01-03", False), (2, "2024-01-01", False)]
    seen = spark.createDataFrame(rows, "id long, t string, success boolean").withColumn("at", F.col("t").cast("timestamp"))
    out = lifecycle.apply_outcomes(table, seen, stamp="a", success_stamp="b")
    assert {r.id: r.consecutive_failures for r in out.collect()} == {1: 1, 2: 2, 3: 9}


def test_event_rules(spark):
    rows = [("rating", '{"value": 3}'), ("rating", '{"value": 6}'), ("rating", None), ("rating", '{"value": 2.5}'), ("hack", None), ("save", "broken")]
    df = spark.createDataFrame(rows, "event_type string, payload string")
    good, bad = validate.split_rows(df, validate.event_reason())
    assert sorted(r.event_type for r in good.collect()) == ["rating", "save"] and bad.count() == 4


def test_page_order(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9), (4, 0.5)], "id long, rank_score double")
    assert [r.id for r in q.page(df, "bogus", limit=3, offset=1).collect()] == [1, 4, 2]
    pairs = spark.createDataFrame([(2, 1, 70.0), (1, 9, 70.0), (1, 3, 70.0), (4, 5, 99.0)], "a_id long, b_id long, match_score double")
    assert [(r.a_id, r.b_id) for r in q.page(pairs, "match_score", limit=3).collect()] == [(4, 5), (1, 3), (1, 9)]


def test_blank_urls_are_no_duplicates(spark):
    rows = [(1, 1, ""), (2, 2, ""), (3, 3, None), (4, 1, " "), (5, 1, "http://x/a?b"), (6, 2, "http://X/a/")]
    deals = spark.createDataFrame([(*r, True, 0.5, None) for r in rows], "id long, source_id long, url string, is_active boolean, quality_score double, fetched_at timestamp")
    out, stats = ingest.flag_url_duplicates(deals)
    assert {r.id for r in out.collect() if not r.is_active} == {5}
    assert tuple(stats.first()) == (6, 1)


@pytest.mark.parametrize("lat,lon,miles", [(60.0, 10.0, 500.0), (10.0, 179.99, 50.0), (-5.0, -179.9, 400.0), (89.0, 0.0, 300.0)])
def test_box_holds_the_circle(spark, lat, lon, miles):
    ring = spark.range(720).select(
        F.radians(F.lit(lat)).alias("y"), F.radians(F.lit(lon)).alias("x"), F.radians(F.col("id") / 2).alias("b"), F.lit(miles * 0.999999 / geo.EARTH_RADIUS_MILES).alias("r")
    )
    y = F.asin(F.sin("y") * F.cos("r") + F.cos("y") * F.sin("r") * F.cos("b"))
    x = F.col("x") + F.atan2(F.sin("b") * F.sin("r") * F.cos("y"), F.cos("r") - F.sin("y") * F.sin(y))
    points = ring.select(F.degrees(y).alias("lat"), (F.pmod(F.degrees(x) + 180, F.lit(360.0)) - 180).alias("lon"))
    assert points.filter(~geo.in_box(F.col("lat"), F.col("lon"), geo.box(lat, lon, miles))).count() == 0


def split_files(df, folder, parts):
    for i in range(parts):
        df.filter(F.col("event_id") % parts == i).coalesce(1).write.mode("append").parquet(folder)


def test_stream_of_reports_equals_batch(spark, tmp_path):
    events = Tables(spark, SF).event_log
    folder = str(tmp_path / "events")
    cuts = [("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-20"), ("2024-01-20", "2024-03-01")]
    root = str(tmp_path / "state")
    for low, high in cuts:
        events.filter((F.col("created_at") >= low) & (F.col("created_at") < high)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        jobs.stream_report_actions(stream, root).awaitTermination()
    names = ["event_id", "deal_id", "n_incorrect", "n_expired", "demote", "expire"]
    got = spark.read.parquet(f"{root}/report_actions").select(*names)
    want = feedback.report_actions(feedback.running_reports(events)).select(*names)
    assert tables.read_log(spark, root, "report_counts", jobs.COUNTS).select("batch").distinct().count() == 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_of_changes(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "source_id long, source_deal_id string, seq long, content_hash string"
    for batch in ([(1, "a", 1, "A"), (1, "b", 2, "X")], [(1, "a", 3, "B"), (1, "a", 4, "B"), (1, "b", 5, "X")], [(1, "a", 6, "A")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.stream_changes(spark.readStream.schema(schema).parquet(folder), root).awaitTermination()
    got = {r.seq: r.changed for r in spark.read.parquet(f"{root}/changes").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}


def test_stream_ingest_versions(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "state")
    tables.write_version(empty(spark, DEAL), root, "deals", 0)
    clock = ["2024-06-01 00:00:00", "2024-06-02 00:00:00"]
    for i, price in enumerate((5.0, 4.0)):
        listing(spark, (i, "d", "Happy hour", "http://x", None, None, None, 10.0, price, None, None)).coalesce(1).write.mode("append").parquet(folder)
        jobs.stream_ingest(spark.readStream.schema(LISTING).parquet(folder), root, 1, lambda b: clock[b]).awaitTermination()
    row = tables.read_version(spark, root, "deals", 2).first()
    assert (row.deal_price, row.discount_pct, str(row.fetched_at)) == (4.0, 60.0, clock[0])
    assert tables.read_version(spark, root, "deals", 1).first().deal_price == 5.0


def test_url_duplicates(spark):
    rows = [(1, 1, "http://x/a?1", 0.9), (2, 2, "HTTP://x/a/", 0.5), (3, 1, "http://x/a", 0.1), (4, 3, "http://x/b", None), (5, 3, "http://x/b", 0.2)]
    df = spark.createDataFrame(rows, "id long, source_id long, url string, quality_score double").withColumns(
        {"is_active": F.lit(True), "fetched_at": F.lit(NOW).cast("timestamp")}
    )
    out, stats = ingest.flag_url_duplicates(df)
    assert {r.id for r in out.filter("NOT is_active").collect()} == {2} and tuple(stats.first()) == (5, 1)


def test_a_written_batch_is_joined_to_the_table_once(spark):
    """The batch is aggregated and the table joined once for all results; ranks are made of the new values."""
    target = spark.createDataFrame([(1, 9, "a", 1.0, 0.5), (2, 9, "b", 2.0, 0.5)], "id long, source_id long, source_deal_id string, price double, rank_score double")
    batch = spark.createDataFrame([(9, "b", 5.0, 1), (9, "c", 3.0, 2), (9, "b", 7.0, 3)], "source_id long, source_deal_id string, price double, seq long")
    after, actions = ingest.upsert(
        target, batch, ingest.KEY, NOW, insert_stamps=(), update_stamps=(), derived={"rank_score": F.col("price") * 10}, write_batch=True
    )
    assert {r.source_deal_id: (r.price, r.rank_score) for r in after.collect()} == {"a": (1.0, 0.5), "b": (7.0, 70.0), "c": (3.0, 30.0)}
    assert {r.source_deal_id: r.action for r in actions.collect()} == {"b": "updated", "c": "inserted"}
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
