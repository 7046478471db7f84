"""The quadtree join against all pairs: radii of 50 m and 500 miles in one table, poles, the antimeridian, crowded cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from offermill.functions import geo
from offermill.operators import quadtree, ranking

R = random.Random(12)


def miles(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_MILES * math.asin(math.sqrt(min(1, h)))


def world():
    deals = [(i, R.uniform(-90, 90), R.uniform(-180, 180)) for i in range(300)]
    deals += [(1000 + i, 40.7 + R.gauss(0, 0.02), -74.0 + R.gauss(0, 0.02)) for i in range(600)]  # a crowded city
    deals += [(2000 + i, 40.7, -74.0) for i in range(200)]  # one address
    deals += [(3000 + i, R.uniform(-1, 1), s * R.uniform(179, 180)) for i, s in enumerate([1, -1] * 30)]
    deals += [(4000, 90.0, 10.0), (4001, -90.0, 0.0), (4002, 0.0, 180.0), (4003, 0.0, -180.0), (4004, 89.99, -170.0)]
    radii = [50.0, 500.0, 5_000.0, 100_000.0, 500 / geo.METERS_TO_MILES, 9_000_000.0, 0.0]
    spots = [(40.7, -74.0), (40.71, -74.03), (0.0, 179.999), (0.5, -179.9), (89.95, 0.0), (-90.0, 50.0), (12.3, 45.6), (0.0, 180.0)]
    points = [(i * 10 + j, lat, lon, r) for i, (lat, lon) in enumerate(spots) for j, r in enumerate(radii)]
    return deals, points


@pytest.mark.parametrize("rows_per_leaf,finest", [(20, 18), (1, 6), (10**6, 18)])
def test_equals_all_pairs(spark, rows_per_leaf, finest):
    deals, points = world()
    d = spark.createDataFrame(deals, "id long, lat double, lon double").repartition(4)
    p = spark.createDataFrame(points, "query_id long, q_lat double, q_lon double, radius_m double")
    got = sorted((r.query_id, r.id) for r in quadtree.within_radius(p, d, rows_per_leaf=rows_per_leaf, finest=finest).collect())
    want = sorted((q, i) for q, lat, lon, r in points for i, y, x in deals if miles(lat, lon, y, x) <= r * geo.METERS_TO_MILES)
    assert got == want


def test_tree_and_candidates_per_hit(spark):
    """Every deal lies in one leaf, leaves are small, and few candidates are looked at for a hit."""
    deals, _ = world()
    d = spark.createDataFrame(deals, "id long, lat double, lon double")
    tree = quadtree.leaves(d, rows_per_leaf=20).cache()
    assert tree.agg(F.sum("rows")).first()[0] == len(deals) == quadtree.place(d, tree).count()
    assert {r.level for r in tree.filter("rows > 20").collect()} <= {quadtree.FINEST}
    points = [(i, 40.7 + R.gauss(0, 0.02), -74.0 + R.gauss(0, 0.02), r) for i, r in enumerate([50.0, 800.0, 800_000.0] * 20)]
    p = spark.createDataFrame(points, "query_id long, q_lat double, q_lon double, radius_m double")
    near = quadtree.candidates(p, d, tree).groupBy("radius_m").agg(
        F.count(F.lit(1)).alias("looked"), F.count_if(F.col("distance_miles") <= F.col("radius_m") * geo.METERS_TO_MILES).alias("hits")
    )
    per = {r.radius_m: (r.looked, r.hits) for r in near.collect()}
    assert per[800_000.0][0] <= 1.2 * per[800_000.0][1] and per[800.0][0] <= 8 * per[800.0][1]
    assert per.get(50.0, (0, 0))[0] < 20 * 4 * 20


def test_nothing_on_either_side(spark):
    d = spark.createDataFrame([], "id long, lat double, lon double")
    p = spark.createDataFrame([(1, 0.0, 0.0, 5.0)], "query_id long, q_lat double, q_lon double, radius_m double")
    assert quadtree.within_radius(p, d).count() == 0
    one = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lon double")
    assert quadtree.within_radius(p.limit(0), one).count() == 0 and quadtree.within_radius(p, one).count() == 1


def test_equal_circles_are_answered_once(spark):
    """Points that agree in all but their id share one answer; nulls agree with nulls."""
    points = spark.createDataFrame([(1, 1.0, None), (2, 1.0, None), (3, 2.0, "a"), (4, 2.0, "b")], "query_id long, q_lat double, wish string")
    asked = []

    def answer(leaders):
        asked.extend(leaders.collect())
        return leaders.select("query_id", F.col("q_lat").alias("x"))

    got = ranking.once_per_circle(points, answer).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(1, 1.0), (2, 1.0), (3, 2.0), (4, 2.0)] and len(asked) == 3
