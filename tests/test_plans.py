"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from offermill.operators import query as q
from offermill.operators import ranking
from offermill.plans.registry import Tables
from offermill.plans.views import NOW

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Domain tables as Parquet, as a deployment has them."""
    root = str(tmp_path_factory.mktemp("tables"))
    t = Tables(spark, SF)
    for name in ("deals", "schedules", "mappings", "cities"):
        getattr(t, name).write.parquet(f"{root}/{name}")
    return {n: spark.read.parquet(f"{root}/{n}") for n in ("deals", "schedules", "mappings", "cities")}


def test_box_reaches_the_scan(stored):
    near = ranking.nearby(stored["deals"], stored["schedules"], stored["mappings"], lat=43.05, lon=-115.95, radius_m=5000.0, at=NOW)
    plan = plan_of(q.page(near.select("id", "score"), "score"))
    assert "GreaterThanOrEqual(lat," in plan and "LessThanOrEqual(lon," in plan
    assert "TakeOrderedAndProject" in plan
    assert "description" not in plan


def test_filters_reach_the_scan(stored):
    plan = plan_of(q.page(q.filter_deals(stored["deals"], city_id=7, category="2-HIGH", max_price=5.0).select("id", "rank_score"), "rank_score"))
    for part in ("EqualTo(city_id,7)", "EqualTo(category,2-HIGH)", "LessThanOrEqual(deal_price,5.0)"):
        assert part in plan
    assert "TakeOrderedAndProject" in plan


def test_small_points_do_not_shuffle_deals(stored, spark):
    points = Tables(spark, SF).points.select("query_id", "q_lat", "q_lon", "radius_m")
    plan = plan_of(ranking.within_radius(points, ranking.located(stored["deals"]), max_radius_m=2000.0))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_top_per_point_is_cut_before_the_shuffle(stored, spark):
    points = Tables(spark, SF).points.select("query_id", "q_lat", "q_lon", "radius_m", F.array("wanted").alias("preferred_categories"))
    out = ranking.nearby_batch(points, stored["deals"], stored["schedules"], stored["mappings"], at=NOW, max_radius_m=2000.0, top=5)
    assert "WindowGroupLimit" in plan_of(out)
