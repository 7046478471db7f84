"""Three records end to end: ids, keys and scores of known inputs."""

import json

from offermill.operators import normalize

CANDIDATE = (
    "seq long, deal_type string, price double, price_range string, items_included array<string>, schedule_days array<string>, "
    "start_time string, end_time string, restrictions array<string>, confidence double, validation_errors array<string>, "
    "source_url string, source_block_text string, extraction_method string"
)
RAW = "seq long, source_deal_id string, title string, url string, description string, merchant string, deal_price double, original_price double"


def candidate(seq=2, **kw):
    row = dict(
        deal_type="early_bird", price=29.0, price_range=None, items=["soup", "salad", "entree"], days=["daily"], start="17:00", end="18:30",
        restrictions=[], confidence=0.9, errors=[], url="u", text="The Anchor — Tribeca\nEarly bird daily 5-6:30pm. $29 prix-fixe.", method="rule_based",
    )
    row.update(kw)
    return (seq, *row.values())


def test_golden_records(spark):
    raw = spark.createDataFrame(
        [
            (0, "raw-g01", "Happy Hour at Blue Smoke", "https://example.com/blue-smoke", "Mon-Fri 5-7pm. $6 draft beer.", "Blue Smoke", None, None),
            (1, "raw-g02", "Lunch Special", "https://example.com/lunch", "Weekdays 11am-3pm. Under $15.", "Café Central", None, None),
        ],
        RAW,
    )
    found = spark.createDataFrame([candidate()], CANDIDATE)
    out = normalize.normalize_listings(normalize.Provenance("golden_test", "2024-06-01 12:00:00", "run-golden"), raw, found)
    docs = [json.loads(r.json) for r in normalize.to_json_rows(out.orderBy("first_seq")).collect()]
    keys = ("deal_id", "price", "price_range", "days", "start_time", "end_time", "confidence", "quality_score", "dedup_key", "last_seen")
    seen = "2024-06-01T12:00:00+00:00"
    assert [tuple(d[k] for k in keys) for d in docs] == [
        ("0421c86cf9c1e682", 6.0, None, [0, 1, 2, 3, 4], "17:00", "19:00", 0.78, 0.88, "blue-smoke|happy_hour|01234|17:00|19:00", seen),
        ("90e72c75d65287bd", None, [0.0, 15.0], [0, 1, 2, 3, 4], "11:00", "15:00", 0.78, 0.88, "caf-central|lunch_special|01234|11:00|15:00", seen),
        ("1e910fe0cd52be19", 29.0, None, list(range(7)), "17:00", "18:30", 0.98, 0.93, "the-anchor-tribeca|early_bird|0123456|17:00|18:30", seen),
    ]
    assert docs[2]["source_deal_id"] == "456913202f01" and docs[2]["title"] == "The Anchor - Tribeca"


def test_winner_and_order(spark):
    rows = [candidate(0, confidence=0.2, errors=["x"]), candidate(1), candidate(2), candidate(3, days=["monday"])]
    out = normalize.normalize_listings(normalize.Provenance("s", "2024-01-01"), candidates=spark.createDataFrame(rows, CANDIDATE))
    assert [(r.seq, r.first_seq) for r in out.orderBy("first_seq").collect()] == [(1, 0), (3, 3)]


def test_candidate_issues_and_price_text(spark):
    rows = [candidate(0, price=None, text="Plain block\nunder $9", errors=["a", "b"], deal_type="bogus"), candidate(1, price=None, price_range="$12-$8")]
    out = normalize.normalize_listings(normalize.Provenance("s", "2024-01-01"), candidates=spark.createDataFrame(rows, CANDIDATE), dedup=False)
    one, two = out.orderBy("seq").collect()
    assert tuple(one.price_range) == (0.0, 9.0) and one.deal_type == "other" and one.confidence == 0.82
    assert tuple(two.price_range) == (8.0, 12.0) and one.validation_issues == ["a", "b"]
