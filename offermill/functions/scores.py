"""Confidence, completeness and ranking arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
BASE_CONFIDENCE = {"llm": 0.80, "rule_based": 0.65, "raw": 0.50}
CONFIDENCE_PARTS = {"price": 0.10, "schedule": 0.10, "time_window": 0.08, "items": 0.05}
ISSUE_PENALTY = 0.08
RULE_BASE = 0.3
RULE_PARTS = {"type": 0.20, "days": 0.15, "time": 0.15, "price": 0.10, "items": 0.10}
ERROR_PENALTY = 0.05
QUALITY_PARTS = {
    "title": 0.15, "description": 0.08, "merchant": 0.10, "type": 0.12, "price": 0.18,
    "original_price": 0.07, "days": 0.15, "both_times": 0.10, "one_time": 0.05, "items": 0.05,
}
STORED_WEIGHTS = {"discount": 0.40, "freshness": 0.35, "quality": 0.25}
STORED_DECAY_HOURS = 48.0
CATEGORY_BOOST = 0.10
# ----------------------------------------------------------------------------------


def points(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def total(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def clamp(c: Column, digits: int) -> Column:
    return F.when(c.isNotNull(), F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), digits))


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def rule_confidence(has: dict[str, Column]) -> Column:
    return F.round(F.least(total([F.lit(RULE_BASE)] + [points(has[k], v) for k, v in RULE_PARTS.items()]), F.lit(1.0)), 2)


def penalised(confidence: Column, errors: Column) -> Column:
    return F.round(F.greatest(confidence - F.size(errors) * ERROR_PENALTY, F.lit(0.0)), 2)


def normalized_confidence(method: Column, existing: Column | None, has: dict[str, Column], issues: Column) -> Column:
    base = F.lit(BASE_CONFIDENCE["raw"])
    for name, value in BASE_CONFIDENCE.items():
        base = F.when(method == name, value).otherwise(base)
    if existing is not None:
        base = F.greatest(base, existing * base)
    earned = total([base] + [points(has[k], v) for k, v in CONFIDENCE_PARTS.items()])
    return clamp(earned - F.size(issues) * ISSUE_PENALTY, 3)


def completeness(*, title, description, merchant, offer_type, priced, original_price, days, start, end, items) -> Column:
    """Share of useful fields that are present."""
    q = QUALITY_PARTS
    parts = [
        points(F.coalesce(F.length(title), F.lit(0)) > 8, q["title"]),
        points(filled(description), q["description"]),
        points(filled(merchant), q["merchant"]),
        points(offer_type != "other", q["type"]),
        points(priced, q["price"]),
        points(original_price.isNotNull(), q["original_price"]),
        points(F.size(days) > 0, q["days"]),
        F.when(filled(start) & filled(end), q["both_times"]).when(filled(start) | filled(end), q["one_time"]).otherwise(0.0),
        points(items, q["items"]),
    ]
    return F.round(F.least(total(parts), F.lit(1.0)), 3)


def stored_rank(discount: Column, age_hours: Column, quality: Column, boosted: Column | None = None) -> Column:
    """The rank kept on the deal row.  A future fetch time is not clamped."""
    w = STORED_WEIGHTS
    score = (
        w["discount"] * F.least(F.coalesce(discount, F.lit(0.0)) / 100, F.lit(1.0))
        + w["freshness"] * F.exp(-age_hours / STORED_DECAY_HOURS)
        + w["quality"] * F.coalesce(quality, F.lit(0.5))
    )
    if boosted is not None:
        score = F.when(boosted, F.least(score + CATEGORY_BOOST, F.lit(1.0))).otherwise(score)
    return F.round(score, 4)


@dataclass(frozen=True)
class RankingConfig:
    """Weights and decays of the query-time rank; they become literals in the plan."""

    deal_value: float = 0.25
    open_now: float = 0.20
    freshness: float = 0.15
    distance: float = 0.20
    confidence: float = 0.10
    venue_popularity: float = 0.05
    preference_boost: float = 0.05
    freshness_decay_hours: float = 48.0
    distance_decay_miles: float = 2.0


FEATURES = ["deal_value", "open_now", "freshness", "distance", "confidence", "venue_popularity", "preference_boost"]
