"""Raw listings and candidates -> normalized offers; the ingest-field normalizer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, price, schedule, scores, text
from ..schemas import INGEST_REPLY


@dataclass(frozen=True)
class Provenance:
    """Constants of one batch."""

    source: str
    last_seen: str
    ingest_run_id: str | None = None


NORMALIZED = [
    "deal_id", "source_deal_id", "title", "description", "deal_type", "merchant", "currency", "price",
    "price_range", "original_price", "discount_pct", "days", "start_time", "end_time", "items_included",
    "restrictions", "source", "source_url", "last_seen", "ingest_run_id", "confidence", "quality_score",
    "validation_issues", "dedup_key", "seq",
]
_STRINGS = "array<string>"


def dedup_key(slug: Column, offer_type: Column, days: Column, start: Column, end: Column) -> Column:
    digits = F.array_join(F.transform(F.array_sort(days), lambda d: d.cast("string")), "")
    return F.concat_ws("|", slug, offer_type, digits, F.coalesce(start, F.lit("")), F.coalesce(end, F.lit("")))


def _finish(df: DataFrame, provenance: Provenance, *, method: Column, existing: Column | None) -> DataFrame:
    """Scores, ids and keys, which both input kinds share."""
    c = F.col
    priced = c("price").isNotNull() | c("price_range").isNotNull()
    has_items = F.size("items_included") > 0
    found = {
        "price": priced,
        "schedule": F.size("days") > 0,
        "time_window": scores.filled(c("start_time")) | scores.filled(c("end_time")),
        "items": has_items,
    }
    source = F.lit(provenance.source)
    return df.withColumns(
        {
            "discount_pct": price.discount_pct(c("original_price"), c("price"), allow_free=True),
            "confidence": scores.normalized_confidence(method, existing, found, c("validation_issues")),
            "quality_score": scores.completeness(
                title=c("title"), description=c("description"), merchant=c("merchant"), offer_type=c("deal_type"),
                priced=priced, original_price=c("original_price"), days=c("days"), start=c("start_time"),
                end=c("end_time"), items=has_items,
            ),
            "deal_id": hashing.listing_id(source, c("source_deal_id")),
            "dedup_key": dedup_key(text.slug(c("merchant")), c("deal_type"), c("days"), c("start_time"), c("end_time")),
            "source": source,
            "last_seen": F.lit(provenance.last_seen).cast("timestamp"),
            "ingest_run_id": F.lit(provenance.ingest_run_id).cast("string"),
        }
    ).select(*NORMALIZED)


def normalize_raw(listings: DataFrame, provenance: Provenance) -> DataFrame:
    """Listings of a feed: everything but ids and prices is read from title and description."""
    c = F.col
    cleaned = listings.select(
        "seq", "source_deal_id", "original_price", "deal_price",
        c("url").alias("source_url"),
        F.coalesce(text.clean_text(c("title")), c("title")).alias("title"),
        text.clean_text(c("description")).alias("description"),
        text.clean_text(c("merchant")).alias("merchant"),
    ).withColumn("_text", F.concat_ws(" ", c("title"), F.coalesce("description", F.lit(""))))
    parsed = cleaned.select(
        "*",
        text.classify_offer_type(None, c("title"), c("description")).alias("deal_type"),
        price.parse_price(c("_text"), c("deal_price")).alias("_price"),
        price.currency(c("_text")).alias("currency"),
        schedule.expand_days(schedule.detect_days(c("_text"))).alias("days"),
        schedule.parse_time_range(c("_text")).alias("_window"),
    )
    ready = parsed.withColumns(
        {
            "price": c("_price.price"),
            "price_range": c("_price.price_range"),
            "start_time": schedule.canonical_time(c("_window.start_time")),
            "end_time": schedule.canonical_time(c("_window.end_time")),
            "items_included": F.array().cast(_STRINGS),
            "restrictions": F.array().cast(_STRINGS),
            "validation_issues": F.array().cast(_STRINGS),
        }
    )
    return _finish(ready, provenance, method=F.lit("raw"), existing=None)


def normalize_candidates(candidates: DataFrame, provenance: Provenance) -> DataFrame:
    """Candidates of scraped blocks: first line is the title, the rest the description."""
    c = F.col
    block = c("source_block_text")
    lines = F.filter(F.transform(F.split(c("_clean"), "\n"), text.strip), lambda s: s != "")
    staged = (
        candidates.withColumn("_clean", text.clean_text(block))
        .withColumn("_lines", lines)
        .withColumn("title", F.coalesce(F.get("_lines", F.lit(0)), F.lit("(no title)")))
        .withColumn("description", text.blank_to_null(F.array_join(F.slice("_lines", F.lit(2), F.size("_lines")), "\n")))
        .withColumn("_given", price.parse_range_text(c("price_range")))
        .withColumn("_parsed", price.parse_price(block))
    )
    unpriced = c("price").isNull() & c("_given").isNull()
    ready = staged.withColumns(
        {
            "merchant": text.block_merchant(block),
            "deal_type": text.classify_offer_type(c("deal_type"), c("title"), c("description")),
            "price": F.when(unpriced, c("_parsed.price")).otherwise(c("price")),
            "price_range": F.when(unpriced, c("_parsed.price_range")).otherwise(c("_given")),
            "currency": price.currency(block),
            "original_price": F.lit(None).cast("double"),
            "days": schedule.expand_days(c("schedule_days")),
            "start_time": schedule.canonical_time(c("start_time")),
            "end_time": schedule.canonical_time(c("end_time")),
            "validation_issues": c("validation_errors"),
            "source_deal_id": hashing.content_id(block),
        }
    )
    return _finish(ready, provenance, method=c("extraction_method"), existing=c("confidence"))


def deduplicate(normalized: DataFrame) -> DataFrame:
    """One offer per key: highest confidence, then latest seen, then first in the input.

    ``first_seq`` orders the result by the first occurrence of each key.
    """
    c = F.col
    better = F.struct(c("confidence"), c("last_seen"), -c("seq"))
    rest = [n for n in normalized.columns if n != "dedup_key"]
    return (
        normalized.groupBy("dedup_key")
        .agg(F.max_by(F.struct(*rest), better).alias("_best"), F.min("seq").alias("first_seq"))
        .select("dedup_key", "_best.*", "first_seq")
        .select(*normalized.columns, "first_seq")
    )


def normalize_listings(
    provenance: Provenance, raw: DataFrame | None = None, candidates: DataFrame | None = None, *, dedup: bool = True
) -> DataFrame:
    """Both input kinds in one normalized table; ``seq`` is the order of arrival."""
    parts = []
    if raw is not None:
        parts.append(normalize_raw(raw, provenance))
    if candidates is not None:
        parts.append(normalize_candidates(candidates, provenance))
    if not parts:
        raise TypeError("give listings, candidates, or both")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return deduplicate(out) if dedup else out


def to_json_rows(normalized: DataFrame) -> DataFrame:
    """One JSON document per offer; the range is a two-element list."""
    fields = [
        F.when(F.col("price_range").isNotNull(), F.array("price_range.lo", "price_range.hi")).alias("price_range")
        if n == "price_range"
        else F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias(n)
        if n == "last_seen"
        else F.col(n)
        for n in NORMALIZED
        if n != "seq"
    ]
    return normalized.select("deal_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


# --- ingest fields ----------------------------------------------------------------


def ingest_fields(listings: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Category, prices, quality and discount of raw listings.

    ``replies`` (source_deal_id, raw_response, model, prompt_tokens, completion_tokens)
    hold answers of an external extractor; listings without a readable one use the rules.
    Adds columns prefixed ``n_``, and ``fallback_used``.
    """
    c = F.col
    amounts = price.dollar_amounts(F.concat(c("title"), F.lit(" "), F.coalesce("description", F.lit(""))))
    staged = listings.withColumn("_amounts", amounts)
    deal = F.coalesce(price.truthy(c("deal_price")), F.array_min("_amounts"))
    original = F.coalesce(price.truthy(c("original_price")), F.when(F.size("_amounts") > 1, F.array_max("_amounts")))
    ruled = staged.withColumns({"_deal": deal, "_original": original}).withColumns(
        {
            "n_category": text.ingest_category(c("title"), c("description")),
            "n_tags": F.array().cast(_STRINGS),
            "n_merchant": c("merchant"),
            "n_deal_price": c("_deal"),
            "n_original_price": c("_original"),
            "n_expires_at": c("expires_at"),
            "n_quality_score": F.round(
                scores.total(
                    [
                        F.lit(0.4),
                        scores.points(c("_deal") != 0, 0.2),
                        scores.points(c("_original") != 0, 0.2),
                        scores.points(scores.filled(c("description")), 0.1),
                        scores.points(scores.filled(c("merchant")), 0.1),
                    ]
                ),
                2,
            ),
            "fallback_used": F.lit(True),
        }
    )
    log = ("model", "prompt_tokens", "completion_tokens", "raw_response")
    if replies is None:
        ruled = ruled.withColumns({n: F.lit(None).cast("long" if "tokens" in n else "string") for n in log})
    else:
        clean = hashing.strip_fences(c("raw_response"))
        usable = F.try_parse_json(clean).isNotNull() & clean.startswith("{")
        answers = replies.select("source_deal_id", *log, F.when(usable, F.from_json(clean, INGEST_REPLY)).alias("_r")).filter(c("_r").isNotNull())
        ruled = ruled.join(answers, "source_deal_id", "left")
        r, used = c("_r"), c("_r").isNotNull()
        # The wall clock of the reply is taken as UTC, whatever offset it names.
        wall = F.regexp_replace(r["expires_at"], r"(Z|[+-]\d{2}:?\d{2})$", "")
        given = {
            "n_category": r["category"],
            "n_tags": F.coalesce(r["tags"], F.array().cast(_STRINGS)),
            "n_merchant": r["merchant"],
            "n_deal_price": F.coalesce(price.truthy(r["deal_price"]), price.truthy(c("deal_price")), r["deal_price"]),
            "n_original_price": F.coalesce(price.truthy(r["original_price"]), price.truthy(c("original_price")), r["original_price"]),
            "n_expires_at": F.try_to_timestamp(wall),
            "n_quality_score": r["quality_score"],
        }
        ruled = ruled.withColumns(
            {n: F.when(used, v).otherwise(c(n)) for n, v in given.items()} | {"fallback_used": ~used}
        ).drop("_r")
    return ruled.withColumn(
        "n_discount_pct", price.discount_pct(c("n_original_price"), c("n_deal_price"), allow_free=False)
    ).drop("_amounts", "_deal", "_original")
