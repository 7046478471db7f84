"""Text blocks -> offer candidates (rules, extractor replies, validation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import price, schedule, scores
from ..functions.hashing import strip_fences
from ..functions.text import OFFER_TYPES, has, let, offer_type, strip
from ..schemas import EXTRACTOR_REPLY

# --- fixed values -----------------------------------------------------------------
ITEM_TRIGGER = r"(?iU)(?:including|includes?|featuring|features?|such\s+as|with)\s*:?\s*"
ITEM_STOP = r"\b(?:not valid|restriction|dine.in|must be|limit|21\+)\b"
ITEM_SEPARATOR = r"(?U),\s*|\s+and\s+|\s*&\s*|\s*\+\s*"
LEADING_CONJUNCTION = r"(?iU)^(?:and|or|&)\s+"
COLON_LIST = r"(?U):\s*([^\n.!?]+)"
SENTENCE_END = r"[.!?]|\n"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BULLET = r"^[-*•·] "
RESTRICTIONS = [
    (r"dine[\s\-]?in\s+only", "dine-in only"),
    (r"no\s+(?:takeout|to[\s\-]go|delivery)", "no takeout"),
    (r"no\s+substitution", "no substitutions"),
    (r"must\s+be\s+21|21\s*\+|ages?\s+21|over\s+21", "21+"),
    (r"reservations?\s+required", "reservations required"),
    (r"no\s+reservations?", "no reservations"),
    (r"not\s+valid\s+with\s+other\s+offer", "not valid with other offers"),
    (r"(?:bar|lounge)\s+only", "bar only"),
    (r"limit\s+\d+\s+per\s+(?:table|person|guest)", None),
    (r"not\s+available\s+on\s+holidays?", "not available on holidays"),
    (r"while\s+supplies?\s+last", "while supplies last"),
    (r"per\s+person", "per person"),
]
VALID_DAYS = ["daily", "friday", "monday", "saturday", "sunday", "thursday", "tuesday", "wednesday", "weekdays", "weekends"]
RANGE_FORMAT = r"^\$[0-9.]+\-\$[0-9.]+$"
# ----------------------------------------------------------------------------------

CANDIDATE = [
    "deal_type", "price", "price_range", "items_included", "schedule_days",
    "start_time", "end_time", "restrictions", "confidence",
]


def _split_items(chunk: Column) -> Column:
    parts = F.transform(
        F.split(strip(chunk), ITEM_SEPARATOR),
        lambda p: F.regexp_replace(strip(F.regexp_replace(strip(p), r"^\.+|\.+$", "")), LEADING_CONJUNCTION, ""),
    )
    return F.filter(parts, lambda p: F.length(p) >= 3)


def _first_of_each(items: Column) -> Column:
    """Distinct ignoring case, the first spelling kept."""

    def unseen(a: Column) -> Column:
        return let(
            F.transform(a, F.lower), lambda low: F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
        )

    return let(items, unseen)


def extract_items(text: Column) -> Column:
    """All items: after a trigger word, else from a colon list, plus bullet lines."""
    none = F.array().cast("array<string>")
    rest = F.get(F.split(text, ITEM_TRIGGER, 2), F.lit(1))
    rest = F.get(F.split(rest, "(?iU)" + ITEM_STOP, 2), F.lit(0))
    triggered = F.coalesce(_split_items(F.get(F.split(rest, SENTENCE_END, 2), F.lit(0))), none)
    chunks = F.filter(
        F.regexp_extract_all(text, F.lit(COLON_LIST), F.lit(1)),
        lambda c: ~has(c, ITEM_STOP),
    )
    listed = F.get(F.filter(F.transform(chunks, _split_items), lambda a: F.size(a) > 0), F.lit(0))
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda s: s.rlike(BULLET))
    bullets = F.flatten(F.transform(lines, lambda s: _split_items(F.substr(s, F.lit(3)))))
    named = let(triggered, lambda a: F.when(F.size(a) > 0, a).otherwise(F.coalesce(listed, none)))
    return _first_of_each(F.concat(named, bullets))


def extract_restrictions(text: Column) -> Column:
    labels = []
    for pattern, label in RESTRICTIONS:
        if label is None:
            labels.append(F.lower(strip(F.regexp_substr(text, F.lit("(?iU)" + pattern)))))
        else:
            labels.append(F.when(has(text, pattern), F.lit(label)))
    return F.array_distinct(F.array_compact(F.array(*labels)))


def rule_fields(df: DataFrame, text: str) -> DataFrame:
    """All rule-extracted columns of a text column, under the candidate names."""
    t = F.col(text)
    staged = df.select(
        "*",
        offer_type(t).alias("deal_type"),
        schedule.detect_days(t).alias("schedule_days"),
        schedule.parse_time_range(t).alias("_window"),
        price.rule_price(t).alias("_price"),
        extract_items(t).alias("items_included"),
        extract_restrictions(t).alias("restrictions"),
    )
    flat = staged.withColumns(
        {
            "start_time": F.col("_window.start_time"),
            "end_time": F.col("_window.end_time"),
            "price": F.col("_price.price"),
            "price_range": F.col("_price.price_range"),
        }
    ).drop("_window", "_price")
    found = {
        "type": F.col("deal_type") != "other",
        "days": F.size("schedule_days") > 0,
        "time": F.col("start_time").isNotNull() | F.col("end_time").isNotNull(),
        "price": F.col("price").isNotNull() | F.col("price_range").isNotNull(),
        "items": F.size("items_included") > 0,
    }
    return flat.withColumn("confidence", scores.rule_confidence(found))


def _quoted_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def validation_errors() -> Column:
    """Error texts of a candidate row, in check order."""
    c = F.col
    bad_days = F.filter(c("schedule_days"), lambda d: ~d.isin(VALID_DAYS))
    checks = [
        F.when(
            ~F.coalesce(c("deal_type").isin(OFFER_TYPES), F.lit(False)),
            F.concat(F.lit("invalid deal_type '"), F.coalesce(c("deal_type"), F.lit("None")), F.lit(f"'; must be one of {_quoted_list(sorted(OFFER_TYPES))}")),
        ),
        F.when(c("price") < 0, F.concat(F.lit("price must be non-negative, got "), c("price").cast("string"))),
        F.when(
            ~c("price_range").rlike(RANGE_FORMAT),
            F.concat(F.lit("price_range '"), c("price_range"), F.lit("' must match '$N-$M' (e.g. '$8-$12')")),
        ),
        F.when(
            c("price").isNotNull() & c("price_range").isNotNull(),
            F.lit("price and price_range are mutually exclusive; set only one"),
        ),
        F.when(
            F.size(bad_days) > 0,
            F.concat(F.lit("invalid schedule_days: ['"), F.array_join(bad_days, "', '"), F.lit(f"']; must be from {_quoted_list(VALID_DAYS)}")),
        ),
    ]
    for name in ("start_time", "end_time"):
        checks.append(
            F.when(~c(name).rlike(schedule.HH_MM), F.concat(F.lit(f"{name} '"), c(name), F.lit("' must be 'HH:MM' in 24-hour format")))
        )
    timed = c("start_time").rlike(schedule.HH_MM) & c("end_time").rlike(schedule.HH_MM)
    checks.append(
        F.when(
            timed & (c("start_time") >= c("end_time")),
            F.concat(F.lit("start_time "), c("start_time"), F.lit(" must be before end_time "), c("end_time")),
        )
    )
    checks.append(
        F.when(
            ~c("confidence").between(0.0, 1.0),
            F.concat(F.lit("confidence "), c("confidence").cast("string"), F.lit(" must be between 0.0 and 1.0")),
        )
    )
    return F.array_compact(F.array(*checks))


def parse_replies(replies: DataFrame) -> DataFrame:
    """Reply table (block_id, raw_text) -> (block_id, reply); unreadable replies give NULL."""
    clean = strip_fences(F.col("raw_text"))
    usable = F.try_parse_json(clean).isNotNull() & clean.startswith("{")
    return replies.select("block_id", F.when(usable, F.from_json(clean, EXTRACTOR_REPLY)).alias("reply"))


def extract_candidates(blocks: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Blocks (block_id, text, source_url, ...) -> validated candidates.

    A usable extractor reply replaces the rules for its block.  Every validation error
    takes 0.05 off the confidence.
    """
    ruled = rule_fields(blocks, "text").withColumn("extraction_method", F.lit("rule_based"))
    if replies is not None:
        joined = ruled.join(parse_replies(replies), "block_id", "left")
        r, used = F.col("reply"), F.col("reply").isNotNull()
        empty = F.array().cast("array<string>")
        given = {name: r[name] for name in CANDIDATE}
        given["deal_type"] = F.coalesce(r["deal_type"], F.lit("other"))
        given["confidence"] = F.coalesce(r["confidence"], F.lit(0.5))
        for name in ("items_included", "schedule_days", "restrictions"):
            given[name] = F.coalesce(r[name], empty)
        ruled = joined.withColumns(
            {n: F.when(used, v).otherwise(F.col(n)) for n, v in given.items()}
            | {"extraction_method": F.when(used, F.lit("llm")).otherwise(F.lit("rule_based"))}
        ).drop("reply")
    checked = ruled.withColumn("validation_errors", validation_errors())
    return checked.withColumn("confidence", scores.penalised(F.col("confidence"), F.col("validation_errors"))).withColumnRenamed(
        "text", "source_block_text"
    )
