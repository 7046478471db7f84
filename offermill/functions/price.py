"""Price expressions over free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match, has, let, match_groups, strip

# --- fixed values -----------------------------------------------------------------
CURRENCIES = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY")]
AMOUNT = r"([0-9]{1,6}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?)"
FREE = r"\b(?:free|complimentary|on\s+the\s+house|no\s+charge|gratis)\b"
UNDER = (
    r"(?iU)\b(?:under|less\s+than|up\s+to|below|max\.?|no\s+more\s+than)\s*"
    r"[$€£¥]?\s*" + AMOUNT + r"\s*(?:dollars?|bucks?|usd|eur|gbp)?"
)
RANGE_JOIN = r"\s*(?:[–\-]|to|through)\s*"
CURRENCY_RANGE = r"(?iU)[$€£¥]\s*" + AMOUNT + RANGE_JOIN + r"[$€£¥]?\s*" + AMOUNT
NOT_A_TIME = r"(?!\s*(?:am|pm|:[0-9]{2}))"
WORD_RANGE = r"(?iU)" + AMOUNT + RANGE_JOIN + AMOUNT + r"\s+(?:dollars?|bucks?)\b"
CURRENCY_SINGLE = r"(?U)[$€£¥]\s*" + AMOUNT
NOT_A_DATE = r"(?!\s*(?:[0-9]|am|pm|:[0-9]{2}))"
WORD_SINGLE = r"(?iU)\b" + AMOUNT + r"\s+(?:dollars?|bucks?)\b"
RANGE_TEXT = r"(?U)^\$([0-9]+(?:\.[0-9]+)?)\s*\-\s*\$([0-9]+(?:\.[0-9]+)?)$"
DOLLAR = r"\$([0-9]+(?:\.[0-9]{1,2})?)"
DOLLAR_RANGE = r"(?U)\$([0-9]+(?:\.[0-9]{1,2})?)\s*(?:–|-|to)\s*\$([0-9]+(?:\.[0-9]{1,2})?)"
WAS_DOLLAR = r"(?iU)was\s+\$([0-9]+(?:\.[0-9]{1,2})?)"
# ----------------------------------------------------------------------------------


def number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).cast("double")


def currency(text: Column) -> Column:
    chain = F
    for symbol, code in CURRENCIES:
        chain = chain.when(text.contains(symbol), code)
    return chain.otherwise("USD")


def ordered_range(a: Column, b: Column) -> Column:
    """struct(lo, hi), NULL when a bound is missing."""
    pair = F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    return F.when(a.isNotNull() & b.isNotNull(), pair)


def _range(text: Column, pattern: str, after: str = "") -> Column:
    found = match_groups(text, pattern + after, 2, pattern)
    return let(found, lambda g: ordered_range(number(F.get(g, F.lit(0))), number(F.get(g, F.lit(1)))))


def parse_price(text: Column, existing: Column | None = None) -> Column:
    """struct(price, price_range) of free text.

    First signal wins: free, upper bound, currency range, word range, one currency
    amount, one word amount, then the price the feed supplied.
    """
    pair = "struct<lo:double,hi:double>"

    def one(price: Column) -> Column:
        return F.struct(price.alias("price"), F.lit(None).cast(pair).alias("price_range"))

    def between(bounds: Column) -> Column:
        return F.struct(F.lit(None).cast("double").alias("price"), bounds.alias("price_range"))

    upper = let(number(first_match(text, UNDER)), lambda u: F.when(u.isNotNull(), F.struct(F.lit(0.0).alias("lo"), u.alias("hi"))))
    fallback = F.lit(None).cast("double") if existing is None else existing
    single = F.coalesce(
        number(first_match(text, CURRENCY_SINGLE + NOT_A_DATE)), number(first_match(text, WORD_SINGLE)), fallback
    )
    bounds = F.coalesce(upper.cast(pair), _range(text, CURRENCY_RANGE, NOT_A_TIME).cast(pair), _range(text, WORD_RANGE).cast(pair))
    priced = let(bounds, lambda b: F.when(b.isNotNull(), between(b)).otherwise(one(single)))
    return F.when(has(text, FREE), one(F.lit(0.0))).otherwise(priced)


def parse_range_text(c: Column) -> Column:
    """'$8-$12' -> struct(8.0, 12.0)."""
    return _range(strip(c), RANGE_TEXT)


def _amount_text(x: Column) -> Column:
    """8.0 -> '8', 8.50 -> '8.5'."""
    exact = x.try_cast("decimal(38,2)").cast("string")
    return F.coalesce(F.regexp_replace(exact, r"\.?0+$", ""), x.cast("string"))


def rule_price(text: Column) -> Column:
    """struct(price, price_range) of the rule extractor; the range is text."""

    def result(bounds: Column) -> Column:
        label = F.concat(F.lit("$"), _amount_text(bounds["lo"]), F.lit("-$"), _amount_text(bounds["hi"]))
        single = F.when(bounds.isNull(), first_match(text, DOLLAR).cast("double"))
        return F.struct(single.alias("price"), label.alias("price_range"))

    return let(_range(text, DOLLAR_RANGE), result)


def dollar_amounts(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(DOLLAR), F.lit(1)), lambda s: s.cast("double"))


def price_pair(title: Column) -> Column:
    """struct(original_price, deal_price) of '$799 (was $1299)'; else by position."""
    was = first_match(title, WAS_DOLLAR).cast("double")

    def pair(x: Column) -> Column:
        second = F.get(x["amounts"], F.lit(1))
        return F.struct(
            F.coalesce(F.when(x["was"] != 0, x["was"]), second, x["was"]).alias("original_price"),
            F.get(x["amounts"], F.lit(0)).alias("deal_price"),
        )

    return let(F.struct(dollar_amounts(title).alias("amounts"), was.alias("was")), pair)


def truthy(c: Column) -> Column:
    """The number, or NULL when it is zero."""
    return F.when(c != 0, c)


def discount_pct(original: Column, deal: Column, *, allow_free: bool) -> Column:
    """Percent off; a price of zero counts as 100 % off only with ``allow_free``."""
    usable = (original > 0) & (deal < original)
    if not allow_free:
        usable = usable & (deal != 0)
    return F.when(usable, F.round((original - deal) / original * 100, 2))
