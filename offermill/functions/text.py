"""String expressions: trimming, cleaning, slugs, first-line merchants, offer types."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------------
# Offer-type keywords, first match wins.
OFFER_TYPE_PATTERNS = [
    (r"\bhappy[\s\-]?hour\b", "happy_hour"),
    (r"\blunch\s+(?:special|deal|menu|combo|offer)\b", "lunch_special"),
    (r"\bmidday\s+special\b", "lunch_special"),
    (r"\bearly[\s\-]?bird\b", "early_bird"),
    (r"\bprix[\s\-]fixe\b|\btasting\s+menu\b", "prix_fixe"),
    (r"\bdinner\s+special\b", "dinner_special"),
]
OFFER_TYPES = ["happy_hour", "lunch_special", "early_bird", "prix_fixe", "dinner_special", "other"]
# Punctuation replaced one for one; the em dash becomes " - ".
PUNCTUATION_FROM = "–‘’“”\u00a0«»"
PUNCTUATION_TO = "-''\"\" \"\""
EM_DASH = "—"
TAG = "<[^>]+>"
# Asterisk footnotes at either end of a line or glued to the front of a word.
FOOTNOTE = r"(?mdU)(?:^\s*\*+\s*|\s*\*+\s*$|\s+\*\S+)"
# Leading "1. Name - suffix" heading of a list article.
NUMBERED_HEADING = r"(?dU)^\d+\.\s*(.+?)(?:\s*[—\-]\s*.+)?$"
# Category keywords of the ingest path; plain substrings of the lower-cased text.
HAPPY_HOUR_WORDS = ["happy hour", "cocktail", "draft", "beer", "wine", "bar", "drinks"]
LUNCH_WORDS = ["lunch", "midday", "noon", "afternoon", "set menu", "prix fixe"]
# City aliases: slug -> (name, state, country).
CITY_ALIASES = {
    "nyc": ("New York", "NY", "US"),
    "new-york": ("New York", "NY", "US"),
    "sf": ("San Francisco", "CA", "US"),
    "san-francisco": ("San Francisco", "CA", "US"),
    "austin": ("Austin", "TX", "US"),
    "la": ("Los Angeles", "CA", "US"),
    "los-angeles": ("Los Angeles", "CA", "US"),
    "chicago": ("Chicago", "IL", "US"),
    "boston": ("Boston", "MA", "US"),
    "seattle": ("Seattle", "WA", "US"),
}
# ----------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Nested CASE chains repeat their inputs, and Spark does not share what sits in branches;
    a one-element array bound by ``transform`` keeps every regex to one pass.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def blank_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def has(c: Column, pattern: str) -> Column:
    """Case-insensitive regex search with Unicode classes; NULL text never matches."""
    return F.coalesce(c.rlike("(?iU)" + pattern), F.lit(False))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or NULL where nothing (or nothing inside it) matched."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def match_groups(c: Column, pattern: str, groups: int, inner: str | None = None) -> Column:
    """All groups of the first match as an array ('' for an unused group), NULL without a match.

    The text is searched once; the groups are then read from the matched piece.  ``inner``
    is the pattern without conditions on what surrounds the piece.
    """
    flags, body = re.match(r"(\(\?\w+\))?(.*)", inner or pattern, re.DOTALL).groups()
    row = "\u0001".join(f"${g}" for g in range(1, groups + 1))
    piece = F.regexp_substr(c, F.lit(pattern))
    return F.split(F.regexp_replace(piece, f"{flags or ''}^(?:{body})$", row), "\u0001")


def contains_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | c.contains(word)
    return found


def _decode_one(t: str) -> str:
    return unicodedata.normalize("NFC", re.sub(TAG, " ", html.unescape(t)))


@F.pandas_udf(StringType())
def _decode(s: pd.Series) -> pd.Series:
    return s.map(_decode_one, na_action="ignore")


@F.pandas_udf(StringType())
def _nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def _non_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def nfd(c: Column) -> Column:
    """Python sees only the rows that Spark's own functions cannot handle."""
    return F.coalesce(_nfd(F.when(_non_ascii(c), c)), c)


def clean_text(c: Column) -> Column:
    """Decode entities, drop tags, normalise punctuation, drop footnotes, collapse space.

    Entities and Unicode composition have no Spark function; only rows with '&' or beyond
    ASCII go to Python for them.
    """
    t = F.coalesce(_decode(F.when(c.contains("&") | _non_ascii(c), c)), F.regexp_replace(c, TAG, " "))
    t = F.translate(F.replace(t, F.lit(EM_DASH), F.lit(" - ")), PUNCTUATION_FROM, PUNCTUATION_TO)
    t = F.regexp_replace(t, FOOTNOTE, " ")
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return blank_to_null(strip(t))


def slug(c: Column) -> Column:
    """ASCII slug; '' for a missing name."""
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.coalesce(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(""))


def title_slug(c: Column) -> Column:
    return slug(c)


def clean_title(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)^\d+[.)]\s*", "")
    return strip(F.translate(t, "–—’é", "--'e"))


def block_merchant(block: Column) -> Column:
    """Venue name guessed from the first line of a text block."""

    def name(line: Column) -> Column:
        bare = F.when(F.length(line).between(6, 79) & ~line.rlike(r"(?U)^\d"), line)
        numbered = strip(F.regexp_extract(line, NUMBERED_HEADING, 1))
        return let(numbered, lambda n: F.when(F.length(n).between(4, 79), n).otherwise(bare))

    return let(strip(F.split_part(strip(block), F.lit("\n"), F.lit(1))), name)


def offer_type(text: Column) -> Column:
    chain = F
    for pattern, label in OFFER_TYPE_PATTERNS:
        chain = chain.when(has(text, pattern), label)
    return chain.otherwise("other")


def classify_offer_type(existing: Column | None, title: Column, description: Column) -> Column:
    """Keep a valid type, else infer it from title and description."""
    inferred = offer_type(F.concat_ws(" ", title, F.coalesce(description, F.lit(""))))
    if existing is None:
        return inferred
    return F.when(existing.isin(OFFER_TYPES), existing).otherwise(inferred)


def ingest_category(title: Column, description: Column) -> Column:
    text = F.lower(F.concat(title, F.lit(" "), F.coalesce(description, F.lit(""))))
    return (
        F.when(contains_any(text, HAPPY_HOUR_WORDS), "Happy Hour")
        .when(contains_any(text, LUNCH_WORDS), "Lunch Special")
        .otherwise("Happy Hour")
    )


def city_slug(c: Column) -> Column:
    return F.replace(F.replace(F.trim(F.lower(c)), F.lit(" "), F.lit("-")), F.lit(","), F.lit(""))


def place_slug(name: Column, state: Column | None = None) -> Column:
    base = F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("-")), F.lit(","), F.lit(""))
    if state is None:
        return base
    return F.when(F.coalesce(state, F.lit("")) != "", F.concat(base, F.lit("-"), F.lower(state))).otherwise(base)


def city_info(slug_col: Column) -> Column:
    """struct(name, state, country) of a city slug; unknown slugs are title-cased."""
    entries = []
    for key, (name, state, country) in CITY_ALIASES.items():
        entries += [F.lit(key), F.struct(F.lit(name).alias("name"), F.lit(state).alias("state"), F.lit(country).alias("country"))]
    unknown = F.struct(
        F.initcap(F.replace(slug_col, F.lit("-"), F.lit(" "))).alias("name"),
        F.lit(None).cast("string").alias("state"),
        F.lit("US").alias("country"),
    )
    return F.coalesce(F.try_element_at(F.create_map(*entries), slug_col), unknown)


def venue_slug(name: Column, city: Column) -> Column:
    base = F.lower(name)
    for old, new in ((" ", "-"), ("'", ""), ("&", "and")):
        base = F.replace(base, F.lit(old), F.lit(new))
    return F.concat(base, F.lit("-"), F.replace(F.lower(city), F.lit(" "), F.lit("-")))
