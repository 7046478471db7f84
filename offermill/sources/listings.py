"""Feed readers: each gives flat listings, the nested ones also venues.

``seq`` is the order of arrival inside one read: for JSON feeds the file and the position in it, whatever the
partitioning.  A JSON document that holds a whole feed is read by as many tasks as it has segments (``json_parts``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import price, schedule, text
from ..functions.text import blank_to_null, first_match
from ..schemas import FLAT_JSON, FORUM_POST, OFFER_JSON, RSS_ITEM
from .json_parts import FILE_BITS, POSITION_BITS, elements, object_keys, sequence_number

# --- fixed values -----------------------------------------------------------------
BUSINESS_CATEGORIES = {
    "pizza": "restaurant", "burgers": "restaurant", "sandwiches": "restaurant", "delis": "restaurant",
    "newamerican": "restaurant", "californiacuisine": "restaurant", "chinese": "restaurant", "japanese": "restaurant",
    "sushi": "restaurant", "bbq": "restaurant", "italian": "restaurant", "breakfast_brunch": "restaurant",
    "coffee": "cafe", "bakeries": "bakery", "cocktailbars": "bar", "bars": "bar", "wine_bars": "bar", "breweries": "bar",
}
DEFAULT_CATEGORY = "restaurant"
PRICE_SYMBOLS = {1: "$", 2: "$$", 3: "$$$", 4: "$$$$"}
FORUM_HOST = "https://www.reddit.com"
# ----------------------------------------------------------------------------------

LISTING = [
    "source_deal_id", "title", "url", "description", "image_url", "merchant",
    "original_price", "deal_price", "expires_at", "raw_data",
]


def _listing(df: DataFrame, seq: Column, **columns: Column) -> DataFrame:
    """Listing columns in their order; those not given are NULL."""
    kinds = {"original_price": "double", "deal_price": "double", "expires_at": "timestamp"}
    return df.select(
        *[columns[n].cast(kinds.get(n, "string")).alias(n) if n in columns else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in LISTING],
        seq.alias("seq"),
    )


def wall_clock(iso: Column) -> Column:
    """ISO time with its offset dropped, read as UTC; NULL when malformed."""
    return F.try_to_timestamp(F.regexp_replace(iso, r"(Z|[+-]\d{2}:?\d{2})$", ""))


def read_flat_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of listing objects; a missing file gives no rows."""
    found = elements(spark, path, "$[*]").withColumn("d", F.from_json("element", FLAT_JSON.strip()))
    return _listing(
        found,
        sequence_number(),
        **{n: F.col(f"d.{n}") for n in LISTING if n not in ("expires_at", "raw_data")},
        expires_at=wall_clock(F.col("d.expires_at")),
        raw_data=F.coalesce("d.raw_data", F.lit("{}")),
    )


def _nested(spark: SparkSession, path: str, list_name: str, fields: str, city: str | None) -> DataFrame:
    """City documents -> one row per place.  Offers stay JSON text, so that an absent key and
    a NULL value can be told apart."""
    places = elements(spark, path, f"$.*.{list_name}[*]").select(
        "file_number", "position", F.col("captures")[0].alias("city_key"), F.from_json("element", f"struct<{fields.strip()}>").alias("p")
    )
    if city is None:
        return places
    return places.filter(F.col("city_key") == F.replace(F.lower(F.lit(city)), F.lit(" "), F.lit("-")))


def _offer(df: DataFrame, id_key: str, offers: str) -> DataFrame:
    """One row per offer of a place: its fields, its raw text and the keys it has."""
    kind = OFFER_JSON.format(id=id_key).strip()
    return df.select("*", F.posexplode(f"p.{offers}").alias("_at", "_raw")).select(
        "*", F.from_json("_raw", kind).alias("o"), F.json_object_keys("_raw").alias("_keys")
    )


def _meta(**extra: Column) -> Column:
    days = F.coalesce("o.valid_days", F.array().cast("array<string>"))
    return F.to_json(
        F.struct(
            *[v.alias(k) for k, v in extra.items()],
            days.alias("valid_days"),
            schedule.abbreviations_to_days(days).alias("valid_day_indices"),
            *[F.col(f"o.{n}").alias(n) for n in ("start_time", "end_time", "discount_pct")],
        )
    )


_BUSINESS = """
  id:string,name:string,image_url:string,is_closed:boolean,url:string,review_count:int,
  categories:array<struct<alias:string,title:string>>,rating:double,coordinates:struct<latitude:double,longitude:double>,
  price:string,location:struct<address1:string,city:string,state:string,country:string,zip_code:string>,
  phone:string,deals:array<string>"""


def read_business_json(spark: SparkSession, path: str, city: str | None = None, *, source: str = "businesses") -> tuple[DataFrame, DataFrame]:
    """Businesses with nested deals -> (venues, listings).  Closed businesses are dropped."""
    places = _nested(spark, path, "businesses", _BUSINESS, city).filter(~F.coalesce("p.is_closed", F.lit(False)))
    lookup = F.create_map(*[F.lit(x) for pair in BUSINESS_CATEGORIES.items() for x in pair])
    known = F.array_compact(F.transform("p.categories", lambda k: F.try_element_at(lookup, k["alias"])))
    c = F.col
    venues = places.select(
        c("p.id").alias("external_id"), c("p.name").alias("name"),
        F.coalesce("p.location.city", "city_key").alias("city"), c("p.location.address1").alias("address"),
        c("p.location.state").alias("state"), F.coalesce("p.location.country", F.lit("US")).alias("country"),
        c("p.coordinates.latitude").alias("lat"), c("p.coordinates.longitude").alias("lon"),
        F.coalesce(F.get(known, F.lit(0)), F.lit(DEFAULT_CATEGORY)).alias("category"), c("p.price").alias("price_range"),
        c("p.rating").alias("rating"), c("p.review_count").alias("review_count"), c("p.phone").alias("phone"),
        c("p.url").alias("website"), c("p.image_url").alias("image_url"), "city_key", sequence_number().alias("seq"),
    )
    offers = _offer(places, "deal_id", "deals")
    # The business URL stands in only where the deal has no url key at all.
    url = F.when(F.array_contains("_keys", "url"), c("o.url")).otherwise(F.coalesce("p.url", F.lit("")))
    listings = _listing(
        offers, sequence_number(c("_at")), source_deal_id=c("o.deal_id"), title=c("o.title"), url=url, description=c("o.description"), merchant=c("p.name"),
        original_price=c("o.original_price"), deal_price=c("o.deal_price"),
        raw_data=_meta(venue_external_id=c("p.id"), venue_name=c("p.name"), source=F.lit(source), raw_deal=c("_raw")),
    )
    return venues, listings


_RESTAURANT = """
  restaurant_id:string,name:string,cuisine:string,price_range:int,rating:double,review_count:int,
  address:struct<street:string,city:string,state:string,country:string,zip:string>,coordinates:struct<lat:double,lng:double>,
  phone:string,website:string,booking_url:string,image_url:string,promotions:array<string>"""


def read_restaurant_json(spark: SparkSession, path: str, city: str | None = None, *, source: str = "restaurants") -> tuple[DataFrame, DataFrame]:
    """Restaurants with nested promotions -> (venues, listings).

    A blank URL counts as missing: promotion, then booking page, then website.
    """
    places = _nested(spark, path, "restaurants", _RESTAURANT, city)
    symbols = F.create_map(*[F.lit(x) for pair in PRICE_SYMBOLS.items() for x in pair])
    c = F.col
    venues = places.select(
        c("p.restaurant_id").alias("external_id"), c("p.name").alias("name"),
        F.coalesce("p.address.city", "city_key").alias("city"), c("p.address.street").alias("address"),
        c("p.address.state").alias("state"), F.coalesce("p.address.country", F.lit("US")).alias("country"),
        c("p.coordinates.lat").alias("lat"), c("p.coordinates.lng").alias("lon"), F.lit(DEFAULT_CATEGORY).alias("category"),
        F.try_element_at(symbols, c("p.price_range")).alias("price_range"), c("p.rating").alias("rating"),
        c("p.review_count").alias("review_count"), c("p.phone").alias("phone"), c("p.website").alias("website"),
        c("p.image_url").alias("image_url"), "city_key", sequence_number().alias("seq"),
    )
    offers = _offer(places, "promo_id", "promotions")
    booking = F.coalesce(blank_to_null(c("p.booking_url")), c("p.website"), F.lit(""))
    listings = _listing(
        offers, sequence_number(c("_at")), source_deal_id=c("o.promo_id"), title=c("o.title"), url=F.coalesce(blank_to_null(c("o.url")), booking),
        description=c("o.description"), merchant=c("p.name"), original_price=c("o.original_price"), deal_price=c("o.deal_price"),
        raw_data=_meta(
            venue_external_id=c("p.restaurant_id"), venue_name=c("p.name"), booking_url=booking, source=F.lit(source), raw_promo=c("_raw")
        ),
    )
    return venues, listings


def available_cities(spark: SparkSession, *paths: str) -> DataFrame:
    """City keys of nested feeds, sorted."""
    docs = [object_keys(spark, p).select(F.col("key").alias("city")) for p in paths]
    return reduce(DataFrame.unionByName, docs).distinct().orderBy("city")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """RSS items.  The publication time stands in for the expiry, which feeds do not carry."""
    items = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    c = F.col
    trimmed = lambda n: text.strip(F.coalesce(n, F.lit("")))
    staged = items.select(
        F.coalesce(blank_to_null(c("id")), blank_to_null(c("guid")), c("link")).alias("source_deal_id"),
        trimmed(c("title")).alias("title"), trimmed(c("link")).alias("url"),
        trimmed(F.coalesce("description", "summary")).alias("summary"), "pubDate", "category",
    ).filter((F.coalesce("source_deal_id", F.lit("")) != "") & (c("title") != "") & (c("url") != ""))
    amount = lambda n: first_match(c(n), price.DOLLAR).cast("double")
    undated = F.regexp_replace("pubDate", r"^\s*[A-Za-z]{3},\s*", "")
    published = F.coalesce(*[F.try_to_timestamp(undated, F.lit(f"d MMM yyyy HH:mm:ss {zone}")) for zone in ("Z", "z")])
    out = _listing(
        staged, F.monotonically_increasing_id(), source_deal_id=c("source_deal_id"), title=c("title"), url=c("url"), description=blank_to_null(c("summary")),
        deal_price=F.coalesce(price.truthy(amount("title")), amount("summary")), expires_at=published,
        raw_data=F.to_json(F.struct(c("category").alias("tags"), F.coalesce("pubDate", F.lit("")).alias("published"))),
    )
    return out


def read_forum_json(spark: SparkSession, path: str) -> DataFrame:
    """Forum listings: stickied posts, self posts without a URL and blank titles are dropped."""
    posts = elements(spark, path, "$.data.children[*]").select(
        "file_number", "position", F.from_json("element", FORUM_POST.strip()).alias("d")
    ).select("file_number", "position", "d.data.*")
    c = F.col
    flag = lambda n: F.coalesce(n, F.lit(False))
    linked = F.coalesce("url", F.lit("")) != ""
    kept = (
        posts.filter(~flag("stickied") & ~(flag("is_self") & ~linked))
        .withColumn("title", text.strip(F.coalesce("title", F.lit(""))))
        .filter(c("title") != "")
        .withColumn("_price", price.price_pair(c("title")))
    )
    out = _listing(
        kept, sequence_number(), source_deal_id=F.coalesce("id", F.lit("")), title=c("title"),
        url=F.when(linked, c("url")).otherwise(F.concat(F.lit(FORUM_HOST), F.coalesce("permalink", F.lit("")))),
        description=blank_to_null(c("selftext")), original_price=c("_price.original_price"), deal_price=c("_price.deal_price"),
        raw_data=F.to_json(
            F.struct(
                F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
                F.coalesce("link_flair_text", F.lit("")).alias("flair"), F.coalesce("created_utc", F.lit(0.0)).alias("created_utc"),
            )
        ),
    )
    return out


def union_sources(named: dict[str, DataFrame]) -> DataFrame:
    """Listings of several feeds with a ``source`` column; ``seq`` goes by feed, then by arrival in it."""
    placed = [
        df.withColumns({"source": F.lit(name), "seq": F.lit(feed << POSITION_BITS + FILE_BITS) + F.col("seq")})
        for feed, (name, df) in enumerate(named.items())
    ]
    return reduce(DataFrame.unionByName, placed)
