"""Domain tables derived from the star-schema test tables.

Each view is one SQL text that both Spark and DuckDB accept, so a query and its oracle
start from the same rows.  ``{orders}`` and the like name the base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "2001-08-01 12:00:00"

TEMPLATES = [
    ("Happy Hour at Blue Smoke", "Mon-Fri 5-7pm. $6 draft beer."),
    ("Lunch Special", "Weekdays 11am-3pm. Under $15."),
    ("Early bird dinner", "Daily 5-6:30pm. $29 prix-fixe including soup, salad and entree."),
    ("Tasting menu", "Tuesday through Thursday after 6. $45-$60 per person."),
    ("Weekend brunch", "Sat and Sun 10am to 2pm. 14 to 18 dollars."),
    ("Midday special", "Noon to 3pm, Mon, Wed & Fri. 8 bucks."),
    ("Free tacos", "Complimentary tacos until 7pm every day."),
    ("Prix fixe night", "Thu-Mon 5:30 p.m. - 9 p.m. only, no substitutions."),
    ("Dinner special", "Fridays by 8pm. $1,250 for 20 guests, reservations required."),
    ("Late happy hour", "10pm-midnight daily, $4 wells, dine-in only."),
    ("Bar bites", "up to 50% off wings with sauce, fries and beer. 21+"),
    ("Two for one", "Monday and tuesday only $12 (was $24)."),
    ("Chef combo", "combo: soup, sandwich & drink. limit 2 per table."),
    ("Wine evening", "All week after 5pm, less than 20 dollars a glass."),
    ("Plain listing", None),
    ("Lunch menu", "Wednesdays, not valid with other offers. 9 dollars while supplies last."),
]


def _case(key: str, values: list) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


TITLE = _case("o_orderkey % 16", [t for t, _ in TEMPLATES])
DESCRIPTION = _case("o_orderkey % 16", [d for _, d in TEMPLATES])
MERCHANT = "CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE 'Joe''s Diner ' || CAST(o_orderkey % 200 AS STRING) END"
URL = (
    "'https://H' || CAST(o_orderkey % 3 AS STRING) || '.example/p/' || CAST(o_custkey AS STRING) || "
    "CASE WHEN o_orderkey % 2 = 0 THEN '/?x=' ELSE '?x=' END || CAST(o_orderkey AS STRING)"
)
_LAT = "37e0 + ({v} % 25) * 5e-1 + ({v} * 37 % 1000) / 1e4"
_LON = "-122e0 + ({v} % 25) * 5e-1 + ({v} * 91 % 1000) / 1e4"

VIEWS = {
    "cities": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, lower(replace(n_name, '_', '-')) AS slug,
               'City ' || CAST(n_nationkey AS STRING) AS name, n_nationkey % 6 <> 5 AS is_active
        FROM {nation}""",
    "sources": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, lower(r_name) AS name, r_regionkey <> 3 AS is_active,
               CAST(r_regionkey AS BIGINT) AS consecutive_failures
        FROM {region}""",
    "venues": f"""
        SELECT p_partkey AS id, p_name || ' ' || lower(p_type) AS name,
               replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING) AS slug,
               CASE WHEN p_partkey % 37 = 5 THEN NULL ELSE p_partkey % 25 END AS city_id,
               CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE {_LAT.format(v="p_partkey")} END AS lat,
               CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE {_LON.format(v="p_partkey")} END AS lon,
               CASE WHEN p_partkey % 2 = 0 THEN '415555' || lpad(CAST(p_partkey % 97 AS STRING), 4, '0') END AS phone,
               CAST(p_size AS STRING) || ' ' || replace(p_brand, '#', ' ') || ' St, X' AS address,
               lower(p_type) AS category, (p_partkey % 10) / 1e1 AS confidence, p_partkey % 19 <> 7 AS is_active,
               CAST(NULL AS STRING) AS image_url, CAST(NULL AS STRING) AS website
        FROM {{part}}""",
    "mappings": """
        SELECT l_partkey * 5 + l_suppkey % 5 AS id, l_partkey AS venue_id, l_suppkey % 5 AS source_id,
               'x' || CAST(l_partkey AS STRING) AS external_id, max(CAST(l_shipdate AS TIMESTAMP)) AS last_seen_at
        FROM {lineitem} GROUP BY l_partkey, l_suppkey % 5""",
    "deals": f"""
        SELECT o_orderkey AS id, o_orderkey % 5 AS source_id, 'd' || CAST(o_orderkey AS STRING) AS source_deal_id,
               venue_id, CASE WHEN o_orderkey % 23 = 7 THEN NULL ELSE venue_id % 25 END AS city_id,
               {TITLE} AS title, {DESCRIPTION} AS description, {MERCHANT} AS merchant, {URL} AS url,
               CASE WHEN o_orderkey % 29 = 3 THEN NULL ELSE o_orderpriority END AS category,
               '["tag' || CAST(o_orderkey % 5 AS STRING) || '","all"]' AS tags,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Area ' || CAST(o_orderkey % 30 AS STRING) END AS location,
               o_totalprice AS original_price, round(8e0 * disc / n, 2) AS discount_pct,
               o_totalprice * (1e0 - round(8e0 * disc / n, 2) / 1e2) AS deal_price,
               o_orderkey % 4 = 0 AS is_online, o_orderstatus <> 'F' AS is_active,
               CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE (o_orderkey % 101) / 1e2 END AS quality_score,
               CASE WHEN o_orderkey % 11 = 2 THEN NULL ELSE (o_orderkey % 89) / 1e2 END AS confidence,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey * 37 % 1000) / 1e3 END AS rank_score,
               CAST(o_orderdate AS TIMESTAMP) AS fetched_at, CAST(o_orderdate AS TIMESTAMP) AS first_seen_at,
               last_ship AS last_seen_at, CAST(o_orderdate AS TIMESTAMP) AS normalized_at,
               CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 DAY END AS expires_at,
               {_LAT.format(v="venue_id")} AS lat, {_LON.format(v="venue_id")} AS lon
        FROM {{orders}} LEFT JOIN (
               SELECT l_orderkey, min(l_partkey) AS venue_id, max(CAST(l_shipdate AS TIMESTAMP)) AS last_ship,
                      sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc, count(*) AS n
               FROM {{lineitem}} GROUP BY l_orderkey) AS line ON o_orderkey = l_orderkey""",
    "schedules": """
        SELECT o_orderkey * 3 AS id, o_orderkey AS deal_id, CAST(o_orderkey % 7 AS INT) AS day_of_week,
               '09:00' AS start_time, '17:00' AS end_time, CAST(NULL AS TIMESTAMP) AS valid_from,
               CAST(NULL AS TIMESTAMP) AS valid_until, 'UTC' AS timezone
        FROM {orders} WHERE o_orderkey % 4 >= 1
        UNION ALL
        SELECT o_orderkey * 3 + 1, o_orderkey, CAST(NULL AS INT), '11:00', '23:59', CAST(NULL AS TIMESTAMP),
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1500 DAY, 'UTC'
        FROM {orders} WHERE o_orderkey % 4 >= 2
        UNION ALL
        SELECT o_orderkey * 3 + 2, o_orderkey, CAST((o_orderkey + 2) % 7 AS INT), CAST(NULL AS STRING),
               CAST(NULL AS STRING), CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY, CAST(NULL AS TIMESTAMP), 'UTC'
        FROM {orders} WHERE o_orderkey % 4 = 3""",
    "event_log": """
        SELECT event_id, CASE event_type WHEN 'error' THEN 'report_incorrect' WHEN 'signup' THEN 'report_expired'
                    WHEN 'purchase' THEN 'rating' WHEN 'view' THEN 'view' WHEN 'click' THEN 'clicked' END AS event_type,
               's' || CAST(user_id AS STRING) AS session_id,
               CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS deal_id, CAST(NULL AS BIGINT) AS venue_id,
               CASE WHEN event_id % 3 = 0 THEN '{{"value": ' || CAST(event_id % 7 AS STRING) || '}}' ELSE props END AS payload,
               '10.0.0.' || CAST(user_id % 250 AS STRING) AS ip, CAST(ts AS TIMESTAMP) AS created_at
        FROM {events}""",
    "normalization_log": """
        SELECT l_orderkey AS deal_id, l_returnflag <> 'R' AS fallback_used FROM {lineitem}""",
    "runs": """
        SELECT o_orderkey AS id, o_custkey % 5 AS source_id, 'src' || CAST(o_custkey % 5 AS STRING) AS source,
               CAST(o_orderdate AS TIMESTAMP) AS started_at, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'success' END AS status,
               o_orderkey % 100 AS deals_fetched, o_orderkey % 40 AS deals_inserted, o_orderkey % 30 AS deals_updated,
               CASE WHEN o_orderstatus = 'F' THEN 'timeout ' || CAST(o_orderkey % 9 AS STRING) END AS error_msg
        FROM {orders}""",
    "preferences": """
        SELECT 's' || CAST(c_custkey AS STRING) AS session_id, CAST(c_nationkey AS BIGINT) AS city_id,
               CASE c_custkey % 3 WHEN 0 THEN '1-urgent' WHEN 1 THEN '2-HIGH' ELSE '3-Medium' END AS first_choice,
               CASE c_custkey % 2 WHEN 0 THEN '5-low' ELSE 'none' END AS second_choice,
               c_acctbal / 1e1 AS max_price, c_acctbal / 8e1 AS min_discount_pct, c_acctbal / 1e1 AS radius_miles
        FROM {customer}""",
    "listings": f"""
        SELECT o_orderkey AS seq, 'd' || CAST(o_orderkey AS STRING) AS source_deal_id, {TITLE} AS title, {URL} AS url,
               {DESCRIPTION} AS description, CAST(NULL AS STRING) AS image_url, {MERCHANT} AS merchant,
               CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS original_price,
               CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice / 2e0 WHEN o_orderkey % 6 = 1 THEN 0e0 END AS deal_price,
               CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 DAY END AS expires_at,
               '{{{{"k": ' || CAST(o_orderkey AS STRING) || '}}}}' AS raw_data
        FROM {{orders}}""",
    "points": f"""
        SELECT s_suppkey AS query_id, {_LAT.format(v="s_suppkey")} + 1e-3 AS q_lat, {_LON.format(v="s_suppkey")} - 1e-3 AS q_lon,
               5e2 + (s_suppkey % 4) * 5e2 AS radius_m,
               CASE s_suppkey % 2 WHEN 0 THEN '1-URGENT' ELSE '3-medium' END AS wanted
        FROM {{supplier}}""",
}

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame over the Parquet files."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    tables = {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in BASE_TABLES}
    return spark.sql(VIEWS[name].format(**tables))


def with_views(select: str) -> str:
    """DuckDB text: every domain view as a common table expression, then the query.

    A query that brings its own WITH list joins it to the views.
    """
    tables = {t: t for t in BASE_TABLES}
    listed = ",\n".join(f"{n} AS ({sql.format(**tables)})" for n, sql in VIEWS.items())
    body = select.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {listed},\n{body[5:]}"
    return f"WITH {listed}\n{body}"
