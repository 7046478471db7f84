"""Explicit schemas of sources and of the tables the jobs keep."""

FLAT_JSON = """
  source_deal_id string, title string, description string, url string, image_url string,
  merchant string, original_price double, deal_price double, expires_at string, raw_data string
"""

OFFER_JSON = """
  struct<{id} string, title string, description string, deal_price double, original_price double,
  discount_pct double, currency string, valid_days array<string>, start_time string,
  end_time string, url string>
"""

FORUM_POST = """
  data struct<
    id string, title string, url string, selftext string, is_self boolean, stickied boolean,
    score long, num_comments long, link_flair_text string, created_utc double, permalink string>
"""

RSS_ITEM = "title string, link string, guid string, id string, description string, summary string, pubDate string, category array<string>"

EXTRACTOR_REPLY = """
  deal_type string, price double, price_range string, items_included array<string>,
  schedule_days array<string>, start_time string, end_time string, restrictions array<string>, confidence double
"""

INGEST_REPLY = """
  category string, tags array<string>, merchant string, original_price double, deal_price double,
  expires_at string, quality_score double
"""
