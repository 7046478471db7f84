"""HTML pages and feed readers on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from offermill.operators import extract, normalize
from offermill.plans.catalog import QUERIES
from offermill.sources import html, listings

ARTICLE = """<html><head><title> Best bars </title></head><body><nav><h2>Menu of nothing at all here</h2></nav>
<div class="post-content wide"><h1>Ten bars</h1><h2>1. The <em>Spotted</em> Dog &amp; Duck — Tribeca</h2>
<p>Happy hour Mon-Fri 5-7pm.<br>$6 beers</p><ul><li>fries</li></ul><!-- ad --><h2>1. The Spotted Dog &amp; Duck — Tribeca</h2>
<p>Happy hour Mon-Fri 5-7pm.<br>$6 beers</p><ul><li>fries</li></ul><h3>short</h3><h2>About this list of ours</h2></div>
<aside><h2>Sidebar happy hour with lots of text</h2></aside></body></html>"""
LIST_ONLY = "<body><main><ul><li>First place, happy hour daily <ul><li>nested thing that is long enough</li></ul></li><li>tiny</li></ul></main></body>"
MENU = """<body><section id="happy_hour"><p>Wells $5 and drafts $6<p>Daily 4-6pm</section><div class="wine">Not a match but long enough</div>
<h2>Lunch Specials</h2><p>Soup and half sandwich $9</p><h2>Contact</h2><p>Call us</p></body>"""


def pages(spark, *docs):
    return spark.createDataFrame([(f"s{i}", f"http://p/{i}", d) for i, d in enumerate(docs)], "stem string, url string, html string")


def test_article_blocks(spark):
    rows = html.pages_to_blocks(pages(spark, ARTICLE)).orderBy("position").collect()
    assert [r.position for r in rows] == [0, 1]
    assert rows[0].text == "1. The Spotted Dog & Duck — Tribeca\nHappy hour Mon-Fri 5-7pm. \n $6 beers\nfries"
    assert rows[0].page_title == "Best bars" and rows[0].block_count == 2
    assert rows[0].html_context == "h2"


def test_list_fallback_and_empty_page(spark):
    rows = html.pages_to_blocks(pages(spark, LIST_ONLY, "", "<p>plain")).collect()
    assert [(r.block_type, r.html_context) for r in rows] == [("list_item", "ul > li")]


def test_menu_blocks(spark):
    rows = html.pages_to_blocks(pages(spark, MENU), "menu_page").orderBy("position").collect()
    assert [(r.block_type, r.html_context) for r in rows] == [("specials_section", "section#happy_hour"), ("heading_paragraph", "h2")]
    assert rows[1].text == "Lunch Specials\nSoup and half sandwich $9"


def test_stray_and_unclosed_tags(spark):
    deep = "<article><h2>Deeply nested offers page</h2>" + "<div>" * 3000 + "</p></span>text inside the deep tree"
    row = html.pages_to_blocks(pages(spark, deep)).first()
    assert row.text.endswith("text inside the deep tree")


def test_page_listings(spark):
    rows = html.pages_to_listings(pages(spark, ARTICLE)).collect()
    assert [r.source_deal_id for r in rows] == ["fix-s0-the-spotted-dog-duck-tribeca", "fix-s0-short"]
    assert rows[0].title == "The Spotted Dog & Duck - Tribeca" and rows[0].deal_price == 6.0 and rows[0].original_price is None


def test_html_folder(spark, tmp_path):
    (tmp_path / "one.html").write_text(ARTICLE)
    row = html.read_html_files(spark, str(tmp_path)).first()
    assert row.stem == "one" and row.html == ARTICLE


def test_page_to_offer(spark):
    blocks = html.pages_to_blocks(pages(spark, ARTICLE))
    found = extract.extract_candidates(blocks).withColumn("seq", F.col("position").cast("long"))
    out = normalize.normalize_listings(normalize.Provenance("web", "2024-06-01 12:00:00"), candidates=found)
    best = out.filter("deal_type = 'happy_hour'").first()
    assert best.dedup_key == "the-spotted-dog-duck|happy_hour|01234|17:00|19:00" and best.price == 6.0


BUSINESSES = {
    "nyc": {
        "businesses": [
            {
                "id": "b1", "name": "Joe's", "is_closed": False, "url": "http://joe", "review_count": 3,
                "categories": [{"alias": "odd", "title": "Odd"}, {"alias": "bars", "title": "Bars"}], "rating": 4.5,
                "coordinates": {"latitude": 40.7, "longitude": -74.0}, "price": "$$",
                "location": {"address1": "1 St", "city": "New York", "state": "NY", "country": "US"}, "phone": "+1212",
                "deals": [
                    {"deal_id": "d1", "title": "A", "valid_days": ["Mon", "Xyz", "Fri"], "start_time": "17:00", "end_time": "19:00", "discount_pct": 10.0},
                    {"deal_id": "d2", "title": "B", "url": None, "deal_price": 5.0, "original_price": 9.0},
                    {"deal_id": "d3", "title": "C", "url": "http://c"},
                ],
            },
            {"id": "b2", "name": "Shut", "is_closed": True, "deals": [{"deal_id": "x", "title": "X"}]},
        ]
    },
    "sf": {"businesses": []},
}


def test_business_feed(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(BUSINESSES, indent=1))
    venues, deals = listings.read_business_json(spark, str(path), "NYC")
    assert [(v.external_id, v.category, v.city, v.lat) for v in venues.collect()] == [("b1", "bar", "New York", 40.7)]
    rows = {r.source_deal_id: r for r in deals.collect()}
    assert {k: r.url for k, r in rows.items()} == {"d1": "http://joe", "d2": None, "d3": "http://c"}
    meta = json.loads(rows["d1"].raw_data)
    assert meta["valid_day_indices"] == [0, 4] and meta["venue_external_id"] == "b1" and rows["d1"].merchant == "Joe's"
    assert listings.read_business_json(spark, str(path), "atlantis")[1].count() == 0
    assert [r.city for r in listings.available_cities(spark, str(path), str(path)).collect()] == ["nyc", "sf"]


def test_restaurant_feed(spark, tmp_path):
    base = {"restaurant_id": "r1", "name": "R", "price_range": 3, "website": "http://w", "booking_url": "", "coordinates": {"lat": 1.0, "lng": 2.0},
            "address": {"street": "2 Av"}, "promotions": [{"promo_id": "p1", "title": "T", "url": ""}, {"promo_id": "p2", "title": "U", "url": "http://u"}]}
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"sf": {"restaurants": [base, dict(base, restaurant_id="r2", website=None, promotions=[{"promo_id": "p3", "title": "V"}])]}}))
    venues, deals = listings.read_restaurant_json(spark, str(path))
    assert [(v.price_range, v.city, v.country) for v in venues.collect()] == [("$$$", "sf", "US")] * 2
    assert {r.source_deal_id: r.url for r in deals.collect()} == {"p1": "http://w", "p2": "http://u", "p3": ""}


def test_flat_feed(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([
        {"source_deal_id": "1", "title": "A", "url": "u", "expires_at": "2024-06-01T10:00:00+05:00", "raw_data": {"category": "X"}, "category": "ignored"},
        {"source_deal_id": "2", "title": "B", "url": "u", "expires_at": "soon", "deal_price": 3.5},
    ]))
    one, two = listings.read_flat_json(spark, str(path)).orderBy("source_deal_id").collect()
    assert str(one.expires_at) == "2024-06-01 10:00:00" and json.loads(one.raw_data) == {"category": "X"}
    assert two.expires_at is None and two.deal_price == 3.5 and two.raw_data == "{}"
    assert listings.read_flat_json(spark, str(tmp_path / "missing.json")).count() == 0


def test_rss_feed(spark, tmp_path):
    path = tmp_path / "feed.xml"
    path.write_text("""<?xml version="1.0"?><rss version="2.0"><channel><title>x</title>
<item><title> Laptop $499.99 </title><link>http://l/1</link><guid isPermaLink="false">g1</guid><description>was nice $5</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>
<item><title>No price</title><link>http://l/2</link><description>now $7</description><pubDate>Tue, 2 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title></title><link>http://l/3</link></item></channel></rss>""")
    one, two = listings.read_rss(spark, str(path)).orderBy("url").collect()
    assert (one.source_deal_id, one.title, one.deal_price) == ("g1", "Laptop $499.99", 499.99)
    assert (two.source_deal_id, two.deal_price, two.description) == ("http://l/2", 7.0, "now $7")
    assert [str(r.expires_at) for r in (one, two)] == ["2024-01-01 10:00:00", "2024-01-02 10:00:00"]


def test_forum_feed(spark, tmp_path):
    post = lambda **kw: {"data": {"is_self": False, "stickied": False, "permalink": "/r/x", **kw}}
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"data": {"children": [
        post(id="a", title=" TV $799.99 (was $1299.99) ", url="http://t", score=5), post(id="b", title="pinned", stickied=True, url="u"),
        post(id="c", title="self", is_self=True), post(id="d", title="  ", url="u"), post(id="e", title="link less", url=""),
    ]}}))
    rows = {r.source_deal_id: r for r in listings.read_forum_json(spark, str(path)).collect()}
    assert set(rows) == {"a", "e"}
    assert (rows["a"].deal_price, rows["a"].original_price, rows["e"].url) == (799.99, 1299.99, "https://www.reddit.com/r/x")
    both = listings.union_sources({"one": listings.read_forum_json(spark, str(path)), "two": listings.read_forum_json(spark, str(path)).limit(1)})
    assert {r.source: r["count"] for r in both.groupBy("source").count().collect()} == {"one": 2, "two": 1}


def test_no_input_is_an_error():
    with pytest.raises(TypeError):
        normalize.normalize_listings(normalize.Provenance("x", "2024-01-01"))


def page_table(spark, folder, *docs):
    rows = [(i, f"http://p/{i}", d) for i, d in enumerate(docs)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


CUT_PAGE = '<html><head><title>Fish &amp; a&amp</title></head><body><div class="ad">A long enough advert of the house</div><article><h1>Fish deal &amp; a&amp</h1><p>x</article></body></html>'


def test_page_blocks_short_and_cut(spark, tmp_path):
    """Short blocks stay, and '&amp' without its semicolon is text, as in the SQL."""
    folder = page_table(spark, tmp_path, CUT_PAGE, "<title>T</title><article><h1>Hi</h1></article>")
    rows = QUERIES["page_blocks"](spark, folder).orderBy("page_id").collect()
    assert [r.page_title for r in rows] == ["Fish & a&amp", "T"]
    assert [r.digest for r in rows] == [hashlib.sha256(x).hexdigest() for x in (b"Fish deal & a&amp x", b"Hi")]


def test_page_listings_cut_reference(spark, tmp_path):
    row = QUERIES["page_listings"](spark, page_table(spark, tmp_path, CUT_PAGE)).first()
    assert (row.title, row.description) == ("Fish deal & a&amp", "x") and row.source_deal_id == "fix-0-fish-deal-a-amp"


def test_page_menu_blocks_without_headings(spark, tmp_path):
    """A heading that holds a keyword by chance is no advert box."""
    rows = QUERIES["page_menu_blocks"](spark, page_table(spark, tmp_path, CUT_PAGE)).collect()
    assert [(r.block_count, r.text) for r in rows] == [(1, "A long enough advert of the house")]
    assert html.pages_to_blocks(pages(spark, MENU), "menu_page", ()).count() == 1
