"""HTML pages -> listings and text blocks.

Only the reading of markup runs in Python, in one pass over the parser's events inside an
Arrow UDF.  It gives back the raw pieces of a page as an array; filters, de-duplication
inside the page and numbering are array functions on that row, so no shuffle is needed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing, price, text
from ..functions.text import clean_title, title_slug

# --- fixed values -----------------------------------------------------------------
VOID_TAGS = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img",
    "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
}
LISTING_CHROME = {"nav", "footer", "aside", "script", "style", "header"}
MENU_CHROME = {"nav", "footer", "header", "script", "style", "meta", "head"}
ARTICLE_CHROME = {"nav", "footer", "header", "aside", "script", "style", "meta", "head"}
HEADINGS = {"h1", "h2", "h3", "h4"}
MENU_KEYWORDS = [
    "special", "specials", "happy", "happy-hour", "happyhour", "lunch", "prix",
    "early-bird", "earlybird", "promo", "promotion", "deal", "offer", "dinner",
]
CONTENT_CLASSES = (
    r"post[\-_]?content|entry[\-_]?content|article[\-_]?body|"
    r"blog[\-_]?content|main[\-_]?content|content[\-_]?area"
)
SKIPPED_TITLES = (
    r"newsletter|subscribe|contact|privacy|terms|copyright|follow us|"
    r"social media|top picks|our menu|reservations|about"
)
MIN_BLOCK_CHARS = 20
TITLE_CHARS = (5, 250)
# ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Reading:
    """What one kind of page is read for."""

    chrome: frozenset[str]  # elements that are passed over with all they hold
    areas: tuple[str, ...]  # where pieces may lie, the best first; "*" is the page, "." a content class
    heads: tuple[str, ...]  # headings that begin a piece
    ends: frozenset[str]  # headings that end the piece of a heading beside them
    steps: int  # length of the context
    items: bool = False  # outermost list items are pieces
    keywords: bool = False  # only elements and headings with a keyword are pieces
    prose: bool = False  # pieces are a title and prose, without line breaks


class _Piece:
    """Text that is still being collected.

    ``level`` is the number of open elements around the element the piece began at.  A heading goes on with what stands
    beside it, so it is open as long as these elements are; any other element as long as it is open itself.
    """

    __slots__ = ("kind", "level", "until", "parts", "contexts")

    def __init__(self, kind: str, level: int, beside: bool, contexts: dict[str, str]):
        self.kind, self.level, self.contexts = kind, level, contexts
        self.until = level if beside else level + 1
        self.parts: list[list[str]] = [[]]

    def add(self, text: str, level: int) -> None:
        if level > self.level:
            self.parts[-1].append(text)
        else:  # beside the heading: a part of its own
            self.parts += [[text.strip()], []]


class _Reader(HTMLParser):
    """One pass over the events of a page; keeps the names of the open elements and the pieces being collected.

    An end tag closes all elements up to its start tag, one without a start tag does nothing.
    """

    def __init__(self, reading: _Reading):
        super().__init__(convert_charrefs=True)
        self.reading = reading
        self.open: list[tuple[str, str]] = []  # name and context step of each open element
        self.muted: int | None = None  # level of the chrome around
        self.areas: dict[str, int | None] = {"*": 0}  # level inside each area found, None once it is over
        self.titles: list[str] | None = None
        self.title_level: int | None = None
        self.collecting: list[_Piece] = []
        self.pieces: list[_Piece] = []
        self.run: list[str] = []

    # --- text

    def _end_run(self) -> None:
        text, self.run = "".join(self.run), []
        if text and not text.strip(" \t\n\r\f"):
            text = "\n" if "\n" in text else " "
        if not text:
            return
        if self.title_level is not None and (self.muted is None or self.reading.items):
            self.titles.append(text)
        if self.muted is None:
            for piece in self.collecting:
                piece.add(text, len(self.open))

    def handle_data(self, data: str) -> None:
        self.run.append(data)

    def handle_comment(self, data: str) -> None:
        self._end_run()
        if self.reading.prose and self.muted is None:  # there a remark beside a heading is read as text
            for piece in self.collecting:
                if piece.level == len(self.open):
                    piece.add(data, piece.level)

    # --- elements

    def _context(self, tag: str, step: str, inside: int) -> str:
        if tag in ("html", "body"):
            return "unknown"
        steps = [step]
        for name, mark in reversed(self.open[inside:]):
            if name in ("html", "body") or len(steps) == self.reading.steps:
                break
            steps.append(mark)
        return " > ".join(reversed(steps))

    def _kind(self, tag: str, given: dict[str, str]) -> str | None:
        reading = self.reading
        if tag in reading.heads:
            return "heading_paragraph"
        if reading.keywords and tag not in HEADINGS:
            marks = (" ".join(given.get("class", "").split()), given.get("id", ""))
            if any(k in m.lower().replace("-", " ").replace("_", " ") for m in marks for k in MENU_KEYWORDS):
                return "specials_section"
        if reading.items and tag == "li" and all(name != "li" for name, _ in self.open):
            return "list_item"
        return None

    def _begin(self, tag: str, attrs: list[tuple[str, str | None]], stays: bool) -> None:
        self._end_run()
        level = len(self.open)
        given = {k: v or "" for k, v in attrs}
        classes = given.get("class", "").split()
        step = tag + (f"#{given['id']}" if given.get("id") else f".{classes[0]}" if classes else "")
        if tag == "title" and self.titles is None and (self.muted is None or self.reading.items):
            self.titles, self.title_level = [], level
        if self.muted is None and tag in self.reading.chrome:
            if not stays:
                return
            self.muted = level
        if self.muted is None:
            self._read(tag, given, step, level)
        if stays:
            self.open.append((tag, step))
        else:
            self._settle()

    def _read(self, tag: str, given: dict[str, str], step: str, level: int) -> None:
        if tag in self.reading.ends:
            self.collecting = [p for p in self.collecting if not p.level == p.until == level]
        for piece in self.collecting:
            if piece.level == level:
                piece.parts.append([])
            elif tag == "br" and not self.reading.prose:
                piece.add("\n", level)
        kind = self._kind(tag, given)
        if kind is not None:
            contexts = {a: self._context(tag, step, inside) for a, inside in self.areas.items() if inside is not None}
            piece = _Piece(kind, level, kind == "heading_paragraph", contexts)
            self.pieces.append(piece)
            self.collecting.append(piece)
        content = "." if re.search(CONTENT_CLASSES, given.get("class", ""), re.IGNORECASE) else ""
        for area in (tag, content):
            if area in self.reading.areas:
                self.areas.setdefault(area, level + 1)

    def _settle(self) -> None:
        """Elements were closed: so are the pieces and areas in them."""
        level = len(self.open)
        self.collecting = [p for p in self.collecting if p.until <= level]
        self.areas = {a: None if inside is None or inside > level else inside for a, inside in self.areas.items()}
        if self.muted is not None and self.muted >= level:
            self.muted = None
        if self.title_level is not None and self.title_level >= level:
            self.title_level = None

    def handle_starttag(self, tag, attrs):
        self._begin(tag, attrs, stays=tag not in VOID_TAGS)

    def handle_startendtag(self, tag, attrs):
        self._begin(tag, attrs, stays=False)

    def handle_endtag(self, tag):
        self._end_run()
        place = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if place is not None:
            del self.open[place:]
            self._settle()

    # --- result

    def _text(self, part: list[str]) -> str:
        return " ".join(t.strip() for t in part if t.strip()) if self.reading.prose else " ".join(part)

    def result(self, markup: str) -> tuple[str, list[dict]]:
        """-> (title of the page, pieces of its best area)."""
        self.feed(markup)
        self.close()
        self._end_run()
        area = next((a for a in self.reading.areas if a in self.areas), None)
        found = []
        for piece in self.pieces:
            if area not in piece.contexts:
                continue
            parts = [self._text(p) for p in piece.parts]
            if self.reading.keywords and piece.until == piece.level and not any(k in parts[0].lower() for k in MENU_KEYWORDS):
                continue
            title, parts = (parts[0], parts[1:]) if self.reading.prose else (piece.kind, parts)
            found.append({"kind": title, "parts": parts, "html_context": piece.contexts[area]})
        if self.reading.keywords:
            found.sort(key=lambda p: p["kind"] == "heading_paragraph")  # marked elements come before headings
        return "".join(self.titles or []).strip(), found


def _reading(kind: str, heads: tuple[str, ...] | None) -> _Reading:
    if kind == "menu_page":
        heads = tuple(sorted(HEADINGS)) if heads is None else heads
        return _Reading(frozenset(MENU_CHROME), ("*",), heads, frozenset(HEADINGS), steps=4, keywords=True)
    if kind == "blog_listing":
        heads = ("h2", "h3") if heads is None else heads
        return _Reading(frozenset(ARTICLE_CHROME), ("article", ".", "main", "body", "*"), heads, frozenset(HEADINGS), steps=3, items=True)
    if kind == "listing":
        return _Reading(frozenset(LISTING_CHROME), ("article", "main", "body"), ("h2", "h3"), frozenset({"h1", "h2", "h3"}), steps=1, prose=True)
    raise KeyError(kind)


_PIECE = T.StructType().add("kind", "string").add("parts", T.ArrayType(T.StringType())).add("html_context", "string")
_PIECES = T.StructType().add("page_title", "string").add("pieces", T.ArrayType(_PIECE))


def _walk(html: Column, kind: str, heading_tags: tuple[str, ...] | None) -> Column:
    reading = _reading(kind, heading_tags)

    @F.pandas_udf(_PIECES)
    def pieces(markup: pd.Series) -> pd.DataFrame:
        found = [_Reader(reading).result(m or "") for m in markup]
        return pd.DataFrame({"page_title": [t for t, _ in found], "pieces": [p for _, p in found]})

    return pieces(html)


def _squeeze(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return text.strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def _joined(parts: Column, separator: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: p != ""), separator)


def _first_by(items: Column, key) -> Column:
    """Items of an array whose key did not occur earlier in it, in their order; sorted, not compared each with each."""

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda s, i: (i == 0) | (s["k"] != F.get(ordered, i - 1)["k"]))

    keyed = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    kept = text.let(F.array_sort(keyed), firsts)
    placed = F.array_sort(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x"))))
    return F.transform(placed, lambda s: s["x"])


def pages_to_blocks(
    pages: DataFrame, kind: str = "blog_listing", heading_tags: tuple[str, ...] | None = None, *, min_chars: int = MIN_BLOCK_CHARS
) -> DataFrame:
    """Pages (url, html) -> one row per text block, numbered in page order.

    ``kind`` is ``menu_page`` (elements marked as specials) or ``blog_listing`` (one block
    per heading, else per list item).  ``heading_tags`` are the headings that begin a block: by
    default h1 to h4 with a keyword on a menu page, h2 and h3 in a blog; none leaves the marked
    elements or list items alone.  ``block_count`` is the number of blocks of the page.
    Blocks below ``min_chars`` characters are no offers and left out; 0 keeps them all.
    """
    walked = pages.withColumn("_w", _walk(F.col("html"), kind, heading_tags))
    blocks = F.transform(
        "_w.pieces",
        lambda p: F.struct(
            text.strip(_joined(F.transform(p["parts"], _squeeze), "\n")).alias("text"),
            p["html_context"].alias("html_context"),
            p["kind"].alias("block_type"),
        ),
    )
    long_enough = F.filter("_b", lambda b: F.length(b["text"]) >= min_chars)
    chosen = F.col("_b")
    if kind == "blog_listing":
        headed = F.filter("_b", lambda b: b["block_type"] == "heading_paragraph")
        chosen = F.when(F.size(headed) > 0, headed).otherwise(F.col("_b"))

    def fingerprint(b: Column) -> Column:
        return text.strip(F.regexp_replace(b["text"], r"(?U)\s+", " "))

    rows = (
        walked.select(*[c for c in pages.columns if c != "html"], F.col("_w.page_title").alias("page_title"), blocks.alias("_b"))
        .withColumn("_b", long_enough)
        .withColumn("_b", chosen)
        .withColumn("_b", _first_by(F.col("_b"), fingerprint))
        .withColumn("block_count", F.size("_b"))
    )
    rest = [c for c in rows.columns if c not in ("_b", "url")]
    out = rows.select(*rest, F.col("url").alias("source_url"), F.posexplode("_b").alias("position", "_block"))
    return out.select(
        hashing.short_sha(F.concat_ws("#", F.col("source_url"), F.lit(kind), F.col("position").cast("string")), 16).alias("block_id"),
        *rest,
        "source_url",
        "position",
        "_block.*",
        F.lit(kind).alias("scraper_name"),
    )


def pages_to_listings(pages: DataFrame, *, title_chars: tuple[int, int] = TITLE_CHARS) -> DataFrame:
    """Pages (stem, url, html) -> flat listings, one per usable h2/h3 heading; the first of each id on a page.

    Headings outside ``title_chars`` or of a page's own business name no offer.
    """
    walked = pages.withColumn("_w", _walk(F.col("html"), "listing", ()))
    items = F.transform(
        "_w.pieces",
        lambda p: F.struct(
            clean_title(p["kind"]).alias("title"),
            text.blank_to_null(_joined(p["parts"], " ")).alias("description"),
        ),
    )
    usable = F.filter(
        items, lambda x: F.length(x["title"]).between(*title_chars) & ~text.has(x["title"], f"({SKIPPED_TITLES})")
    )
    first = _first_by(F.col("_items"), lambda x: title_slug(x["title"]))
    out = (
        walked.select("stem", "url", usable.alias("_items"))
        .select("stem", "url", F.explode(first).alias("_i"))
        .select("stem", "url", "_i.*")
    )
    amounts = price.dollar_amounts(F.concat_ws(" ", F.col("title"), F.coalesce("description", F.lit(""))))
    return out.withColumn("_a", amounts).select(
        F.concat(F.lit("fix-"), F.col("stem"), F.lit("-"), title_slug(F.col("title"))).alias("source_deal_id"),
        "title",
        "url",
        "description",
        F.lit(None).cast("string").alias("image_url"),
        F.lit(None).cast("string").alias("merchant"),
        F.when(F.size("_a") > 1, F.array_max("_a")).alias("original_price"),
        F.array_min("_a").alias("deal_price"),
        F.lit(None).cast("timestamp").alias("expires_at"),
        F.to_json(F.struct(F.col("stem").alias("fixture_file"))).alias("raw_data"),
    )


def read_html_files(spark, path: str) -> DataFrame:
    """A folder of .html files as pages (stem, url, html)."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("url"))
    stem = F.regexp_extract("url", r"([^/]+)\.html?$", 1)
    return files.select(stem.alias("stem"), "url", F.col("value").alias("html"))
