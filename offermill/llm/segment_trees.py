"""How far the sources of a language differ, priced on hash-consed segment trees over term ids.

The counts of a group (language, source) are the leaves of a segment tree over the terms that the language keeps.  Trees
are hash-consed: a node stands for its counts alone, so equal subtrees of any groups are one node.  Two groups are
compared by walking both trees at once; a pair of nodes that turns up again, under whatever parents, is looked up
instead of being walked and priced anew.

The term ids of a language are dealt into blocks of about ``BLOCK`` terms, the subtrees below one level, and sources into
tiles of ``TILE``.  A task holds one block of two tiles, whatever the size of the input; sums over the blocks stand for
the levels above.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import raw_texts, windows

LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50

BLOCK = 4096
TILE = 64
HELD_TERMS = 400_000
CHUNK_BYTES = 4 << 20

# Letters of ASCII, lower-cased, and all bytes of other characters make terms; everything else separates them.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


# ---- counting ---------------------------------------------------------------------------------------------------


def _terms(data: bytes, lo: int, hi: int) -> Iterator[list[bytes]]:
    """The terms of a text in order, in runs of bounded size; ``data`` has spaces between its terms."""
    while lo < hi:
        cut = data.find(b" ", lo + CHUNK_BYTES, hi)
        cut = hi if cut < 0 else cut
        yield data[lo:cut].split()
        lo = cut


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term); a null term stands for the group itself."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64()),
            ], schema=_COUNTED)
        counts.clear()

    held = 0
    for batch in batches:
        for lo, hi in windows(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            raw, bounds = raw_texts(part.column("text"))
            data, edges = raw.tobytes().translate(_TERM_BYTES), bounds.tolist()
            for lang, source, start, end in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), edges, edges[1:]):
                n, docs = counts.setdefault((lang or "", source or ""), (Counter(), Counter()))
                before, distinct = len(n), set()
                for run in _terms(data, start, end):
                    n.update(run)
                    distinct.update(run)
                docs.update(distinct)
                held += len(n) - before
                if held > HELD_TERMS:
                    yield from flush()
                    held = 0
    yield from flush()


def kept_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n): counts of the kept terms that occur, and one row with a null term per group.

    A language keeps the terms of ``least_docs`` of its documents or more; ``lang_n`` counts the whole language.
    """
    rows = docs.select(*[F.col(c).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # One shuffle by (lang, term) serves the sums per source and per language.
    term = W.partitionBy("lang", "term")
    whole = (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"))
    )
    return whole.filter((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("docs")


# ---- trees ------------------------------------------------------------------------------------------------------


class Trees:
    """Segment trees of the rows of a count matrix, with one node table per level for all rows.

    ``leaves`` holds the count of each leaf node, -1 for places behind the last term; ``levels[i]`` the two children of
    each node of level i + 1; ``roots`` the root of each row.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(counts.shape[1] - 1, 0).bit_length()  # 1 at least: a block without terms is one empty place
        padded = np.pad(counts, ((0, 0), (0, width - counts.shape[1])), constant_values=-1)
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.levels: list[np.ndarray] = []
        while nodes.shape[1] > 1:
            pairs, nodes = np.unique(nodes[:, ::2].astype(np.int64) << 32 | nodes[:, 1::2], return_inverse=True)
            nodes = nodes.reshape(len(counts), -1)
            self.levels.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1))
        self.roots = nodes[:, 0]

    def leaves_of(self, row: int) -> np.ndarray:
        """The different leaf nodes below a root."""
        found = self.roots[row:row + 1]
        for level in reversed(self.levels):
            found = np.unique(level[found])
        return found

    def distances(self, row: int, others: np.ndarray, prices: np.ndarray) -> np.ndarray:
        """Sums of |prices[row, leaf] - prices[other, leaf]| over the terms; all traversals go down level by level.

        A level lists every (other, node, node) once, however often it occurs: that is the memo of the traversal.
        On the way back the price of a pair is the sum of the prices its two children were given.
        """
        other, left, right = np.arange(len(others)), np.full(len(others), self.roots[row]), self.roots[others]
        ways: list[np.ndarray] = []
        for level in reversed(self.levels):
            a, b = level[left], level[right]
            key = (other[:, None] << 48 | a << 24 | b).reshape(-1)
            memo, way = np.unique(key, return_inverse=True)
            ways.append(way)
            other, left, right = memo >> 48, memo >> 24 & 0xFFFFFF, memo & 0xFFFFFF
        price = np.abs(prices[row, left] - prices[others[other], right])
        for way in reversed(ways):
            price = price[way].reshape(-1, 2).sum(axis=1)
        return price


def share(n: int, total: int) -> int:
    """1 + floor(SCALE * (n + SMOOTHING) / total) in whole numbers of any size."""
    return 1 + SCALE * (n + SMOOTHING) // total


def _leaf_prices(trees: Trees, totals: list[int]) -> np.ndarray:
    prices = np.zeros((len(totals), len(trees.leaves)), dtype=np.int64)
    for row, total in enumerate(totals):
        for leaf in trees.leaves_of(row).tolist():
            if trees.leaves[leaf] >= 0:
                prices[row, leaf] = share(int(trees.leaves[leaf]), total)
    return prices


_PRICED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _block_distances(key: tuple, rows: pa.Table) -> pa.Table:
    """Distances within one block between the sources of two tiles (or of one), both ways round."""
    lang, _, one, two = (k.as_py() for k in key)
    marks = rows.filter(pc.is_null(rows["term"])).sort_by("source")
    names, tiles, totals = (marks[c].to_pylist() for c in ("source", "tile", "total"))
    place = {name: i for i, name in enumerate(names)}
    found = rows.filter(pc.is_valid(rows["term"]))
    codes = found["term"].combine_chunks().dictionary_encode()
    code = np.asarray(codes.indices, dtype=np.int64)
    weight = np.zeros(len(codes.dictionary), dtype=np.int64)
    weight[code] = np.asarray(found["lang_n"])
    leaf = np.empty(len(weight), dtype=np.int64)
    leaf[np.argsort(-weight, kind="stable")] = np.arange(len(weight))  # rare terms lie together and share subtrees
    counts = np.zeros((len(names), marks["n"][0].as_py()), dtype=np.int64)  # also terms that none of these sources holds
    counts[[place[s] for s in found["source"].to_pylist()], leaf[code]] = np.asarray(found["n"])
    trees = Trees(counts)
    prices = _leaf_prices(trees, totals)
    out: list[tuple[str, str, int]] = []
    for i, name in enumerate(names):
        others = np.array([j for j in range(i + 1, len(names)) if {tiles[i], tiles[j]} == {one, two}], dtype=np.int64)
        if len(others):
            for j, value in zip(others.tolist(), trees.distances(i, others, prices).tolist()):
                out += [(name, names[j], value), (names[j], name, value)]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array([lang] * len(out), pa.string()), *(pa.array(c, f.type) for c, f in zip(columns, list(_PRICED)[1:]))], schema=_PRICED)


# ---- the audit --------------------------------------------------------------------------------------------------


def _share(n: Column, total: Column) -> Column:
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)")
    return F.call_function("div", whole, total.cast("decimal(20,0)")) + 1


def distances(kept: DataFrame, groups: DataFrame, *, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways round.

    ``kept`` as from ``kept_counts``; ``groups`` with lang, source, total (N + 5 V) and terms (V).
    """
    if block * tile > 1 << 20:  # a pair of nodes is one 64-bit key
        raise ValueError("block * tile may not exceed 2**20")
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    blocks = F.greatest(F.ceil(F.col("terms") / block), F.lit(1)).cast("int")
    placed = groups.withColumn("tile", F.floor(number / tile).cast("int")).withColumn("blocks", blocks)
    placed = placed.withColumn("tiles", F.max("tile").over(W.partitionBy("lang")) + 1)
    occurring = kept.filter("term IS NOT NULL").join(placed, ["lang", "source"]).withColumn(
        "block", F.pmod(F.xxhash64("term"), F.col("blocks").cast("long")).cast("int")
    )
    sizes = occurring.select("lang", "block", "term").distinct().groupBy("lang", "block").agg(F.count(F.lit(1)).alias("size"))
    marks = (
        placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(sizes, ["lang", "block"], "left")
        .select(
            "lang", "block", "source", "tile", "tiles", "total", F.lit(None).cast("string").alias("term"),
            F.coalesce("size", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("lang_n"),
        )
    )
    counted = occurring.select("lang", "block", "source", "tile", "tiles", "total", "term", "n", "lang_n")
    rows = counted.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keyed = rows.select(
        "lang", "block", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"),
        "source", "tile", "total", "term", "n", "lang_n",
    )
    priced = keyed.groupBy("lang", "block", "one", "two").applyInArrow(_block_distances, "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def over_used(kept: DataFrame, groups: DataFrame, langs: DataFrame, *, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): terms that a source uses more than its language, furthest first."""
    stated = (
        kept.filter("term IS NOT NULL AND n > 0")
        .join(groups.select("lang", "source", "total"), ["lang", "source"])
        .join(langs.select("lang", "lang_total"), "lang")
        .select(
            "lang", "source", F.col("term").alias("item"),
            (_share(F.col("n"), F.col("total")) - _share(F.col("lang_n"), F.col("lang_total"))).alias("value"),
        )
    )
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return stated.filter("value > 0").withColumn("rank", rank).filter(F.col("rank") <= top)


def audit(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    block: int = BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms that a source over-uses.

    Null languages, sources and texts are empty strings and repeated rows count again.  A source without kept terms, or
    a language that keeps none, still has its distances (0 if none are kept).  Values are exact; ties go by the bytes of
    the item.  Other columns are ignored; an empty table gives no rows.
    """
    kept = cut_lineage(kept_counts(docs, lang_col=lang_col, source_col=source_col, text_col=text_col, least_docs=least_docs))
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("term").alias("terms"), F.sum("n").alias("n")).select(
        "lang", "terms", (F.col("n") + SMOOTHING * F.col("terms")).alias("lang_total")
    )
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(langs, "lang").select(
        "lang", "source", "terms", (F.col("n") + SMOOTHING * F.col("terms")).alias("total")
    )
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = distances(kept, groups, block=block, tile=tile).withColumn("rank", rank)
    used = over_used(kept, groups, langs, top=top)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(names).unionByName(used.withColumn("part", F.lit("term")).select(names))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (
  SELECT lang, source, id, term, count(*) AS n FROM (SELECT lang, source, id, unnest(terms) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT w.lang, w.source, w.term, sum(w.n)::HUGEINT AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL
), s AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v))::BIGINT AS q
  FROM s JOIN l ON l.lang = s.lang JOIN k ON k.lang = s.lang
  LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item ASC)::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""
