"""N-gram Jaccard join in the metric space of shingle sets.

1 - Jaccard is a metric d; documents link when d <= t = 0.25.  Almost all documents lie at distance 1 from each other,
where no pivot can tell them apart, so the space is first dealt into cells: every set takes its first p shingles in
the order of their hashes, with p = n - ceil(0.75 n) + l and l = ceil(0.04 n).  Two linked sets share min(l) of these
at least.  So a set that shares fewer with all others has no link and goes; a cell with more than ``HOT`` sets is
left to the sets with that many shingles in such cells, and these are dealt again by their rarest shingles.

Inside the cells pivots do the rest, recursively:

1. The most typical set of a cell, which shares the largest part of its shingles, is the pivot.  Every set is measured against the pivot with which it shares most
   cells: its Voronoi region.  All sets within t of a pivot are one component; no pair among them is looked at again.
2. Cells that still hold several components and more than ``LEAF`` sets replicate their sets to a next pivot, unless
   component, size or the triangle inequality |d(x, r) - d(r, q)| <= t rules a link to it out.
3. The remaining pairs of a cell are measured across components if they share shingles enough, those that no other set
   has leave room for the similarity, and no triangle with a pivot rules them out.

Every pair of a cell is thus measured, in one component already, or proven to be farther than t.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .components import components
from .token_files import scratch
from .words import lean, mix, word_runs

WIDTH = 5
PERCENT = 75
EXTRA = 4  # percent of a set that is added to its prefix
HOT = 64
LEAF = 64
PIVOT_ROUNDS = 1
BROADCAST_ROWS = 2_000_000
RUN_BYTES = 512 << 10  # of text that a worker takes apart at a time


def _ceil_percent(n, percent):
    return -(-n * percent // 100)


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for lo, _, words in word_runs(column, RUN_BYTES):
        hashes, bounds = words.shingles(WIDTH)
        for i in range(len(bounds) - 1):
            found = np.sort(hashes[bounds[i]:bounds[i + 1]])
            if len(found) > 1:
                keep = np.ones(len(found), dtype=bool)
                keep[1:] = found[1:] != found[:-1]
                found = found[keep]
            yield lo + i, found


def _name(found: np.ndarray) -> int:
    """64-bit name of a set; equal sets have equal names."""
    seed = np.array([len(found), int(np.bitwise_xor.reduce(mix(found + np.uint64(1)))), int(np.sum(found, dtype=np.uint64))], dtype=np.uint64)
    return int(mix(np.array([np.bitwise_xor.reduce(mix(seed * np.array([3, 5, 7], dtype=np.uint64)))], dtype=np.uint64)).view(np.int64)[0])


def _prefix(found: np.ndarray) -> np.ndarray:
    n = len(found)
    return found[: n - _ceil_percent(n, PERCENT) + _ceil_percent(n, EXTRA)]


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and name of every document's set."""
    for batch in batches:
        found = [(len(f), _name(f) if len(f) else 0) for _, f in _sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["doc_id", "n", "x"]
        )


def _new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Sets with their names, each once per task."""
    seen: set[int] = set()
    for batch in batches:
        for _, found in _sets(batch.column("text")):
            if len(found) and (name := _name(found)) not in seen:
                seen.add(name)
                yield name, found


def _dealt(sets: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def packed():
        lengths = [len(r[2]) for r in rows]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), lengths)), pa.array(np.repeat(np.array([r[1] for r in rows], np.int32), lengths)),
            pa.array(np.concatenate([r[2] for r in rows]).view(np.int64)),
        ], ["x", "n", "h"])

    for name, found in sets:
        rows.append((name, len(found), _prefix(found)))
        size += len(rows[-1][2])
        if size > 200_000:
            yield packed()
            rows, size = [], 0
    if rows:
        yield packed()


def _dealt_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _dealt(_new_sets(batches))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for name, data in zip(batch.column("x").to_pylist(), batch.column("set")):
            yield name, np.frombuffer(data.as_buffer(), dtype=np.uint64)


def _dealt_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _dealt(_stored(batches))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All shingles of stored sets."""
    for name, found in _stored(batches):
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(found), name, np.int64)), pa.array(np.full(len(found), len(found), np.int32)), pa.array(found.view(np.int64)),
        ], ["x", "n", "h"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for name, found in _new_sets(batches):
        rows.append((name, len(found), found.tobytes()))
        if len(rows) == 1000:
            yield _set_batch(rows)
            rows = []
    if rows:
        yield _set_batch(rows)


def _set_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["x", "n", "set"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sizes of the intersections of pairs of sets."""
    for batch in batches:
        both = []
        for a, b in zip(batch.column("set_x"), batch.column("set_y")):
            one, two = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both.append(len(np.intersect1d(one, two, assume_unique=True)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("x", "y", "nx", "ny")), pa.array(both, pa.int64())], ["x", "y", "nx", "ny", "both"]
        )


def _prefix_length(n: Column) -> Column:
    return n - F.ceil(n * PERCENT / F.lit(100)) + F.ceil(n * EXTRA / F.lit(100))


def _needed(n: Column) -> Column:
    """Shared prefix shingles that any link of a set of this size has at least."""
    least = F.ceil(n * PERCENT / F.lit(100))
    return F.ceil(least * EXTRA / F.lit(100))


def _may_link(n_x: Column, s_x: Column, n_y: Column, s_y: Column) -> Column:
    """Sizes n and shingles s that other sets have at all bound the similarity: the intersection is at most min(s)."""
    most = F.least(s_x, s_y)
    return most * 100 >= (n_x + n_y - most) * PERCENT


def _sized(df: DataFrame) -> DataFrame:
    """With a broadcast hint if a count proves it small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class _Space:
    """Sets, distances and components found so far."""

    def __init__(self, sets: DataFrame):
        self.sets = sets  # (x, n, set)
        self.tree: DataFrame | None = None  # (u, v): v is the component of u
        self.distances: DataFrame | None = None  # (x, y, d), both directions

    def measure(self, pairs: DataFrame) -> DataFrame:
        """(x, y), x < y -> (x, y, d, linked)."""
        pairs = _sized(_kept(pairs, "pairs"))
        with_x = self.sets.select("x", F.col("n").alias("nx"), F.col("set").alias("set_x")).join(pairs, "x")
        others = self.sets.join(_sized(pairs.select(F.col("y").alias("x")).distinct()), "x", "left_semi")
        both = with_x.join(others.select(F.col("x").alias("y"), F.col("n").alias("ny"), F.col("set").alias("set_y")), "y")
        found = both.select("x", "y", "nx", "ny", "set_x", "set_y").mapInArrow(lean(_measured), "x long, y long, nx int, ny int, both long")
        union = F.col("nx") + F.col("ny") - F.col("both")
        return _kept(found.select("x", "y", (1 - F.col("both") / union).alias("d"), (F.col("both") * 100 >= union * PERCENT).alias("linked")), "distances")

    def learn(self, pairs: DataFrame) -> None:
        """Measure pairs of (x, y), join their components, remember the distances."""
        found = self.measure(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        edges = found.filter("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
        edges = edges if self.tree is None else edges.union(self.tree)
        self.tree = components(edges).filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        spread = found.select("x", "y", "d").union(found.select("y", "x", "d"))
        self.distances = spread if self.distances is None else self.distances.union(spread)

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Rows with the component ``c`` of their set ``x``."""
        tree = _sized(self.tree.select(F.col("u").alias("x"), F.col("v").alias("_c")))
        return rows.join(tree, "x", "left").withColumn("c", F.coalesce("_c", "x")).drop("_c")


def clusters(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included).

    A set is the distinct 5-word shingles of the whole text, words lower-cased in A-Z; a text of fewer words is one
    shingle, a text without words (or null) has an empty set, links with nothing and keeps its own id.  Null ids are
    ignored in the minimum; a component of null ids only has a null id.  Repeated rows are equal sets.  Other columns
    are ignored; an empty table gives no rows.  Shingles and sets are known by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    space = _linked(rows)
    named = rows.mapInArrow(lean(_names), "doc_id long, n long, x long")
    labelled = _kept(named.withColumn("c", F.col("x")) if space is None else space.labelled(named), "labels")
    filled = labelled.filter("n > 0")
    least = filled.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = filled.join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = labelled.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns as they are.

    Of rows that repeat an id one stays.  Rows without an id cannot be told apart and stay.
    """
    found = clusters(docs, id_col=id_col, text_col=text_col)
    linked = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(_sized(_kept(linked, "linked")), id_col, "left_anti")
    again = _kept(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_col)), "again")
    if again.isEmpty():
        return kept.select(docs.columns)
    again = _sized(again)
    once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col])
    return kept.join(again, id_col, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def _by_cell(rows: DataFrame) -> DataFrame:
    """(x, n, h) -> also the number of sets of the cell and its pivot; one row per set and cell, cells of one set gone."""
    once = rows.repartition("h").dropDuplicates(["h", "x"])
    cell = W.partitionBy("h")
    return once.withColumn("size", F.count(F.lit(1)).over(cell)).filter("size > 1")


def _with_pivot(rows: DataFrame) -> DataFrame:
    rows = rows.filter(F.col("s") * 100 >= F.col("n") * PERCENT).withColumn("odd", F.round(-1000 * F.col("s") / F.col("n")).cast("int"))
    first = F.min(F.struct("odd", "x", "n", "s")).over(W.partitionBy("h"))
    return rows.withColumn("p", first).select(
        "h", "x", "n", "s", "odd", "least", F.col("p.x").alias("px"), F.col("p.n").alias("pn"), F.col("p.s").alias("ps")
    )


def _linked(rows: DataFrame) -> _Space | None:
    kind = "x long, n int, h long"
    shared = _by_cell(rows.select("text").mapInArrow(lean(_dealt_texts), kind))
    able = cut_lineage(
        shared.groupBy("x").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("all"), F.sum((F.col("size") > HOT).cast("int")).alias("hot"))
        .filter(F.col("all") >= _needed(F.col("n")))
        .withColumn("s", (F.col("n") - (_prefix_length(F.col("n")) - F.col("all"))).cast("int"))
    )
    if able.isEmpty():
        return None
    sets = rows.select("text").mapInArrow(lean(_whole_sets), "x long, n int, set binary").join(_sized(able.select("x")), "x", "left_semi")
    sets = _kept(sets.dropDuplicates(["x"]), "sets")
    space = _Space(sets)

    # Cells of at most HOT sets, and those of the sets that large cells could link, by shingles rare among these.
    heavy = _sized(able.filter(F.col("hot") >= _needed(F.col("n"))).select("x"))
    dealt = _by_cell(sets.select("x", "set").mapInArrow(lean(_dealt_sets), kind)).filter(F.col("size") <= HOT)
    # Of the shingles that two linked sets share, those of dropped cells are not counted.
    known = _sized(able.select("x", "hot", "s"))
    counted = dealt.join(known, "x").withColumn("least", F.ceil(F.col("n") * EXTRA / F.lit(100)) - F.col("hot"))
    small = _with_pivot(counted.withColumn("least", F.col("least").cast("int")))
    again = _by_cell(sets.join(heavy, "x", "left_semi").select("x", "set").mapInArrow(lean(_shingles), kind))
    # Shingles of one set among the heavy ones come first in its order and meet nobody.
    rank = F.row_number().over(W.partitionBy("x").orderBy("size", "h"))
    met = F.count(F.lit(1)).over(W.partitionBy("x"))
    # Two linked sets that share a rare shingle meet in the cell of a rare one, so in a cell of a common shingle only
    # common ones count for the intersection.
    common = F.sum((F.col("size") > LEAF).cast("int")).over(W.partitionBy("x"))
    place = again.withColumn("rank", rank + F.col("n") - met).withColumn("s", F.when(F.col("size") > LEAF, common).otherwise(met).cast("int"))
    rare = place.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * PERCENT / F.lit(100)) + 1).drop("size", "rank")
    large = _with_pivot(_by_cell(rare).withColumn("least", F.lit(0)))
    cells = _kept(small.unionByName(large), "cells")

    # 1. Voronoi regions: the pivot with most common cells.
    votes = cells.filter((F.col("x") != F.col("px")) & _may_link(F.col("n"), F.col("s"), F.col("pn"), F.col("ps"))).groupBy("x", "px").agg(F.count(F.lit(1)).alias("votes"))
    nearest = votes.groupBy("x").agg(F.max(F.struct("votes", "px")).alias("p"))
    space.learn(nearest.select("x", F.col("p.px").alias("y")))

    # 2. Next pivots of cells that stay large.
    left = _open(space, cells.select("h", "x", "n", "s", "odd", "least"))
    for _ in range(PIVOT_ROUNDS):
        wide = left.filter(F.col("size") > LEAF)
        first = wide.groupBy("h").agg(F.min(F.struct("odd", "x", "n", "s", "c")).alias("p"))
        met = wide.join(first, "h").filter((F.col("c") != F.col("p.c")) & _may_link(F.col("n"), F.col("s"), F.col("p.n"), F.col("p.s")))
        pairs = _kept(_ruled_out(space, met.select("x", F.col("p.x").alias("y")).distinct()), "regions")
        if pairs.isEmpty():
            break
        space.learn(pairs)
        left = _open(space, left.join(first.select("h", "p.x"), ["h", "x"], "left_anti").select("h", "x", "n", "s", "odd", "least"))

    # 3. What is left.
    pairs = _kept(_ruled_out(space, _leaf_pairs(left)), "leaves")
    if not pairs.isEmpty():
        space.learn(pairs)
    return space


def _open(space: _Space, cells: DataFrame) -> DataFrame:
    """The cells whose sets are of several components, with component and size."""
    rows = space.labelled(cells)
    cell = W.partitionBy("h")
    spans = rows.withColumn("size", F.count(F.lit(1)).over(cell)).withColumn("lo", F.min("c").over(cell)).withColumn("hi", F.max("c").over(cell))
    return _kept(spans.filter("lo <> hi").drop("lo", "hi"), "open")


def _leaf_pairs(cells: DataFrame) -> DataFrame:
    """Pairs of each cell across components, as far as they share shingles enough; cells above LEAF meet in blocks.

    An undecided pair finds all cells here that it shares: only cells above LEAF have lost pivots, and these need no
    number (``least`` is 0).
    """
    blocks = F.ceil(F.col("size") / LEAF).cast("int")
    own = cells.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("x"), F.col("blocks").cast("long")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("b1", F.least("b", "other")).withColumn("b2", F.greatest("b", "other"))
    a, b = met.alias("a"), met.alias("b")
    joined = a.join(
        b,
        (F.col("a.h") == F.col("b.h")) & (F.col("a.b1") == F.col("b.b1")) & (F.col("a.b2") == F.col("b.b2"))
        & (F.col("a.c") != F.col("b.c")) & (F.col("a.x") < F.col("b.x")) & _may_link(F.col("a.n"), F.col("a.s"), F.col("b.n"), F.col("b.s")),
    )
    return (
        joined.groupBy(F.col("a.x").alias("x"), F.col("b.x").alias("y"))
        .agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("a.least", "b.least")).alias("least"))
        .filter("shared >= least").select("x", "y")
    )


def _ruled_out(space: _Space, pairs: DataFrame) -> DataFrame:
    """Pairs without those that a common pivot r proves apart, |d(x, r) - d(y, r)| > t, and without measured ones."""
    known = space.distances
    best = known.groupBy("x").agg(F.min(F.struct("d", F.col("y").alias("r"))).alias("p")).select("x", F.col("p.d").alias("dx"), F.col("p.r").alias("r"))
    far = (
        pairs.join(best, "x")
        .join(known.select(F.col("x").alias("y"), F.col("y").alias("r"), F.col("d").alias("dy")), ["y", "r"])
        .filter(F.abs(F.col("dx") - F.col("dy")) > 1 - PERCENT / 100 + 1e-9)
        .select("x", "y")
    )
    return pairs.join(far.union(known.select("x", "y")).distinct(), ["x", "y"], "left_anti")
