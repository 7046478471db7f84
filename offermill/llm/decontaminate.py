"""Benchmark decontamination: SimHash of windows of the items' sizes, candidates by shared shingles.

A document holds an item when some window of as many words as the item has a weighted 5-word shingle similarity of
0.75 or more with it.  A window without any shingle of the item has similarity 0, and the best window of a document
begins at such a shingle (moving a window right to its first one loses none), so these windows alone are tried.

A window that similar shares three quarters of the item's shingles or more, so documents in which fewer places hold
shingles of the item are left out before any window is made.  No candidate is ruled out by its fingerprint: at 0.75,
SimHashes may differ in more bits than an index can look up.  The 64-bit SimHash of the words, each word as heavy as it
is frequent, only gives the distance that is reported.  Candidates are decided by the exact similarity of the two
shingle multisets, sum of minima over sum of maxima.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

WIDTH = 5
PERCENT = 75
# The former multi-index; nothing is decided by it any more, a test still reads it.
BLOCKS = 4
BLOCK_BITS = 16
BLOCK_RADIUS = 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BROADCAST_ROWS = 2_000_000

MASKS = [sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), r)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _shingle_hashes(k: int) -> Column:
    """Hashes of the k-word shingles of ``word_hashes``, in order."""
    parts = ", ".join(f"word_hashes[i + {j}]" for j in range(k))
    return F.expr(f"transform(sequence(0, n - {k}), i -> xxhash64({parts}))")


def _with_words(df: DataFrame, text: Column) -> DataFrame:
    return (
        df.withColumn("words", words(text))
        .withColumn("n", F.size("words"))
        .withColumn("word_hashes", F.expr("transform(words, w -> xxhash64(w))"))
    )


def simhash(hashes: str) -> Column:
    """Bit b is set when more than half of the hashes have it; two 32-bit counters share a long."""
    sums = (
        f"aggregate({hashes}, array_repeat(0L, 32), (acc, h) -> transform(acc, (a, j) -> a + (shiftrightunsigned(h, j) & 4294967297L)))"
    )
    size = f"size({hashes})"
    bits = (
        "aggregate(sequence(0, 31), 0L, (f, j) -> f"
        f" | shiftleft(IF(2 * (s[j] & 4294967295L) > {size}, 1L, 0L), j)"
        f" | shiftleft(IF(2 * shiftrightunsigned(s[j], 32) > {size}, 1L, 0L), j + 32))"
    )
    return F.expr(f"element_at(transform(array({sums}), s -> {bits}), 1)")


def _tagged(words: str, k: str) -> Column:
    """Shingles with their number of occurrence, so that set operations respect multiplicity."""
    shingles = f"transform(sequence(0, size({words}) - {k}), i -> array_join(slice({words}, i + 1, {k}), ' '))"
    plain = "transform(s, x -> concat(x, '\\n0'))"
    counted = "transform(s, (x, i) -> concat(x, '\\n', size(filter(slice(s, 1, i), y -> y = x))))"
    return F.expr(f"element_at(transform(array({shingles}), s -> IF(size(array_distinct(s)) = size(s), {plain}, {counted})), 1)")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    items = _with_words(benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")), F.col("text"))
    items = items.filter("n > 0").withColumn("k", F.least("n", F.lit(WIDTH))).drop("text")
    return items.withColumn("item_key", F.xxhash64("item_id", "words")).dropDuplicates(["item_key"])


def _sized(df: DataFrame) -> DataFrame:
    """With a broadcast hint if a count proves it small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, start, item_key, window): every window of a size of an item that begins at a shingle of this
    item, in documents with enough of its shingles."""
    base = _with_words(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")), F.col("text")
    ).drop("text")
    out = None
    for (k,) in sorted(tuple(r) for r in items.select("k").distinct().collect()):  # 1 to 5
        wanted = items.filter(F.col("k") == k)
        anchors = _sized(wanted.select(F.explode(_shingle_hashes(k)).alias("shingle"), F.col("n").alias("size"), "item_key").distinct())
        placed = base.filter(F.col("n") >= k).select("doc_id", "text_hash", "n", F.posexplode(_shingle_hashes(k)).alias("at", "shingle"))
        start = F.least(F.col("at"), F.greatest(F.lit(0), F.col("n") - F.col("size")))
        met = placed.join(anchors, "shingle").groupBy("doc_id", "text_hash", "item_key", "size").agg(F.count(F.lit(1)).alias("places"), F.collect_set(start).alias("starts"))
        found = met.filter(F.col("places") * 100 >= (F.col("size") - k + 1) * PERCENT).select("doc_id", "text_hash", "item_key", "size", "starts")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return base.selectExpr("doc_id", "text_hash", "0 AS start", "0L AS item_key", "words AS window").limit(0)
    pairs = _sized(cut_lineage(out))
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    held = base.select("doc_id", "text_hash", "words").alias("d").join(pairs.alias("p"), same)
    return held.select("d.doc_id", "d.text_hash", "d.words", "p.item_key", "p.size", F.explode("p.starts").alias("start")).select(
        "doc_id", "text_hash", "start", "item_key", F.expr("slice(words, start + 1, size)").alias("window")
    )


def matches(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document and item that it holds: doc_id, text_hash, item_id, similarity, hamming, start, n_words.

    The row tells of the best window (then the first).  Words are runs of characters other than ASCII white space, in
    lower case.  Items of fewer than five words have their whole sequence as their one shingle; documents shorter than
    an item are one window.  Null, empty and blank texts hold nothing and are held by nothing.  Repeated rows and
    repeated items are reported once; null ids are ids like others.  Other columns are ignored; if either table is
    empty, there are no rows.
    """
    items = _items(benchmark, item_col, item_text_col)
    prints = items.select("item_key", "item_id", "k", F.col("words").alias("item_words"), simhash("word_hashes").alias("item_print"))
    windows = _windows(docs, items, id_col, text_col)
    windows = windows.withColumn("hashes", F.expr("transform(window, w -> xxhash64(w))"))
    pairs = windows.join(_sized(prints), "item_key")
    ready = pairs.filter(F.size("window") >= F.col("k")).withColumn("a", _tagged("window", "k")).withColumn("b", _tagged("item_words", "k"))
    common = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - F.col("common")
    scored = ready.withColumn("common", common).withColumn("union", union).filter(F.col("common") * 100 >= F.col("union") * PERCENT)
    scored = scored.withColumn("hamming", F.bit_count(simhash("hashes").bitwiseXOR(F.col("item_print"))))
    best = F.max(F.struct((F.col("common") / F.col("union")).alias("similarity"), (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"), F.size("window").alias("n_words")))
    return scored.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("m")).select(
        "doc_id", "text_hash", "item_id", "m.similarity", (-F.col("m.h")).alias("hamming"), (-F.col("m.s")).alias("start"), "m.n_words"
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are."""
    held = _sized(matches(docs, benchmark, id_col=id_col, text_col=text_col, **columns).select("doc_id", "text_hash").distinct())
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("h.text_hash"))
    return docs.alias("d").join(held.alias("h"), same, "left_anti")
