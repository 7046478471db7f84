"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected ``target / size of the source`` times.  The running sum of these
expectations starts at one random offset; a document is emitted once for each integer that its step crosses.  Documents
run in order of their size, so the words taken differ from the target by little more than one document.

The running sum is carried over three levels (size class, bucket of the class, document), so no task sorts a source:
a bucket holds a thousandth of one size class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(key: Column, digits: int = 8) -> Column:
    """0 <= u < 1 from the key alone, so that reruns agree."""
    number = F.conv(F.substring(F.sha2(key, 256), 1, digits), 16, 10).cast("double")
    return number / F.lit(float(16**digits))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(_source, _source_size) -> also _target: shares by weight, at most ``most`` times the size, the excess reshared.

    Weights repeat along the sources in code point order, null last.  One row per source; with caps c and weights w
    the water level L solves sum(min(c, L w)) = share * sum(sizes).
    """
    place = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("_source", "_source_size", weight.cast("long").alias("_w")).withColumn(
        "_cap", F.col("_source_size") * most
    )
    rising = W.orderBy(F.col("_cap").cast("double") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_w").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("_source_size").over(everything.orderBy(F.lit(1))).cast("double") * share
    level = (total - before) / left
    leveled = ranked.withColumn("_level", F.when(F.col("_cap").cast("double") / F.col("_w") >= level, level))
    highest = F.max("_level").over(everything.orderBy(F.lit(1)))  # later sources would leave less
    return leveled.select(
        "_source",
        "_source_size",
        F.least(F.col("_cap").cast("double"), F.coalesce(highest, F.lit(0.0)) * F.col("_w")).alias("_target"),
    )


def allot(
    docs: DataFrame,
    *,
    source_col: str = "source",
    id_col: str = "doc_id",
    size: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = "mix",
    buckets: int = BUCKETS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row once: its ``carry`` columns as the struct ``row``, then doc_id, source, size, source_size, target, copies.

    Null sources form one source, null texts have size 0; a source of size 0 has target 0 and gives no rows.  Repeated
    rows are documents of their own; which of two rows with one id and size is taken more often has no meaning.  An
    empty table gives no rows.  Names of other columns do not matter, as they travel inside ``row``.
    """
    size = words(F.col("text")) if size is None else size
    kept = docs.columns if carry is None else carry
    bit = F.length(F.bin("_size"))
    base = (
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(None).alias("row"),
            F.col(id_col).cast("long").alias("_id"),
            F.col(source_col).alias("_source"),
            size.alias("_size"),
        )
        .withColumn("_class", (bit * 8 + F.expr("IF(length(bin(_size)) > 3, shiftright(_size, length(bin(_size)) - 4) & 7, 0)")).cast("int"))
        .withColumn("_bucket", F.floor(_uniform(F.coalesce(F.col("_id").cast("string"), F.lit(""))) * buckets).cast("int"))
    )
    counts = base.groupBy("_source", "_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"))
    classes = counts.groupBy("_source", "_class").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    goals = targets(classes.groupBy("_source").agg(F.sum("_s").alias("_source_size")), weights, share, most)

    earlier = W.rowsBetween(W.unboundedPreceding, -1)
    classes = classes.select(
        "_source", "_class", F.coalesce(F.sum("_n").over(earlier.partitionBy("_source").orderBy("_class")), F.lit(0)).alias("_above")
    )
    source_is = F.col("l._source").eqNullSafe(F.col("r._source"))
    starts = (
        classes.alias("l").join(goals.alias("r"), source_is).select("l.*", "r._source_size", "r._target")
    )
    in_class = earlier.partitionBy("_source", "_class").orderBy("_bucket")
    chunks = (
        counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(in_class), F.lit(0)))
        .alias("l")
        .join(starts.alias("r"), source_is & (F.col("l._class") == F.col("r._class")))
        .select("l._source", "l._class", "l._bucket", (F.col("_earlier") + F.col("_above")).alias("_start"), "_source_size", "_target")
    )
    same = source_is & (F.col("l._class") == F.col("r._class")) & (F.col("l._bucket") == F.col("r._bucket"))
    in_chunk = W.partitionBy("_source", "_class", "_bucket").orderBy("_size", "_id")
    numbered = base.withColumn("_row", F.row_number().over(in_chunk))
    placed = numbered.alias("l").join(chunks.alias("r"), same).select("l.*", "_start", "_source_size", "_target")
    expected = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    offset = _uniform(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_source"), F.lit(""))))
    upto = F.col("_start") + F.col("_row")
    crossed = F.floor(offset + expected * upto) - F.floor(offset + expected * (upto - 1))
    return placed.select(
        "row",
        F.col("_id").alias("doc_id"),
        F.col("_source").alias("source"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        crossed.cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as ``allot`` says, with the columns of ``docs``."""
    placed = allot(docs, **options).filter("copies > 0")
    return placed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    return allot(docs, carry=[], **options).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def oracle(docs: str = "documents", seed: str = "mix", rows: str = "doc_id, size, source_size, target, size * copies AS taken, copies") -> str:
    """The same in SQL; ``docs`` names a table or a bracketed query."""
    uniform = "CAST('0x' || substr(sha256({}), 1, 8) AS UBIGINT)::DOUBLE / 4294967296.0"
    return rf"""
WITH m_d AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}
), m_b AS (
  SELECT *, (length(bin(size)) * 8 + CASE WHEN length(bin(size)) > 3 THEN (size >> (length(bin(size)) - 4)::INT) & 7 ELSE 0 END)::INT AS class,
         floor({uniform.format("coalesce(doc_id::VARCHAR, '')")} * {BUCKETS})::INT AS bucket
  FROM m_d
), m_s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM m_b GROUP BY source
), m_w AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS w, source_size * {MOST} AS cap FROM m_s
), m_l AS (
  SELECT *, ((SELECT sum(source_size) FROM m_w)::DOUBLE * {SHARE}
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM m_w
), m_t AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT coalesce(max(level), 0.0) FROM m_l WHERE cap::DOUBLE / w >= level) * w) AS target FROM m_l
), m_o AS (
  SELECT b.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY b.source ORDER BY class, bucket, size, doc_id NULLS FIRST) AS upto,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS expected,
         {uniform.format(f"'{seed}:' || coalesce(b.source, '')")} AS start
  FROM m_b b JOIN m_t t ON b.source IS NOT DISTINCT FROM t.source
), m_c AS (
  SELECT *, (floor(start + expected * upto) - floor(start + expected * (upto - 1)))::BIGINT AS copies FROM m_o
)
SELECT {rows} FROM m_c
"""


ORACLE = oracle()
