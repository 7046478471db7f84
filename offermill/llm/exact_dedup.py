"""Exact duplicates by skew-safe combining of whole contents.

Contents are combined three times: inside a map task, per (digest, salt) and per digest.  Each time the whole content
is the grouping key, so a digest only decides where a row goes.  A content that a third of all rows share reaches the
second step as one row per map task and salt and the third as one row per salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BLANKS = " \t\n\x0b\f\r"


def squeezed(text: Column) -> Column:
    """The text without its ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank))
    return out


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


# Longest text first, then the smallest id, a null id last: one number per row, so that a hash aggregate can hold it.
_STEP = "36893488147419103232BD"  # 2^65
_TOP = "9223372036854775808BD"  # 2^63


def _rank(chars: Column, doc_id: Column) -> Column:
    low = F.coalesce(F.expr(_TOP) - doc_id.cast("decimal(19,0)"), F.lit(0).cast("decimal(20,0)"))
    return (chars.cast("decimal(10,0)") * F.expr(_STEP) + low).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    low = rank % F.expr(_STEP)
    return F.when(low > 0, (F.expr(_TOP) - low).cast("long"))


def duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 64,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after ASCII white space is deleted.  The longest original text of a group stays
    (in code points), among these the smallest id.  Null texts count as empty and form one group with empty and blank
    ones.  A null id stays only if no row of its length has an id.  Rows that repeat the id and the length of the row
    that stays are that document once more: they all are ``kept``.  Other columns are ignored, an empty table gives
    no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        squeezed(F.col(text_col)).alias("content"),
        F.coalesce(F.char_length(text_col), F.lit(0)).alias("chars"),
    ).withColumn("digest", digest(F.col("content")))

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "chars"), F.lit(salts)).cast("int")).withColumn(
        "rank", _rank(F.col("chars"), F.col("doc_id"))
    )
    # Map-side this is the local step; after the shuffle it is the step per salt.
    by_salt = salted.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    by_digest = (
        by_salt.repartition("digest").groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
    )
    # Still one partition per digest: contents are counted where they lie.
    groups = cut_lineage(
        by_digest.groupBy("digest").agg(
            F.max("rank").alias("rank"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("contents")
        )
    )

    members = rows.select("doc_id", "chars", "digest", F.sha2("content", 256).alias("text_sha256"))
    out = members.join(groups.filter("contents = 1").drop("contents"), "digest")
    clash = groups.filter("contents > 1").select("digest")
    if not clash.isEmpty():  # different contents under one digest: these meet by content
        exact = rows.join(clash, "digest", "left_semi")
        winners = by_digest.join(clash, "digest", "left_semi").select("digest", "content", "rank", F.col("n").alias("group_size"))
        apart = exact.join(winners, ["digest", "content"])
        out = out.unionByName(
            apart.select("digest", "doc_id", "chars", F.sha2("content", 256).alias("text_sha256"), "rank", "group_size")
        )
    return out.select(
        "doc_id",
        _id_of(F.col("rank")).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (_rank(F.col("chars"), F.col("doc_id")) == F.col("rank")).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), w AS (
  SELECT doc_id, content, chars,
         first_value(doc_id) OVER g AS keep_id, first_value(chars) OVER g AS best,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM t WINDOW g AS (PARTITION BY content ORDER BY chars DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, chars = best AND doc_id IS NOT DISTINCT FROM keep_id AS kept,
       sha256(content) AS text_sha256
FROM w
"""
