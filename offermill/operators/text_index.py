"""Substring search by trigrams instead of a scan of all texts.

Rows are numbered when the index is written.  For every field and trigram of its lower-cased text the index holds, per
32,768 rows, a bitmap of the rows that have it.  ``ilike '%q%'`` needs all trigrams of the literal parts of ``q``: the
bitmaps are intersected, only folders and rows that remain are read, and every one of them is put to the ``ilike`` test
itself.  So the result is that of the scan for every ``q``; one without three literal characters in a row is a scan.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.bitmaps import has_bit

GRAM = 3
FOLDER_BITS = 6  # buckets of 32,768 rows per folder, as a power of two
_CONTEXT = re.compile("[σςΣ]")  # lower case depends on the letters around it


def _lower_grams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased text; none for a null or shorter one."""
    low = F.lower(text)
    last = F.length(low) - (GRAM - 1)
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(last >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def write_index(deals: DataFrame, root: str, fields: list[str], *, partitions: int | None = None) -> None:
    """``{root}/rows`` (the deals, numbered) and ``{root}/grams`` (the bitmaps), from the rows as written.

    ``partitions`` deals the rows out first; each partition numbers its own.
    """
    spark = deals.sparkSession
    dealt = deals if partitions is None else deals.repartition(partitions)
    numbered = dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_folder", F.shiftright("_row", 15 + FOLDER_BITS))
    numbered.write.mode("overwrite").partitionBy("_folder").parquet(f"{root}/rows")
    described = spark.createDataFrame([(numbered.schema.json(),)], "schema string")
    described.write.mode("overwrite").text(f"{root}/schema")  # an empty table has no files to take it from
    rows = _stored(spark, root)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), _lower_grams(F.col(f)).alias("grams")) for f in fields])
    flat = (
        rows.select("_folder", "_row", F.explode(pairs).alias("p"))
        .select("_folder", "_row", "p.field", F.explode("p.grams").alias("gram"))
        .withColumn("bucket", F.bitmap_bucket_number("_row"))
    )
    # Row numbers are shuffled, not half-filled bitmaps.
    maps = (
        flat.repartition("gram", "bucket")
        .groupBy("field", "gram", F.col("_folder").alias("folder"), "bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("rows"))
    )
    maps.repartitionByRange("gram").sortWithinPartitions("gram", "field").write.mode("overwrite").parquet(f"{root}/grams")


def _stored(spark: SparkSession, root: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(spark.read.text(f"{root}/schema").first()[0]))
    return spark.read.schema(schema).parquet(f"{root}/rows")


def needed_grams(spark: SparkSession, q: str) -> list[str]:
    """Trigrams that every match of ``%q%`` has.  ``%``, ``_`` and escapes end a literal part."""
    parts = [p for p in re.split(r"\\.?|[%_]", q) if len(p) >= GRAM]
    if not parts:
        return []
    grams = F.flatten(F.array(*[_lower_grams(F.lit(p)) for p in parts]))
    found = spark.range(1).select(F.array_sort(F.array_distinct(grams))).first()[0]
    return [g for g in found if not _CONTEXT.search(g)]


def candidates(spark: SparkSession, root: str, q: str, fields: list[str]) -> DataFrame | None:
    """(folder, bucket, rows) that may match in one of the fields; None if every row may."""
    grams = needed_grams(spark, q)
    if not grams:
        return None
    return (
        spark.read.parquet(f"{root}/grams")
        .filter(F.col("gram").isin(grams) & F.col("field").isin(fields))
        .groupBy("field", "folder", "bucket")
        .agg(F.bitmap_and_agg("rows").alias("rows"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == len(grams))
        .groupBy("folder", "bucket")
        .agg(F.bitmap_or_agg("rows").alias("rows"))
        .filter(F.bitmap_count("rows") > 0)
    )


def matching(spark: SparkSession, root: str, q: str, fields: list[str], *, verified: bool = True) -> DataFrame:
    """Deals with ``q`` in one of the fields, as ``ilike '%q%'`` finds them; unverified, those put to that test.

    Filters of ``query.filter_deals`` go on top.  An empty ``q`` matches every deal with a text.
    """
    rows = _stored(spark, root)
    found = candidates(spark, root, q, fields)
    if found is not None:
        held = found.select(F.col("folder").alias("_folder"), F.col("bucket").alias("_bucket"), F.col("rows").alias("_rows"))
        placed = rows.withColumn("_bucket", F.bitmap_bucket_number("_row"))
        rows = placed.join(held, ["_folder", "_bucket"]).filter(has_bit(F.col("_rows"), F.col("_row"))).drop("_bucket", "_rows")
    if verified:
        rows = rows.filter(reduce(lambda a, b: a | b, [F.col(f).ilike(f"%{q}%") for f in fields]))
    return rows.drop("_row", "_folder")
