"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_TASK = 2_000_000


def work_partitions(df: DataFrame) -> int:
    """Partitions for work that is heavy per row; small rows must not be merged into few tasks."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """Keys with more rows than one task should take, and the number of parts to cut them into.

    There are at most ``rows / rows_per_task`` of them, so the result is always small
    enough to broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
    return counts.select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread_by: Column,
    *,
    condition: Column | None = None,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    partitions: int | None = None,
) -> DataFrame:
    """Equi-join in which only hot keys of ``big`` are cut into parts.

    Rows of a hot key are spread over parts by a hash of ``spread_by``; the matching rows
    of ``small`` are repeated once per part.  All other keys join as they are.  ``partitions``
    keeps small inputs with many partners from being merged into few tasks.
    """
    hot = F.broadcast(hot_keys(big, keys, rows_per_task))
    left = big.join(hot, keys, "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_parts").cast("long")), F.lit(0).cast("long"))
    )
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1)
    right = small.join(hot, keys, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    left = left.drop("_parts")
    if partitions is not None:
        left, right = (df.repartition(partitions, *keys, "_part") for df in (left, right))
    out = left.join(right, keys + ["_part"], how)
    if condition is not None:
        out = out.filter(condition)
    return out.drop("_part")


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row results as the columns of one row, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def running_counts(
    df: DataFrame, key: str, order: list[str], chunk: Column, flags: dict[str, Column]
) -> DataFrame:
    """Running count of each flag per key in event order, the current row included.

    ``chunk`` must not decrease along ``order`` within a key.  Counts are first summed per (key, chunk),
    then carried over the chunks of a key; rows are only ever sorted within one chunk.
    """
    base = df.withColumn("_chunk", chunk)
    for name, flag in flags.items():
        base = base.withColumn(name, F.coalesce(flag, F.lit(False)).cast("long"))
    sums = base.groupBy(key, "_chunk").agg(*[F.sum(n).alias(f"_sum_{n}") for n in flags])
    earlier = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        key, "_chunk", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in flags]
    )
    within = W.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = base.join(carried, [key, "_chunk"])
    return out.select(
        *df.columns, *[(F.sum(n).over(within) + F.col(f"_before_{n}")).alias(n) for n in flags]
    )


def range_parts(df: DataFrame, key: str, order: list[str], rows_per_part: int) -> DataFrame:
    """Rows dealt into ranges of (key, order) of about ``rows_per_part`` rows, with the number of the range as ``_part``.

    A key with many rows spans several ranges, however close its rows lie in order.  The rows are written once, so that
    all that follows sees the same ranges.
    """
    parts = max(1, -(-df.count() // rows_per_part))
    return cut_lineage(df.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()))


def running_counts_scan(df: DataFrame, key: str, order: list[str], flags: dict[str, Column], rows_per_part: int = ROWS_PER_TASK) -> DataFrame:
    """``running_counts`` as a prefix scan: counts within each range, after the sums of the key's earlier ranges.

    Rows that agree in key and order lie in one range; no task holds more than a range.
    """
    flagged = df.withColumns({n: F.coalesce(f, F.lit(False)).cast("long") for n, f in flags.items()})
    placed = range_parts(flagged, key, order, rows_per_part)
    sums = placed.groupBy(key, "_part").agg(*[F.sum(n).alias(f"_sum_{n}") for n in flags])
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        key, "_part", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in flags]
    )
    within = W.partitionBy("_part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = placed.join(carried, [key, "_part"])
    return out.select(*df.columns, *[(F.sum(n).over(within) + F.col(f"_before_{n}")).alias(n) for n in flags])


def previous_value(df: DataFrame, keys: list[str], order: str, value: str, chunk: Column, alias: str) -> DataFrame:
    """``value`` of the preceding row of the key; the two-level form of ``lag`` (see above)."""
    base = df.withColumn("_chunk", chunk)
    lasts = base.groupBy(*keys, "_chunk").agg(F.max_by(value, order).alias("_last"))
    carried = lasts.select(
        *keys, "_chunk", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_carried")
    )
    within = W.partitionBy(*keys, "_chunk").orderBy(order)
    out = base.join(carried, keys + ["_chunk"])
    return out.select(*df.columns, F.coalesce(F.lag(value).over(within), F.col("_carried")).alias(alias))
