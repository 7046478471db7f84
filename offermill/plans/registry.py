"""Named queries over the domain views, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Domain views and base tables of one data folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows dealt over all cores for heavy work per row: a table of one row group is one task otherwise."""
        return df.repartition(self.spark.sparkContext.defaultParallelism)


def query(oracle: str | None = None, *, views: bool = True):
    """Register ``fn(tables) -> DataFrame`` under its own name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = with_views(oracle) if views else oracle
        return fn

    return register


def stamp(c: str | Column) -> Column:
    """Timestamp as text, so that both engines hash the same value."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def joined(name: str, separator: str = "; ") -> Column:
    return F.array_join(F.col(name).cast("array<string>"), separator).alias(name)
