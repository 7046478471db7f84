"""Radius join on an adaptive quadtree, for points whose radii differ by orders of magnitude.

The map is cut into 2^l x 2^l cells on level l.  A cell with more than ``rows_per_leaf`` deals is split into its four
children, down to the finest level; the undivided cells are the leaves, and a deal lies in one of them.  A point goes to
the level whose cells are just larger than its circle, where the circle touches four at most, and from there to the
leaves below these cells that it reaches, or to the leaf above them.  So small circles meet small leaves in crowded
regions, large ones meet large leaves in empty ones, and no task holds more than a leaf of deals for a point.

All joins are equi-joins on cells.  The tree is a small table: one row per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage

FINEST = 18  # cells of about 76 by 150 m at the equator
ROWS_PER_LEAF = 10_000
CELL = ["level", "x", "y"]


def _side(level: Column) -> Column:
    """Cells along one side of the map."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))


def _x(lon: Column, level: Column) -> Column:
    return F.floor((lon + 180) / 360 * _side(level)).cast("long")


def _y(lat: Column, level: Column) -> Column:
    return F.greatest(F.least(F.floor((lat + 90) / 180 * _side(level)).cast("long"), _side(level) - 1), F.lit(0).cast("long"))


def _ancestors(cells: DataFrame, lowest: Column) -> DataFrame:
    """Every cell once for itself (if ``lowest`` is its level) and each of its ancestors: adds up_level, up_x, up_y."""
    up = cells.withColumn("up_level", F.explode(F.sequence(F.lit(0), lowest)))
    shift = F.col("level") - F.col("up_level")
    return up.withColumns({f"up_{n}": F.call_function("shiftright", F.col(n), shift) for n in ("x", "y")})


def _finest(deals: DataFrame, finest: int) -> DataFrame:
    level = F.lit(finest)
    return deals.withColumns({"_x": F.pmod(_x(F.col("lon"), level), _side(level)), "_y": _y(F.col("lat"), level)})


def leaves(deals: DataFrame, *, rows_per_leaf: int = ROWS_PER_LEAF, finest: int = FINEST) -> DataFrame:
    """The tree of the deals (with lat and lon): level, x, y, rows.  Only counts of cells are shuffled."""
    cells = _finest(deals.select("lat", "lon"), finest).groupBy(F.col("_x").alias("x"), F.col("_y").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    placed = _ancestors(cells.withColumn("level", F.lit(finest)), F.col("level"))
    counts = placed.groupBy("up_level", "up_x", "up_y").agg(F.sum("n").alias("rows"))
    counts = counts.select(*[F.col(f"up_{n}").alias(n) for n in CELL], "rows")
    full = counts.filter(F.col("rows") > rows_per_leaf)
    split = full.filter(F.col("level") < finest).select((F.col("level") + 1).alias("level"), *[F.col(n).alias(f"p_{n}") for n in ("x", "y")])
    below_split = counts.withColumns({"p_x": F.shiftright("x", 1), "p_y": F.shiftright("y", 1)}).join(split, ["level", "p_x", "p_y"], "left_semi")
    whole = (F.col("rows") <= rows_per_leaf) | (F.col("level") == finest)
    return below_split.filter(whole).select(*CELL, "rows").unionByName(counts.filter((F.col("level") == 0) & whole))


def _reach(points: DataFrame, finest: int) -> DataFrame:
    """Adds the half sides of the circle's box, the level of the point and the cells of that level that the box touches."""
    angle = F.col("radius_m") * geo.METERS_TO_MILES / geo.EARTH_RADIUS_MILES
    ratio = F.sin(angle) / F.greatest(F.cos(F.radians("q_lat")), F.lit(1e-12))
    polar = (F.abs("q_lat") + F.degrees(angle) >= 90) | (ratio >= 1)
    boxed = points.withColumns(
        {
            "_dy": F.degrees(angle) + 1e-9,
            "_dx": F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9),
        }
    )
    fits = F.floor(F.log2(F.least(F.lit(180.0) / (F.col("_dy") * 2), F.lit(360.0) / (F.col("_dx") * 2))))
    leveled = boxed.withColumn("level", F.greatest(F.least(fits, F.lit(finest)), F.lit(0)).cast("int"))
    level = F.col("level")
    ys = F.sequence(_y(F.col("q_lat") - F.col("_dy"), level), _y(F.col("q_lat") + F.col("_dy"), level))
    xs = F.sequence(_x(F.col("q_lon") - F.col("_dx"), level), _x(F.col("q_lon") + F.col("_dx"), level))
    wrapped = F.array_distinct(F.transform(xs, lambda v: F.pmod(v, _side(level))))
    return leveled.withColumn("y", F.explode(ys)).withColumn("x", F.explode(wrapped))


def _touches() -> Column:
    """Whether the box of the point and the leaf overlap."""
    side = _side(F.col("f_level"))
    low = F.col("f_y") * 180 / side - 90
    middle = (F.col("f_x") + 0.5) * 360 / side - 180
    away = F.abs(F.pmod(middle - F.col("q_lon") + 180, F.lit(360.0)) - 180)
    return (
        (low <= F.col("q_lat") + F.col("_dy")) & (low + F.lit(180.0) / side >= F.col("q_lat") - F.col("_dy"))
        & (away <= F.col("_dx") + F.lit(180.0) / side)
    )


def touched_leaves(points: DataFrame, tree: DataFrame, *, finest: int = FINEST) -> DataFrame:
    """Points with each leaf that their circle may reach: all columns of the points, leaf (level, x, y)."""
    cells = _reach(points, finest)
    flat = tree.select(*CELL)
    # Leaves at or below a cell of the point: each leaf is listed under itself and its ancestors.
    under = _ancestors(flat, F.col("level")).select(*[F.col(f"up_{n}").alias(n) for n in CELL], *[F.col(n).alias(f"f_{n}") for n in CELL])
    inside = cells.join(under, CELL)
    # The leaf above all cells of the point, if they lie within one.
    rising = _ancestors(cells.filter("level > 0"), F.col("level") - 1).drop(*CELL)
    above = rising.join(flat.select(*[F.col(n).alias(f"f_{n}") for n in CELL]), [F.col(f"up_{n}") == F.col(f"f_{n}") for n in CELL])
    found = inside.drop(*CELL).unionByName(above.drop(*[f"up_{n}" for n in CELL])).filter(_touches())
    leaf = F.struct(*[F.col(f"f_{n}").alias(n) for n in CELL]).alias("leaf")
    # Cells of one point may lie under one leaf; a point is a row of its own even if another is equal to it.
    return found.select(*points.columns, leaf).dropDuplicates(["query_id", "leaf"])


def place(deals: DataFrame, tree: DataFrame, *, finest: int = FINEST) -> DataFrame:
    """Deals with the leaf they lie in."""
    fine = _finest(deals, finest)
    cells = fine.select(F.col("_x").alias("x"), F.col("_y").alias("y")).distinct().withColumn("level", F.lit(finest))
    found = _ancestors(cells, F.col("level")).join(tree.select(*[F.col(n).alias(f"up_{n}") for n in CELL]), [f"up_{n}" for n in CELL])
    leaf = F.struct(*[F.col(f"up_{n}").alias(n) for n in CELL]).alias("leaf")
    return fine.join(found.select(F.col("x").alias("_x"), F.col("y").alias("_y"), leaf), ["_x", "_y"]).drop("_x", "_y")


def candidates(points: DataFrame, deals: DataFrame, tree: DataFrame | None = None, *, rows_per_leaf: int = ROWS_PER_LEAF, finest: int = FINEST) -> DataFrame:
    """Points (query_id unique, q_lat, q_lon, radius_m) with the deals of every leaf that their circles touch, and the distance."""
    if tree is None:
        tree = cut_lineage(leaves(deals, rows_per_leaf=rows_per_leaf, finest=finest))
    met = touched_leaves(points, tree, finest=finest).join(place(deals, tree, finest=finest), "leaf").drop("leaf")
    return met.withColumn("distance_miles", geo.miles_between(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")))


def within_radius(points: DataFrame, deals: DataFrame, tree: DataFrame | None = None, **options) -> DataFrame:
    """Points joined with every deal inside their circle, as ``ranking.within_radius`` gives them."""
    near = candidates(points, deals, tree, **options)
    return near.filter(F.col("distance_miles") <= F.col("radius_m") * geo.METERS_TO_MILES)
