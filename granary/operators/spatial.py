"""Searches over two coordinate columns: radius, k nearest, exact points, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.kernels import box, distance

DISTANCE = "_distance"


def _paged(rows: DataFrame, tie: list[str], limit: int, offset: int) -> DataFrame:
    rows = rows.orderBy(DISTANCE, *tie)
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit else rows


def within(rows: DataFrame, x: str, y: str, cx: float, cy: float, radius: float, tie: list[str], limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows at a distance of radius or less, nearest first. The square around the circle is what the reader prunes by."""
    near = rows.where(box(x, y, cx, cy, radius)).withColumn(DISTANCE, distance(x, y, cx, cy))
    return _paged(near.where(F.col(DISTANCE) <= float(radius)), tie, limit, offset)


def nearest(rows: DataFrame, x: str, y: str, cx: float, cy: float, k: int, tie: list[str], limit: int = 0, offset: int = 0) -> DataFrame:
    """The k nearest rows after offset; none if k is not positive. Planned as a top-k: no row is shuffled but the best of each partition."""
    if k <= 0:
        return rows.withColumn(DISTANCE, distance(x, y, cx, cy)).where(F.lit(False))
    return _paged(rows.withColumn(DISTANCE, distance(x, y, cx, cy)).where(F.col(DISTANCE).isNotNull()), tie, min(k, limit) if limit else k, offset)


def at(x: str, y: str, px: float, py: float) -> Column:
    return (F.col(x) == F.lit(float(px)).cast("float")) & (F.col(y) == F.lit(float(py)).cast("float"))


def extent(rows: DataFrame, x: str, y: str) -> tuple[float, float, float, float] | None:
    """Smallest and largest coordinates: min x, min y, max x, max y."""
    r = rows.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return None if r[0] is None else tuple(float(v) for v in r)


def cell_extents(rows: DataFrame, x: str, y: str, side: float) -> DataFrame:
    """Bounds and number of points of every grid cell that has any."""
    cells = rows.groupBy(F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy"))
    return cells.agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"), F.count("*").alias("n"))


def gridded(rows: DataFrame, layout: dict, tiles: int) -> tuple[DataFrame, dict]:
    """Rows with cell columns _cx and _cy, a cell's rows together unless they are too many for a task, and the layout with its origin and sides."""
    x, y = layout["by"]
    low = extent(rows, x, y) or (0.0, 0.0, 1.0, 1.0)
    sides = [max((low[i + 2] - low[i]) / tiles, 1e-9) for i in (0, 1)]
    layout = layout | {"origin": list(low[:2]), "sides": sides, "tiles": tiles}

    def cell(c: str, i: int) -> Column:
        return F.least(F.floor((F.col(c).cast("double") - low[i]) / sides[i]), F.lit(tiles - 1)).cast("int")

    laid = rows.withColumns({"_cx": cell(x, 0), "_cy": cell(y, 1)})
    return laid.hint("rebalance", "_cx", "_cy").sortWithinPartitions("_cx", "_cy", x, y), layout


def cells_around(circle: dict, layout: dict) -> Column:
    """The cells that the square around a circle meets, one more on each side for rounding; null cells hold null coordinates and are never met."""
    parts = []
    for c, name, i in (("x", "_cx", 0), ("y", "_cy", 1)):
        low, high = ((circle[c] + sign * circle["r"] - layout["origin"][i]) / layout["sides"][i] for sign in (-1, 1))
        clip = lambda v: int(max(-1, min(layout["tiles"], math.floor(v))))
        parts.append(F.col(name).between(clip(low) - 1, clip(high) + 1))
    return parts[0] & parts[1]


def points_json(rows: DataFrame, x: str, y: str, rid: str, cx: float, cy: float) -> DataFrame:
    """One row: the answer to a spatial query as JSON text."""
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(rid).alias("rid"), F.round(DISTANCE, 6).alias("distance"), F.lit("blue").alias("color"))
    query = F.struct(F.lit(float(cx)).alias("x"), F.lit(float(cy)).alias("y"), F.lit("red").alias("color"))
    listed = rows.agg(F.sort_array(F.collect_list(F.struct(F.col(DISTANCE).alias("d"), F.col(rid).alias("r"), point.alias("p")))).alias("found"), F.count("*").alias("total"))
    return listed.select(F.to_json(F.struct(query.alias("query_point"), F.transform("found", lambda f: f["p"]).alias("results"), "total")).alias("envelope"))
