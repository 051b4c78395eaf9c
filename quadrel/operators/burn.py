"""Burning lines into grids: a cell is touched if its square meets the segment; later paint covers earlier.

A segment is exploded over the cells of its own box and an exact test decides, so its cost is its
extent; which paint stays is an aggregate over a total key, never the order of writing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meets_square(cx: Column, cy: Column, half: Column, ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Separating axes of a square and a segment."""
    over_x = (F.least(ux, vx) <= cx + half) & (F.greatest(ux, vx) >= cx - half)
    over_y = (F.least(uy, vy) <= cy + half) & (F.greatest(uy, vy) >= cy - half)
    dx, dy = vx - ux, vy - uy
    return over_x & over_y & (F.abs(dx * (cy - uy) - dy * (cx - ux)) <= half * (F.abs(dx) + F.abs(dy)))


def touched(segments: DataFrame, cell: float) -> DataFrame:
    """segments with cx, cy: a row for each cell of side `cell` that one touches."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    rows = segments.withColumn("cx", F.explode(span("ux", "vx"))).withColumn("cy", F.explode(span("uy", "vy")))
    middle = lambda c: (F.col(c) + 0.5) * cell
    return rows.where(meets_square(middle("cx"), middle("cy"), F.lit(cell / 2), *map(F.col, ("ux", "uy", "vx", "vy"))))


def painted(cells: DataFrame, rank: str, order: str, *values: str) -> DataFrame:
    """cx, cy and values of the last paint: the least rank is painted last, then the greatest order."""
    key = F.struct((-F.col(rank)).alias("r"), F.col(order).alias("o"), *[F.col(v).alias(v) for v in values])
    return cells.groupBy("cx", "cy").agg(F.max(key).alias("p")).select("cx", "cy", *[F.col(f"p.{v}").alias(v) for v in values])
