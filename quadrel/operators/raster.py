"""Grids as cell tables (tile, row, col, value), null where nothing is known.

Neighbourhood operators take a dense grid: a row for every cell, null included. A separable window is
two passes of ordinary window functions, along rows and along columns, so a tile is dealt over as
many tasks as it has rows; no tile is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def along_row():
    return Window.partitionBy("tile", "row").orderBy("col")


def along_col():
    return Window.partitionBy("tile", "col").orderBy("row")


def grid_mean(points: DataFrame, minx: float, miny: float, rows: int, cols: int, resolution: float = 1.0) -> DataFrame:
    """tile, row, col, z: mean of the points of a cell; north up; a point on the south edge is out."""
    row = F.floor((F.lit(miny + rows * resolution) - F.col("y")) / F.lit(resolution)).cast("int")
    col = F.floor((F.col("x") - F.lit(minx)) / F.lit(resolution)).cast("int")
    cells = points.select("tile", row.alias("row"), col.alias("col"), "z").where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    return cells.groupBy("tile", "row", "col").agg(F.avg("z").alias("z"))


def dense(cells: DataFrame, rows: int, cols: int, value: str = "z") -> DataFrame:
    """Every cell of the tiles that have any, null where cells has none."""
    lattice = cells.select("tile").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return lattice.join(cells.select("tile", "row", "col", value), ["tile", "row", "col"], "left")


def neighbour(value: Column, step: int, window) -> Column:
    """The value `step` cells on; at the border the cell itself stands in for a missing one."""
    there = F.lag(F.lit(1), -step).over(window) if step < 0 else F.lead(F.lit(1), step).over(window)
    found = F.lag(value, -step).over(window) if step < 0 else F.lead(value, step).over(window)
    return F.when(there.isNull(), value).otherwise(found)


def horn(grid: DataFrame, resolution: float = 1.0) -> DataFrame:
    """grid with dzdx, dzdy (north positive): Horn's weighted differences, border cells repeated."""
    z = F.col("z")
    flat = grid.withColumns({"_w": neighbour(z, -1, along_row()), "_e": neighbour(z, 1, along_row())})
    flat = flat.withColumns({"_dx": F.col("_e") - F.col("_w"), "_sum": F.col("_w") + 2 * z + F.col("_e")})
    up = lambda c, k: neighbour(F.col(c), k, along_col())
    both = flat.withColumns(
        {
            "_gx": up("_dx", -1) + 2 * F.col("_dx") + up("_dx", 1),
            "_gy": up("_sum", -1) - up("_sum", 1),
        }
    )
    scale = F.lit(8.0 * resolution)
    return both.withColumns({"dzdx": F.when(z.isNotNull(), F.col("_gx") / scale), "dzdy": F.when(z.isNotNull(), F.col("_gy") / scale)}).drop("_w", "_e", "_dx", "_sum", "_gx", "_gy")


def slope_percent(dzdx: Column, dzdy: Column) -> Column:
    return F.hypot(dzdx, dzdy) * 100


def slope_degrees(dzdx: Column, dzdy: Column) -> Column:
    return F.degrees(F.atan(F.hypot(dzdx, dzdy)))


def aspect(dzdx: Column, dzdy: Column) -> Column:
    """Compass bearing downhill; null on the flat."""
    level = (F.abs(dzdx) <= 1e-8) & (F.abs(dzdy) <= 1e-8)
    return F.when(~level, F.pmod(F.degrees(F.atan2(-dzdx, -dzdy)), F.lit(360.0)))


def hillshade(dzdx: Column, dzdy: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    import math

    zenith, az = math.radians(90 - altitude), math.radians(azimuth)
    s = F.atan(F.hypot(dzdx, dzdy))
    a = F.atan2(-dzdx, -dzdy)
    lit = math.cos(zenith) * F.cos(s) + math.sin(zenith) * F.sin(s) * F.cos(F.lit(az) - a)
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), lit * 255))


def box_sums(grid: DataFrame, half: int, **columns: Column) -> DataFrame:
    """grid with the sums of columns over the clipped (2 half + 1) squared box around each cell."""
    out = grid.withColumns({f"_{k}": v for k, v in columns.items()})
    for window in (along_row(), along_col()):
        frame = window.rowsBetween(-half, half)
        out = out.withColumns({f"_{k}": F.sum(f"_{k}").over(frame) for k in columns})
    return out.withColumnsRenamed({f"_{k}": k for k in columns})


def roughness(grid: DataFrame, half: int = 1) -> DataFrame:
    """grid with roughness: population deviation in the box, border cells repeated, voids skipped."""
    z = F.col("z")
    out = grid.withColumns({"_n": F.when(z.isNotNull(), 1.0).otherwise(0.0), "_s": F.coalesce(z, F.lit(0.0)), "_q": F.coalesce(z * z, F.lit(0.0))})
    for window, at in ((along_row(), "col"), (along_col(), "row")):
        first = F.col(at) - F.min(at).over(Window.partitionBy(*window_keys(at)))
        last = F.max(at).over(Window.partitionBy(*window_keys(at))) - F.col(at)
        frame = window.rowsBetween(-half, half)
        before = F.greatest(F.lit(half) - first, F.lit(0))
        after = F.greatest(F.lit(half) - last, F.lit(0))
        edge = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumns({c: F.sum(c).over(frame) + before * F.first(c).over(edge) + after * F.last(c).over(edge) for c in ("_n", "_s", "_q")})
    mean = F.col("_s") / F.nullif(F.col("_n"), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.col("_q") / F.nullif(F.col("_n"), F.lit(0.0)) - mean * mean, F.lit(0.0)))
    return out.withColumn("roughness", F.when(z.isNotNull(), spread)).drop("_n", "_s", "_q")


def window_keys(at: str) -> tuple[str, str]:
    return ("tile", "row") if at == "col" else ("tile", "col")


def fill_gaps(grid: DataFrame, rounds: int = 8) -> DataFrame:
    """Voids take the mean of their known 4-neighbours, round by round."""
    for _ in range(rounds):
        z = F.col("z")
        around = [F.lag(z).over(along_row()), F.lead(z).over(along_row()), F.lag(z).over(along_col()), F.lead(z).over(along_col())]
        n = sum((F.when(a.isNotNull(), 1).otherwise(0) for a in around), F.lit(0))
        s = sum((F.coalesce(a, F.lit(0.0)) for a in around), F.lit(0.0))
        grid = grid.withColumn("z", F.coalesce(z, s / F.nullif(n, F.lit(0))))
    return grid


def downsample(grid: DataFrame, factor: int, rows: int, cols: int) -> DataFrame:
    """Block means of what is known; rows and columns beyond the last whole block are left out."""
    whole = grid.where((F.col("row") < rows // factor * factor) & (F.col("col") < cols // factor * factor))
    at = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return whole.groupBy("tile", at("row"), at("col")).agg(F.avg("z").alias("z"))


def resample(grid: DataFrame, rows: int, cols: int, resolution: float, target_rows: int, target_cols: int, target_resolution: float) -> DataFrame:
    """Nearest cell for each target cell's centre, both grids north-west aligned; null outside."""
    at = lambda c: F.floor((F.col(c) + 0.5) * F.lit(target_resolution) / F.lit(resolution)).cast("int")
    lattice = grid.select("tile").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(target_rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(target_cols - 1))))
    lattice = lattice.withColumns({"_r": at("row"), "_c": at("col")})
    source = grid.select("tile", F.col("row").alias("_r"), F.col("col").alias("_c"), "z")
    return lattice.join(source, ["tile", "_r", "_c"], "left").select("tile", "row", "col", "z")


def clip(grid: DataFrame, low_row: int, high_row: int, low_col: int, high_col: int) -> DataFrame:
    """The cells of a half-open range, renumbered from 0."""
    inside = F.col("row").between(low_row, high_row - 1) & F.col("col").between(low_col, high_col - 1)
    return grid.where(inside).withColumns({"row": F.col("row") - low_row, "col": F.col("col") - low_col})


def distance_within(cells: DataFrame, most: float, resolution: float = 1.0) -> DataFrame:
    """cells (tile, row, col, on) with distance: metres to the nearest set cell, at most `most`.

    Set cells are sent to the cells that they can be nearest to: bounded by the distance, not by the tile.
    """
    reach = int(most // resolution)
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit((r * r + c * c) ** 0.5 * resolution).alias("d")) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if (r * r + c * c) ** 0.5 * resolution <= most])
    spread = cells.where("on").select("tile", "row", "col", F.explode(offsets).alias("o"))
    nearest = spread.groupBy("tile", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col")).agg(F.min("o.d").alias("distance"))
    return cells.join(nearest, ["tile", "row", "col"], "left").withColumn("distance", F.coalesce("distance", F.lit(most)))


def gaussian(grid: DataFrame, rows: int, cols: int, sigma: float, value: str = "v") -> DataFrame:
    """tile, row, col and the value blurred: two passes of weighted sums, borders reflected, cut at 4 sigma.

    A cell is sent to the cells of its row, then column, that it weighs in on: equal work for every cell.
    """
    import math

    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-o * o / (2 * sigma * sigma)) for o in range(-reach, reach + 1)]
    offsets = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w / sum(raw)).alias("w")) for o, w in zip(range(-reach, reach + 1), raw)])
    for at, n in (("col", cols), ("row", rows)):
        wanted = grid.select("tile", "row", "col", F.explode(offsets).alias("k"))
        place = F.col(at) + F.col("k.o")
        place = F.when(place < 0, -place - 1).when(place >= n, 2 * n - 1 - place).otherwise(place)
        other = "row" if at == "col" else "col"
        wanted = wanted.select("tile", "row", "col", F.col("k.w").alias("_w"), place.alias("_from"))
        source = grid.select("tile", F.col(other).alias("_same"), F.col(at).alias("_from"), F.col(value).alias("_v"))
        joined = wanted.join(source, (wanted["tile"] == source["tile"]) & (F.col(other) == F.col("_same")) & (wanted["_from"] == source["_from"]))
        grid = joined.groupBy(wanted["tile"], "row", "col").agg(F.sum(F.col("_w") * F.col("_v")).alias(value))
    return grid
