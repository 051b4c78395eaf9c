"""Geographic splits over tiles (tile, ix, iy, site): assigned by site, kept apart by a buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(tiles: DataFrame, steps: int, **columns: str) -> DataFrame:
    """ix, iy and renamed columns: each tile at all places within `steps` of it."""
    step = F.sequence(F.lit(-steps), F.lit(steps))
    spread = tiles.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    return spread.select((F.col("ix") + F.col("_dx")).alias("ix"), (F.col("iy") + F.col("_dy")).alias("iy"), *[F.col(old).alias(new) for new, old in columns.items()])


def assigned(tiles: DataFrame, assignment: DataFrame, buffer: int = 1) -> DataFrame:
    """tiles with part: the site's, or buffer within `buffer` tiles of another part; sites without one go.

    assignment: site, part; a handful of sites.
    """
    own = tiles.join(F.broadcast(assignment), "site")
    if buffer <= 0:
        return own
    other = reach(own, buffer, other="part")
    near = own.join(other, ["ix", "iy"]).where("part <> other").select("tile").distinct().withColumn("_near", F.lit(True))
    return own.join(near, "tile", "left").withColumn("part", F.when(F.col("_near"), "buffer").otherwise(F.col("part"))).drop("_near")


def violations(tiles: DataFrame, steps: int = 1) -> DataFrame:
    """part, other, tile, near: the first pair of tiles of two parts that are within `steps`."""
    own = tiles.where("part <> 'buffer'")
    pairs = own.join(reach(own, steps, other="part", near="tile"), ["ix", "iy"]).where("part < other")
    first = pairs.groupBy("part", "other").agg(F.min(F.struct("tile", "near")).alias("w"))
    return first.select("part", "other", "w.tile", "w.near")


def spanning_sites(tiles: DataFrame) -> DataFrame:
    """Sites that are in more than one part."""
    return tiles.where("part <> 'buffer'").groupBy("site").agg(F.countDistinct("part").alias("n")).where("n > 1").select("site")


def folds(tiles: DataFrame) -> DataFrame:
    """fold, tile, side: each site held out in turn; sites are gathered as one array."""
    names = tiles.agg(F.sort_array(F.collect_set("site")).alias("folds"), F.lit(1).alias("_k"))
    rows = tiles.withColumn("_k", F.lit(1)).join(F.broadcast(names), "_k")
    return rows.select(F.explode("folds").alias("fold"), "tile", "site").select("fold", "tile", F.when(F.col("site") == F.col("fold"), "held").otherwise("train").alias("side"))
