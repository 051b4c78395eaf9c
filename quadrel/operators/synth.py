"""Synthetic terrain: lattice noise by hash, octaves, ridges, carved valleys; the same in any engine.

A cell computes its four lattice values itself, by hashing their places: no lattice table, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Archetype -> relief in m, valleys, ridge share, coast height in m.
ARCHETYPES = {"mountain_valley": (600.0, 1, 0.7, 0.0), "coastal": (250.0, 0, 0.3, 40.0), "plain": (30.0, 0, 0.0, 0.0), "basin": (350.0, 0, 0.5, 0.0)}


def lattice(seed: Column, i: Column, j: Column) -> Column:
    """A number in [0, 1) for a place of a lattice."""
    key = F.concat_ws(":", seed.cast("string"), i.cast("string"), j.cast("string"))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def value_noise(seed: Column, x: Column, y: Column) -> Column:
    """Smoothstep interpolation of lattice values at (x, y), in lattice steps; 0 to 1."""
    i, j = F.floor(x), F.floor(y)
    smooth = lambda t: t * t * (3 - 2 * t)
    u, v = smooth(x - i), smooth(y - j)
    low = lattice(seed, i, j) * (1 - u) + lattice(seed, i + 1, j) * u
    high = lattice(seed, i, j + 1) * (1 - u) + lattice(seed, i + 1, j + 1) * u
    return low * (1 - v) + high * v


def octaves(seed: Column, x: Column, y: Column, n: int = 3, gain: float = 0.5) -> Column:
    """Sum of n octaves about 0, scaled to -1 to 1."""
    total, whole = F.lit(0.0), 0.0
    for k in range(n):
        total = total + (value_noise(seed + 1000 * k, x * 2**k, y * 2**k) * 2 - 1) * gain**k
        whole += gain**k
    return total / whole


def ridged(seed: Column, x: Column, y: Column, n: int = 3) -> Column:
    return 1 - F.abs(octaves(seed, x, y, n))


def cells(spark: SparkSession, size: int) -> DataFrame:
    """row, col of a square world."""
    n = spark.range(size * size)
    return n.select(F.floor(F.col("id") / size).cast("int").alias("row"), (F.col("id") % size).cast("int").alias("col"))


def params(name: str, size_m: float, base_m: float = 4000.0) -> dict:
    """Horizontal lengths go with the world's size, heights don't."""
    relief, valleys, ridge, coast = ARCHETYPES[name]
    return {"name": name, "relief": relief, "valleys": valleys, "ridge": ridge, "coast": coast, "wavelength": 800.0 * size_m / base_m, "valley_width": 220.0 * size_m / base_m}


def synthesise(spark: SparkSession, name: str, size: int, seed: int, cell: float = 10.0) -> DataFrame:
    """row, col, z of a world of one archetype."""
    p = params(name, size * cell)
    x, y, s = F.col("col") * cell / p["wavelength"], F.col("row") * cell / p["wavelength"], F.lit(seed)
    rough = octaves(s, x, y) * 0.5 + 0.5
    z = p["relief"] * (rough * (1 - p["ridge"]) + ridged(s + 7, x, y) * p["ridge"])
    if name == "basin":
        half = size / 2
        away = F.least(F.lit(1.0), F.hypot(F.col("row") - half, F.col("col") - half) / half)
        z = z * away * away
    if name == "coastal":
        z = z * (F.col("row") / size) - p["coast"] * (1 - F.col("row") / size)
    if p["valleys"]:
        middle = size / 2 + size / 8 * F.sin(F.col("row") * 6.283185307179586 / size)
        off = (F.col("col") - middle) * cell / p["valley_width"]
        z = z * (1 - 0.9 * F.exp(-off * off))
    return cells(spark, size).select("row", "col", z.alias("z"))
