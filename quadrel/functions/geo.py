"""Column expressions of plane geometry, grids and terrain. All of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: tuple, b: tuple) -> Column:
    """Boxes (minx, miny, maxx, maxy) share area; touching edges don't."""
    return (a[2] > b[0]) & (b[2] > a[0]) & (a[3] > b[1]) & (b[3] > a[1])


def touches(a: tuple, b: tuple) -> Column:
    """Boxes share area, an edge or a corner."""
    return (a[2] >= b[0]) & (b[2] >= a[0]) & (a[3] >= b[1]) & (b[3] >= a[1])


def contains(box: tuple, x: Column, y: Column) -> Column:
    """Least edges in, greatest edges out."""
    return (x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3])


def buffered(box: tuple, d) -> tuple:
    return box[0] - d, box[1] - d, box[2] + d, box[3] + d


def square(x: Column, y: Column, side: Column) -> Column:
    """Closed ring of a square, anticlockwise from (x, y)."""
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(at(x, y), at(x + side, y), at(x + side, y + side), at(x, y + side), at(x, y))


def steps(line: Column, f) -> Column:
    """f(point, next point) for each step of a line, as an array."""
    n = F.size(line)
    return F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), f)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def line_length(line: Column) -> Column:
    return total(steps(line, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def straight_length(line: Column) -> Column:
    a, b = F.get(line, F.lit(0)), F.get(line, F.size(line) - 1)
    return F.when(F.size(line) < 2, 0.0).otherwise(F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def sinuosity(length: Column, straight: Column) -> Column:
    return F.when(straight <= 1e-9, 1.0).otherwise(length / F.when(straight > 1e-9, straight))


def bearing(dx: Column, dy: Column, turn: float = 360.0) -> Column:
    """Compass bearing in [0, turn): 360 for a direction, 180 for a line."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(turn))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring; 0 below three points."""
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(total(steps(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))) / 2)


def closed(ring: Column) -> Column:
    return (F.size(ring) >= 4) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))


def side(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_cross(a: tuple, b: tuple) -> Column:
    """Segments (x1, y1, x2, y2) cross, by strict side tests: 0 counts as the negative side."""
    p = lambda s, x, y: side(*s, x, y) > 0
    return (p(b, a[0], a[1]) != p(b, a[2], a[3])) & (p(a, b[0], b[1]) != p(a, b[2], b[3]))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    square_ = dx * dx + dy * dy
    t = F.when(square_ > 0, ((px - ax) * dx + (py - ay) * dy) / F.nullif(square_, F.lit(0.0))).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    crossing = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])
    return F.aggregate(steps(ring, lambda a, b: F.coalesce(crossing(a, b), F.lit(False))), F.lit(False), lambda s, c: s != c)


def tile_id(zone: Column, ix: Column, iy: Column) -> Column:
    return F.format_string("z%02d_x%06d_y%06d", zone, ix, iy)


def tile_parts(name: Column) -> tuple[Column, Column, Column]:
    """zone, ix, iy of a tile's name, null if it is none."""
    parts = F.split(name, "_")
    ok = (F.size(parts) == 3) & name.rlike("^z-?[0-9]+_x-?[0-9]+_y-?[0-9]+$")
    return tuple(F.when(ok, F.substring(F.get(parts, F.lit(i)), 2, 20).try_cast("int")) for i in range(3))


def chebyshev(ax, ay, bx, by) -> Column:
    return F.greatest(F.abs(ax - bx), F.abs(ay - by))


def mesh_box(code: Column) -> tuple[Column, Column, Column, Column]:
    """west, south, east, north of a 4-, 6- or 8-digit mesh code; null where the code is none."""
    n = F.length(code)
    digit = lambda i, k=1: F.substring(code, i, k).try_cast("int")
    ok = code.rlike("^([0-9]{4}|[0-9]{6}|[0-9]{8})$") & ((n < 6) | ((digit(5) <= 7) & (digit(6) <= 7)))
    south = digit(1, 2) / F.lit(1.5) + F.when(n >= 6, digit(5) / F.lit(12.0)).otherwise(0.0) + F.when(n >= 8, digit(7) / F.lit(120.0)).otherwise(0.0)
    west = digit(3, 2) + F.lit(100.0) + F.when(n >= 6, digit(6) / F.lit(8.0)).otherwise(0.0) + F.when(n >= 8, digit(8) / F.lit(80.0)).otherwise(0.0)
    high = F.when(n == 4, 1 / 1.5).when(n == 6, 1 / 12).otherwise(1 / 120)
    wide = F.when(n == 4, 1.0).when(n == 6, 1 / 8).otherwise(1 / 80)
    return tuple(F.when(ok, v) for v in (west, south, west + wide, south + high))


def mesh_code_in(name: Column) -> Column:
    """The first run of 4, 6 or 8 digits that stands alone in a name."""
    found = F.regexp_extract(name, r"(?<![0-9])([0-9]{8}|[0-9]{6}|[0-9]{4})(?![0-9])", 1)
    return F.nullif(found, F.lit(""))


def slippy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Map tile (x, y) that holds a place."""
    n = F.lit(float(1 << zoom))
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / F.lit(3.141592653589793)) / 2.0 * n)
    return x, y


def slippy_place(px: Column, py: Column, extent: int, zoom: int) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel of the map, counted from its north-west corner."""
    n = F.lit(float(extent << zoom))
    return px / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1.0 - 2.0 * py / n))))


def cell_of(x: Column, y: Column, minx, maxy, resolution: float) -> tuple[Column, Column]:
    """row, col of a north-up grid, unclipped."""
    return F.floor((maxy - y) / F.lit(resolution)).cast("int"), F.floor((x - minx) / F.lit(resolution)).cast("int")


def wkt(ring: Column) -> Column:
    point = lambda p: F.format_string("%.4f %.4f", p["x"], p["y"])
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, point), ", "), F.lit("))"))


def ring_of(text: Column) -> Column:
    """The ring of a WKT polygon."""
    inner = F.regexp_extract(text, r"\(\((.*)\)\)", 1)
    pair = lambda p: F.split(p, " ")
    return F.transform(F.split(inner, ", "), lambda p: F.struct(F.get(pair(p), F.lit(0)).cast("double").alias("x"), F.get(pair(p), F.lit(1)).cast("double").alias("y")))


# Gauss-Krueger projection on GRS80: series of Kawase (2011) to fourth order in n.
SEMI_MAJOR, FLATTENING, SCALE = 6378137.0, 1 / 298.257222101, 0.9999
# Origin latitude and longitude, in degrees, of the nineteen plane zones.
ZONE_ORIGINS = [
    (33.0, 129.5), (33.0, 131.0), (36.0, 132 + 10 / 60), (33.0, 133.5), (36.0, 134 + 20 / 60), (36.0, 136.0), (36.0, 137 + 10 / 60), (36.0, 138.5),
    (36.0, 139 + 50 / 60), (40.0, 140 + 50 / 60), (44.0, 140.25), (44.0, 142.25), (44.0, 144.25), (26.0, 142.0), (26.0, 127.5), (26.0, 124.0),
    (26.0, 131.0), (20.0, 136.0), (26.0, 154.0),
]


def _series():
    n = FLATTENING / (2 - FLATTENING)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    rectifying = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return n, alpha, beta, delta, rectifying


def _meridian(lat0: float) -> float:
    import math

    n, alpha, _, _, rectifying = _series()
    e = 2 * math.sqrt(n) / (1 + n)
    s = math.sin(math.radians(lat0))
    t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
    xi = math.atan(t)
    return SCALE * rectifying * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(alpha)))


def project(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Plane easting and northing, in m, of a place in degrees."""
    lat0, lon0 = ZONE_ORIGINS[zone - 1]
    n, alpha, _, _, rectifying = _series()
    e = 2 * n**0.5 / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    dl = F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    northing, easting = xi, eta
    for j, a in enumerate(alpha, 1):
        northing = northing + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        easting = easting + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.lit(SCALE * rectifying) * easting, F.lit(SCALE * rectifying) * northing - F.lit(_meridian(lat0))


def unproject(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude of a plane place."""
    lat0, lon0 = ZONE_ORIGINS[zone - 1]
    _, _, beta, delta, rectifying = _series()
    xi, eta = (y + F.lit(_meridian(lat0))) / F.lit(SCALE * rectifying), x / F.lit(SCALE * rectifying)
    a, b = xi, eta
    for j, k in enumerate(beta, 1):
        a = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, k in enumerate(delta, 1):
        lat = lat + k * F.sin(2 * j * chi)
    return F.lit(lon0) + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)
