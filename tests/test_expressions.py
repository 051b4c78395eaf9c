from __future__ import annotations

import math

from pyspark.sql import functions as F

from quadrel.functions import dims, geo
from quadrel.operators import curves


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def box(*v):
    return tuple(map(F.lit, v))


def test_edges_of_boxes(spark):
    touching = box(0.0, 0.0, 1.0, 1.0), box(1.0, 0.0, 2.0, 1.0)
    assert one(spark, geo.overlaps(*touching)) is False and one(spark, geo.touches(*touching)) is True
    assert one(spark, geo.contains(box(0.0, 0.0, 1.0, 1.0), F.lit(0.0), F.lit(0.0))) is True
    assert one(spark, geo.contains(box(0.0, 0.0, 1.0, 1.0), F.lit(1.0), F.lit(0.5))) is False


def line(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_lines_and_rings(spark):
    assert one(spark, geo.line_length(line((0, 0), (3, 4), (3, 5)))) == 6.0
    assert one(spark, geo.straight_length(line((0, 0)))) == 0.0
    assert one(spark, geo.ring_area(line((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)))) == 4.0
    assert one(spark, geo.closed(line((0, 0), (2, 0), (0, 0)))) is False
    concave = line((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0))
    assert one(spark, geo.in_ring(concave, F.lit(0.5), F.lit(1.0))) is True and one(spark, geo.in_ring(concave, F.lit(2.0), F.lit(2.0))) is False
    assert one(spark, geo.bearing(F.lit(-1.0), F.lit(0.0))) == 270.0 and one(spark, geo.bearing(F.lit(-1.0), F.lit(0.0), 180.0)) == 90.0
    assert one(spark, geo.point_segment_distance(*map(F.lit, (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)))) == 5.0


def test_names_and_codes(spark):
    assert one(spark, geo.tile_id(F.lit(8), F.lit(10), F.lit(-110))) == "z08_x000010_y-00110"
    assert one(spark, F.struct(*geo.tile_parts(F.lit("z08_x000010_y-00110")))) == (8, 10, -110)
    assert one(spark, geo.tile_parts(F.lit("z08_x1"))[0]) is None
    assert one(spark, geo.mesh_code_in(F.lit("x_52385001_bldg"))) == "52385001" and one(spark, geo.mesh_code_in(F.lit("x52385_"))) is None
    west, south, east, north = geo.mesh_box(F.lit("523850"))
    assert math.isclose(one(spark, west), 138.0) and math.isclose(one(spark, south), 52 / 1.5 + 5 / 12)
    assert one(spark, geo.mesh_box(F.lit("523890"))[0]) is None
    assert one(spark, geo.wkt(line((0, 0), (1, 2)))) == "POLYGON ((0.0000 0.0000, 1.0000 2.0000))"


def test_projection(spark):
    for zone, (lat, lon) in enumerate(geo.ZONE_ORIGINS, 1):
        e, n = geo.project(F.lit(lon), F.lit(lat), zone)
        assert abs(one(spark, e)) < 1e-6 and abs(one(spark, n)) < 1e-6
    e, n = geo.project(F.lit(138.6), F.lit(35.5), 8)
    east, north = one(spark, e), one(spark, n)
    lon, lat = geo.unproject(F.lit(east), F.lit(north), 8)
    assert abs(one(spark, lon) - 138.6) < 1e-9 and abs(one(spark, lat) - 35.5) < 1e-9
    up = one(spark, geo.project(F.lit(138.6), F.lit(35.51), 8)[1])
    assert abs((up - north) / 0.01 - 110_950) < 100  # metres a degree


def test_curves(spark):
    corner = line((0, 0), (10, 0), (10, 10))
    cut = one(spark, curves.cut_corners(corner))
    assert [(p.x, p.y) for p in cut] == [(0, 0), (7.5, 0), (10, 2.5), (10, 10)]
    spaced = one(spark, curves.resampled(corner, 8.0))
    assert [(round(p.x, 6), round(p.y, 6)) for p in spaced] == [(0, 0), (8, 0), (10, 6), (10, 10)]
    assert len(one(spark, curves.resampled(corner, 50.0))) == 2
    pulled = one(spark, curves.leashed(F.struct(F.lit(10.0).alias("x"), F.lit(0.0).alias("y")), line((0, 0)), 6.0))
    assert (pulled.x, pulled.y) == (6.0, 0.0)


def test_dimensions_agree(spark):
    classes = {c[0] for c in dims.ROAD_CLASSES}
    assert set(dims.HIGHWAYS.values()) <= classes
    assert set(dims.USAGE_CODES.values()) <= set(dims.FINE_TYPES) and set(dims.BUILDING_TAGS.values()) <= set(dims.FINE_TYPES)
    assert set(dims.LANDUSE_GROUPS) <= set(dims.LANDUSE_CODES.values())
    assert dims.channels(spark).count() == 15
