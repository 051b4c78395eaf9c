from __future__ import annotations

import pytest

from quadrel import api
from quadrel.operators import splits
from quadrel.plans import relations as rel

SMALL = "/root/testdata/sf0.001"


def grid(spark, n=6):
    return spark.createDataFrame([(y * n + x, x, y, x // 2) for y in range(n) for x in range(n)], "tile int, ix int, iy int, site int")


def test_plan_is_row_major_and_covers(spark):
    rows = [(r.tile_id, r.ix, r.iy) for r in api.tiles_plan(spark, (-500.0, 0.0, 1500.0, 1000.1), 8).collect()]
    assert [(x, y) for _, x, y in rows] == [(-1, 0), (0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
    assert rows[0][0] == "z08_x-00001_y000000"


@pytest.mark.parametrize("buffer", [0, 1, 2])
def test_splits_are_apart(spark, buffer):
    parts = spark.createDataFrame([(0, "train"), (1, "val"), (2, "test")], "site int, part string")
    split = api.splits_build(grid(spark), parts, buffer)
    assert split.count() == 36
    assert (splits.violations(split, buffer).count() == 0) == (buffer > 0) or buffer == 0
    assert splits.spanning_sites(split).count() == 0
    kept = {r.ix for r in split.where("part <> 'buffer'").collect()}
    assert kept == ({0, 1, 2, 3, 4, 5} if buffer == 0 else {0, 5} if buffer == 1 else set())


def test_unassigned_site_is_left_out(spark):
    parts = spark.createDataFrame([(0, "train")], "site int, part string")
    assert api.splits_build(grid(spark), parts).count() == 12


def test_tiles_are_built_or_reported(spark):
    built, skipped = api.tiles_build(rel.points(spark, SMALL), 33, 33, min_coverage=0.22)
    n = rel.points(spark, SMALL).select("tile").distinct().count()
    assert built.select("tile").distinct().count() + skipped.count() == n
    assert {r.channel for r in api.tiles_inspect(built, ["elevation", "slope"]).collect()} <= {"elevation", "slope"}


def test_provenance_of_the_derived_registry(spark):
    registry, manifests = rel.registry(spark, SMALL), rel.manifests(spark, SMALL)
    kinds = {r.finding for r in api.provenance_check(registry, manifests).select("finding").distinct().collect()}
    assert {"tier", "attribution", "unknown"} <= kinds
    assert api.provenance_can_export(registry, manifests).count() == manifests.select("tile").distinct().count()
    assert all("  " not in r.line for r in api.provenance_attribution(registry, manifests).collect())


def test_study_and_roads(spark):
    found = api.study(rel.observations(spark, SMALL), ["f_step", "f_flat"], ["m_ring"], 50).collect()
    assert {(r.feature, r.verdict == "insufficient") for r in found} >= {("f_flat", True)}
    edges = spark.createDataFrame([(0, 1, 1, 2, 500.0), (0, 2, 2, 3, 500.0), (0, 3, 7, 8, 1000.0)], "graph int, id long, u long, v long, length double")
    row = api.roads_analyse(edges, 2.0).first()
    assert (row.km, row.km_per_km2, row.crossings, row.components) == (2.0, 1.0, 0, 2)
