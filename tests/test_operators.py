from __future__ import annotations

import math
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel import api
from quadrel.operators import graph, local, raster, rangejoin, study, synth
from quadrel.sources import files, sinks
from quadrel.sources.gate import Gate, ProvenanceError, Source


def plane(spark, dx, dy, n=9, void=()):
    rows = [(0, r, c, None if (r, c) in void else float(c * dx - r * dy)) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "tile int, row int, col int, z double")


def test_slope_of_planes_holds_inside_and_halves_at_replicated_borders(spark):
    got = {(r.row, r.col): r for r in raster.horn(plane(spark, 0.05, 0.02)).collect()}
    for (r, c), v in got.items():
        assert math.isclose(v.dzdx, 0.05 * (0.5 if c in (0, 8) else 1), abs_tol=1e-12)
        assert math.isclose(v.dzdy, 0.02 * (0.5 if r in (0, 8) else 1), abs_tol=1e-12)


def test_voids_stay_void(spark):
    g = raster.horn(plane(spark, 1, 1, void={(4, 4)}))
    got = {(r.row, r.col): r for r in g.collect()}
    assert got[4, 4].dzdx is None and got[4, 3].dzdx is None and got[4, 5].dzdx is None
    rough = {(r.row, r.col): r.roughness for r in raster.roughness(plane(spark, 0, 0, void={(4, 4)})).collect()}
    assert rough[4, 4] is None and rough[4, 5] == 0.0
    flat = {(r.row, r.col): r for r in raster.horn(plane(spark, 0, 0)).withColumn("a", raster.aspect(F.col("dzdx"), F.col("dzdy"))).collect()}
    assert all(v.a is None for v in flat.values())
    filled = {(r.row, r.col): r.z for r in raster.fill_gaps(plane(spark, 1, 0, void={(4, 4)}), 1).collect()}
    assert filled[4, 4] == 4.0


def test_roughness_equals_padded_windows(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(7, 7))
    rows = [(0, r, c, float(z[r, c])) for r in range(7) for c in range(7)]
    got = {(r.row, r.col): r.roughness for r in raster.roughness(spark.createDataFrame(rows, "tile int, row int, col int, z double"), 2).collect()}
    pad = np.pad(z, 2, mode="edge")
    for r in range(7):
        for c in range(7):
            assert math.isclose(got[r, c], pad[r : r + 5, c : c + 5].std(), rel_tol=1e-9)


def test_south_edge_point_is_out(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (0, 0.0, 4.0, 2.0), (0, 3.9, 0.1, 3.0)], "tile int, x double, y double, z double")
    assert {(r.row, r.col, r.z) for r in raster.grid_mean(p, 0, 0, 4, 4).collect()} == {(0, 0, 2.0), (3, 3, 3.0)}


def cross(spark):
    rows = [(0, i, 0, i + 1) for i in range(4)] + [(0, 9, 7, 8), (1, 10, 5, 5)]
    return spark.createDataFrame(rows, "graph int, id long, u long, v long")


def test_degrees_and_components(spark):
    e = cross(spark)
    assert {(r.graph, r.node): r.degree for r in graph.degrees(e).collect()} == {(0, 0): 4, (0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 1, (0, 7): 1, (0, 8): 1, (1, 5): 1}
    assert {(r.graph, r.node): r.root for r in graph.components(e).collect()} == {**{(0, i): 0 for i in range(5)}, (0, 7): 7, (0, 8): 7, (1, 5): 5}
    assert graph.components(e.where("1 = 0")).count() == 0


def test_long_chain_is_one_component(spark):
    e = spark.range(300).select(F.lit(0).alias("graph"), "id", F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in graph.components(e).collect()} == {0}


def test_spurs_go_round_by_round(spark):
    e = spark.createDataFrame([(0, i, i, i + 1, 5.0) for i in range(5)] + [(0, 9, 0, 5, 99.0)], "graph int, id long, u long, v long, length double")
    assert graph.prune_spurs(e, 10.0).count() == 6  # a ring has no end
    chain = e.where("id < 9")
    assert [graph.prune_spurs(chain, 10.0, n).count() for n in (1, 2, 3)] == [3, 1, 0]


def test_ways_are_cut_at_shared_nodes(spark):
    w = spark.createDataFrame([(1, p, p) for p in range(5)], "way long, pos int, ref long")
    cut = spark.createDataFrame([(2,), (4,)], "ref long")
    spans = {}
    for r in graph.split_at(w, cut).collect():
        spans.setdefault(r.span, []).append(r.ref)
    assert [sorted(v) for _, v in sorted(spans.items())] == [[0, 1, 2], [2, 3, 4]]


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    p = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150)] + [(200, 10.0, 10.0), (201, 10.0, 20.0)]
    got = {(r.a, r.b) for r in rangejoin.near_pairs(spark.createDataFrame(p, "id long, x double, y double"), 10.0).collect()}
    assert got == {(a[0], b[0]) for a in p for b in p if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 10}
    plan = rangejoin.near_pairs(spark.createDataFrame(p, "id long, x double, y double"), 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_spearman_and_verdicts(spark):
    rows = [(i, i % 4, "f", "m", float(i % 7), float((i % 7) ** 2)) for i in range(40)] + [(i, i % 4, "flat", "m", 1.0, float(i)) for i in range(40)] + [(1, 0, "few", "m", 1.0, 2.0), (2, 0, "few", "m", 2.0, 1.0)]
    t = spark.createDataFrame(rows, "tile long, site int, feature string, metric string, x double, y double")
    got = {r.feature: r for r in study.spearman(t, ["feature", "metric"]).collect()}
    assert math.isclose(got["f"].rho, 1.0) and got["flat"].rho is None and got["few"].rho is None
    say = lambda *v: spark.range(1).select(study.verdict(*[F.lit(x).cast("double") for x in v]).alias("v")).first().v
    assert [say(0.5, 0.1, 0.9), say(0.0, -0.2, 0.2), say(0.1, -0.5, 0.6), say(None, 0.1, 0.2)] == ["supported", "null", "inconclusive", "insufficient"]


def test_graph_scores():
    nodes = {i: (100.0 * i, 0.0) for i in range(5)}
    edges = [(i, i + 1, 100.0) for i in range(4)]
    assert local.apls(edges, nodes, edges, nodes, 10.0) == 1.0
    assert local.topo(edges, nodes, edges, nodes, 10.0) == (1.0, 1.0, 1.0)
    cut = [e for e in edges if e[0] != 2]
    assert 0.3 < local.apls(edges, nodes, cut, nodes, 10.0) < 1.0
    assert local.topo(edges, nodes, cut, nodes, 10.0, 1000.0)[1] < 1.0
    far = {i: (x, 500.0) for i, (x, _) in nodes.items()}
    assert local.apls(edges, nodes, edges, far, 10.0) == 0.0


def test_order_dependent_steps(spark):
    pairs = spark.createDataFrame([(0, 1, 10, 2.0), (0, 1, 11, 1.0), (0, 2, 11, 1.0), (0, 2, 10, 5.0)], "graph int, a long, b long, d double")
    assert {(r.a, r.b) for r in local.greedy_match(pairs).collect()} == {(1, 11), (2, 10)}
    chain = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4)], "graph int, a long, b long")
    assert {(r.node, r.into) for r in local.greedy_merge(chain).collect()} == {(2, 1), (4, 3)}
    assert local.simplify([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)], 0.5) == [(0, 0), (2, 0), (3, 5), (4, 0)]
    assert len(local.simplify([(i, 0.0) for i in range(20_000)], 1.0)) == 2


def test_repair_bridges_and_prunes():
    nodes = {0: (0.0, 0.0), 1: (100.0, 0.0), 2: (130.0, 0.0), 3: (230.0, 0.0), 4: (500.0, 500.0), 5: (505.0, 500.0), 6: (50.0, 8.0)}
    edges = [(0, 1, 100.0), (2, 3, 100.0), (4, 5, 5.0), (0, 6, 8.0)]
    after, report = local.repair(edges, nodes, snap=5.0)
    assert report == {"dropped": 1, "bridged": 1, "snapped": 0, "pruned": 1} and (1, 2, 30.0) in after


def test_repair_counts_components_and_prunes_round_by_round():
    nodes = {i: (40.0 * i, 0.0) for i in range(6)} | {10: (0.0, 900.0), 11: (9.0, 900.0), 12: (18.0, 900.0), 20: (200.0, 20.0), 21: (200.0, 45.0)}
    edges = [(i, i + 1, 40.0, f"e{i}") for i in range(5)] + [(10, 11, 9.0, "s"), (11, 12, 9.0, "t"), (5, 20, 20.0, "x"), (20, 21, 25.0, "y")]
    after, report = local.repair(edges, nodes, gap=1.0, snap=1.0)
    assert report == {"dropped": 1, "bridged": 0, "snapped": 0, "pruned": 2}
    assert [e[3] for e in after] == [f"e{i}" for i in range(5)]


def test_snapping_looks_at_degrees_as_they_are():
    """Two loose ends near each other: the first snaps to the second, which is none any more."""
    nodes = {0: (0.0, 0.0), 1: (100.0, 0.0), 2: (110.0, 10.0), 3: (110.0, 110.0), 4: (300.0, 0.0)}
    edges = [(0, 1, 100.0, "a"), (2, 3, 100.0, "b")]
    after, report = local.repair(edges, nodes, gap=0.0, snap=25.0)
    assert report["snapped"] == 1 and (after[-1][:2], after[-1][3]) == ((1, 2), "snap")


def test_masks_are_cleaned():
    mask = np.ones((12, 12), bool)
    mask[5, 5] = mask[0, 0] = False
    assert local.cleaned(mask, 2, 0).all()
    specks = np.zeros((12, 12), bool)
    specks[2, 2:6] = specks[8, 8] = True
    assert local.cleaned(specks, 0, 3).sum() == 4 and len(local.patches(specks)) == 2


def cross() -> np.ndarray:
    grid = np.zeros((200, 200))
    grid[98:102, 8:192] = grid[8:192, 98:102] = 0.9
    grid[98:102, 140:148] = 0.0  # a gap
    grid[99, 40] = 0.0  # a pinhole
    grid[180:183, 180:183] = 0.8  # a speck
    return grid


def test_roads_are_extracted_repaired_and_graded():
    found = local.extract(cross(), 0.5, 1.0)
    assert len(found) == 5 and all(0 < x < 200 and 0 < y < 200 for *_, line, _ in found for x, y in line)
    flat = local.generated(cross(), np.zeros((200, 200)), 0.5, 1.0, {"gap": 15.0, "least": 15.0})
    assert sorted(e[4] for e in flat) == ["bridge"] + ["traced"] * 5 and all(e[6] == 0 for e in flat)
    wall = np.zeros((200, 200))
    wall[:, 170:] = 40.0
    steep = local.generated(cross(), wall, 0.5, 1.0, {"gap": 15.0, "least": 15.0})
    assert len(steep) == 5 and all(e[6] <= 12.0 for e in steep)
    slope = np.broadcast_to(np.linspace(0, 40, 200)[None, :], (200, 200))
    led = local.generated(cross(), slope, 0.5, 1.0, {"gap": 15.0, "least": 15.0})
    assert any(e[4] == "grade" for e in led) and all(e[6] <= 12.0 for e in led)
    assert local.generated(np.zeros((9, 9)), np.zeros((9, 9)), 0.5, 1.0) == []


def test_generated_roads_can_be_exported(spark, tmp_path):
    grid = cross()
    rows = [(t, r, c, float(grid[r, c]), 0.0) for t in (1, 2) for r in range(200) for c in range(200)]
    cells = spark.createDataFrame(rows, "tile long, row int, col int, v double, z double")
    roads = api.generate_roads(cells, 200, 200, 0.5)
    want = local.generated(grid, np.zeros((200, 200)), 0.5, 1.0)
    assert sorted((r["graph"], r["u"], r["v"], r["length"]) for r in roads.collect()) == sorted((t, *e[:3]) for t in (1, 2) for e in want)
    api.export(api.roads_for_export(roads), str(tmp_path / "bundle"))
    assert spark.read.text(str(tmp_path / "bundle" / "roads.geojsonl")).count() == 2 * len(want)


def test_extraction_of_a_cross():
    grid = np.zeros((60, 60), bool)
    grid[28:32, 5:55] = grid[5:55, 28:32] = True
    nodes, paths = local.trace(local.thin(grid))
    assert sum(d == 1 for d in nodes.values()) == 4 and any(d >= 3 for d in nodes.values())
    assert local.trace(local.thin(np.zeros((9, 9), bool))) == ({}, [])


def test_route_keeps_the_grade():
    heights = np.zeros((21, 21))
    heights[:, 10] = 50.0
    heights[0, 10] = 0.0
    path = local.route(heights, (10, 2), (10, 18), 8.0, 12.0)
    assert path and (0, 10) in path
    assert all(abs(heights[a] - heights[b]) / (8 * math.hypot(a[0] - b[0], a[1] - b[1])) <= 0.12 for a, b in zip(path, path[1:]))
    heights[0, 10] = 50.0
    assert local.route(heights, (10, 2), (10, 18), 8.0, 12.0) is None and local.route(heights, (1, 1), (1, 1), 8.0, 12.0) is None


def test_worlds_repeat(spark):
    a, b = (synth.synthesise(spark, "mountain_valley", 16, 3).orderBy("row", "col").collect() for _ in range(2))
    assert a == b and len(a) == 256
    assert synth.params("plain", 8000.0)["wavelength"] == 2 * synth.params("plain", 4000.0)["wavelength"]


def test_gate():
    gate = Gate([Source("a"), Source("q", tier="quarantined"), Source("p", pin="v2"), Source("t", role="training_only"), Source("o", family="ODbL"), Source("s", family="CC-BY-SA")])
    assert gate.open("a", purpose="training").source_id == "a"
    for bad in (lambda: gate.open("x"), lambda: gate.open("q"), lambda: gate.open("p", "v1"), lambda: gate.open("a", purpose="sale"), lambda: Gate([Source("a"), Source("a")])):
        with pytest.raises(ProvenanceError):
            bad()
    assert gate.exportable(["a"]) == [] and gate.exportable(["t", "x"]) == ["x: unknown", "t: for training only"]
    assert gate.exportable(["o", "s"]) == ["licence families that exclude each other"]


def test_text_las_zip_and_tiles(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3\r\n4 5 6\r\n\r\n")
    (tmp_path / "b.txt").write_text("1,10.5,20.5,30.5,1\n2,11,21,31,0\nbroken\n")
    got = sorted((r.x, r.y, r.z) for r in files.grid_text(spark, f"{tmp_path}/*.txt").collect())
    assert got == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0), (10.5, 20.5, 30.5), (11.0, 21.0, 31.0)]

    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, 3)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    body = b"".join(struct.pack("<iiiHBB", x, x, x, 0, 0, c).ljust(20, b"\0") for x, c in ((100, 2), (200, 5), (300, 2)))
    (tmp_path / "p.las").write_bytes(bytes(head) + body)
    points = files.las_points(spark, f"{tmp_path}/p.las")
    assert sorted((r.x, r.y, r.z, r.cls) for r in points.collect()) == [(101.0, 201.0, 1.0, 2), (102.0, 202.0, 2.0, 5), (103.0, 203.0, 3.0, 2)]
    assert files.ground_or_all(points).count() == 2 and files.ground_or_all(points.where("cls = 5")).count() == 1

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("dir/", "")
        z.writestr("dir/one.gml", "x" * 10)
        z.writestr("two.gml", "y")
    assert [(r.name, r.size) for r in files.zip_members(spark, f"{tmp_path}/z.zip").orderBy("ord").collect()] == [("dir/one.gml", 10), ("two.gml", 1)]

    zig = lambda v: (v << 1) ^ (v >> 31)
    shape = [9, zig(10), zig(20), 18, zig(5), zig(0), zig(0), zig(-7), 15]
    assert files.rings(shape) == [[(10, 20), (15, 20), (15, 13), (10, 20)]]
    field = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    feature = field(2, bytes([0, 0])) + field(4, bytes(shape))
    layer = field(1, b"mesh") + field(2, feature) + field(3, b"MESH_NO") + field(4, field(1, b"52385001")) + bytes([5 << 3, 0x80, 0x20])
    (tmp_path / "t.pbf").write_bytes(field(3, layer))
    row = files.index_features(spark, f"{tmp_path}/t.pbf").first()
    assert (row.mesh_no, row.url, row.minx, row.maxy) == ("52385001", None, 10 / 4096, 20 / 4096)


def test_wire_format_round_trips():
    rng = random.Random(6)

    def coded(n: int) -> bytes:
        out = b""
        while n >= 128:
            out, n = out + bytes([n % 128 + 128]), n // 128
        return out + bytes([n])

    numbers = [rng.randrange(1 << rng.randrange(1, 63)) for _ in range(500)] + [0, 127, 128, (1 << 63) - 1]
    assert files.packed(b"".join(map(coded, numbers))) == numbers and files.packed(b"") == []
    data = b"".join(coded(8 * i) + coded(n) + coded(8 * i + 2) + coded(i) + b"z" * i + coded(8 * i + 1) + struct.pack("<d", i / 4) + coded(8 * i + 5) + struct.pack("<f", 0.5) for i, n in enumerate(numbers[:200], 1))
    want = [(i, v) for i, n in enumerate(numbers[:200], 1) for v in (n, b"z" * i, i / 4, 0.5)]
    assert list(files.message(data)) == want and list(files.message(data + coded(11))) == want and list(files.message(b"")) == []
    zig = lambda v: (v << 1) ^ (v >> 63)
    shape, want, at = [], [], (0, 0)
    for _ in range(60):
        ring = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(rng.randrange(2, 9))]
        steps = [(x - a, y - b) for (x, y), (a, b) in zip(ring, [at, *ring])]
        shape += [9, *map(zig, steps[0]), (len(ring) - 1) << 3 | 2, *[zig(v) for s in steps[1:] for v in s]]
        at, closed = ring[-1], rng.random() < 0.5
        shape += [15] * closed
        want.append(ring + ring[:1] * closed)
    assert files.rings(shape) == want and files.rings([]) == [] and files.rings([15]) == []


def test_map_and_city_files(spark, tmp_path):
    (tmp_path / "m.osm").write_text("""<osm><node id="1" lat="35.0" lon="138.0"/><node id="2" lat="35.1" lon="138.1"/><node id="3" lat="x" lon="1"/>
      <way id="10"><nd ref="1"/><nd ref="2"/><tag k="highway" v="Primary"/></way><way id="11"><nd ref="1"/><tag k="highway" v="footway"/></way><way id="12"><nd ref="2"/></way></osm>""")
    assert sorted(r.id for r in files.map_nodes(spark, f"{tmp_path}/m.osm").collect()) == [1, 2]
    ways = files.map_ways(spark, f"{tmp_path}/m.osm")
    classes = spark.createDataFrame([("primary", "primary"), ("footway", "path")], "tag string, road_class string")
    assert sorted((r.way, r.pos, r.ref) for r in files.road_refs(ways, classes).collect()) == [(10, 0, 1), (10, 1, 2)]
    assert files.road_refs(ways, classes, keep_paths=True).count() == 3

    ring = lambda text: f"<gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{text}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface>"
    (tmp_path / "c.gml").write_text(f"""<core:CityModel xmlns:core="c" xmlns:gml="g" xmlns:bldg="b">
      <bldg:Building gml:id="b1"><bldg:usage>411</bldg:usage><bldg:yearOfConstruction>1998-04-01</bldg:yearOfConstruction><bldg:measuredHeight>7.5</bldg:measuredHeight><bldg:storeysAboveGround>2.0</bldg:storeysAboveGround><bldg:lod0RoofEdge>{ring("35 138 0 35 139 0 36 139 0")}</bldg:lod0RoofEdge></bldg:Building>
      <bldg:Building gml:id="b2"><bldg:usage>999</bldg:usage></bldg:Building></core:CityModel>""")
    rows = files.city_buildings(spark, f"{tmp_path}/c.gml").collect()
    assert [(r.id, r.usage, r.height, r.storeys, r.year, len(r.ring)) for r in rows] == [("b1", "411", 7.5, 2, 1998, 4)]

    (tmp_path / "l.json").write_text('{"features":[{"properties":{"code":"0700"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    assert [(r.code, len(r.ring)) for r in files.landuse(spark, f"{tmp_path}/l.json", "code").collect()] == [("0700", 4)]


def test_store_and_bundle(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "tile_id string, cell int, v double")
    sinks.write_tiles(cells, f"{tmp_path}/s")
    sinks.write_tiles(cells.where("tile_id = 'a'").withColumn("v", F.lit(9.0)), f"{tmp_path}/s")
    assert {(r.tile_id, r.v) for r in sinks.read_tiles(spark, f"{tmp_path}/s").collect()} == {("a", 9.0), ("b", 2.0)}
    assert [r.tile_id for r in sinks.list_tiles(spark, f"{tmp_path}/s").collect()] == ["a", "b"]
    edges = spark.createDataFrame([(1, [(0.0, 0.0, 1.0), (3.14159, 4.0, 1.0)], "path", 1.5)], "id long, line array<struct<x: double, y: double, z: double>>, road_class string, width_m double")
    sinks.write_bundle(edges, f"{tmp_path}/b")
    feature = spark.read.json(f"{tmp_path}/b/roads.geojsonl").first()
    assert feature.geometry.coordinates[1] == [3.142, 4.0, 1.0] and feature.properties.id == 1
    assert spark.read.json(f"{tmp_path}/b/manifest.json").first().units == "m"
