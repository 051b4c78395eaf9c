"""Queries without SQL over whole tables, against brute force on the smallest ones."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest

from quadrel.operators import local
from quadrel.plans import all_queries  # noqa: F401
from quadrel.plans import relations as rel
from quadrel.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    """graph -> (u, v, length, id) of all segments, and the places of its nodes."""
    edges, places = defaultdict(list), defaultdict(dict)
    for s in rel.segments(spark, SMALL).collect():
        edges[s.graph].append((s.u, s.v, math.hypot(s.vx - s.ux, s.vy - s.uy), s.id))
        places[s.graph] |= {s.u: (s.ux, s.uy), s.v: (s.vx, s.vy)}
    return edges, places


def near(places: dict, most: float) -> list:
    at = sorted(places.items())
    return [(math.hypot(x - p, y - q), a, b) for i, (a, (x, y)) in enumerate(at) for b, (p, q) in at[i + 1 :] if math.hypot(x - p, y - q) <= most]


def test_greedy_steps_meet_all_nodes(spark, whole):
    pairs, merged = set(), set()
    for graph, places in whole[1].items():
        left, right, gone = set(), set(), {}
        for _, a, b in sorted(near(places, 60.0)):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                pairs.add((graph, a, b))
        for _, a, b in sorted(near(places, 30.0), key=lambda p: p[1:]):
            if a not in gone and b not in gone:
                gone[b] = a
        merged |= {(graph, b, a) for b, a in gone.items()}
    assert {(r.graph, r.a, r.b) for r in QUERIES["j10_greedy_matches"](spark, SMALL).collect()} == pairs
    assert {(r.graph, r.node, r.into) for r in QUERIES["j11_merged_nodes"](spark, SMALL).collect()} == merged


def test_paths_use_all_edges(spark, whole):
    want = {}
    for graph, edges in whole[0].items():
        start = min(u for u, *_ in edges)
        best, changed = {start: 0.0}, True
        while changed:
            changed = False
            for u, v, d, _ in [*edges, *[(v, u, d, i) for u, v, d, i in edges]]:
                if u in best and best[u] + d < best.get(v, math.inf):
                    best[v], changed = best[u] + d, True
        want |= {(graph, n): d for n, d in best.items() if d <= 3000.0}
    got = {(r.graph, r.node): r.distance for r in QUERIES["gr7_shortest_paths"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-3) for k in want)


def test_agreement_and_repair_see_all_edges(spark, whole):
    agreed = {r.graph: r for r in QUERIES["gr8_graph_agreement"](spark, SMALL).collect()}
    mended = {r.graph: r for r in QUERIES["gr16_repair"](spark, SMALL).collect()}
    assert agreed.keys() == mended.keys() == whole[0].keys()
    for graph, edges in whole[0].items():
        truth, places = [e[:3] for e in edges], whole[1][graph]
        own = [e[:3] for e in edges if e[3] % 9]
        held = {n: places[n] for e in own for n in e[:2]}
        assert math.isclose(agreed[graph].apls, local.apls(truth, places, own, held, 10.0), abs_tol=1e-9)
        assert tuple(agreed[graph])[2:] == local.topo(truth, places, own, held, 10.0)
        after, report = local.repair(truth, places, gap=60.0, snap=30.0, stub=40.0)
        assert tuple(mended[graph])[1:] == (len(edges), len(after), *report.values())


def test_path_lengths_from_both_ends(whole):
    for edges in list(whole[0].values())[:3]:
        adjacent = local.adjacency(e[:3] for e in edges)
        for start in sorted(adjacent)[:20]:
            from_start = local.distances(adjacent, start)
            assert all(math.isclose(local.distance(adjacent, start, n), from_start.get(n, math.inf), abs_tol=1e-9) for n in adjacent)


def test_sampled_pairs_are_those_of_the_whole_list():
    import numpy as np

    ids = list(range(0, 400, 2))
    every = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    drawn = sorted(np.random.default_rng(0).choice(len(every), 90, replace=False))
    assert local.sampled_pairs(ids, 90) == [every[i] for i in drawn] and local.sampled_pairs(ids[:5], 90) == [(a, b) for i, a in enumerate(ids[:5]) for b in ids[i + 1 : 5]]


@pytest.mark.parametrize(("name", "key"), [("gr11_extracted_graphs", "graph"), ("gr17_routes", "tile")])
def test_each_tile_has_a_row(spark, name, key):
    tiles = {r.tile for r in rel.stack(spark, SMALL).select("tile").distinct().collect()}
    rows = QUERIES[name](spark, SMALL).collect()
    assert len(rows) == len(tiles) and {r[key] for r in rows} == tiles


def test_topo_sees_breaks_beyond_the_smallest_ids():
    places = {i: (100.0 * i, 0.0) for i in range(200)}
    edges = [(i, i + 1, 100.0) for i in range(199)]
    cut = [e for e in edges if e[0] != 150]
    precision, recall, _ = local.topo(edges, places, cut, places, 10.0)
    reached = sum(min(199, i + 3) - max(0, i - 3) + 1 for i in range(200))
    kept = sum(min(150 if i <= 150 else 199, i + 3) - max(0 if i <= 150 else 151, i - 3) + 1 for i in range(200))
    assert (precision, recall) == (1.0, kept / reached) and recall < 1.0


def test_topo_takes_matched_seeds_only():
    places = {i: (100.0 * i, 0.0) for i in range(5)}
    edges = [(i, i + 1, 100.0) for i in range(4)]
    assert local.topo(edges, places, edges, {4: places[4]}, 10.0, 100.0) == (0.5, 0.5, 0.5)
    assert local.topo(edges, places, edges, {}, 10.0) == (0.0, 0.0, 0.0)
