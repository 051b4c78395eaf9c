"""Queries over small tables of odd rows, against their SQL or brute force."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quadrel.operators import local, rangejoin
from quadrel.plans import all_queries  # noqa: F401
from quadrel.plans.catalog import ORACLES, QUERIES


def both(spark, folder, name: str, **tables: pa.Table) -> tuple[list, list]:
    """Rows of the query and of its SQL over the tables, sorted."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(folder)).select(*want.columns)
    return sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


def test_reports_print_as_c_does(spark, tmp_path):
    prices = [[62500.0], [187500.0], [1000500.0], [2001500.0], [8500.0, 1000.0], [None], [None, 4500.9], [-0.5], [float("nan")], [float("inf")], [200000.5, 1e16]]
    rows = [(k, p) for k, ps in enumerate(prices) for p in ps] + [(100 + k, 1000.0 * k + 500) for k in range(400)]
    orders = pa.table({"o_orderkey": pa.array(range(len(rows)), pa.int64()), "o_custkey": pa.array([k for k, _ in rows], pa.int64()), "o_totalprice": pa.array([p for _, p in rows], pa.float64())})
    got, want = both(spark, tmp_path, "a35_fetch_reports", orders=orders)
    assert got == want


def test_merge_takes_one_row_of_an_id_that_ways_share(spark, tmp_path):
    """Way 6 has 18 references: its last edge and the first of way 7 have the same id, 112; way 8's and 9's share 144."""
    rows = [(6, p, 100 - p) for p in range(18)] + [(7, 0, 50), (7, 1, 51)] + [(8, p, 100 - p) for p in range(18)] + [(9, 0, 90), (9, 1, 91)]
    lines = pa.table({"l_orderkey": pa.array([w for w, _, _ in rows], pa.int64()), "l_linenumber": pa.array([p for _, p, _ in rows], pa.int32()), "l_partkey": pa.array([r for *_, r in rows], pa.int64())})
    got, want = both(spark, tmp_path, "j22_merge_first_wins", lineitem=lines)
    assert len(got) == len(want) and [r for r in got if r[1] not in (112, 144)] == [r for r in want if r[1] not in (112, 144)]
    assert [r for r in got if r[1] in (112, 144)] == [(106, 112, 85), (8, 144, 84)]


def test_greedy_steps_over_many_points_of_one_place(spark):
    """800 points lie at 6 places; the outcome equals that of the list of pairs."""
    points = spark.createDataFrame([(k % 2, k, float(7 * (k // 3 % 3)), float(4 * (k * 7 % 11 % 2))) for k in range(0, 2400, 3)] + [(1, 5000 + k, 3.0 * k, 5.0 * k) for k in range(40)], "graph int, id long, x double, y double")
    pairs = rangejoin.near_pairs(points, 10.0, ["graph"]).withColumn("d", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    got, want = local.matched_points(points, 10.0), local.greedy_match(pairs)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[:3] for r in got.collect()} == {tuple(r)[:3] for r in want.collect()}
    assert {tuple(r) for r in local.merged_points(points, 10.0).collect()} == {tuple(r) for r in local.greedy_merge(pairs).collect()}


def test_many_equal_boxes_touch(spark):
    """900 rows of 4 boxes, in several blocks each, one id twice, one without a side: 9 candidates of blocks a box at most."""
    rows = [(k, float(50 * (k % 4)), 0.0, 50.0 * (k % 4) + (50.0 if k % 4 else 40.0), 10.0 + k % 2) for k in range(900)] + [(3, 0.0, 5.0, 1.0, 9.0), (1000, 0.0, 0.0, None, None)]
    boxes = spark.createDataFrame(rows, "id long, x double, y double, x2 double, y2 double")
    known = [r for r in rows if r[3] is not None]
    want = sorted((a[0], b[0]) for a in known for b in known if a[0] < b[0] and a[3] >= b[1] and b[3] >= a[1] and a[4] >= b[2] and b[4] >= a[2])
    assert sorted(map(tuple, rangejoin.touching_boxes(boxes, 60.0).collect())) == want
    assert rangejoin.blocks(boxes, ["x", "y", "x2", "y2"]).count() == 5


def test_close_pairs_of_many_points_of_one_place(spark):
    rows = [(k, float(k % 3) * 6, 0.0) for k in range(900)] + [(2000, 500.0, 500.0), (2001, None, 1.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    made = rangejoin.near_by_place(points, 6.0)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    pairs = rangejoin.near_pairs(points, 6.0).select("a", "b", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, pairs.collect()))


def test_rows_meet_all_points_of_a_place(spark):
    rows = spark.createDataFrame([(w, float(w % 3)) for w in range(30)] + [(99, None)], "way long, x double")
    points = spark.createDataFrame([(k, float(k % 4)) for k in range(2000)], "id long, x double")
    got = rangejoin.at_places(rows, points, ["x"])
    assert sorted((r.way, r.id) for r in got.collect()) == [(w, k) for w in range(30) for k in range(2000) if w % 3 == k % 4]
    assert rangejoin.blocks(points, ["x"]).count() == 8


def test_rows_meet_points_place_by_place(spark):
    """In each task all rows of a place come before those of the next; nulls, doubles and lone rows as a plain join has them."""
    rows = spark.createDataFrame([(w, float(w % 3), 0.0) for w in range(90)] + [(7, 1.0, 0.0), (99, None, 0.0), (100, 9.0, 0.0)], "way long, x double, y double")
    points = spark.createDataFrame([(k, float(k % 4), 0.0) for k in range(1200)] + [(5000, None, 0.0)], "id long, x double, y double")
    made = rangejoin.at_places(rows, points, ["x", "y"])
    got = made.withColumn("task", F.spark_partition_id()).collect()
    runs = [(r.task, r.x) for r, after in zip(got, [*got[1:], None]) if after is None or (r.task, r.x) != (after.task, after.x)]
    assert len(runs) == len(set(runs)) and len({x for _, x in runs}) == 3
    plain = rows.join(points, ["x", "y"]).select(*rows.columns, "id")
    assert made.columns == plain.columns and sorted(tuple(r)[:4] for r in got) == sorted(map(tuple, plain.collect()))


def test_repair_of_many_ends_of_one_place(monkeypatch):
    """1000 dead ends at one place are bridged two by two, without a list of their pairs."""
    monkeypatch.setattr(local, "close_pairs", None)
    edges = [(2 * k, 2 * k + 1, 100.0) for k in range(1000)]
    nodes = {n: (0.0, 0.0) if n % 2 == 0 else (1000.0 * n, 500.0) for n in range(2000)}
    left, report = local.repair(edges, nodes)
    assert report == {"dropped": 0, "bridged": 500, "snapped": 0, "pruned": 0}
    assert sorted(left[1000:]) == [(4 * k, 4 * k + 2, 0.0) for k in range(500)]


def test_matching_of_many_nodes_of_one_place(monkeypatch):
    monkeypatch.setattr(local, "close_pairs", None)
    places = dict.fromkeys(range(3000), (5.0, 5.0)) | {3000: (8.0, 9.0)}
    assert local.matched(places, places, 10.0) == {n: n for n in places}
    assert local.matched({7: (0.0, 0.0)}, {1: (3.0, 4.0), 0: (5.0, 0.0), 2: (1.0, 9.0)}, 5.0) == {7: 0}
