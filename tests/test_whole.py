"""Queries without SQL read their whole tables: against plain Python, on rows that a filter had left out."""

import heapq
import math
import random
from collections import Counter, defaultdict
from itertools import pairwise

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from waystone.operators import joins
from waystone.plans import catalog, q_routes
from waystone.plans.fixtures import VIEWS, Inputs

SMALL = "/root/testdata/sf0.001"


def ways(keep=lambda way: True):
    """(way, pos, a, b) of lineitem by plain Python."""
    by = defaultdict(list)
    for r in pq.read_table(f"{SMALL}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).to_pylist():
        if keep(r["l_orderkey"]):
            by[r["l_orderkey"]].append(tuple(r[c] for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    return [(w, i, p[1], q[1]) for w, rows in by.items() for i, (p, q) in enumerate(pairwise(sorted(rows))) if p[1] != q[1]]


def test_stitched_runs_hold_every_way(spark):
    got = [r["way"] for r in catalog.QUERIES["o8_10_stitched_runs"](spark, SMALL).collect()]
    assert sorted(got) == sorted(pq.read_table(f"{SMALL}/orders.parquet")["o_orderkey"].to_pylist())


def test_two_core_and_laps_of_all_ways(spark):
    left = ways()
    while True:
        degree = Counter(n for e in left for n in e[2:])
        after = [e for e in left if degree[e[2]] > 1 and degree[e[3]] > 1]
        if len(after) == len(left):
            break
        left = after
    assert sorted(r[0] for r in catalog.QUERIES["o8_14_two_core"](spark, SMALL).collect()) == sorted(w * 10000 + i for w, i, _, _ in left)
    laps = catalog.QUERIES["o8_13_lap_ways"](spark, SMALL).collect()
    assert sum(r["ways"] for r in laps) == len(left) and sum(r["starts"] for r in laps) == len({e[2] for e in left})


def net():
    """(way, pos, a, b) of the view fx_net_node by plain Python."""
    by = defaultdict(list)
    for r in pq.read_table(f"{SMALL}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).to_pylist():
        by[r["l_orderkey"]].append(tuple(r[c] for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    node = lambda w, part: w // 10 * 20 + part % 20
    each = [(w, i, node(w, p[1]), node(w, q[1])) for w, rows in by.items() for i, (p, q) in enumerate(pairwise(sorted(rows)))]
    return [e for e in each if e[2] != e[3]]


def test_corridor_legs_of_every_way(spark):
    at = lambda n: ((n * 7919) % 10000 / 1e4, (n * 104729) % 10000 / 1e4)
    near, ends = defaultdict(dict), {}
    for w, _, a, b in sorted(net()):
        near[a][b] = near[b][a] = math.dist(at(a), at(b))
        ends[w] = (ends.get(w, (a,))[0], b)
    got = {r["query"]: r for r in catalog.QUERIES["o8_21_corridor_legs"](spark, SMALL).collect()}
    assert set(got) == set(ends)
    for w, (source, target) in ends.items():
        if w % 50 == 0:
            assert got[w]["status"] == "no-anchor" and got[w]["m"] is None
            continue
        far, heap = {}, [(0.0, source)]
        while heap:
            d, n = heapq.heappop(heap)
            if n not in far:
                far[n] = d
                for o, m in near[n].items():
                    heapq.heappush(heap, (d + m, o))
        assert math.isclose(got[w]["m"], far[target], abs_tol=2e-6)
        straight = math.dist(at(source), at(target))
        assert got[w]["paths"] > 1 or abs(far[target] - 1.8 * straight) < 1e-5 or got[w]["status"] == ("accepted" if far[target] <= 1.8 * straight else "detour")


def test_contours_of_every_tile(spark, tmp_path):
    rng = random.Random(2)
    table = pa.table({"vec_id": pa.array([5, 300, 4711], pa.int64()), "embedding": pa.array([[rng.uniform(-1, 1) for _ in range(64)] for _ in range(3)], pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    assert {r["tile"] for r in catalog.QUERIES["o8_18_contours"](spark, str(tmp_path)).collect()} == {5, 300, 4711}


def test_host_roads_of_every_track_and_leg(spark):
    """Track 3 runs along track 53 all the way, track 10 along track 60 from its 20th point on, track 11 far from 61."""
    rows = [(track, pos, pos / 1000, 51.0 + (5.0 if track == 61 or track == 60 and pos < 20 else 0.0)) for track in (3, 53, 10, 60, 11, 61) for pos in range(60)]
    points = spark.createDataFrame(rows, "track_id long, pos int, lon double, lat double")
    got = {r["line_id"]: r["dropped"] for r in q_routes.host_roads(lambda name: points).collect()}
    assert got == {3: True, 10: True, 11: False}


def test_nesting_deeper_than_the_rounds_raises(spark):
    nest = spark.createDataFrame([(i, i + 1, False, i == 5) for i in range(6)], "parent long, child long, inner boolean, leaf boolean")
    assert (0, 6, False, 6) in {tuple(r) for r in joins.nested_members(nest).collect()}
    with pytest.raises(RuntimeError):
        joins.nested_members(nest, rounds=3)


def test_strokes_are_the_views_without_one_task(spark):
    t = Inputs(spark, SMALL)
    t("lineitem").createOrReplaceTempView("lineitem")
    view, got = spark.sql(VIEWS["fx_stroke"]), t("fx_stroke")
    assert got.dtypes == view.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, view.collect()))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert not [x for x in plan.splitlines() if "Window [" in x and "l_linenumber" in x and "_range" not in x]
