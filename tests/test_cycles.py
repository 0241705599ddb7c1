"""Nodes on cycles against a plain search."""

import random

import pytest

from waystone.operators import graph


def plain(edges):
    out, on = {}, set()
    for a, b in edges:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    for start in out:
        seen, todo = set(), list(out[start])
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += out.get(v, ())
        if start in seen:
            on.add(start)
    return on


def found(spark, edges):
    rows = graph.reachable_from_itself(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"] for r in rows}


@pytest.mark.parametrize(("n", "m", "seed"), [(60, 62, 1), (80, 150, 3)])
def test_random_edges(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 3), (4, None)]
    assert found(spark, edges) == plain(edges)


def test_rings_chains_and_knots(spark):
    ring = [(i, (i + 1) % 5000) for i in range(5000)]
    tail = [(4999, 10_000)] + [(10_000 + i, 10_001 + i) for i in range(3000)]  # out of the ring, to nowhere
    apart = [(20_000 + i, 20_001 + i) for i in range(2000)]
    knot = [(30_000, 30_001), (30_001, 30_002), (30_002, 30_000), (30_002, 30_003), (30_003, 30_004), (30_004, 30_005), (30_005, 30_004), (30_001, 30_006), (30_006, 30_002)]
    two = [(40_000, 40_001), (40_001, 40_000), (40_001, 40_002), (40_002, 40_003), (40_003, 40_004), (40_004, 40_003), (40_000, 40_005), (40_005, 40_001)]
    want = set(range(5000)) | {30_000, 30_001, 30_002, 30_004, 30_005, 30_006, 40_000, 40_001, 40_003, 40_004, 40_005, 50_000}
    assert found(spark, ring + tail + apart + knot + two + [(50_000, 50_000), (50_000, 50_001), (50_000, 50_001)]) == want


def test_without_cycles(spark):
    assert found(spark, []) == set() and found(spark, [(1, 2), (2, 3), (1, 3)]) == set()
