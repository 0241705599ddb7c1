"""Exact stretches of lines against plain geometry."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from waystone.operators import covers
from waystone.plans import catalog

SMALL = "/root/testdata/sf0.001"
LEG = "line_id long, pos long, x0 double, y0 double, x1 double, y1 double"


def legs_of(lines):
    return [(k, i, *a, *b) for k, pts in lines.items() for i, (a, b) in enumerate(zip(pts, pts[1:], strict=False))]


def gap(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size)) if size else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def at(a, b, t):
    return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])


def plain_part(a, b, c, d, reach):
    """Where a leg is within reach of an edge: the distance is convex along it, so its least place is searched, then both sides."""
    if any(min(a[i], b[i]) > max(c[i], d[i]) + reach or min(c[i], d[i]) > max(a[i], b[i]) + reach for i in (0, 1)):
        return None
    f = lambda t: gap(at(a, b, t), c, d)
    low, high = 0.0, 1.0
    for _ in range(90):
        u, v = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, v) if f(u) <= f(v) else (u, high)
    best = min((low, 0.0, 1.0), key=f)
    if f(best) > reach:
        return None
    ends = []
    for far in (0.0, 1.0):
        ok, bad = best, far
        if f(far) <= reach:
            ends.append(far)
            continue
        for _ in range(50):
            mid = (ok + bad) / 2
            ok, bad = (mid, bad) if f(mid) <= reach else (ok, mid)
        ends.append(ok)
    return tuple(ends)


def union(found):
    out = []
    for s, e in sorted(found):
        if out and s <= out[-1][1] + 1e-9:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def length(pts):
    return sum(math.dist(a, b) for a, b in zip(pts, pts[1:], strict=False))


def inside(p, edges):
    odd = False
    for a, b in edges:
        if (b[1] > p[1]) != (a[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def test_parts_near_an_edge(spark):
    rng = random.Random(1)
    pick = lambda: (float(rng.randrange(8)), float(rng.randrange(8)))
    rows = [(i, *pick(), *pick(), *pick(), *pick()) for i in range(400)]  # a grid, so parallel, shared and empty ones come up
    df = spark.createDataFrame(rows, "i long, x0 double, y0 double, x1 double, y1 double, a0 double, b0 double, a1 double, b1 double")
    got = {r["i"]: r["p"] for r in covers.with_capsule_part(df, ("x0", "y0", "x1", "y1"), ("a0", "b0", "a1", "b1"), 0.7).selectExpr("i", "part as p").collect()}
    assert sum(p is not None for p in got.values()) > 100
    for i, ax, ay, bx, by, cx, cy, dx, dy in rows:
        want = None if (ax, ay) == (bx, by) else plain_part((ax, ay), (bx, by), (cx, cy), (dx, dy), 0.7)
        if want is None or want[1] - want[0] < 1e-6:
            assert got[i] is None or got[i]["t1"] - got[i]["t0"] < 1e-5
        else:
            assert abs(got[i]["t0"] - want[0]) < 1e-6 and abs(got[i]["t1"] - want[1]) < 1e-6


def test_what_rings_leave_of_lines(spark):
    rng = random.Random(2)
    lines = {k: [(rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(5)] for k in range(12)}
    lines[12] = [(-5.0, 10.0), (45.0, 10.0)]  # along a ring's edge, through its hole's corners
    lines[13] = [(100.0, 100.0), (110.0, 100.0)]  # far from all
    lines[14] = [(12.0, 12.0), (13.0, 12.0)]  # wholly inside
    rings = {50: [[(5, 5), (20, 5), (20, 20), (5, 20)], [(8, 8), (10, 8), (10, 10), (8, 10)]], 51: [[(15, 15), (35, 18), (30, 35)]], 52: [[(0, 10), (4, 10), (4, 14), (0, 14)]]}
    edges = {k: [(r[i], r[(i + 1) % len(r)]) for r in parts for i in range(len(r))] for k, parts in rings.items()}
    ring_rows = [(k, i, *map(float, a), *map(float, b)) for k, es in edges.items() for i, (a, b) in enumerate(es)]
    legs = covers.measured(spark.createDataFrame(legs_of(lines), LEG))
    ringed = spark.createDataFrame(ring_rows, LEG.replace("line_id", "ring_id"))
    for buffer in (0.0, 0.6):
        parts = covers.stretches(covers.inside_parts(legs, ringed, 7.0, buffer), legs)
        shown, sums = defaultdict(list), {r["line_id"]: r for r in covers.suppressed(parts, legs).collect()}
        for r in covers.visible(parts, legs).orderBy("line_id", "part").collect():
            shown[r["line_id"]].append((r["s"], r["e"]))
        assert shown[13] == [(0.0, 10.0)] and 14 not in shown and set(sums) == set(lines)
        for k, pts in lines.items():
            done, wrong = 0.0, 0
            for a, b in zip(pts, pts[1:], strict=False):
                m = math.dist(a, b)
                for j in range(int(m / 0.05)):
                    d = j * 0.05
                    if k == 12 and buffer == 0.0 or any(abs(done + d - x) < 1e-6 for v in shown[k] for x in v):
                        continue
                    p = at(a, b, d / m)
                    covered = any(inside(p, es) or buffer and min(gap(p, c, e) for c, e in es) <= buffer for es in edges.values())
                    wrong += covered == any(s <= done + d <= e for s, e in shown[k])
                done += m
            assert not wrong, (k, buffer)
            assert math.isclose(sums[k]["length"], length(pts)) and math.isclose(sums[k]["shown"], sum(e - s for s, e in shown[k]), abs_tol=1e-5)
            assert math.isclose(sums[k]["covered"], length(pts) - sums[k]["shown"], abs_tol=1e-9)


def plain_thinned(lines, reach, ratio, degrees=None):
    kept, out = [], {}
    for k in sorted(lines, key=lambda k: (-length(lines[k]), k)):
        found, d0 = [], 0.0
        for a, b in zip(lines[k], lines[k][1:], strict=False):
            m = math.dist(a, b)
            for other in kept:
                for c, e in zip(lines[other], lines[other][1:], strict=False):
                    cosine = abs((b[0] - a[0]) * (e[0] - c[0]) + (b[1] - a[1]) * (e[1] - c[1])) / (m * math.dist(c, e))
                    part = plain_part(a, b, c, e, reach)
                    if part and (degrees is None or cosine + 1e-12 >= math.cos(math.radians(degrees))):
                        found.append((d0 + part[0] * m, d0 + part[1] * m))
            d0 += m
        out[k] = sum(e - s for s, e in union(found)) / d0 >= ratio
        if not out[k]:
            kept.append(k)
    return out


def test_parallel_lines_are_thinned_longest_first(spark):
    rng = random.Random(5)
    lines = {}
    for k in range(90):
        x, y = rng.uniform(0, 20), rng.choice([0.0, 0.4, 0.8, 1.2, 5.0, 5.5])
        lines[k] = [(x, y), (x + rng.uniform(1, 6), y + rng.choice([0.0, 0.2])), (x + 7, y + rng.choice([0.0, 3.0]))]
    lines[90] = lines[3]  # a copy goes, whichever is later
    df = spark.createDataFrame(legs_of(lines), LEG)
    for degrees in (None, 20.0):
        got = {r["line_id"]: r["dropped"] for r in covers.thinned(df, 0.5, 0.8, 2.0, most_degrees=degrees).collect()}
        want = plain_thinned(lines, 0.5, 0.8, degrees)
        assert got == want and 10 < sum(want.values()) < 80 and got[90]
    split = df.withColumn("sheet", F.col("line_id"))
    assert not any(r["dropped"] for r in covers.thinned(split, 0.5, 0.8, 2.0, ("sheet",)).collect())


def test_stretches_between_banks(spark):
    river = {1: [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)], 2: [(0.0, 50.0), (9.0, 50.0)], 3: [(0.0, 90.0), (0.5, 90.0)], 4: [(0.0, 120.0), (12.0, 120.0)]}
    banks = {10: [(4.0, 1.0), (12.0, 1.2)], 11: [(3.0, -1.1), (13.0, -1.0)], 12: [(0.0, 51.0), (9.0, 51.0)], 13: [(-1.0, 91.0), (2.0, 91.0)], 14: [(-1.0, 89.0), (2.0, 89.0)], 15: [(5.0, 121.0), (5.5, 121.0)], 16: [(5.0, 119.0), (5.5, 119.0)]}
    legs = covers.measured(spark.createDataFrame(legs_of(river), LEG))
    found = {r["line_id"]: (r["s"], r["e"]) for r in covers.flanked_stretches(legs, spark.createDataFrame(legs_of(banks), LEG), 3.0, 5.0).collect()}
    step = 20.0 / 27
    middles = [i for i in range(27) if 4.0 <= (i + 0.5) * step <= 12.0]
    assert set(found) == {1, 3} and found[3] == (0.0, 0.5)  # 2: one bank only; 4: one interval of sixteen by chance
    assert math.isclose(found[1][0], middles[0] * step) and math.isclose(found[1][1], (middles[-1] + 1) * step)
    left = covers.visible(spark.createDataFrame([(k, *v) for k, v in found.items()], "line_id long, s double, e double"), legs).collect()
    assert sorted((r["line_id"], r["part"]) for r in left) == [(1, 1), (1, 2), (2, 1), (4, 1)]


def test_without_rows(spark):
    none, rings = spark.createDataFrame([], LEG), spark.createDataFrame([], LEG.replace("line_id", "ring_id"))
    legs = covers.measured(none)
    parts = covers.stretches(covers.inside_parts(legs, rings, 1.0, 0.5), legs)
    assert not covers.visible(parts, legs).collect() and not covers.thinned(none, 1.0, 0.5, 1.0).collect()
    assert not covers.flanked_stretches(legs, none, 1.0, 1.0).collect()


def test_queries_of_covers(spark):
    lines = defaultdict(list)
    from waystone.plans.fixtures import Inputs
    from waystone.plans.q_joins import plane

    for r in plane(Inputs(spark, SMALL)).orderBy("line_id", "pos").collect():
        lines[r["line_id"]] = lines[r["line_id"]] or [(r["x0"], r["y0"])]
        lines[r["line_id"]].append((r["x1"], r["y1"]))
    got = {r["line_id"]: r["dropped"] for r in catalog.QUERIES["o4_18_thinned_lines"](spark, SMALL).collect()}
    assert got == plain_thinned(lines, 0.15, 0.5)
