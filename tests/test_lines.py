"""Stitching, contour lines and overlaps of lines against plain loops."""

import math
import random
from collections import defaultdict
from fractions import Fraction

from waystone.operators import coverage, graph, terrain


def plain_stitched(ways, tolerance):
    """Ways joined greedily: the nearest pair of free ends of different ways first."""
    ends = [(w, s, x, y) for w, ax, ay, bx, by, _ in ways for s, x, y in ((0, ax, ay), (1, bx, by))]
    pairs = sorted((math.hypot(a[2] - b[2], a[3] - b[3]), a[0], a[1], b[0], b[1]) for a in ends for b in ends if a[0] < b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) <= tolerance)
    link = {}
    for _, w, s, w2, s2 in pairs:
        if (w, s) not in link and (w2, s2) not in link:
            link[w, s], link[w2, s2] = (w2, s2), (w, s)
    runs, seen = [], set()
    for w in sorted(x[0] for x in ways):
        if w not in seen:
            run, todo = set(), [w]
            while todo:
                v = todo.pop()
                if v not in run:
                    run.add(v)
                    todo += [link[v, s][0] for s in (0, 1) if (v, s) in link]
            seen |= run
            runs.append(run)
    return runs, link


def test_stitching_within_a_metre(spark):
    rng = random.Random(3)
    ways = []
    for k in range(150):
        a, b = (rng.randrange(12) * 10.0, rng.randrange(12) * 10.0), (rng.randrange(12) * 10.0, rng.randrange(12) * 10.0)
        off = lambda: rng.choice([0.0, 0.0, 0.45, 0.9, 2.0])
        ways.append((k, a[0] + off(), a[1], b[0] + off(), b[1], math.hypot(a[0] - b[0], a[1] - b[1])))
    found = graph.stitched(spark.createDataFrame(ways, "way long, ax double, ay double, bx double, by double, m double"), 1.0).collect()
    runs, link = plain_stitched(ways, 1.0)
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["pos"]):
        got[r["run"]].append(r["way"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, runs)) and len(found) == 150
    for order in got.values():
        for a, b in zip(order, order[1:], strict=False):
            assert any(link.get((a, s), (None,))[0] == b for s in (0, 1))
    size = {w[0]: w[5] for w in ways}
    places = sorted({(r["place"], r["run"], round(r["run_m"], 6)) for r in found})
    assert [p[0] for p in places] == list(range(1, len(runs) + 1)) and [p[2] for p in places] == sorted((p[2] for p in places), reverse=True)
    assert all(abs(m - sum(size[w] for w in got[run])) < 1e-5 for _, run, m in places)


def test_contours_are_lines_and_rings(spark):
    rng, cells = random.Random(4), []
    for tile in range(3):
        z = [[rng.randrange(6) + 0.5 for _ in range(12)] for _ in range(12)]
        cells += [(tile, r, c, None if tile == 2 and (r, c) == (5, 5) else z[r][c]) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(cells, "tile long, row long, col long, z double")
    levels = spark.createDataFrame([(t, [1, 3]) for t in range(3)], "tile long, levels array<long>")
    segments = terrain.contour_segments(df, levels)
    lines = defaultdict(list)
    closed = {}
    for r in sorted(terrain.contour_paths(segments).collect(), key=lambda r: r["pos"]):
        key = (r["tile"], r["level"], r["line"])
        lines[key].append((r["x"], r["y"]))
        closed[key] = r["closed"]
    drawn = defaultdict(int)
    for (tile, level, _), p in lines.items():
        for a, b in zip(p, p[1:], strict=False):
            drawn[tile, level, *sorted((a, b))] += 1
    want = defaultdict(int)
    degree = defaultdict(int)
    for s in segments.collect():
        a, b = (s["x0"], s["y0"]), (s["x1"], s["y1"])
        want[s["tile"], s["level"], *sorted((a, b))] += 1
        degree[s["tile"], s["level"], a] += 1
        degree[s["tile"], s["level"], b] += 1
    assert drawn == want
    for key, p in lines.items():
        assert closed[key] == (p[0] == p[-1])
        if not closed[key]:  # an open line ends where nothing goes on
            assert degree[key[0], key[1], p[0]] == degree[key[0], key[1], p[-1]] == 1
    assert any(closed.values()) and not all(closed.values()) and len(lines) == sum(closed.values()) + sum(1 for d in degree.values() if d == 1) // 2


def test_contours_go_on_across_tiles(spark):
    z = lambda r, c: math.hypot(r - 6.2, c - 7.3)
    cells = [(t, r, c, z(r, c)) for t in range(2) for r in range(14) for c in range(8 * t, 8 * t + 9)]
    df = spark.createDataFrame(cells, "tile long, row long, col long, z double")
    segments = terrain.contour_segments(df, spark.createDataFrame([(t, [4]) for t in range(2)], "tile long, levels array<long>"))
    apart, whole = terrain.contour_paths(segments), terrain.contour_paths(segments, across=True)
    assert apart.select("tile", "line").distinct().count() == 2 and apart.where("closed").isEmpty()
    assert whole.select("line").distinct().count() == 1 and whole.where("not closed").isEmpty()
    assert whole.count() == segments.count() + 1


def test_retraced_length(spark):
    rng, rows = random.Random(5), []
    for _ in range(400):
        x, y, n = rng.randrange(-6, 6), rng.randrange(-6, 6), rng.randrange(0, 7)
        dx, dy = rng.choice([(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (2, -1), (-2, 1)])
        rows.append((rng.choice("ab"), float(x), float(y), float(x + n * dx), float(y + n * dy)))
    got = {r["pen"]: r for r in coverage.retraced_length(spark.createDataFrame(rows, "pen string, x0 double, y0 double, x1 double, y1 double"), ["pen"]).collect()}
    for pen in "ab":
        drawn, unit = 0.0, {}
        for p, x0, y0, x1, y1 in rows:
            if p == pen and (x0, y0) != (x1, y1):
                drawn += math.hypot(x1 - x0, y1 - y0)
                n = math.gcd(int(x1 - x0), int(y1 - y0))
                at = [(Fraction(int(x0 * n + (x1 - x0) * k), n), Fraction(int(y0 * n + (y1 - y0) * k), n)) for k in range(n + 1)]
                for a, b in zip(at, at[1:], strict=False):
                    unit[tuple(sorted((a, b)))] = math.hypot(x1 - x0, y1 - y0) / n
        assert abs(got[pen]["drawn"] - drawn) < 1e-6 and abs(got[pen]["distinct"] - sum(unit.values())) < 1e-6
        assert abs(got[pen]["retraced"] - (drawn - sum(unit.values()))) < 1e-6


LEG = "sheet int, line_id int, pos int, layer string, width double, source string, x0 double, y0 double, x1 double, y1 double"


def sheet_rows(lines):
    return [(s, i, k, layer, w, source, *map(float, (*p, *q))) for s, i, layer, w, source, points in lines for k, (p, q) in enumerate(zip(points, points[1:], strict=False))]


def sampled_gap(a, b, radius, step=0.01):
    """The distance of two lines outside the discs around their crossings, by samples; None where nothing is left of one."""

    def dense(points):
        out = []
        for p, q in zip(points, points[1:], strict=False):
            n = max(1, int(math.hypot(q[0] - p[0], q[1] - p[1]) / step))
            out += [(p[0] + (q[0] - p[0]) * k / n, p[1] + (q[1] - p[1]) * k / n) for k in range(n + 1)]
        return out

    def cross(p, q, r, s):
        d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
        if abs(d) < 1e-12:
            return None
        t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
        u = ((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])) / d
        return (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])) if 0 <= t <= 1 and 0 <= u <= 1 else None

    hits = [h for p, q in zip(a, a[1:], strict=False) for r, s in zip(b, b[1:], strict=False) if (h := cross(p, q, r, s))]
    left = [[p for p in dense(line) if all(math.hypot(p[0] - h[0], p[1] - h[1]) >= radius for h in hits)] for line in (a, b)]
    return min((math.hypot(p[0] - q[0], p[1] - q[1]) for p in left[0] for q in left[1]), default=None)


def test_separation_outside_junctions(spark):
    lines = [
        (0, 1, "roads", 0.5, None, [(0, 0), (20, 0)]), (0, 2, "rail", 0.5, None, [(0, 1.9), (20, -2.1)]),  # an acute crossing of 11 degrees
        (1, 1, "roads", 0.5, None, [(0, 0), (10, 0)]), (1, 2, "rail", 0.5, None, [(0, 0), (4, 0), (4, 9)]),  # a stretch in common from a shared end
        (2, 1, "roads", 0.5, None, [(0, 0), (10, 0)]), (2, 2, "rail", 0.5, None, [(5, -5), (5, 5)]),  # a plain crossing
        (3, 1, "roads", 0.5, "way/1", [(0, 0), (10, 0)]), (3, 2, "rail", 0.5, "way/1", [(0, 0.2), (10, 0.2)]),  # one source
        (4, 1, "roads", 0.5, "way/1", [(0, 0), (10, 0)]), (4, 2, "rail", 0.5, "way/2", [(0, 0.2), (10, 0.2)]),
        (5, 1, "roads", 0.5, None, [(0, 0), (0.3, 0)]), (5, 2, "rail", 0.5, None, [(0, 0), (0, 0.3)]),  # nothing is left beside the junction
        (6, 1, "roads", 0.5, None, [(0, 0), (10, 0)]), (6, 2, "rail", 0.5, None, [(0, 0.5), (10, 0.5)]),  # as far apart as they must be
    ]
    got = {(r["sheet"], r["a"], r["b"]): r["gap"] for r in coverage.separations(spark.createDataFrame(sheet_rows(lines), LEG), 3.0, 0.5).collect()}
    assert set(got) == {(0, 1, 2), (1, 1, 2), (4, 1, 2)} and got[1, 1, 2] == 0.0 and abs(got[4, 1, 2] - 0.2) < 1e-9 and 0.15 < got[0, 1, 2] < 0.25


def test_separations_equal_samples(spark):
    rng, lines = random.Random(6), []
    for sheet in range(12):
        for i in range(3):
            points = [(rng.uniform(0, 6), rng.uniform(0, 6))]
            for _ in range(3):
                points.append((points[-1][0] + rng.uniform(-3, 3), points[-1][1] + rng.uniform(-3, 3)))
            lines.append((sheet, i, "ab"[i % 2], 0.4, None, points))
    got = {(r["sheet"], r["a"], r["b"]): r["gap"] for r in coverage.separations(spark.createDataFrame(sheet_rows(lines), LEG), 2.0, 0.4).collect()}
    seen = 0
    for s, i, *_, a in lines:
        for s2, j, *_, b in lines:
            if s == s2 and i < j:
                want = sampled_gap(a, b, 0.8)
                if want is None or want > 0.44:
                    assert (s, i, j) not in got
                elif want < 0.36:
                    assert abs(got[s, i, j] - want) < 0.03
                    seen += 1
    assert seen >= 3


def test_crossing_lines_are_close(spark):
    from waystone.operators import joins

    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 10.0, 10.0, 0.0), (3, 50.0, 50.0, 60.0, 50.0)]
    got = joins.close_pairs(spark.createDataFrame(rows, "line_id int, x0 double, y0 double, x1 double, y1 double"), 0.5, 4.0).collect()
    assert [(r["a"], r["b"], r["gap"]) for r in got] == [(1, 2, 0.0)]


def test_two_core_takes_spurs_whole(spark, monkeypatch):
    """A net of rings with a spur of 2,000 edges, trees and loops: few tables, and what peeling leaf by leaf leaves."""
    rng = random.Random(9)
    edges = [(k, k, k + 1) for k in range(2_000)]
    n = 30_000
    edges += [(n + k, n + k, n + (k + 1) % 7) for k in range(7)] + [(n + 7, 0, n)]  # the spur hangs on a ring
    edges += [(n + 100 + k, n + 100 + k, n + 100 + rng.randrange(k + 1) - (1 if k else 0)) for k in range(1, 20)]  # a tree
    edges += [(n + 300, n + 500, n + 500), (n + 301, n + 500, n + 501)]  # a loop with a spur
    edges += [(n + 600 + k, n + 600 + rng.randrange(40), n + 600 + rng.randrange(40)) for k in range(50)]
    left = list(edges)
    while True:
        degree = defaultdict(int)
        for _, a, b in left:
            degree[a] += 1
            degree[b] += 1
        kept = [e for e in left if degree[e[1]] > 1 and degree[e[2]] > 1]
        if len(kept) == len(left):
            break
        left = kept
    tables, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: tables.append(1) or settled(df))
    got = sorted(r["edge_id"] for r in graph.two_core(spark.createDataFrame(edges, "edge_id long, a long, b long")).collect())
    assert got == sorted(e[0] for e in left) and len(tables) < 250 and n + 300 in got
