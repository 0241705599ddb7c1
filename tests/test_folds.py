"""Rules that depend on what was kept before, against plain loops, and on groups of half a million rows."""

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from waystone.functions.geo import metres
from waystone.operators import graph, select, tracks


def points(spark, rows):
    return spark.createDataFrame(rows, "track_id long, seg long, pos long, lon double, lat double, ele double, ts timestamp_ntz, stays boolean")


def some_rows(seed):
    import datetime

    rng, rows = random.Random(seed), []
    for track in range(3):
        for seg in range(3):
            lon, lat, t = rng.random(), 51 + rng.random(), datetime.datetime(2024, 1, 1)
            step = 0.0002 if seg else 0.02  # a segment of long legs beside one of short ones
            for k in range(rng.choice([1, 3, 4, 60])):
                lon, lat = lon + rng.uniform(0, step), lat + rng.uniform(-step, step)
                off = 30 * step if rng.random() < 0.1 else 0
                t += datetime.timedelta(seconds=rng.choice([0, 1, 60, 5000]))
                rows.append((track, seg, 100 * seg + k, lon, lat + off, rng.choice([None, 1.0, 2.0, float(k)]), t, rng.random() < 0.05))
                if rng.random() < 0.2:
                    rows[-1] = (*rows[-1][:3], *(rows[-2][3:5] if k else (lon, lat)), *rows[-1][5:])
    return rows


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[:2], []).append(r)
    return out


def plain_spikes(rows, least, ratio, times, speed=None, preserve=False):
    gone = {}
    for p in groups(rows).values():
        if len(p) < 4:
            continue
        legs = [m for a, b in zip(p, p[1:], strict=False) if (m := metres(*a[3:5], *b[3:5])) > 1e-6]
        gate = max(least, (statistics.median(legs) if legs else 0) * times)
        last = p[0]
        for here, following in zip(p[1:], p[2:], strict=False):
            a, b, c = metres(*last[3:5], *here[3:5]), metres(*here[3:5], *following[3:5]), metres(*last[3:5], *following[3:5])
            speeds = [m / dt for m, dt in ((a, (here[6] - last[6]).total_seconds()), (b, (following[6] - here[6]).total_seconds())) if dt > 0]
            fast = speed is None or not speeds or max(speeds) > speed
            if a >= gate and b >= gate and (a + b) / max(c, 0.01) >= ratio and fast and not (preserve and here[7]):
                gone[here[0], here[2]] = a + b
            else:
                last = here
    return gone


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("speed", "preserve"), [(None, False), (None, True), (20.0, False)])
def test_spikes(spark, seed, speed, preserve):
    rows = some_rows(seed)
    found = tracks.spikes(points(spark, rows), 30.0, 8.0, 8.0, speed_m_s=speed, preserved="stays" if preserve else None)
    got = {(r["track_id"], r["pos"]): r["detour_m"] for r in found.collect()}
    want = plain_spikes(rows, 30.0, 8.0, 8.0, speed, preserve)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got) and want


def test_spike_of_a_short_segment_beside_a_long_one(spark):
    """A detour of 90 m stands out in its segment, whatever the legs of another segment of the track."""
    import datetime

    at = datetime.datetime(2024, 1, 1)
    short = [(1, 0, k, 0.0, 51 + k * 0.00001 + (0.0009 if k == 5 else 0), None, at, False) for k in range(10)]
    far = [(1, 1, 20 + k, 0.0, 52 + k * 0.01, None, at, False) for k in range(10)]
    assert [r["pos"] for r in tracks.spikes(points(spark, short + far), 30.0, 8.0, 8.0).collect()] == [5]


def test_deduplicated_points(spark):
    rows = some_rows(3)
    got = {(r["track_id"], r["pos"]): (r["ele"], r["stays"], r["separation_m"]) for r in tracks.deduplicated(points(spark, rows), 5.0, merged=("ele",), either=("stays",)).collect()}
    want = {}
    for p in groups(rows).values():
        last = None
        for r in p:
            away = metres(*last[3:5], *r[3:5]) if last else None
            if last and away <= 5.0 + 1e-9:
                last[5], last[7] = last[5] if r[5] is None else r[5], last[7] or r[7]
                want[r[0], r[2]] = (r[5], r[7], away)
            else:
                last = list(r)
                want[r[0], r[2]] = last
    want = {k: (v[5], v[7], None) if isinstance(v, list) else v for k, v in want.items()}
    assert got.keys() == want.keys() and sum(v[2] is not None for v in want.values()) > 10
    for k, (ele, stays, away) in want.items():
        assert got[k][:2] == (ele, stays) and (away is None) == (got[k][2] is None)


@pytest.mark.parametrize("n", [500_000])
def test_one_group_of_half_a_million_rows(spark, n):
    began = time.time()
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("k"), (F.col("id") % 97 + 1.0).alias("n"))
    kept = select.within_budget(df, ["g"], "k", "n", 1000.0, 0.0)
    assert kept.count() >= 10
    p = spark.range(n).select(F.lit(1).alias("track_id"), F.lit(0).alias("seg"), F.col("id").alias("pos"), (F.floor(F.col("id") / 2) * 1e-4).alias("lon"), F.lit(51.0).alias("lat"), F.lit(None).cast("timestamp").alias("ts"))
    assert tracks.without_repeats(p, 1.0).count() == n // 2
    assert tracks.spikes(p, 30.0, 8.0, 8.0).count() == 0
    m = spark.range(n).select(F.lit(1).alias("relation"), F.col("id").alias("pos"), F.col("id").alias("way"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), *[F.lit(0.0).alias(c) for c in ("xa", "ya", "xb", "yb")])
    assert graph.oriented(m, m.select(F.col("way").alias("before"), "way").limit(1), 1.0).where("direction = 'forward'").count() == n
    assert time.time() - began < 120


def ring_points(spark, lines):
    rows = [(t, k, float(x), float(y), bool(keep)) for t, line in lines.items() for k, (x, y, keep) in enumerate(line)]
    return spark.createDataFrame(rows, "track_id long, pos long, x double, y double, keep boolean")


def plain_generalized(line, tolerance):
    """Positions that are kept, span by span."""

    def away(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        size = (dx * dx + dy * dy) ** 0.5
        return abs(dy * (p[0] - a[0]) - dx * (p[1] - a[1])) / size if size else ((p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2) ** 0.5

    def inside(i, j):
        best = max(range(i + 1, j), key=lambda k: (away(line[k], line[i], line[j]), -k), default=None)
        if best is None or away(line[best], line[i], line[j]) <= tolerance:
            return set()
        return {best} | inside(i, best) | inside(best, j)

    n = len(line)
    ring = n > 3 and line[0][:2] == line[-1][:2]
    fixed = {0, n - 1} | {k for k, p in enumerate(line) if p[2]}
    if ring:
        fixed.add(max(range(1, n - 1), key=lambda k: (((line[k][0] - line[0][0]) ** 2 + (line[k][1] - line[0][1]) ** 2) ** 0.5, -k)))
    at = sorted(fixed)
    kept = fixed.union(*[inside(i, j) for i, j in zip(at, at[1:], strict=False)])
    return set(range(n)) if ring and len(kept) < 4 else kept


def test_generalisation(spark):
    rng = random.Random(7)
    lines = {0: [(0, 0, 0), (15, 0.1, 0), (10, 0, 0)], 1: [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 0)], 2: [(5, 5, 0)], 3: [(0, 0, 0), (1, 3, 1), (2, 0, 0)], 4: [(0, 0, 0), (9, 1, 0), (0, 0, 0)]}
    for t in range(5, 25):
        line = [(k + rng.random(), rng.uniform(-3, 3), rng.random() < 0.05) for k in range(rng.randrange(2, 40))]
        lines[t] = [*line, line[0]] if t % 2 else line
    for tolerance in (0.5, 5.0):
        got = {}
        for r in graph.generalized(ring_points(spark, lines), tolerance, protected="keep").collect():
            got.setdefault(r["track_id"], []).append(r["pos"])
        assert {t: sorted(v) for t, v in got.items()} == {t: sorted(plain_generalized(line, tolerance)) for t, line in lines.items()}
    assert plain_generalized(lines[0], 0.5) == {0, 2} and plain_generalized(lines[1], 5.0) == {0, 1, 2, 3, 4}
