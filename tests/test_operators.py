"""Operators that SQL doesn't state, against plain Python on small inputs, and the traps of rules."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from waystone.functions import geo, rail, tags, text
from waystone.operators import audit, graph, joins, paths, select, terrain, tracks
from waystone.sources import readers
from waystone.streaming import streams


def hav(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


def test_repeated_points_compare_with_the_last_kept(spark):
    rng = random.Random(2)
    rows = [(1, 0, i, rng.random() / 200, 50 + rng.random() / 200) for i in range(60)]
    df = spark.createDataFrame(rows, "track_id long, seg long, pos long, lon double, lat double")
    kept = []
    for r in rows:
        if not kept or hav(kept[-1][3:], r[3:]) > 200:
            kept.append(r)
    assert sorted(r["pos"] for r in tracks.without_repeats(df, 200.0).collect()) == [r[2] for r in kept]


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("a", 1, 90.0), ("a", 2, 60.0), ("a", 3, 10.0), ("a", 4, 1.0), ("b", 5, 500.0)], "g string, k long, n double")
    assert sorted(r["k"] for r in select.within_budget(df, ["g"], "k", "n", 100.0, 5.0).collect()) == [1, 3, 5]


def test_chains_cycles_and_cores(spark):
    ways = [(1, 10, 11), (2, 12, 11), (3, 12, 13), (5, 20, 21), (6, 21, 22), (7, 22, 20), (12, 40, 41), (13, 41, 42), (14, 41, 43), (20, 50, 51), (21, 51, 50), (30, 60, 60), (35, 70, 71), (31, 71, 72), (33, 73, 72), (32, 73, 74)]
    found = sorted((r["run"], r["pos"], r["way"]) for r in graph.chains(spark.createDataFrame(ways, "way long, a long, b long")).collect())
    assert found == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (5, 0, 5), (5, 1, 6), (5, 2, 7), (12, 0, 12), (13, 0, 13), (14, 0, 14), (20, 0, 20), (20, 1, 21), (30, 0, 30), (31, 0, 32), (31, 1, 33), (31, 2, 31), (31, 3, 35)]
    core = graph.two_core(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7)])], "edge_id long, a long, b long"))
    assert sorted(r["edge_id"] for r in core.collect()) == [0, 1, 2]
    good, bad = graph.directed_cycles(spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 9, 1), (5, 7, 8)], "way long, head long, tail long"))
    assert [r["way"] for r in good.collect()] == [] or {r["cycle"] for r in good.collect()} == {1}
    assert {r["way"]: r["problem"] for r in bad.collect()}[5] == "no-successor"


def test_shortest_paths_and_ties(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(25), rng.randrange(25), float(rng.randint(1, 4))) for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    d = {(i, j): 0.0 if i == j else math.inf for i in range(25) for j in range(25)}
    for a, b, m in edges:
        d[a, b] = d[b, a] = min(d[a, b], m)
    for k in range(25):
        for i in range(25):
            for j in range(25):
                d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    pairs = [(i, i, (i * 7 + 3) % 25) for i in range(12)]
    rows = [(k, *e) for k, e in enumerate(edges)]
    frames = lambda e, p: (spark.createDataFrame(e, "edge long, a long, b long, m double"), spark.createDataFrame(p, "query long, source long, target long"))
    for r in paths.shortest_routes(*frames(rows, pairs))[0].collect():
        want = d[pairs[r["query"]][1:]]
        assert (r["m"] is None and math.isinf(want)) or r["m"] == want
    square = [(1, 1, 2, 1.0), (2, 2, 4, 1.0), (3, 1, 3, 1.0), (4, 3, 4, 1.0)]
    found = paths.shortest_routes(*frames(square, [(0, 1, 4), (1, 1, 9)]))[0].orderBy("query").collect()
    assert found == [(0, 2.0, 2, True), (1, None, 0, True)]


def test_generalised_line_keeps_what_recursion_keeps(spark):
    rng = random.Random(9)
    p = [(float(i), rng.random() * 3) for i in range(50)]

    def far(q, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((q[0] - a[0]) * dx + (q[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(q[0] - a[0] - t * dx, q[1] - a[1] - t * dy)

    def rdp(i, j):
        inner = [(far(p[k], p[i], p[j]), -k) for k in range(i + 1, j)]
        if not inner or max(inner)[0] <= 0.8:
            return {i, j}
        k = -max(inner)[1]
        return rdp(i, k) | rdp(k, j)

    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(p)], "track_id long, pos long, x double, y double")
    assert {r["pos"] for r in graph.generalized(df, 0.8).collect()} == rdp(0, 49)


def test_contour_segments_lie_on_the_level(spark):
    z = [[math.sin(r) + math.cos(c / 2) for c in range(6)] for r in range(6)]
    cells = spark.createDataFrame([(1, r, c, z[r][c] * 100) for r in range(6) for c in range(6)], "tile long, row int, col int, z double")
    found = terrain.contour_segments(cells, spark.createDataFrame([(1, [0, 50])], "tile long, levels array<long>")).collect()
    assert found
    for s in found:
        for x, y in ((s["x0"], s["y0"]), (s["x1"], s["y1"])):
            c, r = int(min(x, 4.999)), int(min(y, 4.999))
            fx, fy = x - c, y - r
            v = (z[r][c] * (1 - fx) + z[r][c + 1] * fx) * (1 - fy) + (z[r + 1][c] * (1 - fx) + z[r + 1][c + 1] * fx) * fy
            assert abs(v * 100 - s["level"]) < 1e-6


def test_days_levels_and_lifecycle(spark):
    row = spark.range(1).select(
        rail.token_days(F.lit("EWD")).alias("a"), rail.token_days(F.lit("THX")).alias("b"), rail.token_days(F.lit("SUO")).alias("c"), rail.token_days(F.lit("SUX")).alias("d"), rail.token_days(F.lit("MMO")).alias("e"),
        text.level_key(F.lit("-01.50")).alias("f"), text.level_key(F.lit(None).cast("string")).alias("g"), text.level_key(F.lit("0;1")).alias("h"), text.name_key(F.lit("São  Bênto & Rail Station")).alias("i"),
        tags.active_railway(F.create_map(F.lit("railway"), F.lit("miniature"), F.lit("abandoned:railway"), F.lit("rail"))).alias("j"), tags.active_railway(F.create_map(F.lit("railway"), F.lit("rail"), F.lit("railway:abandoned"), F.lit("yes"))).alias("k"),
        text.yymmdd(F.lit("991332")).alias("l"),
    ).first()
    assert list(row) == [[0, 1, 2, 3, 4, 5], [0, 1, 2, 4, 5], [6], None, None, "-1.5", "0", "0;1", "sao bento and", True, False, None]


def test_readers_reject_and_keep(spark):
    docs = spark.createDataFrame([(1, '{"elements":[{"type":"way","id":5,"geometry":[{"lat":1.0,"lon":2.0}]}]}'), (2, "{}"), (3, "broken")], "source long, value string")
    found = readers.elements(docs).collect()
    assert sorted((r["source"], r["id"], r["problem"]) for r in found if r["problem"] is None) == [(1, 5, None)]
    assert sorted(r["source"] for r in found if r["problem"]) == [2, 3]
    sums = spark.createDataFrame([("a" * 64 + "  x/y",), ("b" * 64 + "  x/y",), ("c" * 64 + "  ../z",), ("bad",), ("d" * 64 + "  ok",)], "value string")
    good, bad = readers.checksum_list(sums)
    assert [r["path"] for r in good.collect()] == ["ok"] and sorted(r["problem"] for r in bad.collect()) == ["malformed", "repeated", "repeated", "traversal"]
    gpx = spark.createDataFrame([(1, '<gpx><trk><trkseg><trkpt lat="1" lon="2"><ele>3</ele></trkpt></trkseg><trkseg><trkpt lat="4" lon="5"/></trkseg></trk></gpx>')], "source long, value string")
    assert [(r["seg"], r["lat"], r["ele"]) for r in readers.gpx_points(gpx).orderBy("seg").collect()] == [(0, 1.0, 3.0), (1, 4.0, None)]


def test_change_log_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(8), i, rng.choice("NRD"), float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, seq long, op string, payload double")
    df.write.parquet(str(tmp_path / "in"))
    standing, problems = streams.change_log(df)
    out = streams.run_once(streams.change_log_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "run"))
    assert sorted(map(tuple, out.where("problem is not null").select("k", "seq", "problem").collect())) == sorted(map(tuple, problems.collect()))
    last = {}
    for k, seq, op, payload in rows:
        last[k] = (seq, op, payload)
    assert sorted((r["k"], r["seq"]) for r in standing.collect()) == sorted((k, s) for k, (s, op, _) in last.items() if op != "D")


def test_cleaned_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1, t0 + datetime.timedelta(seconds=10 * i), 0.00001 * i, 50.0) for i in range(40)]
    df = spark.createDataFrame(rows, "track_id long, ts timestamp, lon double, lat double")
    df.write.parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.cleaned_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 5.0, 3600.0), str(tmp_path / "run")).orderBy("ts").collect()
    kept = []
    for r in rows:
        if not kept or hav(kept[-1][2:], r[2:]) > 5:
            kept.append(r)
    assert [round(r["lon"], 7) for r in out] == [round(r[2], 7) for r in kept]


def test_windows_and_sessions_as_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0 + datetime.timedelta(minutes=m), 1.0) for m in (0, 5, 50, 120, 125)], "k long, ts timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    out = streams.run_once(streams.session_counts(stream, "k", "30 minutes"), str(tmp_path / "s"))
    batch = streams.session_counts(df, "k", "30 minutes")
    assert set(map(tuple, out.collect())) <= set(map(tuple, batch.collect())) and batch.count() == 3


def test_strict_report(spark):
    df = spark.createDataFrame([(1, 2.0)], "k long, v double")
    assert audit.strict(audit.findings(df, ["k"], {"low": F.col("v") < 0})).count() == 0
    with pytest.raises(ValueError):
        audit.strict(audit.findings(df, ["k"], {"high": F.col("v") > 0}))


def test_radius_join_is_whole(spark):
    rng = random.Random(1)
    p = [(i, rng.random() / 5, 51 + rng.random() / 5) for i in range(60)]
    n = [(i, rng.random() / 5, 51 + rng.random() / 5) for i in range(300)]
    found = joins.radius_join(spark.createDataFrame(p, "point_id long, lon double, lat double"), spark.createDataFrame(n, "node_id long, lon double, lat double"), 900.0)
    assert {(r["point_id"], r["node_id"]) for r in found.collect()} == {(a[0], b[0]) for a in p for b in n if hav(a[1:], b[1:]) <= 900}
