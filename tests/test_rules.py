"""Rules and operators that SQL doesn't state, or not in all their cases, against plain Python."""

import json
import math
import random
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waystone.functions import extent, geo, text
from waystone.operators import audit, coverage, graph, joins, ranks, reconcile, select, tracks
from waystone.plans import catalog
from waystone.sources import readers

SMALL = "/root/testdata/sf0.001"


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_name_keys(spark):
    names = ["St Pancras", "Łódź Nth Jn", "Aylesbury Rail  Station", "Crewe Stn", "Bæch Sth Jcn (Goods)", "Rugby via Ely", "A & B Train Station", "ﬁeld ½ ㎞", None, "", "Station"]
    assert column(spark, names, text.name_key) == ["st pancras", "odz north junction", "aylesbury", "crewe", "bch south junction goods", "rugby via ely", "a and b", "field 12 km", None, "", ""]
    assert column(spark, names[4:6], text.relaxed_name_key) == ["bch south junction", "rugby"]
    assert column(spark, ["Bath Spa Railway Station", "St. Ives Station & Pier"], text.station_key) == ["bath spa", "st ives and pier"]


def test_folding_is_compatibility_decomposition(spark):
    rng = random.Random(4)
    values = ["".join(chr(rng.choice([*range(0x20, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB10), *range(0x2100, 0x2200), *range(0x1D400, 0x1D480)])) for _ in range(12)) for _ in range(200)]
    assert column(spark, values, text.ascii_fold) == [unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in values]


def test_ranks_and_holes(spark):
    assert column(spark, ["4=", "=4", "17", "4-6", "0", "x", "", None], text.rank_number) == [4, 4, 17, None, None, None, None, None]
    holes = ["7", " 18 ", "19", "0", "7B", "Old course hole 5 (par)", "5 - Old", "hole 3", None]
    assert column(spark, holes, text.hole_number) == [7, 18, None, None, None, None, None, None, None]
    assert column(spark, holes, lambda c: text.hole_number(c, suffix="b")) == [None, None, None, None, 7, None, None, None, None]
    assert column(spark, holes, lambda c: text.hole_number(c, course_token="Old")) == [None, None, None, None, None, None, 5, None, None]


def test_extents(spark):
    e = extent.box(F.lit(1.0), F.lit(50.0), F.lit(3.0), F.lit(50.0))
    flat = spark.range(1).select(extent.never_flat(e).alias("e")).first()["e"]
    assert (flat["west"], flat["east"]) == (1.0, 3.0) and math.isclose(flat["north"] - flat["south"], 1 / 111320, rel_tol=1e-6) and math.isclose(flat["north"] + flat["south"], 100.0)
    framed = spark.range(1).select(extent.with_margin(e, 0.1).alias("e")).first()["e"]
    assert framed == (0.8, 49.8, 3.2, 50.2)
    box = extent.box(F.lit(0.0), F.lit(10.0), F.lit(2.0), F.lit(11.0))
    for shape, holds in ((extent.expanded_to, lambda n: n[0] <= 0 and n[1] <= 10 and n[2] >= 2 and n[3] >= 11), (extent.cropped_to, lambda n: n[0] >= 0 and n[1] >= 10 and n[2] <= 2 and n[3] <= 11)):
        for aspect in (0.5, 3.0):
            row = spark.range(1).select(shape(box, aspect).alias("e")).select("e", (extent.width_m(F.col("e")) / extent.height_m(F.col("e"))).alias("r")).first()
            assert holds(row["e"]) and math.isclose(row["r"], aspect, rel_tol=1e-9)
    none = spark.createDataFrame([(1, None, None)], "k int, x double, y double").groupBy("k").agg(extent.bounds("x", "y").alias("e")).select(extent.never_flat(F.col("e")).alias("e")).first()
    assert none["e"] is None


def test_distance_of_a_missing_point_is_null(spark):
    df = spark.createDataFrame([(0.0, 50.0, None, 51.0)], "a double, b double, c double, d double")
    assert df.select(geo.haversine_m("a", "b", "c", "d").alias("m")).first()["m"] is None


def plain_turns(points):
    legs = [(p, q, math.dist(p, q)) for p, q in zip(points, points[1:] + points[:1], strict=True) if p != q]
    length = sum(m for *_, m in legs)
    if length < 300:
        return []
    n = max(16, math.ceil(length / 20))
    at, gone, k = [], 0.0, 0
    for i in range(n):
        d = i * length / n
        while k + 1 < len(legs) and d > gone + legs[k][2] - 1e-9:
            gone += legs[k][2]
            k += 1
        (x0, y0), (x1, y1), m = legs[k]
        f = (d - gone) / m
        at.append((x0 + f * (x1 - x0), y0 + f * (y1 - y0)))
    o = max(2, round(60 / (length / n)))
    bent = []
    for i, (x, y) in enumerate(at):
        (a, b), (c, e) = at[i - o], at[(i + o) % n]
        t = math.atan2(e - y, c - x) - math.atan2(y - b, x - a)
        t = math.degrees(abs(math.atan2(math.sin(t), math.cos(t))))
        if t >= 14:
            bent.append((-t, i * length / n))
    kept = []
    for t, d in sorted(bent):
        if len(kept) < 30 and all(min(abs(d - e), length - abs(d - e)) >= 95 for _, e in kept):
            kept.append((t, d))
    return sorted((round(d, 2), round(-t, 2)) for t, d in kept)


def test_turn_stations_round_a_lap(spark):
    rng = random.Random(3)
    laps = {i: [(400 * math.cos(k / 9) * (1 + rng.random() / 3), 300 * math.sin(k / 9) * (1 + rng.random() / 3)) for k in range(56)] for i in range(4)}
    laps[9] = [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0)]
    rows = [(lap, i, *p) for lap, points in laps.items() for i, p in enumerate(points)]
    got = defaultdict(list)
    for r in tracks.turn_stations(spark.createDataFrame(rows, "lap int, pos int, x double, y double")).collect():
        got[r["lap"]].append((round(r["d"], 2), round(r["turn"], 2)))
    for lap, points in laps.items():
        want = plain_turns(points)
        assert len(got[lap]) == len(want) and all(math.isclose(a, b, abs_tol=0.02) for p, q in zip(sorted(got[lap]), want, strict=True) for a, b in zip(p, q, strict=True))
    assert want == [] and len(got[0]) > 3


def test_spans_are_paired_like_greedy_choice(spark):
    rng = random.Random(8)
    unit = lambda: (lambda a: (math.cos(a), math.sin(a)))(rng.random() * 6.28)
    spans = [(i, rng.randrange(12), rng.randrange(2), 0, rng.randrange(9), rng.randrange(9), *unit(), *unit()) for i in range(60)]
    spans = [s for s in spans if s[4] != s[5]]
    ends = defaultdict(list)
    for s in spans:
        ends[s[4]].append((s[0], 0, s[1], s[2:4], s[6:8]))
        ends[s[5]].append((s[0], 1, s[1], s[2:4], s[8:10]))
    want = set()
    for meet in ends.values():
        pairs = sorted((p[2] != q[2], p[4][0] * q[4][0] + p[4][1] * q[4][1], p[:2], q[:2]) for p in meet for q in meet if p[0] < q[0] and p[3] == q[3])
        used = set()
        for *_, p, q in pairs:
            if p not in used and q not in used:
                used |= {p, q}
                want |= {(*p, *q), (*q, *p)}
    df = spark.createDataFrame(spans, "way long, line long, semantic int, grade int, a long, b long, ax double, ay double, bx double, by double")
    assert {tuple(r) for r in graph.compatible_links(df).collect()} == want and want


def test_laps_by_each_method(spark):
    square = [(1, 10, 11, ""), (2, 11, 12, ""), (3, 12, 13, ""), (4, 13, 10, "")]
    cases = {
        1: (square, ([1, 2, 3, 4], True, "order")),
        2: ([square[0], square[2], square[1], square[3]], ([1, 2, 3, 4], True, "cycle")),
        3: ([(1, 10, 11, ""), (2, 11, 12, "backward"), (3, 12, 10, "forward")], ([1, 2, 3], True, "order-role-relaxed")),
        4: ([(1, 10, 11, ""), (3, 12, 13, "forward"), (2, 11, 12, "backward"), (4, 13, 10, "")], ([1, 2, 3, 4], True, "cycle-role-relaxed")),
        5: ([*square, (9, 12, 99, "")], ([1, 2, 3, 4], True, "pruned-order")),
        6: ([(1, 10, 11, ""), (2, 20, 21, "")], ([1], False, "unresolved")),
        7: ([(1, 10, 11, ""), (2, 11, 12, "")], ([1, 2], False, "order")),
    }
    rows = [(r, i, *w) for r, (ways, _) in cases.items() for i, w in enumerate(ways)] + [(8, 0, 1, None, 5, "")]
    got = {r["relation"]: r for r in graph.laps(spark.createDataFrame(rows, "relation long, pos int, way long, a long, b long, role string")).collect()}
    assert set(got) == set(cases)
    for r, (_, (ways, closed, method)) in cases.items():
        assert (got[r]["ways"], got[r]["closed"], got[r]["method"]) == (ways, closed, method)
    assert got[5]["findings"] == ["pruned 9"] and got[3]["findings"] == ["roles conflict with ends"]


def test_lines_are_merged_at_equal_ends(spark):
    p = lambda *xs: [(float(x), 0.0) for x in xs]
    lines = [(1, p(0, 1, 2)), (2, p(4, 3, 2)), (3, p(2, 3, 4)), (4, p(4, 5)), (5, p(9, 9)), (6, p(20, 21)), (7, p(20, 22, 21)), (8, p(30, 31)), (9, p(31, 32)), (10, p(31, 33))]
    got = graph.merged_lines(spark.createDataFrame(lines, "line long, points array<struct<x:double,y:double>>")).collect()
    shapes = {tuple(q["x"] for q in r["points"]): r["lines"] for r in got}
    either = lambda *xs: next((s for s in (xs, xs[::-1]) if s in shapes), None)
    assert either(0.0, 1.0, 2.0, 3.0, 4.0, 5.0) and shapes[either(0.0, 1.0, 2.0, 3.0, 4.0, 5.0)] == 3
    ring = [s for s in shapes if 22.0 in s]
    assert len(ring) == 1 and ring[0][0] == ring[0][-1] and len(ring[0]) == 4 and len(shapes) == 5


def test_raw_geometry_names_each_fault(spark):
    g = lambda *ps: [None if p is None else (float(p[0]), float(p[1])) for p in ps]
    good = g((1, 2), (3, 4))
    rows = [
        ("node", 1, 1.0, 2.0, None, None, None), ("node", 2, 3.0, 4.0, None, None, None), ("node", 3, None, 4.0, None, None, None), ("node", 4, 95.0, 4.0, None, None, None), ("node", 2, 3.0, 4.0, None, None, None),
        ("way", 10, None, None, [1, 2], good, None), ("way", 11, None, None, [1], g((1, 2)), None), ("way", 12, None, None, [1, 2, 9], good, None), ("way", 13, None, None, [1, 2], g((1, 2), None), None),
        ("way", 14, None, None, [1, 2], g((1, 2), (91, 4)), None), ("way", 15, None, None, [1, 1], g((1, 2), (1, 2)), None), ("thing", 16, None, None, None, None, None), ("way", None, None, None, [1, 2], good, None),
        ("relation", 20, None, None, None, None, [("way", 10, "")]), ("relation", 21, None, None, None, None, []), ("relation", 22, None, None, None, None, [("way", 99, ""), ("area", 10, "")]),
        ("relation", 23, None, None, None, None, [("relation", 24, ""), ("way", 10, ""), ("way", 10, "")]), ("relation", 24, None, None, None, None, [("relation", 23, "")]), ("relation", 25, None, None, None, None, [("relation", 23, None)]),
    ]
    kind = "type string, id long, lat double, lon double, nodes array<long>, geometry array<struct<lat:double,lon:double>>, members array<struct<type:string,ref:bigint,role:string>>"
    df = spark.createDataFrame(rows, kind)
    digest = df.where("id = 10").select(audit.geometry_digest(F.col("geometry")).alias("d")).first()["d"]
    canonical = spark.createDataFrame([("way", 10, digest), ("way", 12, "x"), ("way", 77, "y")], "type string, id long, digest string")
    got = {(r["type"], r["id"], r["reason"]) for r in audit.raw_geometry(df, canonical).collect()}
    assert got == {
        ("node", 3, "no-coordinates"), ("node", 4, "coordinate-range"), ("node", 2, "repeated-id"), ("way", 11, "too-few-vertices"), ("way", 12, "node-count"), ("way", 12, "node-missing"),
        ("way", 13, "vertex-missing"), ("way", 14, "vertex-range"), ("way", 15, "zero-length"), ("thing", 16, "unknown-type"), ("way", None, "no-id"), ("relation", 21, "no-members"), ("relation", 22, "member-type"),
        ("relation", 22, "member-missing"), ("relation", 23, "member-repeated"), ("relation", 23, "member-cycle"), ("relation", 24, "member-cycle"), ("relation", 25, "member-role"), ("way", 12, "canonical-changed"), ("way", 77, "canonical-lost"),
    }
    assert {r["reason"] for r in catalog.QUERIES["o9_1_raw_geometry"](spark, SMALL).collect()} >= {"unknown-type", "no-id", "vertex-missing", "vertex-range", "too-few-vertices", "node-missing", "member-type", "member-role", "member-missing", "member-cycle"}


def test_ink_selection(spark):
    rng = random.Random(2)
    groups = [(rng.randrange(3), rng.choice("ab"), f"g{i}", rng.randrange(5), float(rng.randint(1, 40))) for i in range(60)]
    want = set()
    for plate in range(3):
        mine, used = [g for g in groups if g[0] == plate], 0.0
        kept = set()
        for layer in "ab":
            spent = 0.0
            for g in sorted((g for g in mine if g[1] == layer), key=lambda g: (-g[4], g[2])):
                if not spent or spent + g[4] <= 40:
                    spent += g[4]
                    kept.add(g[2])
                    want.add((plate, g[2], "reserve"))
            used += spent
        for g in sorted((g for g in mine if g[2] not in kept), key=lambda g: (-g[3], -g[4], g[2])):
            if used + g[4] <= 200:
                used += g[4]
                want.add((plate, g[2], "fill"))
    df = spark.createDataFrame(groups, "plate int, layer string, key string, rank int, ink double")
    assert {tuple(r) for r in select.ink_selection(df, "plate", "layer", "key", "rank", "ink", 200.0, 0.2).collect()} == want


def test_oriented_members(spark):
    m = [(1, 0, 1, 10, 11), (1, 1, 2, 12, 11), (1, 2, 3, 13, 14), (1, 3, 4, 90, 91), (2, 0, 5, 31, 30), (2, 1, 6, 31, 32)]
    at = {n: (float(n), 0.0) for n in (10, 11, 12, 13, 14, 90, 91, 30, 31, 32)}
    df = spark.createDataFrame([(*r, *at[r[3]], *at[r[4]]) for r in m], "relation long, pos long, way long, a long, b long, xa double, ya double, xb double, yb double")
    snaps = spark.createDataFrame([(2, 3)], "before long, way long")
    got = {(r["relation"], r["pos"]): (r["direction"], r["join"]) for r in graph.oriented(df, snaps, 3.0).collect()}
    assert got == {(1, 0): ("forward", "start"), (1, 1): ("reverse", "node"), (1, 2): ("forward", "snap"), (1, 3): ("forward", "break"), (2, 0): ("reverse", "start"), (2, 1): ("forward", "node")}


def gap(p, q):
    def to(x, y, a, b, c, d):
        m = (c - a) ** 2 + (d - b) ** 2
        f = max(0, min(1, ((x - a) * (c - a) + (y - b) * (d - b)) / m)) if m else 0
        return math.hypot(x - a - f * (c - a), y - b - f * (d - b))

    return min(to(*p[:2], *q), to(*p[2:], *q), to(*q[:2], *p), to(*q[2:], *p))


def test_conflicts_of_layers(spark):
    """Counts of separations() by pair of layers; tests of separations stand in test_lines."""
    rng, rows = random.Random(7), []
    for i in range(30):
        x, y = rng.random() * 30, rng.random() * 30
        rows.append((0, i, 0, "ab"[i % 2], 1.0 + i % 2, x, y, x + rng.random() * 4, y + rng.random() * 4))
    df = spark.createDataFrame(rows, "sheet int, line_id int, pos int, layer string, width double, x0 double, y0 double, x1 double, y1 double")
    want = defaultdict(list)
    for r in coverage.separations(df, 4.0, 2.0).collect():
        want[tuple(sorted((r["a_layer"], r["b_layer"])))].append(r["gap"])
    got = {(r["layer"], r["other"]): (r["conflicts"], r["least_gap"]) for r in coverage.close_conflicts(df, 4.0, 2.0).collect()}
    assert got == {k: (len(v), min(v)) for k, v in want.items()} and want
    least = min(gap(a[5:], b[5:]) for a in rows for b in rows if a[1] < b[1] and gap(a[5:], b[5:]) > 0.01)
    assert min(m for _, m in got.values()) <= least + 2.0


def test_landmarks_near_and_far_are_all_placed(spark):
    rng = random.Random(5)
    points = [(0.0 + i * 0.02, 51.0 + rng.random() / 50) for i in range(30)]
    legs, d = [], 0.0
    for i, ((a, b), (c, e)) in enumerate(zip(points, points[1:], strict=False)):
        m = math.dist((a, b), (c, e)) * 1e5
        legs.append((1, i, a, b, None, d, c, e, None, d + m))
        d += m
    kind = "track_id long, pos long, lon0 double, lat0 double, ele0 double, d0 double, lon1 double, lat1 double, ele1 double, d1 double"
    marks = [(1, i, rng.random() * 0.6, 51 + rng.random() / 50) for i in range(20)] + [(1, 50, 3.0, 53.0), (1, 51, 0.3, 51.3)]
    l, m = spark.createDataFrame(legs, kind), spark.createDataFrame(marks, "track_id long, landmark_id long, lon double, lat double")
    p = geo.segment_projection("lon", "lat", "lon0", "lat0", "lon1", "lat1")
    plain = m.crossJoin(l.drop("track_id")).select("landmark_id", p["distance_m"].alias("o")).groupBy("landmark_id").agg(F.min("o").alias("o"))
    want = {r["landmark_id"]: round(r["o"], 3) for r in plain.collect()}
    assert {r["landmark_id"]: round(r["offset_m"], 3) for r in joins.linear_reference(m, l, reach_m=300.0, rounds=3).collect()} == want
    ask = spark.createDataFrame([(1, 0.0), (1, legs[3][5]), (1, legs[-1][-1]), (1, 1e9), (1, -1.0)], "track_id long, d double")
    assert sorted(r["status"] for r in tracks.stations(l, ask).collect()) == ["unavailable"] * 3


def test_readers_open_any_nesting_and_say_what_they_leave_out(spark):
    line = {"type": "LineString", "coordinates": [[1.5, 2.0], [3.0, 4.0]]}
    nest = line
    for _ in range(9):
        nest = {"type": "GeometryCollection", "geometries": [nest, {"type": "Point", "coordinates": [0, 0]}]}
    docs = [(1, json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": nest}]})), (2, json.dumps({"type": "MultiLineString", "coordinates": [line["coordinates"]] * 2})), (3, "broken"), (4, None)]
    found = readers.geojson_lines(spark.createDataFrame(docs, "source long, value string")).collect()
    assert sorted((r["source"], r["line"], r["coordinates"]) for r in found) == [(1, 0, line["coordinates"]), (2, 0, line["coordinates"]), (2, 1, line["coordinates"])]
    kml = '<k:kml><k:LineString id="a"><k:coordinates>1,2,3 4,5</k:coordinates></k:LineString><LineString><coordinates >6,7</coordinates></LineString><LineString><coordinates >6,7 8,9</coordinates></LineString></k:kml>'  # one position is no line
    points = readers.kml_points(spark.createDataFrame([(1, kml)], "source long, value string")).collect()
    assert sorted((r["line"], r["pos"], r["lon"], r["lat"], r["ele"]) for r in points) == [(0, 0, 1.0, 2.0, 3.0), (0, 1, 4.0, 5.0, None), (2, 0, 6.0, 7.0, None), (2, 1, 8.0, 9.0, None)]
    rows = spark.createDataFrame([("5,r1,3,1.5",), ("x,r1,3,1.5",), ("6,r1,0,",), ("7,r1,2,",)], "value string")
    good, bad = readers.ranking_rows(rows)
    assert sorted(map(tuple, good.collect())) == [(5, "r1", 3, 1.5), (7, "r1", 2, None)] and bad.count() == 2


def test_counts_run_over_blocks_and_digests_over_buckets(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randrange(2)) for g in "ab" for i in range(400)]
    got = {(r["g"], r["i"]): r["s"] for r in ranks.running_count(spark.createDataFrame(rows, "g string, i int, n int"), "g", "i", "n", "s", block=32).collect()}
    total = defaultdict(int)
    for g, i, n in rows:
        total[g] += n
        assert got[g, i] == total[g]
    df = spark.createDataFrame([(g, i % 97) for g, i, _ in rows], "g string, v int")
    digest = lambda d: {r["g"]: r["digest"] for r in reconcile.digest_of_set(d, ["g"], F.sha2(F.col("v").cast("string"), 256)).collect()}
    assert digest(df) == digest(df.orderBy(F.rand(3))) and digest(df)["a"] == digest(df)["b"] != digest(df.where("v <> 3 or g = 'b'"))["a"]


@pytest.mark.parametrize("name", ["o4_4_inner_ring_container", "o4_17_close_pairs", "o4_20_uncovered_runs", "o4_26_features_in_boundary", "o6_8_member_discontinuity", "o9_4_generalisation_check", "o10_3_cleaned_track_stream"])
def test_queries_find_something(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
