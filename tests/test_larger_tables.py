"""Small cases of what larger tables brought up: keys beyond a million, gaps of part seconds, repeated edges, sums of rounding."""

import hashlib
import math
import random
import unicodedata

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waystone.functions import text
from waystone.functions.geo import EARTH_M, metres
from waystone.operators import audit, coverage, graph, joins, ranks, reconcile, select, terrain, tracks
from waystone.plans import catalog
from waystone.sources import readers
from waystone.streaming import streams


def test_a_gap_counts_parts_of_a_second(spark):
    rows = spark.sql("select 1 as track_id, 0 as pos, timestamp '2024-01-01 00:00:00.1' as ts union all select 1, 1, timestamp '2024-01-02 00:00:00.6' union all select 1, 2, timestamp '2024-01-03 00:00:00.6'")
    assert [r["seg"] for r in tracks.segmented(rows, 86400).orderBy("pos").collect()] == [0, 1, 1]


def test_neighbours_round_a_lap_take_no_join(spark):
    rows = [(1, i, 300 * math.cos(i / 5), 200 * math.sin(i / 5)) for i in range(31)]
    found = tracks.turn_stations(spark.createDataFrame(rows, "lap int, pos int, x double, y double"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0


def test_a_ring_s_repeated_edge_is_crossed_twice(spark):
    corners = [(0, 0), (4, 0), (4, 4), (0, 0), (4, 0), (4, 4), (0, 4)]
    ring = [(1, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True))]
    rings = spark.createDataFrame(ring, "ring_id int, pos int, x0 double, y0 double, x1 double, y1 double")
    legs = spark.createDataFrame([(7, 0, 1, 3.0, 1.0, 5.0, 1.5)], "line_id int, pos int, ring_id int, x0 double, y0 double, x1 double, y1 double")
    assert coverage.features_in_boundary(legs, rings).collect()[0]["crossings"] == 2


def lineitem(folder, pairs):
    names = {"l_orderkey": [k // 2 for k in range(len(pairs))], "l_linenumber": [k % 2 for k in range(len(pairs))], "l_partkey": [a for a, _ in pairs], "l_suppkey": [b for _, b in pairs]}
    n = len(pairs)
    pq.write_table(pa.table(names | {"l_quantity": [1.0] * n, "l_extendedprice": [1.0] * n, "l_returnflag": ["A"] * n}), folder / "lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    return c


def test_pairs_of_keys_beyond_a_million_stay_apart(spark, tmp_path):
    c = lineitem(tmp_path, [(1, 2_000_005), (2, 1_000_005)])
    name = "o4_19_coincident_segments"
    assert c.execute(catalog.SQL[name]).fetchall() == [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()] == [("A", 2, 0)]


def test_edges_of_nodes_beyond_a_million_stay_apart(spark, tmp_path):
    c = lineitem(tmp_path, [(0, 0)] * 2 + [(1, 0), (2_000_005, 0)] + [(0, 0)] * 22 + [(2, 0), (1_000_005, 0)])
    name = "o5_5_operator_summary"
    assert c.execute(catalog.SQL[name]).fetchall() == [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()] == [(1, 2, 2, 2)]


def test_stations_beyond_a_million_keep_their_codes(spark, tmp_path):
    keys = [1_000_001, 1_000_003, 10_000_015, 7]
    pq.write_table(pa.table({"p_partkey": keys, "p_name": ["a"] * 4, "p_size": pa.array([1] * 4, pa.int32())}), tmp_path / "part.parquet")
    assert {r["tiploc"] for r in catalog.QUERIES["o1_14_station_scan"](spark, str(tmp_path)).collect()} == {f"T{k}" for k in keys}


def test_an_offset_is_not_rounded_before_its_use(spark):
    off = 5.0049997
    leg = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.01, 0.0, 0.0, 1000.0)], "track_id int, pos int, lon0 double, lat0 double, lon1 double, lat1 double, d0 double, d1 double")
    mark = spark.createDataFrame([(1, 9, 0.005, math.degrees(off / EARTH_M))], "track_id int, landmark_id int, lon double, lat double")
    assert math.isclose(joins.linear_reference(mark, leg).collect()[0]["offset_m"], off, abs_tol=1e-8)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_an_alias_of_many_identities_is_one_row(spark):
    aliases = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "c"), (None, "d")], "identity int, alias string")
    records = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a"), (12, "c"), (13, "d"), (14, "z"), (15, None)], "record int, alias string")
    found = reconcile.alias_identity(records, aliases)
    assert sorted(map(tuple, found.collect())) == [(10, 1, False), (11, None, True), (12, None, True), (13, None, False)]
    assert "count(distinct" not in plan(found)


def test_a_name_meets_the_first_codes_of_a_key_only(spark):
    rng = random.Random(4)
    names = [(i, rng.choice("ab"), rng.choice("xy")) for i in range(6)]
    records = [(rng.choice("st"), c, rng.choice("ab"), rng.choice("xy")) for c in range(40)]
    want = set()
    for i, exact, relaxed in names:
        for source in "st":
            keys = sorted((0 if r[2] == exact else 1, r[1]) for r in records if r[0] == source and (r[2] == exact or r[3] == relaxed))
            want |= {(i, source, code, strength) for strength, code in keys[:3]}
    found = joins.candidates_by_keys(spark.createDataFrame(names, "id int, exact string, relaxed string"), spark.createDataFrame(records, "source string, code int, exact string, relaxed string"), 3)
    assert {(r["id"], r["source"], r["code"], r["strength"]) for r in found.collect()} == want
    assert "_n#" in plan(found)  # codes of a key are numbered before names meet them


def test_the_nearest_of_a_name_is_found_at_any_reach(spark):
    rng = random.Random(5)
    place = lambda: (rng.randrange(-40, 40) * 25.0, rng.randrange(-40, 40) * 25.0)
    left = [(i, rng.choice("ab"), *place()) for i in range(40)] + [(98, None, 0.0, 0.0), (99, "z", 0.0, 0.0)]
    right = [(c, rng.choice("ab"), *place()) for c in range(30)] + [(90, "a", *left[0][2:]), (80, "a", *left[0][2:])]
    schema = "string, x double, y double"
    found = joins.nearest_by_key(spark.createDataFrame(left, f"id int, key {schema}"), spark.createDataFrame(right, f"code int, key {schema}"), "key", 300.0)
    want = {}
    for i, key, x, y in left:
        d = min(((math.hypot(x - u, y - v), c) for c, k, u, v in right if k == key), default=(math.inf, None))
        want[i] = d[::-1] if d[0] <= 300 else (None, None)
    assert {r["id"]: (r["code"], r["distance"]) for r in found.collect()} == want
    assert "hypot" not in plan(found)  # distances are those of near places, found in rounds


def test_points_meet_segments_by_exchange_and_once(spark):
    points = spark.createDataFrame([(i, i * 0.002, 0.001) for i in range(20)], "point_id int, lon double, lat double")
    segments = spark.createDataFrame([(j, j * 0.004, 0.0, j * 0.004 + 0.01, 0.0) for j in range(5)], "segment_id int, lon_a double, lat_a double, lon_b double, lat_b double")
    found = joins.segment_radius_join(points, segments, 500.0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    near = lambda i, j: math.hypot(max(j * 0.004 - i * 0.002, 0, i * 0.002 - j * 0.004 - 0.01), 0.001) * math.radians(1) * EARTH_M
    assert sorted((r["point_id"], r["segment_id"]) for r in found.collect()) == [(i, j) for i in range(20) for j in range(5) if near(i, j) <= 500]


def test_copies_of_a_place_share_its_distances_to_segments(spark, monkeypatch):
    """700 points at one place and 600 segments at another have one distance to measure, far or near; nothing of the pairs is lost."""
    near, far = [(i, 0.0, 0.001) for i in range(700)] + [(None, 0.0, 0.001)], [(1000 + i, 0.0, 0.006) for i in range(700)]
    others = [(2000 + i, 0.0005 * i, 0.003) for i in range(5)]
    legs = [(j, 0.0, 0.0, 0.01, 0.0) for j in range(600)] + [(900, -0.001, 0.0, -0.001, 0.0), (901, None, 0.0, 0.0, 0.0), (902, -0.001, 0.004, 0.0, 0.004)]
    points = spark.createDataFrame(near + far + others, "point_id int, lon double, lat double")
    segments = spark.createDataFrame(legs, "segment_id int, lon_a double, lat_a double, lon_b double, lat_b double")
    count, project = spark.sparkContext.accumulator(0), joins.segment_projection
    counted = F.udf(lambda m: count.add(1) or m, "double")
    monkeypatch.setattr(joins, "segment_projection", lambda *c: project(*c).withField("distance_m", counted(project(*c)["distance_m"])))
    found = joins.segment_radius_join(points, segments, 500.0, values={"m": F.round("p.distance_m", 3)})
    got = [tuple(r) for r in found.collect()]
    assert count.value < 1000

    def apart(p, s):
        (_, x, y), (_, a, b, c, d) = p, s
        scale = math.cos(math.radians(y))
        return math.hypot(max(min(a, c) - x, x - max(a, c), 0) * scale, y - b) * math.radians(1) * EARTH_M  # all segments lie level

    want = {(p[0], s[0]): apart(p, s) for p in near + far + others for s in legs if s[1] is not None and apart(p, s) <= 500}
    assert len(got) == len(want) and all(abs(m - want[i, j]) < 0.01 for i, j, m in got) and (None, 5) in want and (1000, 902) in want
    ranked = joins.segment_radius_join(points, segments, 500.0, 3).collect()
    first = {p[0]: sorted((round(m, 3), j) for (i, j), m in want.items() if i == p[0])[:3] for p in [near[0], near[-1], far[0], *others]}
    assert {(r["point_id"], r["rank"]): r["segment_id"] for r in ranked if r["point_id"] in first} == {(i, n + 1): j for i, v in first.items() for n, (_, j) in enumerate(v)}


def united(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    return {x: top(x) for x in root}


def test_components_write_little_more_than_their_edges(spark, monkeypatch):
    rng = random.Random(6)
    path = [(i, i + 1) for i in range(600)]
    star = [(9000, i) for i in range(1000, 1200)]
    pairs = path + star + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(250)] + [(1, 1), (7000, 7000), (3, 2), (3, 2)]
    written, keep = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (lambda out: written.append(out.count()) or out)(keep(df)))
    edges = spark.createDataFrame([*pairs, (None, 1), (7001, None)], "a int, b int")
    assert {r["id"]: r["component"] for r in graph.components(edges).collect()} == united(pairs)
    assert sum(written) < 12 * len(pairs)


def test_items_of_a_reference_are_known_by_their_least(spark):
    rng = random.Random(7)
    items = [(i, f"r{rng.randrange(60)}") for i in range(80) for _ in range(rng.randrange(1, 3))]
    first = {}
    for i, ref in items:
        first[ref] = min(i, first.get(ref, i))
    found = graph.grouped_by_reference(spark.createDataFrame([*items, (5000, None)], "item long, ref string"))
    assert {r["item"]: r["component"] for r in found.collect()} == united((i, first[ref]) for i, ref in items)
    assert "kind" not in plan(found)


def test_chains_write_what_goes_on_only(spark, monkeypatch):
    rng = random.Random(8)
    ids = rng.sample(range(10_000), 900)
    path, ring, alone = ids[:100], ids[100:137], ids[137:]
    ways = [(w, i, i + 1) for i, w in enumerate(path)] + [(w, 1000 + i, 1000 + (i + 1) % 37) for i, w in enumerate(ring)] + [(w, 5000 + 2 * w, 5001 + 2 * w) for w in alone]
    ways = [(w, a, b) if rng.random() < 0.5 else (w, b, a) for w, a, b in ways]
    written, keep = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (lambda out: written.append(out.count()) or out)(keep(df)))
    found = {r["way"]: (r["run"], r["pos"]) for r in graph.chains(spark.createDataFrame(ways, "way int, a int, b int")).collect()}
    line = path if path[0] < path[-1] else path[::-1]
    want = {w: (w, 0) for w in alone} | {w: (min(path), i) for i, w in enumerate(line)}
    assert {w: found[w] for w in want} == want and len(found) == len(ways)
    at = ring.index(min(ring))
    turn = ring[at:] + ring[:at]
    assert [found[w] for w in turn] in ([(turn[0], i) for i in range(37)], [(turn[0], -i % 37) for i in range(37)])
    assert max(written) <= 2 * 137


def test_pairs_of_legs_are_no_rows(spark):
    rng, rows = random.Random(9), []
    for line in range(6):
        p = [(rng.uniform(0, 9) + 2 * line, rng.uniform(0, 9)) for _ in range(4 if line % 2 else 25)]
        rows += [(0, line, k, "ab"[line % 2], 0.1, *a, *b) for k, (a, b) in enumerate(zip(p, p[1:], strict=False))]
    df = spark.createDataFrame(rows, "sheet int, line_id int, pos int, layer string, width double, x0 double, y0 double, x1 double, y1 double")
    found = coverage.separations(df, 0.5, 0.2)
    assert "join" not in plan(found)
    got = {(r["a"], r["b"]): r["gap"] for r in found.collect()}
    whole = {(r["a"], r["b"]): r["gap"] for r in coverage.separations(df, 100.0, 0.2).collect()}  # one cell
    assert got.keys() == whole.keys() and len(got) > 5 and all(math.isclose(got[k], whole[k], abs_tol=1e-9) for k in got)


def test_contours_inside_a_block_are_no_links(spark, monkeypatch):
    rng = random.Random(10)
    cells = [(t, r, c, rng.randrange(4) + 0.5) for t in range(2) for r in range(15) for c in range(11 * t, 11 * t + 12)]
    cells = [(t, r, c, 2.5 if c == 11 else z) for t, r, c, z in cells]  # tiles share a column
    df = spark.createDataFrame(cells, "tile long, row long, col long, z double")
    segments = terrain.contour_segments(df, spark.createDataFrame([(t, [1, 2, 3]) for t in range(2)], "tile long, levels array<long>")).localCheckpoint()
    rows = lambda df: sorted(map(tuple, df.collect()))
    for across in (False, True):
        assert rows(terrain.contour_paths(segments, across, 3)) == rows(terrain.contour_paths(segments, across))
    monkeypatch.setattr(terrain, "chains", lambda *_: 1 / 0)
    assert terrain.contour_paths(segments).count() > segments.count()


def test_places_are_measured_once(spark):
    rng = random.Random(11)
    spots = [(rng.random() * 0.03, 51 + rng.random() * 0.02) for _ in range(36)]
    place = lambda: rng.choice(spots)
    points, nodes = [(i, *place()) for i in range(60)] + [(99, None, 51.0)], [(i, *place()) for i in range(80)] + [(98, 0.0, None)]
    of = lambda rows, name: spark.createDataFrame(rows, f"{name} int, lon double, lat double")
    m = {(p, n): metres(x, y, u, v) for p, x, y in points[:-1] for n, u, v in nodes[:-1]}
    every = joins.radius_join(of(points, "point_id"), of(nodes, "node_id"), 700.0)
    assert sorted((r["point_id"], r["node_id"]) for r in every.collect()) == sorted(k for k, d in m.items() if d <= 700)
    near = joins.radius_join(of(points, "point_id"), of(nodes, "node_id"), 700.0, 3)
    want = [(p, n, i + 1) for p, *_ in points for i, (_, n) in enumerate(sorted((d, n) for (q, n), d in m.items() if q == p and d <= 700)[:3])]
    assert sorted((r["point_id"], r["node_id"], r["rank"]) for r in near.collect()) == sorted(want)
    assert all("aggregate [plon" in plan(df) for df in (every, near))  # places of points are told apart before they meet nodes


def test_points_of_a_span_are_not_spread(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 3.0, 3.0), (1, 1.0, -1.0), (1, None, 9.0), (2, None, None)], "track int, x double, y double")
    found = coverage.oriented_span(points, "track")
    assert "explode" not in plan(found)
    one, none = found.orderBy("track").collect()
    assert math.isclose(one["area"], 6.0) and math.isclose(one["short_side"], math.sqrt(2)) and one["bearing"] == 45
    assert tuple(none) == (2, None, None, 90)


def test_names_are_spread_and_folded_by_character(spark):
    every = [chr(c) for c in range(0x20, 0x2FFF, 7)] + ["\U0001d400", "ﬁ", "½", "Ł", "\U0001f600", "", "plain"]
    names = [a + "x" + b + "\n" + b + a for a, b in zip(every, every[5:] + every[:5], strict=True)]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.ascii_fold(F.col("n")).alias("f")).collect()
    assert all(r["f"] == unicodedata.normalize("NFKD", r["n"]).encode("ascii", "ignore").decode() for r in found)
    assert catalog.QUERIES["o3_12_name_keys"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_relations_stream_by(spark):
    members = [(r, p, 10 * r + p, p, (p + 1) % 3, None) for r in range(40) for p in (2, 0, 1)] + [(99, 0, 7, None, 1, "")]
    found = graph.laps(spark.createDataFrame(members, "relation int, pos int, way int, a int, b int, role string"))
    assert "flatmapgroups" not in plan(found)  # no group of Arrow a relation
    assert sorted(map(tuple, found.collect())) == [(r, [10 * r, 10 * r + 1, 10 * r + 2], True, "order", []) for r in range(40)]


def test_places_take_no_second_exchange_and_budgets_one_sort(spark):
    rows = random.Random(12).sample(range(5000), 700)
    placed = ranks.global_position(spark.createDataFrame([(v,) for v in rows], "v int").repartition(3), ["v"], "place")
    assert {r["v"]: r["place"] for r in placed.collect()} == {v: i + 1 for i, v in enumerate(sorted(rows))}
    cut = select.cut_to_budget(placed.withColumn("g", F.col("v") % 3), ["g"], ["v"], "v", 90_000.0, F.col("v") % 7 == 0)
    shown = lambda df: df._jdf.queryExecution().sparkPlan().toString().lower()
    assert "window [row_number" not in shown(placed) and shown(cut).count("window [") == 1 + shown(placed).count("window [")
    kept = {r["v"]: r["kept"] for r in cut.collect()}
    for g in range(3):
        own, gone = sorted(v for v in rows if v % 3 == g), 0
        for v in own:
            assert kept[v] == (v % 7 == 0 or sum(own) - gone <= 90_000)
            gone += 0 if v % 7 == 0 else v


def test_a_change_log_s_state_is_a_row_a_bucket(spark, tmp_path):
    """Three micro-batches over many keys, one of them null (F37: a Python call a key)."""
    rng = random.Random(37)
    rows = [(rng.choice([None, *range(-150, 150)]), i, rng.choice("NRD"), float(i)) for i in range(1500)]
    for part in range(3):
        spark.createDataFrame(rows[part * 500 : part * 500 + 500], "k long, seq long, op string, payload double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, seq long, op string, payload double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streams.change_log_stream(stream, buckets=16).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    there, want = set(), []
    for k, seq, op, payload in rows:
        had = k in there
        want.append((k, seq, op, payload, "insert-of-existing" if op == "N" and had else "replace-of-missing" if op == "R" and not had else "delete-of-missing" if op == "D" and not had else None))
        there = there - {k} if op == "D" else there | {k}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: r[1]) == want
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 16


def test_raw_elements_are_read_once(spark):
    """Every rule read them anew (F41)."""
    seen = spark.sparkContext.accumulator(0)

    def kind(x):
        seen.add(1)
        return x

    rows = [("node", 1, 1.0, 1.0, None, None, None), ("way", 2, None, None, [1, 9], [(1.0, 1.0), (2.0, 2.0)], None), ("relation", 3, None, None, None, None, [("relation", 3, "")])]
    df = spark.createDataFrame(rows, "type string, id long, lat double, lon double, nodes array<long>, geometry array<struct<lat:double,lon:double>>, members array<struct<type:string,ref:long,role:string>>")
    got = audit.raw_geometry(df.withColumn("type", F.udf(kind, "string")("type"))).collect()
    assert sorted(map(tuple, got)) == [("relation", 3, "member-cycle"), ("way", 2, "node-missing")] and seen.value == 3


def test_ink_is_selected_without_a_join(spark):
    """Sorted sides of joins were held by the tasks that sort a plate's groups (F38)."""
    rng = random.Random(38)
    rows = [(k % 5, rng.choice("ab"), f"g{k}", rng.randrange(4), rng.choice([None, *map(float, range(0, 60, 3))])) for k in range(200)]
    got = select.ink_selection(spark.createDataFrame(rows, "plate int, layer string, key string, rank int, ink double"), "plate", "layer", "key", "rank", "ink", 200.0, 0.2)
    want = []
    for plate in range(5):
        spent, seeds = 0.0, set()
        for layer in "ab":
            own = 0.0
            for i, (_, _, key, _, ink) in enumerate(sorted((r for r in rows if r[:2] == (plate, layer) and r[4] is not None), key=lambda r: (-r[4], r[2]))):
                if i == 0 or own + ink <= 40.0:
                    own += ink
                    seeds.add(key)
                    want.append((plate, key, "reserve"))
            spent += own
        for _, _, key, _, ink in sorted((r for r in rows if r[0] == plate and r[2] not in seeds and r[4] is not None), key=lambda r: (-r[3], -r[4], r[2])):
            if spent + ink <= 200.0:
                spent += ink
                want.append((plate, key, "fill"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_of_segments_are_never_rows(spark, monkeypatch, kind):
    """Lines over several squares, of any length, some touching, some of one point; blocks of few pairs. Against every pair."""
    monkeypatch.setattr(joins, "PAIRS", 50)
    rng = random.Random(17)
    name = str if kind == "string" else int
    rows = []
    for k in range(60):
        x, y = rng.uniform(-70, 70), rng.uniform(-10, 40)
        for _ in range(rng.randrange(1, 6)):
            u, v = x + rng.uniform(-1, 1) * rng.choice((0, 1, 4, 30)), y + rng.uniform(-1, 1) * rng.choice((0, 1, 4))
            rows.append((name(k), x, y, u, v))
            x, y = u, v
    rows += [(name(100), 0.0, 0.0, 4.0, 0.0), (name(101), 4.0, 0.0, 8.0, 0.0), (name(102), 2.0, 0.5, 2.0, 3.0), (name(103), 2.0, -0.500001, 2.0, -3.0), (None, 0.0, 0.0, 1.0, 1.0), (name(104), None, 0.0, 1.0, 1.0)]
    found = joins.close_pairs(spark.createDataFrame(rows, f"line_id {kind}, x0 double, y0 double, x1 double, y1 double"), 0.5, 4.0)
    assert "join" not in plan(found)

    def apart(x, y, a, b, c, d):
        size = (c - a) ** 2 + (d - b) ** 2
        t = min(1.0, max(0.0, ((x - a) * (c - a) + (y - b) * (d - b)) / size)) if size else 0.0
        return math.hypot(x - a - t * (c - a), y - b - t * (d - b))

    turn = lambda p, x, y: (p[2] - p[0]) * (y - p[1]) - (p[3] - p[1]) * (x - p[0])
    want = {}
    whole = [r for r in rows if None not in r]
    for a, *p in whole:
        for b, *q in whole:
            if a < b:
                crossed = turn(p, *q[:2]) * turn(p, *q[2:]) < 0 and turn(q, *p[:2]) * turn(q, *p[2:]) < 0
                gap = 0.0 if crossed else min(apart(*p[:2], *q), apart(*p[2:], *q), apart(*q[:2], *p), apart(*q[2:], *p))
                want[a, b] = min(gap, want.get((a, b), math.inf))
    got = {(r["a"], r["b"]): r["gap"] for r in found.collect()}
    near = {k: v for k, v in want.items() if v <= 0.5}
    assert got.keys() == near.keys() and all(abs(got[k] - v) < 1e-9 for k, v in near.items()) and len(set(near.values())) > 5


def test_a_file_of_over_two_gigabytes_streams_by(spark, tmp_path):
    """Spark reads no such file whole; its bytes, all zero here, take no disk."""
    size = 2**31 + 12_345
    with open(tmp_path / "long.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "short.bin").write_bytes(b"abc")
    sha, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        sha.update(block)
    sha.update(bytes(size % (1 << 20)))
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha"]) for r in readers.artifacts(spark, str(tmp_path)).collect()}
    assert got == {"long.bin": (size, sha.hexdigest()), "short.bin": (3, hashlib.sha256(b"abc").hexdigest())}


def test_pieces_of_files_are_whole(spark, tmp_path, monkeypatch):
    """Files of any length and name by pieces of 1,000 bytes; one that is cut meanwhile raises."""
    monkeypatch.setattr(readers, "WHOLE", 1500)
    monkeypatch.setattr(readers, "PIECE", 1000)
    rng = random.Random(6)
    want = {}
    for name, size in {"a": 1, "b": 1500, "c": 1501, "d": 2000, "e,f.gz": 123_457, "g{h,i} [j]?%20*": 5000, "k/l": 70_999, "k/m^n é": 1999}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(rng.randbytes(size))
        want[name] = (size, hashlib.sha256((tmp_path / name).read_bytes()).hexdigest())
    found = readers.artifacts(spark, str(tmp_path))
    assert {r["path"].split(f"{tmp_path}/", 1)[1]: (r["length"], r["sha"]) for r in found.collect()} == want
    with open(tmp_path / "k/l", "r+b") as f:
        f.truncate(30_500)
    with pytest.raises(Exception, match="pieces of 70"):
        found.collect()
    assert spark.sparkContext._jsc.sc().conf().get("spark.files.ignoreCorruptFiles", "false") == "false"
