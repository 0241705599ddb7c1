"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waystone.operators import coverage, joins, reconcile, tracks
from waystone.plans.q_tracks import CHAIN, LEGS, by_pos, chained, hav, legs
from waystone.plans.registry import query


#: Every track as a line of its own in a plane: ten of them overlap in a row, the next ten lie far away. ox: the line's place.
PLANE = """pl as (select track_id as line_id, pos, floor(track_id / 10) * 200.0e0 + (track_id % 10) * 4.0e0 as ox, (lon + 3 - (track_id % 50) * 0.1e0) * 1000 as px, (lat - 51 - (track_id % 30) * 0.1e0) * 1000 as y1 from fx_track_pt),
line as (select * from (select line_id, pos, ox, lag(px + ox) over w as x0, lag(y1) over w as y0, px + ox as x1, y1 from pl window w as (partition by line_id order by pos)) q where x0 is not null)"""
#: The same lines closed to rings.
RING = f"""{PLANE}, ring as (select line_id as ring_id, floor(line_id / 10) as rel, pos, px + ox as x0, y1 as y0, coalesce(lead(px + ox) over w, first_value(px + ox) over w) as x1, coalesce(lead(y1) over w, first_value(y1) over w) as y1 from pl window w as (partition by line_id order by pos))"""


def placed(t):
    k = F.col("track_id")
    ox = F.floor(k / 10) * 200.0 + (k % 10) * 4.0
    return t("fx_track_pt").select(k.alias("line_id"), "pos", ox.alias("ox"), ((F.col("lon") + 3 - (k % 50) * 0.1) * 1000).alias("px"), ((F.col("lat") - 51 - (k % 30) * 0.1) * 1000).alias("y1"))


def plane(t):
    by = Window.partitionBy("line_id").orderBy("pos")
    x = F.col("px") + F.col("ox")
    return placed(t).select("line_id", "pos", "ox", F.lag(x).over(by).alias("x0"), F.lag("y1").over(by).alias("y0"), x.alias("x1"), "y1").where("x0 is not null")


def rings(t):
    by = Window.partitionBy("line_id").orderBy("pos")
    x = F.col("px") + F.col("ox")
    after = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(by))
    return placed(t).select(F.col("line_id").alias("ring_id"), F.floor(F.col("line_id") / 10).alias("rel"), "pos", x.alias("x0"), F.col("y1").alias("y0"), after(x).alias("x1"), after(F.col("y1")).alias("y1"))


def seg_dist(px, py, a, b, c, d):
    f = f"case when ({c} - {a}) * ({c} - {a}) + ({d} - {b}) * ({d} - {b}) > 0 then least(1.0, greatest(0.0, (({px} - {a}) * ({c} - {a}) + ({py} - {b}) * ({d} - {b})) / (({c} - {a}) * ({c} - {a}) + ({d} - {b}) * ({d} - {b})))) else 0.0 end"
    return f"sqrt(power({px} - {a} - ({f}) * ({c} - {a}), 2) + power({py} - {b} - ({f}) * ({d} - {b}), 2))"


def side(p, q, x, y):
    return f"sign(({p}.x1 - {p}.x0) * ({q}.{y} - {p}.y0) - ({p}.y1 - {p}.y0) * ({q}.{x} - {p}.x0))"


def lines(t):
    """The legs of all tracks in the plane."""
    return legs(t).select(F.col("track_id").alias("line_id"), "pos", ((F.col("lon0") + 3) * 1000).alias("x0"), ((F.col("lat0") - 51) * 1000).alias("y0"), ((F.col("lon") + 3) * 1000).alias("x1"), ((F.col("lat") - 51) * 1000).alias("y1"))


@query("o4_1_way_node_edges", f"""with p as (select way_id, pos, node_id as a, lead(node_id) over (partition by way_id order by pos) as b from fx_way_node),
e as (select way_id, pos, a, b, x.lon as lon0, x.lat as lat0, y.lon, y.lat from p left join fx_node x on x.node_id = a left join fx_node y on y.node_id = b where b is not null)
select way_id, pos, a, b, round({hav()}, 3) as m from e""")
def way_node_edges(t):
    return joins.edges_of(t("fx_way_node"), t("fx_node")).select("way_id", "pos", "a", "b", F.round("m", 3).alias("m"))


@query("o4_2_relation_members", """select m.relation_id, case when w.way_id is null then 'missing' when m.role = 'platform' then 'support' else 'resolved' end as resolution, count(*) as n
from fx_rel_member m left join (select distinct way_id from fx_way where way_id % 7 <> 0) w on w.way_id = m.way_id group by 1, 2""")
def relation_members(t):
    return reconcile.member_resolution(t("fx_rel_member"), t("fx_way").where("way_id % 7 <> 0"), F.col("role") == "platform")


NEST = "nest as (select p_partkey as parent, case when p_partkey % 5 = 0 then p_partkey * 2 + 1 else (p_partkey * 3) % 400 + p_partkey // 400 * 400 end as child, p_size % 2 = 1 as inside, p_partkey % 3 <> 0 as leaf from part)"


@query("o4_3_nested_relations", f"""with recursive {NEST}, walk as (select parent as root, child, inside, leaf, [parent] as path, 1 as depth from nest union all
select w.root, n.child, w.inside <> n.inside, n.leaf, list_append(w.path, w.child), w.depth + 1 from walk w join nest n on n.parent = w.child where not w.leaf and not list_contains(w.path, w.child))
select root, child as leaf, inside as inner_role, depth from walk where leaf""")
def nested_relations(t):
    p = F.col("p_partkey")
    block = F.floor(p / 400) * 400
    nest = t("part").select(p.alias("parent"), F.when(p % 5 == 0, p * 2 + 1).otherwise((p * 3) % 400 + block).alias("child"), (F.col("p_size") % 2 == 1).alias("inner"), (p % 3 != 0).alias("leaf"))
    return joins.nested_members(nest).withColumnRenamed("inner", "inner_role")


@query("o4_4_inner_ring_container", f"""with {RING}, area as (select rel, ring_id, abs(sum((x0 * y1 - x1 * y0) / 2)) as area from ring group by 1, 2),
pt as (select line_id * 1000 + pos as point_id, floor(line_id / 10) as rel, px + ox + 1.3e0 as x, y1 + 0.7e0 as y from pl),
met as (select point_id, r.ring_id, sum(case when (y1 > y) <> (y0 > y) and x < (x1 - x0) * (y - y0) / nullif(y1 - y0, 0) + x0 then 1 else 0 end) as n from pt join ring r on r.rel = pt.rel group by 1, 2)
select point_id, arg_min(m.ring_id, (a.area, m.ring_id)) as ring_id from met m join area a on a.ring_id = m.ring_id where n % 2 = 1 group by 1""")
def inner_ring_container(t):
    points = placed(t).select((F.col("line_id") * 1000 + F.col("pos")).alias("point_id"), F.floor(F.col("line_id") / 10).alias("rel"), (F.col("px") + F.col("ox") + 1.3).alias("x"), (F.col("y1") + 0.7).alias("y"))
    return joins.smallest_container(points, rings(t), "rel", 10.0)


NEAR = f"near as (select event_id as point_id, node_id, {hav('p.lon', 'p.lat', 'n.lon', 'n.lat')} as m from fx_track_pt p join fx_node n on n.lat between p.lat - 0.02 and p.lat + 0.02 and n.lon between p.lon - 0.04 and p.lon + 0.04)"


@query("o4_5_nodes_in_radius", f"with {NEAR} select point_id, node_id, round(m, 3) as m from near where m <= 1200")
def nodes_in_radius(t):
    points = t("fx_track_pt").select(F.col("event_id").alias("point_id"), "lon", "lat")
    return joins.radius_join(points, t("fx_node"), 1200.0).select("point_id", "node_id", F.round("m", 3).alias("m"))


@query("o7_1_nearest_nodes", f"with {NEAR}, r as (select *, row_number() over (partition by point_id order by m, node_id) as rank from near where m <= 1200) select point_id, node_id, round(m, 3) as m, cast(rank as integer) as rank from r where rank <= 3")
def nearest_nodes(t):
    points = t("fx_track_pt").select(F.col("event_id").alias("point_id"), "lon", "lat")
    return joins.radius_join(points, t("fx_node"), 1200.0, 3).select("point_id", "node_id", F.round("m", 3).alias("m"), "rank")


@query("o4_6_segments_in_radius", f"""with {LEGS}, s as (select track_id * 1000 + pos as segment_id, lon0, lat0, lon, lat from legs where lon0 is not null),
q as (select node_id as point_id, lon as plon, lat as plat from fx_node),
l as (select point_id, segment_id, radians(lon0 - plon) * 6371008.8 * cos(radians(plat)) as ax, radians(lat0 - plat) * 6371008.8 as ay, radians(lon - plon) * 6371008.8 * cos(radians(plat)) as bx, radians(lat - plat) * 6371008.8 as byy from q join s on plat between least(lat0, lat) - 0.01 and greatest(lat0, lat) + 0.01 and plon between least(lon0, lon) - 0.02 and greatest(lon0, lon) + 0.02),
f as (select *, case when (bx - ax) * (bx - ax) + (byy - ay) * (byy - ay) > 0 then least(1.0, greatest(0.0, (-ax * (bx - ax) - ay * (byy - ay)) / ((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay)))) else 0.0 end as f from l)
select point_id, segment_id, round(sqrt(power(ax + f * (bx - ax), 2) + power(ay + f * (byy - ay), 2)), 2) as distance_m from f where sqrt(power(ax + f * (bx - ax), 2) + power(ay + f * (byy - ay), 2)) <= 500""")
def segments_in_radius(t):
    segments = legs(t).select((F.col("track_id") * 1000 + F.col("pos")).alias("segment_id"), F.col("lon0").alias("lon_a"), F.col("lat0").alias("lat_a"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    points = t("fx_node").select(F.col("node_id").alias("point_id"), "lon", "lat")
    return joins.segment_radius_join(points, segments, 500.0, values={"distance_m": F.round("p.distance_m", 2)})


@query("o4_7_name_and_distance", """with m as (select s.station_id, a.code, sqrt(power(s.easting - a.easting, 2) + power(s.northing - a.northing, 2)) as d from fx_station s join fx_authority a on upper(s.name) || ' Railway Station' = a.name),
b as (select station_id, arg_min(code, (d, code)) as code, min(d) as d from m where d <= 1000 group by 1)
select s.station_id as id, b.code, round(b.d, 6) as distance from fx_station s left join b on b.station_id = s.station_id""")
def name_and_distance(t):
    left = t("fx_station").select(F.col("station_id").alias("id"), F.concat(F.upper("name"), F.lit(" Railway Station")).alias("key"), F.col("easting").alias("x"), F.col("northing").alias("y"))
    right = t("fx_authority").select("code", F.col("name").alias("key"), F.col("easting").alias("x"), F.col("northing").alias("y"))
    return joins.nearest_by_key(left, right, "key", 1000.0).select("id", "code", F.round("distance", 6).alias("distance"))


@query("o4_8_candidate_records", """with n as (select station_id as id, name || '!' || (station_id % 4) as exact, name as relaxed from fx_station),
r as (select code, 'auth' || (code % 2) as source, replace(lower(name), ' railway station', '') || '!' || (code % 4) as exact, replace(lower(name), ' railway station', '') as relaxed from fx_authority),
u as (select n.id, r.source, r.code, 0 as strength from n join r on lower(n.exact) = r.exact union all select n.id, r.source, r.code, 1 from n join r on lower(n.relaxed) = r.relaxed),
g as (select id, source, code, min(strength) as strength from u group by 1, 2, 3), k as (select *, row_number() over (partition by id, source order by strength, code) as r from g)
select id, source, code, strength from k where r <= 8""")
def candidate_records(t):
    base = F.regexp_replace(F.lower("name"), " railway station", "")
    names = t("fx_station").select(F.col("station_id").alias("id"), F.concat(F.lower("name"), F.lit("!"), (F.col("station_id") % 4).cast("string")).alias("exact"), F.lower("name").alias("relaxed"))
    records = t("fx_authority").select("code", F.concat(F.lit("auth"), (F.col("code") % 2).cast("string")).alias("source"), F.concat(base, F.lit("!"), (F.col("code") % 4).cast("string")).alias("exact"), base.alias("relaxed"))
    return joins.candidates_by_keys(names, records, 8)


@query("o4_9_active_trips", """with routes as (select c_custkey from customer where c_mktsegment = 'BUILDING'), trips as (select o_orderkey, o_custkey from orders where o_orderstatus <> 'P' and o_custkey in (select c_custkey from routes))
select l_orderkey as trip, count(*) as stop_times from lineitem where l_orderkey in (select o_orderkey from trips) group by 1""")
def active_trips(t):
    trips = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"))
    routes = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("route_id"))
    found = reconcile.active_stop_times(t("lineitem").select(F.col("l_orderkey").alias("trip_id")), trips, routes)
    return found.groupBy(F.col("trip_id").alias("trip")).agg(F.count("*").alias("stop_times"))


@query("o4_10_missing_references", """select 'stop' as kind, count(*) as missing from (select distinct l_partkey from lineitem) x where l_partkey not in (select p_partkey from part where p_partkey % 50 <> 0)
union all select 'route', count(*) from (select distinct o_custkey from orders) y where o_custkey not in (select c_custkey from customer where c_custkey % 40 <> 0)""")
def missing_references(t):
    stops = reconcile.missing_references(t("lineitem").select("l_partkey").distinct(), "l_partkey", t("part").where("p_partkey % 50 <> 0"), "p_partkey")
    routes = reconcile.missing_references(t("orders").select("o_custkey").distinct(), "o_custkey", t("customer").where("c_custkey % 40 <> 0"), "c_custkey")
    return reconcile.broken_references({"stop": stops, "route": routes}).withColumnsRenamed({"rule": "kind", "broken": "missing"})


LEG = f"{CHAIN}, lg as (select track_id, pos, lon as x0, lat as y0, cum_m as d0, lead(lon) over w as x1, lead(lat) over w as y1, lead(cum_m) over w as d1, seg as s0, lead(seg) over w as s1, lead(leg_m) over w as m1 from cum window w as (partition by track_id order by pos)), leg as (select * from lg where s0 = s1 and m1 > 0)"


@query("o4_12_landmark_reference", f"""with {LEG}, mark as (select track_id, event_id as landmark_id, lon + 0.0005 as lon, lat - 0.0007 as lat from fx_track_pt where pos % 10 = 0),
l as (select m.track_id, landmark_id, d0, d1, radians(x0 - lon) * 6371008.8 * cos(radians(lat)) as ax, radians(y0 - lat) * 6371008.8 as ay, radians(x1 - lon) * 6371008.8 * cos(radians(lat)) as bx, radians(y1 - lat) * 6371008.8 as byy from mark m join leg g on g.track_id = m.track_id),
f as (select *, least(1.0, greatest(0.0, (-ax * (bx - ax) - ay * (byy - ay)) / nullif((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay), 0))) as f from l),
d as (select track_id, landmark_id, d0 + coalesce(f, 0) * (d1 - d0) as along, sqrt(power(ax + coalesce(f, 0) * (bx - ax), 2) + power(ay + coalesce(f, 0) * (byy - ay), 2)) as off from f)
select track_id, landmark_id, round(min(off), 2) as offset_m, round(arg_min(along, (round(off, 6), along)), 1) as along_m from d group by 1, 2""")
def landmark_reference(t):
    marks = t("fx_track_pt").where("pos % 10 = 0").select("track_id", F.col("event_id").alias("landmark_id"), (F.col("lon") + 0.0005).alias("lon"), (F.col("lat") - 0.0007).alias("lat"))
    return joins.linear_reference(marks, tracks.legs_of(chained(t))).select("track_id", "landmark_id", F.round("offset_m", 2).alias("offset_m"), F.round("along_m", 1).alias("along_m"))


@query("o4_13_ranking_join", """with r as (select o_orderkey, o_custkey, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders where o_totalprice > 400000)
select o_orderkey as row_id, coalesce(s.s_name, c.c_name) as subject, case when s.s_suppkey is not null then 'seed' else 'base' end as origin from r left join supplier s on s.s_suppkey = r.o_custkey left join customer c on c.c_custkey = r.o_custkey""")
def ranking_join(t):
    r = t("orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("subject_id"))
    seeds = t("supplier").select(F.col("s_suppkey").alias("subject_id"), F.col("s_name").alias("name"))
    base = t("customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_name").alias("name"))
    return reconcile.ranked_subjects(r, seeds, base).withColumn("origin", F.coalesce("origin", F.lit("base")))


@query("o4_14_triplets", """with a as (select o_orderkey as stem from orders where o_orderkey % 4 <> 0), b as (select o_orderkey as stem from orders where o_orderkey % 5 <> 0)
select coalesce(a.stem, b.stem) as stem, case when a.stem is null then 'missing-drawing' when b.stem is null then 'missing-manifest' end as finding from a full outer join b on a.stem = b.stem where a.stem is null or b.stem is null""")
def triplets(t):
    stems = lambda rule: t("orders").where(rule).select(F.col("o_orderkey").alias("stem"))
    return reconcile.incomplete_sets({"drawing": stems("o_orderkey % 4 <> 0"), "manifest": stems("o_orderkey % 5 <> 0")})


@query("o4_15_checksum_join", """with listed as (select doc_id as path, sha256(text || case when doc_id % 50 = 0 then 'x' else '' end) as want from documents where doc_id % 30 <> 0), found as (select doc_id as path, sha256(text) as have from documents where doc_id % 40 <> 0)
select status, count(*) as n from (select case when have is null then 'missing' when want is null then 'unlisted' when want = have then 'pass' else 'mismatch' end as status from listed full outer join found using (path)) x group by 1""")
def checksum_join(t):
    d = t("documents").select(F.col("doc_id").alias("path"), "text")
    listed = d.where("path % 30 <> 0").select("path", F.sha2(F.concat("text", F.when(F.col("path") % 50 == 0, "x").otherwise("")), 256).alias("sha"))
    found = d.where("path % 40 <> 0").select("path", F.sha2("text", 256).alias("sha"))
    return reconcile.checked_files(listed, found).groupBy("status").agg(F.count("*").alias("n"))


@query("o4_16_stage_lineage", """with e as (select way_id from fx_way where way_id % 13 <> 0), d as (select way_id from e where way_id % 11 <> 0), p as (select way_id from d where way_id % 7 <> 0)
select case when p.way_id is not null then 'emitted' when d.way_id is not null then 'physical-omitted' when e.way_id is not null then 'cartographic-omitted' else 'not-extracted' end as status, highway, count(*) as n
from fx_way w left join e on e.way_id = w.way_id left join d on d.way_id = w.way_id left join p on p.way_id = w.way_id group by 1, 2""")
def stage_lineage(t):
    raw = t("fx_way")
    rules = ["way_id % 13 <> 0", "way_id % 11 <> 0", "way_id % 7 <> 0"]
    stages = {name: raw.where(" and ".join(rules[: i + 1])).select("way_id") for i, name in enumerate("edp")}
    lost = {"e": "not-extracted", "d": "cartographic-omitted", "p": "physical-omitted"}
    return reconcile.stage_lineage(raw, "way_id", stages, lost).groupBy("status", "highway").agg(F.count("*").alias("n"))


@query("o4_17_close_pairs", f"""with {PLANE}, g as (select a.line_id as a, b.line_id as b, case when {side('a', 'b', 'x0', 'y0')} * {side('a', 'b', 'x1', 'y1')} < 0 and {side('b', 'a', 'x0', 'y0')} * {side('b', 'a', 'x1', 'y1')} < 0 then 0 else least({seg_dist('a.x0', 'a.y0', 'b.x0', 'b.y0', 'b.x1', 'b.y1')}, {seg_dist('a.x1', 'a.y1', 'b.x0', 'b.y0', 'b.x1', 'b.y1')}, {seg_dist('b.x0', 'b.y0', 'a.x0', 'a.y0', 'a.x1', 'a.y1')}, {seg_dist('b.x1', 'b.y1', 'a.x0', 'a.y0', 'a.x1', 'a.y1')}) end as gap from line a join line b on a.line_id < b.line_id and floor(a.line_id / 10) = floor(b.line_id / 10))
select a, b, round(min(gap), 6) as gap from g where gap <= 0.5 group by 1, 2""")
def close_pairs(t):
    return joins.close_pairs(plane(t), 0.5, 4.0).select("a", "b", F.round("gap", 6).alias("gap"))


@query("o4_19_coincident_segments", """with e as (select l_returnflag as pen, least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, l_quantity as m from lineitem)
select pen, count(*) as drawn, cast(count(*) - count(distinct (a, b)) as bigint) as retraced from e group by 1""")
def coincident_segments(t):
    e = t("lineitem").select(F.col("l_returnflag").alias("pen"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return coverage.coincident(e, ["pen"])


@query("o4_19_retraced_length", """with s as (select l_returnflag as pen, l_suppkey % 4 as way, l_partkey % 40 as x, l_orderkey % 9 as y, l_linenumber as n from lineitem),
l as (select pen, case when way = 1 then 'v' when way = 2 then 'd' else 'h' end as kind, case way when 1 then x when 2 then y - x else y end as line, case way when 1 then y when 3 then x - n else x end as a, case way when 1 then y + n when 3 then x else x + n end as b, case when way = 2 then sqrt(2.0e0) else 1.0e0 end as unit from s),
c as (select *, max(b) over (partition by pen, kind, line order by a, b rows between unbounded preceding and 1 preceding) as reach from l)
select pen, round(sum((b - a) * unit), 4) as drawn, round(sum(greatest(0, b - greatest(a, coalesce(reach, a))) * unit), 4) as distinct_length, round(sum((b - a) * unit) - sum(greatest(0, b - greatest(a, coalesce(reach, a))) * unit), 4) as retraced from c group by 1""")
def retraced_length(t):
    """Lines along, up, aslant and back over a small grid, which overlap in part."""
    way, n = F.col("l_suppkey") % 4, F.col("l_linenumber").cast("double")
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_orderkey") % 9).cast("double")
    dx, dy = F.when(way == 1, 0.0).when(way == 3, -n).otherwise(n), F.when(way.isin(1, 2), n).otherwise(0.0)
    legs = t("lineitem").select(F.col("l_returnflag").alias("pen"), x.alias("x0"), y.alias("y0"), (x + dx).alias("x1"), (y + dy).alias("y1"))
    found = coverage.retraced_length(legs, ["pen"])
    return found.select("pen", F.round("drawn", 4).alias("drawn"), F.round("distinct", 4).alias("distinct_length"), F.round("retraced", 4).alias("retraced"))


@query("o4_21_elevation_precedence", "select feature_id, coalesce(native_ele, case when source_id <> 'src0' then global_ele end) as ele, case when native_ele is not null then 'native' when source_id <> 'src0' then 'global' else 'removed' end as origin from fx_elevation")
def elevation_precedence(t):
    usable = F.when(F.col("source_id") != "src0", F.col("global_ele"))
    return reconcile.first_source(t("fx_elevation"), "feature_id", {"native": F.col("native_ele"), "global": usable}, "ele", "removed")


@query("o4_22_factual_patch", "select o.o_orderkey as record_id, coalesce(case when p.p_size > 25 then cast(p.p_retailprice as double) end, o.o_totalprice) as value, p.p_partkey is not null as patched from orders o left join part p on p.p_partkey = o.o_orderkey and p.p_partkey % 10 = 0")
def factual_patch(t):
    patch = t("part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("record_id"), F.when(F.col("p_size") > 25, F.col("p_retailprice").cast("double")).alias("value"))
    records = t("orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("value"))
    return reconcile.patched(records, patch, "record_id", "value")


DEM = "dem as (select vec_id as tile, cast(i // 8 as integer) as r, cast(i % 8 as integer) as c, cast(embedding[i + 1] as double) * 100 as z from embeddings, unnest(range(64)) as u(i))"


def dem(t):
    return tiles(t)


def tiles(t):
    """The cells of all elevation tiles."""
    cells = t("embeddings").select(F.col("vec_id").alias("tile"), F.posexplode("embedding").alias("i", "v"))
    return cells.select("tile", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), (F.col("v").cast("double") * 100).alias("z"))


@query("o4_23_dem_sample", f"""with {DEM}, s as (select event_id, user_id % 300 as tile, (event_id % 70) / 10.0 as fr, (event_id % 85) / 10.0 as fc from events),
k as (select s.*, z, case when r = floor(fr) then 1 - (fr - floor(fr)) else fr - floor(fr) end * case when c = floor(fc) then 1 - (fc - floor(fc)) else fc - floor(fc) end as w from s left join dem on dem.tile = s.tile and r in (floor(fr), floor(fr) + 1) and c in (floor(fc), floor(fc) + 1))
select event_id as sample_id, round(case when count(z) = 4 then sum(w * z) end, 6) as z from k group by 1""")
def dem_sample(t):
    s = t("events").select(F.col("event_id").alias("sample_id"), (F.col("user_id") % 300).alias("tile"), ((F.col("event_id") % 70) / 10.0).alias("fr"), ((F.col("event_id") % 85) / 10.0).alias("fc"))
    return joins.bilinear(s, dem(t)).select("sample_id", F.round("z", 6).alias("z"))


@query("o4_25_reference_distance", f"""with {PLANE}, d as (select a.line_id, a.pos, min({seg_dist('a.x1', 'a.y1', 'b.x0', 'b.y0', 'b.x1', 'b.y1')}) as d from line a join line b on b.line_id = a.line_id + 1 group by 1, 2),
e as (select b.line_id - 1 as line_id, b.pos, min({seg_dist('b.x1', 'b.y1', 'a.x0', 'a.y0', 'a.x1', 'a.y1')}) as d from line b join line a on b.line_id = a.line_id + 1 group by 1, 2),
m as (select line_id, max(d) as most, avg(d) as mean from d group by 1), n as (select line_id, max(d) as back from e group by 1)
select line_id, round(most, 6) as most, round(mean, 6) as mean, round(back, 6) as back, round(greatest(most, back), 6) as hausdorff from m join n using (line_id)""")
def reference_distance(t):
    """Each line against the next one."""
    p = plane(t)
    found = coverage.reference_distances(p, p.withColumn("line_id", F.col("line_id") - 1))
    return found.select("line_id", *[F.round(c, 6).alias(c) for c in ("most", "mean", "back", "hausdorff")])


@query("o4_28_self_crossings", f"""with {PLANE} select a.line_id as track_id, a.pos as i, b.pos as j from line a join line b on a.line_id = b.line_id and b.pos - a.pos > 1
where {side('a', 'b', 'x0', 'y0')} * {side('a', 'b', 'x1', 'y1')} < 0 and {side('b', 'a', 'x0', 'y0')} * {side('b', 'a', 'x1', 'y1')} < 0""")
def self_crossings(t):
    return joins.crossings(plane(t).withColumnRenamed("line_id", "track_id"), "track_id", 4.0)


@query("o4_29_lap_proximity", f"""with {CHAIN} select a.track_id, a.pos as i, b.pos as j, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) as m from cum a join cum b on a.track_id = b.track_id and b.cum_m - a.cum_m >= 3000 and {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 60""")
def lap_proximity(t):
    p = chained(t)
    pts = p.select("track_id", F.col("pos").alias("point_id"), "lon", "lat")
    keyed = pts.withColumn("point_id", F.struct("track_id", "point_id"))
    near = joins.radius_join(keyed, keyed.withColumnRenamed("point_id", "node_id"), 60.0, within=["track_id"])
    near = near.select("point_id.track_id", F.col("point_id.point_id").alias("i"), F.col("node_id.point_id").alias("j"), "m").where("i < j")
    at = lambda name: p.select("track_id", F.col("pos").alias(name), F.col("cum_m").alias(f"{name}_m"))
    met = near.join(at("i"), ["track_id", "i"]).join(at("j"), ["track_id", "j"]).where("j_m - i_m >= 3000")
    return met.select("track_id", "i", "j", F.round("m", 3).alias("m"))


@query("o4_30_alias_identity", """with a as (select p_partkey as identity, lower(p_name) as alias from part where p_partkey % 2 = 0 union select p_partkey, lower(p_brand || ' ' || p_name) from part where p_partkey % 2 = 0),
r as (select p_partkey as record, lower(p_name) as alias from part where p_partkey % 7 = 0)
select record, case when count(distinct identity) > 1 then null else min(identity) end as identity, count(distinct identity) > 1 as conflict from r join a using (alias) group by 1""")
def alias_identity(t):
    some = t("part").where("p_partkey % 2 = 0")
    aliases = some.select(F.col("p_partkey").alias("identity"), F.explode(F.array(F.lower("p_name"), F.lower(F.concat_ws(" ", "p_brand", "p_name")))).alias("alias"))
    records = t("part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("record"), F.lower("p_name").alias("alias"))
    return reconcile.alias_identity(records, aliases)


@query("o4_17_layer_conflicts")
def layer_conflicts(t):
    """Conflicts of the plane's lines by pair of layers, outside junctions; tests hold it against plain Python."""
    k = F.col("line_id")
    p = plane(t).withColumns({"sheet": F.floor(k / 10), "layer": F.when(k % 3 == 0, "roads").when(k % 3 == 1, "water").otherwise("rail"), "width": F.when(k % 3 == 0, 0.3).otherwise(0.5)})
    found = coverage.close_conflicts(p, 12.0, 0.5)
    return found.select("layer", "other", "conflicts", F.round("least_gap", 6).alias("least_gap"))
