"""Queries of track operators and of scalar geometry over tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waystone.functions import extent, geo, text
from waystone.operators import coverage, reconcile, rollups, tracks
from waystone.plans.registry import query


def by_pos():
    return Window.partitionBy("track_id").orderBy("pos")


#: The legs of fx_track_pt in SQL: both ends, haversine length.
HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2)) + 0 * ({b} - {a} + {d} - {c})))"


def hav(lon0="lon0", lat0="lat0", lon1="lon", lat1="lat") -> str:
    return HAV.format(a=lat0, b=lat1, c=lon0, d=lon1)


LEGS = "legs as (select *, lag(lon) over (partition by track_id order by pos) as lon0, lag(lat) over (partition by track_id order by pos) as lat0, lag(ts) over (partition by track_id order by pos) as ts0 from fx_track_pt)"
SEGS = f"{LEGS}, segs as (select *, cast(sum(case when epoch(ts) - epoch(ts0) > 86400 then 1 else 0 end) over (partition by track_id order by pos rows unbounded preceding) as bigint) as seg from legs)"
CHAIN = f"""{SEGS}, prev as (select *, lag(seg) over (partition by track_id order by pos) as seg0 from segs),
chain as (select *, case when seg0 = seg then {hav()} else 0.0 end as leg_m from prev),
cum as (select *, sum(leg_m) over (partition by track_id order by pos rows unbounded preceding) as cum_m from chain)"""


def legs(t):
    return t("fx_track_pt").withColumns({"lon0": F.lag("lon").over(by_pos()), "lat0": F.lag("lat").over(by_pos())}).where("lon0 is not null")


def chained(t):
    return tracks.chainage(tracks.segmented(t("fx_track_pt"), 86400))


@query("course_verification", f"""with {CHAIN}, parts as (select track_id, seg, sum(leg_m) as m from cum group by 1, 2),
c as (select track_id, sum(m) as measured, max(m) as largest, count(*) as parts, 30000.0 + (track_id % 20) * 2000.0 as official from parts group by 1)
select track_id, parts, round(measured, 3) as measured_m, round((measured - official) / official, 6) as relative_error, round(largest / nullif(measured, 0), 6) as largest_share,
 concat_ws(';', case when measured <= 0 then 'no-length' end, case when (measured - official) / official < -0.01 then 'too-short' end, case when (measured - official) / official > 0.03 then 'too-long' end, case when largest / nullif(measured, 0) < 0.8 then 'fragmented' end) as reasons from c""")
def course_verification(t):
    v = tracks.verification(chained(t), 30000.0 + (F.col("track_id") % 20) * 2000.0, 0.01, 0.03)
    return v.select("track_id", "parts", F.round("measured_m", 3).alias("measured_m"), F.round("relative_error", 6).alias("relative_error"), F.round("largest_share", 6).alias("largest_share"), F.array_join("reasons", ";").alias("reasons"))


@query("o3_1_great_circle", f"with {LEGS} select track_id, pos, round({hav()}, 4) as m from legs where lon0 is not null")
def great_circle(t):
    return legs(t).select("track_id", "pos", F.round(geo.haversine_m("lon0", "lat0", "lon", "lat"), 4).alias("m"))


@query("o3_2_great_circle_point", f"""with {LEGS}, b as (select track_id, pos, lon0, lat0, atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0))) as b, 0.25 * {hav()} / 6371008.8 as d from legs where lon0 is not null),
c as (select *, asin(sin(radians(lat0)) * cos(d) + cos(radians(lat0)) * sin(d) * cos(b)) as la from b)
select track_id, pos, round(degrees(la), 7) as lat, round(degrees(radians(lon0) + atan2(sin(b) * sin(d) * cos(radians(lat0)), cos(d) - sin(radians(lat0)) * sin(la))), 7) as lon from c""")
def great_circle_point(t):
    p = geo.along_great_circle("lon0", "lat0", "lon", "lat", 0.25)
    return legs(t).select("track_id", "pos", F.round(p["lat"], 7).alias("lat"), F.round(p["lon"], 7).alias("lon"))


PROJ = "x1 as (select track_id, pos, radians(lon0 + 0.003) * 0 + radians(-0.003) * 6371008.8 * cos(radians(lat0 + 0.001)) as ax, radians(-0.001) * 6371008.8 as ay, radians(lon - lon0 - 0.003) * 6371008.8 * cos(radians(lat0 + 0.001)) as bx, radians(lat - lat0 - 0.001) * 6371008.8 as byy, lon0, lat0, lon, lat from legs where lon0 is not null), x2 as (select *, (bx - ax) * (bx - ax) + (byy - ay) * (byy - ay) as s from x1), x3 as (select *, case when s > 0 then least(1.0, greatest(0.0, (-ax * (bx - ax) - ay * (byy - ay)) / s)) else 0.0 end as f from x2)"


@query("o3_3_segment_projection", f"with {LEGS}, {PROJ} select track_id, pos, round(sqrt(power(ax + f * (bx - ax), 2) + power(ay + f * (byy - ay), 2)), 3) as distance_m, round(f, 7) as fraction, round(lon0 + f * (lon - lon0), 8) as lon, round(lat0 + f * (lat - lat0), 8) as lat from x3")
def segment_projection(t):
    p = geo.segment_projection(F.col("lon0") + 0.003, F.col("lat0") + 0.001, "lon0", "lat0", "lon", "lat")
    out = legs(t).withColumn("p", p)
    return out.select("track_id", "pos", F.round("p.distance_m", 3).alias("distance_m"), F.round("p.fraction", 7).alias("fraction"), F.round("p.lon", 8).alias("lon"), F.round("p.lat", 8).alias("lat"))


@query("o3_4_line_distance", f"with {LEGS} select track_id, pos, round(case when lon = lon0 and lat = lat0 then sqrt(power(0.01, 2) + power(0.02, 2)) else abs((lat - lat0) * (lon0 + 0.01) - (lon - lon0) * (lat0 + 0.02) + lon * lat0 - lat * lon0) / sqrt(power(lon - lon0, 2) + power(lat - lat0, 2)) end, 7) as d from legs where lon0 is not null")
def line_distance(t):
    return legs(t).select("track_id", "pos", F.round(geo.line_distance(F.col("lon0") + 0.01, F.col("lat0") + 0.02, "lon0", "lat0", "lon", "lat"), 7).alias("d"))


@query("o3_5_polyline_length", f"with {LEGS} select track_id, round(sum(coalesce(sqrt(power(lon - lon0, 2) + power(lat - lat0, 2)), 0)), 7) as length from legs group by 1")
def polyline_length(t):
    pts = t("fx_track_pt").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"))
    return pts.select("track_id", F.round(geo.array_length(F.col("p")), 7).alias("length"))


@query("o3_6_page_projection", "select track_id, pos, round(radians(lon + 0.5) * 6371008.8 * cos(radians(52.5)) * 1000 / 25000, 5) as x_mm, round(radians(52.5 - lat) * 6371008.8 * 1000 / 25000, 5) as y_mm from fx_track_pt")
def page_projection(t):
    x, y = geo.page_mm("lon", "lat", -0.5, 52.5, 25000.0)
    return t("fx_track_pt").select("track_id", "pos", F.round(x, 5).alias("x_mm"), F.round(y, 5).alias("y_mm"))


@query("o3_7_tiles", "select track_id, pos, round(radians(lon) * 6378137.0, 4) as mx, round(asinh(tan(radians(lat))) * 6378137.0, 4) as my, cast(floor((lon + 180) / 360 * 4096) as integer) as tx, cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096) as integer) as ty from fx_track_pt")
def tiles(t):
    (mx, my), (tx, ty) = geo.mercator("lon", "lat"), geo.tile_of("lon", "lat", 12)
    return t("fx_track_pt").select("track_id", "pos", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"), tx.alias("tx"), ty.alias("ty"))


CLIP = f"""with {LEGS}, p as (select track_id, pos, lon0, lat0, lon, lat, lon - lon0 as dx, lat - lat0 as dy from legs where lon0 is not null),
q as (select *, greatest(0.0, case when dx > 0 then (-1.0 - lon0) / dx end, case when dx < 0 then (1.0 - lon0) / dx end, case when dy > 0 then (51.5 - lat0) / dy end, case when dy < 0 then (53.0 - lat0) / dy end) as t0,
 least(1.0, case when dx > 0 then (1.0 - lon0) / dx end, case when dx < 0 then (-1.0 - lon0) / dx end, case when dy > 0 then (53.0 - lat0) / dy end, case when dy < 0 then (51.5 - lat0) / dy end) as t1,
 (dx = 0 and (lon0 < -1.0 or lon0 > 1.0)) or (dy = 0 and (lat0 < 51.5 or lat0 > 53.0)) as off from p)"""


@query("o3_8_rectangle_clip", f"{CLIP} select track_id, pos, round(lon0 + t0 * dx, 7) as x0, round(lat0 + t0 * dy, 7) as y0, round(lon0 + t1 * dx, 7) as x1, round(lat0 + t1 * dy, 7) as y1 from q where not off and t0 <= t1")
def rectangle_clip(t):
    c = legs(t).withColumn("c", geo.clip_parameters("lon0", "lat0", "lon", "lat", -1.0, 51.5, 1.0, 53.0)).where("c is not null")
    at = lambda a, b, f: F.round(F.col(a) + F.col(f"c.{f}") * (F.col(b) - F.col(a)), 7)
    return c.select("track_id", "pos", at("lon0", "lon", "t0").alias("x0"), at("lat0", "lat", "t0").alias("y0"), at("lon0", "lon", "t1").alias("x1"), at("lat0", "lat", "t1").alias("y1"))


RING = "ring as (select *, coalesce(lead(lon) over (partition by track_id order by pos), first_value(lon) over (partition by track_id order by pos)) as lon1, coalesce(lead(lat) over (partition by track_id order by pos), first_value(lat) over (partition by track_id order by pos)) as lat1, avg(lon) over (partition by track_id) as cx, avg(lat) over (partition by track_id) as cy from fx_track_pt)"


@query("o3_9_ring_area_and_inside", f"with {RING} select track_id, round(abs(sum(((lon - cx) * (lat1 - cy) - (lon1 - cx) * (lat - cy)) / 2)), 9) as area, cast(sum(case when (lat1 > cy) <> (lat > cy) and cx < (lon1 - lon) * (cy - lat) / nullif(lat1 - lat, 0) + lon then 1 else 0 end) as bigint) % 2 = 1 as inside from ring group by 1")
def ring_area_and_inside(t):
    every = Window.partitionBy("track_id")
    ring = t("fx_track_pt").withColumns({"lon1": F.coalesce(F.lead("lon").over(by_pos()), F.first("lon").over(by_pos())), "lat1": F.coalesce(F.lead("lat").over(by_pos()), F.first("lat").over(by_pos())), "cx": F.avg("lon").over(every), "cy": F.avg("lat").over(every)})
    area = F.sum(geo.shoelace_term(F.col("lon") - F.col("cx"), F.col("lat") - F.col("cy"), F.col("lon1") - F.col("cx"), F.col("lat1") - F.col("cy")))
    return ring.groupBy("track_id").agg(F.round(F.abs(area), 9).alias("area"), (F.count_if(geo.crosses_ray("cx", "cy", "lon", "lat", "lon1", "lat1")) % 2 == 1).alias("inside"))


TURN = f"with {LEGS}, n as (select *, lead(lon) over (partition by track_id order by pos) as lon1, lead(lat) over (partition by track_id order by pos) as lat1 from legs), d as (select track_id, pos, sqrt(power(lon - lon0, 2) + power(lat - lat0, 2)) * sqrt(power(lon1 - lon, 2) + power(lat1 - lat, 2)) as s, (lon - lon0) * (lon1 - lon) + (lat - lat0) * (lat1 - lat) as dot from n where lon0 is not null and lon1 is not null)"


@query("o3_10_turn_angle", f"{TURN} select track_id, pos, round(case when s > 0 then degrees(acos(least(1.0, greatest(-1.0, dot / s)))) end, 4) as degrees from d")
def turn_angle(t):
    p = legs(t).withColumns({"lon1": F.lead("lon").over(by_pos()), "lat1": F.lead("lat").over(by_pos())}).where("lon1 is not null")
    return p.select("track_id", "pos", F.round(geo.turn_degrees("lon0", "lat0", "lon", "lat", "lon1", "lat1"), 4).alias("degrees"))


@query("o3_11_oriented_span", """with a as (select unnest(range(0, 90)) as deg), r as (select track_id, deg, max(lon * cos(radians(deg)) + lat * sin(radians(deg))) - min(lon * cos(radians(deg)) + lat * sin(radians(deg))) as u, max(lat * cos(radians(deg)) - lon * sin(radians(deg))) - min(lat * cos(radians(deg)) - lon * sin(radians(deg))) as v from fx_track_pt cross join a group by 1, 2),
b as (select track_id, arg_min({'u': u, 'v': v, 'deg': deg}, (u * v, deg)) as b from r group by 1)
select track_id, round(b.u * b.v, 7) as area, round(least(b.u, b.v), 7) as short_side, cast(case when b.u >= b.v then b.deg else b.deg + 90 end as integer) as bearing from b""")
def oriented_span(t):
    found = coverage.oriented_span(t("fx_track_pt").select("track_id", F.col("lon").alias("x"), F.col("lat").alias("y")), "track_id")
    return found.select("track_id", F.round("area", 7).alias("area"), F.round("short_side", 7).alias("short_side"), "bearing")


#: Names with marks, abbreviations, suffixes and qualifiers, and the rule of their keys in SQL.
RAW = """case p_partkey % 6 when 0 then p_name || ' Nth Jn (Goods)' when 1 then 'Łow ' || p_name || ' & Sth Jcn' when 2 then 'St. ' || p_name || '  Railway Station' when 3 then p_name || ' Stn via Łódź' when 4 then 'Ñew ' || p_name || ' Tráin Station' else p_name || ' for Bìg ﬁelds' end"""


def sql_key(x: str) -> str:
    ascii_ = f"lower(regexp_replace(strip_accents(replace({x}, 'ﬁ', 'fi')), '[^\\x00-\\x7F]', '', 'g'))"
    words = f"trim(regexp_replace(replace({ascii_}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
    for short, long in text.ABBREVIATIONS.items():
        words = f"regexp_replace({words}, '\\b{short}\\b', '{long}', 'g')"
    return f"trim(regexp_replace({words}, '\\b(?:railway\\s+station|rail\\s+station|train\\s+station|station|stn)$', ''))"


@query("o3_12_name_keys", f"""with n as (select p_partkey as code, {RAW} as raw from part)
select code, {sql_key('raw')} as key, trim(regexp_replace({sql_key("regexp_replace(raw, '[ ]*[(][^)]*[)][ ]*', ' ', 'g')")}, '\\b(?:for|via)\\b.*$', '')) as relaxed,
 trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(raw), '&', ' and '), '\\b(?:railway|rail)[ ]+station\\b', ' ', 'g'), '\\bstation\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) as station from n""")
def name_keys(t):
    n = t("part").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))  # a small file of much work
    n = n.select(F.col("p_partkey").alias("code"), F.expr(RAW).alias("raw"))
    return n.select("code", text.name_key(F.col("raw")).alias("key"), text.relaxed_name_key(F.col("raw")).alias("relaxed"), text.station_key(F.col("raw")).alias("station"))


@query("o3_14_rank_notation", "select o_orderkey as k, case when o_orderkey % 7 <> 6 and o_orderkey % 50 <> 0 then cast(o_orderkey % 50 as integer) end as rank, o_orderkey % 3 = 0 as tied from orders")
def rank_notation(t):
    k = F.col("o_orderkey")
    shown = F.concat((k % 50).cast("string"), F.when(k % 7 == 6, "-6").otherwise(""), F.when(k % 3 == 0, "=").otherwise(""))
    return t("orders").select(k.alias("k"), text.rank_number(shown).alias("rank"), text.is_tied(shown).alias("tied"))


@query("o3_15_lap_time", "select o_orderkey as k, case when o_orderkey % 4 <> 0 then cast(60000 + (o_orderkey % 60) * 1000 + o_orderkey % 1000 as integer) end as ms from orders")
def lap_time(t):
    k = F.col("o_orderkey")
    shown = F.concat(F.lit("1:"), F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 4 == 0, ",").otherwise("."), F.lpad((k % 1000).cast("string"), 3, "0"))
    return t("orders").select(k.alias("k"), text.lap_ms(shown).alias("ms"))


@query("o3_16_hole_number", """select o_orderkey as k, case when o_orderkey % 25 between 1 and 18 and o_orderkey % 6 in (0, 1) then cast(o_orderkey % 25 as integer) end as plain,
 case when o_orderkey % 25 between 1 and 18 and o_orderkey % 6 = 2 then cast(o_orderkey % 25 as integer) end as suffixed, case when o_orderkey % 25 between 1 and 18 and o_orderkey % 6 = 3 then cast(o_orderkey % 25 as integer) end as of_course from orders""")
def hole_number(t):
    k = F.col("o_orderkey")
    n = (k % 25).cast("string")
    ref = F.when(k % 6 == 0, n).when(k % 6 == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(k % 6 == 2, F.concat(n, F.lit("b"))).when(k % 6 == 3, F.concat(n, F.lit(" - Old"))).when(k % 6 == 4, F.concat(F.lit("hole "), n)).otherwise(F.concat(n, F.lit(" (par)")))
    return t("orders").select(k.alias("k"), text.hole_number(ref).alias("plain"), text.hole_number(ref, suffix="B").alias("suffixed"), text.hole_number(ref, course_token="Old").alias("of_course"))


@query("o3_17_rail_times", """select o_orderkey as k, cast(cast(o_orderdate as date) as varchar) as by_ymd, cast(cast(o_orderdate as date) as varchar) as by_dmy, case when o_orderkey % 10 < 8 then cast((o_orderkey % 24) * 120 + (o_orderkey % 60) * 2 + case when o_orderkey % 2 = 0 then 1 else 0 end as integer) end as half,
 case when o_orderkey % 120 <> 0 then cast((o_orderkey % 24) * 120 + (o_orderkey % 60) * 2 as integer) end as public, 'TB,-U' as codes from orders""")
def rail_times(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    hhmm = F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"))
    working = F.concat(hhmm, F.when(k % 10 >= 8, "X").when(k % 2 == 0, "H").otherwise(" "))
    return t("orders").select(k.alias("k"), text.yymmdd(F.date_format(d, "yyMMdd")).cast("string").alias("by_ymd"), text.ddmmyy(F.date_format(d, "ddMMyy")).cast("string").alias("by_dmy"), text.half_minutes(working).alias("half"), text.public_time(hhmm).alias("public"), F.array_join(text.activity_codes(F.lit("TB  -U")), ",").alias("codes"))


@query("o3_18_content_hash", """with h as (select layer, sha256(concat_ws('|', cast(stroke_id as varchar), layer, coalesce(pen, '~'), cast(source_ref as varchar))) as d from fx_stroke),
b as (select layer, substr(d, 1, 3) as b, sha256(string_agg(d, chr(10) order by d)) as s from h group by 1, 2) select layer, sha256(string_agg(s, chr(10) order by b)) as digest from b group by 1""")
def content_hash(t):
    d = text.record_digest(F.col("stroke_id"), F.col("layer"), F.col("pen"), F.col("source_ref"))
    return reconcile.digest_of_set(t("fx_stroke"), ["layer"], d)


@query("o3_19_line_direction", f"with {LEGS} select count(*) as legs, count(distinct case when (round(lon0, 7), round(lat0, 7)) <= (round(lon, 7), round(lat, 7)) then concat_ws(' ', round(lon0, 7), round(lat0, 7), round(lon, 7), round(lat, 7)) else concat_ws(' ', round(lon, 7), round(lat, 7), round(lon0, 7), round(lat0, 7)) end) as lines from legs where lon0 is not null")
def line_direction(t):
    point = lambda a, b: F.struct(F.round(a, 7).alias("x"), F.round(b, 7).alias("y"))
    a, b = point("lon0", "lat0"), point("lon", "lat")
    both = legs(t).select(geo.canonical_line(a, b).alias("line")).unionByName(legs(t).select(geo.canonical_line(b, a).alias("line")))
    return both.agg((F.count("*") / 2).cast("bigint").alias("legs"), F.countDistinct("line").alias("lines"))


@query("o3_20_source_refs", "select way_id, 'way/' || way_id || case when way_id % 2 = 0 then ';relation/' || (way_id % 10) else '' end as roots from fx_way")
def source_refs(t):
    w = F.col("way_id").cast("string")
    refs = F.concat(F.lit("way/"), w, F.lit("/1; way/"), w, F.lit("/2;"), F.when(F.col("way_id") % 2 == 0, F.concat(F.lit("relation/"), (F.col("way_id") % 10).cast("string"), F.lit("/0;;"))).otherwise(""))
    return t("fx_way").select("way_id", F.array_join(text.source_roots(refs), ";").alias("roots"))


MORTON = " + ".join(f"((({v} >> {k}) & 1) << {2 * k + o})" for v, o in (("ix", 0), ("iy", 1)) for k in range(10))


@query("o3_21_morton", f"select node_id, cast({MORTON} as bigint) as cell from (select node_id, cast(floor(least(1.0, greatest(0.0, (lon + 3.0) / 1.0)) * 1023) as bigint) as ix, cast(floor(least(1.0, greatest(0.0, (lat - 51.0) / 1.0)) * 1023) as bigint) as iy from fx_node) x")
def morton(t):
    return t("fx_node").select("node_id", geo.morton("lon", "lat", -3.0, 51.0, -2.0, 52.0).alias("cell"))


@query("o3_22_physical_scale", "select stroke_id, round(length_mm * 25000 / 1000.0, 6) as ground_m, round(case pen when 'O' then 0.3 else 0.5 end * 25.0, 6) as width_m from fx_stroke")
def physical_scale(t):
    nib = F.when(F.col("pen") == "O", 0.3).otherwise(0.5)
    return t("fx_stroke").select("stroke_id", F.round(geo.ground_metres("length_mm", 25000.0), 6).alias("ground_m"), F.round(geo.ground_metres(nib, 25000.0), 6).alias("width_m"))


@query("o3_23_value_coercion", "select o_orderkey as k, case when o_orderkey % 5 in (0, 1, 2) then null when o_orderkey % 5 = 3 then o_totalprice else cast(o_orderkey as double) end as v from orders")
def value_coercion(t):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, "NaN").when(k % 5 == 1, "true").when(k % 5 == 2, "-Infinity").when(k % 5 == 3, F.col("o_totalprice").cast("string")).otherwise(k.cast("string"))
    return t("orders").select(k.alias("k"), text.finite(raw).alias("v"))


@query("o3_24_axis_transform", "select p_partkey as id, round((p_retailprice - 900) / 1200, 8) as linear, round((log10(p_retailprice) - log10(900)) / (log10(2100) - log10(900)), 8) as logarithmic from part")
def axis_transform(t):
    return t("part").select(F.col("p_partkey").alias("id"), F.round(geo.axis_position("p_retailprice", 900.0, 2100.0), 8).alias("linear"), F.round(geo.axis_position("p_retailprice", 900.0, 2100.0, True), 8).alias("logarithmic"))


@query("o6_1_chainage", f"with {CHAIN} select track_id, pos, seg, round(cum_m, 3) as cum_m from cum")
def chainage(t):
    return chained(t).select("track_id", "pos", "seg", F.round("cum_m", 3).alias("cum_m"))


@query("o6_2_profile_runs", f"""with {SEGS}, b as (select *, case when ele is null or coalesce(lag(seg) over w <> seg, true) or lag(ele) over w is null then 1 else 0 end as b from segs window w as (partition by track_id order by pos)),
r as (select *, sum(b) over (partition by track_id order by pos rows unbounded preceding) as run from b)
select track_id, min(pos) as first_pos, max(pos) as last_pos, count(*) as points, min(ele) as least_ele, max(ele) as most_ele from r where ele is not null group by track_id, run""")
def profile_runs(t):
    return tracks.profile_runs(tracks.segmented(t("fx_track_pt"), 86400))


@query("o6_3_repeated_points")
def repeated_points(t):
    return tracks.without_repeats(tracks.segmented(t("fx_track_pt"), 86400), 400.0)


@query("o6_4_spikes", f"""with recursive {SEGS}, n as (select track_id, seg, pos, lon, lat, row_number() over w as rn, lag(lon) over w as a0, lag(lat) over w as b0, lead(lon) over w as a2, lead(lat) over w as b2 from segs window w as (partition by track_id, seg order by pos)),
l as (select track_id, seg, case when a0 is not null then {hav('a0', 'b0', 'lon', 'lat')} end as m from n), g as (select track_id, seg, greatest(300.0, coalesce(median(case when m > 1e-6 then m end), 0) * 0.8) as gate from l group by 1, 2 having count(*) >= 4),
d as (select n.*, gate, pos % 11 = 0 as stays from n join g using (track_id, seg)),
r as (select track_id, seg, rn, pos, lon as klon, lat as klat, cast(null as double) as detour from d where rn = 1
 union all select track_id, seg, rn, pos, case when spike then klon else lon end, case when spike then klat else lat end, case when spike then a + b end from
 (select *, not stays and a2 is not null and a >= gate and b >= gate and (a + b) / greatest(c, 0.01) >= 3.0 as spike from
 (select d.*, klon, klat, {hav('klon', 'klat', 'd.lon', 'd.lat')} as a, {hav('d.lon', 'd.lat', 'd.a2', 'd.b2')} as b, {hav('klon', 'klat', 'd.a2', 'd.b2')} as c from r join d on d.track_id = r.track_id and d.seg = r.seg and d.rn = r.rn + 1) x) y)
select track_id, pos, round(detour, 3) as detour_m from r where detour is not null""")
def spikes(t):
    """Outliers against the last kept point; every eleventh point is preserved."""
    p = tracks.segmented(t("fx_track_pt"), 86400).withColumn("stays", F.col("pos") % 11 == 0)
    return tracks.spikes(p, 300.0, 3.0, 0.8, preserved="stays").select("track_id", "pos", F.round("detour_m", 3).alias("detour_m"))


@query("o6_4_fast_spikes")
def fast_spikes(t):
    """Outliers that take a speed as well; tests hold it against plain Python."""
    s = tracks.spikes(tracks.segmented(t("fx_track_pt"), 86400), 300.0, 3.0, 0.8, speed_m_s=0.05)
    return s.select("track_id", "pos", F.round("detour_m", 3).alias("detour_m"))


@query("o6_3_removed_points")
def removed_points(t):
    """Points that repeat the last kept one; a kept point takes over their elevations. Tests hold it against plain Python."""
    d = tracks.deduplicated(tracks.segmented(t("fx_track_pt"), 86400), 400.0, merged=("ele",))
    return d.select("track_id", "seg", "pos", "ele", F.round("separation_m", 3).alias("separation_m"))


@query("o6_5_invalid_vertex_split", """with r as (select track_id, pos, ele, sum(case when ele is null then 1 else 0 end) over (partition by track_id order by pos rows unbounded preceding) as run from fx_track_pt)
select track_id, min(pos) as first_pos, count(*) as points from r where ele is not null group by track_id, run having count(*) >= 2""")
def invalid_vertex_split(t):
    runs = tracks.islands(t("fx_track_pt"), F.col("ele").isNull(), ["track_id"], ["pos"], "run").where("ele is not null")
    return runs.groupBy("track_id", "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("points")).where("points >= 2").drop("run")


CALLS = "calls as (select user_id as trip, ts, event_id, event_type as stop, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)"


@query("o6_6_stop_collapse", f"with {CALLS} select trip, event_id, stop from calls where before is null or before <> stop")
def stop_collapse(t):
    calls = t("events").select(F.col("user_id").alias("trip"), "ts", "event_id", F.col("event_type").alias("stop"))
    return tracks.collapsed_stops(calls, "trip", ["ts", "event_id"], "stop").select("trip", "event_id", "stop")


@query("o6_7_transitions", f"with {CALLS} select before as origin, stop as destination, count(*) as n, min(event_id) as example from calls where before is not null group by 1, 2")
def transitions(t):
    return tracks.transitions(t("events"), "user_id", ["ts", "event_id"], "event_type", "event_id")


@query("o6_8_member_discontinuity", "select relation_id, pos, way_id from (select *, way_id % 5 as a, (way_id + pos) % 5 as b, lead(way_id % 5) over w as na, lead((way_id + pos) % 5) over w as nb from fx_rel_member window w as (partition by relation_id order by pos)) x where na is not null and a <> na and a <> nb and b <> na and b <> nb")
def member_discontinuity(t):
    ends = F.array(F.col("way_id") % 5, (F.col("way_id") + F.col("pos")) % 5)
    return tracks.discontinuities(t("fx_rel_member"), "relation_id", ends).select("relation_id", "pos", "way_id")


@query("o6_10_contiguous_positions", "select o_custkey as list, count(*) as n, max(line) <> count(*) or count(distinct line) <> count(*) or min(line) <> 1 as broken from (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) + case when o_orderkey % 97 = 0 then 1 else 0 end as line from orders) x group by 1")
def contiguous_positions(t):
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    p = t("orders").select(F.col("o_custkey").alias("list"), (F.row_number().over(by) + F.when(F.col("o_orderkey") % 97 == 0, 1).otherwise(0)).alias("line"))
    return tracks.broken_positions(p, "list", "line")


@query("o6_13_extrema_buckets", """with n as (select track_id, pos, ele, row_number() over (partition by track_id order by pos) - 1 as i, count(*) over (partition by track_id) as n from fx_track_pt where ele is not null),
b as (select *, floor(i * 8 / n) as b from n), r as (select *, row_number() over (partition by track_id, b order by ele, pos) as lo, row_number() over (partition by track_id, b order by ele desc, pos) as hi from b)
select track_id, pos, ele from r where lo = 1 or hi = 1 or i = 0 or i = n - 1""")
def extrema_buckets(t):
    return tracks.extrema_buckets(t("fx_track_pt"), "ele", 8)


@query("o6_14_reversals", """with p as (select track_id, pos, lag(pos) over (partition by track_id order by pos) as before, nullif(sign(ele - lag(ele) over (partition by track_id order by pos)), 0) as s from fx_track_pt where ele is not null),
d as (select *, last_value(s ignore nulls) over (partition by track_id order by pos rows between unbounded preceding and 1 preceding) as t from p)
select track_id, before as pos from d where s is not null and t is not null and s <> t""")
def reversals(t):
    return tracks.reversals(t("fx_track_pt"), "ele")


STEP = f"with {CHAIN}, l as (select track_id, pos, lon as x0, lat as y0, ele as e0, cum_m as d0, lead(lon) over w as x1, lead(lat) over w as y1, lead(ele) over w as e1, lead(cum_m) over w as d1, seg as s0, lead(seg) over w as s1 from cum window w as (partition by track_id order by pos)), g as (select * from l where s0 = s1 and d1 > d0)"


@query("o6_16_equal_steps", f"{STEP} select track_id, d * 1.0 as d, round(x0 + (d - d0) / (d1 - d0) * (x1 - x0), 7) as lon, round(y0 + (d - d0) / (d1 - d0) * (y1 - y0), 7) as lat from g join (select unnest(range(500, 200000, 500)) as d) s on d > d0 and d <= d1")
def equal_steps(t):
    found = tracks.resampled(tracks.legs_of(chained(t)), 500.0)
    return found.select("track_id", "d", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("o4_11_station_at_distance", f"{STEP}, w as (select distinct track_id, unnest([1000.5, 2500.25, 9999.0]) as d from fx_track_pt) select w.track_id, w.d, round(x0 + (d - d0) / (d1 - d0) * (x1 - x0), 7) as lon, round(e0 + (d - d0) / (d1 - d0) * (e1 - e0), 5) as ele, case when e0 is null or e1 is null then 'unavailable' else 'interpolated' end as status from w join g on w.track_id = g.track_id and d > d0 and d <= d1")
def station_at_distance(t):
    wanted = t("fx_track_pt").select("track_id").distinct().select("track_id", F.explode(F.array(F.lit(1000.5), F.lit(2500.25), F.lit(9999.0))).alias("d"))
    s = tracks.stations(tracks.legs_of(chained(t)), wanted)
    return s.select("track_id", "d", F.round("lon", 7).alias("lon"), F.round("ele", 5).alias("ele"), "status")


@query("o5_3_course_extent", """with b as (select track_id, min(lon) as w, max(lon) as e, min(la) as s, max(la) as n from (select *, case when track_id % 10 = 0 then 52.5e0 else lat end as la from fx_track_pt) q group by 1),
c as (select track_id, case when e - w < 1 / 111320.0e0 then (w + e) / 2 - 0.5 / 111320.0e0 else w end as w, case when e - w < 1 / 111320.0e0 then (w + e) / 2 + 0.5 / 111320.0e0 else e end as e, case when n - s < 1 / 111320.0e0 then (s + n) / 2 - 0.5 / 111320.0e0 else s end as s, case when n - s < 1 / 111320.0e0 then (s + n) / 2 + 0.5 / 111320.0e0 else n end as n from b),
m as (select *, 0.08 * greatest(e - w, n - s) as p from c)
select track_id, round(w, 9) as west, round(s, 9) as south, round(e, 9) as east, round(n, 9) as north, round(w - p, 9) as framed_west, round(n + p, 9) as framed_north from m""")
def course_extent(t):
    """Every tenth track runs dead straight from west to east."""
    p = t("fx_track_pt").withColumn("lat", F.when(F.col("track_id") % 10 == 0, 52.5).otherwise(F.col("lat")))
    e = p.groupBy("track_id").agg(extent.bounds("lon", "lat").alias("e")).withColumn("e", extent.never_flat(F.col("e"))).withColumn("m", extent.with_margin(F.col("e"), 0.08))
    r = lambda c, name: F.round(c, 9).alias(name)
    return e.select("track_id", *[r(f"e.{c}", c) for c in ("west", "south", "east", "north")], r("m.west", "framed_west"), r("m.north", "framed_north"))


@query("o5_18_elevation_extent", "select track_id, min(ele) as least_ele, max(ele) as most_ele, count(ele) > 0 as any_ele, count(ele) = count(*) as complete from fx_track_pt group by 1")
def elevation_extent(t):
    return rollups.elevation_extent(t("fx_track_pt"))
