"""Queries of ranked and budgeted selection, and of the windows beside it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waystone.functions import rail
from waystone.operators import coverage, select, tracks
from waystone.operators.terrain import gradient, smoothed
from waystone.plans.q_joins import DEM, LEG, PLANE, dem, placed, plane
from waystone.plans.q_tracks import chained
from waystone.plans.registry import query


@query("o6_9_precedence_winner", """with a as (select *, case stp when 'C' then 4 when 'O' then 3 when 'N' then 2 else 1 end as p from fx_schedule where date '1995-06-15' between runs_from and runs_to),
r as (select *, rank() over (partition by uid order by p desc) as r, max(case when stp = 'P' then 1 else 0 end) over (partition by uid) as has_p from a),
w as (select uid, stp, src_line, has_p, count(*) over (partition by uid) as n from r where r = 1)
select uid, src_line, case when n > 1 then 'tie' when stp = 'C' then 'cancelled' when stp = 'O' and has_p = 0 then 'missing-permanent' else 'runs' end as status from w""")
def precedence_winner(t):
    day = F.lit("1995-06-15").cast("date")
    active = t("fx_schedule").where(day.between(F.col("runs_from"), F.col("runs_to"))).withColumn("p", rail.precedence(F.col("stp")))
    ranked = active.withColumn("r", F.rank().over(Window.partitionBy("uid").orderBy(F.desc("p")))).withColumn("has_p", F.bool_or(F.col("stp") == "P").over(Window.partitionBy("uid")))
    winners = ranked.where("r = 1").withColumn("n", F.count("*").over(Window.partitionBy("uid")))
    status = F.when(F.col("n") > 1, "tie").when(F.col("stp") == "C", "cancelled").when((F.col("stp") == "O") & ~F.col("has_p"), "missing-permanent").otherwise("runs")
    return winners.select("uid", "src_line", status.alias("status"))


@query("o6_11_distributed_pick", """with c as (select *, cast(least(floor(least(1.0, greatest(0.0, route_axis)) * 6), 5) as integer) as band from fx_candidate),
f as (select *, row_number() over (partition by kind, band order by priority, distance_m, id) = 1 as first from c),
r as (select *, row_number() over (partition by kind order by first desc, case when first then band end, priority, distance_m, id) as place from f)
select kind, id, band, cast(place as integer) as place from r where place <= 10""")
def distributed_pick(t):
    return select.distributed(t("fx_candidate"), ["kind"], F.col("route_axis"), 6, ["priority", "distance_m", "id"], 10).select("kind", "id", "band", "place")


@query("o6_12_tile_rounds", "select stroke_id, layer, source_ref % 9 as tile, cast(row_number() over (partition by layer, source_ref % 9 order by length_mm desc, stroke_id) - 1 as integer) as round from fx_stroke")
def tile_rounds(t):
    s = t("fx_stroke").withColumn("tile", F.col("source_ref") % 9)
    return select.round_robin(s, "layer", "tile", [F.desc("length_mm"), "stroke_id"]).select("stroke_id", "layer", "tile", "round")


@query("o6_15_turn_stations")
def turn_stations(t):
    """Every track's line, a hundred times larger, as a lap; tests hold it against plain Python."""
    laps = placed(t).select(F.col("line_id").alias("lap"), "pos", (F.col("px") * 100).alias("x"), (F.col("y1") * 100).alias("y"))
    found = tracks.turn_stations(laps)
    return found.select("lap", F.round("d", 3).alias("d"), F.round("turn", 3).alias("turn"))


@query("o6_17_parallel_runs", """with i as (select track_id, pos * 10.0e0 + event_id % 7 as a, pos * 10.0e0 + event_id % 7 + 4 + event_id % 9 as b from fx_track_pt where ele > 40),
m as (select *, max(b) over (partition by track_id order by a, b rows between unbounded preceding and 1 preceding) as reach from i),
r as (select *, sum(case when reach is null or a > reach + 2 then 1 else 0 end) over (partition by track_id order by a, b rows unbounded preceding) as run from m)
select track_id, min(a) as a, max(b) as b, count(*) as n from r group by track_id, run having max(b) - min(a) >= 15""")
def parallel_runs(t):
    a = F.col("pos") * 10.0 + F.col("event_id") % 7
    i = t("fx_track_pt").where("ele > 40").select("track_id", a.alias("a"), (a + 4 + F.col("event_id") % 9).alias("b"))
    return tracks.merged_intervals(i, "track_id", 2.0, 15.0)


KERNEL = {-1: 0.25, 0: 0.5, 1: 0.25}


@query("o6_18_dem_gradient", f"""with {DEM}, k as (select unnest([-1, 0, 1]) as o), w as (select o, case o when 0 then 0.5 else 0.25 end as w from k),
h as (select d.tile, d.r, d.c, sum(w * e.z) / sum(w) as z from dem d join w on true join dem e on e.tile = d.tile and e.r = d.r and e.c = d.c + o group by 1, 2, 3),
s as (select d.tile, d.r, d.c, sum(w * e.z) / sum(w) as z from h d join w on true join h e on e.tile = d.tile and e.c = d.c and e.r = d.r + o group by 1, 2, 3)
select tile, r as row, c as col, round(z, 6) as z, round((lead(z) over (partition by tile, r order by c) - lag(z) over (partition by tile, r order by c)) / 2, 6) as gx, round((lead(z) over (partition by tile, c order by r) - lag(z) over (partition by tile, c order by r)) / 2, 6) as gy from s""")
def dem_gradient(t):
    s = gradient(smoothed(dem(t), KERNEL))
    return s.select("tile", "row", "col", F.round("z", 6).alias("z"), F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy"))


@query("o6_19_cut_edges", f"""with {LEG}, mark as (select track_id, event_id as cut_id, lon + case when pos % 20 = 0 then 0.01 else 0.00001 end as lon, lat from fx_track_pt where pos % 10 = 0),
l as (select m.track_id, cut_id, d0, d1, radians(x0 - lon) * 6371008.8 * cos(radians(lat)) as ax, radians(y0 - lat) * 6371008.8 as ay, radians(x1 - lon) * 6371008.8 * cos(radians(lat)) as bx, radians(y1 - lat) * 6371008.8 as byy from mark m join leg g on g.track_id = m.track_id),
f as (select *, least(1.0, greatest(0.0, (-ax * (bx - ax) - ay * (byy - ay)) / nullif((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay), 0))) as f from l),
d as (select track_id, cut_id, d0 + coalesce(f, 0) * (d1 - d0) as along, sqrt(power(ax + coalesce(f, 0) * (bx - ax), 2) + power(ay + coalesce(f, 0) * (byy - ay), 2)) as off from f),
p as (select track_id, cut_id, arg_min(along, (round(off, 6), along)) as d, min(round(off, 6)) as off from d group by 1, 2),
ends as (select track_id, min(d0) as a, max(d1) as b from leg group by 1),
c as (select track_id, d, min(cut_id) as cut_id from (select track_id, d, cut_id from p where off <= 5 union all select track_id, a, null from ends union all select track_id, b, null from ends) q group by 1, 2),
e as (select track_id, d as from_m, cut_id as from_cut, lead(d) over w as to_m, lead(cut_id) over w as to_cut from c window w as (partition by track_id order by d))
select e.track_id, round(from_m, 2) as from_m, round(to_m, 2) as to_m, from_cut, to_cut, (select count(*) from leg g where g.track_id = e.track_id and g.d0 > e.from_m + 0.001 and g.d0 < e.to_m - 0.001) as vertices from e where to_m is not null""")
def cut_edges(t):
    """Tracks cut at points beside every tenth vertex; every other one lies too far away."""
    cuts = t("fx_track_pt").where("pos % 10 = 0").select("track_id", F.col("event_id").alias("cut_id"), (F.col("lon") + F.when(F.col("pos") % 20 == 0, 0.01).otherwise(0.00001)).alias("lon"), "lat")
    e = tracks.cut_edges(tracks.legs_of(chained(t)), cuts, 5.0)
    return e.select("track_id", F.round("from_m", 2).alias("from_m"), F.round("to_m", 2).alias("to_m"), "from_cut", "to_cut", "vertices")


@query("o6_20_named_sections", """with w as (select l_orderkey as course, l_linenumber as n, l_partkey, l_quantity as m, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos from lineitem),
c as (select *, coalesce(sum(m) over (partition by course order by pos rows between unbounded preceding and 1 preceding), 0) as start_m from w)
select course, pos, l_partkey as name, start_m, start_m + m as end_m from c where l_partkey not in (select p_partkey from part where p_size < 10)""")
def named_sections(t):
    w = t("lineitem").withColumnsRenamed({"l_orderkey": "course", "l_quantity": "m"})
    c = tracks.sections(w, "course", ["l_linenumber", "l_partkey", "l_suppkey", "m", "l_extendedprice"], "m")
    generic = t("part").where("p_size < 10")
    return c.join(generic, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("course", "pos", F.col("l_partkey").alias("name"), "start_m", "end_m")


BUDGET = """with recursive g as (select layer, pen, source_ref // 40 as sheet, stroke_id, length_mm, row_number() over (partition by layer, pen, source_ref // 40 order by length_mm desc, stroke_id) as r from fx_stroke where length_mm >= 5),
walk as (select layer, pen, sheet, stroke_id, r, length_mm as used, true as kept from g where r = 1 union all
select g.layer, g.pen, g.sheet, g.stroke_id, g.r, case when w.used + g.length_mm <= 200 then w.used + g.length_mm else w.used end, w.used + g.length_mm <= 200 from walk w join g on g.layer = w.layer and g.pen = w.pen and g.sheet = w.sheet and g.r = w.r + 1)
select layer, pen, sheet, stroke_id from walk where kept"""


@query("o7_2_length_budget", BUDGET)
def length_budget(t):
    s = t("fx_stroke").withColumn("sheet", F.floor(F.col("source_ref") / 40))
    return select.within_budget(s, ["layer", "pen", "sheet"], "stroke_id", "length_mm", 200.0, 5.0)


@query("o7_3_detail_budget", """with recursive k as (select source_ref // 100 as sheet, case layer when 'A' then 'local' when 'N' then 'service' else 'path' end as category, source_ref, sum(length_mm) as length, source_ref % 60 as distance, source_ref % 3 = 0 as named, case source_ref % 4 when 0 then 'cycleway' when 1 then 'pedestrian' else 'track' end as highway, max(case when pen = 'O' and source_ref % 25 = 0 then 1 else 0 end) = 1 as bridge from fx_stroke group by 1, 2, 3, layer),
s as (select *, length * (1.25 - 0.25 * least(distance / 60.0e0, 1.0)) * case when named then 1.15 else 1.0 end * case when category = 'path' and highway in ('cycleway', 'pedestrian') then 1.20 else 1.0 end * case when bridge then 10.0 else 1.0 end as score,
 case category when 'local' then 0.0715 when 'service' then 0.0163 else 0.0358 end * 20000.0e0 as budget from k where length >= case category when 'local' then 0.8 else 1.0 end),
g as (select *, row_number() over (partition by sheet, category order by score desc, source_ref) as r from s),
walk as (select sheet, category, source_ref, r, length as used, true as kept from g where r = 1 union all
select g.sheet, g.category, g.source_ref, g.r, case when w.used + g.length <= g.budget then w.used + g.length else w.used end, w.used + g.length <= g.budget from walk w join g on g.sheet = w.sheet and g.category = w.category and g.r = w.r + 1)
select sheet, category, source_ref from walk where kept""")
def detail_budget(t):
    ref = F.col("source_ref")
    category = F.when(F.col("layer") == "A", "local").when(F.col("layer") == "N", "service").otherwise("path")
    k = t.plain_strokes().groupBy(F.floor(ref / 100).alias("sheet"), category.alias("category"), "source_ref").agg(F.sum("length_mm").alias("length"), F.bool_or((F.col("pen") == "O") & (ref % 25 == 0)).alias("bridge"))
    highway = F.when(ref % 4 == 0, "cycleway").when(ref % 4 == 1, "pedestrian").otherwise("track")
    score = select.detail_score(F.col("category"), F.col("length"), (ref % 60).cast("double"), F.lit(60.0), ref % 3 == 0, highway, F.col("bridge"))
    return select.detail_budget(k.withColumn("score", score), "sheet", "category", "source_ref", "length", "score", 20000.0)


@query("o7_5_kind_caps", """with r as (select *, row_number() over (partition by kind order by priority, distance_m, id) as place from fx_candidate), a as (select kind, count(*) as before from fx_candidate group by 1)
select r.kind, r.id, cast(place as integer) as place, before from r join a on a.kind = r.kind where place <= 5""")
def kind_caps(t):
    counts = t("fx_candidate").groupBy("kind").agg(F.count("*").alias("before"))
    return select.top_of_each(t("fx_candidate"), ["kind"], ["priority", "distance_m", "id"], 5).join(F.broadcast(counts), "kind").select("kind", "id", "place", "before")


@query("o7_6_density_cut", """with s as (select *, layer = 'A' as protected from fx_stroke), g as (select *, sum(length_mm) over (partition by pen, source_ref // 50) as total, coalesce(sum(case when protected then 0 else length_mm end) over (partition by pen, source_ref // 50 order by layer desc, length_mm, stroke_id rows between unbounded preceding and 1 preceding), 0) as gone from s)
select stroke_id, protected or total - gone <= 400 as kept from g""")
def density_cut(t):
    s = t("fx_stroke").withColumn("sheet", F.floor(F.col("source_ref") / 50))
    return select.cut_to_budget(s, ["pen", "sheet"], [F.desc("layer"), "length_mm", "stroke_id"], "length_mm", 400.0, F.col("layer") == "A").select("stroke_id", "kept")


@query("o7_7_contour_rotation", """with c as (select p_partkey as id, p_size as level, p_retailprice as length_mm, p_partkey % 3 as band from part where p_retailprice >= 950),
r as (select *, row_number() over (partition by level, band order by length_mm desc, id) as turn from c), k as (select *, row_number() over (partition by level order by turn, band) as place from r)
select level, id, cast(place as integer) as place from k where place <= 6""")
def contour_rotation(t):
    c = t("part").where("p_retailprice >= 950").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("level"), F.col("p_retailprice").alias("length_mm"), (F.col("p_partkey") % 3).alias("band"))
    turn = c.withColumn("turn", F.row_number().over(Window.partitionBy("level", "band").orderBy(F.desc("length_mm"), "id")))
    return select.top_of_each(turn, ["level"], ["turn", "band"], 6).select("level", "id", "place")


@query("o7_8_class_quota", """with q as (select *, id % 97 = 0 as required, row_number() over (partition by kind, priority // 10 order by distance_m, id) <= 2 as inside from fx_candidate), r as (select *, row_number() over (partition by kind order by required desc, inside desc, distance_m, id) as place from q)
select kind, id, cast(place as integer) as place from r where place <= 12""")
def class_quota(t):
    c = t("fx_candidate").withColumn("tier", F.floor(F.col("priority") / 10))
    return select.tier_quota(c, ["kind"], "tier", 2, ["distance_m", "id"], 12, F.col("id") % 97 == 0).select("kind", "id", "place")


@query("o7_9_plot_metrics", f"""with {PLANE}, l as (select *, lag(x1) over (partition by line_id order by pos desc) as ex, lag(y1) over (partition by line_id order by pos desc) as ey from line)
select line_id, round(sum(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))), 5) as down, round(sum(coalesce(sqrt(power(x0 - ex, 2) + power(y0 - ey, 2)), 0)), 5) as up, cast(sum(case when ex is not null and (ex <> x0 or ey <> y0) then 1 else 0 end) as bigint) as lifts from l group by 1""")
def plot_metrics(t):
    return coverage.plot_metrics(plane(t), [F.desc("pos")]).withColumns({"down": F.round("down", 5), "up": F.round("up", 5)})
