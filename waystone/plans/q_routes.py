"""Queries of coverage, clipping, budgets and routing that put several operators together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waystone.functions import tags
from waystone.operators import coverage, covers, graph, paths, select, tracks
from waystone.plans.q_graph import net_edges
from waystone.plans.q_joins import PLANE, RING, lines, plane, rings, seg_dist, side
from waystone.plans.registry import query
from waystone.sources import readers


@query("o1_20_ranking_seeds", "select o_orderkey as subject_id, 'r' || (o_orderkey % 5) as ranking, cast(o_orderkey % 90 as integer) as rank, case when o_orderkey % 3 <> 0 then o_totalprice end as score from orders where o_orderkey % 90 <> 0 and o_orderkey % 17 <> 0")
def ranking_seeds(t):
    k = F.col("o_orderkey")
    subject = F.when(k % 17 == 0, "nobody").otherwise(k.cast("string"))
    line = F.concat_ws(",", subject, F.concat(F.lit("r"), (k % 5).cast("string")), (k % 90).cast("string"), F.when(k % 3 != 0, F.col("o_totalprice").cast("string")).otherwise(""))
    return readers.ranking_rows(t("orders").select(line.alias("value")))[0]


@query("o2_23_without_selection_edges", """with p as (select track_id, pos, case when pos % 7 in (2, 3, 4) then -3.0e0 else lon end as x, lat as y from fx_track_pt), s as (select *, lead(x) over (partition by track_id order by pos) as x1 from p),
k as (select *, case when x = -3.0e0 and x1 = -3.0e0 then 1 else 0 end as edge from s where x1 is not null), r as (select *, sum(edge) over (partition by track_id order by pos rows unbounded preceding) as run from k)
select track_id, min(pos) as first_pos, count(*) as segments from r where edge = 0 group by track_id, run""")
def without_selection_edges(t):
    by = Window.partitionBy("track_id").orderBy("pos")
    p = t("fx_track_pt").select("track_id", "pos", F.when(F.col("pos") % 7 >= 2, F.when(F.col("pos") % 7 <= 4, -3.0)).alias("e"), "lon").withColumn("x", F.coalesce("e", "lon"))
    s = p.withColumn("x1", F.lead("x").over(by)).where("x1 is not null")
    on_edge = (F.col("x") == -3.0) & (F.col("x1") == -3.0)
    runs = tracks.islands(s.withColumn("edge", on_edge), F.col("edge"), ["track_id"], ["pos"], "run").where("not edge")
    return runs.groupBy("track_id", "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("segments")).drop("run")


SAMPLES = "sm as (select line_id, pos * 4 + k as step, x0 + (x1 - x0) * k / 4.0 as x, y0 + (y1 - y0) * k / 4.0 as y from line, (select unnest(range(0, 4)) as k) q)"


@query("o4_20_uncovered_runs", f"""with {RING}, {SAMPLES},
c as (select s.line_id, step, coalesce(sum(case when (r.y1 > y) <> (r.y0 > y) and x < (r.x1 - r.x0) * (y - r.y0) / nullif(r.y1 - r.y0, 0) + r.x0 then 1 else 0 end), 0) % 2 = 1 or coalesce(min({seg_dist('x', 'y', 'r.x0', 'r.y0', 'r.x1', 'r.y1')}) <= 0.2, false) as covered from sm s left join ring r on r.ring_id = s.line_id + 1 group by 1, 2),
r as (select *, sum(case when covered then 1 else 0 end) over (partition by line_id order by step rows unbounded preceding) as run from c)
select line_id, min(step) as first, max(step) as last, count(*) as points from r where not covered group by line_id, run having count(*) >= 2""")
def uncovered_runs(t):
    """What of each line lies outside the next line's ring, sampled four times a leg, with a buffer."""
    samples = coverage.sampled(plane(t)).where("k < 4").select("line_id", (F.col("pos") * 4 + F.col("k")).alias("at"), "x", "y", (F.col("line_id") + 1).alias("ring_id"))
    covered = coverage.inside_rings(samples, rings(t), ["line_id", "at"], 0.2).withColumnRenamed("inside", "covered")
    return coverage.uncovered_runs(covered)


#: Where every line is cut by the edges of each third line's ring of its row, what lies between two cuts, and which of it is inside.
CUTS = f"""{RING}, lg as (select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as m from line), ms as (select *, coalesce(sum(m) over (partition by line_id order by pos rows between unbounded preceding and 1 preceding), 0) as d0 from lg),
pr as (select l.line_id, l.pos, l.x0, l.y0, l.x1, l.y1, r.ring_id, r.x0 as rx0, r.y0 as ry0, r.x1 as rx1, r.y1 as ry1, (l.x1 - l.x0) * (r.y1 - r.y0) - (l.y1 - l.y0) * (r.x1 - r.x0) as turn
 from ms l join ring r on r.rel = floor(l.line_id / 10) and r.ring_id % 3 = 0 and r.ring_id <> l.line_id),
ct as (select line_id, pos, ring_id, ((rx0 - x0) * (ry1 - ry0) - (ry0 - y0) * (rx1 - rx0)) / turn as t, ((rx0 - x0) * (y1 - y0) - (ry0 - y0) * (x1 - x0)) / turn as u from pr where turn <> 0),
br as (select line_id, pos, ring_id, t from ct where u between 0 and 1 and t > 0 and t < 1 union all select distinct line_id, pos, ring_id, unnest([0.0e0, 1.0e0]) from pr),
iv as (select * from (select line_id, pos, ring_id, t as t0, lead(t) over (partition by line_id, pos, ring_id order by t) as t1 from br) q where t1 - t0 > 1e-12),
md as (select i.*, x0 + (t0 + t1) / 2 * (x1 - x0) as x, y0 + (t0 + t1) / 2 * (y1 - y0) as y, d0 + t0 * m as s, d0 + t1 * m as e from iv i join ms using (line_id, pos)),
cv as (select i.line_id, i.s, i.e from md i join ring r on r.ring_id = i.ring_id group by i.line_id, i.pos, i.ring_id, i.t0, i.s, i.e having sum(case when (r.y1 > y) <> (r.y0 > y) and x < (r.x1 - r.x0) * (y - r.y0) / nullif(r.y1 - r.y0, 0) + r.x0 then 1 else 0 end) % 2 = 1)"""


def third_rings(t):
    """Parts of all lines inside the ring of every third line, its own excepted, and the measured lines."""
    legs = covers.measured(plane(t))
    return covers.stretches(covers.inside_parts(legs, rings(t).where("ring_id % 3 = 0"), 8.0, other=True), legs), legs


@query("o4_20_visible_stretches", f"""with {CUTS}, ev as (select line_id, s, e from cv union all select line_id, max(d0 + m), max(d0 + m) from ms group by 1),
g as (select line_id, s, coalesce(max(e) over (partition by line_id order by s, e rows between unbounded preceding and 1 preceding), 0) as start from ev)
select line_id, cast(row_number() over (partition by line_id order by start) as integer) as part, round(start, 5) as s, round(s, 5) as e from g where s - start > 1e-6""")
def visible_stretches(t):
    """What each line shows outside the rings, exact and in order along it."""
    return covers.visible(*third_rings(t)).select("line_id", "part", F.round("s", 5).alias("s"), F.round("e", 5).alias("e"))


@query("o4_20_suppressed_length", f"""with {CUTS}, o as (select *, row_number() over (partition by line_id order by s, e) as k, max(e) over (partition by line_id order by s, e rows between unbounded preceding and 1 preceding) as far from cv),
c as (select line_id, sum(greatest(0, e - greatest(s, coalesce(far, s)))) as covered from o group by 1), w as (select line_id, sum(m) as length from ms group by 1)
select line_id, round(length, 5) as length, round(length - coalesce(covered, 0), 5) as shown, round(coalesce(covered, 0), 5) as covered from w left join c using (line_id)""")
def suppressed_length(t):
    """How much of each line the rings cover, counted once where they overlap."""
    return covers.suppressed(*third_rings(t)).select("line_id", *[F.round(c, 5).alias(c) for c in ("length", "shown", "covered")])


@query("o4_20_flanked_stretches")
def flanked_stretches(t):
    """Every fifth line as a river, the others as banks; held against a plain channel in tests."""
    p = plane(t)
    river = covers.measured(p.where("line_id % 5 = 0"))
    found = covers.flanked_stretches(river, p.where("line_id % 5 <> 0"), 2.0, 8.0)
    return found.select("line_id", F.round("s", 5).alias("s"), F.round("e", 5).alias("e"))


@query("o4_18_thinned_lines")
def thinned_lines(t):
    """Longest first, lines that run along kept ones for half their length go; held against plain Python."""
    return covers.thinned(plane(t).drop("ox"), 0.15, 0.5, 4.0).select("line_id", F.round("length", 6).alias("length"), "dropped")


@query("o4_24_host_roads")
def host_roads(t):
    """Lines most of which lie along their reference are dropped: the line 50 further."""
    p = lines(t)
    shares = coverage.parallel_share(p, p.withColumn("line_id", F.col("line_id") - 50), 0.8, 4.0)
    return coverage.redundant(shares, 0.5)


@query("o4_26_features_in_boundary", f"""with {RING}, ft as (select * from line where line_id % 10 <> 9 and line_id % 7 <> 3 union all select line_id, pos, ox, x0 + 500, y0, x1 + 500, y1 from line where line_id % 7 = 3),
vx as (select line_id, pos, x0 as x, y0 as y from ft union all select line_id, max(pos) + 1, arg_max(x1, pos), arg_max(y1, pos) from ft group by 1),
i as (select v.line_id, v.pos, coalesce(sum(case when (r.y1 > y) <> (r.y0 > y) and x < (r.x1 - r.x0) * (y - r.y0) / nullif(r.y1 - r.y0, 0) + r.x0 then 1 else 0 end), 0) % 2 = 1 or coalesce(min({seg_dist('x', 'y', 'r.x0', 'r.y0', 'r.x1', 'r.y1')}) <= 0.3, false) as inside from vx v left join ring r on r.ring_id = v.line_id + 1 group by 1, 2),
a as (select line_id, cast(sum(case when inside then 1 else 0 end) as bigint) as n from i group by 1),
x as (select a.line_id, cast(sum(case when {side('a', 'b', 'x0', 'y0')} * {side('a', 'b', 'x1', 'y1')} < 0 and {side('b', 'a', 'x0', 'y0')} * {side('b', 'a', 'x1', 'y1')} < 0 then 1 else 0 end) as bigint) as n from ft a join ring b on b.ring_id = a.line_id + 1 group by 1)
select a.line_id, a.n as vertices_inside, coalesce(x.n, 0) as crossings from a left join x on x.line_id = a.line_id where a.n > 0 or x.n > 0""")
def features_in_boundary(t):
    """Each line against the next line's ring, every seventh moved away."""
    p = plane(t).where("line_id % 10 <> 9 or line_id % 7 = 3")
    far = F.when(F.col("line_id") % 7 == 3, 500.0).otherwise(0.0)
    legs = p.select("line_id", "pos", (F.col("x0") + far).alias("x0"), "y0", (F.col("x1") + far).alias("x1"), "y1", (F.col("line_id") + 1).alias("ring_id"))
    return coverage.features_in_boundary(legs, rings(t), 0.3)


@query("o4_27_landcover_selection", f"""with {PLANE}, o as (select way_id, case when nature = 'wood' or landuse = 'forest' then 'wood' when leisure = 'park' then 'park' when waterway = 'river' then 'river' when nature = 'coastline' and coalesce(waterway, '') <> 'riverbank' and coalesce(landuse, '') <> 'reservoir' then 'coast' end as class, abs(length_mm - 3) as distance from fx_tagged),
d as (select line_id, x0, y0, x1, y1, x1 - x0 as dx, y1 - y0 as dy, ox from line),
q as (select *, greatest(0.0, case when dx > 0 then (ox + 1 - x0) / dx end, case when dx < 0 then (ox + 9 - x0) / dx end, case when dy > 0 then (1 - y0) / dy end, case when dy < 0 then (9 - y0) / dy end) as t0,
 least(1.0, case when dx > 0 then (ox + 9 - x0) / dx end, case when dx < 0 then (ox + 1 - x0) / dx end, case when dy > 0 then (9 - y0) / dy end, case when dy < 0 then (1 - y0) / dy end) as t1,
 (dx = 0 and (x0 < ox + 1 or x0 > ox + 9)) or (dy = 0 and (y0 < 1 or y0 > 9)) as off from d),
l as (select line_id, sum(sqrt(dx * dx + dy * dy) * (t1 - t0)) as length from q where not off and t0 <= t1 group by 1 having sum(sqrt(dx * dx + dy * dy) * (t1 - t0)) > 0),
m as (select class, line_id, length, row_number() over (partition by class order by distance, length desc, line_id) as place from l join o on o.way_id = l.line_id where length >= case class when 'wood' then 150 when 'park' then 100 when 'coast' then 10 when 'river' then 50 end and distance <= 2.5)
select class, line_id, round(length, 5) as length, cast(place as integer) as place from m where place <= 20""")
def landcover_selection(t):
    """Wood, parks, coasts and rivers: the plane's lines clipped to a frame, by class, length and distance."""
    few = F.create_map(F.lit("natural"), F.col("nature"), F.lit("landuse"), F.col("landuse"), F.lit("leisure"), F.col("leisure"), F.lit("waterway"), F.col("waterway"))
    x = t("fx_tagged").select("way_id", few.alias("tags"), F.abs(F.col("length_mm") - 3).alias("distance"))
    water = tags.water_class(F.col("tags"))
    kind = F.coalesce(tags.landcover_class(F.col("tags")), F.when(water == "coast", "coast"), F.when(water == "river", "river"))
    objects = x.select(F.col("way_id").alias("line_id"), kind.alias("class"), "distance").where("class is not null")
    own = plane(t).withColumns({"x0": F.col("x0") - F.col("ox"), "x1": F.col("x1") - F.col("ox")})
    found = coverage.route_context(objects, own, (1.0, 1.0, 9.0, 9.0), {"wood": 150.0, "park": 100.0, "coast": 10.0, "river": 50.0}, 2.5, 20)
    return found.withColumn("length", F.round("length", 5))


@query("o7_4_ink_selection")
def ink_selection(t):
    g = t.plain_strokes().groupBy(F.floor(F.col("source_ref") / 40).alias("plate"), "layer", F.col("source_ref").alias("group_id")).agg(F.sum("length_mm").alias("ink"), F.count("*").alias("rank"))
    one = g.withColumn("group_key", F.concat_ws("/", "layer", F.col("group_id").cast("string")))
    return select.ink_selection(one, "plate", "layer", "group_key", "rank", "ink", 500.0, 0.2)


@query("o7_4_ink_phases")
def ink_phases(t):
    """Seeds, reserves, roads, context and late ink of each plate, orders of nine tiles; held against a plain loop."""
    kind = F.concat("layer", "pen")
    g = t.plain_strokes().groupBy(F.floor(F.col("source_ref") / 40).alias("plate"), kind.alias("layer"), F.col("source_ref").alias("group_id")).agg(F.sum("length_mm").alias("ink"), F.count("*").alias("rank"))
    one = g.withColumn("group_key", F.concat_ws("/", "layer", F.col("group_id").cast("string"))).withColumn("tile", F.col("group_id") % 9)
    return select.ink_phases(one, "plate", "layer", "group_key", "ink", "rank", "tile", 900.0, {"AF": 200.0, "NO": 150.0, "RF": 100.0}, ["AF"], ["NO", "NF"])


@query("o8_20_oriented_ways")
def oriented_ways(t):
    m = t("fx_rel_member").select(F.col("relation_id").alias("relation"), "pos", F.col("way_id").alias("way"), (F.col("way_id") % 40).alias("a"), ((F.col("way_id") * 3 + F.col("pos")) % 40).alias("b"))
    at = lambda c: ((F.col(c) * 13) % 17).cast("double")
    m = m.withColumns({"xa": at("a"), "ya": at("a") / 2, "xb": at("b"), "yb": at("b") / 2})
    by = Window.partitionBy("relation").orderBy("pos")
    snaps = m.withColumn("before", F.lag("way").over(by)).where("before % 3 = 0").select("before", "way").distinct()
    return graph.oriented(m, snaps, 6.0)


@query("o8_21_corridor_legs")
def corridor_legs(t):
    """Each way's way over the net between its ends, which lie a little beside their nodes; tests hold it against plain Python."""
    e = net_edges(t)
    at = lambda c: (((F.col(c) * 7919) % 10000) / 10000.0, ((F.col(c) * 104729) % 10000) / 10000.0)
    (xa, ya), (xb, yb) = at("a"), at("b")
    measured = e.select((F.col("way_id") * 10000 + F.col("pos")).alias("edge"), "a", "b", F.hypot(xa - xb, ya - yb).alias("m"))
    x, y = at("id")
    nodes = measured.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", x.alias("x"), y.alias("y"))
    legs = e.groupBy(F.col("way_id").alias("query")).agg(F.min_by("a", "pos").alias("s"), F.max_by("b", "pos").alias("t"))
    (sx, sy), (tx, ty) = at("s"), at("t")
    off = F.when(F.col("query") % 50 == 0, 9.0).otherwise(1e-7)
    legs = legs.select("query", (sx + off).alias("sx"), sy.alias("sy"), tx.alias("tx"), (ty - 1e-7).alias("ty"))
    found = paths.corridor_legs(paths.one_of_parallel(measured), nodes, legs, 1.8, 1e-6)
    return found.select("query", F.round("m", 6).alias("m"), "paths", "status")
