"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from waystone.operators import coverage, reconcile, rollups, terrain
from waystone.operators.audit import findings
from waystone.plans.q_graph import EDGE, edges
from waystone.plans.q_joins import DEM, PLANE, dem, plane, seg_dist
from waystone.plans.registry import query


@query("o5_2_course_lengths", """with p as (select o_custkey as course, o_orderstatus as part, sum(o_totalprice) as m from orders group by 1, 2), c as (select course, sum(m) as measured, max(m) as largest, count(*) as parts from p group by 1)
select course, round(measured, 2) as measured_m, parts, round(largest / measured, 6) as largest_share, case when measured < 1000000 * 0.99 then 'too-short' when measured > 1000000 * 1.03 then 'too-long' else 'accepted' end as verdict from c""")
def course_lengths(t):
    p = t("orders").groupBy(F.col("o_custkey").alias("course"), "o_orderstatus").agg(F.sum("o_totalprice").alias("m"))
    c = rollups.course_parts(p, "course", "m", 1000000.0, 0.01, 0.03)
    return c.select("course", F.round("measured_m", 2).alias("measured_m"), "parts", F.round("largest_share", 6).alias("largest_share"), "verdict")


@query("o5_4_timing_inventory", """with c as (select user_id as trip, event_type as stop, value, row_number() over (partition by user_id order by ts, event_id) as n, count(*) over (partition by user_id) as last from events)
select stop, count(*) as occurrences, cast(sum(case when value is null or value < 20 then 1 else 0 end) as bigint) as passes, cast(sum(case when n = 1 or n = last then 1 else 0 end) as bigint) as endpoints, count(distinct trip) as schedules from c group by 1""")
def timing_inventory(t):
    calls = t("events").withColumnsRenamed({"user_id": "trip", "event_type": "stop"})
    return rollups.timing_inventory(calls, "trip", ["ts", "event_id"], "stop", F.col("value").isNull() | (F.col("value") < 20))


@query("o5_5_operator_summary", f"""with {EDGE}, e as (select way_id % 12 as operator, way_id, least(a, b) as p, greatest(a, b) as q, pos from edge where b is not null and a <> b)
select operator, count(distinct way_id) as relations, count(*) as resolved, count(distinct (p, q)) as unique_edges from e group by 1""")
def operator_summary(t):
    return rollups.operator_summary(edges(t).withColumn("operator", F.col("way_id") % 12), "operator", "way_id")


@query("o5_6_stroke_groups", "select source_ref as group_id, count(*) as strokes, sum(length_mm) as length_mm, sum(length_mm * case pen when 'O' then 0.3 else 0.5 end) as ink, max(stroke_id) as last, string_agg(distinct layer, ',' order by layer) as layers, max(case when layer = 'A' then 1 else 0 end) = 1 as has_a from fx_stroke group by 1")
def stroke_groups(t):
    nib = F.when(F.col("pen") == "O", 0.3).otherwise(0.5)
    return rollups.ink_groups(t("fx_stroke"), "source_ref", nib, F.col("layer") == "A").withColumnsRenamed({"source_ref": "group_id", "flagged": "has_a"})


@query("o5_7_layer_summaries", """select layer, cast(sum(case when length_mm >= 25 then 1 else 0 end) as bigint) as retained, cast(sum(case when length_mm < 25 then 1 else 0 end) as bigint) as omitted, sum(case when length_mm >= 25 then length_mm else 0 end) as retained_mm, round(sum(case when length_mm >= 25 then length_mm else 0 end) / nullif(sum(length_mm), 0), 8) as ratio from fx_stroke group by 1""")
def layer_summaries(t):
    return rollups.retained(t.plain_strokes(), "layer", "length_mm", F.col("length_mm") >= 25).withColumn("ratio", F.round("ratio", 8))


@query("o5_8_occupancy", f"""with {PLANE}, c as (select line_id, floor(((x0 - ox) + (x1 - ox)) / 2) as cx, floor((y0 + y1) / 2) as cy, sum(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))) as ink from line group by 1, 2, 3)
select line_id, count(*) as cells, count(distinct cx) as columns, count(distinct cy) as rows, cast(greatest(min(cx), 9 - max(cx), min(cy), 9 - max(cy)) as bigint) as empty_border from c where ink >= 12 and cx between 0 and 9 and cy between 0 and 9 group by 1""")
def occupancy(t):
    own = plane(t).withColumns({"x0": F.col("x0") - F.col("ox"), "x1": F.col("x1") - F.col("ox")})
    return coverage.occupancy(own, 1.0, 12.0, 10, 10)


@query("o5_9_terrain_density", f"with {DEM} select tile, count(distinct round(z)) as levels, count(*) as paths, round(sum(abs(z)) / 64, 6) as density from dem group by 1")
def terrain_density(t):
    return rollups.terrain_density(dem(t)).withColumn("density", F.round("density", 6))


@query("o5_10_contour_levels", f"""with {DEM}, p as (select tile, quantile_cont(z, 0.02) as lo, quantile_cont(z, 0.98) as hi from dem group by 1),
s as (select *, (select min(i) from (select unnest([5, 10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000]) as i) x where i >= greatest((hi - lo) / 12, 5.0)) as step from p)
select tile, cast(case when ceil(lo / step) * step <= floor(hi / step) * step then ceil(lo / step) * step else round_even((lo + hi) / 2, 0) end as bigint) as first_level, cast(case when ceil(lo / step) * step <= floor(hi / step) * step then floor((floor(hi / step) - ceil(lo / step))) + 1 else 1 end as integer) as n from s""")
def contour_levels(t):
    return terrain.level_plan(dem(t), most=10_000).select("tile", F.element_at("levels", 1).alias("first_level"), F.size("levels").alias("n"))


@query("o5_11_name_centroid", "select p_name as name, round(avg(lon), 9) as lon, round(avg(lat), 9) as lat, count(*) as n from fx_node join part on p_partkey = node_id group by 1")
def name_centroid(t):
    named = t("fx_node").join(t("part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name")), "node_id")
    return rollups.name_centroid(named, "name").withColumns({"lon": F.round("lon", 9), "lat": F.round("lat", 9)})


@query("o5_12_stop_patterns", """with c as (select conv_id as trip, turn, role, lag(role) over (partition by conv_id order by turn) as before from conversations), p as (select trip, string_agg(role, '>' order by turn) as pattern from c where before is null or before <> role group by 1)
select pattern, count(*) as trips, min(trip) as first_trip from p group by 1""")
def stop_patterns(t):
    return rollups.stop_patterns(t("conversations"), "conv_id", "turn", "role")


@query("o5_13_cohort_counts", "with w as (select n_name as cohort, n_nationkey * 3 as expected from nation), h as (select n_name as cohort, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1) select w.cohort, coalesce(n, 0) as n, expected, coalesce(n, 0) >= expected as enough from w full outer join h using (cohort)")
def cohort_counts(t):
    want = t("nation").select("n_nationkey", F.col("n_name").alias("cohort"), (F.col("n_nationkey") * 3).alias("expected"))
    return rollups.cohort_counts(want, t("customer").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "cohort")


@query("o5_14_exclusions", "select coalesce(o_orderpriority, '-') as reason, coalesce(o_orderstatus, '-') as operator, count(*) as n from orders where o_totalprice < 100000 group by cube (o_orderpriority, o_orderstatus)")
def exclusions(t):
    return rollups.cubed(t("orders").where("o_totalprice < 100000"), {"o_orderpriority": "reason", "o_orderstatus": "operator"})


@query("o5_16_path_tags", "with p as (select l_orderkey % 50 as path, l_returnflag as service, l_partkey as edge from lineitem) select path, service, count(*) as edges, count(distinct edge) as distinct_edges, cast(sum(case when edge % 9 = 0 then 1 else 0 end) as bigint) as ineligible from p group by 1, 2")
def path_tags(t):
    p = t("lineitem").select((F.col("l_orderkey") % 50).alias("path"), F.col("l_returnflag").alias("service"), F.col("l_partkey").alias("edge"))
    return rollups.path_services(p, "path", "service", "edge", F.col("edge") % 9 == 0)


@query("o5_17_resolution_report", "select layer, max(case pen when 'O' then 0.3 else 0.5 end) as nib, min(length_mm) as least_mm, max(length_mm) * 25.0 as ground_m, string_agg(distinct pen, ',' order by pen) as pens from fx_stroke group by 1")
def resolution_report(t):
    return rollups.resolution(t.plain_strokes(), "layer", "pen", F.when(F.col("pen") == "O", 0.3).otherwise(0.5), 25.0)


@query("o5_19_geometry_findings", """select reason, count(*) as n from (select unnest(list_filter([case when ele is null then 'missing-elevation' end, case when lon < -2.9 then 'west-edge' end, case when lat > 53.5 then 'north-edge' end], lambda x: x is not null)) as reason from fx_track_pt) x group by 1""")
def geometry_findings(t):
    found = findings(t("fx_track_pt"), ["track_id", "pos"], {"missing-elevation": F.col("ele").isNull(), "west-edge": F.col("lon") < -2.9, "north-edge": F.col("lat") > 53.5})
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query("o5_20_coverage_evidence", "select track_id % 25 as subject, min(lon) as west, max(lon) as east, min(lon) > -3.0e0 + (track_id % 25) * 0.1e0 as gap_west, max(lon) < -0.4e0 + (track_id % 25) * 0.1e0 as gap_east from fx_track_pt group by 1")
def coverage_evidence(t):
    s = F.col("subject")
    return rollups.coverage_gaps(t("fx_track_pt"), F.col("track_id") % 25, -3 + s * 0.1, -0.4 + s * 0.1)


@query("o5_21_release_rollup", "select o_custkey as artifact, count(*) as gates, cast(sum(case when o_totalprice < 20000 then 1 else 0 end) as bigint) as failed, coalesce(string_agg(case when o_totalprice < 20000 then 'gate-' || o_orderkey end, ';' order by o_orderkey), '') as failures from orders group by 1")
def release_rollup(t):
    name = F.concat(F.lit("gate-"), F.col("o_orderkey").cast("string"))
    return rollups.gates(t("orders").withColumnRenamed("o_custkey", "artifact"), "artifact", "o_orderkey", F.col("o_totalprice") < 20000, name)


@query("o5_22_source_ledger", """with v as (select layer, source_ref from fx_stroke group by 1, 2), e as (select layer, source_ref from fx_stroke where length_mm > 20 group by 1, 2)
select v.layer, count(*) as visible, count(e.source_ref) as emitted, cast(sum(case when e.source_ref is null and v.source_ref % 2 = 0 then 1 else 0 end) as bigint) as explained, cast(sum(case when e.source_ref is null and v.source_ref % 2 <> 0 then 1 else 0 end) as bigint) as unexplained from v left join e on e.layer = v.layer and e.source_ref = v.source_ref group by 1""")
def source_ledger(t):
    return rollups.source_ledger(t.plain_strokes(), "layer", "source_ref", F.col("length_mm") > 20, F.col("source_ref") % 2 == 0)


@query("o5_23_source_coverage", "select source as subject, cast(sum(case when l.quality = 1 then 1 else 0 end) as bigint) as qualified, cast(sum(case when l.quality = 0 then 1 else 0 end) as bigint) as rejected, cast(sum(case when l.quality is null then 1 else 0 end) as bigint) as open, sum(case when l.quality is null then 1 else 0 end) = 0 as complete from documents d left join labels l on l.doc_id = d.doc_id group by 1")
def source_coverage(t):
    met = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    state = F.when(F.col("quality") == 1, "qualified").when(F.col("quality") == 0, "rejected").otherwise("open")
    found = rollups.by_state(met, F.col("source").alias("subject"), state, {"qualified": "qualified", "rejected": "rejected", "open": "open"})
    return found.withColumn("complete", F.col("open") == 0)


@query("o5_24_snapshot_audit", "select o_custkey as relation, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as resolved, cast(sum(case when o_orderstatus = 'O' then 1 else 0 end) as bigint) as missing, cast(sum(case when o_orderstatus = 'P' then 1 else 0 end) as bigint) as excluded, count(distinct o_orderkey % 100) as ways from orders group by 1")
def snapshot_audit(t):
    found = rollups.by_state(t("orders"), F.col("o_custkey").alias("relation"), F.col("o_orderstatus"), {"F": "resolved", "O": "missing", "P": "excluded"})
    ways = t("orders").groupBy(F.col("o_custkey").alias("relation")).agg(F.countDistinct(F.col("o_orderkey") % 100).alias("ways"))
    return found.join(ways, "relation")


@query("o4_18_parallel_share", f"""with {PLANE}, c as (select line_id, pos, k, x0 + (x1 - x0) * k / 4.0 as x, y0 + (y1 - y0) * k / 4.0 as y from line, (select unnest(range(0, 5)) as k) q),
d as (select c.line_id, c.pos, c.k, min({seg_dist('c.x', 'c.y', 'l.x0', 'l.y0', 'l.x1', 'l.y1')}) as m from c join line l on l.line_id = c.line_id + 1 group by 1, 2, 3)
select line_id, count(*) as samples, round(avg(case when m <= 0.8 then 1.0 else 0.0 end), 6) as share from d group by 1""")
def parallel_share(t):
    """Each line against the next one."""
    p = plane(t)
    return coverage.parallel_share(p, next_lines(p), 0.8, 4.0).withColumn("share", F.round("share", 6))


def next_lines(p):
    """The legs of a plane as references of the line before."""
    return p.withColumn("line_id", F.col("line_id") - 1)


@query("o4_31_context_pieces", "select way_id, 'c' || way_id || case when n > 1 then '-' || n else '' end as piece from (select *, row_number() over (partition by highway, way_id % 5 order by way_id) as n from fx_tagged where highway is not null and area_mm2 > 1) x")
def context_pieces(t):
    x = t("fx_tagged").where("highway is not null and area_mm2 > 1")
    return reconcile.numbered_pieces(x, ["highway", F.col("way_id") % 5], ["way_id"], F.concat(F.lit("c"), F.col("way_id").cast("string"))).select("way_id", "piece")
