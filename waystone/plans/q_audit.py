"""Queries of contracts and data quality checks, and of caller-supplied columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waystone.operators import audit, coverage, reconcile, rollups, select
from waystone.plans.registry import query


@query("o9_1_raw_integrity", """select track_id, pos, unnest(list_filter([case when ele is null then 'missing-elevation' end, case when lat > 53.8 then 'outside' end, case when event_id % 11 = 0 then 'bad-id' end], lambda x: x is not null)) as reason from fx_track_pt""")
def raw_integrity(t):
    return audit.findings(t("fx_track_pt"), ["track_id", "pos"], {"missing-elevation": F.col("ele").isNull(), "outside": F.col("lat") > 53.8, "bad-id": F.col("event_id") % 11 == 0})


KEPT, DROPPED = "length_mm >= 20 and stroke_id % 101 <> 0", "length_mm < 20 or stroke_id % 103 = 0"


@query("o9_2_partition_parity", f"""with parts as (select stroke_id, length_mm from fx_stroke where {KEPT} union all select stroke_id, length_mm from fx_stroke where {DROPPED} union all select -stroke_id, length_mm from fx_stroke where stroke_id % 107 = 0),
lost as (select stroke_id from fx_stroke except all select stroke_id from parts), added as (select stroke_id from parts except all select stroke_id from fx_stroke),
twice as (select stroke_id from fx_stroke where {KEPT} intersect (select stroke_id from fx_stroke where {DROPPED} union all select -stroke_id from fx_stroke where stroke_id % 107 = 0))
select (select count(*) from lost) as lost, (select count(*) from added) as added, (select count(*) from twice) as overlap, (select round(sum(length_mm), 6) from fx_stroke) as whole_sum, (select round(sum(length_mm), 6) from parts) as parts_sum,
 (select count(*) from lost) = 0 and (select count(*) from added) = 0 and (select count(*) from twice) = 0 and (select round(sum(length_mm), 6) from fx_stroke) = (select round(sum(length_mm), 6) from parts) as holds""")
def partition_parity(t):
    """A split that loses strokes, puts some in both parts and adds some."""
    s = t("fx_stroke").select("stroke_id", "length_mm")
    extra = s.where("stroke_id % 107 = 0").withColumn("stroke_id", -F.col("stroke_id"))
    return audit.partition_parity(s, s.where(KEPT), s.where(DROPPED).unionByName(extra), "stroke_id", "length_mm")


@query("o9_3_minimum_evidence", "select stroke_id, length_mm, case pen when 'O' then 2.0 else 4.0 end * 3 as gate from fx_stroke where length_mm < case pen when 'O' then 2.0 else 4.0 end * 3")
def minimum_evidence(t):
    gate = F.when(F.col("pen") == "O", 2.0).otherwise(4.0) * 3
    return reconcile.below_gate(t("fx_stroke"), "length_mm", gate).select("stroke_id", "length_mm", "gate")


@query("o9_4_generalisation_check", """with b as (select track_id as line_id, pos, lon * 1000 as x, lat * 1000 as y, max(pos) over (partition by track_id) as last from fx_track_pt),
a as (select line_id, pos, x + case when line_id % 20 = 7 and pos = 0 then 1.0 else 0.0 end as x, y from b where line_id % 9 <> 4 and (pos % 2 = 0 or pos = last)),
m0 as (select line_id, count(*) as n, sum(d) as m from (select line_id, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 0) as d from b window w as (partition by line_id order by pos)) q group by 1),
m1 as (select line_id, count(*) as n, sum(d) as m from (select line_id, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 0) as d from a window w as (partition by line_id order by pos)) q group by 1),
p as (select b.line_id, b.x, b.y, l.x as x0, l.y as y0, h.x as x1, h.y as y1 from b join a l on l.line_id = b.line_id and l.pos = b.pos - case when b.pos % 2 = 0 or b.pos = b.last then 0 else 1 end join a h on h.line_id = b.line_id and h.pos = b.pos + case when b.pos % 2 = 0 or b.pos = b.last then 0 else 1 end),
f as (select *, case when (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 0 then least(1.0, greatest(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) else 0.0 end as f from p),
e as (select line_id, max(sqrt(power(x - x0 - f * (x1 - x0), 2) + power(y - y0 - f * (y1 - y0), 2))) as most from f group by 1)
select m0.line_id, m0.n as before, m1.n as after, round(m1.m / m0.m, 6) as length_ratio, round(most, 6) as error,
 concat_ws(';', case when m1.n is null then 'line-missing' end, case when m1.n is not null and m0.line_id % 20 = 7 then 'anchor-moved' end, case when m1.n is not null and most > 5.0 then 'error-bound-exceeded' end) as reasons
from m0 left join m1 on m1.line_id = m0.line_id left join e on e.line_id = m0.line_id""")
def generalisation_check(t):
    """Every other vertex, with moved starts and lost lines."""
    every = Window.partitionBy("track_id")
    b = t("fx_track_pt").withColumn("last", F.max("pos").over(every)).select(F.col("track_id").alias("line_id"), "pos", (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"), "last")
    moved = F.when((F.col("line_id") % 20 == 7) & (F.col("pos") == 0), 1.0).otherwise(0.0)
    a = b.where("line_id % 9 <> 4 and (pos % 2 = 0 or pos = last)").withColumn("x", F.col("x") + moved)
    c = coverage.generalisation_check(b, a, 5.0)
    return c.select("line_id", "before", "after", F.round("length_ratio", 6).alias("length_ratio"), F.round("error", 6).alias("error"), F.array_join("reasons", ";").alias("reasons"))


@query("o9_5_source_agreement", """select feature_id, case when not (native_ele is not null and n_ele is not null and native_ele <> n_ele) then coalesce(native_ele, n_ele) end as value,
 case when native_ele is null and n_ele is null then 'absent' when native_ele is null or n_ele is null then 'single' when native_ele = n_ele then 'agreed' else 'withheld' end as status from (select *, case when feature_id % 3 = 0 then global_ele + 10 when feature_id % 3 = 1 then global_ele end as n_ele from fx_elevation) x""")
def source_agreement(t):
    other = F.when(F.col("feature_id") % 3 == 0, F.col("global_ele") + 10).when(F.col("feature_id") % 3 == 1, F.col("global_ele"))
    return audit.agreement(t("fx_elevation").withColumn("n_ele", other), "feature_id", "native_ele", "n_ele")


@query("o9_6_distance_gate", "select o_custkey as course, round(sum(o_totalprice), 2) as measured, abs(sum(o_totalprice) - 1500000) / 1500000 <= 0.25 and count(distinct o_orderpriority) >= 3 as passed from orders group by 1")
def distance_gate(t):
    found = reconcile.distance_gate(t("orders").withColumnRenamed("o_custkey", "course"), "course", "o_totalprice", "o_orderpriority", 1500000.0, 0.25, 3)
    return found.withColumn("measured", F.round("measured", 2))


@query("o9_7_catalog_contract", """select 'duplicate-id' as rule, count(*) as broken from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1) a
union all select 'unknown-country', count(*) from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey <> 2) union all select 'wrong-size', case when (select count(*) from nation) = 25 then 0 else 1 end""")
def catalog_contract(t):
    size = t("nation").agg(F.count("*").alias("n")).where("n <> 25")
    return reconcile.broken_references({
        "duplicate-id": reconcile.repeated_keys(t("lineitem"), ["l_orderkey", "l_linenumber"]),
        "unknown-country": reconcile.missing_references(t("customer"), "c_nationkey", t("nation").where("n_regionkey <> 2"), "n_nationkey"),
        "wrong-size": size,
    })


@query("o9_8_cohort_binding", """select page_id, case when length(html) <> want then 'size' when page_id % 20 = 0 then 'digest' else 'bound' end as status from (select page_id, html, length(html) + case when page_id % 15 = 0 then 1 else 0 end as want from pages) x""")
def cohort_binding(t):
    k = F.col("page_id")
    facts = t("pages").select("page_id", F.length("html").alias("size"), F.sha2("html", 256).alias("sha"))
    other = F.when(k % 20 == 0, F.reverse("sha")).otherwise(F.col("sha"))
    pinned = facts.select("page_id", (F.col("size") + F.when(k % 15 == 0, 1).otherwise(0)).alias("size"), other.alias("sha"))
    return reconcile.bound_content(facts, pinned, "page_id")


@query("o9_9_route_identity", "select track_id, pos, side from (select track_id, pos, unnest(['gone', 'new']) as side from fx_track_pt where event_id % 500 = 0) x")
def route_identity(t):
    before = t("fx_track_pt").withColumn("lon", F.round("lon", 9))
    after = before.withColumn("lon", F.when(F.col("event_id") % 500 == 0, F.col("lon") + 1).otherwise(F.col("lon"))).withColumn("ele", F.lit(0.0))
    return audit.moved(before, after, ["track_id", "pos", "lon", "lat"]).select("track_id", "pos", "side")


@query("o9_10_reference_closure", "select r as ref, count(*) as uses from (select unnest([o_custkey % 900, o_orderkey % 1700]) as r from orders) x where r not in (select c_custkey from customer where c_custkey % 3 <> 0) group by 1")
def reference_closure(t):
    refs = t("orders").select(F.explode(F.array(F.col("o_custkey") % 900, F.col("o_orderkey") % 1700)).alias("ref"))
    return reconcile.reference_closure(refs, t("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("ref")))


@query("o9_11_crew_check", """with s as (select o_custkey as crew, o_orderkey % 5 + 1 as seat, o_orderkey % 40 as person from orders), n as (select crew, count(distinct seat) as seats, count(*) as people, count(distinct person) as persons from s group by 1)
select crew, seats = 5 as complete, persons < people as repeated from n""")
def crew_check(t):
    s = t("orders").select(F.col("o_custkey").alias("crew"), (F.col("o_orderkey") % 5 + 1).alias("seat"), (F.col("o_orderkey") % 40).alias("person"))
    return reconcile.crews(s, "crew", "seat", "person", 5)


@query("o11_1_width_callback", "select stroke_id, round(length_mm * (case layer when 'A' then 0.3 else 0.7 end), 6) as ink from fx_stroke")
def width_callback(t):
    """The width is a column that the caller supplies."""
    return rollups.inked(t("fx_stroke"), "stroke_id", "length_mm", F.when(F.col("layer") == "A", 0.3).otherwise(0.7)).withColumn("ink", F.round("ink", 6))


@query("o11_2_score_callback", "with c as (select *, row_number() over (partition by kind order by distance_m desc, id) as place from fx_candidate) select kind, id, cast(place as integer) as place from c where place <= 4")
def score_callback(t):
    """The order is a list of columns that the caller supplies."""
    return select.top_of_each(t("fx_candidate"), ["kind"], [F.desc("distance_m"), "id"], 4).select("kind", "id", "place")


@query("o11_3_bucket_callback", "select length_mm >= 25 as bucket, count(*) as strokes, sum(length_mm) as mm from fx_stroke group by 1")
def bucket_callback(t):
    """The bucket is a column that the caller supplies."""
    return rollups.bucketed(t.plain_strokes(), F.col("length_mm") >= 25, "length_mm")


@query("o11_4_row_generator", "select p_partkey as id, unnest(range(0, p_size, 10)) as at from part")
def row_generator(t):
    return rollups.generated(t("part"), F.col("p_partkey").alias("id"), F.col("p_size"), 10)


@query("o9_1_raw_geometry")
def raw_geometry(t):
    """Elements made of the net's ways and its nodes, with faults of each kind among them; tests hold it against plain Python."""
    return audit.raw_geometry(faulty_elements(t))


def faulty_elements(t):
    """Ways with geometry, their nodes, and relations of ten ways each; ids, vertices, roles and references are broken on a
    pattern."""
    n, w = F.col("node_id"), F.col("way_id")
    lon, lat = -3.0 + ((n * 7919) % 10000) / 10000.0, 51.0 + ((n * 104729) % 10000) / 10000.0
    rows = t("fx_net_node").withColumns({"lon": F.when(w % 41 == 0, 200.0).otherwise(lon), "lat": F.when((w % 43 == 0) & (F.col("pos") == 0), None).otherwise(lat)})
    vertex = F.struct("pos", F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon")).alias("p"), n.alias("n"))
    packed = rows.groupBy("way_id").agg(F.array_sort(F.collect_list(vertex)).alias("v"))
    ways = packed.select(
        F.when(w % 47 == 0, "area").otherwise("way").alias("type"), F.when(w % 53 == 0, None).otherwise(w).alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        F.transform("v", lambda x: x["n"]).alias("nodes"), F.transform(F.when(w % 59 == 0, F.slice("v", 1, 1)).otherwise(F.col("v")), lambda x: x["p"]).alias("geometry"), F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>").alias("members"),
    )
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in ways.schema.fields}
    nodes = t("fx_net_node").where("node_id % 97 <> 0").select(n.alias("id"), lon.alias("lon"), lat.alias("lat")).distinct()
    nodes = nodes.select(*[(none | {"type": F.lit("node").alias("type"), "id": F.col("id"), "lat": F.col("lat"), "lon": F.col("lon")})[c] for c in ways.columns])
    r = F.floor(w / 10)
    member = F.struct(F.when(w % 61 == 0, "thing").otherwise("way").alias("type"), w.alias("ref"), F.when(w % 67 == 0, None).otherwise("").alias("role"))
    nested = F.array(F.struct(F.lit("relation").alias("type"), F.when(F.col("r") % 5 == 4, F.col("r") - 4).otherwise(F.col("r") + 1).alias("ref"), F.lit("").alias("role")))
    relations = packed.select(r.alias("r"), w.alias("way_id")).groupBy("r").agg(F.array_sort(F.collect_list(member)).alias("m"))
    relations = relations.select(*[(none | {"type": F.lit("relation").alias("type"), "id": F.col("r").alias("id"), "members": F.when(F.col("r") % 7 < 5, F.concat("m", nested)).otherwise(F.col("m")).alias("members")})[c] for c in ways.columns])
    return ways.unionByName(nodes).unionByName(relations)
