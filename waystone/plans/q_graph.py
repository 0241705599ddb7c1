"""Queries of set operations, deduplication and graph jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waystone.operators import graph, paths, reconcile
from waystone.operators.ranks import global_position
from waystone.operators.terrain import contour_paths, contour_segments, level_plan
from waystone.plans.q_joins import tiles
from waystone.plans.registry import query

EDGE = "edge as (select way_id, pos, node_id as a, lead(node_id) over (partition by way_id order by pos) as b from fx_way_node)"
EDGES = f"{EDGE}, link as (select distinct a, b from edge where b is not null and a <> b union select distinct b, a from edge where b is not null and a <> b)"


def edges(t):
    by = Window.partitionBy("way_id").orderBy("pos")
    return t("fx_way_node").select("way_id", "pos", F.col("node_id").alias("a"), F.lead("node_id").over(by).alias("b")).where("b is not null and a <> b")


#: The net: ways of ten orders share twenty nodes of their own, so that components stay small however many there are.
NET = "edge as (select way_id, pos, node_id as a, lead(node_id) over (partition by way_id order by pos) as b from fx_net_node)"
SPARSE = "link as (select distinct a, b from edge where b is not null and a <> b union select distinct b, a from edge where b is not null and a <> b), reach as (select a as id, a as r from link union select reach.id, link.b from reach join link on link.a = reach.r), comp as (select id, min(r) as component from reach group by 1)"


def net_edges(t):
    by = Window.partitionBy("way_id").orderBy("pos")
    return t("fx_net_node").select("way_id", "pos", F.col("node_id").alias("a"), F.lead("node_id").over(by).alias("b")).where("b is not null and a <> b")


@query("o8_7_components", f"with recursive {NET}, {SPARSE} select id, component from comp")
def components(t):
    return graph.components(net_edges(t))


@query("o5_15_component_sizes", f"with recursive {NET}, {SPARSE}, n as (select component, count(*) as nodes from comp group by 1), e as (select component, count(*) as edges from link join comp on id = a where a < b group by 1) select component, nodes, edges from n join e using (component)")
def component_sizes(t):
    e = net_edges(t)
    comp = graph.components(e)
    ends = e.select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("other")).distinct().join(comp, "id").groupBy("component").agg(F.count("*").alias("edges"))
    return comp.groupBy("component").agg(F.count("*").alias("nodes")).join(ends, "component")


@query("o8_8_groups_by_reference", """with recursive i as (select distinct l_orderkey // 10 * 20 + l_partkey % 20 as item, l_orderkey as ref from lineitem), l as (select distinct x.item as a, y.item as b from i x join i y using (ref)),
reach as (select a as id, b as r from l union select reach.id, l.b from reach join l on l.a = reach.r)
select cast(id as varchar) as item, cast(min(r) as varchar) as group_key from reach group by 1""")
def groups_by_reference(t):
    items = t("fx_net_node").select(F.col("node_id").alias("item"), F.col("way_id").alias("ref"))
    return graph.grouped_by_reference(items).select(F.col("item").cast("string").alias("item"), F.col("component").cast("string").alias("group_key"))


@query("o8_9_river_reunion", """with recursive r as (select o_orderkey as id, o_orderkey // 30 * 100 + o_custkey % 40 as a, o_orderkey // 30 * 100 + o_orderkey * 7 % 50 as b, case when o_orderkey % 3 = 0 then 'river' || (o_orderkey // 90) || '-' || (o_orderkey % 11) end as name, case when o_orderkey % 5 = 0 then o_orderkey % 7 end as wikidata from orders),
l as (select x.id as a, y.id as b from r x join r y on x.a = y.a union select x.id, y.id from r x join r y on x.a = y.b union select y.id, x.id from r x join r y on x.a = y.b union select x.id, y.id from r x join r y on x.b = y.b union select x.id, y.id from r x join r y on x.name = y.name),
reach as (select a as id, b as r from l union select reach.id, l.b from reach join l on l.a = reach.r), c as (select id, min(r) as component from reach group by 1)
select component, count(*) as parts, count(distinct wikidata) > 1 as conflict from c join r using (id) group by 1""")
def river_reunion(t):
    k = F.col("o_orderkey")
    block = F.floor(k / 30) * 100
    name = F.when(k % 3 == 0, F.concat(F.lit("river"), F.floor(k / 90).cast("string"), F.lit("-"), (k % 11).cast("string")))
    r = t("orders").select(k.alias("id"), (block + F.col("o_custkey") % 40).alias("a"), (block + (k * 7) % 50).alias("b"), name.alias("name"), F.when(k % 5 == 0, k % 7).alias("wikidata"))
    return graph.reunited(r)


@query("o8_10_stitched_runs")
def stitched_runs(t):
    """Ways whose ends lie on a grid of their own, some a little beside it; tests hold it against plain Python."""
    k = F.col("o_orderkey")
    off = F.when(k % 5 == 0, 0.4).when(k % 17 == 0, 1.5).otherwise(0.0)
    at = lambda n: (n * 7.0, n % 100 * 7.0)
    (ax, ay), (bx, by) = at(k), at(F.floor(k / 50) * 50 + (k * 7 + 3) % 50)
    ends = t("orders").select(k.alias("way"), (ax + off).alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), F.hypot(ax - bx, ay - by).alias("m"))
    return graph.stitched(ends, 1.0)


@query("o8_12_directed_cycles", """with recursive w as (select p_partkey as way, p_partkey as head, case when p_partkey % 10 = 0 then p_partkey - 9 when p_partkey % 77 = 0 then 0 else p_partkey + 1 end as tail from part),
f as (select x.way, y.way as next from w x join w y on y.head = x.tail), o as (select way, count(*) as n from f group by 1), i as (select next as way, count(*) as n from f group by 1),
g as (select w.way from w join o on o.way = w.way and o.n = 1 join i on i.way = w.way and i.n = 1), s as (select f.* from f join g on g.way = f.way),
reach as (select way, next as r from s union select reach.way, s.next from reach join s on s.way = reach.r), cyc as (select way from reach where way = r)
select way, (select min(q.r) from reach q where q.way = cyc.way) as cycle from cyc""")
def directed_cycles(t):
    p = F.col("p_partkey")
    ways = t("part").select(p.alias("way"), p.alias("head"), F.when(p % 10 == 0, p - 9).when(p % 77 == 0, 0).otherwise(p + 1).alias("tail"))
    return graph.directed_cycles(ways)[0]


@query("o8_14_two_core")
def two_core(t):
    e = edges(t).select((F.col("way_id") * 10000 + F.col("pos")).alias("edge_id"), "a", "b")
    return graph.two_core(e).select("edge_id")


@query("o8_13_lap_ways")
def lap_ways(t):
    """Ways that are left when leaves are pruned, by connected lap: the last tier of lap assembly."""
    e = edges(t).select((F.col("way_id") * 10000 + F.col("pos")).alias("edge_id"), "a", "b")
    core = graph.two_core(e)
    comp = graph.components(core.select("a", "b"))
    return core.join(comp, F.col("a") == F.col("id")).groupBy("component").agg(F.count("*").alias("ways"), F.countDistinct("a").alias("starts"))


@query("o8_15_shortest_paths", f"""with recursive {NET}, n as (select a, b, cast(1 + (a + b) % 7 as double) as m from edge where b is not null and a <> b), l as (select a, b, min(m) as m from (select a, b, m from n union all select b, a, m from n) x group by 1, 2),
q as (select distinct a as source, a // 20 * 20 + (a * 7 + 3) % 20 as target from n where a % 4 = 0), t as (select source, target from q where source <> target),
walk as (select source, target, source as node, 0.0e0 as d from t union select w.source, w.target, l.b, w.d + l.m from walk w join l on l.a = w.node where w.d + l.m <= 20)
select t.source, t.target, min(d) as m from t left join walk on walk.source = t.source and walk.target = t.target and node = walk.target group by 1, 2""")
def shortest_paths(t):
    """Shortest ways of a length of up to 20."""
    e, pairs = weighted_net(t)
    found = paths.shortest_routes(e, pairs)[0].join(pairs, "query")
    return found.select("source", "target", F.when(F.col("m") <= 20, F.col("m")).alias("m"))


def weighted_net(t):
    """The net's edges, one between any two nodes, and the pairs that are asked for."""
    e = net_edges(t).select((F.col("way_id") * 10000 + F.col("pos")).alias("edge"), "a", "b", (1.0 + (F.col("a") + F.col("b")) % 7).alias("m"))
    q = e.where("a % 4 = 0").select(F.col("a").alias("source"), (F.floor(F.col("a") / 20) * 20 + (F.col("a") * 7 + 3) % 20).alias("target")).distinct().where("source <> target")
    pairs = global_position(q, ["source", "target"], "query").select(F.col("query").cast("long").alias("query"), "source", "target")
    return paths.one_of_parallel(e), pairs


@query("o8_15_route_edges")
def route_edges(t):
    """The edges of up to four equal shortest routes of each pair, in order; tests hold them against plain Dijkstra."""
    e, pairs = weighted_net(t)
    return paths.shortest_routes(e, pairs)[1].join(pairs, "query").drop("query")


@query("o8_21_corridor_routes")
def corridor_routes(t):
    """A corridor a way, a leg between each two of its nodes in order, over the net; legs that repeat an edge are told."""
    by = Window.partitionBy("way_id").orderBy("pos")
    chain = net_edges(t).select((F.col("way_id") * 10000 + F.col("pos")).alias("edge"), "a", "b", (1.0 + (F.col("a") * 31 + F.col("b") * 17) % 101).alias("m"))
    legs = t("fx_net_node").select(F.col("way_id").alias("corridor"), F.col("pos").alias("leg"), F.col("node_id").alias("source"), F.lead("node_id").over(by).alias("target")).where("target is not null")
    return paths.corridor(paths.one_of_parallel(chain), legs)[0]


@query("o8_16_path_walk", f"with {EDGE} select way_id, count(*) as edges, coalesce(sum(case when next is not null and next <> b then 1 else 0 end), 0) = 0 as contiguous from (select *, lead(a) over (partition by way_id order by pos + case when way_id % 7 = 0 and pos = 1 then 5 else 0 end) as next from edge where b is not null) x group by 1")
def path_walk(t):
    by = Window.partitionBy("way_id").orderBy("pos")
    e = t("fx_way_node").select("way_id", "pos", F.col("node_id").alias("a"), F.lead("node_id").over(by).alias("b")).where("b is not null")
    return reconcile.contiguous_walks(e, "way_id", F.col("pos") + F.when((F.col("way_id") % 7 == 0) & (F.col("pos") == 1), 5).otherwise(0))


@query("o8_17_generalized_lines")
def generalized_lines(t):
    return graph.generalized(t("fx_track_pt").select("track_id", "pos", F.col("lon").alias("x"), F.col("lat").alias("y")), 0.004)


@query("o8_18_contours")
def contours(t):
    return contour_segments(tiles(t), level_plan(tiles(t))).drop("side0", "side1")


@query("o8_18_contour_lines")
def contour_lines(t):
    """Contours stitched to open lines and closed rings; tests hold them against plain Python."""
    return contour_paths(contour_segments(tiles(t), level_plan(tiles(t))))


@query("o8_19_route_discovery", """with recursive m as (select distinct relation_id as a, way_id % 900 as b from fx_rel_member), w as (select 0 as id, 0 as depth union select b, depth + 1 from w join m on m.a = w.id where depth < 40)
select id, min(depth) as depth from w group by 1""")
def route_discovery(t):
    m = t("fx_rel_member").select(F.col("relation_id").alias("a"), (F.col("way_id") % 900).alias("b")).distinct()
    return graph.reachable(m, t.spark.range(1).select("id"))


@query("o8_1_manifest_merge", """with s as (select o_custkey as id, case when o_custkey % 5 = 0 then o_orderstatus else 'same' end as body, o_orderkey % 9 = 0 as failed from orders), ok as (select id, count(*) as copies, count(distinct body) as bodies, min(body) as body from s where not failed group by 1)
select id, copies, case when bodies > 1 then 'conflict' else 'merged' end as status from ok union all select distinct id, 0, 'failed' from s where failed and id not in (select id from ok)""")
def manifest_merge(t):
    body = F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderstatus")).otherwise("same")
    return reconcile.merged_manifests(t("orders").select(F.col("o_custkey").alias("id"), body.alias("body"), (F.col("o_orderkey") % 9 == 0).alias("failed")))


@query("o8_2_inventory_difference", "select 'missing' as side, p_partkey as k from part where p_partkey not in (select l_partkey from lineitem where l_quantity < 10) union all select 'extra', l_partkey from (select distinct l_partkey from lineitem where l_quantity < 10) x where l_partkey not in (select p_partkey from part where p_partkey % 3 <> 0)")
def inventory_difference(t):
    want, have = t("part").select(F.col("p_partkey").alias("k")), t("lineitem").where("l_quantity < 10").select(F.col("l_partkey").alias("k")).distinct()
    return reconcile.inventory_difference(want, have, want.where("k % 3 <> 0"))


@query("o8_3_feature_dedup", """with f as (select l_orderkey * 10 + l_linenumber as pos, l_returnflag as layer, l_partkey as a, l_suppkey as b from lineitem)
select layer, least(a, b) as p, greatest(a, b) as q, min(pos) as first_pos, count(*) as copies from f group by 1, 2, 3""")
def feature_dedup(t):
    rows = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("layer"), "l_partkey", "l_suppkey")
    return reconcile.same_features(rows, ["layer"], "l_partkey", "l_suppkey", "pos")


@query("o8_4_observation_dedup", "select l_orderkey as k, l_linenumber as n, count(*) as seen, string_agg(cast(l_suppkey as varchar), ',' order by l_suppkey) as provenance, count(distinct l_returnflag) > 1 as disagree from lineitem group by 1, 2")
def observation_dedup(t):
    return reconcile.observations(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey", "l_returnflag").withColumnsRenamed({"l_orderkey": "k", "l_linenumber": "n"})


@query("o8_5_complementary_pairs", "select o_custkey as uid, count(*) as parts, count(distinct o_orderstatus) as kinds, count(*) = 2 and count(distinct o_orderstatus) = 2 as complete from orders group by 1")
def complementary_pairs(t):
    return reconcile.complementary(t("orders").withColumnRenamed("o_custkey", "uid"), "uid", "o_orderstatus")


@query("o8_6_release_diff", "select page_id, sha256(html) as before_sha, sha256(regexp_replace(html, '<a [^>]*>[^<]*</a>', '', 'g')) as after_sha, cast(len(regexp_extract_all(html, '<a [^>]*>[^<]*</a>')) as integer) as removed from pages")
def release_diff(t):
    return reconcile.externalised(t("pages"), "page_id", "html", "<a [^>]*>[^<]*</a>")


@query("o8_22_endpoint_merge", f"with recursive {NET}, {SPARSE} select component, count(*) as lines from comp join (select distinct least(a, b) as a, greatest(a, b) as b from link) l on l.a = comp.id group by 1")
def endpoint_merge(t):
    e = net_edges(t).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return e.join(graph.components(e), F.col("a") == F.col("id")).groupBy("component").agg(F.count("*").alias("lines"))


@query("o8_11_chain_pairs", f"""with {NET}, s as (select a as n, b as o, way_id, pos from edge where b is not null and a <> b union all select b, a, way_id, pos from edge where b is not null and a <> b),
d as (select n, count(*) as k from s group by 1), g as (select s.n, min(way_id * 10000 + pos) as first, max(way_id * 10000 + pos) as second from s join d on d.n = s.n and d.k = 2 group by 1)
select n as node, first, second from g where first // 10000 % 2 = second // 10000 % 2""")
def chain_pairs(t):
    e = net_edges(t).withColumn("e", F.col("way_id") * 10000 + F.col("pos"))
    s = e.select(F.col("a").alias("n"), "e", (F.col("way_id") % 2).alias("grade")).unionByName(e.select(F.col("b").alias("n"), "e", (F.col("way_id") % 2).alias("grade")))
    two = s.groupBy("n").agg(F.count("*").alias("k"), F.min("e").alias("first"), F.max("e").alias("second"), F.countDistinct("grade").alias("grades")).where("k = 2 and grades = 1")
    return two.select(F.col("n").alias("node"), "first", "second")


def net_spans(t):
    """The net's edges as spans: ids, line, signatures, ends and their outward directions."""
    at = lambda c: (((F.col(c) * 7919) % 10000) / 10000.0, ((F.col(c) * 104729) % 10000) / 10000.0)
    (xa, ya), (xb, yb) = at("a"), at("b")
    m = F.hypot(xb - xa, yb - ya)
    x, y = F.try_divide(xb - xa, m), F.try_divide(yb - ya, m)
    w = F.col("way_id")
    return net_edges(t).select((w * 10000 + F.col("pos")).alias("way"), w.alias("line"), (w % 2).alias("semantic"), (w % 3).alias("grade"), "a", "b", x.alias("ax"), y.alias("ay"), (-x).alias("bx"), (-y).alias("by"))


@query("o8_11_compatible_chains")
def compatible_chains(t):
    """Chains of compatible spans, the straightest paired first; tests hold the pairs against plain Python."""
    spans = net_spans(t)
    return graph.chains(spans.select("way", "a", "b"), links=graph.compatible_links(spans))


@query("o8_13_lap_assembly")
def lap_assembly(t):
    """Laps of five edges each of the net's ways, in order, with roles; tests hold it against plain Python."""
    e = net_edges(t)
    role = F.when(F.col("way_id") % 3 == 0, "forward").otherwise("")
    m = e.select("way_id", (F.col("way_id") * 10000 + F.col("pos")).alias("way"), "pos", "a", "b", role.alias("role"))
    return graph.laps(m.withColumnRenamed("way_id", "relation")).select("relation", F.array_join("ways", ",").alias("ways"), "closed", "method", F.array_join("findings", ";").alias("findings"))


@query("o8_22_merged_lines")
def merged_lines(t):
    """The net's edges as lines of three points, merged at ends where two meet; tests hold it against plain Python."""
    p = lambda c: F.struct(F.col(c).cast("double").alias("x"), (F.col(c) % 20).cast("double").alias("y"))
    mid = F.struct(((F.col("a") + F.col("b")) / 2).alias("x"), F.lit(-1.0).alias("y"))
    found = graph.merged_lines(net_edges(t).select((F.col("way_id") * 10000 + F.col("pos")).alias("line"), F.array(p("a"), mid, p("b")).alias("points")))
    return found.select("run", "lines", F.size("points").alias("vertices"), F.element_at("points", 1)["x"].alias("start_x"), F.element_at("points", -1)["x"].alias("end_x"))
