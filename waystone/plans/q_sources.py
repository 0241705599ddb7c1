"""Queries of readers and writers: messages of each format are made from the given tables by Spark, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from waystone.operators import reconcile
from waystone.operators.terrain import decoded
from waystone.plans.registry import query
from waystone.sources import readers, writers

S = lambda c: F.col(c).cast("string")


def way_documents(t):
    """JSON documents of fifty ways each, with tags and geometry."""
    points = t("fx_way_node").join(t("fx_node"), "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("g"))
    element = F.struct(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.create_map(F.lit("highway"), F.when(F.col("way_id") % 2 == 0, "primary").otherwise("path")).alias("tags"), F.transform("g", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("geometry"))
    return points.groupBy(F.floor(F.col("way_id") / 50).alias("source")).agg(F.collect_list(element).alias("elements")).select("source", F.to_json(F.struct("elements")).alias("value"))


@query("o1_1_element_scan", "select w.way_id as id, case when w.way_id % 2 = 0 then 'primary' else 'path' end as highway, count(*) as vertices, min(n.lat) as south from fx_way_node w join fx_node n on n.node_id = w.node_id group by 1, 2")
def element_scan(t):
    found = readers.elements(way_documents(t)).where("problem is null")
    v = readers.element_vertices(found).groupBy("id").agg(F.count("*").alias("vertices"), F.min("lat").alias("south"))
    return found.select("id", F.col("tags")["highway"].alias("highway")).join(v, "id")


@query("o1_2_complete_ways", "with r as (select way_id, w.node_id, n.lon, n.lat from fx_way_node w left join (select * from fx_node where node_id % 50 <> 0) n on n.node_id = w.node_id) select way_id, count(*) as n, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north from r group by 1 having count(lon) = count(*)")
def complete_ways(t):
    ways = t("fx_way_node").groupBy("way_id").agg(F.collect_list("node_id").alias("nodes"))
    return readers.complete_ways(ways, t("fx_node").where("node_id % 50 <> 0"))


@query("o1_3_targeted_extract", "select node_id, lon, lat from fx_node where node_id in (select node_id from fx_way_node where way_id % 300 = 0)")
def targeted_extract(t):
    return readers.nodes_of_ways(t("fx_way").where("way_id % 300 = 0"), t("fx_way_node"), t("fx_node"))


@query("o1_4_named_nodes", "select p_partkey as node_id, lower(p_name) as name from part where p_partkey % 4 = 0 and p_partkey % 20 <> 0 and p_name is not null")
def named_nodes(t):
    k = F.col("p_partkey")
    tags = F.map_filter(F.create_map(F.lit("railway"), F.when(k % 4 == 0, "station"), F.lit("name"), F.lower("p_name"), F.when(k % 40 == 0, "abandoned").otherwise("disused:railway"), F.when(k % 20 == 0, "yes")), lambda k, v: v.isNotNull())
    return readers.named_rail_nodes(t("part").select(k.alias("node_id"), tags.alias("tags")))


@query("o1_5_operator_relations", """with r as (select o_orderkey as relation, unnest(string_split(case when o_orderkey % 4 = 0 then o_orderstatus || ';' || substr(o_orderpriority, 1, 1) else o_orderstatus end, ';')) as token from orders),
c as (select relation, count(distinct token) as n, min(token) as code from r where token in ('F', 'O', '1') group by 1) select relation, case when n = 1 then code end as code, n > 1 as ambiguous from c""")
def operator_relations(t):
    tag = F.when(F.col("o_orderkey") % 4 == 0, F.concat_ws(" ; ", "o_orderstatus", F.substring("o_orderpriority", 1, 1))).otherwise(F.col("o_orderstatus"))
    return readers.operator_relations(t("orders").select(F.col("o_orderkey").alias("relation"), tag.alias("operator")), ["F", "O", "1"])


@query("o1_6_coastline_scan", """with c as (select w.way_id, w.pos, w.node_id, n.lon, n.lat from fx_way_node w join fx_tagged g on g.way_id = w.way_id and g.nature = 'coastline' left join (select * from fx_node where node_id % 31 <> 0) n on n.node_id = w.node_id)
select way_id, pos, node_id, lon, lat from c where way_id in (select way_id from c where lon between -2.9 and -2.4 and lat between 51.1 and 51.6)""")
def coastline_scan(t):
    ways = t("fx_tagged").select("way_id", F.map_filter(F.create_map(F.lit("natural"), F.col("nature")), lambda k, v: v.isNotNull()).alias("tags"))
    return readers.coastline_ways(ways, t("fx_way_node"), t("fx_node").where("node_id % 31 <> 0"), -2.9, 51.1, -2.4, 51.6)


def point_texts(t, template: str):
    """Each track's points as one text, points in order."""
    p = t("fx_track_pt").select("track_id", "pos", F.format_string(template, "lat", "lon", F.coalesce(S("ele"), F.lit(""))).alias("s"))
    return p.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("body"))


LINE_SCAN = "select track_id as source, count(*) as points, round(max(lat), 7) as lat, round(min(lon), 7) as lon, count(ele) as elevations from fx_track_pt where track_id % 9 <> 4 group by 1 having count(*) >= 2"
LINE_REJECTS = "select track_id as source, case when track_id % 9 = 4 then 'malformed' when count(*) < 2 then 'no-line' end as problem from fx_track_pt group by 1 having track_id % 9 = 4 or count(*) < 2"


def scan_of(points):
    lines = points.groupBy("source").agg(F.count("*").alias("points"), F.round(F.max("lat"), 7).alias("lat"), F.round(F.min("lon"), 7).alias("lon"), F.count("ele").alias("elevations"))
    return lines.where("points >= 2")


def gpx_documents(t):
    """A track a document, beside one without segments; every ninth document lacks its end."""
    docs = point_texts(t, '<trkpt lat="%.9f" lon="%.9f"><ele>%s</ele></trkpt>')
    end = F.when(F.col("track_id") % 9 == 4, "").otherwise("</trkseg></trk><trk><name>none</name></trk></gpx>")
    return docs.select(F.col("track_id").alias("source"), F.concat(F.lit("<gpx><trk><name>t</name><trkseg>"), "body", end).alias("value"))


def kml_documents(t):
    """A line a document, between an empty one, a point and a line of one position; every ninth document lacks its end."""
    p = t("fx_track_pt").select("track_id", "pos", F.concat(F.format_string("%.9f,%.9f", "lon", "lat"), F.coalesce(F.concat(F.lit(","), S("ele")), F.lit(""))).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "\n ")
    head = "<kml><LineString/><LineString></LineString><Point><coordinates>9,9</coordinates></Point><LineString><coordinates>8,8</coordinates></LineString><LineString id='a'><coordinates>\n "
    packed = p.groupBy(F.col("track_id").alias("source")).agg(body.alias("body"))
    end = F.when(F.col("source") % 9 == 4, "</coordinates></LineString>").otherwise("</coordinates></LineString></kml>")
    return packed.select("source", F.concat(F.lit(head), "body", end).alias("value"))


@query("o1_7_gpx_scan", LINE_SCAN)
def gpx_scan(t):
    return scan_of(readers.gpx_points(gpx_documents(t)))


@query("o1_7_gpx_rejects", LINE_REJECTS)
def gpx_rejects(t):
    docs = gpx_documents(t)
    return readers.track_rejects(docs, readers.gpx_points(docs), ["seg"])


@query("o1_8_kml_scan", LINE_SCAN)
def kml_scan(t):
    docs = kml_documents(t)
    good = docs.join(readers.malformed(docs).select("source"), "source", "left_anti")
    return scan_of(readers.kml_points(good))


@query("o1_8_kml_rejects", LINE_REJECTS)
def kml_rejects(t):
    docs = kml_documents(t)
    return readers.track_rejects(docs, readers.kml_points(docs), ["line"])


@query("o1_9_tcx_scan", "select track_id as source, cast(pos // 20 as integer) as lap, count(*) as points, round(max(lat), 7) as lat, count(ele) as elevations from fx_track_pt group by 1, 2")
def tcx_scan(t):
    p = t("fx_track_pt").select("track_id", "pos", F.floor(F.col("pos") / 20).alias("lap"), F.concat(F.format_string("<Trackpoint><Position><LatitudeDegrees>%.9f</LatitudeDegrees><LongitudeDegrees>%.9f</LongitudeDegrees></Position>", "lat", "lon"), F.coalesce(F.concat(F.lit("<AltitudeMeters>"), S("ele"), F.lit("</AltitudeMeters>")), F.lit("")), F.lit("</Trackpoint>")).alias("s"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), "")
    laps = p.groupBy("track_id", "lap").agg(F.concat(F.lit("<Lap><Track>"), join(F.struct("pos", "s")), F.lit("</Track></Lap>")).alias("s"))
    docs = laps.groupBy(F.col("track_id").alias("source")).agg(F.concat(F.lit("<Activity>"), join(F.struct("lap", "s")), F.lit("</Activity>")).alias("value"))
    return readers.tcx_points(docs).groupBy("source", "lap").agg(F.count("*").alias("points"), F.round(F.max("lat"), 7).alias("lat"), F.count("ele").alias("elevations"))


@query("o1_10_geojson_scan", "select track_id as source, cast(count(*) as integer) as points, round(max(lat), 7) as lat from fx_track_pt group by 1")
def geojson_scan(t):
    p = t("fx_track_pt").groupBy(F.col("track_id").alias("source")).agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    c = F.to_json(F.transform("p", lambda x: F.array(x["lon"], x["lat"])))
    line = F.concat(F.lit('{"type":"LineString","coordinates":'), c, F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.when(F.col("source") % 2 == 0, line).otherwise(F.concat(F.lit('{"type":"GeometryCollection","geometries":['), line, F.lit("]}"))), F.lit("}"))
    docs = p.select("source", F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")).alias("value"))
    lines = readers.geojson_lines(docs)
    return lines.select("source", F.size("coordinates").alias("points"), F.round(F.array_max(F.transform("coordinates", lambda q: q[1])), 7).alias("lat"))


@query("o1_11_course_relation", """with g as (select way_id, -3.0e0 + (way_id % 40) * 0.01e0 as x0, 51.0e0 + (way_id * 7 % 30) * 0.01e0 as y0, -3.0e0 + ((way_id + 1) % 40) * 0.01e0 as x1, 51.0e0 + ((way_id + 1) * 7 % 30) * 0.01e0 as y1 from (select distinct way_id from fx_rel_member where way_id % 13 <> 0) q),
w as (select r.relation_id, r.pos, g.way_id, case when g.way_id is not null then 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(y1 - y0) / 2), 2) + cos(radians(y0)) * cos(radians(y1)) * power(sin(radians(x1 - x0) / 2), 2)))) end as m, concat_ws(' ', round(x0, 7), round(y0, 7)) as a, concat_ws(' ', round(x1, 7), round(y1, 7)) as b from fx_rel_member r left join g on g.way_id = r.way_id),
s as (select *, sum(new) over (partition by relation_id order by pos rows unbounded preceding) as seg from (select *, case when coalesce(a = la or a = lb or b = la or b = lb, false) then 0 else 1 end as new from (select *, lag(a) over (partition by relation_id order by pos) as la, lag(b) over (partition by relation_id order by pos) as lb from w) q where m is not null) z),
p as (select relation_id, seg, sum(m) as m from s group by 1, 2), c as (select relation_id, sum(m) as measured, max(m) as largest, count(*) as parts, 2000.0e0 + relation_id % 5 * 1000 as official from p group by 1), l as (select relation_id, cast(sum(case when m is null then 1 else 0 end) as bigint) as missing from w group by 1)
select relation_id, parts, round(measured, 3) as measured_m, missing, concat_ws(';', case when measured <= 0 then 'no-length' end, case when (measured - official) / official < -0.1 then 'too-short' end, case when (measured - official) / official > 0.1 then 'too-long' end, case when largest / measured < 0.8 then 'fragmented' end, case when missing > 0 then 'missing-ways' end) as reasons from c join l using (relation_id)""")
def course_relation(t):
    """Relations and their ways as elements of JSON documents; one way in thirteen isn't there."""
    member = F.transform("m", lambda x: F.struct(F.lit("way").alias("type"), x["way_id"].alias("ref"), x["role"].alias("role")))
    relations = t("fx_rel_member").groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("pos", "way_id", "role"))).alias("m"))
    relations = relations.select(F.col("relation_id").alias("source"), F.struct(F.lit("relation").alias("type"), F.col("relation_id").alias("id"), member.alias("members")).alias("e"))
    w = F.col("way_id")
    point = lambda k: F.struct((51.0 + (k * 7 % 30) * 0.01).alias("lat"), (-3.0 + (k % 40) * 0.01).alias("lon"))
    ways = t("fx_rel_member").where("way_id % 13 <> 0").select("way_id").distinct().select(w.alias("source"), F.struct(F.lit("way").alias("type"), w.alias("id"), F.array(point(w), point(w + 1)).alias("geometry")).alias("e"))
    docs = lambda df: df.select("source", F.to_json(F.struct(F.array("e").alias("elements"))).alias("value"))
    found = readers.elements(docs(relations).unionByName(docs(ways)))
    official = t("fx_rel_member").select(F.col("relation_id").alias("relation"), (2000.0 + F.col("relation_id") % 5 * 1000).alias("official_m")).distinct()
    c = readers.course_relations(found, official, 0.1, 0.1)
    return c.select(F.col("relation").alias("relation_id"), "parts", F.round("measured_m", 3).alias("measured_m"), "missing", F.array_join("reasons", ";").alias("reasons"))


@query("o1_12_service_days", "select c_custkey as service_id from customer where (c_custkey % 7 < 4 and c_custkey % 5 <> 0 or c_custkey % 11 = 0) and c_custkey % 13 <> 0")
def service_days(t):
    c = F.col("c_custkey")
    day = F.lit("1995-06-15").cast("date")
    calendar = t("customer").select(c.alias("service_id"), *[F.when(c % 7 < 4, 1).otherwise(0).alias(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")], F.when(c % 5 == 0, F.lit("1996-01-01")).otherwise("1995-01-01").cast("date").alias("start_date"), F.lit("1999-01-01").cast("date").alias("end_date"))
    extra = t("customer").where("c_custkey % 11 = 0").select(c.alias("service_id"), day.alias("date"), F.lit(1).alias("exception_type"))
    gone = t("customer").where("c_custkey % 13 = 0").select(c.alias("service_id"), day.alias("date"), F.lit(2).alias("exception_type"))
    return readers.service_days(calendar, extra.unionByName(gone), day)


def cif_lines(t):
    """Fixed-width lines of schedules: one BS record and three calls for each order."""
    k = F.col("o_orderkey")
    head = F.concat(F.lit("BSN"), F.lpad(S("o_custkey"), 6, "0"), F.date_format("o_orderdate", "yyMMdd"), F.date_format(F.date_add("o_orderdate", 90), "yyMMdd"), F.lit("1111100"), F.lit(" "), F.lit("P"), F.lit("OO"), F.lpad(S("o_orderkey").substr(F.lit(1), F.lit(4)), 4, "0"))
    head = F.concat(F.rpad(head, 79, " "), F.when(k % 3 == 0, "O").otherwise("P"))
    hhmm = lambda m: F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))
    start = k % 1200
    calls = [F.concat(F.lit("LOAAA    "), F.lit(" "), hhmm(start), F.lit("H")), F.concat(F.lit("LIBBB    "), F.lit(" "), hhmm(start + 10), F.lit(" "), hhmm(start + 11), F.lit(" ")), F.concat(F.lit("LTCCC    "), F.lit(" "), hhmm(start + 30), F.lit(" "))]
    return t("orders").select(F.floor(k / 2000).cast("string").alias("file"), k.alias("k"), F.posexplode(F.array(head, *calls)).alias("i", "value")).select("file", (F.col("k") * 4 + F.col("i")).alias("line"), "value")


@query("o1_13_cif_scan", """select lpad(cast(o_custkey as varchar), 6, '0') as uid, strftime(o_orderdate, '%Y-%m-%d') as runs_from, case when o_orderkey % 3 = 0 then 'O' else 'P' end as stp, 3 as calls, cast((o_orderkey % 1200) * 2 + 1 as integer) as first_depart, cast((o_orderkey % 1200 + 30) * 2 as integer) as last_arrive from orders""")
def cif_scan(t):
    heads, calls = readers.cif_schedules(cif_lines(t))
    each = calls.groupBy("file", "schedule").agg(F.count("*").cast("int").alias("calls"), F.min_by("depart", "pos").alias("first_depart"), F.max_by("arrive", "pos").alias("last_arrive"))
    return heads.join(each, ["file", "schedule"]).select("uid", S("runs_from").alias("runs_from"), "stp", "calls", "first_depart", "last_arrive")


@query("o1_13_cif_rejects", """with r as (select o_custkey % 50 as file, o_orderkey * 8 as base, o_orderkey % 13 as broken from orders),
k as (select file, base + i as line, case when i = 0 then 'BS' when i = 1 then 'BX' when i = 2 then case when broken = 3 then 'XX' else 'LO' end when i = 3 then 'LI' when i = 4 then case when broken = 5 then 'BX' else 'CR' end when i = 5 then 'LI' else 'LT' end as kind
 from r, (select unnest(range(0, 7)) as i) q where not (broken = 7 and i = 6) and not (broken = 9 and i = 2)
 union all select file, -1, 'HD' from r where file % 7 <> 2 group by 1 union all select file, 1000000000, 'ZZ' from r where file % 11 <> 3 group by 1),
p as (select *, lag(kind) over w as before, row_number() over w as n, count(*) over (partition by file) as total from k window w as (partition by file order by line)),
q as (select file, line, 'unknown-record' as problem from p where kind = 'XX' union all select file, line, 'no-header' from p where n = 1 and kind <> 'HD' union all select file, line, 'no-trailer' from p where n = total and kind <> 'ZZ'
 union all select file, line, 'misplaced' from p where (kind = 'BX' and before is distinct from 'BS') or (kind = 'LO' and coalesce(before, '') not in ('BS', 'BX', 'TN')) or (kind = 'LI' and coalesce(before, '') not in ('LO', 'LI', 'CR')) or (kind = 'CR' and coalesce(before, '') not in ('LO', 'LI')) or (kind = 'LT' and coalesce(before, '') not in ('LO', 'LI', 'CR'))
 union all select file, line, 'unfinished' from p where (kind in ('BS', 'ZZ') and before in ('LO', 'LI', 'CR')) or (n = total and kind in ('LO', 'LI', 'CR')))
select file, line, problem from q""")
def cif_rejects(t):
    """Files of schedules of seven records, some of which are broken; some files lack a header or a trailer."""
    r = t("orders").select((F.col("o_custkey") % 50).alias("file"), (F.col("o_orderkey") * 8).alias("base"), (F.col("o_orderkey") % 13).alias("broken"))
    kinds = F.array(F.lit("BS"), F.lit("BX"), F.when(F.col("broken") == 3, "XX").otherwise("LO"), F.lit("LI"), F.when(F.col("broken") == 5, "BX").otherwise("CR"), F.lit("LI"), F.lit("LT"))
    rows = r.select("file", "base", "broken", F.posexplode(kinds).alias("i", "value")).where("not (broken = 7 and i = 6) and not (broken = 9 and i = 2)")
    rows = rows.select("file", (F.col("base") + F.col("i")).alias("line"), "value")
    files = r.select("file").distinct()
    ends = files.where("file % 7 <> 2").select("file", F.lit(-1).cast("long").alias("line"), F.lit("HD").alias("value")).unionByName(files.where("file % 11 <> 3").select("file", F.lit(1_000_000_000).cast("long").alias("line"), F.lit("ZZ").alias("value")))
    return readers.cif_rejects(rows.unionByName(ends))


@query("o1_14_station_scan", "select p_name as name, 'T' || p_partkey as tiploc, cast((p_size * 10 + 1000 - 1000) * 100 as integer) as easting from part where p_partkey % 9 <> 0")
def station_scan(t):
    """A TIPLOC has seven columns, which hold keys beyond 999,999 in base 36 only."""
    crs = F.when(F.col("p_partkey") % 9 == 0, "A1C").otherwise("ABC")
    line = F.concat(F.lit("A    "), F.rpad("p_name", 26, " "), F.lit("     "), F.rpad(F.concat(F.lit("T"), F.conv(S("p_partkey"), 10, 36)), 7, " "), F.rpad(F.lit("X"), 6, " "), crs, F.lpad((F.col("p_size") * 10 + 10000).cast("string"), 5, "0"), F.lit(" "), F.lit("60500"), F.lit("05 "))
    good, _ = readers.station_records(t("part").select(line.alias("value")))
    key = F.conv(F.substring("tiploc", 2, 6), 36, 10)
    return good.select("name", F.concat(F.lit("T"), key).alias("tiploc"), "easting")


@query("o1_15_stop_scan", "select 'S' || (p_partkey - p_partkey % 2 * case when p_partkey % 10 = 1 then 1 else 0 end) as code from part where p_partkey % 10 not in (0, 1) and p_partkey % 8 <> 0")
def stop_scan(t):
    k = F.col("p_partkey")
    stops = t("part").select(F.concat(F.lit("S"), (k - F.when(k % 10 == 1, 1).otherwise(0)).cast("string")).alias("ATCOCode"), F.lit(" rly ").alias("StopType"), F.when(k % 10 == 0, "active").otherwise("Active").alias("Status"), F.when(k % 8 == 0, "").otherwise("-1.5").alias("Longitude"), F.lit("52.1").alias("Latitude"))
    both = stops.where(~(F.substring("ATCOCode", -1, 1) == "0"))
    good, _ = readers.stop_points(both, ["RLY"])
    return good.select(F.col("ATCOCode").alias("code"))


@query("o1_16_timing_columns", "select l_orderkey // 20 as book, l_returnflag as sheet, l_suppkey as col, count(*) as n from lineitem where l_quantity > 10 group by 1, 2, 3")
def timing_columns(t):
    cells = t("lineitem").select(F.floor(F.col("l_orderkey") / 20).alias("book"), F.col("l_returnflag").alias("sheet"), F.col("l_suppkey").alias("col"), F.col("l_linenumber").alias("row"), F.when(F.col("l_quantity") > 10, S("l_partkey")).otherwise("  ").alias("value"))
    return readers.timing_columns(cells).select("book", "sheet", "col", "n")


@query("o1_17_tile_features", "with v as (select p_partkey as feature_id, (2000 + p_partkey % 90 + (p_size * 80) / 4096.0e0) / 4096.0e0 * 360 - 180 as lon, (1300 + p_partkey % 70 + 0.5) / 4096.0e0 as fy from part) select feature_id, round(lon, 8) as lon, round(degrees(atan(sinh(pi() * (1 - 2 * fy)))), 8) as lat from v where lon between -4 and 2")
def tile_features(t):
    k = F.col("p_partkey")
    f = t("part").select(F.lit(12).alias("z"), (2000 + k % 90).alias("x"), (1300 + k % 70).alias("y"), k.alias("feature_id"), F.lit(0).alias("pos"), (F.col("p_size") * 80).alias("px"), F.lit(2048).alias("py"))
    return readers.tile_features(f, (-4.0, -90.0, 2.0, 90.0)).select("feature_id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query("o1_18_catalog_scan", "select c_custkey // 100 as source, count(*) as subjects, cast(sum(case when c_custkey % 10 = 3 then 1 else 0 end) as bigint) as unknown from customer group by 1")
def catalog_scan(t):
    k = F.col("c_custkey")
    subject = F.struct(S("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("city").alias("kind"), F.lit("GB").alias("country"))
    entry = F.struct(F.when(k % 10 == 3, F.lit("nobody")).otherwise(S("c_custkey")).alias("subject_id"), (k % 100).cast("int").alias("position"))
    docs = t("customer").groupBy(F.floor(k / 100).alias("source")).agg(F.collect_list(subject).alias("subjects"), F.collect_list(entry).alias("e"))
    docs = docs.select("source", F.to_json(F.struct(F.lit(1).alias("schema_version"), "subjects", F.array(F.struct(F.lit("all").alias("id"), F.col("e").alias("entries"))).alias("collections"))).alias("value"))
    subjects, _, unknown = readers.catalog_entries(docs)
    lost = unknown.groupBy("source").agg(F.count("*").alias("unknown"))
    return subjects.groupBy("source").agg(F.count("*").alias("subjects")).join(lost, "source", "left").select("source", "subjects", F.coalesce("unknown", F.lit(0)).alias("unknown"))


@query("o1_19_contract_references", "select 'edge-node' as rule, count(*) as broken from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 100 <> 0) union all select 'edge-line', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 100 <> 0)")
def contract_references(t):
    nodes = reconcile.missing_references(t("lineitem"), "l_partkey", t("part").where("p_partkey % 100 <> 0"), "p_partkey")
    lines = reconcile.missing_references(t("lineitem"), "l_orderkey", t("orders").where("o_orderkey % 100 <> 0"), "o_orderkey")
    return reconcile.broken_references({"edge-node": nodes, "edge-line": lines})


@query("o1_21_checksum_list", "with l as (select page_id, case when page_id % 10 = 0 then 'xyz' else sha256(html) end as sha, case when page_id % 10 = 1 then '/abs' when page_id % 10 = 2 then 'a/../b' else 'p/' || page_id end as path from pages) select case when sha = 'xyz' then 'malformed' when path = '/abs' then 'absolute' when path = 'a/../b' then 'traversal' else 'good' end as status, count(*) as n from l group by 1")
def checksum_list(t):
    m = F.col("page_id") % 10
    sha = F.when(m == 0, "xyz").otherwise(F.sha2("html", 256))
    path = F.when(m == 1, "/abs").when(m == 2, "a/../b").otherwise(F.concat(F.lit("p/"), S("page_id")))
    good, bad = readers.checksum_list(t("pages").select(F.concat(sha, F.lit("  "), path).alias("value")))
    return good.agg(F.lit("good").alias("status"), F.count("*").alias("n")).unionByName(bad.groupBy(F.col("problem").alias("status")).agg(F.count("*").alias("n")))


@query("o1_22_artifact_bytes")
def artifact_bytes(t):
    """Size and digest of every table file of the folder."""
    found = readers.artifacts(t.spark, t.sf_dir, "*.parquet")
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "sha")


@query("o1_23_html_facts", "select page_id, nullif(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '') as title, cast(len(regexp_extract_all(html, '<a [^>]*href')) as integer) as n_links from pages")
def html_facts(t):
    return readers.html_facts(t("pages")).select("page_id", "title", "n_links")


@query("o1_24_pixel_elevation", "with p as (select vec_id as tile, i, 128.0e0 + (vec_id % 3) as r, cast((i * 7) % 256 as double) as g, cast((i * 13) % 256 as double) as b from embeddings, unnest(range(64)) as u(i)) select tile, i as pos, case when r * 256 + g + b / 256 - 32768 between -500 and 9000 then r * 256 + g + b / 256 - 32768 end as z from p")
def pixel_elevation(t):
    p = t("embeddings").select(F.col("vec_id").alias("tile"), F.posexplode("embedding").alias("pos", "v"))
    z = decoded(128.0 + F.col("tile") % 3, ((F.col("pos") * 7) % 256).cast("double"), ((F.col("pos") * 13) % 256).cast("double"))
    return p.select("tile", F.col("pos").cast("long").alias("pos"), z.alias("z"))


@query("o1_25_grid_mosaic", "with c as (select vec_id as tile, i // 8 as row, i % 8 as col, round(cast(embedding[i + 1] as double) * 1000) as z from embeddings, unnest(range(64)) as u(i) where vec_id % 13 <> 5), m as (select (tile % 10) * 200.0e0 + col * 50 as x, (tile // 10) * 200.0e0 + (7 - row) * 50 as y, tile, z from c where z <> -9999) select x, y, arg_max(z, tile) + 0.0e0 as z from m group by 1, 2")
def grid_mosaic(t):
    return readers.mosaic(readers.ascii_grid(grid_lines(t)), "tile").withColumn("z", F.col("z") + 0.0)


def grid_lines(t):
    """Lines of ASCII grids, one of each tile; one in thirteen has another cell size."""
    k = F.col("vec_id")
    size = F.when(k % 13 == 5, F.lit("cellsize 25")).otherwise("cellsize 50")
    header = [F.lit("ncols 8"), F.lit("nrows 8"), F.concat(F.lit("xllcorner "), ((k % 10) * 200.0).cast("string")), F.concat(F.lit("yllcorner "), (F.floor(k / 10) * 200.0).cast("string")), size, F.lit("NODATA_value -9999")]
    row = lambda r: F.array_join(F.transform(F.slice("embedding", r * 8 + 1, 8), lambda v: F.round(v.cast("double") * 1000).cast("string")), " ")
    return t("embeddings").select(k.alias("tile"), F.posexplode(F.array(*header, *[row(r) for r in range(8)])).alias("line", "value"))


@query("o1_25_grid_rejects", "select vec_id as tile, 'cell-size' as problem from embeddings where vec_id % 13 = 5")
def grid_rejects(t):
    return readers.grid_heads(grid_lines(t))[1]


CONTOUR = """with f as (select p_partkey, p_size as level, case when p_partkey % 11 = 0 then 'Point' else 'LineString' end as kind, case when p_partkey % 13 = 0 then 1 else 2 + p_partkey % 4 end as points, p_partkey % 17 = 0 as bare from part),
c as (select *, case when bare then 'no-geometry' when kind <> 'LineString' then 'not-a-line' when points < 2 then 'too-few-points' when level % 5 <> 0 then 'level' end as problem from f)"""


def contour_documents(t):
    """Feature collections of a hundred contours each; some have no geometry, another kind, one point or an odd level."""
    k = F.col("p_partkey")
    n = F.when(k % 13 == 0, 1).otherwise((2 + k % 4).cast("int"))
    points = F.to_json(F.transform(F.sequence(F.lit(1), n), lambda i: F.array(i.cast("double"), (k + i).cast("double"))))
    shape = F.concat(F.lit('{"type":"'), F.when(k % 11 == 0, "Point").otherwise("LineString"), F.lit('","coordinates":'), points, F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"level":'), S("p_size"), F.lit(',"importance":'), (k % 3).cast("string"), F.lit('},"geometry":'), F.when(k % 17 == 0, "null").otherwise(shape), F.lit("}"))
    packed = t("part").groupBy(F.floor(k / 100).alias("source")).agg(F.array_join(F.collect_list(feature), ",").alias("f"))
    return packed.select("source", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value"))


@query("o1_26_contour_levels", f"{CONTOUR} select level + 0.0e0 as level, p_partkey % 3 as importance, count(*) as lines, cast(sum(points) as bigint) as points from c where problem is null group by 1, 2")
def contour_levels(t):
    good, _ = readers.contour_lines(contour_documents(t), 5)
    return good.groupBy("level", "importance").agg(F.count("*").alias("lines"), F.sum(F.size("coordinates")).alias("points"))


@query("o1_26_contour_rejects", f"{CONTOUR} select problem, count(*) as n from c where problem is not null group by 1")
def contour_rejects(t):
    return readers.contour_lines(contour_documents(t), 5)[1].groupBy("problem").agg(F.count("*").alias("n"))


@query("o1_27_hydro_gate", """with f as (select p_partkey as k, p_partkey // 50 as source, case when p_partkey % 2 = 0 then 'river' else 'lake' end as kind, -3.0e0 + (p_partkey * 7 % 100) * 0.1e0 as x, 50.0e0 + (p_partkey * 3 % 50) * 0.1e0 as y,
 case when p_partkey % 10 = 0 then 9.0e0 else 0.3e0 end as dx, case when p_partkey % 3 = 0 then 2 else 1 end as parts, cast(p_partkey % 9 as integer) as rank from part),
p as (select f.*, i, x + i * 0.1e0 as px, y + i * 0.1e0 as py from f, (select unnest(range(0, 2)) as i) q where i < parts),
g as (select source, k, kind, rank, parts, sum(case when py between 50.5 and 53 then greatest(0.0, least(px + dx, 3.0) - greatest(px, -2.0)) else 0 end) as inside,
 bool_and(px between -2 and 3 and px + 0.3e0 between -2 and 3 and py between 50.5 and 53 and py + 0.2e0 between 50.5 and 53) as covered from p group by 1, 2, 3, 4, 5)
select source, kind, 'N' || k as name, rank, cast(case when kind = 'river' then 2 else 4 end * parts as integer) as points, case when kind = 'river' then round(inside, 6) end as inside from g
where source % 4 <> 3 and k % 5 <> 4 and rank <= 6 and case when kind = 'river' then inside > 0 else covered end""")
def hydro_gate(t):
    """Rivers and lakes of fifty features a document, every third of two parts and some rivers without a vertex in the extent; every
    fourth document isn't the one that the manifest pins, and one feature in five is of another class."""
    k = F.col("p_partkey")
    x, y = -3.0 + (k * 7 % 100) * 0.1, 50.0 + (k * 3 % 50) * 0.1
    dx = F.when(k % 10 == 0, 9.0).otherwise(0.3)
    p = lambda i, a, b: F.array(x + 0.1 * i + a, y + 0.1 * i + b)
    line = lambda i: F.array(p(i, F.lit(0.0), 0.0), p(i, dx, 0.0))
    ring = lambda i: F.array(F.array(p(i, 0.0, 0.0), p(i, 0.3, 0.0), p(i, 0.3, 0.2), p(i, 0.0, 0.0)))
    geometry = lambda kind, c: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(c), F.lit("}"))
    shape = (
        F.when((k % 2 == 0) & (k % 3 == 0), geometry("MultiLineString", F.array(line(0), line(1)))).when(k % 2 == 0, geometry("LineString", line(0)))
        .when(k % 3 == 0, geometry("MultiPolygon", F.array(ring(0), ring(1)))).otherwise(geometry("Polygon", ring(0)))
    )
    name = F.when(k % 5 == 4, "Road").when(k % 2 == 0, "River").otherwise("Lake Centerline")
    head = F.concat(F.lit('{"properties":{"name":"N'), S("p_partkey"), F.lit('","scalerank":'), (k % 9).cast("string"))
    feature = F.concat(head, F.lit(',"featurecla":"'), name, F.lit('"},"geometry":'), shape, F.lit("}"))
    packed = t("part").groupBy(F.floor(k / 50).alias("source")).agg(F.array_join(F.array_sort(F.collect_list(feature)), ",").alias("f"))
    docs = packed.select("source", F.concat(F.lit('{"features":['), "f", F.lit("]}")).alias("value"))
    pinned = docs.select("source", F.sha2(F.concat("value", F.when(F.col("source") % 4 == 3, " ").otherwise("")), 256).alias("sha"))
    found = readers.hydro_candidates(docs, pinned, -2.0, 50.5, 3.0, 53.0, 6)
    return found.select("source", "kind", "name", "rank", F.size(F.flatten("parts")).alias("points"), F.when(F.col("kind") == "river", F.round("inside", 6)).alias("inside"))


@query("o1_28_manifest_heads", "select c_custkey as source, c_name as title, c_mktsegment as format_id from customer")
def manifest_heads(t):
    value = F.to_json(F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("format_id"), F.array_repeat(F.lit("x"), 20).alias("big")))
    return readers.manifest_heads(t("customer").select(F.col("c_custkey").alias("source"), value.alias("value")), ("title", "format_id"))


@query("o1_29_canonical_json", """select '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' as value from nation""")
def canonical_json(t):
    return writers.canonical_json(t("nation"), ["n_nationkey"])


@query("o1_30_checksum_lines", "select sha256(html) || '  p/' || page_id as value from pages")
def checksum_lines(t):
    files = t("pages").select(F.concat(F.lit("/root/out.d/p/"), S("page_id")).alias("path"), F.sha2("html", 256).alias("sha"))
    return writers.checksum_lines(files, "out.d")


@query("o1_31_markdown_report", "select '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' as value from nation")
def markdown_report(t):
    return writers.markdown(t("nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("o1_32_snapshot_merge", """with e as (select l_orderkey as id, arg_max(l_quantity, (l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100) * 100 + l_quantity) as q, count(*) as copies from lineitem group by 1),
v as (select w.way_id as id, count(*) as vertices, min(n.lat) as south from fx_way_node w join fx_node n on n.node_id = w.node_id where n.node_id % 50 <> 0 group by 1) select e.id, q, copies, vertices, south from e left join v on v.id = e.id""")
def snapshot_merge(t):
    """Ways that several snapshots hold, the last one of each; their nodes, of which some aren't there, give the geometry."""
    e = t("lineitem").select(F.lit("way").alias("type"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("q"), ((F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100) * 100 + F.col("l_quantity")).alias("seq"))
    refs = t("fx_way_node").groupBy(F.col("way_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("nodes"))
    g = readers.hydrated(refs, t("fx_node").where("node_id % 50 <> 0").withColumnRenamed("node_id", "id")).select(F.col("way_id").alias("id"), F.size("geometry").cast("long").alias("vertices"), F.array_min(F.transform("geometry", lambda p: p["lat"])).alias("south"))
    counts = e.groupBy("id").agg(F.count("*").alias("copies"))
    return readers.last_elements(e, "seq").join(counts, "id").join(g, "id", "left").select("id", "q", "copies", "vertices", "south")
