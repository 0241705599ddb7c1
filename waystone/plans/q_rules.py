"""Queries of classification rules and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waystone.functions import extent, geo, rail, tags, text
from waystone.operators import rollups
from waystone.operators.ranks import global_position
from waystone.plans.registry import query

KEYS = {"highway": "highway", "construction": "construction", "railway": "railway", "abandoned": "abandoned", "razed_railway": "razed:railway", "nature": "natural", "waterway": "waterway", "landuse": "landuse", "leisure": "leisure", "building": "building", "historic": "historic", "amenity": "amenity", "name": "name", "boundary": "boundary", "lanes": "lanes", "width": "width", "bridge": "bridge", "tunnel": "tunnel", "covered": "covered", "location": "location", "access": "access", "service": "service", "level": "level"}


def tag_map(without: tuple[str, ...] = ()) -> Column:
    """The columns of fx_tagged as a tag map, absent tags left out."""
    every = F.create_map(*[x for column, key in KEYS.items() if column not in without for x in (F.lit(key), F.col(column))])
    return F.map_filter(every, lambda k, v: v.isNotNull())


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_road_layer(x: str) -> str:
    return "case " + " ".join(f"when {x} in {sql_list(v)} then '{k}'" for k, v in tags.ROADS.items()) + " end"


ROAD = f"""case when lower(coalesce(highway, '')) = 'construction' then coalesce({sql_road_layer("lower(coalesce(construction, ''))")}, 'roads_other')
 when {sql_road_layer("lower(coalesce(highway, ''))")} is not null then {sql_road_layer("lower(coalesce(highway, ''))")}
 when lower(coalesce(highway, '')) not in {sql_list([*tags.INACTIVE_ROADS, *tags.NO_ROUTE, *tags.PLACEHOLDERS, ""])} then 'roads_other' end"""
FALSE = sql_list(tags.FALSE)
DEAD_RAIL = f"(coalesce(abandoned, '') not in {FALSE} or coalesce(construction, '') not in {FALSE} or (coalesce(razed_railway, '') not in {FALSE} and razed_railway in ('yes', coalesce(railway, ''))))"
LIVE_RAIL = f"(coalesce(railway, '') in {sql_list(tags.RAILWAYS)} and not {DEAD_RAIL})"
LAYER = f"""coalesce({ROAD}, case when nature = 'water' or waterway = 'riverbank' or landuse = 'reservoir' then 'water_areas'
 when waterway = 'river' or nature = 'coastline' then 'waterways' when leisure = 'park' or landuse = 'forest' or nature = 'wood' then 'green_space'
 when {LIVE_RAIL} then 'railways' when boundary = 'administrative' then 'boundaries' when leisure = 'stadium' then 'buildings'
 when building is not null and building <> 'no' then 'buildings'
 when building is null and historic = 'castle' and name is not null then 'buildings' end)"""


@query("o2_1_primary_layer", f"select way_id, {LAYER} as layer from fx_tagged")
def primary_layer(t):
    return t("fx_tagged").select("way_id", tags.layer(tag_map()).alias("layer"))


@query("o2_2_every_layer", f"""with x as (select way_id, {LAYER} as first, {LIVE_RAIL} as rail from fx_tagged)
select way_id, first as layer from x where first is not null union all select way_id, 'railways' as layer from x where rail and coalesce(first, '') <> 'railways'""")
def every_layer(t):
    return t("fx_tagged").select("way_id", F.explode(tags.layers(tag_map())).alias("layer"))


@query("o2_3_road_class", f"""select way_id, {ROAD} as road_class, case when lower(coalesce(highway, '')) <> 'construction' then lower(coalesce(highway, ''))
 when construction = 'secondary' then 'secondary' else 'road' end as effective from fx_tagged""")
def road_class(t):
    return t("fx_tagged").select("way_id", tags.road_layer(tag_map()).alias("road_class"), tags.effective_road(tag_map()).alias("effective"))


@query("o2_4_rail_lifecycle", f"select way_id, {DEAD_RAIL} as inactive, case when coalesce(railway, '') not in {sql_list(tags.RAILWAYS)} then 'unsupported' when {DEAD_RAIL} then 'lifecycle' else 'selected' end as reason from fx_tagged")
def rail_lifecycle(t):
    dead = tags.inactive_railway(tag_map())
    reason = F.when(~F.coalesce(F.col("railway"), F.lit("")).isin(*tags.RAILWAYS), "unsupported").when(dead, "lifecycle").otherwise("selected")
    return t("fx_tagged").select("way_id", dead.alias("inactive"), reason.alias("reason"))


@query("o2_5_landmark_identity", "select way_id, name is not null as identified, building is null and historic = 'castle' as heritage_site from fx_tagged where historic is not null")
def landmark_identity(t):
    return t("fx_tagged").where("historic is not null").select("way_id", tags.identified(tag_map()).alias("identified"), tags.heritage_site(tag_map()).alias("heritage_site"))


ROLE = """case when building = 'cathedral' then case when area_mm2 + 1e-9 >= 0.75 then 'cathedral' end
 when (coalesce(building, 'no') <> 'no' and historic in ('castle', 'monument')) or (building is null and historic = 'castle' and name is not null) then case when area_mm2 + 1e-9 >= 0.75 and name is not null then 'heritage' end
 when coalesce(building, 'no') <> 'no' and amenity = 'place_of_worship' then case when area_mm2 + 1e-9 >= case when name is not null then 0.75 else 2.0 end then 'worship' end
 when building = 'university' then case when area_mm2 + 1e-9 >= case when name is not null then 1.5 else 3.0 end then 'university' end
 when leisure = 'stadium' then case when area_mm2 + 1e-9 >= case when coalesce(building, 'no') <> 'no' then 1.5 else 6.0 end then 'stadium' end
 when coalesce(building, 'no') <> 'no' and amenity = 'library' then case when area_mm2 + 1e-9 >= 1.5 and name is not null then 'civic' end
 when coalesce(building, 'no') <> 'no' and amenity = 'hospital' then case when area_mm2 + 1e-9 >= 3.0 and name is not null then 'health' end end"""


@query("o2_6_building_role", f"""with r as (select way_id, name, {ROLE} as role from fx_tagged)
select way_id, role, case role when 'cathedral' then 8 when 'heritage' then 7 when 'stadium' then 7 when 'university' then 6 when 'worship' then 5 when 'civic' then 4 when 'health' then 3 end + case when name is null then 0 else 1 end as rank from r where role is not null""")
def building_role(t):
    found = tags.building_role(tag_map(without=("construction", "abandoned")), F.col("area_mm2"))
    return t("fx_tagged").select("way_id", found.alias("r")).where("r is not null").select("way_id", "r.role", "r.rank")


RANK = """case replace(e, '_link', '') when 'motorway' then 6 when 'secondary' then 4 when 'tertiary' then 4 when 'residential' then 3 when 'living_street' then 2 when 'road' then 2 when 'service' then 2 when 'pedestrian' then 2 else 1 end"""


@query("o2_7_road_rank", f"""with x as (select way_id, lanes, width, case when lower(highway) = 'construction' then case when construction = 'secondary' then 'secondary' else 'road' end else lower(highway) end as e from fx_tagged where highway is not null),
y as (select way_id, case when e like '%!_link' escape '!' then greatest(1, {RANK} - 1) else {RANK} end as r, case lanes when '2' then 2 when '4;5' then 5 when '7' then 7 end as n,
 case width when '13,5 m' then 13.5 when '70''' then 70 * 0.3048 when '6' then 6.0 end as w from x)
select way_id, cast(case when w >= 20 or n >= 6 then greatest(r, 6) when w >= 13 or n >= 4 then greatest(r, 5) else r end as integer) as rank from y""")
def road_rank(t):
    return t("fx_tagged").where("highway is not null").select("way_id", tags.road_rank(tag_map()).alias("rank"))


@query("o2_8_detail_target", f"""with x as (select *, {ROAD} as road from fx_tagged where highway is not null)
select way_id, case when access = 'private' then null
 when road = 'paths' then case highway when 'pedestrian' then case when name is not null or length_mm >= 3 then 'roads_local' end
   when 'footway' then case when bridge = 'yes' then case when length_mm >= 1 then 'paths' end when (name is not null and length_mm >= 1.2) or length_mm >= 6 then 'paths' end
   when 'cycleway' then case when (name is not null and length_mm >= 1) or length_mm >= 4 then 'paths' end when 'track' then case when (name is not null and length_mm >= 1.5) or length_mm >= 6 then 'paths' end end
 when highway = 'service' then case when service = 'driveway' then null when (name is not null and length_mm >= 1) or (service is null and length_mm >= 4) then 'roads_other' end
 when road = 'roads_other' and length_mm < 1 then null else road end as target from x""")
def detail_target(t):
    return t("fx_tagged").where("highway is not null").select("way_id", tags.detail_target(tags.road_layer(tag_map()), tag_map(), F.col("length_mm")).alias("target"))


@query("o2_9_road_exclusion", f"""select way_id, case when way_id % 41 = 0 then 'unsupported_type' when lower(highway) in ('construction', 'proposed', 'planned') then 'construction_or_proposed'
 when lower(highway) in {sql_list(tags.INACTIVE_ROADS)} then 'inactive_lifecycle' when lower(highway) in {sql_list(tags.NO_ROUTE)} then 'known_non_route' when lower(highway) in ('no', 'yes') then 'placeholder'
 when way_id % 43 = 0 then 'missing_geometry' when area_mm2 >= 3 then 'outside_frame' end as reason from fx_tagged where highway is not null""")
def road_exclusion(t):
    kind = F.when(F.col("way_id") % 41 == 0, "relation").otherwise("way")
    return t("fx_tagged").where("highway is not null").select("way_id", tags.road_exclusion(tag_map(), kind, F.when(F.col("way_id") % 43 == 0, "missing_geometry"), F.col("area_mm2") < 3).alias("reason"))


@query("o2_10_timing_exclusion", """with x as (select o_orderkey, case when o_orderkey % 50 = 0 then '' else cast(o_orderkey % 10 as varchar) || 'A0' || (o_orderkey % 7) end as tid,
 case o_orderkey % 4 when 0 then 'Hilltop T.M.D' when 1 then 'Carriage  Sidings' else 'Central' end as origin from orders)
select o_orderkey as k, case when tid = '' then 'blank-tid' when substr(tid, 1, 1) = '5' then 'empty-coaching-stock-class' when substr(tid, 1, 1) in ('4', '6', '7') then 'freight-train-class'
 when substr(tid, 1, 1) not in ('1', '2') then 'unsupported-train-class' when origin <> 'Central' then 'depot-endpoint' end as reason from x""")
def timing_exclusion(t):
    k = F.col("o_orderkey")
    tid = F.when(k % 50 == 0, "").otherwise(F.concat((k % 10).cast("string"), F.lit("A0"), (k % 7).cast("string")))
    origin = F.when(k % 4 == 0, "Hilltop T.M.D").when(k % 4 == 1, "Carriage  Sidings").otherwise("Central")
    return t("orders").select(k.alias("k"), rail.timing_exclusion(tid, origin, F.lit("Central")).alias("reason"))


@query("o2_11_passenger_trains", """with x as (select o_orderkey as k, case o_orderstatus when 'F' then 'P' when 'O' then '1' else case when o_orderkey % 2 = 0 then 'B' else '' end end as s, case o_orderkey % 5 when 0 then 'BR' when 1 then 'EE' else 'OO' end as c from orders)
select k, case when s = 'B' then 'bus-train-status:B' when s = '' then 'non-passenger-train-status:blank' when c = 'BR' then 'bus-train-category:BR' when c = 'EE' then 'empty-coaching-stock:EE' end as reason from x""")
def passenger_trains(t):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "P").when(F.col("o_orderstatus") == "O", "1").when(k % 2 == 0, "B").otherwise("")
    return t("orders").select(k.alias("k"), rail.passenger_exclusion(status, F.when(k % 5 == 0, "BR").when(k % 5 == 1, "EE").otherwise("OO")).alias("reason"))


@query("o2_12_runs_on_date", """with x as (select uid, src_line, runs_from, runs_to, case src_line % 3 when 0 then '1111100' when 1 then '0000011' else '1010101' end as mask,
 case src_line % 4 when 0 then 'EWD' when 1 then 'SO' when 2 then 'MTHO' else 'WX' end as tokens from fx_schedule)
select uid, src_line, date '1995-06-15' between runs_from and runs_to and substr(mask, 4, 1) = '1' as by_mask, date '1995-06-15' between runs_from and runs_to and tokens in ('EWD', 'MTHO', 'WX') as by_tokens from x""")
def runs_on_date(t):
    day, k = F.lit("1995-06-15").cast("date"), F.col("src_line")
    mask = F.when(k % 3 == 0, "1111100").when(k % 3 == 1, "0000011").otherwise("1010101")
    tokens = F.when(k % 4 == 0, "EWD").when(k % 4 == 1, "SO").when(k % 4 == 2, "MTHO").otherwise("WX")
    token = day.between(F.col("runs_from"), F.col("runs_to")) & F.array_contains(rail.token_days(tokens), F.weekday(day))
    return t("fx_schedule").select("uid", "src_line", rail.runs_on(day, F.col("runs_from"), F.col("runs_to"), mask).alias("by_mask"), token.alias("by_tokens"))


@query("o2_13_member_roles", "select role_class, count(*) as members from (select case when role = 'platform' then 'support' else 'alignment' end as role_class from fx_rel_member) x group by 1")
def member_roles(t):
    return t("fx_rel_member").groupBy(tags.member_role(F.col("role")).alias("role_class")).agg(F.count("*").alias("members"))


@query("o2_14_water_and_landcover", """select way_id, case when waterway = 'river' then 'river' when nature = 'water' then 'lake' when waterway = 'riverbank' then 'river_area' when landuse = 'reservoir' then 'reservoir' when nature = 'coastline' then 'coast' end as water,
 case when nature = 'wood' or landuse = 'forest' then 'wood' when leisure = 'park' then 'park' end as landcover from fx_tagged""")
def water_and_landcover(t):
    return t("fx_tagged").select("way_id", tags.water_class(tag_map()).alias("water"), tags.landcover_class(tag_map()).alias("landcover"))


@query("o2_15_pit_members", "select relation_id, pos, lower(role) = 'pit' or way_id % 9 = 0 as pit from fx_rel_member")
def pit_members(t):
    name = F.when(F.col("way_id") % 9 == 0, "Old Pit-Lane").when(F.col("way_id") % 9 == 1, "Pitt Street").otherwise("main")
    return t("fx_rel_member").select("relation_id", "pos", tags.pit_member(F.col("role"), name).alias("pit"))


@query("o2_16_underground_water", """select way_id, concat_ws(';', case when tunnel in ('yes', 'culvert') then 'tunnel=' || tunnel end, case when covered = 'yes' then 'covered=yes' end, case when location = 'underground' then 'location=underground' end) as reasons from fx_tagged where waterway is not null""")
def underground_water(t):
    return t("fx_tagged").where("waterway is not null").select("way_id", F.array_join(tags.underground_reasons(tag_map()), ";").alias("reasons"))


@query("o2_17_explicit_elevation", "select feature_id, native_ele is not null and source_id <> 'src0' as explicit, native_ele is null and source_id = 'src0' as inferred from fx_elevation")
def explicit_elevation(t):
    claim = tags.elevation_claim(F.col("native_ele"), F.col("source_id") != "src0")
    return t("fx_elevation").select("feature_id", (claim == "explicit").alias("explicit"), (claim == "inferred").alias("inferred"))


@query("o2_18_bbox_overlap", """select track_id, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north from fx_track_pt group by track_id
having max(lon) >= -2.5 and min(lon) <= -1.0 and max(lat) >= 51.4 and min(lat) <= 52.6""")
def bbox_overlap(t):
    frame = extent.box(F.lit(-2.5), F.lit(51.4), F.lit(-1.0), F.lit(52.6))
    found = t("fx_track_pt").groupBy("track_id").agg(extent.bounds("lon", "lat").alias("e"))
    return found.where(extent.overlaps(F.col("e"), frame)).select("track_id", "e.west", "e.south", "e.east", "e.north")


@query("o2_19_bbox_algebra", """with b as (select track_id, min(lon) as w, min(lat) as s, max(lon) as e, max(lat) as n from fx_track_pt group by track_id),
m as (select *, (w + e) / 2 as cx, (s + n) / 2 as cy, 6371008.8 * radians(e - w) * cos(radians((s + n) / 2)) as wm, 6371008.8 * radians(n - s) as hm from b),
x as (select *, 20000 / 6371008.8 * 180 / pi() as dy, (e - w) * case when wm / hm < 1.5 then 1.5 / (wm / hm) else 1 end as ex, (n - s) * case when wm / hm < 1.5 then 1 else wm / hm / 1.5 end as ey, (e - w) * case when wm / hm < 1.5 then 1 else 1.5 / (wm / hm) end as kx, (n - s) * case when wm / hm < 1.5 then wm / hm / 1.5 else 1 end as ky from m)
select track_id, round(cx - (e - w) * 0.6, 9) as pad_west, round(cy + (n - s) * 0.6, 9) as pad_north, round(cx - ex / 2, 9) as expand_west, round(cy + ey / 2, 9) as expand_north, round(cx + kx / 2, 9) as crop_east, round(cy - ky / 2, 9) as crop_south,
 round(w - dy / cos(radians(s)), 9) as around_west, round(greatest(n, s + dy), 9) as union_north, round(wm * hm / 1e6, 6) as area from x""")
def bbox_algebra(t):
    b = t("fx_track_pt").groupBy("track_id").agg(extent.bounds("lon", "lat").alias("e"))
    e = F.col("e")
    pad, wide, narrow, around = extent.padded(e, 0.1), extent.expanded_to(e, 1.5), extent.cropped_to(e, 1.5), extent.around(e["west"], e["south"], 20.0)
    r = lambda c: F.round(c, 9)
    return b.select(
        "track_id", r(pad["west"]).alias("pad_west"), r(pad["north"]).alias("pad_north"), r(wide["west"]).alias("expand_west"), r(wide["north"]).alias("expand_north"),
        r(narrow["east"]).alias("crop_east"), r(narrow["south"]).alias("crop_south"), r(around["west"]).alias("around_west"), r(extent.union(e, around)["north"]).alias("union_north"),
        F.round(extent.area_km2(e), 6).alias("area"),
    )


@query("o2_20_subject_selection", """select n_name as name, c_custkey as subject_id, c_mktsegment as kind, cast(row_number() over (order by c_mktsegment, c_name, c_custkey) as integer) as position
from customer join nation on c_nationkey = n_nationkey where n_regionkey = 3 and c_mktsegment in ('BUILDING', 'MACHINERY')""")
def subject_selection(t):
    chosen = t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(t("nation").where("n_regionkey = 3"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = chosen.select(F.col("n_name").alias("name"), F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("kind"), "c_name")
    return global_position(named, ["kind", "c_name", "subject_id"], "position").drop("c_name")


@query("o2_21_season_partition", """select o_orderkey as event_id, o_orderstatus <> 'P' and o_totalprice > 50000 as renderable,
 concat_ws(';', case when o_orderstatus = 'P' then 'not-confirmed' end, case when o_totalprice <= 50000 then 'no-geometry' end) as hold from orders where year(o_orderdate) = 1995""")
def season_partition(t):
    season = t("orders").where(F.year("o_orderdate") == 1995).withColumnRenamed("o_orderkey", "event_id")
    held = rollups.held_events(season, {"not-confirmed": F.col("o_orderstatus") == "P", "no-geometry": F.col("o_totalprice") <= 50000})
    return held.select("event_id", "renderable", "hold")


@query("o2_22_drawable_gate", "select stroke_id, layer, length_mm >= greatest(0.5, 3 * case pen when 'O' then 0.3 else 4.0 end) and (layer <> 'A' or length_mm >= power(2 * case pen when 'O' then 0.3 else 4.0 end, 2)) as drawable from fx_stroke")
def drawable_gate(t):
    nib = F.when(F.col("pen") == "O", 0.3).otherwise(4.0)
    fits = geo.drawable(F.col("length_mm"), nib, F.col("length_mm"), F.col("layer") == "A")
    return t("fx_stroke").select("stroke_id", "layer", fits.alias("drawable"))


@query("o3_13_level_and_grade", """select way_id, l as level, '0/' || l || '/' || case when bridge = 'yes' then 'yes' else 'no' end || '/' || case when tunnel in ('yes', 'culvert') then tunnel else 'no' end || '/' || case when covered = 'yes' then 'yes' else 'no' end || '/no' as grade
from (select *, case level when '1' then '1' when '-1.50' then '-1.5' when '0.0' then '0' when '0;1' then '0;1' when ' 2 ' then '2' else '0' end as l from fx_tagged) x""")
def level_and_grade(t):
    level = text.level_key(F.col("level"))
    return t("fx_tagged").select("way_id", level.alias("level"), tags.grade(tag_map(), level).alias("grade"))


@query("o5_1_highway_coverage", f"""with x as (select lower(highway) as v, {ROAD} as road, case when lower(highway) = 'construction' then coalesce(construction, '<missing>') end as target from fx_tagged where highway is not null)
select coalesce(road, '<excluded>') as layer, v as value, count(*) as ways, cast(sum(case when target is not null then 1 else 0 end) as bigint) as in_construction from x group by grouping sets ((layer, value), (layer), ())""")
def highway_coverage(t):
    x = t("fx_tagged").where("highway is not null").select(F.lower("highway").alias("value"), F.coalesce(tags.road_layer(tag_map()), F.lit("<excluded>")).alias("layer"))
    return x.rollup("layer", "value").agg(F.count("*").alias("ways"), F.count_if(F.col("value") == "construction").alias("in_construction"))
