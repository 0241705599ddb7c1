"""Typed readers. Each takes rows of text (value, and file or line where order matters), so that spark.read.text,
spark.read.json and tables of messages serve alike; *_files functions read paths. Malformed input becomes a row of a reject
table or a null, never an exception in a task."""

from __future__ import annotations

import hashlib
import re

from pyspark import RDD
from pyspark.serializers import NoOpSerializer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waystone.functions import text
from waystone.functions.geo import clip_parameters, haversine_m
from waystone.operators.ranks import running_count
from waystone.operators.storage import settled, union_all
from waystone.operators.tracks import verification

#: Bytes of a file that is read whole at most, and of a piece of a longer one.
WHOLE, PIECE = 1 << 24, 1 << 18
POINT = "struct<lat:double,lon:double>"
ELEMENT = f"struct<type:string,id:bigint,version:int,timestamp:string,tags:map<string,string>,nodes:array<bigint>,geometry:array<{POINT}>,members:array<struct<type:string,ref:bigint,role:string>>>"
TRACK_POINT = "struct<_lat:double,_lon:double,ele:double,time:string>"
GPX = f"trk array<struct<name:string,trkseg:array<struct<trkpt:array<{TRACK_POINT}>>>>>, rte array<struct<rtept:array<{TRACK_POINT}>>>"
TCX = "Lap array<struct<Track:array<struct<Trackpoint:array<struct<Time:string,AltitudeMeters:double,DistanceMeters:double,Position:struct<LatitudeDegrees:double,LongitudeDegrees:double>,HeartRateBpm:struct<Value:int>>>>>>>"


def elements(documents: DataFrame) -> DataFrame:
    """Map elements of JSON documents (source, value): one row each, source kept. A document without an `elements` array gives
    one row with problem set."""
    parsed = documents.select("source", F.from_json("value", f"elements array<{ELEMENT}>").alias("d"))
    good = parsed.where("d.elements is not null").select("source", F.explode("d.elements").alias("e")).select("source", "e.*").withColumn("problem", F.lit(None).cast("string"))
    columns = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("source", "problem") else F.col(f.name) for f in good.schema.fields]
    bad = parsed.where("d.elements is null").withColumn("problem", F.lit("no-elements")).select(*columns)
    return good.unionByName(bad)


def element_vertices(found: DataFrame) -> DataFrame:
    """Vertices of way elements with inline geometry: type, id, pos, lat, lon."""
    return found.where("geometry is not null").select("type", "id", F.posexplode("geometry").alias("pos", "p")).select("type", "id", "pos", "p.lat", "p.lon")


def element_members(found: DataFrame) -> DataFrame:
    return found.where("members is not null").select("id", F.posexplode("members").alias("pos", "m")).select("id", "pos", F.col("m.type").alias("member_type"), "m.ref", "m.role")


def last_elements(found: DataFrame, order: str) -> DataFrame:
    """The last copy of each (type, id) by an order column: snapshots merged."""
    rest = [c for c in found.columns if c not in ("type", "id")]
    return found.groupBy("type", "id").agg(F.max_by(F.struct(*rest), order).alias("e")).select("type", "id", "e.*")


def hydrated(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coordinates of ways (id, nodes) from node rows (id, lat, lon) in order; nodes that are missing are skipped."""
    refs = ways.select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "node_id"))
    met = refs.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    return met.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("geometry"))


def complete_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways (way_id, nodes) whose nodes are all known, with their envelope: a missing node rejects the way."""
    refs = ways.select("way_id", F.explode("nodes").alias("node_id"))
    met = refs.join(nodes.select("node_id", "lon", "lat"), "node_id", "left")
    out = met.groupBy("way_id").agg(F.count("*").alias("n"), F.count_if(F.col("lon").isNull()).alias("missing"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    return out.where("missing = 0").drop("missing")


def gpx_points(documents: DataFrame) -> DataFrame:
    """Points of GPX documents (source, value): segments in order (routes after tracks), never bridged."""
    d = documents.select("source", F.from_xml("value", GPX).alias("d"))
    tracks = F.flatten(F.transform(F.coalesce("d.trk", F.array().cast("array<struct<name:string,trkseg:array<struct<trkpt:array<" + TRACK_POINT + ">>>>>")), lambda t: F.transform(F.coalesce(t["trkseg"], F.array().cast("array<struct<trkpt:array<" + TRACK_POINT + ">>>")), lambda s: s["trkpt"])))
    routes = F.transform(F.coalesce("d.rte", F.array().cast("array<struct<rtept:array<" + TRACK_POINT + ">>>")), lambda r: r["rtept"])
    segments = d.select("source", F.posexplode(F.concat(tracks, routes)).alias("seg", "points"))
    return segments.select("source", "seg", F.posexplode("points").alias("pos", "p")).select("source", "seg", "pos", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), "p.ele", F.col("p.time").try_cast("timestamp").alias("time"))


def malformed(documents: DataFrame) -> DataFrame:
    """Documents (source, value) that aren't well-formed XML: source, problem. Readers give no rows of them."""
    parsed = F.from_xml("value", "_corrupt_record string", {"mode": "PERMISSIVE"})
    bad = F.col("value").isNull() | ~F.coalesce(F.trim("value").startswith("<"), F.lit(False)) | parsed["_corrupt_record"].isNotNull()
    return documents.where(bad).select("source", F.lit("malformed").alias("problem"))


def malformed_json(documents: DataFrame) -> DataFrame:
    """Documents (source, value) that aren't JSON objects: source, problem. Readers give no rows of them."""
    parsed = F.from_json("value", "_corrupt_record string, type string")
    bad = F.col("value").isNull() | ~F.coalesce(F.trim("value").startswith("{"), F.lit(False)) | parsed["_corrupt_record"].isNotNull()
    return documents.where(bad).select("source", F.lit("malformed").alias("problem"))


def track_rejects(documents: DataFrame, points: DataFrame, line: list[str]) -> DataFrame:
    """Why documents give no track, of XML documents and the points (source, line, lat, lon) read from them: malformed, bad-point (a
    point without a usable position) or no-line (no line of two points or more). source, problem."""
    broken = malformed(documents)
    rest = documents.select("source").join(broken.select("source"), "source", "left_anti")
    lines = points.groupBy("source", *line).agg(F.count("*").alias("n"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("bad"))
    told = lines.groupBy("source").agg(F.max("n").alias("n"), F.sum("bad").alias("bad"))
    problem = F.when(F.col("bad") > 0, "bad-point").when(F.coalesce("n", F.lit(0)) < 2, "no-line")
    return rest.join(told, "source", "left").select("source", problem.alias("problem")).where("problem is not null").unionByName(broken)


def kml_points(documents: DataFrame) -> DataFrame:
    """Vertices of every LineString of two or more in KML documents (source, value); tags may have attributes and a namespace
    prefix. A LineString without coordinates, or whose text has under two positions, is no line; a position that can't be read
    has null coordinates."""
    name = r"(?:[A-Za-z_][\w.-]*:)?"
    inside = lambda tag: rf"(?s)<{name}{tag}(?:\s[^>]*)?(?<!/)>(.*?)</{name}{tag}\s*>"
    lines = documents.select("source", F.posexplode(F.regexp_extract_all("value", F.lit(inside("LineString")), 1)).alias("line", "e"))
    text = F.trim(F.regexp_replace(F.regexp_extract("e", inside("coordinates"), 1), r"\s+", " "))
    tokens = F.filter(F.split(text, " "), lambda t: F.instr(t, ",") > 0)
    points = lines.withColumn("t", tokens).where(F.size("t") >= 2).select("source", "line", F.posexplode("t").alias("pos", "t")).withColumn("p", F.split("t", ","))
    number = lambda i: F.try_element_at("p", F.lit(i)).try_cast("double")
    return points.select("source", "line", "pos", number(1).alias("lon"), number(2).alias("lat"), number(3).alias("ele"))


def tcx_points(activities: DataFrame) -> DataFrame:
    """Trackpoints of TCX activities (source, value: one Activity element), laps numbered from 0."""
    d = activities.select("source", F.from_xml("value", TCX).alias("d")).select("source", F.posexplode("d.Lap").alias("lap", "l"))
    tracks = d.select("source", "lap", F.posexplode("l.Track").alias("seg", "t")).select("source", "lap", "seg", F.posexplode("t.Trackpoint").alias("pos", "p"))
    return tracks.select("source", "lap", "seg", "pos", F.col("p.Position.LatitudeDegrees").alias("lat"), F.col("p.Position.LongitudeDegrees").alias("lon"), F.col("p.AltitudeMeters").alias("ele"), F.col("p.DistanceMeters").alias("distance_m"), F.col("p.HeartRateBpm.Value").alias("heart_rate"), F.col("p.Time").try_cast("timestamp").alias("time"))


def geojson_lines(documents: DataFrame, rounds: int = 64) -> DataFrame:
    """Lines of GeoJSON (source, value) under any nesting of features and collections: source, path, line, coordinates.

    Nesting is opened level by level until nothing is closed; each level is settled, so no level is parsed twice. Raises
    where rounds don't suffice."""
    parsed = lambda value: F.from_json(value, "type string, coordinates string, geometry string, features array<string>, geometries array<string>")
    level = documents.select("source", parsed("value").alias("g"), F.lit("").alias("path"))
    found = []
    for _ in range(rounds):
        level = settled(level)
        if level.isEmpty():
            return union_all(found)
        one = level.where("g.type = 'LineString'").select("source", "path", F.lit(0).alias("line"), F.from_json("g.coordinates", "array<array<double>>").alias("coordinates"))
        many = level.where("g.type = 'MultiLineString'").select("source", "path", F.posexplode(F.from_json("g.coordinates", "array<array<array<double>>>")).alias("line", "coordinates"))
        found += [one, many]
        inside = F.when(F.col("g.type") == "Feature", F.array("g.geometry")).when(F.col("g.type").isin("FeatureCollection", "GeometryCollection"), F.coalesce("g.features", "g.geometries"))
        opened = level.select("source", "path", F.posexplode(inside).alias("i", "v")).where("v is not null")
        level = opened.select("source", parsed("v").alias("g"), F.concat("path", F.lit("/"), F.col("i").cast("string")).alias("path"))
    raise RuntimeError("geojson_lines: nested deeper than the rounds")


def geojson_features(documents: DataFrame, properties: str) -> DataFrame:
    """Features of GeoJSON feature collections (source, value): source, pos, kind, the stated properties (a DDL string) and
    geometry as text; problem where a feature has no geometry of points. A document without features gives one row with a
    problem."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    parsed = documents.select("source", F.from_json("value", schema).alias("d"))
    good = parsed.where("d.features is not null").select("source", F.posexplode("d.features").alias("pos", "f"))
    problem = F.when(F.col("f.geometry.coordinates").isNull() | (F.length("f.geometry.coordinates") < 5), "no-geometry")
    good = good.select("source", "pos", F.col("f.geometry.type").alias("kind"), F.col("f.properties").alias("properties"), F.col("f.geometry.coordinates").alias("coordinates"), problem.alias("problem"))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema.fields} | {"source": F.col("source"), "problem": F.lit("no-features").alias("problem")}
    return good.unionByName(parsed.where("d.features is null").select(*empty.values()))


def verified(documents: DataFrame, pinned: DataFrame) -> DataFrame:
    """Documents (source, value) whose content has the digest that a manifest (source, sha) pins; others are left out. The
    digests alone are joined back to the rows that they stand in."""
    return documents.withColumn("sha", F.sha2("value", 256)).join(pinned.select("source", "sha"), ["source", "sha"], "left_semi").drop("sha")


def contour_lines(documents: DataFrame, interval: int) -> tuple[DataFrame, DataFrame]:
    """Contours of GeoJSON documents: source, pos, level, importance, coordinates; and rejects with their problem: no geometry,
    a kind that is no line, fewer than two points, or a level that isn't a multiple of the interval."""
    rows = geojson_features(documents, "level:double,importance:int")
    points = F.when(F.col("kind") == "LineString", F.from_json("coordinates", "array<array<double>>"))
    rows = rows.withColumn("points", points)
    level = F.col("properties.level")
    problem = F.coalesce(
        "problem",
        F.when(F.coalesce(F.col("kind"), F.lit("")) != "LineString", "not-a-line").when(F.coalesce(F.size("points"), F.lit(0)) < 2, "too-few-points")
        .when(level.isNull() | (level % interval != 0), "level"),
    )
    checked = rows.withColumn("problem", problem)
    good = checked.where("problem is null").select("source", "pos", level.alias("level"), F.col("properties.importance").alias("importance"), F.col("points").alias("coordinates"))
    return good, checked.where("problem is not null").select("source", "pos", "problem")


def hydro_candidates(documents: DataFrame, pinned: DataFrame, west: float, south: float, east: float, north: float, least_rank: int) -> DataFrame:
    """Rivers and lakes of verified GeoJSON documents up to a scale rank: source, pos, kind (river, lake), name, rank, parts (arrays
    of positions: lines, or rings) and inside, the length within the extent in degrees.

    A river, of one line or several, counts where some of its length lies within the extent, whether or not a vertex does; a lake,
    of one polygon or several, only where all of it does, as a shore cut off by the extent would be no shore."""
    rows = geojson_features(verified(documents, pinned), "name:string,scalerank:int,featurecla:string").where("problem is null")
    one, two, three = (F.from_json("coordinates", "array<" * n + "array<double>" + ">" * n) for n in (1, 2, 3))
    what, is_river = F.lower("properties.featurecla"), F.col("kind").isin("LineString", "MultiLineString")
    kind = F.when(is_river & what.startswith("river"), "river").when(F.col("kind").isin("Polygon", "MultiPolygon") & what.startswith("lake"), "lake")
    parts = F.when(F.col("kind") == "LineString", F.array(one)).when(F.col("kind").isin("MultiLineString", "Polygon"), two).when(F.col("kind") == "MultiPolygon", F.flatten(three))
    found = rows.select("source", "pos", kind.alias("what"), F.col("properties.name").alias("name"), F.col("properties.scalerank").alias("rank"), parts.alias("parts"))

    def drawn(a, b):
        t = clip_parameters(a[0], a[1], b[0], b[1], west, south, east, north)
        return F.coalesce(F.hypot(b[0] - a[0], b[1] - a[1]) * (t["t1"] - t["t0"]), F.lit(0.0))

    legs = lambda part: F.zip_with(F.slice(part, 1, F.size(part) - 1), F.slice(part, 2, F.size(part) - 1), drawn)
    total = F.aggregate(F.flatten(F.transform(F.filter("parts", lambda p: F.size(p) >= 2), legs)), F.lit(0.0), lambda s, m: s + m)
    covered = F.forall(F.flatten("parts"), lambda p: p[0].between(west, east) & p[1].between(south, north))
    known = found.where("what is not null and size(parts) > 0").where(F.col("rank") <= least_rank).withColumn("inside", total)
    return known.where(F.when(F.col("what") == "river", F.col("inside") > 0).otherwise(covered)).withColumnRenamed("what", "kind")


def nodes_of_ways(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes (node_id, ..) that chosen ways (way_id) refer to in way_nodes (way_id, node_id), once each."""
    return nodes.join(way_nodes.join(ways.select("way_id"), "way_id", "left_semi").select("node_id"), "node_id", "left_semi")


def named_rail_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, tags) with a railway and a name, of no past or future kind: node_id, name."""
    gone = F.array(*[F.lit(w) for w in ("abandoned", "disused", "razed", "demolished", "proposed", "construction")])
    dead = F.exists(F.map_keys("tags"), lambda k: F.array_contains(gone, k) | F.array_contains(gone, F.substring_index(k, ":", 1)))
    return nodes.where(F.col("tags")["railway"].isNotNull() & F.col("tags")["name"].isNotNull() & ~dead).select("node_id", F.col("tags")["name"].alias("name"))


def operator_relations(relations: DataFrame, codes: list[str]) -> DataFrame:
    """Relations (relation, operator: `;`-joined text) that name operators of a list: the code where it is one, else null and
    ambiguous. Other tokens don't count."""
    tokens = relations.select("relation", F.explode(F.transform(F.split("operator", ";"), lambda x: F.trim(x))).alias("token"))
    one = F.countDistinct("token") == 1
    return tokens.where(F.col("token").isin(*codes)).groupBy("relation").agg(F.when(one, F.min("token")).alias("code"), (~one).alias("ambiguous"))


def coastline_ways(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Vertices (way_id, pos, node_id, lon, lat) of coastline ways (way_id, tags) that have a node inside a bound; a node that
    isn't there has null coordinates."""
    coast = way_nodes.join(ways.where(F.col("tags")["natural"] == "coastline").select("way_id"), "way_id", "left_semi")
    met = coast.join(nodes.select("node_id", "lon", "lat"), "node_id", "left")
    inside = met.where(F.col("lon").between(west, east) & F.col("lat").between(south, north)).select("way_id").distinct()
    return met.join(inside, "way_id", "left_semi").select("way_id", "pos", "node_id", "lon", "lat")


def ranking_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds of rankings from CSV lines (value): subject_id, ranking, rank, score (may be empty); and rejects."""
    row = F.from_csv("value", "subject_id long, ranking string, rank int, score double, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = lines.select("value", row.alias("r"))
    good = F.col("r._bad").isNull() & F.col("r.subject_id").isNotNull() & (F.col("r.rank") >= 1)
    fine = rows.where(F.coalesce(good, F.lit(False))).select("r.subject_id", "r.ranking", "r.rank", "r.score")
    return fine, rows.where(~F.coalesce(good, F.lit(False))).select("value")


def course_ways(found: DataFrame) -> DataFrame:
    """Member ways of relations among elements(): relation, pos, way, role, a and b (end points as text keys), m (length), and
    n, the vertices; a way that isn't there or has no geometry gives nulls."""
    members = element_members(found.where("type = 'relation'")).where("member_type = 'way'").select(F.col("id").alias("relation"), "pos", F.col("ref").alias("way"), "role")
    leg = lambda p, q: haversine_m(p["lon"], p["lat"], q["lon"], q["lat"])
    g, n = F.col("geometry"), F.size("geometry")
    m = F.aggregate(F.zip_with(F.slice(g, 1, n - 1), F.slice(g, 2, n - 1), leg), F.lit(0.0), lambda s, x: s + x)
    key = lambda p: F.concat_ws(" ", F.round(p["lon"], 7), F.round(p["lat"], 7))
    ways = found.where((F.col("type") == "way") & (n >= 2)).groupBy(F.col("id").alias("way")).agg(F.max_by("geometry", F.coalesce("version", F.lit(0))).alias("geometry"))
    return members.join(ways.select("way", key(F.element_at(g, 1)).alias("a"), key(F.element_at(g, -1)).alias("b"), m.alias("m"), n.alias("n")), "way", "left")


def course_relations(found: DataFrame, official: DataFrame, under: float, over: float) -> DataFrame:
    """Courses of relations among elements(), against official (relation, official_m): parts (members whose ends meet, in
    order), measured_m, missing ways, and the reasons why a course isn't accepted."""
    ways = course_ways(found)
    by = Window.partitionBy("relation").orderBy("pos")
    met = F.arrays_overlap(F.array("a", "b"), F.lag(F.array("a", "b")).over(by))
    placed = ways.where("m is not null").withColumn("new", F.when(F.coalesce(met, F.lit(False)), 0).otherwise(1))
    placed = placed.withColumn("seg", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    lost = ways.groupBy("relation").agg(F.count_if(F.col("m").isNull()).alias("missing"))
    checked = verification(placed.withColumnRenamed("m", "leg_m").join(official, "relation"), F.lit(None).cast("double"), under, over, track="relation", official="official_m")
    return checked.join(lost, "relation").select("relation", "parts", "measured_m", "missing", F.concat("reasons", F.array_compact(F.array(F.when(F.col("missing") > 0, "missing-ways")))).alias("reasons"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: file, line (from 0, in the file's own order), value; empty lines are counted and left out.

    A file is read in splits by as many tasks as it has; rows of a split come in order, so a line's number is its place in its split
    and the lines of the splits before. Only one row a split is gathered."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    splits = rows.groupBy("file", "at").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "at", "first", F.coalesce(before, F.lit(0)).alias("before"))
    line = F.col("row") - F.col("first") + F.col("before")
    return rows.join(splits, ["file", "at"]).where("value <> ''").select("file", line.alias("line"), "value")


#: The records of a timetable file, and which of them may come right before each record that has an order.
CIF_KINDS = ("HD", "TI", "TA", "TD", "AA", "BS", "BX", "TN", "LO", "LI", "CR", "LN", "LT", "ZZ")
CIF_BEFORE = {"BX": ("BS",), "TN": ("BS", "BX"), "LO": ("BS", "BX", "TN"), "LI": ("LO", "LI", "CR"), "CR": ("LO", "LI"), "LT": ("LO", "LI", "CR")}
CIF_OPEN = ("LO", "LI", "CR")


def cif_rejects(lines: DataFrame, block: int = 1 << 16) -> DataFrame:
    """What is wrong with the order of records of timetable lines (file, line, value): file, line, problem. unknown-record; no-header
    and no-trailer (line: the first and last one); misplaced-header; after-trailer; misplaced (a record that may not follow the one
    before); unfinished (a schedule without its last call, where the next one begins or the file ends).

    A record is judged by the one before it, found in its block of lines or, for a block's first, among the blocks' last records:
    a file of any size is judged by many tasks."""
    kind = F.substring("value", 1, 2)
    rows = lines.select("file", "line", kind.alias("kind"), F.floor(F.col("line") / block).alias("b"))
    by = Window.partitionBy("file", "b").orderBy("line")
    blocks = rows.groupBy("file", "b").agg(F.max_by("kind", "line").alias("last"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min(F.when(F.col("kind") == "ZZ", F.col("line"))).alias("zz"))
    along = Window.partitionBy("file").orderBy("b")
    ends = F.max("last_line").over(Window.partitionBy("file"))
    blocks = blocks.select("file", "b", F.lag("last").over(along).alias("earlier"), F.min("zz").over(Window.partitionBy("file")).alias("zz"), F.min("first_line").over(Window.partitionBy("file")).alias("first_line"), ends.alias("last_line"))
    met = rows.withColumn("before", F.lag("kind").over(by)).join(blocks, ["file", "b"]).withColumn("before", F.coalesce("before", "earlier"))
    after = F.lit(False)
    for record, allowed in CIF_BEFORE.items():
        after = after | ((F.col("kind") == record) & ~F.coalesce(F.col("before").isin(*allowed), F.lit(False)))
    first, last = F.col("line") == F.col("first_line"), F.col("line") == F.col("last_line")
    unfinished = F.col("kind").isin("BS", "AA", "ZZ") & F.coalesce(F.col("before").isin(*CIF_OPEN), F.lit(False)) | last & F.col("kind").isin(*CIF_OPEN)
    problems = F.array_compact(F.array(
        F.when(~F.col("kind").isin(*CIF_KINDS), "unknown-record"), F.when(first & (F.col("kind") != "HD"), "no-header"), F.when(last & (F.col("kind") != "ZZ"), "no-trailer"),
        F.when(~first & (F.col("kind") == "HD"), "misplaced-header"), F.when(F.col("line") > F.col("zz"), "after-trailer"), F.when(after, "misplaced"), F.when(unfinished, "unfinished"),
    ))
    return met.select("file", "line", F.explode(problems).alias("problem"))


def cif_schedules(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schedules and their calls of fixed-width timetable lines (file, line, value): a BS record opens a schedule, the L
    records after it belong to it. A file is numbered in blocks of lines, so one large file is read by many tasks."""
    part = lambda a, n: F.trim(F.substring("value", a, n))
    kind = F.substring("value", 1, 2)
    placed = running_count(lines.withColumn("kind", kind).withColumn("opens", (kind == "BS").cast("int")), "file", "line", "opens", "schedule")
    numbered_ = placed.drop("opens")
    heads = numbered_.where("kind = 'BS'").select(
        "file", "schedule", part(3, 1).alias("transaction"), part(4, 6).alias("uid"), text.yymmdd(F.substring("value", 10, 6)).alias("runs_from"), text.yymmdd(F.substring("value", 16, 6)).alias("runs_to"),
        F.substring("value", 22, 7).alias("days"), part(30, 1).alias("status"), part(31, 2).alias("category"), part(33, 4).alias("train"), F.substring("value", 80, 1).alias("stp"),
    )
    stops = numbered_.where(F.col("kind").isin("LO", "LI", "LT"))
    arrives, departs = F.when(F.col("kind") != "LO", F.substring("value", 11, 5)), F.when(F.col("kind") == "LO", F.substring("value", 11, 5)).when(F.col("kind") == "LI", F.substring("value", 16, 5))
    order = Window.partitionBy("file", "schedule").orderBy("line")
    calls = stops.select("file", "schedule", (F.row_number().over(order) - 1).alias("pos"), "kind", part(3, 7).alias("location"), text.half_minutes(arrives).alias("arrive"), text.half_minutes(departs).alias("depart"))
    return heads, calls


def station_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Station rows of fixed-width A records (value): name, tiploc, crs, easting, northing (metres), change; and rejects."""
    part = lambda a, n: F.trim(F.substring("value", a, n))
    grid = lambda a: ((F.substring("value", a, 5).try_cast("int") - F.lit(10000 if a == 53 else 60000)) * 100).cast("int")
    rows = lines.where(F.substring("value", 1, 1) == "A").select(F.col("value"), part(6, 26).alias("name"), part(37, 7).alias("tiploc"), part(50, 3).alias("crs"), grid(53).alias("easting"), grid(59).alias("northing"), part(64, 2).try_cast("int").alias("change_minutes"))
    doubled = F.count("*").over(Window.partitionBy("tiploc"))
    checked = rows.withColumn("problem", F.when(F.length("value") < 65, "short").when(~F.col("crs").rlike("^[A-Z]{3}$"), "crs").when(F.col("tiploc") == "", "tiploc").when(doubled > 1, "repeated-tiploc"))
    return checked.where("problem is null").drop("value", "problem"), checked.where("problem is not null").select("value", "problem")


def stop_points(stops: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Active stops of some types from text columns ATCOCode, StopType, Status, Longitude, Latitude; and rejects."""
    lon, lat = F.col("Longitude").try_cast("double"), F.col("Latitude").try_cast("double")
    rows = stops.where(F.upper(F.trim("StopType")).isin(*kinds) & (F.lower(F.trim("Status")) == "active"))
    doubled = F.count("*").over(Window.partitionBy("ATCOCode"))
    checked = rows.withColumns({"lon": lon, "lat": lat}).withColumn("problem", F.when(F.trim("ATCOCode") == "", "no-code").when(doubled > 1, "repeated-code").when(F.col("lon").isNull() != F.col("lat").isNull(), "half-coordinates"))
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null").select("ATCOCode", "problem")


def timing_columns(cells: DataFrame) -> DataFrame:
    """Columns of timetable sheets from cells (book, sheet, col, row, value): the ordered non-blank values of each column."""
    filled = cells.where(F.trim("value") != "")
    return filled.groupBy("book", "sheet", "col").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("values"), F.count("*").alias("n"))


def gtfs(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """A feed's table by header names; columns that the file lacks are null."""
    have = spark.read.csv(f"{folder}/{table}.txt", header=True)
    want = spark.createDataFrame([], schema).schema
    known = {c.strip("﻿").strip(): c for c in have.columns}
    return have.select(*[(F.col(f"`{known[f.name]}`").try_cast(f.dataType.simpleString()) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])


def service_days(calendar: DataFrame, exceptions: DataFrame, day: Column) -> DataFrame:
    """Services active on a day: the weekday rule, then exceptions of that day (1 adds, 2 removes)."""
    weekday = F.element_at(F.array(*[F.col(c) for c in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")]), F.weekday(day) + 1)
    base = calendar.where((weekday == 1) & day.between(F.col("start_date"), F.col("end_date"))).select("service_id")
    that = exceptions.where(F.col("date") == day)
    return base.unionByName(that.where("exception_type = 1").select("service_id")).distinct().join(that.where("exception_type = 2").select("service_id"), "service_id", "left_anti")


def checksum_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (sha, path) of `<64 hex>  <relative path>` lines (value), and rejects with their problem."""
    sha, path = F.regexp_extract("value", "^([0-9a-f]{64})  (.+)$", 1), F.regexp_extract("value", "^([0-9a-f]{64})  (.+)$", 2)
    rows = lines.select("value", sha.alias("sha"), path.alias("path"))
    doubled = F.count("*").over(Window.partitionBy("path"))
    problem = F.when(F.col("sha") == "", "malformed").when(F.col("path").startswith("/"), "absolute").when(F.array_contains(F.split("path", "/"), ".."), "traversal").when(doubled > 1, "repeated")
    checked = rows.withColumn("problem", problem)
    return checked.where("problem is null").select("sha", "path"), checked.where("problem is not null").select("value", "problem")


def artifacts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path with size and SHA-256. A file of more than WHOLE bytes streams through a task by pieces and is never held
    whole, whatever its size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    long_ = files.where(F.col("length") > WHOLE).select("path", "length").collect()
    whole = files.where(F.col("length") <= WHOLE).select("path", "length", F.sha2("content", 256).alias("sha"))
    if not long_:
        return whole
    streams = spark.sparkContext.union([_digest(spark, r["path"], r["length"]) for r in long_])
    return whole.unionByName(spark.createDataFrame(streams, "path string, length long, sha string"))


def _digest(spark: SparkSession, path: str, length: int):
    """An RDD of one row, (path, length, SHA-256), of a file that passes by in pieces of one length, which a task reads in order.

    Readers of such pieces fail at a shorter last one, so they are told to end there; the driver reads that piece alone. A file of
    which more or less passed by than its length says raises. What a name's ending says of compression is passed over."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    hadoop, settings = jvm.org.apache.hadoop.conf.Configuration(context._jsc.hadoopConfiguration()), context._jsc.sc().conf()
    hadoop.set("mapreduce.input.fileinputformat.split.minsize", str(1 << 60))
    place, pieces = jvm.org.apache.hadoop.fs.Path(path), length // PIECE
    stream = place.getFileSystem(hadoop).open(place)
    try:
        stream.seek(pieces * PIECE)
        tail = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length - pieces * PIECE))
    finally:
        stream.close()
    only = re.sub(r"([\\*?\[\]{}^])", r"\\\1", path).replace(",", r"{\,}")  # a pattern, or several by commas, else
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(hadoop).getCodec(place)
    key = "spark.files.ignoreCorruptFiles"
    held = settings.get(key, "false")
    try:
        settings.set(key, "true")
        if codec is None:
            records = RDD(context._jsc.sc().binaryRecords(only, PIECE, hadoop).toJavaRDD(), context, NoOpSerializer())
        else:  # which the faster reader refuses
            plain = {"io.compression.codecs": jvm.org.apache.hadoop.io.compress.PassthroughCodec.CLASSNAME, jvm.org.apache.hadoop.io.compress.PassthroughCodec.OPT_EXTENSION: codec.getDefaultExtension()}
            plain |= {"fixedlengthinputformat.record.length": str(PIECE), "mapreduce.input.fileinputformat.split.minsize": str(1 << 60)}
            names = ("org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable")
            records = context.newAPIHadoopFile(only, *names, conf=plain).values()
    finally:
        settings.set(key, held)

    def digest(parts):
        sha, n = hashlib.sha256(), 0
        for part in parts:
            sha.update(part)
            n += 1
        if n != pieces:
            raise OSError(f"{path}: {n} pieces of {pieces} were read")
        sha.update(tail)
        return [(path, length, sha.hexdigest())]

    return records.mapPartitions(digest)


def html_facts(pages: DataFrame) -> DataFrame:
    """Facts of pages (page_id, html): the title where all titles agree, links, and visible characters."""
    titles = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit("(?s)<title>(.*?)</title>"), 1), lambda t: F.trim(t)))
    visible = F.trim(F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " "))
    return pages.select("page_id", F.when(F.size(titles) == 1, F.element_at(titles, 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a [^>]*href"), 0)).alias("n_links"), F.length(F.regexp_replace(visible, r"\s+", " ")).alias("visible_chars"))


def grid_heads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers of ASCII grids (tile, line, value; lines 0 to 5): one row a tile, and rejects (tile, problem): a header that lacks
    a number, or another cell size than the most frequent one."""
    head = rows.where("line < 6").select("tile", F.lower(F.regexp_extract("value", r"^(\S+)", 1)).alias("k"), F.regexp_extract("value", r"(\S+)\s*$", 1).try_cast("double").alias("v"))
    meta = head.groupBy("tile").pivot("k", ["ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value"]).agg(F.first("v"))
    common = meta.groupBy("cellsize").agg(F.count("*").alias("n")).agg(F.max_by("cellsize", F.struct("n", "cellsize")).alias("common"))
    whole = F.col("ncols").isNotNull() & F.col("nrows").isNotNull() & F.col("xllcorner").isNotNull() & F.col("yllcorner").isNotNull() & F.col("cellsize").isNotNull()
    checked = meta.join(F.broadcast(common), F.lit(True)).withColumn("problem", F.when(~whole, "header").when(F.col("cellsize") != F.col("common"), "cell-size"))  # common is one row
    return checked.where("problem is null").drop("problem", "common"), checked.where("problem is not null").select("tile", "problem")


def ascii_grid(rows: DataFrame) -> DataFrame:
    """Cells of ASCII grids (tile, line, value; lines 0 to 5 are the header): x and y of the cell's corner, z null where there
    is no data. What grid_heads() rejects is left out here."""
    meta = grid_heads(rows)[0]
    body = rows.where("line >= 6").select("tile", (F.col("line") - 6).alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "t"))
    met = body.join(meta, "tile")
    z = F.col("t").try_cast("double")
    return met.select("tile", "row", "col", (F.col("xllcorner") + F.col("col") * F.col("cellsize")).alias("x"), (F.col("yllcorner") + (F.col("nrows") - 1 - F.col("row")) * F.col("cellsize")).alias("y"), F.when(z != F.coalesce("nodata_value", F.lit(-9999.0)), z).alias("z"))


def mosaic(cells: DataFrame, order: str) -> DataFrame:
    """One value per (x, y): of tiles that overlap the last by an order column wins, where it has a value."""
    return cells.where("z is not null").groupBy("x", "y").agg(F.max_by("z", order).alias("z"))


def manifest_heads(documents: DataFrame, fields: tuple[str, ...] = ("title", "subtitle", "subject_id", "format_id", "generated_at")) -> DataFrame:
    """Some top-level fields of large JSON documents (source, value), without parsing the rest into columns."""
    return documents.select("source", *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


def catalog_entries(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subjects and collection entries of versioned catalogs (source, value), and entries whose subject is unknown."""
    schema = "schema_version int, subjects array<struct<id:string,name:string,kind:string,country:string>>, collections array<struct<id:string,entries:array<struct<subject_id:string,position:int>>>>"
    d = documents.select("source", F.from_json("value", schema).alias("d"))
    subjects = d.select("source", F.explode("d.subjects").alias("s")).select("source", "s.*")
    entries = d.select("source", F.explode("d.collections").alias("c")).select("source", F.col("c.id").alias("collection"), F.explode("c.entries").alias("e")).select("source", "collection", "e.subject_id", "e.position")
    unknown = entries.join(subjects.select("source", F.col("id").alias("subject_id")), ["source", "subject_id"], "left_anti")
    return subjects, entries, unknown


def tile_features(features: DataFrame, bounds: tuple[float, float, float, float], extent: int = 4096) -> DataFrame:
    """Vertices of decoded tile features (z, x, y, feature_id, pos, px, py) in degrees, of tiles that meet the bounds."""
    n = F.pow(F.lit(2.0), F.col("z"))
    fx, fy = (F.col("x") + F.col("px") / extent) / n, (F.col("y") + F.col("py") / extent) / n
    lon, lat = fx * 360 - 180, F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * fy))))
    west, south, east, north = bounds
    return features.withColumns({"lon": lon, "lat": lat}).where(F.col("lon").between(west, east) & F.col("lat").between(south, north)).select("z", "x", "y", "feature_id", "pos", "lon", "lat")
