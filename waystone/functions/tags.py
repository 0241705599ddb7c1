"""Rules over tag maps (map<string,string>) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Road vocabularies by layer, and values that are no line of a network.
ROADS = {
    "roads_major": ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"),
    "roads_secondary": ("secondary", "secondary_link", "tertiary", "tertiary_link"),
    "roads_local": ("residential", "living_street", "unclassified", "service", "road"),
    "roads_other": ("busway", "bus_guideway", "escape", "raceway"),
    "paths": ("path", "footway", "cycleway", "bridleway", "steps", "pedestrian", "track", "corridor", "elevator", "ladder", "via_ferrata"),
}
#: Lifecycle words of roads, and objects on roads that are no way to go.
INACTIVE_ROADS = ("abandoned", "demolished", "destroyed", "dismantled", "disused", "planned", "proposed", "razed", "removed")
NO_ROUTE = (
    "bus_stop", "crossing", "cyclist_waiting_aid", "emergency_access_point", "emergency_bay", "give_way", "hitchhiking", "milestone", "mini_roundabout",
    "motorway_junction", "passing_place", "platform", "rest_area", "services", "speed_camera", "speed_display", "stop", "street_lamp", "toll_gantry",
    "traffic_calming", "traffic_island", "traffic_mirror", "traffic_signals", "trailhead", "turning_circle", "turning_loop",
)
PLACEHOLDERS = ("no", "yes")
#: Kinds of railway, and lifecycle words of railways and buildings.
RAILWAYS = ("rail", "light_rail", "tram", "subway", "narrow_gauge", "monorail", "funicular", "preserved", "miniature", "disused")
INACTIVE_RAILWAYS = ("abandoned", "construction", "demolished", "destroyed", "dismantled", "planned", "proposed", "razed", "removed")
INACTIVE_BUILDINGS = ("abandoned", "construction", "demolished", "destroyed", "disused", "proposed", "razed", "removed")
#: What stands for no, and waterways that are lines.
FALSE = ("", "0", "false", "no", "none")
LINEAR_WATER = ("river", "stream", "canal", "drain", "ditch", "tidal_channel")
#: Ranks of roads.
RANKS = {6: ("motorway", "trunk"), 5: ("primary",), 4: ("secondary", "tertiary"), 3: ("residential", "unclassified"), 2: ("living_street", "road", "service", "pedestrian")}


def value(tags: Column, key: str) -> Column:
    """A tag's value, trimmed and in lower case; empty if absent."""
    return F.lower(F.trim(F.coalesce(tags[key], F.lit(""))))


def road_layer_of(highway: Column) -> Column:
    out = F.lit(None).cast("string")
    for layer, values in reversed(ROADS.items()):
        out = F.when(highway.isin(*values), layer).otherwise(out)
    return out


def effective_road(tags: Column) -> Column:
    """The physical road type: construction stands for its target, or for `road` where that is unknown."""
    highway, target = value(tags, "highway"), value(tags, "construction")
    return F.when(highway != "construction", highway).when(road_layer_of(target).isNotNull(), target).otherwise("road")


def road_layer(tags: Column) -> Column:
    """The layer of a road: unknown values are kept as roads_other, lifecycle and non-route values have none."""
    highway = value(tags, "highway")
    known = road_layer_of(highway)
    left_out = highway.isin(*INACTIVE_ROADS, *NO_ROUTE, *PLACEHOLDERS, "")
    return F.when(highway == "construction", F.coalesce(road_layer_of(value(tags, "construction")), F.lit("roads_other"))).when(known.isNotNull(), known).when(~left_out, "roads_other")


def road_exclusion(tags: Column, kind: Column, geometry: Column, in_frame: Column) -> Column:
    """Why an object isn't drawn as a road; null if it is. geometry: a failure, or null."""
    highway = value(tags, "highway")
    return (
        F.when(kind != "way", "unsupported_type").when(highway.isin("construction", "proposed", "planned"), "construction_or_proposed").when(highway.isin(*INACTIVE_ROADS), "inactive_lifecycle")
        .when(highway.isin(*NO_ROUTE), "known_non_route").when(highway.isin(*PLACEHOLDERS), "placeholder").when(geometry.isNotNull(), geometry).when(~in_frame, "outside_frame")
    )


def inactive_railway(tags: Column) -> Column:
    """Whether lifecycle tags make a rail inactive: bare and suffixed ones do, prefixed ones if they name the present kind."""
    now, out = value(tags, "railway"), F.lit(False)
    for word in INACTIVE_RAILWAYS:
        before = value(tags, f"{word}:railway")
        out = out | ~value(tags, word).isin(*FALSE) | ~value(tags, f"railway:{word}").isin(*FALSE) | (~before.isin(*FALSE) & ((before == "yes") | (before == now)))
    return out


def active_railway(tags: Column) -> Column:
    kind = F.coalesce(F.nullif(tags["railway"], F.lit("")), tags["disused:railway"], F.lit(""))
    return kind.isin(*RAILWAYS) & ~inactive_railway(tags)


def identified(tags: Column) -> Column:
    """Whether tags name a landmark: a name or an encyclopedia entry, a listing, or a heritage reference."""
    named = F.lit(False)
    for key in ("name", "official_name", "wikidata", "wikipedia"):
        named = named | (F.trim(F.coalesce(tags[key], F.lit(""))) != "")
    listed = F.map_filter(tags, lambda k, v: F.lower(k).startswith("ref:") & (F.contains(F.lower(k), F.lit("heritage")) | F.contains(F.lower(k), F.lit("nhle"))) & ~F.lower(F.trim(v)).isin(*FALSE))
    return named | ~value(tags, "heritage").isin(*FALSE) | (F.size(listed) > 0)


def heritage_site(tags: Column) -> Column:
    return (F.trim(F.coalesce(tags["building"], F.lit(""))) == "") & value(tags, "historic").isin("castle", "palace")


def layer(tags: Column) -> Column:
    """The primary layer: road, road area, water area, waterway, green, railway, boundary, building, in this order."""
    t = lambda key: F.coalesce(tags[key], F.lit(""))
    return F.coalesce(
        road_layer(tags),
        F.when(~value(tags, "area:highway").isin(*FALSE), "road_areas")
        .when(t("natural").isin("water", "bay", "wetland") | (t("waterway") == "riverbank") | t("landuse").isin("reservoir", "basin"), "water_areas")
        .when(t("waterway").isin(*LINEAR_WATER) | (t("natural") == "coastline") | t("man_made").isin("pier", "breakwater"), "waterways")
        .when(t("leisure").isin("park", "nature_reserve", "golf_course"), "green_space")
        .when(t("landuse").isin("forest", "grass", "recreation_ground", "cemetery", "meadow", "village_green", "allotments", "orchard"), "green_space")
        .when(t("natural").isin("wood", "scrub", "heath"), "green_space")
        .when(active_railway(tags), "railways")
        .when(t("boundary") == "administrative", "boundaries")
        .when(t("leisure") == "stadium", "buildings")
        .when(tags["building"].isNotNull() & ~value(tags, "building").isin(*FALSE, "nonexistent"), "buildings")
        .when(heritage_site(tags) & identified(tags), "buildings"),
    )


def layers(tags: Column) -> Column:
    """The primary layer and, where a road or area is also an active railway, `railways`."""
    first = layer(tags)
    return F.array_compact(F.array(first, F.when(active_railway(tags) & (F.coalesce(first, F.lit("")) != "railways"), "railways")))


def road_rank(tags: Column) -> Column:
    """1 to 6 by class, one less on links, raised by lanes and width (feet where a ' stands)."""
    road = effective_road(tags)
    base, rank = F.regexp_replace(road, "_link$", ""), F.lit(1)
    for r, values in RANKS.items():
        rank = F.when(base.isin(*values), r).otherwise(rank)
    rank = F.when(road.endswith("_link"), F.greatest(F.lit(1), rank - 1)).otherwise(rank)
    lanes = F.array_max(F.transform(F.regexp_extract_all(F.coalesce(tags["lanes"], F.lit("")), F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int")))
    text = F.coalesce(tags["width"], F.lit(""))
    width = F.regexp_replace(F.regexp_extract(text, r"\d+([.,]\d+)?", 0), ",", ".").try_cast("double") * F.when(F.contains(text, F.lit("'")), 0.3048).otherwise(1.0)
    return F.when((width >= 20) | (lanes >= 6), F.greatest(rank, F.lit(6))).when((width >= 13) | (lanes >= 4), F.greatest(rank, F.lit(5))).otherwise(rank)


def building_role(tags: Column, area_mm2: Column, scale: float = 1.0) -> Column:
    """struct(role, rank) of a landmark building large enough on the page; null if it has no role."""
    building, amenity, leisure, tourism, health, historic = (value(tags, k) for k in ("building", "amenity", "leisure", "tourism", "healthcare", "historic"))
    solid, known = ~building.isin(*FALSE, "nonexistent"), identified(tags)
    dead = building.isin(*INACTIVE_BUILDINGS) | value(tags, "status").isin(*INACTIVE_BUILDINGS) | value(tags, "lifecycle").isin(*INACTIVE_BUILDINGS) | ~value(tags, "construction").isin("", "no", "0", "false")
    for word in INACTIVE_BUILDINGS:
        dead = dead | ~value(tags, f"{word}:building").isin("", "no", "0", "false")
    rules = [
        ("cathedral", 8, building == "cathedral", F.lit(0.75), False),
        ("heritage", 7, building.isin("castle", "palace") | (solid & historic.isin("castle", "palace", "monument", "memorial", "tower")) | (heritage_site(tags) & known), F.lit(0.75), True),
        ("worship", 5, building.isin("church", "chapel", "religious", "mosque", "synagogue", "temple", "shrine") | (solid & (amenity == "place_of_worship")), F.when(known, 0.75).otherwise(2.0), False),
        ("university", 6, building.isin("university", "college") | (solid & amenity.isin("university", "college")), F.when(known, 1.5).otherwise(3.0), False),
        ("stadium", 7, building.isin("stadium", "grandstand", "sports_hall"), F.lit(1.5), False),
        ("stadium", 7, leisure == "stadium", F.when(solid, 1.5).otherwise(6.0), False),
        ("civic", 4, building.isin("civic", "public", "government") | (solid & amenity.isin("townhall", "courthouse", "library")), F.lit(1.5), True),
        ("culture", 4, solid & (amenity.isin("theatre", "arts_centre") | tourism.isin("museum", "gallery")), F.lit(1.5), True),
        ("health", 3, (building == "hospital") | (solid & ((amenity == "hospital") | (health == "hospital"))), F.lit(3.0), True),
        ("transport", 3, building == "train_station", F.lit(3.0), True),
    ]
    out = F.lit(None)
    for role, rank, fits, least, named in reversed(rules):
        large = (area_mm2 + 1e-9 >= least * scale) & (known if named else F.lit(True))
        out = F.when(fits, F.when(large, F.struct(F.lit(role).alias("role"), (F.lit(rank) + known.cast("int")).alias("rank")))).otherwise(out)
    return F.when(~dead, out)


def detail_target(layer_name: Column, tags: Column, length_mm: Column) -> Column:
    """Where a road is drawn at balanced detail: another layer, its own, or nowhere (null)."""
    t = lambda key: F.coalesce(tags[key], F.lit(""))
    highway, named = t("highway"), t("name") != ""
    path = (
        F.when(highway == "pedestrian", F.when(named | (length_mm >= 3.0), "roads_local"))
        .when(highway == "footway", F.when(t("footway").isin("sidewalk", "crossing"), None).when(~t("bridge").isin("", "no"), F.when(length_mm >= 1.0, "paths")).when((named & (length_mm >= 1.2)) | (length_mm >= 6.0), "paths"))
        .when(highway == "cycleway", F.when((named & (length_mm >= 1.0)) | (length_mm >= 4.0), "paths"))
        .when(highway.isin("path", "track", "bridleway"), F.when((named & (length_mm >= 1.5)) | (length_mm >= 6.0), "paths"))
    )
    service = F.when(t("service").isin("driveway", "parking_aisle", "drive-through"), None).when((named & (length_mm >= 1.0)) | ((t("service") == "") & (length_mm >= 4.0)), "roads_other")
    return (
        F.when(t("access").isin("private", "no"), None).when(layer_name == "paths", path).when(highway == "service", service)
        .when((layer_name == "roads_other") & (length_mm < 1.0), None).otherwise(layer_name)
    )


def underground_reasons(tags: Column) -> Column:
    """Why a waterway is below ground: an array, empty if it isn't."""
    tunnel = value(tags, "tunnel")
    return F.array_compact(F.array(F.when(~tunnel.isin(*FALSE), F.concat(F.lit("tunnel="), tunnel)), F.when(value(tags, "covered") == "yes", "covered=yes"), F.when(value(tags, "location") == "underground", "location=underground")))


def member_role(role: Column) -> Column:
    """alignment, support or unsupported, of a way's role in a route."""
    r = F.lower(F.trim(role))
    return F.when(r.isin("", "route", "forward", "backward"), "alignment").when(r.isin("platform", "platform_entry_only", "platform_exit_only", "station", "stop") | r.startswith("platform_"), "support").otherwise("unsupported")


def grade(tags: Column, level: Column) -> Column:
    """Structure and level signature: lines of different signatures never meet. level: text.level_key of the level tag."""
    yes = lambda key: F.when(value(tags, key).isin(*FALSE), "no").otherwise(value(tags, key))
    return F.concat_ws("/", F.coalesce(F.nullif(F.trim(tags["layer"]), F.lit("")), F.lit("0")), level, yes("bridge"), yes("tunnel"), yes("covered"), yes("ford"))


def water_class(tags: Column) -> Column:
    t = lambda key: value(tags, key)
    return F.when(t("waterway").isin(*LINEAR_WATER), t("waterway")).when(t("natural").isin("water", "bay"), "lake").when(t("waterway") == "riverbank", "river_area").when(t("landuse").isin("reservoir", "basin"), "reservoir").when(t("natural") == "coastline", "coast")


def landcover_class(tags: Column) -> Column:
    t = lambda key: value(tags, key)
    return F.when((t("natural") == "wood") | (t("landuse") == "forest"), "wood").when(t("natural").isin("scrub", "heath"), t("natural")).when(t("landuse").isin("meadow", "grass"), "grass").when(t("leisure").isin("park", "golf_course"), "park")


def pit_member(role: Column, name: Column, words: tuple[str, ...] = ("pit", "pitlane", "lane")) -> Column:
    """Whether a member of a lap is a pit lane, by a word of its role or name."""
    every = F.split(F.lower(F.regexp_replace(F.concat_ws(" ", role, name), "[^A-Za-z]+", " ")), " ")
    return F.arrays_overlap(every, F.array(*map(F.lit, words)))


def elevation_claim(native: Column, trusted: Column) -> Column:
    """explicit where a feature has its own elevation of a trusted source, inferred where it has none of either, else open."""
    return F.when(native.isNotNull() & trusted, "explicit").when(native.isNull() & ~trusted, "inferred").otherwise("open")
