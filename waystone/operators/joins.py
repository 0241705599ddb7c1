"""Spatial, name and interval joins: equi joins on cells and keys first, distances after."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waystone.functions.geo import EARTH_M, crosses_ray, haversine_m, planar_distance, segment_projection
from waystone.operators.storage import removed, settled, union_all

#: Latitude within which cells of a radius join are wide enough.
MAX_LATITUDE = 75.0
#: Ids of one place that a row holds at most.
IDS = 512
#: Cells on a side of the square that a task measures at once, and pairs of segments that it holds.
SIDE, PAIRS = 8, 1 << 18


def edges_of(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between consecutive nodes of a way: way_id, pos, a, b, both ends and metres; missing nodes leave nulls."""
    by = Window.partitionBy("way_id").orderBy("pos")
    pairs = way_nodes.select("way_id", "pos", F.col("node_id").alias("a"), F.lead("node_id").over(by).alias("b")).where("b is not null")
    end = lambda s: nodes.select(F.col("node_id").alias(s), F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}"))
    both = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return both.select("way_id", "pos", "a", "b", "lon_a", "lat_a", "lon_b", "lat_b", haversine_m("lon_a", "lat_a", "lon_b", "lat_b").alias("m"))


def cell_degrees(metres: float) -> tuple[float, float]:
    """Cell sizes in degrees of longitude and latitude that no pair within `metres` can be two cells apart in."""
    lat = math.degrees(metres / EARTH_M)
    return lat / math.cos(math.radians(MAX_LATITUDE)), lat


def around(lon: Column, lat: Column, metres: float) -> Column:
    """The nine cells at and around a point, as an array of struct(cx, cy)."""
    dx, dy = cell_degrees(metres)
    step = [F.struct((F.floor(lon / dx) + i).alias("cx"), (F.floor(lat / dy) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return F.array(*step)


def radius_join(points: DataFrame, nodes: DataFrame, metres: float, k: int | None = None, within: list[str] | None = None) -> DataFrame:
    """Nodes within a radius of points (point_id, lon, lat; node_id, lon, lat), the nearest k of each, ties by node_id. within:
    columns that both have and that must agree as well, such as a track.

    Points and nodes at one place are one row until their distance is known: places of points are dealt to the cells around them and
    meet places of nodes (the first k nodes of each, if k is given) in one cell each, and only what is found is spread to the points,
    by exchange. So distances don't grow with copies of a place, and with k neither do rows but by points. Without k, rows are all
    pairs within the radius. Latitudes beyond MAX_LATITUDE need a smaller radius."""
    dx, dy = cell_degrees(metres)
    same = within or []
    at = [*same, "plon", "plat"]
    own = points.select("point_id", *same, F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    left = own.select(*at).distinct().withColumn("c", F.explode(around(F.col("plon"), F.col("plat"), metres))).select(*at, "c.cx", "c.cy")
    if k is None:
        sites = nodes.select(*same, "lon", "lat").distinct()
    else:
        first = F.row_number().over(Window.partitionBy(*same, "lon", "lat").orderBy("node_id"))
        sites = nodes.select("node_id", *same, "lon", "lat").withColumn("_n", first).where(F.col("_n") <= k).drop("_n")
    right = sites.withColumns({"cx": F.floor(F.col("lon") / dx), "cy": F.floor(F.col("lat") / dy)})
    met = left.join(right.hint("merge"), [*same, "cx", "cy"]).withColumn("m", haversine_m("plon", "plat", "lon", "lat")).where(F.col("m") <= metres)
    if k is None:
        found = met.select(*at, "lon", "lat", "m").join(nodes.select("node_id", *same, "lon", "lat").hint("merge"), [*same, "lon", "lat"]).select(*at, "node_id", "m")
        return found.join(own.hint("merge"), at).select("point_id", "node_id", "m")
    found = met.select(*at, "node_id", "m").withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy("m", "node_id"))).where(F.col("rank") <= k)
    return found.join(own.hint("merge"), at).select("point_id", "node_id", "m", "rank")


def segment_cells(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column, metres: float, beside: int = 0) -> Column:
    """The cells that a segment's bounding box meets, and so many beside them, as an array of struct(cx, cy)."""
    dx, dy = cell_degrees(metres)
    span = lambda a, b, d: F.sequence(F.floor(F.least(a, b) / d) - beside, F.floor(F.greatest(a, b) / d) + beside)
    xs, ys = span(lon_a, lon_b, dx), span(lat_a, lat_b, dy)
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def _by_place(rows: DataFrame, id: str, at: list[str], most: int | None = None) -> DataFrame:
    """Places (columns at) with the ids of their rows (the first `most` of them, if given): part 0, 1, .. of a place holds up to IDS."""
    n = F.row_number().over(Window.partitionBy(*at).orderBy(id)) - 1
    placed = rows.dropna(subset=at).withColumn("_n", n)
    kept = placed if most is None else placed.where(F.col("_n") < most)
    return settled(kept.groupBy(*at, F.floor(F.col("_n") / IDS).cast("int").alias("part")).agg(F.collect_list(F.struct(id)).alias(f"{id}s")))


def segment_radius_join(points: DataFrame, segments: DataFrame, metres: float, k: int | None = None, values: dict[str, Column] | None = None) -> DataFrame:
    """Segments (segment_id, lon_a, lat_a, lon_b, lat_b) within a radius of points, with the projected point and fraction. values: what
    to give of the projection p (distance_m, lon, lat, fraction) instead, computed once for a place and a segment's place.

    Points at one place are one row until their distance is known, and so are segments at one; then the ids of both are spread, held in
    arrays of up to IDS. So distances don't grow with copies of a place; without k, rows are all pairs within the radius. Places of
    segments are dealt to all cells that their boxes meet and those beside, so they should be short against the radius's cell. A point
    is in one cell, so a pair meets once; all is joined by exchange, as dealt rows are more than their size as a table tells."""
    dx, dy = cell_degrees(metres)
    at, leg = ["plon", "plat"], ["lon_a", "lat_a", "lon_b", "lat_b"]
    own = _by_place(points.select("point_id", F.col("lon").alias("plon"), F.col("lat").alias("plat")), "point_id", at)
    drawn = _by_place(segments.select("segment_id", *leg), "segment_id", leg, k)
    left = own.where("part = 0").select(*at, F.floor(F.col("plon") / dx).alias("cx"), F.floor(F.col("plat") / dy).alias("cy"))
    right = drawn.where("part = 0").select(*leg, F.explode(segment_cells(*map(F.col, leg), metres, 1)).alias("c")).select(*leg, "c.cx", "c.cy")
    met = left.join(right.hint("merge"), ["cx", "cy"]).withColumn("p", segment_projection(*at, *leg)).where(F.col("p.distance_m") <= metres)
    given = values or {c: F.col(f"p.{c}") for c in ("distance_m", "lon", "lat", "fraction")}
    found = met.select(*at, *leg, F.col("p.distance_m").alias("_m"), *[v.alias(c) for c, v in given.items()])
    spread = lambda df, id: df.withColumn("_i", F.explode(f"{id}s")).drop(f"{id}s", "part").withColumn(id, F.col(f"_i.{id}")).drop("_i")
    if k is None:
        met = found.join(own.drop("part").hint("merge"), at).join(drawn.drop("part").hint("merge"), leg)
        return spread(spread(met, "point_id"), "segment_id").select("point_id", "segment_id", *given)
    each = spread(found.join(drawn.hint("merge"), leg), "segment_id")
    first = each.withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy("_m", "segment_id"))).where(F.col("rank") <= k)
    return spread(first.join(own.hint("merge"), at), "point_id").select("point_id", "segment_id", *given, "rank")


def nearest_by_key(left: DataFrame, right: DataFrame, key: str, limit: float) -> DataFrame:
    """Each left row (id, key, x, y) with the nearest right row (code, key, x, y) of the same key within a limit, ties by
    code; code and distance are null where there is none.

    Rows at one place are asked once. A place meets the cells around it, of a small reach first; where none is within it, the reach
    grows fourfold for those places alone, so that a name that many rows share meets near rows only."""
    sites = right.groupBy(key, F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min("code").alias("code"))
    open_, found = settled(left.where(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(key, "x", "y").distinct()), []
    for reach in (limit / 256, limit / 64, limit / 16, limit / 4, limit):
        size = reach * (1 + 1e-9) or 1.0  # a little wider, so that rounding parts no pair
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: B023, E731
        around = F.array(*[F.struct((cell("x") + i).alias("_cx"), (cell("y") + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        asked = open_.select(key, "x", "y", F.explode(around).alias("c")).select(key, "x", "y", "c.*")
        met = asked.join(sites.withColumns({"_cx": cell("_x"), "_cy": cell("_y")}), [key, "_cx", "_cy"])
        met = met.withColumn("distance", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))).where(F.col("distance") <= reach)
        best = settled(met.groupBy(key, "x", "y").agg(F.min(F.struct("distance", "code")).alias("b")))
        found.append(best)
        after = settled(open_.join(best, [key, "x", "y"], "left_anti"))
        removed(open_)
        open_ = after
        if open_.isEmpty():
            break
    return left.select("id", key, "x", "y").join(union_all(found), [key, "x", "y"], "left").select("id", "b.code", "b.distance")


def candidates_by_keys(names: DataFrame, records: DataFrame, cap: int) -> DataFrame:
    """Records (source, code, exact, relaxed) for names (id, exact, relaxed): by the exact key first, then by the weaker,
    at most cap of each source; a record found by both counts as exact. id, source, code, strength.

    A name takes no more of a key and source than the first cap codes: fewer than cap exact ones leave room for as many of the first cap
    relaxed ones as there are others. So only these are joined."""
    first = Window.partitionBy("k", "source").orderBy("code")
    known = lambda k: records.select(F.col(k).alias("k"), "source", "code").where("k is not null").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap)
    ways = [names.select("id", F.col(k).alias("k")).join(known(k), "k").select("id", "source", "code", F.lit(i).alias("strength")) for i, k in enumerate(("exact", "relaxed"))]
    found = ways[0].unionByName(ways[1]).groupBy("id", "source", "code").agg(F.min("strength").alias("strength"))
    return found.withColumn("r", F.row_number().over(Window.partitionBy("id", "source").orderBy("strength", "code"))).where(F.col("r") <= cap).drop("r")


def linear_reference(landmarks: DataFrame, legs: DataFrame, track: str = "track_id", reach_m: float = 2000.0, rounds: int = 4) -> DataFrame:
    """Each landmark (landmark_id, track, lon, lat) on the nearest leg of its own track (pos, lon0.., d0, d1): chainage and
    offset in metres, ties by chainage.

    A landmark meets the legs of its track in the cells around it. Where none is within reach, the reach grows fourfold, for
    those landmarks alone; what is left after the rounds, far from everything, meets its whole track."""
    along = F.col("d0") + F.col("p.fraction") * (F.col("d1") - F.col("d0"))
    nearest = F.min("p.distance_m").alias("offset_m"), F.min(F.struct(F.round("p.distance_m", 6).alias("_o"), along.alias("along_m"))).alias("b")
    ends = ("lon0", "lat0", "lon1", "lat1", "d0", "d1")
    open_, found, reach = landmarks.select(track, "landmark_id", "lon", "lat"), [], reach_m
    projected = segment_projection("lon", "lat", "lon0", "lat0", "lon1", "lat1")
    for _ in range(rounds):
        left = open_.withColumn("c", F.explode(around(F.col("lon"), F.col("lat"), reach))).select(track, "landmark_id", "lon", "lat", "c.cx", "c.cy")
        right = legs.withColumn("c", F.explode(segment_cells(F.col("lon0"), F.col("lat0"), F.col("lon1"), F.col("lat1"), reach))).select(track, *ends, "c.cx", "c.cy")
        near = left.join(right, [track, "cx", "cy"]).withColumn("p", projected).where(F.col("p.distance_m") <= reach)
        best = settled(near.groupBy(track, "landmark_id").agg(*nearest))
        found.append(best)
        open_ = settled(open_.join(best.select(track, "landmark_id"), [track, "landmark_id"], "left_anti"))
        if open_.isEmpty():
            break
        reach *= 4
    else:
        found.append(open_.join(legs.select(track, *ends), track).withColumn("p", projected).groupBy(track, "landmark_id").agg(*nearest))
    return union_all(found).select(track, "landmark_id", "b.along_m", "offset_m")


def close_pairs(segments: DataFrame, distance: float, cell: float) -> DataFrame:
    """Pairs of different lines (line_id, x0, y0, x1, y1) with ends within a distance of the other's segment: least gap.

    Two that cross have a gap of 0; others are nearest at an end of one. Segments are dealt to squares of SIDE cells of size `cell` (at
    least the distance) in whose reach their boxes are. A square's segments are swept along x, at most PAIRS pairs with boxes near at
    once, so pairs of segments are never rows; lines that cross there are not measured further. A pair is met in one of the squares
    that it shares."""
    step = SIDE * max(cell, distance)
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - distance) / step), F.floor((F.greatest(a, b) + distance) / step))
    cells = F.flatten(F.transform(span("x0", "x1"), lambda x: F.transform(span("y0", "y1"), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    own = segments.where("line_id is not null").select("line_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    kind = own.schema["line_id"].dataType.simpleString()
    columns = f"a {kind}, b {kind}, gap double"
    found = own.withColumn("c", F.explode(cells)).select(*own.columns, "c.cx", "c.cy").groupBy("cx", "cy").applyInArrow(_square_gaps(distance, step, columns), columns)
    return found.groupBy("a", "b").agg(F.min("gap").alias("gap"))


def _square_gaps(distance: float, step: float, columns: str):
    """Of one square's segments the least gap of each two lines within the distance."""
    target, reach = to_arrow_schema(StructType.fromDDL(columns)), distance * (1 + 1e-9)

    def run(key, table):
        cx, cy = (k.as_py() for k in key)
        ids = table["line_id"].combine_chunks()
        names = ids.unique()
        names = names.take(pc.array_sort_indices(names))
        line = pc.index_in(ids, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.stack([table[c].to_numpy() for c in ("x0", "y0", "x1", "y1")])
        order = np.argsort(np.minimum(ends[0], ends[2]), kind="stable")
        line, ends = line[order], ends[:, order]
        (w, s), (e, n) = np.minimum(ends[:2], ends[2:]), np.maximum(ends[:2], ends[2:])
        left, low = np.floor((w - distance) / step), np.floor((s - distance) / step)
        after = np.searchsorted(w, e + reach, side="right") - np.arange(len(w)) - 1  # those that start later, but not beyond it
        sums = np.concatenate([[0], np.cumsum(after)])
        known, found, p = np.empty(0, np.int64), [], 0
        while p < len(w):
            q = max(p + 1, int(np.searchsorted(sums, sums[p] + PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(p, q), after[p:q])
            j = i + 1 + np.arange(len(i)) - np.repeat(sums[p:q] - sums[p], after[p:q])
            p = q
            near = (line[i] != line[j]) & (s[j] - n[i] <= reach) & (s[i] - n[j] <= reach)
            i, j = i[near], j[near]
            here = (np.maximum(left[i], left[j]) == cx) & (np.maximum(low[i], low[j]) == cy)
            i, j = i[here], j[here]
            pair = np.minimum(line[i], line[j]) * len(names) + np.maximum(line[i], line[j])
            for every in (16, 1):  # most lines that cross do so in a few of their pairs; these are left out of the second look
                open_ = np.nonzero(~np.isin(pair, known))[0]
                some = open_[::every]
                known = np.union1d(known, pair[some[_cross(ends[:, i[some]], ends[:, j[some]])]])
            open_ = ~np.isin(pair, known)
            i, j, pair = ends[:, i[open_]], ends[:, j[open_]], pair[open_]
            gap = np.minimum.reduce([_distances(u[c], u[c + 1], v) for u, v in ((i, j), (j, i)) for c in (0, 2)])
            close = gap <= distance
            found.append(_least(pair[close], gap[close]))
        pairs, gaps = _least(np.concatenate([known, *[f[0] for f in found]]), np.concatenate([np.zeros(len(known)), *[f[1] for f in found]]))
        cells = names.take(pa.array(pairs // len(names))), names.take(pa.array(pairs % len(names))), pa.array(gaps)
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cells, target, strict=True)], schema=target)

    return run


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether segments (x0, y0, x1, y1) cross properly."""
    turn = lambda p, q, e: np.sign((p[2] - p[0]) * (q[e + 1] - p[1]) - (p[3] - p[1]) * (q[e] - p[0]))
    return (turn(a, b, 0) * turn(a, b, 2) < 0) & (turn(b, a, 0) * turn(b, a, 2) < 0)


def _distances(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """planar_distance() of points from segments."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    size = dx * dx + dy * dy
    t = np.clip(((x - s[0]) * dx + (y - s[1]) * dy) / np.where(size > 0, size, 1.0), 0.0, 1.0)
    return np.hypot(x - s[0] - t * dx, y - s[1] - t * dy)


def _least(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, each once, and the least value of each."""
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    first = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    return key[first], value[first]


def crossings(segments: DataFrame, track: str, cell: float) -> DataFrame:
    """Proper crossings of non-adjacent segments (track, pos, x0, y0, x1, y1) of a track: i, j. Segments meet in cells."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    cells = F.flatten(F.transform(span(F.col("x0"), F.col("x1")), lambda x: F.transform(span(F.col("y0"), F.col("y1")), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    dealt = segments.withColumn("c", F.explode(cells))
    a = dealt.select(track, "c", F.col("pos").alias("i"), *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    b = dealt.select(track, "c", F.col("pos").alias("j"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    side = lambda p, q, x, y: F.signum((F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{q}{y}") - F.col(f"{p}y0")) - (F.col(f"{p}y1") - F.col(f"{p}y0")) * (F.col(f"{q}{x}") - F.col(f"{p}x0")))
    proper = (side("a", "b", "x0", "y0") * side("a", "b", "x1", "y1") < 0) & (side("b", "a", "x0", "y0") * side("b", "a", "x1", "y1") < 0)
    return a.join(b, [track, "c"]).where((F.col("j") - F.col("i") > 1) & proper).select(track, "i", "j").distinct()


def smallest_container(points: DataFrame, rings: DataFrame, key: str, cell: float) -> DataFrame:
    """Each point (point_id, key, x, y) with the ring (ring_id, key, pos, x0, y0, x1, y1) of least area that it is inside of,
    among rings of its own key. point_id, ring_id. Points meet the boxes of rings in cells of a size that the boxes set."""
    areas = rings.groupBy(key, "ring_id").agg(F.abs(F.sum((F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2)).alias("area"), F.min("x0").alias("w"), F.max("x0").alias("e"), F.min("y0").alias("s"), F.max("y0").alias("n"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    cells = F.flatten(F.transform(span("w", "e"), lambda x: F.transform(span("s", "n"), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    boxes = areas.withColumn("c", F.explode(cells)).select(key, "ring_id", "area", "w", "e", "s", "n", "c.cx", "c.cy")
    placed = points.select("point_id", key, "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    possible = placed.join(boxes, [key, "cx", "cy"]).where(F.col("x").between(F.col("w"), F.col("e")) & F.col("y").between(F.col("s"), F.col("n")))
    met = possible.join(rings.select(key, "ring_id", "x0", "y0", "x1", "y1"), [key, "ring_id"]).groupBy("point_id", "ring_id", "area")
    inside = met.agg((F.count_if(crosses_ray("x", "y", "x0", "y0", "x1", "y1")) % 2).alias("odd")).where("odd = 1")
    return inside.groupBy("point_id").agg(F.min_by("ring_id", F.struct("area", "ring_id")).alias("ring_id"))


def bilinear(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """Each sample (sample_id, tile, fr, fc: fractional row and column) from its cell's four corners (tile, row, col, z);
    null where a corner is missing."""
    r, c = F.floor("fr").cast("int"), F.floor("fc").cast("int")
    corners = samples.withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))).withColumns({"row": r + F.col("k.i"), "col": c + F.col("k.j")})
    weight = F.when(F.col("k.i") == 0, 1 - (F.col("fr") - F.floor("fr"))).otherwise(F.col("fr") - F.floor("fr")) * F.when(F.col("k.j") == 0, 1 - (F.col("fc") - F.floor("fc"))).otherwise(F.col("fc") - F.floor("fc"))
    met = corners.join(grid, ["tile", "row", "col"], "left").groupBy("sample_id").agg(F.sum(weight * F.col("z")).alias("z"), F.count("z").alias("n"))
    return met.select("sample_id", F.when(F.col("n") == 4, F.col("z")).alias("z"))


def nested_members(relations: DataFrame, rounds: int = 32) -> DataFrame:
    """Leaves of nested relations: members (parent, child, inner, leaf) of roots, roles composed by exclusive or through the
    nesting; a relation that is its own ancestor is not entered again. root, leaf, inner, depth."""
    level = relations.select(F.col("parent").alias("root"), F.col("child"), F.col("inner"), F.col("leaf"), F.array("parent").alias("path"), F.lit(1).alias("depth"))
    done, open_ = level.where("leaf"), level.where(~F.col("leaf"))
    every = relations.select(F.col("parent").alias("p"), F.col("child").alias("c"), F.col("inner").alias("i"), F.col("leaf").alias("l"))
    for _ in range(rounds):
        open_ = open_.where(~F.array_contains("path", F.col("child")))
        nxt = open_.join(every, open_["child"] == every["p"]).select("root", F.col("c").alias("child"), (F.col("inner") != F.col("i")).alias("inner"), F.col("l").alias("leaf"), F.concat("path", F.array("child")).alias("path"), (F.col("depth") + 1).alias("depth"))
        nxt = settled(nxt)
        if nxt.isEmpty():
            break
        done, open_ = done.unionByName(nxt.where("leaf")), nxt.where(~F.col("leaf"))
    else:
        raise RuntimeError("nested_members: not settled")
    return done.select("root", F.col("child").alias("leaf"), "inner", "depth")
