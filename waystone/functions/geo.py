"""Geometry as column expressions: degrees on a sphere, planar segments, tiles, rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius and Web-Mercator radius in metres.
EARTH_M, MERCATOR_M = 6371008.8, 6378137.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, int | float) else F.col(x)


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres; null if a coordinate is."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h.isNotNull(), F.least(F.lit(1.0), h))))  # least() alone would pass a null over


def metres(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """haversine_m() of numbers, for rules that fold over rows in a task."""
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, h)))


def along_great_circle(lon1, lat1, lon2, lat2, fraction) -> Column:
    """struct(lon, lat) at a fraction of the great circle between two points, by first bearing and distance."""
    lon1, lat1, lon2, lat2, fraction = map(_c, (lon1, lat1, lon2, lat2, fraction))
    f1, f2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    bearing = F.atan2(F.sin(dl) * F.cos(f2), F.cos(f1) * F.sin(f2) - F.sin(f1) * F.cos(f2) * F.cos(dl))
    d = fraction * haversine_m(lon1, lat1, lon2, lat2) / EARTH_M
    lat = F.asin(F.sin(f1) * F.cos(d) + F.cos(f1) * F.sin(d) * F.cos(bearing))
    lon = F.radians(lon1) + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(f1), F.cos(d) - F.sin(f1) * F.sin(lat))
    return F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))


def planar_fraction(x, y, x1, y1, x2, y2) -> Column:
    """Where the nearest point of a segment lies, 0 to 1; 0 on a segment of no length."""
    x, y, x1, y1, x2, y2 = map(_c, (x, y, x1, y1, x2, y2))
    size = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    return F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / size))).otherwise(0.0)


def planar_distance(x, y, x1, y1, x2, y2) -> Column:
    """Distance from a point to a segment in the plane, safe for segments of no length."""
    x, y, x1, y1, x2, y2 = map(_c, (x, y, x1, y1, x2, y2))
    t = planar_fraction(x, y, x1, y1, x2, y2)
    return F.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


def line_distance(x, y, x1, y1, x2, y2) -> Column:
    """Distance from a point to the infinite line through two points; to the point itself if they are one."""
    x, y, x1, y1, x2, y2 = map(_c, (x, y, x1, y1, x2, y2))
    size = F.hypot(x2 - x1, y2 - y1)
    return F.when(size > 0, F.abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1) / size).otherwise(F.hypot(x - x1, y - y1))


def local_metres(lon, lat, lon0, lat0) -> tuple[Column, Column]:
    """x and y in metres in the tangent plane at a point."""
    lon, lat, lon0, lat0 = map(_c, (lon, lat, lon0, lat0))
    return F.radians(lon - lon0) * EARTH_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_M


def segment_projection(lon, lat, lon1, lat1, lon2, lat2) -> Column:
    """struct(distance_m, lon, lat, fraction): a point's nearest point on a segment, in the plane tangent at the point."""
    lon, lat, lon1, lat1, lon2, lat2 = map(_c, (lon, lat, lon1, lat1, lon2, lat2))
    (x1, y1), (x2, y2) = local_metres(lon1, lat1, lon, lat), local_metres(lon2, lat2, lon, lat)
    t = planar_fraction(F.lit(0.0), F.lit(0.0), x1, y1, x2, y2)
    return F.struct(F.hypot(x1 + t * (x2 - x1), y1 + t * (y2 - y1)).alias("distance_m"), (lon1 + t * (lon2 - lon1)).alias("lon"), (lat1 + t * (lat2 - lat1)).alias("lat"), t.alias("fraction"))


def array_length(points: Column) -> Column:
    """Length of an array of struct(x, y); 0 for fewer than two points."""
    n = F.size(points)
    pairs = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def page_mm(lon, lat, lon0, lat0, scale) -> tuple[Column, Column]:
    """Page millimetres from the page centre (x right, y down) at a scale denominator."""
    x, _ = local_metres(lon, lat, lon0, lat0)
    return x * 1000.0 / _c(scale), F.radians(_c(lat0) - _c(lat)) * EARTH_M * 1000.0 / _c(scale)


def mercator(lon, lat) -> tuple[Column, Column]:
    return F.radians(_c(lon)) * MERCATOR_M, F.asinh(F.tan(F.radians(_c(lat)))) * MERCATOR_M


def from_mercator(x, y) -> tuple[Column, Column]:
    return F.degrees(_c(x) / MERCATOR_M), F.degrees(F.atan(F.sinh(_c(y) / MERCATOR_M)))


def world_pixel(lon, lat, zoom: int, tile: int = 256) -> tuple[Column, Column]:
    size = float(tile * 2**zoom)
    return (_c(lon) + 180.0) / 360.0 * size, (1.0 - F.asinh(F.tan(F.radians(_c(lat)))) / math.pi) / 2.0 * size


def tile_of(lon, lat, zoom: int) -> tuple[Column, Column]:
    x, y = world_pixel(lon, lat, zoom, 1)
    top = 2**zoom - 1
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor(x))).cast("int"), F.least(F.lit(top), F.greatest(F.lit(0), F.floor(y))).cast("int")


def clip_parameters(x1, y1, x2, y2, west, south, east, north) -> Column:
    """struct(t0, t1) of the part of a segment inside a rectangle (Liang and Barsky); null if none is."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    low, high, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for p, q in ((x1 - x2, x1 - west), (x2 - x1, east - x1), (y1 - y2, y1 - south), (y2 - y1, north - y1)):
        low.append(F.when(p < 0, q / p))
        high.append(F.when(p > 0, q / p))
        outside = outside | ((p == 0) & (q < 0))
    t0, t1 = F.greatest(*low), F.least(*high)
    return F.when(~outside & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def shoelace_term(x1, y1, x2, y2) -> Column:
    """Half the cross product; its sum over a ring is the signed area."""
    return (_c(x1) * _c(y2) - _c(x2) * _c(y1)) / 2.0


def crosses_ray(x, y, x1, y1, x2, y2) -> Column:
    """Whether a ring's edge crosses the ray from a point to the east; an odd count is inside."""
    x, y, x1, y1, x2, y2 = map(_c, (x, y, x1, y1, x2, y2))
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def turn_degrees(x0, y0, x1, y1, x2, y2) -> Column:
    """Angle between two successive legs, 0 straight on to 180 back; null if a leg has no length."""
    x0, y0, x1, y1, x2, y2 = map(_c, (x0, y0, x1, y1, x2, y2))
    ax, ay, bx, by = x1 - x0, y1 - y0, x2 - x1, y2 - y1
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(size > 0, F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ax * bx + ay * by) / size)))))


def morton(x, y, west: float, south: float, east: float, north: float, bits: int = 10) -> Column:
    """Bit-interleaved cell number of a point in a rectangle, x in the even bits."""
    top = (1 << bits) - 1
    ix = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_c(x) - west) / (east - west))) * top).cast("long")
    iy = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_c(y) - south) / (north - south))) * top).cast("long")
    parts = [F.shiftleft(F.shiftright(v, k).bitwiseAND(1), 2 * k + o) for v, o in ((ix, 0), (iy, 1)) for k in range(bits)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def ground_metres(page, scale) -> Column:
    return _c(page) * _c(scale) / 1000.0


def axis_position(x, low, high, log: bool = False) -> Column:
    """Position between low and high, on a linear or logarithmic axis; null where the logarithm has none."""
    x, low, high = map(_c, (x, low, high))
    if log:
        return F.when((x > 0) & (low > 0) & (high > low), (F.log10(x) - F.log10(low)) / (F.log10(high) - F.log10(low)))
    return F.when(high > low, (x - low) / (high - low))


def drawable(length: Column, nib: Column, area: Column, is_area: Column, least: float = 0.5, widths: float = 3.0) -> Column:
    """Whether a stroke can be drawn with a pen: at least some of its widths long, and an area at least two widths square."""
    return (length >= F.greatest(F.lit(least), widths * nib)) & (~is_area | (area >= F.pow(2 * nib, F.lit(2.0))))


def canonical_line(a: Column, b: Column) -> Column:
    """A leg's two ends (structs that can be ordered) as an array that is alike for both directions."""
    return F.when(a <= b, F.array(a, b)).otherwise(F.array(b, a))
