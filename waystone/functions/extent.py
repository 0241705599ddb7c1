"""Extents as struct(west, south, east, north) columns, in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waystone.functions.geo import EARTH_M

#: Fixed value: one metre in degrees of latitude, the least side of a course's extent.
LEAST_SIDE = 1.0 / 111_320.0


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))


def bounds(lon: str | Column, lat: str | Column) -> Column:
    """Aggregate: the extent of a group's points; null coordinates don't count."""
    return box(F.min(lon), F.min(lat), F.max(lon), F.max(lat))


def united(extent: str) -> Column:
    """Aggregate: the extent of a group's extents."""
    return box(F.min(f"{extent}.west"), F.min(f"{extent}.south"), F.max(f"{extent}.east"), F.max(f"{extent}.north"))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["west"], b["west"]), F.least(a["south"], b["south"]), F.greatest(a["east"], b["east"]), F.greatest(a["north"], b["north"]))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two extents meet, touching included."""
    return (a["east"] >= b["west"]) & (a["west"] <= b["east"]) & (a["north"] >= b["south"]) & (a["south"] <= b["north"])


def _centred(extent: Column, width: Column, height: Column) -> Column:
    lon, lat = (extent["west"] + extent["east"]) / 2, (extent["south"] + extent["north"]) / 2
    return box(lon - width / 2, lat - height / 2, lon + width / 2, lat + height / 2)


def _sides(extent: Column) -> tuple[Column, Column]:
    return extent["east"] - extent["west"], extent["north"] - extent["south"]


def width_m(extent: Column) -> Column:
    """Metres from west to east at the middle latitude."""
    return EARTH_M * F.radians(extent["east"] - extent["west"]) * F.cos(F.radians((extent["south"] + extent["north"]) / 2))


def height_m(extent: Column) -> Column:
    return EARTH_M * F.radians(extent["north"] - extent["south"])


def area_km2(extent: Column) -> Column:
    return width_m(extent) * height_m(extent) / 1e6


def around(lon: Column, lat: Column, radius_km: float) -> Column:
    """The extent of a circle; null where the centre is outside latitudes of 85 degrees or longitudes of 180."""
    dy = F.lit(radius_km * 1000 / EARTH_M) * 180 / F.pi()
    dx = dy / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    return F.when(lat.between(-85, 85) & lon.between(-180, 180), box(lon - dx, lat - dy, lon + dx, lat + dy))


def padded(extent: Column, fraction: float) -> Column:
    """Wider by a share of each side, on both ends of it."""
    x, y = _sides(extent)
    return _centred(extent, x * (1 + 2 * fraction), y * (1 + 2 * fraction))


def expanded_to(extent: Column, aspect: float) -> Column:
    """The least extent of a width to height ratio (in metres) that holds this one, of the same centre."""
    x, y = _sides(extent)
    now = width_m(extent) / height_m(extent)
    return _centred(extent, F.when(now < aspect, x * aspect / now).otherwise(x), F.when(now < aspect, y).otherwise(y * now / aspect))


def cropped_to(extent: Column, aspect: float) -> Column:
    """The largest extent of a width to height ratio (in metres) inside this one, of the same centre."""
    x, y = _sides(extent)
    now = width_m(extent) / height_m(extent)
    return _centred(extent, F.when(now < aspect, x).otherwise(x * aspect / now), F.when(now < aspect, y * now / aspect).otherwise(y))


def never_flat(extent: Column) -> Column:
    """An extent whose side is shorter than a metre is opened to one around its middle; null without points."""
    x, y = _sides(extent)
    return F.when(x.isNotNull() & y.isNotNull(), _centred(extent, F.greatest(x, F.lit(LEAST_SIDE)), F.greatest(y, F.lit(LEAST_SIDE))))


def with_margin(extent: Column, margin: float) -> Column:
    """Padded on all sides alike, by a share of the longer one."""
    x, y = _sides(extent)
    pad = margin * F.greatest(x, y)
    return box(extent["west"] - pad, extent["south"] - pad, extent["east"] + pad, extent["north"] + pad)
