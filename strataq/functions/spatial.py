"""Distances, polygons and cell codes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2, lon2) -> Column:
    """Metres on the sphere."""
    a1, a2 = F.radians(lat1), F.radians(F.lit(lat2) if not isinstance(lat2, Column) else lat2)
    dl = F.radians((F.lit(lon2) if not isinstance(lon2, Column) else lon2) - lon1)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    across = lon.between(west, east) if west <= east else ((lon >= west) | (lon <= east))
    return lat.between(south, north) & across


def radius_box(lat: Column, lon: Column, at: tuple[float, float], metres: float) -> Column:
    """A box about the circle, for the scan to skip by; no longitude bound near a pole or across the date line."""
    d = math.degrees(metres / EARTH)
    cond = lat.between(at[0] - d, at[0] + d)
    if abs(at[0]) + d < 89:
        w = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(at[0])))))
        if -180 <= at[1] - w and at[1] + w <= 180:
            cond = cond & lon.between(at[1] - w, at[1] + w)
    return cond


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]], holes=()) -> Column:
    """Ray casting over the ring's edges; the constant ring folds into the expression."""
    odd = F.lit(False)
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
        odd = odd != crosses
    for h in holes:
        odd = odd & ~in_polygon(lat, lon, list(h))
    return odd


def winding(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Winding number, which also tells points of self-crossing rings; 0 is outside."""
    n = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]):
        side = (x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1)
        n = n + F.when((F.lit(y1) <= lat) & (F.lit(y2) > lat) & (side > 0), 1).when((F.lit(y1) > lat) & (F.lit(y2) <= lat) & (side < 0), -1).otherwise(0)
    return n


def in_convex(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    left, right = F.lit(True), F.lit(True)
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]):
        side = (x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1)
        left, right = left & (side >= 0), right & (side <= 0)
    return left | right


def signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(x1 * y2 - x2 * y1 for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]])) / 2


def _spread(c: Column, bits: int, stride: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        bit = F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bit, i * stride))
    return out


def morton2(x: Column, y: Column, bits: int = 16) -> Column:
    return _spread(x.cast("long"), bits, 2).bitwiseOR(F.shiftleft(_spread(y.cast("long"), bits, 2), 1))


def morton3(x: Column, y: Column, z: Column, bits: int = 16) -> Column:
    a, b, c = (_spread(v.cast("long"), bits, 3) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def morton_decode(code: Column, axis: int, dims: int = 2, bits: int = 16) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(code, i * dims + axis).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def cell(lat: Column, lon: Column, level: int) -> Column:
    """Cell of a quad-tree on latitude and longitude, 2^level to a side, Morton-coded; the parent is the code shifted by two."""
    n = 1 << level
    y = F.least(F.lit(n - 1), F.floor((lat + 90) / 180 * n))
    x = F.least(F.lit(n - 1), F.floor((lon + 180) / 360 * n))
    return morton2(x, y, max(level, 1))


def cell_parent(code: Column, levels: int = 1) -> Column:
    return F.shiftright(code, 2 * levels)


def cell_children(code: Column) -> Column:
    return F.array(*[F.shiftleft(code, 2) + i for i in range(4)])
