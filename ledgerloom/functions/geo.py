"""Geographic filters over longitude and latitude columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def in_envelope(lon: Column, lat: Column, west: float, north: float, east: float, south: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def in_ring(lon: Column, lat: Column, ring: Ring) -> Column:
    """Whether a ray to the east crosses the ring an odd number of times. The ring's box is tested
    first as plain comparisons, which reach the scan."""
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(closed, closed[1:]):
        if y1 != y2:
            hit = ((lat < y1) != (lat < y2)) & (lon < F.lit(x1) + (lat - y1) * (x2 - x1) / (y2 - y1))
            crossings = crossings + hit.cast("int")
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return in_envelope(lon, lat, min(xs), max(ys), max(xs), min(ys)) & (crossings % 2 == 1)


def in_polygon(lon: Column, lat: Column, rings: list[Ring]) -> Column:
    """Inside the first ring and in none of the holes that follow it."""
    inside = in_ring(lon, lat, rings[0])
    for hole in rings[1:]:
        inside = inside & ~in_ring(lon, lat, hole)
    return inside


def in_multipolygon(lon: Column, lat: Column, polygons: list[list[Ring]]) -> Column:
    inside = F.lit(False)
    for rings in polygons:
        inside = inside | in_polygon(lon, lat, rings)
    return inside
