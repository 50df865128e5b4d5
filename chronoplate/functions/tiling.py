"""Tile grids: rectangles, positions and spans, for the geographic (2 x 1 roots) and the Web Mercator (1 x 1) scheme.

Degrees throughout; rows grow south. `scheme` is a Python string, so that each plan holds the arithmetic of one scheme.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoplate.functions.rotation import EARTH

GEOGRAPHIC, MERCATOR = "geographic", "web-mercator"
#: Northern limit of the Web Mercator square in degrees.
MERCATOR_LAT = math.degrees(math.pi / 2 - 2 * math.atan(math.exp(-math.pi)))


def columns_at(level: Column, scheme: str) -> Column:
    return (F.pow(F.lit(2.0), level) * (2 if scheme == GEOGRAPHIC else 1)).cast("int")


def rows_at(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast("int")


def _mercator_lat(share: Column) -> Column:
    """Latitude at a share of the square's height, from the north."""
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * share))))


def _mercator_share(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return 0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())


def rectangle(x: Column, y: Column, level: Column, scheme: str) -> Column:
    """struct<west, south, east, north> of a tile."""
    nx, ny = columns_at(level, scheme), rows_at(level)
    west, east = x / nx * 360 - 180, (x + 1) / nx * 360 - 180
    north = 90 - y / ny * 180 if scheme == GEOGRAPHIC else _mercator_lat(y / ny)
    south = 90 - (y + 1) / ny * 180 if scheme == GEOGRAPHIC else _mercator_lat((y + 1) / ny)
    return F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))


def tile_x(lon: Column, level: Column, scheme: str) -> Column:
    nx = columns_at(level, scheme)
    return F.greatest(F.lit(0), F.least(nx - 1, F.floor((lon + 180) / 360 * nx).cast("int")))


def tile_y(lat: Column, level: Column, scheme: str) -> Column:
    ny = rows_at(level)
    share = (90 - lat) / 180 if scheme == GEOGRAPHIC else _mercator_share(lat)
    return F.greatest(F.lit(0), F.least(ny - 1, F.floor(share * ny).cast("int")))


def row_bounds(y: Column, level: Column, scheme: str) -> tuple[Column, Column]:
    """(south, north) of a row of tiles."""
    ny = rows_at(level)
    lat = (lambda share: 90 - share * 180) if scheme == GEOGRAPHIC else _mercator_lat
    return lat((y + 1) / ny), lat(y / ny)


def limits(scheme: str) -> tuple[float, float, float, float]:
    """(west, south, east, north) of the whole grid."""
    lat = 90.0 if scheme == GEOGRAPHIC else MERCATOR_LAT
    return -180.0, -lat, 180.0, lat


def longitude_chord(lat: Column, width: Column) -> Column:
    """Metres straight between the ends of a longitude span at a latitude; a full circle counts its circumference."""
    w = F.least(F.abs(width), F.lit(360.0))
    ring = F.abs(F.cos(F.radians(lat))) * (2 * EARTH)
    return ring * F.when(F.radians(w) >= 2 * F.pi() - 1e-9, F.pi()).otherwise(F.sin(F.radians(w) / 2))


def latitude_chord(south: Column, north: Column) -> Column:
    return 2 * EARTH * F.sin(F.radians(north - south) / 2)
