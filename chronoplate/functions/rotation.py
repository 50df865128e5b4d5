"""Quaternions, rotation matrices and sphere positions as Columns.

A quaternion is a struct (x, y, z, w), a vector a struct (x, y, z), a matrix an array of nine doubles, row by row. Angles are
degrees where a name says so. Positions are on a sphere of `EARTH` metres.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the reference sphere in metres.
EARTH = 6371009.0


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))


def identity() -> Column:
    zero = F.lit(0.0)
    return quaternion(zero, zero, zero, F.lit(1.0))


def unit_vector(lon_deg: Column, lat_deg: Column) -> Column:
    lon, lat = F.radians(lon_deg), F.radians(lat_deg)
    return vector(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def position(lon_deg: Column, lat_deg: Column, radius: float = EARTH) -> Column:
    v = unit_vector(lon_deg, lat_deg)
    return vector(v["x"] * radius, v["y"] * radius, v["z"] * radius)


def lon_lat(v: Column) -> Column:
    """(lon, lat) in degrees of a vector."""
    return F.struct(F.degrees(F.atan2(v["y"], v["x"])).alias("lon"), F.degrees(F.atan2(v["z"], F.hypot(v["x"], v["y"]))).alias("lat"))


def from_pole(pole_lon: Column, pole_lat: Column, angle_deg: Column) -> Column:
    """Rotation by an angle about an Euler pole."""
    v, half = unit_vector(pole_lon, pole_lat), F.radians(angle_deg) / 2
    return quaternion(v["x"] * F.sin(half), v["y"] * F.sin(half), v["z"] * F.sin(half), F.cos(half))


def multiply(a: Column, b: Column) -> Column:
    """a after b."""
    return quaternion(
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
    )


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc from a (t = 0) to b (t = 1); nearly equal ends go straight."""
    one = F.lit(1.0)

    def weights(dot: Column) -> Column:
        angle = F.acos(F.least(one, F.abs(dot)))
        sign = F.when(dot < 0, -one).otherwise(one)
        arc = lambda s: F.struct((F.sin((1 - s["t"]) * s["angle"]) / F.sin(s["angle"])).alias("a"), (F.sin(s["t"] * s["angle"]) / F.sin(s["angle"]) * s["sign"]).alias("b"))
        straight = F.struct((1 - t).alias("a"), (t * sign).alias("b"))
        given = F.struct(angle.alias("angle"), sign.alias("sign"), t.alias("t"))
        return F.when(F.abs(dot) > 1 - 1e-12, straight).otherwise(F.get(F.transform(F.array(given), arc), F.lit(0)))

    dot = sum((a[c] * b[c] for c in "yzw"), a["x"] * b["x"])
    mixed = lambda w: quaternion(*(w["a"] * a[c] + w["b"] * b[c] for c in "xyzw"))
    # Lambdas over arrays of one: the product and the weights are computed once, not once a component.
    return F.get(F.transform(F.transform(F.array(dot), weights), mixed), F.lit(0))


def matrix(q: Column) -> Column:
    x, y, z, w = (q[c] for c in "xyzw")
    return F.array(
        x * x - y * y - z * z + w * w, 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), -(x * x) + y * y - z * z + w * w, 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), -(x * x) - y * y + z * z + w * w,
    )


def transpose(m: Column) -> Column:
    """Of a rotation matrix, its inverse."""
    return F.array(*(F.get(m, F.lit(3 * j + i)) for i in range(3) for j in range(3)))


def apply(m: Column, v: Column) -> Column:
    """Matrix times vector."""
    at = lambda i, j: F.get(m, F.lit(3 * i + j))
    return vector(*(reduce(lambda a, b: a + b, (at(i, j) * v[c] for j, c in enumerate("xyz"))) for i in range(3)))


def moved_sphere(sphere: Column, m: Column) -> Column:
    """A bounding sphere (x, y, z, r) turned by a matrix: its centre moves, its radius stays."""
    c = apply(m, sphere)
    return F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"), sphere["r"].alias("r"))


def in_degrees(rect: Column) -> Column:
    """A rectangle (west, south, east, north) of radians in degrees."""
    return F.struct(*(F.degrees(rect[c]).alias(c) for c in ("west", "south", "east", "north")))


def rotate_about(v: Column, pole_lon: Column, pole_lat: Column, angle_deg: Column) -> Column:
    """One point turned about an axis."""
    return apply(matrix(from_pole(pole_lon, pole_lat, angle_deg)), v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "yz"), (a["x"] - b["x"]) * (a["x"] - b["x"])))


def is_anchor(plate: Column, anchor: str | None) -> Column:
    """Whether a plate id is the anchor's; integers compare as numbers ("000" is "0")."""
    if anchor is None:
        return F.lit(False)
    plain = lambda c: F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("decimal(38,0)").cast("string")).otherwise(F.trim(c))
    return plain(plate) == plain(F.lit(anchor))


def wrap_longitude(radians: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(radians + F.pi(), 2 * F.pi()) - F.pi()
