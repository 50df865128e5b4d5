"""Rings as arrays of struct<x, y>: closing, areas, clipping to half planes and rectangles, point tests. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same(a: Column, b: Column) -> Column:
    return (F.abs(a["x"] - b["x"]) <= EPSILON) & (F.abs(a["y"] - b["y"]) <= EPSILON)


def is_finite(p: Column) -> Column:
    """Whether both coordinates are numbers: not null, not NaN, not infinite."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce(number(p["x"]) & number(p["y"]), F.lit(False))


def from_flat(flat: Column) -> Column:
    """x0, y0, x1, y1, ... to points."""
    return F.when(F.size(flat) < 2, F.array().cast("array<struct<x: double, y: double>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: point(F.get(flat, 2 * i), F.get(flat, 2 * i + 1))))


def closed(ring: Column) -> Column:
    """The ring with its first point at its end too; rings under two points stay."""
    return let(ring, lambda r: F.when((F.size(r) < 2) | same(F.get(r, F.lit(0)), F.try_element_at(r, F.lit(-1))), r).otherwise(F.concat(r, F.slice(r, 1, 1))))


def opened(ring: Column) -> Column:
    """The ring without a repeated end."""
    return let(ring, lambda r: F.when((F.size(r) > 1) & same(F.get(r, F.lit(0)), F.try_element_at(r, F.lit(-1))), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))


def without_repeats(ring: Column) -> Column:
    """Points that equal the one before them are left out."""
    return let(ring, lambda r: F.filter(F.transform(r, lambda p, i: F.when((i == 0) | ~same(p, F.get(r, i - 1)), p)), lambda p: p.isNotNull()))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive if counter-clockwise; open and closed rings alike."""
    terms = lambda r: F.transform(r, lambda p, i: let(F.get(r, (i + 1) % F.size(r)), lambda q: p["x"] * q["y"] - q["x"] * p["y"]))
    return F.aggregate(let(ring, terms), F.lit(0.0), lambda a, t: a + t) / 2


def valid(ring: Column) -> Column:
    """Four points or more when closed, all finite, and of some area."""
    finite = F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) != float("inf")) & (F.abs(p["y"]) != float("inf")))
    return finite & let(closed(ring), lambda c: (F.size(c) >= 4) & (F.abs(signed_area(c)) >= EPSILON))


def oriented(ring: Column, clockwise: bool) -> Column:
    turned = signed_area(ring) > 0 if clockwise else signed_area(ring) < 0
    return F.when(turned, F.reverse(ring)).otherwise(ring)


def affine(ring: Column, ax: Column, bx: Column, ay: Column, by: Column) -> Column:
    """x to ax * x + bx, y to ay * y + by."""
    return F.transform(ring, lambda p: point(ax * p["x"] + bx, ay * p["y"] + by))


def to_tile(ring: Column, rect: Column) -> Column:
    """Degrees to shares of a tile (0 in the south-west); latitudes are clamped to the poles."""
    return F.transform(ring, lambda p: point((p["x"] - rect["west"]) / (rect["east"] - rect["west"]), (F.greatest(F.lit(-90.0), F.least(F.lit(90.0), p["y"])) - rect["south"]) / (rect["north"] - rect["south"])))


def half_plane(ring: Column, axis: str, limit: Column, below: bool) -> Column:
    """The part of an open ring on one side of x = limit or y = limit; points on the line are in."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: p[axis] <= limit if below else p[axis] >= limit

    def edge(p: Column, q: Column) -> Column:
        share = (limit - p[axis]) / (q[axis] - p[axis])
        across = p[other] + share * (q[other] - p[other])
        cut = point(limit, across) if axis == "x" else point(across, limit)
        return F.array_compact(F.array(F.when(inside(p), p), F.when(inside(p) != inside(q), cut)))

    return let(ring, lambda r: F.flatten(F.transform(r, lambda p, i: let(F.get(r, (i + 1) % F.size(r)), lambda q: edge(p, q)))))


def clip(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """An open ring cut to a rectangle. Concave rings may get bridges of no area along its edges."""
    sides = [("x", west, False), ("x", east, True), ("y", south, False), ("y", north, True)]
    return reduce(lambda r, s: half_plane(r, *s), sides, ring)


def quarters(ring: Column, ratio: Column) -> Column:
    """array<struct<qx, qy, ring>>: a ring of tile shares cut at x = 1/2 and y = ratio, each part in its child's shares."""
    r = F.least(F.greatest(ratio, F.lit(EPSILON)), F.lit(1 - EPSILON))
    one, zero, half = F.lit(1.0), F.lit(0.0), F.lit(0.5)

    def child(qx: int, qy: int) -> Column:  # qy 0 is the northern child: rows grow south
        x0, x1 = (zero, half) if qx == 0 else (half, one)
        y0, y1 = (r, one) if qy == 0 else (zero, r)
        part = clip(ring, x0, y0, x1, y1)
        return F.struct(F.lit(qx).alias("qx"), F.lit(qy).alias("qy"), F.transform(part, lambda p: point((p["x"] - x0) / (x1 - x0), (p["y"] - y0) / (y1 - y0))).alias("ring"))

    return F.array(*(child(qx, qy) for qx in (0, 1) for qy in (0, 1)))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point."""
    def crosses(p: Column, q: Column) -> Column:
        return F.when((p["y"] > y) != (q["y"] > y), x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]).otherwise(False)

    hits = F.transform(ring, lambda p, i: let(F.get(ring, (i + 1) % F.size(ring)), lambda q: crosses(p, q).cast("int")))
    return F.aggregate(hits, F.lit(0), lambda a, h: a + h) % 2 == 1


def polygon_area(exterior: Column, interiors: Column) -> Column:
    return F.abs(signed_area(exterior)) - F.aggregate(F.transform(interiors, lambda r: F.abs(signed_area(r))), F.lit(0.0), lambda a, b: a + b)


def clip_key(rings: Column) -> Column:
    """A hash of rings rounded to six digits, whatever their order."""
    return F.xxhash64(F.array_sort(F.transform(rings, lambda r: F.array_join(F.transform(r, lambda p: F.concat_ws(",", F.format_number(p["x"], 6), F.format_number(p["y"], 6))), ";"))))

#: Latitudes within this of 90 degrees are a pole's.
POLE = 1e-6


def pole(lat: Column) -> Column:
    """1 at the north pole, -1 at the south pole, 0 elsewhere."""
    return F.when(F.abs(F.abs(lat) - 90) > POLE, 0).when(lat >= 0, 1).otherwise(-1)


def from_first(ring: Column, wanted) -> Column:
    """An open ring turned so that it starts at its first point for which `wanted` holds; as it is if there is none."""

    def turned(r: Column) -> Column:
        at = F.array_position(F.transform(r, wanted), F.lit(True)).cast("int")
        return F.when(at <= 1, r).otherwise(F.concat(F.slice(r, at, F.size(r)), F.slice(r, F.lit(1), at - 1)))

    return let(ring, turned)


def with_pole_edges(ring: Column) -> Column:
    """An open ring of degrees whose runs of polar points become two points on the pole's edge, at the longitudes of the points before and after the run: a pole has no longitude of its own. A ring of nothing but polar points is empty."""

    def edges(r: Column) -> Column:
        sign = lambda i: pole(F.get(r, (i + F.size(r)) % F.size(r))["y"])

        def at(p: Column, i: Column) -> Column:
            here = pole(p["y"])
            before, after = F.get(r, (i - 1 + F.size(r)) % F.size(r)), F.get(r, (i + 1) % F.size(r))
            starts, ends = (here != 0) & (sign(i - 1) != here), (here != 0) & (sign(i + 1) != here)
            side = lambda q: point(q["x"], here * F.lit(90.0))
            return F.array_compact(F.array(F.when(here == 0, p), F.when(starts, side(before)), F.when(ends, side(after))))

        return F.when(F.exists(r, lambda p: pole(p["y"]) == 0), F.flatten(F.transform(r, at))).otherwise(F.filter(r, lambda p: F.lit(False)))

    return let(from_first(ring, lambda p: pole(p["y"]) == 0), edges)


def to_tile_clip(ring: Column, rect: Column) -> Column:
    """A ring of degrees as an open ring of tile shares, cut to the tile; empty where they don't meet."""
    shares = to_tile(with_pole_edges(opened(ring)), rect)
    cut = let(opened(without_repeats(shares)), lambda r: clip(r, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    return let(cut, lambda r: F.when((F.size(r) >= 3) & (F.abs(signed_area(r)) >= EPSILON), r).otherwise(F.filter(r, lambda p: F.lit(False))))
