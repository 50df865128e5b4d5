"""Flat polygons in degrees: cutting at the antimeridian, bridges over the poles, roots, and the descent through their tiles.

A flat polygon is one closed ring. Longitudes lie in [-180, 180] and jump where an edge crosses the antimeridian. Everything is
made on the polygon's row, without a shuffle, and of built-in functions but for one step: tiles are a frontier of nodes, a row each, that
goes down a level at a time, and the search for branching nodes takes all roots of an Arrow batch down together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from chronoplate.functions import geometry as G
from chronoplate.functions import tiling as T
from chronoplate.operators.areas import clip_mode

#: Latitudes beyond the limit are moved to it; an edge crosses the antimeridian if both ends lie beyond NEAR and more
#: than half a turn apart; a ring whose longitudes sum up to a turn, within a tenth of a degree, goes round a pole; ends this close are one point.
POLAR_LIMIT = 89.5
NEAR = 120.0
TURN_ACCURACY = 0.1
SAME_POINT = 1e-7
#: Levels that the search for a branching tile goes down: the numbers of tiles below are no 32-bit integers.
DEEPEST = 28


_CROSSINGS = "array<struct<i:int,east:boolean,y:double>>"
_DEALT = "array<struct<part:int,x:double,y:double>>"


def _crossings(ring: Column) -> Column:
    """array<struct<i, east, y>>: the edges, by their first vertex, that cross the antimeridian, whether eastward, and the latitude where they do."""

    def crossing(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, i + 1)
        step = q["x"] - p["x"]
        crosses = (F.abs(p["x"]) > NEAR) & (F.abs(q["x"]) > NEAR) & (F.abs(step) > 180)
        east = step < 0
        side = F.when(east, 180.0).otherwise(-180.0)
        y = p["y"] + (side - p["x"]) / (step + F.when(east, 360.0).otherwise(-360.0)) * (q["y"] - p["y"])
        return F.when(crosses, F.struct(i.alias("i"), east.alias("east"), y.alias("y")))

    # Longitudes cross only between points beyond NEAR on both sides; numbers that are none are looked at edge by edge.
    reaches = F.exists(ring, lambda p: p["x"] > NEAR) & F.exists(ring, lambda p: p["x"] < -NEAR) | F.exists(ring, lambda p: F.abs(p["x"]) > 180)
    return F.when(reaches, F.array_compact(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), crossing))).otherwise(F.array().cast(_CROSSINGS))


def _winding(ring: Column, crossings: Column) -> Column:
    """Degrees of longitude that the ring turns through, eastward positive."""
    jumps = F.aggregate(crossings, F.lit(0.0), lambda a, c: a + F.when(c["east"], 360.0).otherwise(-360.0))
    return F.element_at(ring, -1)["x"] - F.get(ring, F.lit(0))["x"] + jumps


def _bridge(ring: Column, crossings: Column) -> Column:
    """The crossing nearest to the pole that the ring goes round (the first of equal ones), with `pole` 1 or -1."""
    north = F.aggregate(F.slice(ring, F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda a, p: a + p["y"]) >= 0
    sign = F.when(north, 1.0).otherwise(-1.0)
    best = F.array_max(F.transform(crossings, lambda c: F.struct((c["y"] * sign).alias("near"), (-c["i"]).alias("first"), c.alias("c"))))
    return F.struct(best["c"]["i"].alias("i"), best["c"]["east"].alias("east"), best["c"]["y"].alias("y"), sign.alias("pole"))


def _dealt(ring: Column, crossings: Column, bridge: Column) -> Column:
    """array<struct<part, x, y>>: the vertices with the bridge's, each in part 0 or 1; the points on the antimeridian are in both, on either side."""
    point = lambda part, x, y: F.struct(part.alias("part"), x.alias("x"), y.alias("y"))
    none = F.array().cast(_DEALT)

    def dealt(left: Column) -> Column:
        even = F.size(left) % 2 == 0  # an odd number leaves the polygon whole

        def at(p: Column, i: Column, part: Column) -> Column:
            side = F.when(bridge["east"], 180.0).otherwise(-180.0)
            over = F.array(*(point(part, x, y) for x, y in ((side, bridge["y"]), (side, bridge["pole"] * POLAR_LIMIT), (-side, bridge["pole"] * POLAR_LIMIT), (-side, bridge["y"]))))
            here = F.when(even, F.get(F.filter(left, lambda c: c["i"] == i), F.lit(0)))
            edge = lambda h: F.when(h["east"], 180.0).otherwise(-180.0)
            both = G.let(here, lambda h: F.when(h.isNotNull(), F.array(point(part, edge(h), h["y"]), point(1 - part, -edge(h), h["y"]))).otherwise(none))
            return F.concat(F.array(point(part, p["x"], p["y"])), F.when(bridge["i"] == i, over).otherwise(none), both)

        part = lambda i: F.when(even, F.size(F.filter(left, lambda c: c["i"] < i)) % 2).otherwise(0)
        return F.flatten(F.transform(ring, lambda p, i: G.let(part(i), lambda k: at(p, i, k))))

    return G.let(F.filter(crossings, lambda c: bridge["i"].isNull() | (c["i"] != bridge["i"])), dealt)


def _ring_of(dealt: Column, part: int) -> Column:
    """One part, closed."""
    return _ended(F.transform(F.filter(dealt, lambda p: p["part"] == part), lambda p: G.point(p["x"], p["y"])))


def _ended(ring: Column) -> Column:
    """The ring with its first point at its end too, unless the end is nearly that."""
    apart = lambda a, b: (F.abs(a["x"] - b["x"]) > SAME_POINT) | (F.abs(a["y"] - b["y"]) > SAME_POINT)
    return G.let(ring, lambda r: F.when((F.size(r) > 0) & apart(F.get(r, F.lit(0)), F.try_element_at(r, F.lit(-1))), F.concat(r, F.slice(r, 1, 1))).otherwise(r))


def cut_at_antimeridian(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Polygons with `crossings`, `winding` in degrees, `bridged`, `west` and `east` (whether it has points there) and `parts`, an array of one or two closed rings.

    Latitudes are cut to POLAR_LIMIT. A ring round a pole gets a bridge along the antimeridian, where it crosses it nearest to the
    pole; what crossings are left come in pairs, between which the vertices go to the second part. An odd number of them leaves the
    ring whole; a turn without a crossing leaves it unbridged. Rings without points have no parts; a null ring has null columns. Rings may be open."""
    clamped = F.transform(G.closed(F.col(ring)), lambda p: G.point(p["x"], F.greatest(F.lit(-POLAR_LIMIT), F.least(F.lit(POLAR_LIMIT), p["y"]))))
    # A generator of one row: the planner doesn't merge what is computed before it into what comes after.
    step = lambda df, **named: df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in named.items())))))
    some = step(polygons, _r=clamped)
    some = step(some, crossings=F.when(F.size("_r") > 1, _crossings(F.col("_r"))).otherwise(F.when(F.col("_r").isNotNull(), F.array().cast(_CROSSINGS))))
    some = step(some, winding=F.when(F.size("_r") > 1, _winding(F.col("_r"), F.col("crossings"))))
    turns = (F.abs(F.abs("winding") - 360) < TURN_ACCURACY) & (F.size("crossings") > 0)
    some = step(some, _b=F.when(turns, _bridge(F.col("_r"), F.col("crossings"))))
    # What doesn't cross the antimeridian is one part as it is.
    crossed = F.size("crossings") > 0
    some = step(some, _d=F.when(crossed, _dealt(F.col("_r"), F.col("crossings"), F.col("_b"))))
    parts = F.filter(F.when(crossed, F.array(_ring_of(F.col("_d"), 0), _ring_of(F.col("_d"), 1))).otherwise(F.array(_ended(F.col("_r")))), lambda r: F.size(r) > 0)
    sides = {"west": F.exists("_r", lambda p: p["x"] < 0), "east": F.exists("_r", lambda p: p["x"] > 0)}
    return step(some, bridged=F.col("_b").isNotNull(), **sides, parts=F.when(F.col("_r").isNotNull(), parts)).drop("_r", "_b", "_d")


def roots(cut: DataFrame, scheme: str = T.GEOGRAPHIC) -> DataFrame:
    """A row for each part of each polygon of cut_at_antimeridian() and root tile that it is dealt to: x, y, l, the tile's rectangle (`west`, `south`, `east`, `north`), `clip` (closed ring of tile shares) and `status`.

    In the geographic scheme a polygon with points on both sides of the prime meridian is cut there, and otherwise belongs to its side's root."""
    keep = [c for c in cut.columns if c not in ("crossings", "winding", "bridged", "west", "east", "parts")]
    part = cut.select(*keep, "west", "east", F.explode("parts").alias("_p"))
    low = -90.0 if scheme == T.GEOGRAPHIC else -T.MERCATOR_LAT
    width, height = (180.0, 180.0) if scheme == T.GEOGRAPHIC else (360.0, 2 * T.MERCATOR_LAT)
    if scheme == T.MERCATOR:
        height_share = lambda p: (p["y"] - low) / height
        mine = F.array(F.struct(F.lit(0).alias("x"), F.transform("_p", lambda p: G.point((p["x"] + 180) / width, height_share(p))).alias("clip")))
    else:
        shares = F.transform("_p", lambda p: G.point((p["x"] + 180) / width, (p["y"] - low) / height))
        one = F.lit(1.0)
        half = lambda below: G.closed(G.half_plane(G.opened(shares), "x", one, below))
        moved = lambda r: F.transform(r, lambda p: G.point(p["x"] - 1, p["y"]))
        root = lambda x, r: F.struct(F.lit(x).alias("x"), r.alias("clip"))
        both = F.array(root(0, half(True)), root(1, moved(half(False))))
        mine = F.when(F.col("west") & F.col("east"), both).when(F.col("west"), F.array(root(0, shares))).otherwise(F.array(root(1, moved(shares))))
    at = part.select(*keep, F.inline(mine)).withColumns({"y": F.lit(0), "l": F.lit(0)})
    rect = T.rectangle(F.col("x"), F.col("y"), F.col("l"), scheme)
    return _classed(at.select(*keep, "x", "y", "l", *(rect[c].alias(c) for c in ("west", "south", "east", "north")), "clip"))


def _classed(nodes: DataFrame) -> DataFrame:
    """Nodes with their `status`; only one that is cut keeps its ring."""
    told = nodes.select("*", F.inline(F.array(F.struct(G.let(G.opened(F.col("clip")), clip_mode).alias("status")))))
    return told.withColumn("clip", F.when(F.col("status") == "CLIP", F.col("clip")))


#: Children in the order in which they are looked at.
CHILDREN = ("south-west", "north-west", "south-east", "north-east")


def _ratio(scheme: str) -> Column:
    """Where the real rectangles of a node's children meet, as a share of its height from the south."""
    upper = T.rectangle(F.col("x") * 2, F.col("y") * 2, F.col("l") + 1, scheme)
    lower = T.rectangle(F.col("x") * 2, F.col("y") * 2 + 1, F.col("l") + 1, scheme)
    return (lower["north"] - lower["south"]) / (upper["north"] - lower["south"])


def _quarters(ring: Column, ratio: Column) -> Column:
    """An open ring of shares cut at x = 1/2, and each half at y = ratio: four open rings of their child's shares, in the order of CHILDREN."""
    half, one = F.lit(0.5), F.lit(1.0)

    def rows(side: Column, west: Column) -> Column:
        lower = lambda r: F.transform(G.half_plane(r, "y", ratio, True), lambda p: G.point((p["x"] - west) * 2, p["y"] / ratio))
        upper = lambda r: F.transform(G.half_plane(r, "y", ratio, False), lambda p: G.point((p["x"] - west) * 2, (p["y"] - ratio) / (one - ratio)))
        return G.let(side, lambda r: F.array(lower(r), upper(r)))

    return F.concat(rows(G.half_plane(ring, "x", half, True), F.lit(0.0)), rows(G.half_plane(ring, "x", half, False), half))


def children(nodes: DataFrame, scheme: str = T.GEOGRAPHIC) -> DataFrame:
    """The four children of each node that isn't NONE, with `child` (0 to 3, as in CHILDREN). Rectangles are halved in degrees; rings are cut where the scheme's real rows meet, which differs in Web Mercator. A full node's children are full."""
    keep = [c for c in nodes.columns if c not in ("x", "y", "l", "west", "south", "east", "north", "clip", "status")]
    rings = F.when(F.col("status") == "CLIP", G.let(G.opened(F.col("clip")), lambda r: G.let(_ratio(scheme), lambda k: _quarters(r, k))))
    cut = nodes.filter("status <> 'NONE'").select(*keep, "x", "y", "l", "west", "south", "east", "north", F.posexplode(F.coalesce(rings, F.array(*[F.lit(None)] * 4).cast("array<array<struct<x:double,y:double>>>"))).alias("child", "_ring"))
    east, north = F.col("child") >= 2, F.col("child") % 2 == 1
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    return cut.select(
        *keep,
        "child",
        (F.col("x") * 2 + east.cast("int")).alias("x"),
        (F.col("y") * 2 + (~north).cast("int")).alias("y"),
        (F.col("l") + 1).alias("l"),
        F.when(east, x).otherwise(F.col("west")).alias("west"),
        F.when(north, y).otherwise(F.col("south")).alias("south"),
        F.when(east, F.col("east")).otherwise(x).alias("east"),
        F.when(north, F.col("north")).otherwise(y).alias("north"),
        F.inline(F.array(F.struct(G.closed(F.col("_ring")).alias("clip"), F.coalesce(clip_mode(F.col("_ring")), F.lit("FULL")).alias("status")))),
    ).withColumn("clip", F.when(F.col("status") == "CLIP", F.col("clip")))


def tiles_at(root_nodes: DataFrame, level: int, scheme: str = T.GEOGRAPHIC) -> DataFrame:
    """The nodes of a level that aren't NONE, below roots(): one frontier, in which only cut nodes have rings to cut."""
    nodes = root_nodes
    for _ in range(level):
        nodes = children(nodes, scheme).drop("child")
    return nodes.filter("status <> 'NONE'")


_RECTANGLE = ("west", "south", "east", "north")
#: Children of nodes of this level have numbers that are no 32-bit integers.
_LAST = 30
_NONE, _CLIP, _FULL = range(3)


class _Rings(NamedTuple):
    """Open rings of shares, one after the other: their points, whether x is known (latitudes always are), and how many points each ring has."""

    x: np.ndarray
    y: np.ndarray
    known: np.ndarray
    counts: np.ndarray

    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def after(self) -> np.ndarray:
        """The place of the next point round its ring."""
        places, ends, some = np.arange(1, len(self.x) + 1), np.cumsum(self.counts), self.counts > 0
        places[ends[some] - 1] = (ends - self.counts)[some]
        return places

    def only(self, rows: np.ndarray) -> _Rings:
        held = np.repeat(rows, self.counts)
        return _Rings(self.x[held], self.y[held], self.known[held], self.counts[rows])


def _rings(clips: pa.Array) -> _Rings:
    """Rings of an Arrow batch; a null one has no points."""
    x, y = clips.flatten().flatten()
    counts = pc.fill_null(pc.list_value_length(clips), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _Rings(*(c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in (x, y)), x.is_valid().to_numpy(zero_copy_only=False), counts)


def _half(rings: _Rings, axis: str, limit: np.ndarray, below: bool) -> _Rings:
    """G.half_plane() of each ring at its own limit. As there, NaN is above all numbers, and what has no x is on no side of one."""
    of, after = rings.of(), rings.after()
    v, w = (rings.x, rings.y) if axis == "x" else (rings.y, rings.x)
    at = limit[of]
    inside = v <= at if below else ~(v < at)
    crosses = inside != inside[after]
    if axis == "x":
        inside, crosses = inside & rings.known, crosses & rings.known & rings.known[after]
    n = inside.astype(np.int64) + crosses
    first = np.cumsum(n) - n
    points = int(n.sum())
    to_v, to_w, known = np.empty(points), np.empty(points), np.empty(points, bool)
    kept, p = first[inside], np.flatnonzero(crosses)
    to_v[kept], to_w[kept], known[kept] = v[inside], w[inside], rings.known[inside]
    cut, q = first[p] + inside[p], after[p]
    to_v[cut], to_w[cut], known[cut] = at[p], w[p] + (at[p] - v[p]) / (v[q] - v[p]) * (w[q] - w[p]), rings.known[p] & rings.known[q]
    x, y = (to_v, to_w) if axis == "x" else (to_w, to_v)
    return _Rings(x, y, known, np.bincount(of, n, len(rings.counts)).astype(np.int64))


def _modes(rings: _Rings) -> np.ndarray:
    """clip_mode() of each ring."""
    x, y, of, after, n = rings.x, rings.y, rings.of(), rings.after(), len(rings.counts)
    on = ((x == 0) | (x == 1)) & (y >= 0) & (y <= 1) | ((y == 0) | (y == 1)) & (x >= 0) & (x <= 1)
    off = np.bincount(of, ~(on & rings.known), n) > 0
    held = np.abs(np.bincount(of, x * y[after] - x[after] * y, n) / 2)
    return np.select([rings.counts < 3, off, held <= G.EPSILON, held >= 1 - G.EPSILON], [_NONE, _CLIP, _NONE, _FULL], _CLIP)


def _quarter(rings: _Rings, ratio: np.ndarray, kinds: tuple[int, ...]) -> list[_Rings]:
    """Each ring's part in its children of these kinds, in their shares; see _quarters()."""
    half, out = np.full(len(ratio), 0.5), []
    sides = {east: _half(rings, "x", half, not east) for east in {k >= 2 for k in kinds}}
    for k in kinds:
        east, north = k >= 2, k % 2 == 1
        part = _half(sides[east], "y", ratio, not north)
        r = ratio[part.of()]
        out.append(part._replace(x=(part.x - 0.5 * east) * 2, y=(part.y - r) / (1 - r) if north else part.y / r))
    return out


def _chosen(options: list[_Rings], which: np.ndarray) -> _Rings:
    """Each row's ring from the one of the options that is its own."""
    counts = np.choose(which, [o.counts for o in options])
    start, points = np.cumsum(counts) - counts, int(counts.sum())
    out = _Rings(np.empty(points), np.empty(points), np.empty(points, bool), counts)
    for k, o in enumerate(options):
        of, rows = o.of(), which == k
        held = np.flatnonzero(rows[of])
        to = start[of[held]] + held - (np.cumsum(o.counts) - o.counts)[of[held]]
        out.x[to], out.y[to], out.known[to] = o.x[held], o.y[held], o.known[held]
    return out


def _lat(share: np.ndarray, mercator: np.ndarray) -> np.ndarray:
    return np.where(mercator, np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * share)))), 90 - share * 180)


def _descended(node: dict[str, np.ndarray], rings: _Rings, mercator: np.ndarray, split_to: int) -> np.ndarray:
    """Takes each node down to where its search ends, see extents(); returns which are complete. Rings are those of nodes that are cut."""
    done = node["status"] != _CLIP
    complete, full = done.copy(), np.zeros(len(done), bool)
    child = np.full(len(done), -1)

    def go(rows: np.ndarray, k: np.ndarray) -> None:
        east, north = k >= 2, k % 2 == 1
        for low, high, upper in (("west", "east", east), ("south", "north", north)):
            middle = (node[low][rows] + node[high][rows]) / 2
            node[low][rows], node[high][rows] = np.where(upper, middle, node[low][rows]), np.where(upper, node[high][rows], middle)
        node["x"][rows], node["y"][rows] = node["x"][rows] * 2 + east, node["y"][rows] * 2 + ~north
        node["l"][rows] += 1
        child[rows] = k

    live = np.flatnonzero(~done)
    rings = rings.only(~done)
    for step in range(DEEPEST * (4 if split_to else 1)):
        stage = step % 4 if split_to else 0
        looks = node["l"][live] < _LAST if stage == 0 else (child[live] < stage) & (node["l"][live] < min(split_to, _LAST))
        if stage == 0:  # no child is seen of those that are as deep as numbers go
            live, rings = live[looks], rings.only(looks)
            looks = looks[looks]
        rows = live[looks]
        if not len(rows):
            if stage == 0:
                break
            continue
        y, n = node["y"][rows], 2.0 ** (node["l"][rows] + 1)
        top, middle, low = (_lat((2 * y + k) / n, mercator[rows]) for k in range(3))
        kinds = (stage,) if stage else (0, 1, 2, 3)
        kids = _quarter(rings.only(looks), (middle - low) / (top - low), kinds)
        modes = np.where(full[rows], _FULL, np.stack([_modes(r) for r in kids]))
        seen = modes != _NONE
        one, to = seen.sum(0) == 1, seen.argmax(0)
        moved = rows[one]
        go(moved, np.array(kinds)[to[one]])
        full[moved] = modes[to, np.arange(len(rows))][one] == _FULL
        if stage == 0:
            complete[rows] = seen.sum(0) > 1
            live, rings = moved, _chosen(kids, to).only(one)
        else:
            counts, goes = np.zeros(len(live), np.int64), looks.copy()
            counts[looks], goes[looks] = kids[0].counts, one
            rings = _chosen([rings, kids[0]._replace(counts=counts)], goes.astype(int))
    return complete


def extents(root_nodes: DataFrame, scheme: str = T.GEOGRAPHIC, split_to: int = 0) -> DataFrame:
    """Root rows with `to_x`, `to_y`, `to_l`, the rectangle `to_west`..`to_north` of the first node under each root that branches, and `complete`.

    A node branches if two or more of its children aren't NONE; a root that is NONE itself counts as branching. From a node with one
    such child the search goes on in it, and then looks, in the order of CHILDREN and from where it has got to, for children of the
    later kinds among nodes that have been split before: those above level `split_to`, as left by tiles_at(split_to). It can so
    pass a branching node. A root under which no node branches is not `complete`: a node without children, or DEEPEST levels.

    Each root goes down on its own row, in Arrow batches (numpy) and with nothing to shuffle; a step is one pass over the batch's rings that are still on their way."""
    rest = [c for c in root_nodes.columns if c not in ("clip", "status")]
    told = [f"to_{c}" for c in ("x", "y", "l", *_RECTANGLE)]
    number = {c: IntegerType() if c in ("to_x", "to_y", "to_l") else DoubleType() for c in told}
    schema = StructType([*root_nodes.select(*rest).schema.fields, *(StructField(c, t) for c, t in number.items()), StructField("complete", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64 if c in ("x", "y", "l") else float) for c in ("x", "y", "l", *_RECTANGLE)}
            node["status"] = np.where(batch.column("_cut").to_numpy(zero_copy_only=False), _CLIP, _NONE)
            with np.errstate(all="ignore"):
                complete = _descended(node, _rings(batch.column("_ring")), np.full(batch.num_rows, scheme == T.MERCATOR), split_to)
            found = [pa.array(node[c[3:]], pa.int32() if number[c] == IntegerType() else pa.float64()) for c in told]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *found, pa.array(complete)], schema.names)

    cut = F.col("status") == "CLIP"
    return root_nodes.select(*rest, cut.alias("_cut"), F.when(cut, G.opened(F.col("clip"))).alias("_ring")).mapInArrow(run, schema)
