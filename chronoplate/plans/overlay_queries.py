"""Queries on overlays of areas, triangles of large rings, masks by scan lines and the linear filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.functions import geometry as G
from chronoplate.functions import tiling as T
from chronoplate.operators import areas as A
from chronoplate.operators import overlay as V
from chronoplate.operators import raster as RA
from chronoplate.operators.tables import spread
from chronoplate.plans.registry import query, rounded, table

#: Two boxes of each order: the first with a hole, the second beside or over it; all bounds by arithmetic on the key.
_K = "o_orderkey"
_A = [f"{_K} * 37 % 400 * 0.1 - 20", f"{_K} * 53 % 300 * 0.1 - 15", f"{_K} % 17 * 0.3713171 + 2.0171717", f"{_K} % 13 * 0.4131313 + 2.0313131"]
_B = [f"{_K} * 37 % 400 * 0.1 - 20 + {_K} % 11 * 0.5311117 - 3.0131313", f"{_K} * 53 % 300 * 0.1 - 15 + {_K} % 7 * 0.7177771 - 2.0171717", f"{_K} % 19 * 0.2919191 + 1.1119191", f"{_K} % 23 * 0.2323233 + 1.3232323"]
_BOXES = f"""o AS (SELECT {_K}, {_A[0]} AS ax, {_A[1]} AS ay, {_A[2]} AS aw, {_A[3]} AS ah, {_B[0]} AS bx, {_B[1]} AS `by`, {_B[2]} AS bw, {_B[3]} AS bh FROM orders),
s AS (SELECT {_K}, aw * ah * 0.75 AS a, bw * bh AS b,
  greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, `by` + bh) - greatest(ay, `by`))
  - greatest(0, least(ax + aw * 0.75, bx + bw) - greatest(ax + aw * 0.25, bx)) * greatest(0, least(ay + ah * 0.75, `by` + bh) - greatest(ay + ah * 0.25, `by`)) AS i FROM o)""".replace("`", '"')


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(*(G.point((x + w * i).cast("double"), (y + h * j).cast("double")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ([F.expr(x) for x in side] for side in (_A, _B))
    hole = _box(a[0] + a[2] * 0.25, a[1] + a[3] * 0.25, a[2] * 0.5, a[3] * 0.5)
    none = F.array().cast("array<array<struct<x: double, y: double>>>")
    return spread(table(spark, sf_dir, "orders").select(_K)).select(_K, F.array(A.polygon(_box(*a), F.array(hole))).alias("a"), F.array(A.polygon(_box(*b), none)).alias("b"))


_SIZE = {"union": "a + b - i", "intersection": "i", "difference": "a - i", "xor": "a + b - 2 * i"}


@query("U4_overlay_sizes", f"WITH {_BOXES} " + " UNION ALL ".join(f"SELECT {_K}, '{o}' AS operation, round({x}, 6)::DOUBLE AS size FROM s WHERE {x} > 1e-9" for o, x in _SIZE.items()))
def overlay_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(o).alias("operation"), F.col(f"sizes.{o}").alias("size")) for o in V.OPERATIONS))
    out = V.with_sizes(pairs(spark, sf_dir), _K).select(_K, F.inline(each))
    return rounded(out.filter("size > 1e-9").select(_K, "operation", "size"), "size")


@query("U4_difference_areas", f"WITH {_BOXES} SELECT {_K}, round(a - i, 6)::DOUBLE AS size, true AS apart FROM s WHERE a - i > 1e-9")
def difference_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second area leaves of the first, as an area: its size, and whether it lies apart from the second, by sizes of overlays of the result."""
    both = pairs(spark, sf_dir)
    left = V.with_sizes(V.overlay(both, "difference", _K, keep=("b",)), _K, "area", "b")
    shared = F.coalesce(F.col("sizes.intersection") > 1e-9, F.lit(False))
    rows = left.select(_K, A.size(F.col("area")).alias("size"), (~shared).alias("apart"))
    return rounded(rows.filter("size > 1e-9"), "size")


@query(
    "G6_U4_covered_by_union",
    """WITH e AS (SELECT event_id, event_id % 7 * 0.17 + 0.05 AS cut, event_id % 5 * 0.09 AS over, event_id % 3 = 0 AS short FROM events)
    SELECT event_id, NOT short AND least(cut, 1) + over >= least(cut, 1) AND (cut >= 1 OR over > 0 OR NOT short) AS covers FROM e""",
)
def covered_by_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two polygons that may overlap cover the unit tile together; one in three leaves a strip at the top."""
    e = F.col("event_id")
    cut, over, short = F.least(e % 7 * 0.17 + 0.05, F.lit(1.0)), e % 5 * 0.09, e % 3 == 0
    high = F.when(short, 0.9).otherwise(1.1)
    none = F.array().cast("array<array<struct<x: double, y: double>>>")
    cover = F.array(A.polygon(_box(F.lit(-0.1), F.lit(-0.1), cut + over + 0.1, high + 0.1), none), A.polygon(_box(cut, F.lit(-0.2), 1.3 - cut, high + 0.2), none))
    tile = F.array(A.polygon(_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), none))
    rows = table(spark, sf_dir, "events").select("event_id", tile.alias("a"), cover.alias("b"))
    open_ = V.left_uncovered(rows, "event_id").withColumn("open", F.lit(True))
    return rows.select("event_id").join(open_, "event_id", "left").select("event_id", F.col("open").isNull().alias("covers"))


# --- Large rings: the points of a group's parts in the order of their keys, on a circle that goes in and out -----------------------

_RADIUS = "0.3 + p_size * 0.002"
_LARGE = f"""pt AS (SELECT p_size % 5 AS grp, p_partkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY p_size % 5) AS n, {_RADIUS} AS d FROM part WINDOW w AS (PARTITION BY p_size % 5 ORDER BY p_partkey)),
v AS (SELECT grp, i, n, 0.5 + d * cos(2 * pi() * i / n) AS x, 0.5 + d * sin(2 * pi() * i / n) AS y FROM pt),
edge AS (SELECT grp, n, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v WINDOW w AS (PARTITION BY grp ORDER BY i))"""


def large_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 5).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.expr(_RADIUS).cast("double").alias("d")))).alias("pts"))
    angle = lambda i: 2 * F.pi() * i / F.size("pts")
    return part.select("grp", F.transform("pts", lambda p, i: G.point(0.5 + p["d"] * F.cos(angle(i)), 0.5 + p["d"] * F.sin(angle(i)))).alias("ring"))


@query("R7_R8_large_triangles", f"WITH {_LARGE} SELECT grp, 1::BIGINT AS polygons, 1::BIGINT AS interiors, 0::BIGINT AS skipped, (any_value(n) + 4 + 2 - 2)::BIGINT AS triangles, 0::DOUBLE AS deviation, 0::BIGINT AS high, 0::BIGINT AS unbridged FROM edge GROUP BY grp")
def large_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each large ring with a square hole."""
    hole = _box(F.lit(0.4), F.lit(0.45), F.lit(0.15), F.lit(0.1))
    rows = large_rings(spark, sf_dir).select("grp", F.array(A.polygon(F.col("ring"), F.array(hole))).alias("area"))
    return rounded(A.mask_report(rows, ["grp"]), "deviation")


_PIXELS = 48


@query(
    "R5_U5_large_masks",
    f"""WITH {_LARGE}, px AS (SELECT a AS px, b AS py, (a + 0.5) / {_PIXELS} AS u, 1 - (b + 0.5) / {_PIXELS} AS v FROM range({_PIXELS}) r(a), range({_PIXELS}) s(b)),
    hit AS (SELECT grp, px, py FROM edge JOIN px ON (y > v) <> (ny > v) AND u < (nx - x) * (v - y) / (ny - y) + x GROUP BY ALL HAVING count(*) % 2 = 1)
    SELECT grp % 2 AS tile, py::INT AS py, count(DISTINCT px) AS pixels, min(px)::INT AS first, max(px)::INT AS last FROM hit GROUP BY ALL""",
)
def large_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiles, each masked by several large rings; pixels in any of them count once."""
    tiles = large_rings(spark, sf_dir).groupBy((F.col("grp") % 2).alias("tile")).agg(F.collect_list("ring").alias("clips"))
    spans = RA.mask_spans(tiles, _PIXELS)
    return spans.groupBy("tile", "py").agg(F.sum(F.col("last") - F.col("first") + 1).alias("pixels"), F.min("first").alias("first"), F.max("last").alias("last"))


_SOURCE, _TARGET = 16, 12
_Y = lambda lat: f"(ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) / 2)"
_TILE = "p_partkey % 8 AS x, 1 + p_partkey % 2 AS y, 2 AS l, p_partkey AS k"
_VALUE = lambda c, r: f"((k * 31 + ({c}) * 7 + ({r}) * ({r}) * 3) % 256)"


@query(
    "R3_linear_filter",
    f"""WITH t AS (SELECT x, y, min(k) AS k, 90 - (y + 1) / 4 * 180 AS south, 90 - y / 4 * 180 AS north FROM (SELECT {_TILE} FROM part) GROUP BY x, y),
    p AS (SELECT t.*, px, py, 1 - (py + 0.5) / {_TARGET} AS v, greatest(0, least({_SOURCE - 1}, (px + 0.5) / {_TARGET} * {_SOURCE} - 0.5)) AS cx FROM t, range({_TARGET}) a(px), range({_TARGET}) b(py)),
    q AS (SELECT *, greatest(0, least({_SOURCE - 1}, (1 - ({_Y("south + v * (north - south)")} - {_Y("south")}) / ({_Y("north")} - {_Y("south")})) * {_SOURCE} - 0.5)) AS cy FROM p),
    w AS (SELECT *, floor(cx)::INT AS c, floor(cy)::INT AS r, cx - floor(cx) AS a, cy - floor(cy) AS b FROM q)
    SELECT x::INT AS x, y::INT AS y, px::INT AS px, py::INT AS py, round((1 - a) * (1 - b) * {_VALUE("c", "r")} + a * (1 - b) * {_VALUE(f"least(c + 1, {_SOURCE - 1})", "r")} + (1 - a) * b * {_VALUE("c", f"least(r + 1, {_SOURCE - 1})")} + a * b * {_VALUE(f"least(c + 1, {_SOURCE - 1})", f"least(r + 1, {_SOURCE - 1})")}, 6) AS value FROM w""",
)
def linear_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that parts fall on, from images whose pixels follow from the least key of a tile."""
    key = table(spark, sf_dir, "part").select((F.col("p_partkey") % 8).cast("int").alias("x"), (1 + F.col("p_partkey") % 2).cast("int").alias("y"), F.lit(2).alias("l"), F.col("p_partkey").alias("k"))
    tiles = key.groupBy("x", "y", "l").agg(F.min("k").alias("k")).withColumn("r", T.rectangle(F.col("x"), F.col("y"), F.col("l"), T.GEOGRAPHIC)).select("x", "y", "l", "k", "r.south", "r.north")
    source = RA.pixels(tiles.select("x", "y", "l", "k"), _SOURCE).select("x", "y", "l", "px", "py", ((F.col("k") * 31 + F.col("px") * 7 + F.col("py") * F.col("py") * 3) % 256).alias("value"))
    return rounded(RA.reproject_linear(tiles, source, _TARGET, _SOURCE, True).drop("l"), "value")
