"""Queries on flat polygons: the antimeridian, and the descent from their roots."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.functions import geometry as G
from chronoplate.functions import tiling as T
from chronoplate.operators import flat_polygons as P
from chronoplate.operators.tables import spread
from chronoplate.plans.registry import query, rounded, table

#: Corners of a ring about a centre, concave; and how many points a ring about a pole has.
_CORNERS = [(1.0, 0.1), (0.35, 0.5), (0.1, 1.0), (-0.4, 0.45), (-1.0, 0.2), (-0.5, -0.3), (-0.2, -1.0), (0.5, -0.6)]
_AROUND = 12

#: Rings of events: about a centre, or, one in eleven, about a pole; `u` is the longitude that goes on beyond 180, `x` the one that doesn't.
RINGS = f"""e AS (SELECT event_id AS id, event_id % 11 = 0 AS polar, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS way FROM events),
corner AS (SELECT unnest(range({len(_CORNERS) + 1})) AS i, unnest({[c[0] for c in [*_CORNERS, _CORNERS[0]]]})::DOUBLE AS cx, unnest({[c[1] for c in [*_CORNERS, _CORNERS[0]]]})::DOUBLE AS cy),
turn AS (SELECT i, i % {_AROUND} AS k FROM range({_AROUND + 1}) r(i)),
vertex AS (
  SELECT id, polar, i, id * 37 % 3600 / 10 - 180 + 0.0137 + cx * (3 + id % 17) AS u, id * 53 % 1300 / 10 - 65 + 0.0071 + cy * (2 + id % 13) AS y FROM e, corner WHERE NOT polar
  UNION ALL
  SELECT id, polar, i, way * (i * 30 + 0.37 + id % 29) AS u, (CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END) * (60 + (id * 7 + k * 5) % 20) AS y FROM e, turn WHERE polar
), ring AS (SELECT *, u - 360 * floor((u + 180) / 360) AS x, floor((u + 180) / 360) AS lap, lead(u) OVER w AS nu, lead(y) OVER w AS ny, lead(floor((u + 180) / 360)) OVER w AS nlap FROM vertex WINDOW w AS (PARTITION BY id ORDER BY i))"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("id")
    wrap = lambda u: u - 360 * F.floor((u + 180) / 360)
    lon, lat = e * 37 % 3600 / 10 - 180 + 0.0137, e * 53 % 1300 / 10 - 65 + 0.0071
    about = F.array(*(G.point(wrap(lon + cx * (3 + e % 17)), lat + cy * (2 + e % 13)) for cx, cy in [*_CORNERS, _CORNERS[0]]))
    way, pole = F.when(e % 2 == 0, 1).otherwise(-1), F.when(e % 3 == 0, -1).otherwise(1)
    polar = F.transform(F.sequence(F.lit(0), F.lit(_AROUND)), lambda i: G.point(wrap(way * (i * 30 + F.lit(0.37) + e % 29)), (pole * (60 + (e * 7 + i % _AROUND * 5) % 20)).cast("double")))
    return spread(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))).withColumn("ring", F.when(e % 11 == 0, polar).otherwise(about))


def _size(parts: Column) -> Column:
    return F.aggregate(F.transform(parts, lambda r: F.abs(G.signed_area(G.opened(r)))), F.lit(0.0), lambda a, b: a + b)


@query(
    "G19_antimeridian_cut",
    f"""WITH {RINGS} SELECT id, count(*) FILTER (lap <> nlap) AS crossings, round(max(u) FILTER (i = {_AROUND}) - min(u) FILTER (i = 0), 6) + 0.0 AS turned, bool_or(polar) AS bridged,
      CASE WHEN NOT bool_or(polar) AND count(*) FILTER (lap <> nlap) > 0 THEN 2 ELSE 1 END AS parts,
      count(*) + CASE WHEN bool_or(polar) THEN 4 WHEN count(*) FILTER (lap <> nlap) > 0 THEN 2 * count(*) FILTER (lap <> nlap) + 1 ELSE 0 END AS points,
      round(CASE WHEN bool_or(polar) THEN sum(30 * ({P.POLAR_LIMIT} - abs(y + ny) / 2)) ELSE abs(sum(u * ny - nu * y)) / 2 END, 5) AS area
    FROM ring GROUP BY id""",
)
def antimeridian_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings, turns, bridges, parts and their summed area, which in SQL follows from longitudes that go on beyond 180."""
    cut = P.cut_at_antimeridian(rings(spark, sf_dir))
    points = F.aggregate(F.transform("parts", F.size), F.lit(0), lambda a, b: a + b)
    turned = F.when(F.col("bridged"), F.col("winding"))
    rows = cut.select("id", F.size("crossings").cast("bigint").alias("crossings"), turned.alias("turned"), "bridged", F.size("parts").alias("parts"), points.cast("bigint").alias("points"), _size(F.col("parts")).alias("area"))
    return rounded(rounded(rows, "turned"), "area", digits=5)


@query(
    "G19_crossing_latitudes",
    f"WITH {RINGS} SELECT id, count(*) AS n, round(sum(y + ((CASE WHEN nlap > lap THEN nlap ELSE lap END) * 360 - 180 - u) / (nu - u) * (ny - y)), 6) AS latitudes, count(*) FILTER (nlap > lap) AS eastward FROM ring WHERE lap <> nlap GROUP BY id",
)
def crossing_latitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.cut_at_antimeridian(rings(spark, sf_dir)).select("id", F.explode("crossings").alias("c"))
    return rounded(found.groupBy("id").agg(F.count("*").alias("n"), F.sum("c.y").alias("latitudes"), F.count_if("c.east").alias("eastward")), "latitudes")


# --- Descent: boxes of parts, some of them over the antimeridian, so that SQL can follow them by their bounds ---------------------

_W, _E, _S, _N = "p_partkey * 37 % 3600 / 10 - 180 + 0.0137", "p_size * 1.1 + 0.7", "p_partkey * 53 % 1200 / 10 - 70 + 0.0071", "p_partkey % 19 * 0.9 + 0.4"
_SCHEMES = [T.GEOGRAPHIC, T.MERCATOR]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    west, wide, south, high = (F.expr(x) for x in (_W, _E, _S, _N))
    wrap = lambda u: F.when(u > 180, u - 360).otherwise(u)
    corners = [(west, south), (west + wide, south), (west + wide, south + high), (west, south + high), (west, south)]
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.array(*(G.point(wrap(x), y.cast("double")) for x, y in corners)).alias("ring"))


def _roots_sql() -> str:
    """Roots of both schemes as boxes of shares (u0, v0, u1, v1), v from the south."""
    low = T.MERCATOR_LAT
    return f"""b AS (SELECT p_partkey, {_W} AS w, {_W} + {_E} AS e, {_S} AS s, {_S} + {_N} AS n FROM part),
    p AS (SELECT p_partkey, w, least(e, 180) AS e, s, n, w < 0 OR e > 180 AS l, w > 0 OR e BETWEEN 0 AND 180 AS r FROM b UNION ALL SELECT p_partkey, -180, e - 360, s, n, true, w > 0 FROM b WHERE e > 180),
    g AS (SELECT p_partkey, 'geographic' AS scheme, x, (w + 180) / 180 - x AS u0, (e + 180) / 180 - x AS u1, (s + 90) / 180 AS v0, (n + 90) / 180 AS v1, l, r FROM p, range(2) t(x)
      UNION ALL SELECT p_partkey, 'web-mercator', 0, (w + 180) / 360, (e + 180) / 360, (s + {low}) / {2 * low}, (n + {low}) / {2 * low}, false, false FROM p),
    root AS (SELECT p_partkey, scheme, x, greatest(u0, 0) AS u0, least(u1, 1) AS u1, greatest(v0, 0) AS v0, least(v1, 1) AS v1, row_number() OVER (ORDER BY p_partkey, scheme, x, u0) AS id FROM g WHERE u1 > 0 AND u0 < 1 OR scheme = 'web-mercator')"""


_LAT = lambda share: f"degrees(atan(sinh(pi() * (1 - 2 * ({share})))))"


def _ratio_sql(y: str, level: str) -> str:
    """Where the rows of a tile's children meet, from the south."""
    n = f"2.0 ** ({level} + 1)"
    low, mid, top = (_LAT(f"(2 * {y} + {k}) / ({n})") for k in (2, 1, 0))
    return f"CASE WHEN scheme = 'geographic' THEN 0.5 ELSE ({mid} - {low}) / ({top} - {low}) END"


def _kept(spark: SparkSession, sf_dir: str, scheme: str) -> DataFrame:
    return P.roots(P.cut_at_antimeridian(boxes(spark, sf_dir)), scheme).filter("status <> 'NONE'").withColumn("scheme", F.lit(scheme))


_LEVEL = 4


@query(
    "G24_G25_flat_tiles",
    f"""WITH RECURSIVE {_roots_sql()}, t AS (
      SELECT p_partkey, scheme, 0 AS l, x, 0 AS y, u0, u1, v0, v1, CASE WHEN scheme = 'geographic' THEN -90.0 ELSE -{T.MERCATOR_LAT} END::DOUBLE AS south, CASE WHEN scheme = 'geographic' THEN 90.0 ELSE {T.MERCATOR_LAT} END::DOUBLE AS north FROM root
      UNION ALL
      SELECT p_partkey, scheme, l + 1, 2 * x + qx, 2 * y + qy, greatest(u0 * 2 - qx, 0), least(u1 * 2 - qx, 1), greatest((v0 - v) / h, 0), least((v1 - v) / h, 1), CASE WHEN qy = 1 THEN south ELSE (south + north) / 2 END, CASE WHEN qy = 0 THEN north ELSE (south + north) / 2 END
      FROM (SELECT *, CASE WHEN qy = 1 THEN 0 ELSE k END AS v, CASE WHEN qy = 1 THEN k ELSE 1 - k END AS h FROM (SELECT *, {_ratio_sql("y", "l")} AS k FROM t), range(2) a(qx), range(2) b(qy))
      WHERE l < {_LEVEL} AND u0 * 2 - qx < 1 AND u1 * 2 - qx > 0 AND (v0 - v) / h < 1 AND (v1 - v) / h > 0
    ) SELECT p_partkey, scheme, x::INT AS x, y::INT AS y, CASE WHEN u0 <= 1e-9 AND v0 <= 1e-9 AND u1 >= 1 - 1e-9 AND v1 >= 1 - 1e-9 THEN 'FULL' ELSE 'CLIP' END AS status, round(south, 6)::DOUBLE AS south, round(north, 6)::DOUBLE AS north, round((u1 - u0) * (v1 - v0), 6)::DOUBLE AS share FROM t WHERE l = {_LEVEL}""",
)
def flat_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a level in both schemes, with their halved rectangles and the share that is held."""
    parts = [P.tiles_at(_kept(spark, sf_dir, s), _LEVEL, s) for s in _SCHEMES]
    share = F.coalesce(F.abs(G.signed_area(G.opened(F.col("clip")))), F.lit(1.0))
    return rounded(parts[0].unionByName(parts[1]).select("p_partkey", "scheme", "x", "y", "status", "south", "north", share.alias("share")), "south", "north", "share")


def _extent_sql(split_to: int) -> str:
    """Stage 0 counts a node's children and goes to the only one; stages 1 to 3 look for a later kind of child among nodes split before."""
    seen = [f"(u0 < 0.5 AND {v})" if k < 2 else f"(u1 > 0.5 AND {v})" for k, v in enumerate(["v0 < k", "v1 > k", "v0 < k", "v1 > k"])]
    count = " + ".join(f"{s}::INT" for s in seen)
    to = "CASE " + " ".join(f"WHEN {s} THEN {k}" for k, s in enumerate(seen)) + " END"
    goes = "CASE WHEN stage = 0 THEN CASE WHEN n = 1 THEN kind END WHEN child < stage AND l < " + str(split_to) + " AND list_extract(has, stage + 1) THEN stage END"
    return f"""WITH RECURSIVE {_roots_sql()}, t AS (
      SELECT id, scheme, 0 AS l, x, 0 AS y, u0, u1, v0, v1, 0 AS stage, -1 AS child, false AS done FROM root
      UNION ALL
      SELECT id, scheme, CASE WHEN move IS NULL THEN l ELSE l + 1 END, CASE WHEN move IS NULL THEN x ELSE 2 * x + (move >= 2)::INT END, CASE WHEN move IS NULL THEN y ELSE 2 * y + (move % 2 = 0)::INT END,
        CASE WHEN move IS NULL THEN u0 ELSE greatest(u0 * 2 - (move >= 2)::INT, 0) END, CASE WHEN move IS NULL THEN u1 ELSE least(u1 * 2 - (move >= 2)::INT, 1) END,
        CASE WHEN move IS NULL THEN v0 WHEN move % 2 = 0 THEN v0 / k ELSE greatest((v0 - k) / (1 - k), 0) END, CASE WHEN move IS NULL THEN v1 WHEN move % 2 = 0 THEN least(v1 / k, 1) ELSE (v1 - k) / (1 - k) END,
        (stage + 1) % 4, coalesce(move, child), stage = 0 AND n > 1
      FROM (SELECT *, {goes} AS move FROM (SELECT *, {count} AS n, {to} AS kind, [{", ".join(seen)}] AS has FROM (SELECT *, {_ratio_sql("y", "l")} AS k FROM t WHERE NOT done)))
    ) SELECT p_partkey, t.scheme, l::INT AS to_l, t.x::INT AS to_x, y::INT AS to_y, true AS complete FROM t JOIN root USING (id) WHERE done"""


def _extents(spark: SparkSession, sf_dir: str, split_to: int) -> DataFrame:
    found = [P.extents(_kept(spark, sf_dir, s), s, split_to) for s in _SCHEMES]
    return found[0].unionByName(found[1]).select("p_partkey", "scheme", "to_l", "to_x", "to_y", "complete")


@query("G29_flat_extents", _extent_sql(0))
def flat_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first node under each root that branches."""
    return _extents(spark, sf_dir, 0)


@query("G29_G30_flat_extents_again", _extent_sql(5))
def flat_extents_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, rebuilt after the tiles down to level 5 were asked for: nodes that are split are passed by the later looks."""
    return _extents(spark, sf_dir, 5)
