"""Queries on areas: conversions, coverage, boundary classes, triangles and spheres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.functions import geometry as G
from chronoplate.functions import rotation as R
from chronoplate.operators import areas as A
from chronoplate.operators.rotations import baked, plate_matrices
from chronoplate.plans.domain_queries import DOMAINS, domains
from chronoplate.operators.tables import spread
from chronoplate.plans.registry import query, rounded, table
from chronoplate.plans.rotation_queries import WITH_MODEL, totals

_K = "p_partkey"


def flat_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat ring of each part: two points, a line, or a rectangle."""
    k, w, h = F.col(_K), F.col("p_size").cast("double"), (F.col(_K) % 7 + 1).cast("double")
    zero = F.lit(0.0)
    flat = F.when(k % 5 == 0, F.array(zero, zero, w, h)).when(k % 5 == 1, F.array(zero, zero, w, h, 2 * w, 2 * h)).otherwise(F.array(zero, zero, w, zero, w, h, zero, h))
    return table(spark, sf_dir, "part").select(_K, flat.alias("flat"))


@query("G4_G14_G36_area_conversion", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN 1 ELSE 0 END AS polygons, CASE WHEN p_partkey % 5 > 1 THEN 10 ELSE 0 END AS numbers, CASE WHEN p_partkey % 5 > 1 THEN p_size * (p_partkey % 7 + 1) ELSE 0 END::DOUBLE AS size FROM part")
def area_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_rings(spark, sf_dir).withColumn("area", A.from_rings(A.to_rings(A.from_flat_ring(F.col("flat")))))
    return rows.select(_K, F.size("area").alias("polygons"), F.coalesce(F.size(A.to_flat(F.get("area", F.lit(0))["exterior"])), F.lit(0)).alias("numbers"), A.size(F.col("area")).alias("size"))


_BOX = "SELECT event_id, (event_id % 4 - 2) * 0.25 AS a, (event_id % 3 - 1) * 0.3 AS c, 0.5 + event_id % 5 * 0.4 AS w, 0.7 + event_id % 4 * 0.3 AS h FROM events"


@query("G6_U4_covers_tile", f"WITH b AS ({_BOX}), s AS (SELECT event_id, greatest(0, least(1, a + w) - greatest(0, a)) * greatest(0, least(1, c + h) - greatest(0, c)) AS s FROM b) SELECT event_id, round(s, 6)::DOUBLE AS inside, s >= 1 - 1e-9 AS covers FROM s")
def covers_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    a, c, w, h = (e % 4 - 2) * 0.25, (e % 3 - 1) * 0.3, 0.5 + e % 5 * 0.4, 0.7 + e % 4 * 0.3
    ring = F.array(G.point(a, c), G.point(a + w, c), G.point(a + w, c + h), G.point(a, c + h), G.point(a, c))
    area = F.array(A.polygon(ring, F.array().cast("array<array<struct<x: double, y: double>>>")))
    rows = table(spark, sf_dir, "events").select("event_id", area.alias("area"))
    unit = A.cut(F.col("area"), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    return rounded(rows.select("event_id", A.size(unit).alias("inside"), A.covers_unit(F.col("area")).alias("covers")), "inside")


#: Rings of tile shares and their classes: round the tile, the same backwards and with points on edges, there and back, a corner, too few points, a cut from edge to edge, a point inside.
EDGE_RINGS = [
    ([0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0], "FULL"),
    ([0.0, 0.0, 0.0, 0.5, 0.0, 1.0, 1.0, 1.0, 1.0, 0.2, 1.0, 0.0], "FULL"),
    ([0.2, 0.0, 0.8, 0.0, 1.0, 0.0, 1.0, 0.4, 1.0, 0.0], "NONE"),
    ([0.5, 0.0, 1.0, 0.0, 0.7, 0.0], "NONE"),
    ([0.0, 0.0, 1.0, 0.0], "NONE"),
    ([0.0, 0.0, 1.0, 0.0, 1.0, 0.5, 0.0, 0.5], "CLIP"),
    ([0.0, 0.0, 1.0, 0.0, 0.5, 0.5], "CLIP"),
]


@query("G17_clip_mode", "SELECT event_id, " + "[" + ", ".join(f"'{c}'" for _, c in EDGE_RINGS) + f"][event_id % {len(EDGE_RINGS)} + 1] AS mode FROM events")
def clip_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = F.array(*(F.array(*map(F.lit, r)) for r, _ in EDGE_RINGS))
    flat = F.get(rings, (F.col("event_id") % len(EDGE_RINGS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", A.clip_mode(G.from_flat(flat)).alias("mode"))


@query(
    "G18_crossings",
    """WITH s AS (SELECT event_id, event_id % 10 AS x, event_id % 7 AS y, event_id % 10 + 1 + event_id % 3 AS u, event_id % 7 + 2 + event_id % 5 AS v FROM events)
    SELECT event_id, round(y + (v - y) / (u - x) * (x + 0.25 - x), 6)::DOUBLE AS at_x, round(x + (u - x) / (v - y) * (y + 0.5 - y), 6)::DOUBLE AS at_y FROM s""",
)
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    p = G.point((e % 10).cast("double"), (e % 7).cast("double"))
    q = G.point((e % 10 + 1 + e % 3).cast("double"), (e % 7 + 2 + e % 5).cast("double"))
    rows = table(spark, sf_dir, "events").select("event_id", A.crossing_x(p, q, p["x"] + 0.25)["y"].alias("at_x"), A.crossing_y(p, q, p["y"] + 0.5)["x"].alias("at_y"))
    return rounded(rows, "at_x", "at_y")


@query("R6_ring_preparation", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN 4 END AS points, CASE WHEN p_partkey % 5 > 1 THEN -(p_size * (p_partkey % 7 + 1)) END::DOUBLE AS exterior, CASE WHEN p_partkey % 5 > 1 THEN p_size * (p_partkey % 7 + 1) END::DOUBLE AS interior FROM part")
def ring_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = G.closed(G.from_flat(F.col("flat")))
    turned = F.when(F.col(_K) % 2 == 0, F.reverse(ring)).otherwise(ring)
    rows = flat_rings(spark, sf_dir).select(_K, F.concat(F.slice(turned, 1, 1), turned).alias("r"))
    return rows.select(_K, F.size(A.prepared(F.col("r"), True)).alias("points"), G.signed_area(A.prepared(F.col("r"), True)).alias("exterior"), G.signed_area(A.prepared(F.col("r"), False)).alias("interior"))


@query(
    "R7_R8_A20_triangles",
    """WITH p AS (SELECT p_partkey % 11 AS grp, p_partkey % 3 AS holes, p_partkey % 13 = 0 AS flat FROM part)
    SELECT grp, count(*) AS polygons, sum(holes)::BIGINT AS interiors, count(*) FILTER (flat) AS skipped, coalesce(sum(4 + 4 * holes + 2 * holes - 2) FILTER (NOT flat), 0)::BIGINT AS triangles, 0::DOUBLE AS deviation, 0::BIGINT AS high, 0::BIGINT AS unbridged FROM p GROUP BY grp""",
)
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda x0, y0, x1, y1: G.from_flat(F.array(*map(F.lit, (x0, y0, x1, y0, x1, y1, x0, y1, x0, y0))))
    k = F.col(_K)
    outer = F.when(k % 13 == 0, G.from_flat(F.array(*map(F.lit, (0.0, 0.0, 5.0, 5.0, 9.0, 9.0))))).otherwise(box(0.0, 0.0, 10.0, 10.0))
    holes = F.slice(F.array(box(2.0, 2.0, 3.0, 3.0), box(6.0, 5.0, 7.0, 8.0)), F.lit(1), (k % 3).cast("int"))
    rows = spread(table(spark, sf_dir, "part").select(_K)).select((k % 11).alias("grp"), F.array(A.polygon(outer, holes)).alias("area"))
    return rounded(A.mask_report(rows, ["grp"]), "deviation")


@query("G27_root_level", "SELECT event_id, greatest(event_id % 8, 3)::INT AS level FROM events")
def root_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", A.root_level((F.col("event_id") % 8).cast("int")).alias("level"))


@query("G34_outline_points", f"WITH {DOMAINS}, c AS (SELECT feature_id, unnest([west, east]) AS lon, south AS lat FROM dom) SELECT feature_id, lon, round({R.EARTH} * cos(radians(lat)) * cos(radians(lon)), 2) AS x, round({R.EARTH} * cos(radians(lat)) * sin(radians(lon)), 2) AS y, round({R.EARTH} * sin(radians(lat)), 2) AS z FROM c")
def outline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domains(spark, sf_dir).select("feature_id", F.explode(F.array("west", "east")).alias("lon"), "south")
    v = R.position(F.col("lon"), F.col("south"))
    return rounded(rows.select("feature_id", "lon", *(v[c].alias(c) for c in "xyz")), "x", "y", "z", digits=2)


@query(
    "M18_M21_moved_spheres",
    WITH_MODEL
    + f""", {DOMAINS}, s AS (SELECT feature_id, cos(radians(south)) * cos(radians(west)) AS x, cos(radians(south)) * sin(radians(west)) AS y, sin(radians(south)) AS z, round(west, 6) AS west FROM dom)
    SELECT feature_id, west, round(m0 * x + m1 * y + m2 * z, 6) + 0.0::DOUBLE AS x, round(m3 * x + m4 * y + m5 * z, 6) + 0.0::DOUBLE AS y, round(m6 * x + m7 * y + m8 * z, 6) + 0.0::DOUBLE AS z, 0.5::DOUBLE AS r FROM s, m WHERE plate_id = '201' AND age = 75""",
)
def moved_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = plate_matrices(totals(spark, sf_dir)).filter("plate_id = '201' and age = 75").select("plate_id", "m")
    v = R.unit_vector(F.col("west"), F.col("south"))
    sphere = F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"), F.lit(0.5).alias("r"))
    rect = F.struct(*(F.radians(c).alias(c) for c in ("west", "south", "east", "north")))
    rows = domains(spark, sf_dir).select("feature_id", F.lit("201").alias("plate_id"), sphere.alias("sphere"), R.in_degrees(rect)["west"].alias("west")).join(turned, "plate_id")
    return rounded(rows.select("feature_id", "west", R.moved_sphere(F.col("sphere"), F.col("m")).alias("s")).select("feature_id", "west", "s.*"), "west", "x", "y", "z")


_PLATES = ["101", "201", "301", "501", "777"]


@query(
    "T6_baked_instances",
    WITH_MODEL
    + f""", {DOMAINS}, d AS (SELECT *, {_PLATES}[plate_id::INT + 1] AS plate, cos(radians(south)) * cos(radians(west)) AS x, cos(radians(south)) * sin(radians(west)) AS y, sin(radians(south)) AS z FROM dom WHERE end_age <= 5 AND begin_age >= 5),
    t AS (SELECT plate_id AS plate, m.* EXCLUDE (plate_id) FROM m WHERE age = 75)
    SELECT feature_id, round(CASE WHEN known THEN degrees(atan2(m3 * x + m4 * y + m5 * z, m0 * x + m1 * y + m2 * z)) ELSE west END, 5) + 0.0::DOUBLE AS new_lon,
      round(CASE WHEN known THEN degrees(asin(greatest(-1, least(1, m6 * x + m7 * y + m8 * z)))) ELSE south END, 5) + 0.0::DOUBLE AS new_lat FROM d LEFT JOIN t USING (plate)""",
)
def baked_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """South-western corners of the domains that are visible at 5, turned by their plates' rotations of 75."""
    turned = totals(spark, sf_dir).filter("age = 75").withColumn("age", F.lit(5.0))
    plate = F.get(F.array(*map(F.lit, _PLATES)), F.col("plate_id").cast("int"))
    rows = domains(spark, sf_dir).select("feature_id", plate.alias("plate_id"), "begin_age", "end_age", F.col("west").alias("lon"), F.col("south").alias("lat"))
    return rounded(baked(rows, turned, 5.0).select("feature_id", "new_lon", "new_lat"), "new_lon", "new_lat", digits=5)
