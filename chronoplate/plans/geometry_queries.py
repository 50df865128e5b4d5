"""Queries on rings, masks, pixels and scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.functions import geometry as G
from chronoplate.functions import scalars as S
from chronoplate.functions import tiling as T
from chronoplate.operators import raster as RA
from chronoplate.plans.registry import dealt, dealt_sql, query, rounded, table

#: Five-pointed rings about a centre, concave where the inner radius is small; made alike in both engines.
_CORNERS = [(1.0, 0.1), (0.35, 0.5), (0.1, 1.0), (-0.4, 0.45), (-1.0, 0.2), (-0.5, -0.3), (-0.2, -1.0), (0.5, -0.6)]
RINGS = f"""corner AS (SELECT unnest(range({len(_CORNERS)})) AS i, unnest({[c[0] for c in _CORNERS]})::DOUBLE AS cx, unnest({[c[1] for c in _CORNERS]})::DOUBLE AS cy),
ring AS (SELECT n_nationkey AS id, i, 0.13 + n_nationkey % 5 * 0.21 + cx * (0.21371 + 0.0311 * (n_nationkey % 4)) AS x, 0.17 + n_nationkey // 5 * 0.19 + cy * (0.25713 + 0.0417 * (n_nationkey % 3)) AS y FROM nation, corner)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    corners = F.array(*(G.point(F.lit(a), F.lit(b)) for a, b in _CORNERS))
    x0, y0, rx, ry = 0.13 + k % 5 * 0.21, 0.17 + F.floor(k / 5) * 0.19, 0.21371 + 0.0311 * (k % 4), 0.25713 + 0.0417 * (k % 3)
    return table(spark, sf_dir, "nation").select(k.alias("id"), G.affine(corners, rx, x0, ry, y0).alias("ring"))


def _area_sql(source: str, order: str = "i") -> str:
    return f"SELECT id, sum(x * ny - nx * y) / 2 AS area FROM (SELECT id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM {source} WINDOW w AS (PARTITION BY id ORDER BY {order})) GROUP BY id"


@query("G2_signed_area", f"WITH {RINGS} SELECT id, round(area, 6) AS area FROM ({_area_sql('ring')})")
def signed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rings(spark, sf_dir).select("id", G.signed_area(F.col("ring")).alias("area")), "area")


def _half_sql(name: str, source: str, axis: str, limit: str, below: bool) -> str:
    o, op = ("y" if axis == "x" else "x"), ("<=" if below else ">=")
    cut = f"{o} + ({limit} - {axis}) / (n{axis} - {axis}) * (n{o} - {o})"
    return f"""{name}_n AS (SELECT id, i, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM {source} WINDOW w AS (PARTITION BY id ORDER BY i)),
    {name} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) AS i, x, y FROM (SELECT id, i, 0 AS j, x, y FROM {name}_n WHERE {axis} {op} {limit}
      UNION ALL SELECT id, i, 1, {limit if axis == "x" else cut}, {cut if axis == "x" else limit} FROM {name}_n WHERE ({axis} {op} {limit}) <> (n{axis} {op} {limit})))"""


_CLIP = ", ".join([RINGS, _half_sql("c1", "ring", "x", "0.0::DOUBLE", False), _half_sql("c2", "c1", "x", "1.0::DOUBLE", True), _half_sql("c3", "c2", "y", "0.0::DOUBLE", False), _half_sql("c4", "c3", "y", "1.0::DOUBLE", True)])


@query("G5_G16_clip_area", f"WITH {_CLIP} SELECT a.id, round(abs(coalesce(area, 0)), 6) AS area, coalesce(n, 0) AS points FROM (SELECT DISTINCT id FROM ring) a LEFT JOIN ({_area_sql('c4')}) USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM c4 GROUP BY id) USING (id)")
def clip_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = rings(spark, sf_dir).withColumn("c", G.clip(F.col("ring"), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    return rounded(cut.select("id", F.abs(G.signed_area(F.col("c"))).alias("area"), F.size("c").cast("bigint").alias("points")), "area")


@query("G8_G15_G23_quarters", f"WITH {_CLIP} SELECT id, round(abs(area), 6) AS area FROM ({_area_sql('c4')})")
def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four children's areas, each in its child's shares, add up to their parent's."""
    cut = rings(spark, sf_dir).withColumn("c", G.clip(F.col("ring"), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    parts = cut.select("id", F.explode(G.quarters(F.col("c"), F.lit(0.4))).alias("q"))
    scaled = F.abs(G.signed_area(F.col("q.ring"))) * 0.5 * F.when(F.col("q.qy") == 0, 0.6).otherwise(0.4)
    return rounded(parts.groupBy("id").agg(F.sum(scaled).alias("area")), "area")


@query("G1_G3_G12_rings", dealt_sql(5, "SELECT * FROM (VALUES (1, true, 5, 4), (2, false, 3, 2), (3, true, 5, 4), (4, false, 4, 3), (5, false, 0, 0)) t(id, valid, closed, distinct_points)"))
def ring_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0]), (2, [0.0, 0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0]), (4, [0.0, 0.0, 1.0, 1.0, 2.0, 2.0]), (5, [])]
    size, move = (1 + F.col("p_partkey") % 7).cast("double"), (F.col("p_partkey") % 11).cast("double")
    given = dealt(spark, sf_dir, rows, "id INT, flat ARRAY<DOUBLE>").withColumn("r", G.without_repeats(G.affine(G.from_flat(F.col("flat")), size, move, size, move)))
    return given.select("p_partkey", "id", F.coalesce(G.valid(F.col("r")), F.lit(False)).alias("valid"), F.size(G.closed(F.col("r"))).alias("closed"), F.size(G.opened(F.col("r"))).alias("distinct_points"))


@query("G9_G7_tile_shares", f"WITH {RINGS} SELECT id, i::INT AS i, round((x * 40 - 10 + 45) / 90, 6) AS u, round((greatest(-90, least(90, y * 140 - 20)) - 0) / 90, 6) + 0.0::DOUBLE AS v FROM ring")
def tile_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = G.affine(F.col("ring"), F.lit(40.0), F.lit(-10.0), F.lit(140.0), F.lit(-20.0))
    rect = F.struct(F.lit(-45.0).alias("west"), F.lit(0.0).alias("south"), F.lit(45.0).alias("east"), F.lit(90.0).alias("north"))
    rows = rings(spark, sf_dir).select("id", F.posexplode(G.to_tile(degrees, rect)).alias("i", "p")).select("id", "i", F.col("p.x").alias("u"), F.col("p.y").alias("v"))
    return rounded(rows, "u", "v")


SIZE = 16
_PIX = f"""px AS (SELECT a AS px, b AS py, (a + 0.5) / {SIZE} AS u, 1 - (b + 0.5) / {SIZE} AS v FROM range({SIZE}) r(a), range({SIZE}) s(b)),
edge AS (SELECT id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM ring WINDOW w AS (PARTITION BY id ORDER BY i)),
hit AS (SELECT id, px, py, count(*) FILTER ((y > v) <> (ny > v) AND u < (nx - x) * (v - y) / (ny - y) + x) % 2 = 1 AS h FROM edge, px GROUP BY id, px, py)"""


@query("R4_R5_mask", f"WITH {RINGS}, {_PIX} SELECT id, count(*) AS inside FROM hit WHERE h GROUP BY id")
def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RA.masked(rings(spark, sf_dir).select("id", F.array("ring").alias("clips")), SIZE).groupBy("id").agg(F.count("*").alias("inside"))


@query("U5_R11_mask_union", f"WITH {RINGS}, {_PIX} SELECT grp, count(*) AS inside FROM (SELECT id % 3 AS grp, px, py FROM hit GROUP BY ALL HAVING bool_or(h)) GROUP BY grp UNION ALL SELECT 99, {SIZE * SIZE}")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = rings(spark, sf_dir).groupBy((F.col("id") % 3).alias("grp")).agg(F.collect_list("ring").alias("clips"))
    whole = tiles.limit(1).select(F.lit(99).cast("bigint").alias("grp"), F.filter("clips", lambda r: F.lit(False)).alias("clips"))
    return RA.masked(tiles.unionByName(whole), SIZE).groupBy("grp").agg(F.count("*").alias("inside"))


@query("A20_mask_statistics", f"WITH {RINGS} SELECT id % 3 AS grp, count(DISTINCT id) AS polygons, count(*) AS points, count(*) - 2 * count(DISTINCT id) AS triangles, 0::BIGINT AS skipped FROM ring GROUP BY 1")
def mask_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RA.mask_statistics(rings(spark, sf_dir).select((F.col("id") % 3).alias("grp"), F.array("ring").alias("clips")), ["grp"])


_Y = lambda lat: f"(ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) / 2)"


@query(
    "R1_R2_R3_reproject",
    f"""WITH t AS (SELECT x, y, 90 - (y + 1) / 4 * 180 AS south, 90 - y / 4 * 180 AS north FROM (SELECT DISTINCT p_partkey % 8 AS x, 1 + p_partkey // 8 % 2 AS y FROM part)), p AS (SELECT t.*, px, py, 1 - (py + 0.5) / {SIZE} AS v FROM t, range({SIZE}) r(px), range({SIZE}) s(py)),
    q AS (SELECT *, greatest(0, least({SIZE - 1}, floor((1 - ({_Y("south + v * (north - south)")} - {_Y("south")}) / ({_Y("north")} - {_Y("south")})) * {SIZE})))::INT AS sr FROM p)
    SELECT x::INT AS x, y::INT AS y, px::INT AS px, py::INT AS py, sr AS source_row, ((x * 31 + y * 17 + px * 7 + sr * 3) % 256)::INT AS r FROM q""",
)
def reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles that parts fall on."""
    k = F.col("p_partkey")
    grid = table(spark, sf_dir, "part").select((k % 8).cast("int").alias("x"), (1 + F.floor(k / 8) % 2).cast("int").alias("y"), F.lit(2).alias("l")).distinct().withColumn("rect", T.rectangle(F.col("x"), F.col("y"), F.col("l"), T.GEOGRAPHIC)).select("x", "y", "l", "rect.south", "rect.north")
    source = RA.pixels(grid.select("x", "y", "l"), SIZE).select("x", "y", "l", "px", "py", ((F.col("x") * 31 + F.col("y") * 17 + F.col("px") * 7 + F.col("py") * 3) % 256).alias("r"))
    return RA.reproject(RA.pixels(grid, SIZE), source, SIZE, True).select("x", "y", "px", "py", "source_row", "r")


@query("R9_R10_R12_result_keys", f"WITH {RINGS} SELECT count(DISTINCT id) AS keys, count(DISTINCT id) AS results FROM ring")
def result_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring listed first or second gives one key; results are made once a key."""
    r = rings(spark, sf_dir)
    turned = lambda order: r.select(F.concat_ws(":", F.lit("local"), F.lit("4/3/2"), G.clip_key(F.array(*(F.col("ring") if o else G.affine(F.col("ring"), F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(0.0)) for o in order))).cast("string"), F.lit("png")).alias("key"))
    both = turned((1, 0)).unionByName(turned((0, 1)))
    return both.agg(F.count_distinct("key").alias("keys")).crossJoin(both.dropDuplicates(["key"]).agg(F.count("*").alias("results")))  # one row each


@query("M20_round_half_up", "SELECT event_id, floor((value - 50) * 1000 + 0.5) / 1000 AS r FROM events")
def round_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.round_half_up(F.col("value") - 50, 3).alias("r"))


@query("M22_M23_scalars", "SELECT event_id, event_id > 0 AND event_id & (event_id - 1) = 0 AS power, round(CASE WHEN (event_id % 720 - 360) >= 180 THEN event_id % 720 - 720 WHEN (event_id % 720 - 360) < -180 THEN event_id % 720 ELSE event_id % 720 - 360 END, 6)::DOUBLE AS lon FROM events WHERE event_id % 180 <> 0")
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoplate.functions.rotation import wrap_longitude

    lon = F.degrees(wrap_longitude(F.radians((F.col("event_id") % 720 - 360).cast("double"))))
    return rounded(table(spark, sf_dir, "events").filter("event_id % 180 <> 0").select("event_id", S.is_power_of_two(F.col("event_id")).alias("power"), lon.alias("lon")), "lon")


@query("P14_P15_P16_text_rules", dealt_sql(6, "SELECT id, number::DOUBLE AS number, age::DOUBLE AS age, name FROM (VALUES (1, 12.5, 12.5, 'Basin'), (2, NULL, 999999, 'x'), (3, NULL, -999, 'b'), (4, -0.3, -0.3, ''), (5, NULL, NULL, 'plain'), (6, 1500, 1500, 'c')) t(id, number, age, name)"))
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, " about 12.5 Ma", "gpml:Basin"), (2, "http://x/distantPast", "x"), (3, "gml:distantFuture", "a:b"), (4, "-.3", "a:"), (5, "none", "plain"), (6, "1.5e3 and 7", "a:b:c")]
    given = dealt(spark, sf_dir, rows, "id INT, t STRING, n STRING")
    return given.select("p_partkey", "id", S.first_number(F.col("t")).alias("number"), S.geo_time(F.col("t")).alias("age"), S.local_name(F.col("n")).alias("name"))


@query("P6_P7_P8_positions", dealt_sql(4, "SELECT * FROM (VALUES (1, true, 3, 20.0::DOUBLE, 10.0::DOUBLE), (2, false, 2, 170.0::DOUBLE, 10.0::DOUBLE), (3, true, 2, 2.0::DOUBLE, 1.0::DOUBLE), (4, true, 2, 120.0::DOUBLE, 5.0::DOUBLE)) t(id, lat_lon, points, x, y)"))
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "10 20 30 x 40 50 60", 2), (2, "170 10 -171 20", 2), (3, "1 2 9 3 4 9", 3), (4, " 5 120\n6 130 ", 2)]
    given = dealt(spark, sf_dir, rows, "id INT, t STRING, d INT").withColumn("v", S.numbers(F.col("t"))).withColumn("lat_lon", S.is_lat_lon(F.col("v"), F.col("d")))
    out = given.withColumn("p", S.positions(F.col("v"), F.col("d"), F.col("lat_lon")))
    return out.select("p_partkey", "id", "lat_lon", F.size("p").alias("points"), F.get("p", F.lit(0))["x"].alias("x"), F.get("p", F.lit(0))["y"].alias("y"))


@query("P12_P13_attributes", dealt_sql(4, "SELECT * FROM (VALUES (1, '7'), (2, '8'), (3, '9'), (4, NULL)) t(id, plate)"))
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, {"PlateId1": "5", "plateid": "7"}), (2, {"PLATEID1": "8"}), (3, {"recon_plate_id": "9", "x": "1"}), (4, {})]
    return dealt(spark, sf_dir, rows, "id INT, a MAP<STRING, STRING>").select("p_partkey", "id", S.attribute(F.col("a"), "PLATEID", "PLATEID1", "RECON_PLATE_ID").alias("plate"))


@query("K3_export_name", "SELECT event_id, regexp_replace('Run ' || event_type || '/é#' || event_id, '[^a-zA-Z0-9._-]+', '_', 'g') || '_' || replace(regexp_replace((event_id % 40 / 4)::DOUBLE::VARCHAR, '\\.0$', ''), '.', 'p') || 'Ma_' || strftime(ts, '%Y%m%dT%H%M%SZ') AS name FROM events")
def export_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("Run "), F.col("event_type"), F.lit("/é#"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.export_name(title, (F.col("event_id") % 40 / 4).cast("double"), F.col("ts")).alias("name"))


@query("S18_S20_names", dealt_sql(3, "SELECT * FROM (VALUES (1, 'area', 4321, '3D', '0x0_0x1'), (2, NULL, 7, NULL, 'unknown'), (3, 'area', NULL, NULL, NULL)) t(id, intent, pid, engine, adapter)"))
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "/f/Static%20Polygons.gpmlz", "pid_4321_luid_0x0_0x1_phys_0_engtype_3D"), (2, "/f/coast.gpml", "pid_7_x"), (3, "a/static_plate_1.json", "luid_1_2")]
    return dealt(spark, sf_dir, rows, "id INT, u STRING, g STRING").select("p_partkey", "id", S.infer_intent(F.col("u")).alias("intent"), S.gpu_instance(F.col("g")).alias("i")).select("p_partkey", "id", "intent", "i.pid", "i.engine", "i.adapter")


@query(
    "G35_point_predicates",
    """WITH p AS (SELECT p_partkey AS k, (p_partkey % 3)::DOUBLE AS x, (p_partkey % 4)::DOUBLE AS y, p_partkey % 2 + CASE WHEN p_partkey % 5 = 0 THEN 1e-10 ELSE 0 END AS u, (p_partkey % 4)::DOUBLE AS v FROM part)
    SELECT k AS p_partkey, k % 7 > 2 AS finite, abs(x - u) <= 1e-9 AND abs(y - v) <= 1e-9 AS same, 3 AS points, 6 AS numbers FROM p""",
)
def point_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rings of three points to points and back; whether the last is finite, and the first two are the same."""
    k = F.col("p_partkey")
    odd = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 7 == 1, F.lit(float("inf"))).when(k % 7 == 2, F.lit(None).cast("double")).otherwise(k.cast("double"))
    flat = F.array((k % 3).cast("double"), (k % 4).cast("double"), k % 2 + F.when(k % 5 == 0, 1e-10).otherwise(0.0), (k % 4).cast("double"), F.lit(1.0), odd)
    rows = table(spark, sf_dir, "part").select("p_partkey", G.from_flat(flat).alias("r"))
    at = lambda i: F.get("r", F.lit(i))
    return rows.select("p_partkey", G.is_finite(at(2)).alias("finite"), G.same(at(0), at(1)).alias("same"), F.size("r").alias("points"), F.size(F.flatten(F.transform("r", lambda p: F.array(p["x"], p["y"])))).alias("numbers"))
