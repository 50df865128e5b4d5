"""Queries on plate domains, tiles, composite tasks and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.functions import rotation as R
from chronoplate.functions import tiling as T
from chronoplate.operators import domains as D
from chronoplate.operators import tiles as O
from chronoplate.operators import views as V
from chronoplate.operators.rotations import plate_matrices
from chronoplate.plans.registry import dealt, dealt_sql, query, rounded, table
from chronoplate.plans.rotation_queries import WITH_MODEL, totals
from chronoplate.sources import providers

# --- Features from `part`, rectangles from `nation` -------------------------------------------------------------------

FEATURES = """feat AS (SELECT p_partkey, (p_partkey % 50)::VARCHAR AS feature_id, p_partkey AS member_index,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_size % 7)::VARCHAR END AS plate_id, (p_size % 4)::BIGINT AS polygon_count,
  ['gpml:Coastline', 'gpml:MidOceanRidge', 'gpml:Basin', 'gpml:TerraneBoundary', 'gpml:InferredPaleoBoundary', 'gpml:Volcano'][p_partkey % 6 + 1] AS feature_type,
  CASE WHEN p_partkey % 17 = 0 THEN 'gpml:Fault' WHEN p_partkey % 19 = 0 THEN '' END AS attribute_type,
  CASE WHEN p_partkey % 23 = 0 THEN 'centerLineOf' ELSE 'outlineOf' END AS property_name,
  CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 600)::DOUBLE END AS begin_age, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 40)::DOUBLE END AS end_age FROM part)"""

INTENT_SQL = f"""CASE WHEN property_name = 'centerLineOf' THEN 'line-like' WHEN k IN ({", ".join(f"'{x}'" for x in D.AREA_TYPES)}) THEN 'area'
  WHEN k IN ({", ".join(f"'{x}'" for x in D.LINE_TYPES)}) OR k LIKE '%Boundary%' OR k LIKE '%Coastline%' THEN 'line-like' WHEN polygon_count > 0 THEN 'area' ELSE 'unknown' END"""
WITH_FEATURES = f"WITH {FEATURES}, typed AS (SELECT *, {INTENT_SQL} AS intent FROM (SELECT *, split_part(coalesce(nullif(attribute_type, ''), feature_type), ':', -1) AS k FROM feat))"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    types = ["gpml:Coastline", "gpml:MidOceanRidge", "gpml:Basin", "gpml:TerraneBoundary", "gpml:InferredPaleoBoundary", "gpml:Volcano"]
    rows = table(spark, sf_dir, "part").select(
        (k % 50).cast("string").alias("feature_id"),
        k.alias("member_index"),
        F.when(k % 13 != 0, (F.col("p_size") % 7).cast("string")).alias("plate_id"),
        (F.col("p_size") % 4).cast("bigint").alias("polygon_count"),
        F.get(F.array(*map(F.lit, types)), (k % 6).cast("int")).alias("feature_type"),
        F.when(k % 17 == 0, "gpml:Fault").when(k % 19 == 0, "").alias("attribute_type"),
        F.when(k % 23 == 0, "centerLineOf").otherwise("outlineOf").alias("property_name"),
        F.when(k % 5 != 0, (k % 600).cast("double")).alias("begin_age"),
        F.when(k % 7 != 0, (k % 40).cast("double")).alias("end_age"),
    )
    return rows.withColumn("intent", D.intent(F.col("property_name"), F.col("feature_type"), F.col("attribute_type"), F.col("polygon_count")))


@query("P5_render_intent", WITH_FEATURES + " SELECT member_index, intent FROM typed")
def render_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("member_index", "intent")


@query("P2_area_filter", WITH_FEATURES + " SELECT intent, count(*) AS n FROM typed WHERE intent = 'area' GROUP BY 1")
def area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).filter("intent = 'area'").groupBy("intent").agg(F.count("*").alias("n"))


@query("P3_import_filter", WITH_FEATURES + " SELECT member_index, plate_id, coalesce(begin_age, 999999)::DOUBLE AS begin_age, coalesce(end_age, -999)::DOUBLE AS end_age FROM typed WHERE plate_id IS NOT NULL AND polygon_count > 0")
def import_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.importable(features(spark, sf_dir)).select("member_index", "plate_id", "begin_age", "end_age")


@query("P4_unique_id", WITH_FEATURES + " SELECT member_index, CASE WHEN count(*) OVER (PARTITION BY feature_id) > 1 THEN feature_id || ':member:' || member_index ELSE feature_id END AS unique_id FROM typed")
def unique_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_unique_ids(features(spark, sf_dir)).select("member_index", "unique_id")


@query("A6_duplicate_ids", WITH_FEATURES + " SELECT count(*) FILTER (n > 1) AS duplicate_ids, sum(n - 1)::BIGINT AS extra_rows FROM (SELECT count(*) AS n FROM typed GROUP BY feature_id)")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.duplicate_ids(features(spark, sf_dir))


_OK = "(plate_id IS NOT NULL AND polygon_count > 0)"


@query(
    "A4_import_diagnostics",
    WITH_FEATURES
    + f""" SELECT count(*) AS parsed, count(*) FILTER (plate_id IS NULL) AS without_plate, count(*) FILTER (polygon_count = 0) AS without_polygons, count(*) FILTER {_OK.replace("(", "(", 1)} AS imported,
    count(*) FILTER ({_OK} AND intent = 'area') AS areas, count(*) FILTER ({_OK} AND intent = 'line-like') AS lines, count(*) FILTER (begin_age IS NULL) AS without_begin,
    coalesce(sum(polygon_count) FILTER {_OK}, 0)::BIGINT AS polygons, count(DISTINCT feature_id) FILTER {_OK} AS distinct_ids, count(DISTINCT plate_id) FILTER {_OK} AS plates,
    (SELECT list(struct_pack(feature_type := feature_type, n := n) ORDER BY feature_type)::VARCHAR FROM (SELECT feature_type, count(*) AS n FROM typed WHERE NOT {_OK} GROUP BY 1)) IS NOT NULL AS has_skipped FROM typed""",
)
def import_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.import_diagnostics(features(spark, sf_dir)).withColumn("has_skipped", F.size("skipped") > 0).drop("skipped")


@query("A4_skipped_types", WITH_FEATURES + f" SELECT feature_type, count(*) AS n FROM typed WHERE NOT {_OK} GROUP BY 1")
def skipped_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.import_diagnostics(features(spark, sf_dir)).select(F.inline("skipped"))


@query("W4_first_by_id", WITH_FEATURES + " SELECT plate_id, feature_id, min(member_index) AS member_index FROM typed GROUP BY ALL")
def first_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_by_id(features(spark, sf_dir)).select("plate_id", "feature_id", "member_index")


@query(
    "O1_plate_draw_order",
    "SELECT v AS plate_id, row_number() OVER (ORDER BY try_cast(v AS DOUBLE) IS NULL, try_cast(v AS DOUBLE), v) AS draw_order FROM (SELECT [s_suppkey::VARCHAR, 'b' || s_suppkey, '-' || s_suppkey, s_suppkey || '.5', '00' || s_suppkey][s_suppkey % 5 + 1] AS v FROM supplier)",
)
def plate_draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    ids = F.array(k, F.concat(F.lit("b"), k), F.concat(F.lit("-"), k), F.concat(k, F.lit(".5")), F.concat(F.lit("00"), k))
    ids = table(spark, sf_dir, "supplier").select(F.get(ids, (F.col("s_suppkey") % 5).cast("int")).alias("plate_id"))
    return D.draw_order(ids).withColumn("draw_order", F.col("draw_order").cast("bigint"))


DOMAINS = """dom AS (SELECT n_nationkey::VARCHAR AS feature_id, n_regionkey::VARCHAR AS plate_id, (-179.3 + (n_nationkey % 5) * 72)::DOUBLE AS west, (-79.4 + floor(n_nationkey / 5) * 32)::DOUBLE AS south,
  (-179.3 + (n_nationkey % 5) * 72 + 40 + n_nationkey)::DOUBLE AS east, (-79.4 + floor(n_nationkey / 5) * 32 + 24 + n_nationkey % 6)::DOUBLE AS north,
  (600 - 20 * (n_nationkey % 4))::DOUBLE AS begin_age, CASE n_nationkey % 3 WHEN 0 THEN -999 ELSE 10 * (n_nationkey % 2) END::DOUBLE AS end_age FROM nation)"""


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    west, south = -179.3 + (k % 5) * 72, -79.4 + F.floor(k / 5) * 32
    return table(spark, sf_dir, "nation").select(
        k.cast("string").alias("feature_id"),
        F.col("n_regionkey").cast("string").alias("plate_id"),
        west.alias("west"),
        south.alias("south"),
        (west + 40 + k).alias("east"),
        (south + 24 + k % 6).alias("north"),
        (600 - 20 * (k % 4)).cast("double").alias("begin_age"),
        F.when(k % 3 == 0, -999).otherwise(10 * (k % 2)).cast("double").alias("end_age"),
    )


AGES = [5.0, 50.0, 550.0, 590.0]


@query("P1_age_visibility", f"WITH {DOMAINS} SELECT feature_id, age, age BETWEEN end_age AND begin_age AS visible FROM dom, (SELECT unnest({AGES})::DOUBLE AS age)")
def age_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains(spark, sf_dir).withColumn("age", F.explode(F.array(*map(F.lit, AGES)))).select("feature_id", "age", D.visible(F.col("age")).alias("visible"))


LEVEL = 3


def _rect_sql(scheme: str, x: str = "x", y: str = "y", l: str = "l") -> str:
    nx, ny = (f"({2 if scheme == T.GEOGRAPHIC else 1} * pow(2, {l}))", f"pow(2, {l})")
    lat = (lambda s: f"(90 - {s} * 180)") if scheme == T.GEOGRAPHIC else (lambda s: f"degrees(atan(sinh(pi() * (1 - 2 * {s}))))")
    return f"({x} / {nx} * 360 - 180)::DOUBLE AS tw, {lat(f'(({y} + 1) / {ny})')}::DOUBLE AS ts, (({x} + 1) / {nx} * 360 - 180)::DOUBLE AS te, {lat(f'({y} / {ny})')}::DOUBLE AS tn"


def _tiles_sql(scheme: str) -> str:
    nx, ny = (2 if scheme == T.GEOGRAPHIC else 1) << LEVEL, 1 << LEVEL
    _, low, _, high = T.limits(scheme)
    return f"""WITH {DOMAINS}, grid AS (SELECT x.x AS x, y.y AS y, {LEVEL} AS l FROM range({nx}) x(x), range({ny}) y(y)), rect AS (SELECT *, {_rect_sql(scheme)} FROM grid),
    cut AS (SELECT feature_id, plate_id, begin_age, end_age, x, y, l, (greatest(west, tw) - tw) / (te - tw) AS u0, (greatest(south, {low}, ts) - ts) / (tn - ts) AS v0, (least(east, te) - tw) / (te - tw) AS u1, (least(north, {high}, tn) - ts) / (tn - ts) AS v1
      FROM dom, rect WHERE least(east, te) - greatest(west, tw) > 1e-9 AND least(north, {high}, tn) - greatest(south, {low}, ts) > 1e-9),
    tiles AS (SELECT *, u0 <= 1e-9 AND v0 <= 1e-9 AND u1 >= 1 - 1e-9 AND v1 >= 1 - 1e-9 AS whole FROM cut),
    tasks AS (SELECT plate_id, begin_age, end_age, x, y, l, bool_or(whole) AS covers_full, count(*) FILTER (NOT whole) AS clips, count(DISTINCT feature_id) AS features, count(*) AS sources FROM tiles GROUP BY ALL)"""


def _tiles(spark: SparkSession, sf_dir: str, scheme: str = T.GEOGRAPHIC) -> DataFrame:
    return O.tiles_of_rectangles(domains(spark, sf_dir), LEVEL, scheme)


def _entries(tiles: DataFrame) -> DataFrame:
    share = lambda c, whole: F.coalesce(F.col(f"clip.{c}"), F.lit(whole))
    rows = tiles.select("feature_id", "x", "y", "status", share("u0", 0.0).alias("u0"), share("v0", 0.0).alias("v0"), share("u1", 1.0).alias("u1"), share("v1", 1.0).alias("v1"))
    return rounded(rows, "u0", "v0", "u1", "v1")


_ENTRIES_SQL = " SELECT feature_id, x::INT AS x, y::INT AS y, CASE WHEN whole THEN 'FULL' ELSE 'CLIP' END AS status, " + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in ("u0", "v0", "u1", "v1")) + " FROM tiles"


@query("J5_G21_tile_entries", _tiles_sql(T.GEOGRAPHIC) + _ENTRIES_SQL)
def tile_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(_tiles(spark, sf_dir))


@query("J5_G20_tile_entries_mercator", _tiles_sql(T.MERCATOR) + _ENTRIES_SQL)
def tile_entries_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(_tiles(spark, sf_dir, T.MERCATOR))


@query("A1_composite_tasks", _tiles_sql(T.GEOGRAPHIC) + " SELECT plate_id, begin_age, end_age, x::INT AS x, y::INT AS y, covers_full, clips, features, sources FROM tasks")
def composite_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.composites(_tiles(spark, sf_dir)).select("plate_id", "begin_age", "end_age", "x", "y", "covers_full", F.size("clips").cast("bigint").alias("clips"), F.size("feature_ids").cast("bigint").alias("features"), "sources")


@query("A2_raw_tiles", _tiles_sql(T.GEOGRAPHIC) + " SELECT count(DISTINCT (x, y, l)) AS raw_tiles FROM tiles")
def raw_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.raw_tile_count(_tiles(spark, sf_dir))


@query(
    "A3_task_statistics",
    _tiles_sql(T.GEOGRAPHIC)
    + """ SELECT count(*) AS tasks, sum(sources)::BIGINT AS sources, count(*) FILTER (covers_full) AS full_tasks, count(*) FILTER (features > 1) AS merged_tasks, max(features)::INT AS max_features,
    round(avg(features), 6) AS mean_features, sum(clips)::BIGINT AS clip_parts, max(clips)::INT AS max_clips, round(avg(clips), 6) AS mean_clips, count(DISTINCT (x, y, l)) AS raw_tiles FROM tasks""",
)
def task_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.task_statistics(O.composites(_tiles(spark, sf_dir))), "mean_features", "mean_clips")


@query("A7_visibility_counts", _tiles_sql(T.GEOGRAPHIC) + f" SELECT age, count(*) FILTER (age BETWEEN end_age AND begin_age) AS visible, count(*) FILTER (NOT age BETWEEN end_age AND begin_age) AS hidden FROM tasks, (SELECT unnest({AGES})::DOUBLE AS age) GROUP BY age")
def visibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.visibility_counts(O.composites(_tiles(spark, sf_dir)), AGES)


@query("O6_phases", _tiles_sql(T.GEOGRAPHIC) + " SELECT CASE WHEN 550.0 BETWEEN end_age AND begin_age THEN 0 ELSE 1 END AS phase, count(*) AS n FROM tasks GROUP BY 1")
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.phases(O.composites(_tiles(spark, sf_dir)), 550.0).groupBy("phase").agg(F.count("*").alias("n"))


@query("P20_U3_not_loaded", _tiles_sql(T.GEOGRAPHIC) + " SELECT plate_id, x::INT AS x, y::INT AS y, sources FROM tasks WHERE x % 3 <> 0")
def not_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = O.composites(_tiles(spark, sf_dir))
    return O.not_loaded(tasks, tasks.filter("x % 3 = 0")).select("plate_id", "x", "y", "sources")


@query("U1_U2_plate_union", _tiles_sql(T.GEOGRAPHIC) + " SELECT plate_id, count(*) AS entries FROM (SELECT * FROM tiles UNION ALL SELECT * FROM tiles WHERE y < 4) GROUP BY plate_id")
def plate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _tiles(spark, sf_dir)
    return tiles.unionByName(tiles.filter("y < 4")).groupBy("plate_id").agg(F.count("*").alias("entries"))


@query("J9_task_images", _tiles_sql(T.GEOGRAPHIC) + " SELECT plate_id, x::INT AS x, y::INT AS y, CASE WHEN (x + y) % 2 = 0 THEN x * 100 + y END::BIGINT AS image FROM tasks")
def task_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = O.grid(spark, LEVEL).filter("(x + y) % 2 = 0").withColumn("image", (F.col("x") * 100 + F.col("y")).cast("bigint"))
    return O.with_images(O.composites(_tiles(spark, sf_dir)), images).select("plate_id", "x", "y", "image")


@query("J8_task_matrices", _tiles_sql(T.GEOGRAPHIC).replace("WITH ", WITH_MODEL + ", ", 1) + " SELECT t.plate_id, count(*) AS tasks, round(max(coalesce(m.m0, 1)), 6) AS m0 FROM tasks t LEFT JOIN (SELECT (plate_id::INT // 100 - 1)::VARCHAR AS plate_id, m0 FROM m WHERE age = 120 AND plate_id IN ('101', '202', '301')) m USING (plate_id) GROUP BY 1")
def task_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = totals(spark, sf_dir).filter("age = 120 and plate_id in ('101', '202', '301')").withColumn("plate_id", (F.floor(F.col("plate_id").cast("int") / 100) - 1).cast("string"))
    tasks = O.with_matrices(O.composites(_tiles(spark, sf_dir)), plate_matrices(few))
    return rounded(tasks.groupBy("plate_id").agg(F.count("*").alias("tasks"), F.max(F.get("m", F.lit(0))).alias("m0")), "m0")


@query("G23_G25_full_descent", _tiles_sql(T.GEOGRAPHIC) + " SELECT feature_id, (x * 4 + i)::INT AS x, (y * 4 + j)::INT AS y, 5 AS l FROM tiles, range(4) a(i), range(4) b(j) WHERE whole")
def full_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.descend(_tiles(spark, sf_dir).filter("clip is null"), 2).select("feature_id", "x", "y", "l")


def _grid_sql(scheme: str) -> str:
    nx = 2 if scheme == T.GEOGRAPHIC else 1
    tiles = f"SELECT p_partkey * 7 % ({nx} << l) AS x, p_partkey * 5 % (1 << l) AS y, l, p_partkey FROM (SELECT p_partkey, (1 + p_partkey % 6)::INT AS l FROM part)"
    return f"SELECT p_partkey, l, x::INT AS x, y::INT AS y, round(tw, 6) AS west, round(ts, 6) + 0.0::DOUBLE AS south, round(te, 6) AS east, round(tn, 6) + 0.0::DOUBLE AS north FROM (SELECT *, {_rect_sql(scheme)} FROM ({tiles}) g) t(x, y, l, p_partkey, tw, ts, te, tn)"


def _grid(spark: SparkSession, sf_dir: str, scheme: str) -> DataFrame:
    """A tile for each part, of one of six levels."""
    k = F.col("p_partkey")
    level = table(spark, sf_dir, "part").select("p_partkey", (1 + k % 6).cast("int").alias("l"))
    tiles = level.select("p_partkey", "l", (k * 7 % T.columns_at(F.col("l"), scheme)).cast("int").alias("x"), (k * 5 % T.rows_at(F.col("l"))).cast("int").alias("y"))
    return rounded(tiles.withColumn("r", T.rectangle(F.col("x"), F.col("y"), F.col("l"), scheme)).select("p_partkey", "l", "x", "y", "r.*"), "west", "south", "east", "north")


@query("D26_grid_geographic", _grid_sql(T.GEOGRAPHIC))
def grid_geographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, T.GEOGRAPHIC)


@query("D26_grid_mercator", _grid_sql(T.MERCATOR))
def grid_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, T.MERCATOR)


@query(
    "G32_G33_subdivision",
    f"""WITH {DOMAINS}, n AS (SELECT *, greatest(1, ceil((east - west) / 17.3 - 1e-12))::INT AS cols, greatest(1, ceil((north - south) / 17.3 - 1e-12))::INT AS rows FROM dom),
    p AS (SELECT *, unnest(range(cols)) AS col FROM n), q AS (SELECT *, unnest(range(rows)) AS row FROM p)
    SELECT feature_id, row::INT AS row, col::INT AS col, round(west + (east - west) * col / cols, 6) AS west, round(south + (north - south) * row / rows, 6) AS south, round(west + (east - west) * (col + 1) / cols, 6) AS east,
      round(south + (north - south) * (row + 1) / rows, 6) AS north, round(col / cols + 0.25 * ((col + 1) / cols - col / cols), 6) AS mid_u, round((row + 1) / rows, 6) AS v1 FROM q""",
)
def subdivision(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = O.subdivide(domains(spark, sf_dir).select("feature_id", "west", "south", "east", "north"), 17.3)
    parts = parts.withColumn("mid_u", O.remap(F.lit(0.25), F.col("u0"), F.col("u1"))).drop("u0", "v0", "u1")
    return rounded(parts, "west", "south", "east", "north", "mid_u", "v1")


# --- Views ------------------------------------------------------------------------------------------------------------

#: A view of each supplier, some over the antimeridian, one in 25 the whole globe; made alike in both engines.
_VIEW = {
    "view_id": "CAST(k AS INT)",
    "west": "CASE WHEN k % 25 = 0 THEN -180 ELSE k * 37 % 3600 / 10 - 180 + 0.0137 END",
    "south": "CASE WHEN k % 25 = 0 THEN -90 ELSE k * 53 % 1500 / 10 - 80 + 0.0071 END",
    "east": "CASE WHEN k % 25 = 0 THEN 180 WHEN k * 37 % 3600 / 10 + 0.6137 + k * k % 97 * 1.3 > 360 THEN k * 37 % 3600 / 10 + 0.6137 + k * k % 97 * 1.3 - 540 ELSE k * 37 % 3600 / 10 + 0.6137 + k * k % 97 * 1.3 - 180 END",
    "north": "CASE WHEN k % 25 = 0 THEN 90 ELSE least(89.5, k * 53 % 1500 / 10 - 79.6 + k % 31) END",
}


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    bounds = (F.expr(x).cast("int" if c == "view_id" else "double").alias(c) for c, x in _VIEW.items())
    return rows.select(*bounds, *(F.lit(v).alias(c) for c, v in (("width", 1280.0), ("height", 720.0), ("camera_height", 1e6))))


WITH_VIEWS = "WITH v AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _VIEW.items()) + """ FROM (SELECT s_suppkey AS k FROM supplier)), c AS (SELECT view_id, west::DOUBLE AS west, south::DOUBLE AS south, east::DOUBLE AS east, north::DOUBLE AS north,
  (CASE WHEN east < west THEN east - west + 360 ELSE east - west END)::DOUBLE AS span, ((south + north) / 2)::DOUBLE AS lat FROM v), cc AS (SELECT *, CASE WHEN west + span / 2 >= 180 THEN west + span / 2 - 360 ELSE west + span / 2 END AS lon FROM c)"""


def _chord(lat1: str, dlon: str) -> str:
    return f"2 * {R.EARTH} * abs(cos(radians({lat1}))) * sin(radians({dlon}) / 2)"


def _lat_chord(a: str, b: str) -> str:
    return f"2 * {R.EARTH} * sin(radians({b} - {a}) / 2)"


_MPP = f"greatest(CASE WHEN span >= 360 THEN 2 * pi() * {R.EARTH} * abs(cos(radians(lat))) ELSE {_chord('lat', 'span')} END / 1280, {_lat_chord('south', 'north')} / 720)"


@query("M12_M13_metres_per_pixel", WITH_VIEWS + f" SELECT view_id, round({_MPP}, 3) AS metres FROM cc")
def view_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views(spark, sf_dir).select("view_id", V.metres_per_pixel().alias("metres")), "metres", digits=3)


def _tile_metres_sql() -> str:
    row = "least(pow(2, l) - 1, floor((90 - lat) / 180 * pow(2, l)))"
    mid = f"(90 - ({row} + 0.5) / pow(2, l) * 180)"
    wide = f"CASE WHEN l = -1 THEN 0 ELSE {_chord(mid, '(180 / pow(2, l))')} END"
    return f"greatest({wide}, {_lat_chord('0', '(180 / pow(2, l))')})"


@query("M14_tile_metres", WITH_VIEWS + f" SELECT view_id, l::INT AS level, round({_tile_metres_sql()}, 3) AS metres FROM cc, range(0, 7) r(l)")
def tile_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(i.alias("level"), V.tile_metres(i, T.GEOGRAPHIC).alias("metres")))))
    return rounded(rows.select("view_id", "at.level", "at.metres"), "metres", digits=3)


_COLS = lambda a, b: f"(floor(({b} - 1e-10 + 180) / 360 * nx) - floor(({a} + 1e-10 + 180) / 360 * nx) + 1)"
_RAW = f"""(floor((90 - greatest(south, -90 + 1e-10)) / 180 * ny) - floor((90 - least(north, 90 - 1e-10)) / 180 * ny) + 1) *
  CASE WHEN span >= 360 - 1e-7 THEN nx WHEN west <= east THEN {_COLS("west", "east")} ELSE {_COLS("west", "180")} + {_COLS("-180", "east")} END"""


@query("M15_raw_view_tiles", WITH_VIEWS + f" SELECT view_id, l::INT AS level, ({_RAW})::INT AS raw_tiles FROM (SELECT *, 2 * pow(2, l) AS nx, pow(2, l) AS ny FROM cc, range(0, 9) r(l))")
def raw_view_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(i.alias("level"), V.raw_tiles(i, T.GEOGRAPHIC).cast("int").alias("raw_tiles")))))
    return rows.select("view_id", "at.*")


@query(
    "O2_O3_view_level",
    WITH_VIEWS
    + f""", lv AS (SELECT view_id, l, abs(ln({_tile_metres_sql()} / {_MPP} / 256)) AS score, {_RAW} AS raw FROM (SELECT *, 2 * pow(2, l) AS nx, pow(2, l) AS ny FROM cc, range(0, 13) r(l))),
    best AS (SELECT view_id, arg_min(l, (score, l)) AS b FROM lv GROUP BY view_id)
    SELECT view_id, max(l)::INT AS level FROM lv JOIN best USING (view_id) WHERE l <= b AND (raw <= 128 OR l = 0) GROUP BY view_id""",
)
def view_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.choose_level(views(spark, sf_dir), high=12).select("view_id", "level")


@query("P21_level_bounds", "SELECT p_partkey, low::INT AS low, greatest(low, floor(coalesce(b, c, 18)))::INT AS high FROM (SELECT p_partkey, b, c, greatest(0, floor(coalesce(a, 0))) AS low FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 23 - 3.1 END AS a, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 17 + 0.7 END AS b, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 11 + 0.2 END AS c FROM part))")
def level_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b, c = ((F.when(k % n > 0, k % m + F.lit(x))).cast("double") for n, m, x in ((4, 23, -3.1), (5, 17, 0.7), (3, 11, 0.2)))
    return table(spark, sf_dir, "part").select("p_partkey", V.level_bounds(a, b, c).alias("s")).select("p_partkey", "s.*")


@query(
    "M16_view_sphere",
    WITH_VIEWS
    + f""", p AS (SELECT view_id, lon, lat, west + span * i / 8 AS plon, CASE e WHEN 0 THEN south ELSE north END AS plat FROM cc, range(0, 9) a(i), range(0, 2) b(e)
      UNION ALL SELECT view_id, lon, lat, CASE e WHEN 0 THEN west ELSE east END, south + (north - south) * i / 8 FROM cc, range(1, 8) a(i), range(0, 2) b(e))
    SELECT view_id, round({R.EARTH} * sqrt(max(pow(cos(radians(plat)) * cos(radians(plon)) - cos(radians(lat)) * cos(radians(lon)), 2) + pow(cos(radians(plat)) * sin(radians(plon)) - cos(radians(lat)) * sin(radians(lon)), 2) + pow(sin(radians(plat)) - sin(radians(lat)), 2))), 2) AS radius FROM p GROUP BY view_id""",
)
def view_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views(spark, sf_dir).select("view_id", V.sphere()["r"].alias("radius")), "radius", digits=2)


_UNIT = lambda lon, lat: (f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))")


@query(
    "J6_J7_M17_M19_domains_in_view",
    WITH_MODEL.rstrip()
    + f""", {DOMAINS}, v AS (SELECT unnest([1, 2]) AS view_id, unnest([-15.0, 100.0])::DOUBLE AS lon, unnest([10.0, -20.0])::DOUBLE AS lat, unnest([2000000.0, 3000000.0])::DOUBLE AS r),
    d AS (SELECT feature_id, [ '101', '201', '301', '501', '601'][plate_id::INT + 1] AS plate_id, (west + east) / 2 AS lon, (south + north) / 2 AS lat, 1500000::DOUBLE AS r FROM dom),
    dp AS (SELECT d.*, {", ".join(f"{R.EARTH} * {e} AS {n}" for e, n in zip(_UNIT("lon", "lat"), "xyz", strict=True))} FROM d),
    vp AS (SELECT v.*, {", ".join(f"{R.EARTH} * {e} AS {n}" for e, n in zip(_UNIT("lon", "lat"), "xyz", strict=True))} FROM v),
    vm AS (SELECT view_id, plate_id, r, m0 * x + m3 * y + m6 * z AS x, m1 * x + m4 * y + m7 * z AS y, m2 * x + m5 * y + m8 * z AS z FROM vp, m WHERE m.age = 120)
    SELECT view_id, feature_id FROM dp JOIN vm USING (plate_id) WHERE sqrt(pow(dp.x - vm.x, 2) + pow(dp.y - vm.y, 2) + pow(dp.z - vm.z, 2)) <= dp.r + vm.r""",
)
def domains_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ball(lon, lat, r):
        p = R.position(lon, lat)
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), F.lit(r).cast("double").alias("r"))

    plates = F.array(*map(F.lit, ("101", "201", "301", "501", "601")))
    items = domains(spark, sf_dir).select("feature_id", F.get(plates, F.col("plate_id").cast("int")).alias("plate_id"), ball((F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2, 1.5e6).alias("sphere"))
    seen = spark.createDataFrame([(1, -15.0, 10.0, 2e6), (2, 100.0, -20.0, 3e6)], "view_id INT, lon DOUBLE, lat DOUBLE, r DOUBLE").select("view_id", F.lit(120.0).alias("age"), ball(F.col("lon"), F.col("lat"), F.col("r")).alias("sphere"))
    return V.in_view(items, seen, totals(spark, sf_dir)).select("view_id", "feature_id")


_SQL = lambda v: "NULL" if v is None else repr(v)


@query("S12_providers", dealt_sql(len(providers.PROVIDERS), "SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ", ".join(map(_SQL, p)) + ")" for i, p in enumerate(providers.PROVIDERS, 1)) + ") t(id, key, kind, min_level, max_level, scheme, url)"))
def provider_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider that each part names."""
    named = dealt(spark, sf_dir, [(i, p[0]) for i, p in enumerate(providers.PROVIDERS, 1)], "id INT, key STRING")
    return named.join(F.broadcast(providers.table(spark)), "key")  # a dozen of providers


@query("S13_template_errors", dealt_sql(4, "SELECT * FROM (VALUES (1, 0), (2, 3), (3, 2), (4, 1)) t(id, errors)"))
def template_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "https://a.example/{z}/{x}/{y}.png", 0, 5), (2, "ftp://a", 3, 1), (3, "", -1, 4), (4, "/tiles/{z}/{x}.png", 0, 0)]
    given = dealt(spark, sf_dir, rows, "id INT, template STRING, low INT, high INT")
    return given.select("p_partkey", "id", F.size(providers.template_errors(F.col("template"), F.col("low"), F.col("high"))).alias("errors"))


# --- Rings through the tile tree --------------------------------------------------------------------------------------

_RING_DOMAINS = f"{DOMAINS}, rdom AS (SELECT * FROM dom)"


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return domains(spark, sf_dir).withColumn("ring", F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south")))


def _ring_tiles_sql(level: int) -> str:
    return f"""WITH {_RING_DOMAINS}, t AS (SELECT a.x AS x, b.y AS y, -180 + a.x * 180 / pow(2, {level}) AS tw, -180 + (a.x + 1) * 180 / pow(2, {level}) AS te, 90 - (b.y + 1) * 180 / pow(2, {level}) AS ts, 90 - b.y * 180 / pow(2, {level}) AS tn FROM range({2 << level}) a(x), range({1 << level}) b(y)),
    c AS (SELECT feature_id, x, y, (least(east, te) - greatest(west, tw)) / (te - tw) AS w, (least(north, tn) - greatest(south, ts)) / (tn - ts) AS h FROM rdom, t WHERE least(east, te) > greatest(west, tw) AND least(north, tn) > greatest(south, ts))"""


@query("G13_G22_G26_ring_tiles", _ring_tiles_sql(3) + " SELECT feature_id, x::INT AS x, y::INT AS y, CASE WHEN w * h >= 1 - 1e-9 THEN 'FULL' ELSE 'CLIP' END AS status, round(w * h, 6) AS area FROM c")
def ring_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoplate.functions.geometry import signed_area

    tiles = O.tiles_of_rings(_rings(spark, sf_dir).select("feature_id", "ring"), 3)
    return rounded(tiles.select("feature_id", "x", "y", "status", F.coalesce(F.abs(signed_area(F.col("clip"))), F.lit(1.0)).alias("area")), "area")


@query("G38_visible_children", _ring_tiles_sql(3) + " SELECT feature_id, (x // 2)::INT AS x, (y // 2)::INT AS y, 2 AS l, count(*) AS children FROM c GROUP BY ALL")
def visible_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.visible_children(O.tiles_of_rings(_rings(spark, sf_dir).select("feature_id", "ring"), 3).withColumn("l", F.lit(3)), ["feature_id"])


@query(
    "G28_effective_level",
    " ".join(_ring_tiles_sql(0).split())
    + "".join(f", {_ring_tiles_sql(n).split('), t AS ')[1].join(['t%d AS ' % n, '']).replace('FROM rdom, t ', 'FROM rdom, t%d ' % n).replace('c AS (SELECT', 'c%d AS (SELECT' % n)}" for n in (1, 2, 3))
    + ", a AS (SELECT feature_id, 0 AS l, w * h AS s FROM c UNION ALL SELECT feature_id, 1, w * h FROM c1 UNION ALL SELECT feature_id, 2, w * h FROM c2 UNION ALL SELECT feature_id, 3, w * h FROM c3), g AS (SELECT feature_id, l, count(*) AS n, max(s) AS m FROM a GROUP BY ALL) SELECT feature_id, coalesce(min(l) FILTER (n > 1 OR m >= 1 - 1e-9), max(l))::INT AS level FROM g GROUP BY feature_id",
)
def effective_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = [O.tiles_of_rectangles(domains(spark, sf_dir), n).select("feature_id", "l", "status") for n in range(4)]
    return O.effective_level(levels[0].unionByName(levels[1]).unionByName(levels[2]).unionByName(levels[3]))


@query("G10_G11_pole_edges", dealt_sql(4, "SELECT * FROM (VALUES (1, 4, 1800.0::DOUBLE), (2, 4, 1800.0::DOUBLE), (3, 0, 0.0::DOUBLE), (4, 4, 2400.0::DOUBLE)) t(id, points, area)"))
def pole_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoplate.functions import geometry as G

    rows = [(1, [10.0, 60.0, 70.0, 60.0, 40.0, 90.0]), (2, [33.0, -90.0, 10.0, -60.0, 70.0, -60.0, 5.0, -90.0, 170.0, -90.0]), (3, [0.0, 90.0, 50.0, 90.0, 100.0, 90.0]), (4, [0.0, 10.0, 60.0, 10.0, 60.0, 50.0, 0.0, 50.0])]
    # Each part's ring is moved to the west.
    ring = G.with_pole_edges(G.affine(G.from_flat(F.col("flat")), F.lit(1.0), -(F.col("p_partkey") % 90).cast("double"), F.lit(1.0), F.lit(0.0)))
    return dealt(spark, sf_dir, rows, "id INT, flat ARRAY<DOUBLE>").select("p_partkey", "id", F.size(ring).alias("points"), F.abs(G.signed_area(ring)).alias("area"))


@query("A8_runtime_stats", _tiles_sql(T.GEOGRAPHIC) + " SELECT count(*) AS retained, count(DISTINCT (x, y, l)) AS images, count(*) * 262144 AS rgba_bytes FROM tasks")
def runtime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.runtime_stats(O.composites(_tiles(spark, sf_dir)))


@query("A9_generation_report", _tiles_sql(T.GEOGRAPHIC) + " SELECT CASE WHEN 550.0 BETWEEN end_age AND begin_age THEN 0 ELSE 1 END AS phase, count(*) FILTER ((x + y) % 5 > 1) AS completed, count(*) FILTER ((x + y) % 5 = 0) AS failed, count(*) FILTER ((x + y) % 5 = 1) AS cancelled FROM tasks GROUP BY 1")
def generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("x") + F.col("y")) % 5
    return O.generation_report(O.phases(O.composites(_tiles(spark, sf_dir)), 550.0).withColumn("outcome", F.when(k == 0, "failed").when(k == 1, "cancelled").otherwise("completed")))
