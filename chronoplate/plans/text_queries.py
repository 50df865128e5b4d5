"""Text rules and small formats over whole tables: each row of `part` renders a text, and the SQL says what must be read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.functions import geometry as G
from chronoplate.functions import scalars as S
from chronoplate.operators.tables import spread
from chronoplate.plans.registry import query, rounded, table
from chronoplate.sources import features, providers

def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query(
    "P14_P15_P16_text_table",
    """WITH t AS (SELECT p_partkey AS k, p_partkey % 7 AS c FROM part), n AS (SELECT k, c, CASE c WHEN 3 THEN -(k % 9) / 10 WHEN 4 THEN (k % 9 + 1) * 100 WHEN 5 THEN k + 0.5 WHEN 6 THEN -k END::DOUBLE AS number FROM t)
    SELECT k AS p_partkey, round(number, 6) + 0.0::DOUBLE AS number, round(CASE c WHEN 0 THEN 999999 WHEN 1 THEN -999 ELSE number END, 6)::DOUBLE + 0.0::DOUBLE AS age, k::VARCHAR AS name FROM n""",
)
def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    c = k % 7
    t = F.when(c == 0, "http://x/distantPast").when(c == 1, "gml:distantFuture").when(c == 2, "none").when(c == 3, _text("-.", k % 9)).when(c == 4, _text(k % 9 + 1, "e2 x")).when(c == 5, _text("about ", k, ".5 Ma and 7")).otherwise(_text("x-", k, "y"))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", S.first_number(t).alias("number"), S.geo_time(t).cast("double").alias("age"), S.local_name(_text("a:b:", k)).alias("name")), "number", "age")


@query("P6_P7_P8_position_table", "SELECT p_partkey, p_partkey % 3 <> 0 AS lat_lon, 2 AS points, (100 + p_partkey % 70)::DOUBLE AS x, (p_partkey % 80)::DOUBLE AS y FROM part")
def position_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two positions with a latitude and a longitude beyond 90 in either order, with or without a height, and a word that is no number."""
    k = F.col("p_partkey")
    lon, lat = (100 + k % 70).cast("string"), (k % 80).cast("string")
    pair = F.when(k % 3 == 0, _text(lon, " ", lat)).otherwise(_text(lat, "\n", lon))
    text = F.when(k % 2 == 0, _text(" ", pair, " x ", pair)).otherwise(_text(pair, " 9  ", pair, " 9 "))
    dimension = F.when(k % 2 == 0, 2).otherwise(3)
    given = table(spark, sf_dir, "part").select("p_partkey", S.numbers(text).alias("v"), dimension.alias("d")).withColumn("lat_lon", S.is_lat_lon(F.col("v"), F.col("d")))
    rows = given.withColumn("p", S.positions(F.col("v"), F.col("d"), F.col("lat_lon")))
    return rows.select("p_partkey", "lat_lon", F.size("p").alias("points"), F.get("p", F.lit(1))["x"].alias("x"), F.get("p", F.lit(1))["y"].alias("y"))


@query("P12_P13_attribute_table", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a' || p_partkey WHEN 1 THEN 'b' || p_partkey WHEN 2 THEN 'c' || p_partkey WHEN 3 THEN 'first' END AS plate FROM part")
def attribute_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by priority and in any case, twice in other cases, and none."""
    k = F.col("p_partkey")
    of = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    given = F.when(k % 5 == 0, of("PlateId1", "no", "plateid", _text("a", k))).when(k % 5 == 1, of("x", "1", "PLATEID1", _text("b", k))).when(k % 5 == 2, of("recon_plate_id", _text("c", k))).when(k % 5 == 3, of("PlateID", "first", "PLATEID", "second")).otherwise(of("name", "n"))
    return table(spark, sf_dir, "part").select("p_partkey", S.attribute(given, *features.PLATE_KEYS).alias("plate"))


@query("S8_A5_legacy_table", "SELECT 'f' || p_partkey AS feature_id, (p_size % 7)::VARCHAR AS plate_id, p_partkey::DOUBLE AS begin_age, 'area' AS intent, (p_size * (p_partkey % 7 + 1) / 2)::DOUBLE AS area FROM part WHERE p_partkey % 4 <> 0")
def legacy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part, of one feature with a triangle and a second polygon, or with none."""
    k, w, h = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 7 + 1
    at = lambda lat, lon: _text('{"Latitude":', lat, ',"Longitude":', lon, "}")
    ring = _text("[", at(F.lit(0), F.lit(0)), ",", at(F.lit(0), w), ",", at(h, w), "]")
    polygons = F.when(k % 4 == 0, "[]").otherwise(_text('[{"PosList":', ring, '},{"PosList":[]}]'))
    text = _text('[{"FeatureID":"f', k, '","PlateID":"', w % 7, '","ValidTime":{"Begin":', k, ',"End":0},"Polygon":', polygons, "}]")
    rows = features.parse_legacy_json(table(spark, sf_dir, "part").select(text.alias("text")))
    return rows.select("feature_id", "plate_id", "begin_age", "intent", F.abs(G.signed_area(F.col("exterior"))).alias("area"))


@query(
    "S10_geojson_table",
    "SELECT p_partkey::DOUBLE AS area, CASE p_partkey % 4 WHEN 0 THEN 4 ELSE 5 END AS points FROM part WHERE p_partkey % 4 <> 3 UNION ALL SELECT p_partkey::DOUBLE, 4 FROM part WHERE p_partkey % 4 = 1",
)
def geojson_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection with an open and an invalid ring, a feature of two polygons, a bare polygon, a point."""
    k = F.col("p_partkey")
    box = _text("[[0,0],[", k, ",0],[", k, ",1],[0,1],[0,0]]")
    collection = _text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[', 2 * k, ",0],[", 2 * k, ',1]],[[1,1],["x",2],[2,2]]]}},{"type":"Feature","geometry":null}]}')
    many = _text('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[', box, "],[[[5,5],[", k + 5, ",5],[", k + 5, ",7]]]]}}")
    text = F.when(k % 4 == 0, collection).when(k % 4 == 1, many).when(k % 4 == 2, _text('{"type":"Polygon","coordinates":[', box, "]}")).otherwise('{"type":"Point","coordinates":[1,2]}')
    rows = features.parse_geojson_rings(table(spark, sf_dir, "part").select(text.alias("text")))
    return rows.select(F.abs(G.signed_area(F.col("ring"))).alias("area"), F.size("ring").alias("points"))


@query(
    "S12_S13_tile_addresses",
    """WITH t AS (SELECT p_partkey AS k, p_size % 8 AS x, p_size % 5 AS y, 3 + p_partkey % 3 AS l FROM part)
    SELECT k AS p_partkey, CASE k % 3 WHEN 0 THEN '/t/' || l || '/' || x || '/' || y || '.png' WHEN 1 THEN '/t/' || l || '/' || x || '/' || (pow(2, l) - 1 - y)::BIGINT ELSE 'https://a/W/' || l || '/' || y || '/' || x || '.jpg' END AS url, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS errors FROM t""",
)
def tile_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y, level = F.col("p_size") % 8, F.col("p_size") % 5, 3 + k % 3
    url = F.when(k % 3 == 0, providers.tile_url(F.lit("/t/{z}/{x}/{y}.png"), x, y, level)).when(k % 3 == 1, providers.tile_url(F.lit("/t/{z}/{x}/{reverseY}"), x, y, level)).otherwise(providers.wmts_url(F.lit("https://a/{TileMatrixSet}/{TileMatrix}/{TileRow}/{TileCol}.jpg"), F.lit("W"), x, y, level))
    errors = providers.template_errors(F.when(k % 2 == 0, "/t/{z}/{x}/{y}").otherwise(_text("t", k)), F.lit(0), F.lit(4))
    return table(spark, sf_dir, "part").select("p_partkey", url.alias("url"), F.when(F.size(errors) == 0, 0).otherwise(1).alias("errors"))


@query(
    "S21_loaded_items",
    "SELECT CASE p_partkey % 3 WHEN 0 THEN 'g' ELSE 'f' END || p_partkey AS feature_id, (p_size % 7)::VARCHAR AS plate_id, CASE p_partkey % 3 WHEN 0 THEN 'gpml' ELSE 'json' END AS kind, (p_size * (p_partkey % 7 + 1) / 2)::DOUBLE AS area FROM part WHERE p_partkey % 3 < 2",
)
def loaded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of files of both kinds, told apart by their first character, without diagnostics; a third kind is no file."""
    k, w, h = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 7 + 1
    at = lambda lat, lon: _text('{"Latitude":', lat, ',"Longitude":', lon, "}")
    legacy = _text('[{"FeatureID":"f', k, '","PlateID":"', w % 7, '","Polygon":[{"PosList":[', at(F.lit(0), F.lit(0)), ",", at(F.lit(0), w), ",", at(h, w), "]}]}]")
    gpml = _text("<x><gml:featureMember><gpml:Basin><gpml:identity>g", k, "</gpml:identity><gpml:reconstructionPlateId>", w % 7, "</gpml:reconstructionPlateId><gpml:outlineOf><gml:Polygon><gml:exterior><gml:posList>0 100 0 ", w + 100, " ", h, " ", w + 100, "</gml:posList></gml:exterior></gml:Polygon></gpml:outlineOf></gpml:Basin></gml:featureMember></x>")
    text = F.when(k % 3 == 0, gpml).when(k % 3 == 1, _text("  ", legacy)).otherwise("none")
    files = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(text.alias("text")).withColumn("kind", features.kind_of(F.lit("blob:1"), F.col("text")))
    area = F.aggregate(F.transform("polygons", lambda p: F.abs(G.signed_area(p["exterior"]))), F.lit(0.0), lambda a, b: a + b)
    one = features.parse_gpml(files.filter("kind = 'gpml'")).select("feature_id", "plate_id", F.lit("gpml").alias("kind"), area.alias("area"))
    return one.unionByName(features.parse_legacy_json(files.filter("kind = 'json'")).select("feature_id", "plate_id", F.lit("json").alias("kind"), F.abs(G.signed_area(F.col("exterior"))).alias("area")))
