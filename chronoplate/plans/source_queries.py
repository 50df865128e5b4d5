"""Queries on feature files, configurations, artifacts and request streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.functions import geometry as G
from chronoplate.operators.tables import shared_dir, spread
from chronoplate.plans.registry import dealt, dealt_sql, query, rounded, table
from chronoplate.sources import artifacts, config, features
from chronoplate.streaming import requests

GPML = """<?xml version="1.0"?><gpml:FeatureCollection xmlns:gpml="g" xmlns:gml="m">
<gml:featureMember><gpml:Basin><gpml:identity>GPlates-1</gpml:identity><gml:name>North</gml:name><gpml:reconstructionPlateId><gpml:ConstantValue><gpml:value>101</gpml:value></gpml:ConstantValue></gpml:reconstructionPlateId>
<gml:validTime><gml:TimePeriod><gml:begin><gml:TimeInstant><gml:timePosition>410.5</gml:timePosition></gml:TimeInstant></gml:begin><gml:end><gml:TimeInstant><gml:timePosition>http://x/distantFuture</gml:timePosition></gml:TimeInstant></gml:end></gml:TimePeriod></gml:validTime>
<gpml:outlineOf><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList dimension="2">10 100 10 120 30 120 30 100 10 100</gml:posList></gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList>15 105 15 110 20 110 15 105</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></gpml:outlineOf></gpml:Basin></gml:featureMember>
<gml:featureMember><gpml:Coastline><gpml:identity>GPlates-2</gpml:identity><gpml:shapefileAttributes><gpml:KeyValueDictionary><gpml:element><gpml:KeyValueDictionaryElement><gpml:key>PlateId1</gpml:key><gpml:value>202</gpml:value></gpml:KeyValueDictionaryElement></gpml:element></gpml:KeyValueDictionary></gpml:shapefileAttributes>
<gpml:unclassifiedGeometry><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 0 4 3 4</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gpml:unclassifiedGeometry></gpml:Coastline></gml:featureMember>
<gml:featureMember><gpml:Volcano id="v3"><gpml:reconstructionPlateId>none</gpml:reconstructionPlateId></gpml:Volcano></gml:featureMember></gpml:FeatureCollection>"""


@query(
    "S7_P9_P11_gpml",
    """SELECT feature_id || '-' || p_partkey AS feature_id, t.* EXCLUDE (feature_id) FROM part, (VALUES ('GPlates-1', 'Basin', 'North', '101', 410.5::DOUBLE, -999.0::DOUBLE, 'area', 1, 1, 400.0::DOUBLE), ('GPlates-2', 'Coastline', NULL, '202', 999999.0::DOUBLE, -999.0::DOUBLE, 'line-like', 1, 0, 6.0::DOUBLE),
    ('v3', 'Volcano', NULL, NULL, 999999.0::DOUBLE, -999.0::DOUBLE, 'unknown', 0, 0, 0.0::DOUBLE)) t(feature_id, feature_type, name, plate_id, begin_age, end_age, intent, polygons, holes, area)""",
)
def gpml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part."""
    text = F.regexp_replace(F.lit(GPML), F.lit("(GPlates-[12]|v3)"), F.concat(F.lit("$1-"), F.col("p_partkey").cast("string")))
    rows = features.parse_gpml(spread(table(spark, sf_dir, "part").select("p_partkey")).select(text.alias("text")))
    return rows.select(
        "feature_id", "feature_type", "name", "plate_id", "begin_age", "end_age", "intent", F.size("polygons").alias("polygons"),
        F.aggregate(F.transform("polygons", lambda p: F.size(p["interiors"])), F.lit(0), lambda a, b: a + b).alias("holes"),
        F.aggregate(F.transform("polygons", lambda p: F.abs(G.signed_area(p["exterior"]))), F.lit(0.0), lambda a, b: a + b).alias("area"),
    )


@query(
    "S7_S22_member_files",
    "SELECT 'id-' || p_partkey AS feature_id, 'Basin' AS feature_type, CASE WHEN p_partkey % 3 <> 0 THEN 'part ' || p_partkey END AS name, (p_size % 7)::VARCHAR AS plate_id, (p_partkey % 600)::DOUBLE AS begin_age, 1 AS polygons, (p_size * (p_partkey % 7 + 1))::DOUBLE AS area FROM part",
)
def member_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature member for each part, written as files by all tasks and read by members."""
    k, w, h = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 7 + 1
    text = lambda c: c.cast("string")
    tag = lambda name, *inside: F.concat(F.lit(f"<{name}>"), *inside, F.lit(f"</{name}>"))
    points = F.concat_ws(" ", F.lit("0 100 0"), text(w + 100), text(h), text(w + 100), text(h), F.lit("100 0 100"))
    member = tag(
        "gml:featureMember", F.lit("<gpml:Basin>"), tag("gpml:identity", F.lit("id-"), text(k)), F.when(k % 3 == 0, "<!-- no name -->").otherwise(tag("gml:name", F.lit("part "), text(k))),
        tag("gpml:reconstructionPlateId", tag("gpml:value", text(w % 7))), tag("gml:validTime", tag("gml:begin", tag("gml:timePosition", text(k % 600)))),
        F.lit("<gpml:outlineOf><gml:Polygon><gml:exterior>"), tag("gml:posList", points), F.lit("</gml:exterior></gml:Polygon></gpml:outlineOf></gpml:Basin>"),
    )
    path = f"{shared_dir(spark)}/chronoplate/{uuid.uuid4().hex}/members"
    spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(member.alias("value")).write.text(path)
    rows = features.parse_members(features.read_members(spark, path))
    area = F.aggregate(F.transform("polygons", lambda p: F.abs(G.signed_area(p["exterior"]))), F.lit(0.0), lambda a, b: a + b)
    return rows.select("feature_id", "feature_type", "name", "plate_id", "begin_age", F.size("polygons").alias("polygons"), area.alias("area"))


LEGACY = '[{"FeatureID":"a","PlateID":"7","ValidTime":{"Begin":100,"End":0},"Polygon":[{"PosList":[{"Latitude":1,"Longitude":2},{"Latitude":3,"Longitude":2},{"Latitude":3,"Longitude":6}]},{"PosList":[]}]},{"FeatureID":"b","PlateID":"8","Polygon":[]}]'


@query("S8_A5_legacy_json", "SELECT 'a' || p_partkey AS feature_id, '7' AS plate_id, 100.0::DOUBLE AS begin_age, 0.0::DOUBLE AS end_age, 'area' AS intent, 4.0::DOUBLE AS area FROM part")
def legacy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.lit(LEGACY), F.lit('"a"'), F.concat(F.lit('"a'), F.col("p_partkey").cast("string"), F.lit('"')))
    rows = features.parse_legacy_json(table(spark, sf_dir, "part").select(text.alias("text")))
    return rows.select("feature_id", "plate_id", "begin_age", "end_age", "intent", F.abs(G.signed_area(F.col("exterior"))).alias("area"))


GEOJSON = [
    '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,3]],[[1,1],["x",2],[2,2]]]}},{"type":"Feature","geometry":null}]}',
    '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,2],[0,0]]],[[[5,5],[6,5],[6,6]]]]}}',
    '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}',
    '{"type":"Point","coordinates":[1,2]}',
    "no json",
]


@query("S10_geojson_rings", "SELECT t.area, t.points FROM part JOIN (VALUES (0, 6.0::DOUBLE, 4), (1, 4.0::DOUBLE, 5), (1, 0.5::DOUBLE, 4), (2, 1.0::DOUBLE, 5)) t(i, area, points) ON i = p_partkey % 5")
def geojson_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.parse_geojson_rings(dealt(spark, sf_dir, [(t,) for t in GEOJSON], "text STRING"))
    return rows.select(F.abs(G.signed_area(F.col("ring"))).alias("area"), F.size("ring").alias("points"))


@query("S9_format_dispatch", dealt_sql(6, "SELECT * FROM (VALUES (1, 'json'), (2, 'gpml'), (3, 'gpml'), (4, 'json'), (5, 'gpml'), (6, NULL)) t(id, kind)"))
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "a/b.JSON?x=1", ""), (2, "a.gpmlz#h", ""), (3, "a.xml", ""), (4, "blob:1", "  [1]"), (5, "blob:2", "\n<a/>"), (6, "a.txt", "x")]
    return dealt(spark, sf_dir, rows, "id INT, p STRING, t STRING").select("p_partkey", "id", features.kind_of(F.col("p"), F.col("t")).alias("kind"))


CONFIGS = ['{"timeMa": 120.5, "level": 3.6, "viewMode": "2D", "provider": "p", "anchorPlateId": null, "rotationFiles": ["a.rot", " ", "b.rot"]}', '{"age": 50, "viewMode": "4D", "level": "x", "anchorPlateId": "701", "rotationFile": "c.rot"}', "[1, 2]", "broken{"]


@query("S11_P28_config_import", dealt_sql(4, "SELECT * FROM (VALUES (1, true, 120.5::DOUBLE, 4, '2D', 'p', NULL, 2), (2, true, 50.0::DOUBLE, 4, '3D', 'local-topography', '701', 1), (3, false, 0.0::DOUBLE, 4, '3D', 'local-topography', '0', 0), (4, false, 0.0::DOUBLE, 4, '3D', 'local-topography', '0', 0)) t(id, is_config, time_ma, level, view_mode, provider, anchor, files)"))
def config_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = config.imported(dealt(spark, sf_dir, list(enumerate(CONFIGS, 1)), "id INT, config STRING"))
    return rows.withColumn("files", F.size("rotation_files")).drop("rotation_files")


@query("P18_P19_extent_checks", dealt_sql(3, "SELECT * FROM (VALUES (1, 0, 'web-mercator'), (2, 2, 'perspective-globe'), (3, 1, 'geographic')) t(id, errors, projection)"))
def extent_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, -50.0, -25.0, 20.0, 10.0, "2D", "web-mercator"), (2, -190.0, 10.0, 20.0, 5.0, "3D", "web-mercator"), (3, 5.0, 0.0, 5.0, 1.0, "2D", "geographic")]
    given = dealt(spark, sf_dir, rows, "id INT, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE, m STRING, k STRING")
    return given.select("p_partkey", "id", F.size(config.extent_errors(*(F.col(c) for c in "wsen"))).alias("errors"), config.projection(F.col("m"), F.col("k")).alias("projection"))


@query("K2_config_export", "SELECT n_nationkey AS id, n_name AS case_id, floor(n_nationkey * 10.1234567 * 1000000 + 0.5) / 1000000 AS time_ma, 2 AS files FROM nation")
def config_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("id"), F.col("n_name").alias("case_id"), (k * F.lit(10.1234567)).alias("time_ma"), *(F.lit(v).alias(c) for c, v in (("west", -1.5), ("south", -2.5), ("east", 3.5), ("north", 4.5))), F.array(F.lit("a"), F.lit("b")).alias("rotation_files"))
    back = F.from_json("j", "caseId STRING, timeMa DOUBLE, rotationFiles ARRAY<STRING>")
    return rounded(rows.select("id", config.export_json(rows).alias("j")).select("id", back.alias("c")).select("id", F.col("c.caseId").alias("case_id"), F.col("c.timeMa").alias("time_ma"), F.size("c.rotationFiles").alias("files")), "time_ma")


@query("K4_csv_manifest", """SELECT event_id, sha256(event_id || ',' || event_type || ',"a ""q"", ' || event_id || '"') AS sha256, length(event_id || ',' || event_type || ',"a ""q"", ' || event_id || '"')::INT AS bytes FROM events""")
def csv_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit('a "q", '), F.col("event_id").cast("string")).alias("note"))
    lined = rows.select("event_id", F.concat_ws(",", *(artifacts.csv_cell(F.col(c)) for c in rows.columns)).alias("content"))
    return artifacts.manifest(lined)


@query("T2_latest_age", "SELECT user_id AS session, time_bucket(INTERVAL '1 hour', ts) AS window_start, arg_max(value, event_id) AS age, max(event_id) AS token FROM events GROUP BY ALL")
def latest_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("token"), F.col("value").alias("age"))
    return requests.latest_ages(rows, window="1 hour")


@query(
    "T1_T3_token_outcomes",
    """WITH r AS (SELECT user_id::VARCHAR AS session, event_id AS seq, event_id // 40 - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS generation, (event_id // 2)::VARCHAR AS key FROM events WHERE event_type <> 'error'),
    d AS (SELECT user_id::VARCHAR AS session, event_id + event_id % 97 AS seq, event_id // 40 - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS generation, (event_id // 2)::VARCHAR AS key FROM events WHERE event_type <> 'error' AND event_id % 3 > 0)
    SELECT session, generation, key, seq, CASE WHEN EXISTS (SELECT 1 FROM r n WHERE n.session = r.session AND n.seq < r.seq AND n.generation > r.generation) THEN 'cancelled'
      WHEN over IS NULL AND done IS NULL THEN 'pending' WHEN done IS NULL OR over <= done THEN 'cancelled' ELSE 'completed' END AS outcome
    FROM (SELECT *, (SELECT min(seq) FROM r n WHERE n.session = r.session AND n.seq > r.seq AND n.generation > r.generation) AS over, (SELECT min(seq) FROM d WHERE d.session = r.session AND d.generation = r.generation AND d.key = r.key AND d.seq > r.seq) AS done FROM r) r""",
)
def token_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of their users, some of them of an older generation; two in three are done some time later, the same event's number further on."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").filter("event_type <> 'error'").select(F.col("user_id").cast("string").alias("session"), e.alias("seq"), (F.floor(e / 40) - F.when(e % 13 == 0, 1).otherwise(0)).alias("generation"), F.floor(e / 2).cast("string").alias("key"), "ts")
    done = rows.filter(F.col("seq") % 3 > 0).withColumn("seq", F.col("seq") + F.col("seq") % 97).withColumn("kind", F.lit("done"))
    return requests.token_outcomes(rows.withColumn("kind", F.lit("start")).unionByName(done)).select("session", "generation", "key", "seq", "outcome")


@query("T1_T3_newest_generation", "SELECT user_id AS session, event_id FROM events QUALIFY event_id // 100 = max(event_id // 100) OVER (PARTITION BY user_id)")
def newest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", F.floor(F.col("event_id") / 100).alias("generation"))
    return requests.newest_generation(rows).select("session", "event_id")
