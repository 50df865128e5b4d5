"""Queries on sample files, ranges, requests of views, presets and sources."""

from __future__ import annotations

import gzip
import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.operators import samplers as P
from chronoplate.operators.tables import shared_dir, spread
from chronoplate.plans.rotation_queries import WITH_MODEL, model
from chronoplate.plans.registry import dealt, dealt_sql, query, table
from chronoplate.sources import artifacts, experiments, features, presets, rot




@query("S19_sample_lines", "SELECT event_id, value FROM events WHERE event_id % 7 <> 0")
def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, some behind a byte-order mark and some blank; a missing file adds none."""
    line = F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.when(F.col("event_id") % 10 == 0, F.lit("\ufeff")).otherwise(F.lit("")), F.to_json(F.struct("event_id", "value"))))
    rows = P.parsed_lines(table(spark, sf_dir, "events").select(line.alias("value")), "event_id BIGINT, value DOUBLE")
    return rows.unionByName(P.read_samples(spark, f"{shared_dir(spark)}/no-such-file.jsonl", "event_id BIGINT, value DOUBLE"))


@query(
    "J16_latest_graphics_bytes",
    """WITH p AS (SELECT DISTINCT event_id % 9 AS pid FROM events WHERE event_type <> 'error' AND event_id // 50 = (SELECT max(event_id // 50) FROM events WHERE event_type <> 'error'))
    SELECT event_id % 13 AS pid, sum(event_id % 100)::BIGINT AS dedicated_bytes, sum(event_id % 37)::BIGINT AS shared_bytes FROM events WHERE event_id // 40 = (SELECT max(event_id // 40) FROM events) AND event_id % 13 IN (SELECT pid FROM p) GROUP BY 1""",
)
def latest_graphics_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, e = table(spark, sf_dir, "events"), F.col("event_id")
    processes = ev.filter("event_type <> 'error'").select(F.floor(e / 50).alias("sample"), (e % 9).alias("pid"))
    memory = ev.select(F.floor(e / 40).alias("sample"), F.concat(F.lit("pid_"), (e % 13).cast("string"), F.lit("_luid_0x0_0x1_phys_0")).alias("name"), (e % 100).alias("dedicated"), (e % 37).alias("shared"))
    return P.merged_latest(processes, memory)


@query(
    "A23_range_summaries",
    """WITH s AS (SELECT (event_id // 4 * 250)::DOUBLE AS epoch_ms, event_id % 4 + 100 AS pid, event_id * 0.25::DOUBLE AS cpu, event_id % 1000 AS bytes FROM events WHERE event_id % 11 <> 3),
    r AS (SELECT i AS record, (i * 777)::DOUBLE AS a, CASE i % 10 WHEN 9 THEN NULL WHEN 8 THEN 'nan'::DOUBLE ELSE i * 777 + 3000 END::DOUBLE AS b FROM range(60) t(i)),
    d AS (SELECT record, epoch_ms, bytes, greatest(0, cpu - lag(cpu) OVER (PARTITION BY record, pid ORDER BY epoch_ms)) AS c FROM r JOIN s ON NOT isnan(b) AND epoch_ms BETWEEN a AND b),
    g AS (SELECT record, epoch_ms, sum(CASE WHEN c IS NULL THEN 0 ELSE c END) AS c, sum(bytes)::BIGINT AS bytes FROM d GROUP BY ALL), f AS (SELECT record, count(*) AS n, sum(c) AS c, max(bytes) AS peak FROM g GROUP BY record)
    SELECT record, CASE WHEN b IS NULL OR isnan(b) THEN 'invalid' ELSE 'measured' END AS status, CASE WHEN b IS NOT NULL AND NOT isnan(b) THEN coalesce(n, 0) END AS samples, CASE WHEN b IS NOT NULL AND NOT isnan(b) THEN coalesce(c, 0) END::DOUBLE AS cpu_seconds, peak AS peak_bytes FROM r LEFT JOIN f USING (record)""",
)
def range_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = F.col("event_id"), F.col("id")
    samples = table(spark, sf_dir, "events").filter("event_id % 11 <> 3").select((F.floor(e / 4) * 250).cast("double").alias("epoch_ms"), (e % 4 + 100).alias("pid"), (e * 0.25).cast("double").alias("cpu_seconds"), (e % 1000).alias("bytes"))
    end = F.when(i % 10 == 9, F.lit(None)).when(i % 10 == 8, F.lit(float("nan"))).otherwise((i * 777 + 3000).cast("double"))
    ranges = spark.range(60).select(i.alias("record"), (i * 777).cast("double").alias("start_ms"), end.alias("end_ms"))
    return P.range_summaries(ranges, samples, ["record"], 1000.0)


_RECORD = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'load' ELSE 'age' END AS kind, o_orderkey % 2 = 0 AS warmup, o_orderkey % 5 % 2 AS block, o_orderkey % 7 % 2 AS replicate,
  CASE o_orderkey % 4 WHEN 3 THEN 'original-l2' ELSE 'case-' || o_orderkey || '-split-l2-extent' END AS condition_id, CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'failed' ELSE 'measured' END AS visual_status FROM orders"""


@query("A26_A28_smoke_rows", f"WITH r AS ({_RECORD}) SELECT condition_id || '-visual-smoke' AS name, coalesce(visual_status, 'missing') = 'measured' AS passed, coalesce(visual_status, 'missing') AS observed, 'measured' AS expected FROM r WHERE kind = 'load' AND NOT warmup AND block = 0 AND replicate = 0 AND condition_id LIKE '%split-l2-extent'")
def smoke_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "load").otherwise("age").alias("kind"), (k % 2 == 0).alias("warmup"), (k % 5 % 2).alias("block"), (k % 7 % 2).alias("replicate"),
        F.when(k % 4 == 3, "original-l2").otherwise(F.concat(F.lit("case-"), k.cast("string"), F.lit("-split-l2-extent"))).alias("condition_id"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, "failed").otherwise("measured").alias("visual_status"),
    )
    rows = P.smoke_rows(records)
    return rows.select(P.check(F.col("name"), F.col("observed"), F.col("expected")).alias("c")).select("c.name", "c.passed", "c.observed", "c.expected")


@query("P25_cached_responses", "SELECT event_id, event_id % 3 = 0 OR (event_id % 5 <> 0 AND event_id % 5 = 1) OR event_id % 7 = 0 AS cached FROM events")
def cached_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", P.from_cache(e % 3 == 0, F.when(e % 5 != 0, e % 5 == 1), e % 7 == 0).alias("cached"))


@query("P22_view_skip_reasons", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no-view-rectangle' WHEN event_id % 4 = 0 THEN 'not-ready' WHEN event_id % 3 <> 0 AND event_id % 2 <> event_id % 6 THEN 'stale-age' END AS reason FROM events")
def view_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", P.skip_reason(e % 5 != 0, e % 4 != 0, F.when(e % 3 == 0, F.lit(10.0)), e % 2, e % 6).alias("reason"))


@query("T4_retained_records", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS reused FROM events")
def retained_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.retained(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("event_id", "reused")


@query("T7_provider_change", "SELECT kind, count(*) AS n FROM (SELECT ['feature', 'rotation', 'tile', 'image', 'task'][event_id % 5 + 1] AS kind FROM events) WHERE kind IN ('feature', 'rotation') GROUP BY kind")
def provider_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("feature", "rotation", "tile", "image", "task")))
    return P.after_provider_change(table(spark, sf_dir, "events").select(F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("T8_revealed", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 END IS NOT DISTINCT FROM CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 6 END AS shown FROM events")
def revealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", P.revealed(F.when(e % 4 != 0, e % 3), F.when(e % 8 != 0, e % 6)).alias("shown"))


# --- Presets and sources ----------------------------------------------------------------------------------------------

_TEXT = lambda v: "NULL" if v is None else f"'{v}'"
_ALL = [("feature", *p) for p in presets.FEATURES] + [("rotation", *p) for p in presets.ROTATIONS] + [("outline", *p) for p in presets.OUTLINES]
PRESETS = "pre AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_TEXT, p))})" for p in _ALL) + ") t(kind, key, url))"


@query("S17_presets", f"WITH {PRESETS}, n AS (SELECT *, row_number() OVER (ORDER BY kind, key) - 1 AS i FROM pre) SELECT p_partkey, kind, key, url, key IN ({', '.join(map(_TEXT, presets.DEFAULTS.values()))}) AS is_default FROM part JOIN n ON i = p_partkey % {len(_ALL)}")
def preset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preset that each part names."""
    named = dealt(spark, sf_dir, sorted(p[:2] for p in _ALL), "kind STRING, key STRING")
    return named.join(F.broadcast(presets.table(spark)), ["kind", "key"])  # a dozen of presets


_KEYS = ["seton-2012-static-polygons-gpmlz", "gone", None, "merdith-2021-static-polygons-gpml"]
_URLS = ["/features/shapes_static_polygons_Merdith_etal.gpml", "/mine.gpml", None]


@query(
    "J10_config_presets",
    f"""WITH {PRESETS}, c AS (SELECT p_partkey, [{", ".join(map(_TEXT, _KEYS))}][p_partkey % 4 + 1] AS k, [{", ".join(map(_TEXT, _URLS))}][p_partkey % 3 + 1] AS u FROM part), f AS (SELECT * FROM pre WHERE kind = 'feature')
    SELECT p_partkey, coalesce(a.key, b.key, 'custom') AS found_key, CASE WHEN a.key IS NOT NULL THEN a.url ELSE u END AS found_url FROM c LEFT JOIN f a ON a.key = k LEFT JOIN f b ON b.url = u""",
)
def config_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % n).cast("int"))
    configs = table(spark, sf_dir, "part").select("p_partkey", at(_KEYS, 4).alias("preset_key"), at(_URLS, 3).alias("preset_url"))
    return presets.with_preset(configs, presets.table(spark).filter("kind = 'feature'")).select("p_partkey", "found_key", "found_url")


@query(
    "S15_source_resolution",
    """WITH o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'new.gpml' END AS s, CASE WHEN p_partkey % 5 = 0 THEN 'given.gpml' END AS su, CASE WHEN p_partkey % 2 = 0 THEN 'old.json' END AS old, CASE WHEN p_partkey % 7 > 2 THEN ['a.rot', 'b.rot'] WHEN p_partkey % 7 = 2 THEN [] END AS r, CASE WHEN p_partkey % 4 = 0 THEN ['old.rot'] END AS ro FROM part),
    e AS (SELECT *, coalesce(s, su, old) AS p, coalesce(r, ro) AS rots FROM o), x AS (SELECT *, CASE WHEN p IS NULL THEN 'no feature source' WHEN rots IS NULL OR len(rots) = 0 THEN 'no rotation source' END AS error FROM e)
    SELECT k AS p_partkey, CASE WHEN error IS NULL THEN p END AS polygon, CASE WHEN error IS NULL THEN len(rots) END::INT AS rotations, CASE WHEN error IS NULL THEN coalesce(CASE WHEN k % 5 = 0 THEN 'area' END, 'line-like') END AS intent, error FROM x""",
)
def source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    texts = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    found = presets.resolved(
        F.when(k % 3 == 0, "new.gpml"), F.when(k % 5 == 0, "given.gpml"), F.when(k % 5 == 0, "area"), F.when(k % 2 == 0, "old.json"), F.lit("line-like"),
        F.when(k % 7 > 2, texts("a.rot", "b.rot")).when(k % 7 == 2, texts()), F.when(k % 4 == 0, texts("old.rot")),
    )
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("s")).select("p_partkey", "s.polygon", F.when(F.col("s.error").isNull(), F.size("s.rotations")).alias("rotations"), "s.intent", "s.error")


@query("S2_rot_files", WITH_MODEL + "SELECT plate_id, age, pole_lat, pole_lon, angle, related_id, plate_id::INT % 3 AS file FROM rec")
def rot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files of the model's plates read as one text, in the order of their paths."""
    names = ("plate_id", "age", "pole_lat", "pole_lon", "angle", "related_id")
    lines = model(spark, sf_dir).select(F.col("plate_id").cast("int").alias("k"), F.concat_ws(" ", *(F.col(c).cast("string") for c in names), F.lit("! note")).alias("value"))
    paths = [f"{shared_dir(spark)}/chronoplate/{uuid.uuid4().hex}/{i}" for i in range(3)]
    for i, path in enumerate(paths):
        lines.filter(F.col("k") % 3 == i).select("value").coalesce(1).write.text(path)
    return rot.read(spark, *paths).select(*names, F.shiftright("line_no", 40).cast("int").alias("file"))


def _zip(*entries: tuple[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries:
            z.writestr(name, text)
    return out.getvalue()


@query("S4_S5_archives", "SELECT p_partkey || '/' || path AS path, text FROM (" + dealt_sql(5, "SELECT * FROM (VALUES (1, 'a.gpml', '<plain ä/>'), (2, 'b.gpmlz', '<gzip/>'), (3, 'c.zip', '<second/>'), (4, 'd.zip', 'first'), (5, 'e.zip', '<upper/>')) t(id, path, text)") + ")")
def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text, gzip, a zip with a feature file after another, one without, and one with a name in capitals."""
    files = [("a.gpml", "<plain ä/>".encode()), ("b.gpmlz", gzip.compress(b"<gzip/>")), ("c.zip", _zip(("x/readme.txt", "first"), ("x/m.gpml", "<second/>"))), ("d.zip", _zip(("one.txt", "first"), ("two.txt", "second"))), ("e.zip", _zip(("one.txt", "first"), ("M.XML", "<upper/>")))]
    rows = dealt(spark, sf_dir, files, "path STRING, content BINARY")
    return features.decoded(rows.select(F.concat_ws("/", F.col("p_partkey").cast("string"), "path").alias("path"), "content"))


_NAMES = ["outlineOf", "boundary", "other", "centerLineOf"]


@query("P10_property_names", f"SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE ['outlineOf', 'boundary', 'geometry', 'centerLineOf'][p_partkey % 4 + 1] END AS name FROM part")
def property_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest known element around the polygon, below one that is known as well."""
    k = F.col("p_partkey")
    name = F.get(F.array(*map(F.lit, _NAMES)), (k % 4).cast("int"))
    shape = F.when(k % 9 == 0, F.lit("<Point/>")).otherwise(F.lit("<Polygon/>"))
    outer = F.when(k % 4 == 2, F.lit("kept")).otherwise(F.lit("position"))
    xml = F.concat(F.lit("<m><"), outer, F.lit("><"), name, F.lit("><s>"), shape, F.lit("</s></"), name, F.lit("></"), outer, F.lit("></m>"))
    return table(spark, sf_dir, "part").select("p_partkey", features.property_name(xml).alias("name"))


_ASSETS = ["/features/a.gpml", "./tiles/{z}", "rotations/b.rot", "//geo/x", "/other/a", "https://a.example/features/x", "blob:1"]


@query("S23_asset_urls", "SELECT p_partkey, ['/app/features/a.gpml', '/app/tiles/{z}', '/app/rotations/b.rot', '/app/geo/x', '/other/a', 'https://a.example/features/x', 'blob:1'][p_partkey % 7 + 1] AS url, CASE WHEN p_partkey % 2 = 0 THEN 'merdith-2021-rot' ELSE 'custom' END AS preset FROM part")
def asset_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    url = F.get(F.array(*map(F.lit, _ASSETS)), (k % 7).cast("int"))
    files = F.when(k % 2 == 0, F.array(F.lit(presets.ROTATIONS[2][1]))).otherwise(F.array(F.lit(presets.ROTATIONS[2][1]), F.lit("more.rot")))
    return table(spark, sf_dir, "part").select("p_partkey", presets.asset_url(url, "/app/").alias("url"), presets.rotation_preset(files).alias("preset"))


@query("P26_P27_names", "SELECT event_id, ['MORPHING', 'COLUMBUS_VIEW', 'SCENE2D', 'SCENE3D'][event_id % 4 + 1] AS scene, CASE WHEN event_id % 4 = 2 THEN '2D_RECTANGULAR' ELSE '3D_GLOBE' END AS mode, 'geographic:' || event_id % 3 || ',' || event_id % 5 || ',7' AS scheme FROM events")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    key = presets.scheme_key(F.lit("geographic"), (e % 3).cast("string"), (e % 5).cast("string"), F.lit("7"))
    return table(spark, sf_dir, "events").select("event_id", presets.scene_mode(e % 4).alias("scene"), presets.view_mode(e % 4).alias("mode"), key.alias("scheme"))


@query("K5_suite_json", "SELECT event_id, event_type, value FROM events")
def suite_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON and read again."""
    path = f"{shared_dir(spark)}/chronoplate/{uuid.uuid4().hex}/suite"
    artifacts.write_json(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return spark.read.schema("event_id BIGINT, event_type STRING, value DOUBLE").json(path)


# --- Experiment documents ---------------------------------------------------------------------------------------------

_ANCHORS = ['"rotationAnchorMode": "auto", "anchorPlateId": "701", ', '"rotationAnchorMode": "custom", "anchorPlateId": null, ', '"anchorPlateId": "701", ', '"anchorPlateId": "-00", ', '"anchorPlateId": null, ', '"rotationAnchorMode": "other", ']


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiment document for each part, with fields missing, of other types and beyond their enumerations."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    sources = F.concat(
        F.lit('"sources": {'), pick(_ANCHORS, 6), F.lit('"featurePresetKey": "'), pick(["merdith-2021-static-polygons-gpml", "gone"], 2), F.lit('", "rotUrls": ['), pick(['" ", "a.rot", 5, "b.rot"', '" ", 7'], 2),
        F.lit('], "gplatesReferencePolygonUrl": "/gplates_ref/geojson/Merdith2021_750.00Ma.geojson", "gplatesReferencePolygonColor": "'), pick(["#12ab3F", "red"], 2),
        F.lit('", "providerKey": "'), pick(["custom-url-template", "macrostrat-carto", "nothing"], 3), F.lit('", "customProviderConfig": {"url": "/t/{z}", "tilingSchemeKey": "geographic", "minimumLevel": 0.5, "maximumLevel": '), text(k % 9), F.lit("}}, "),
    )
    doc = F.concat(
        F.lit('{"schemaVersion": '), F.when(k % 23 == 0, "2").otherwise("1"), F.lit(', "caseId": "c'), text(k), F.lit('", "timeMa": '), F.when(k % 7 == 0, '"x"').otherwise(text(k * 5)), F.lit(', "viewMode": "'), pick(["2D_RECTANGULAR", "3D_GLOBE", "MORPH"], 3),
        F.lit('", "rotationFile": "old.rot", "platePolygonFile": "old.gpml", "extent": {"west": -'), text(k % 100), F.lit('.25, "south": -1, "east": 2.5, "north": '), F.when(k % 6 == 0, "null").otherwise("3"),
        F.lit('}, "output": {"width": '), text(k % 4), F.lit(', "configuredCssHeight": 10.5, "height": 7, "pixelRatio": 2}, '), F.when(k % 5 == 0, "").otherwise(sources),
        F.lit('"render": {"level": '), text(k % 4 - 2), F.lit('.5, "polygonRenderIntent": "'), pick(["classified", "x"], 2), F.lit('", "debugEnabled": true}}'),
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.when(k % 29 == 0, F.lit("[1]")).when(k % 31 == 0, F.lit("{broken")).otherwise(doc).alias("config"))


_CONTROLS = """WITH k AS (SELECT p_partkey, p_partkey AS k, p_partkey % 5 <> 0 AS s, CASE WHEN p_partkey % 29 = 0 OR p_partkey % 31 = 0 THEN 'no object' WHEN p_partkey % 23 = 0 THEN 'another schema version' END AS error FROM part),
c AS (SELECT p_partkey, error, CASE WHEN error IS NULL THEN 'c' || k END AS case_id, CASE WHEN error IS NULL AND k % 7 <> 0 THEN k * 5 END::DOUBLE AS age, CASE WHEN error IS NULL THEN ['2D_RECTANGULAR', '3D_GLOBE', NULL][k % 3 + 1] END AS view_mode,
  CASE WHEN error IS NULL AND k % 6 <> 0 THEN -(k % 100) - 0.25 END::DOUBLE AS west, CASE WHEN error IS NULL AND k % 4 > 0 THEN k % 4 END::INT AS width, CASE WHEN error IS NULL AND k % 4 > 0 THEN 11 END::INT AS height,
  CASE WHEN error IS NULL AND s AND k % 2 = 0 THEN 'merdith-2021-static-polygons-gpml' END AS feature_preset, CASE WHEN error IS NULL THEN 'old.gpml' END AS feature_url, CASE WHEN error IS NULL THEN CASE WHEN s AND k % 2 = 0 THEN '#12ab3F' ELSE '#E6E6E6' END END AS outline_color,
  CASE WHEN error IS NULL THEN CASE WHEN s THEN 'merdith-2021-750' ELSE 'off' END END AS outline_key, CASE WHEN error IS NULL THEN CASE WHEN s THEN ['auto', 'custom', 'custom', 'default', 'auto', 'default'][k % 6 + 1] ELSE 'default' END END AS anchor_mode,
  CASE WHEN error IS NULL THEN CASE WHEN s THEN [NULL, '0', '701', '-00', NULL, '0'][k % 6 + 1] ELSE '0' END END AS anchor, CASE WHEN error IS NULL THEN CASE WHEN s AND k % 2 = 0 THEN 'a.rot b.rot' ELSE 'old.rot' END END AS rotation_urls,
  CASE WHEN error IS NULL AND s THEN ['custom-url-template', 'macrostrat-carto', NULL][k % 3 + 1] END AS provider, CASE WHEN error IS NULL AND s THEN k % 9 END::INT AS custom_max,
  CASE WHEN error IS NULL THEN CASE k % 4 WHEN 2 THEN 1 WHEN 3 THEN 2 END END::INT AS level, CASE WHEN error IS NULL AND k % 2 = 0 THEN 'classified' END AS render_intent, CASE WHEN error IS NULL THEN TRUE END AS debug FROM k)"""


def _controls(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "p_partkey", "error", "case_id", "age", "view_mode", "extent.west", "output.width", "output.height", "feature_preset", "feature_url", "outline_color", "outline_key", "anchor_mode", "anchor",
        F.array_join("rotation_urls", " ").alias("rotation_urls"), "provider", F.col("custom_provider.max_level").alias("custom_max"), "level", "render_intent", "debug", *more,
    )


@query("S11_P27_P28_experiment_import", _CONTROLS + " SELECT * FROM c")
def experiment_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controls(experiments.imported(documents(spark, sf_dir)))


@query(
    "K2_experiment_export",
    _CONTROLS + """ SELECT * REPLACE (CASE WHEN provider = 'custom-url-template' THEN custom_max END AS custom_max, CASE WHEN anchor_mode <> 'custom' THEN CASE anchor_mode WHEN 'default' THEN '0' END ELSE anchor END AS anchor),
    CASE WHEN view_mode = '3D_GLOBE' THEN 'perspective-globe' WHEN provider = 'macrostrat-carto' THEN 'web-mercator' ELSE 'geographic' END AS projection, coalesce(round((west + 2.5) / 2, 6), 0)::DOUBLE AS central_meridian FROM c WHERE error IS NULL""",
)
def experiment_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exported from their controls and read again."""
    once = lambda df, **named: df.select("p_partkey", F.inline(F.array(F.struct(*(c.alias(n) for n, c in named.items())))))  # noqa: E731  (a generator: nothing before it is computed again after it)
    imported = experiments.imported(documents(spark, sf_dir))
    controls = once(imported, **{c: F.col(c) for c in imported.columns if c != "p_partkey"}).filter("error is null")
    out = once(controls, config=experiments.exported(controls))
    more = F.from_json("config", "projection STRING, centralMeridian DOUBLE")
    back = experiments.imported(out.select("p_partkey", "config", more.alias("m")))
    back = _controls(back, "m")
    return back.withColumns({"projection": F.col("m.projection"), "central_meridian": F.col("m.centralMeridian")}).drop("m")
