"""Whole experiment documents: tolerant import of every control, and export.

A field of another type than its own, or beyond its enumeration, counts as missing; newer names go before older ones. Import gives a row for
every row; what is no object, or of another schema version, has an error and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplate.functions.scalars import round_half_up
from chronoplate.sources import presets, providers

#: What enumerations allow, and defaults.
VIEW_MODES = ("2D_RECTANGULAR", "3D_GLOBE")
ANCHOR_MODES = ("default", "auto", "custom")
RENDER_INTENTS = ("classified", "all-polygons-area")
TRANSFORM_MODES = ("dynamic3D", "bakedInstance")
SCHEMES = ("geographic", "web-mercator")
OUTLINE_COLOR = "#E6E6E6"
CAMERA = ("targetLon", "targetLat", "range", "heading", "pitch", "roll")


class _Fields:
    """Typed values of a variant column by path."""

    def __init__(self, variant: Column):
        self.v = variant

    def kind(self, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(self.v, path, "variant")), F.lit(""))

    def is_object(self, path: str) -> Column:
        return self.kind(path).startswith("OBJECT")

    def text(self, path: str, allowed: tuple[str, ...] | None = None) -> Column:
        value = F.when(self.kind(path) == "STRING", F.try_variant_get(self.v, path, "string"))
        return F.when(value.isin(*allowed), value) if allowed else value

    def number(self, path: str) -> Column:
        return F.when(self.kind(path).rlike(r"^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(self.v, path, "double"))

    def whole(self, path: str) -> Column:
        return F.floor(self.number(path) + 0.5).cast("int")

    def flag(self, path: str) -> Column:
        return F.when(self.kind(path) == "BOOLEAN", F.try_variant_get(self.v, path, "boolean"))

    def texts(self, path: str) -> Column:
        """The non-blank strings of a list; null if there are none."""
        items = F.filter(F.try_variant_get(self.v, path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
        found = F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), lambda s: F.trim(s) != "")
        return F.when(F.size(found) > 0, found)

    def given(self, path: str) -> Column:
        """Whether there is a text or an explicit null."""
        return self.kind(path).isin("STRING", "VOID")


def _all(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull()
    return out


def imported(rows: DataFrame, text: str = "config") -> DataFrame:
    """The other columns, `error`, and a column for every control."""
    parsed = rows.withColumn("_v", F.try_parse_json(F.col(text)))
    f = _Fields(F.col("_v"))
    error = F.when(~F.coalesce(f.kind("$").startswith("OBJECT"), F.lit(False)), "no object").when(~F.coalesce(f.number("$.schemaVersion") == 1, F.lit(False)), "another schema version")
    s = f.is_object("$.sources")
    extent = {c: f.number(f"$.extent.{c}") for c in ("west", "south", "east", "north")}
    camera = {c: f.number(f"$.camera3D.{c}") for c in CAMERA} | {"orthographic": f.flag("$.camera3D.orthographic")}
    width, height = (F.coalesce(f.whole(f"$.output.configuredCss{c}"), f.whole(f"$.output.{c.lower()}")) for c in ("Width", "Height"))
    ratio = F.coalesce(f.number("$.output.configuredPixelRatio"), f.number("$.output.pixelRatio"))
    output = _all(width, height, ratio) & (width >= 1) & (height >= 1) & (ratio > 0)
    mode, anchor = f.text("$.sources.rotationAnchorMode", ANCHOR_MODES), f.text("$.sources.anchorPlateId")
    given = F.coalesce(f.given("$.sources.anchorPlateId"), F.lit(False))
    found_mode = F.when(~s, "default").when(mode.isNotNull(), mode).when(given & anchor.isNull(), "auto").when(given & ~anchor.rlike(r"^\s*[+-]?0+\s*$"), "custom").otherwise("default")
    found_anchor = F.when(~s | (mode == "default"), F.lit("0")).when(mode == "auto", F.lit(None)).when(mode == "custom", F.coalesce(anchor, F.lit("0"))).when(given, anchor).otherwise(F.lit("0"))
    outline_url = f.text("$.sources.gplatesReferencePolygonUrl")
    by_url = F.coalesce(*(F.when(outline_url == url, F.lit(key)) for key, url in presets.OUTLINES if url), F.lit("off"))
    color = f.text("$.sources.gplatesReferencePolygonColor")
    custom = {"url": F.nullif(f.text("$.sources.customProviderConfig.url"), F.lit("")), "scheme": f.text("$.sources.customProviderConfig.tilingSchemeKey", SCHEMES), "min_level": f.whole("$.sources.customProviderConfig.minimumLevel"), "max_level": f.whole("$.sources.customProviderConfig.maximumLevel")}
    level = f.whole("$.render.level")
    whole = lambda parts, ok: F.when(ok, F.struct(*(v.alias(k) for k, v in parts.items())))
    columns = {
        "case_id": F.nullif(f.text("$.caseId"), F.lit("")),
        "model_name": F.nullif(f.text("$.modelName"), F.lit("")),
        "view_mode": f.text("$.viewMode", VIEW_MODES),
        "age": f.number("$.timeMa"),
        "extent": whole(extent, _all(*extent.values())),
        "camera": whole(camera, _all(*camera.values())),
        "output": whole({"width": width, "height": height, "pixel_ratio": ratio}, output),
        "base_color": F.nullif(f.text("$.layers.backgroundColor"), F.lit("")),
        "feature_preset": f.text("$.sources.featurePresetKey", tuple(k for k, _ in presets.FEATURES)),
        "feature_url": F.coalesce(f.text("$.sources.featureUrl"), f.text("$.platePolygonFile")),
        "outline_color": F.when(color.rlike("^#[0-9a-fA-F]{6}$"), color).otherwise(OUTLINE_COLOR),
        "outline_key": F.when(s, F.coalesce(f.text("$.sources.gplatesReferencePolygonKey", tuple(k for k, _ in presets.OUTLINES)), by_url)).otherwise("off"),
        "rotation_preset": f.text("$.sources.rotationPresetKey", tuple(k for k, _ in presets.ROTATIONS)),
        "anchor_mode": found_mode,
        "anchor": found_anchor,
        "rotation_urls": F.coalesce(f.texts("$.sources.rotUrls"), f.texts("$.rotationFiles"), F.when(F.coalesce(f.text("$.rotationFile"), F.lit("")) != "", F.array(f.text("$.rotationFile")))),
        "provider": f.text("$.sources.providerKey", tuple(p[0] for p in providers.PROVIDERS)),
        "custom_provider": whole(custom, _all(*custom.values())),
        "level": F.when(level >= 0, level),
        "render_intent": f.text("$.render.polygonRenderIntent", RENDER_INTENTS),
        "transform_mode": f.text("$.render.primitiveTransformMode", TRANSFORM_MODES),
        "debug": f.flag("$.render.debugEnabled"),
    }
    return parsed.select(*(c for c in rows.columns if c != text), error.alias("error"), *(F.when(error.isNull(), c).alias(name) for name, c in columns.items()))


def exported(rows: DataFrame) -> Column:
    """A document of a row with the columns of imported(), as JSON: numbers rounded half up to six digits, lists whole, missing parts left out; with projection, central meridian, and whether an outline is shown."""
    r = round_half_up
    c = F.col
    scheme = F.coalesce(*(F.when(c("provider") == p[0], F.lit(p[4])) for p in providers.PROVIDERS if p[4]), c("custom_provider.scheme"))
    outline_url = F.coalesce(*(F.when(c("outline_key") == key, F.lit(url)) for key, url in presets.OUTLINES if url), F.lit(None).cast("string"))
    globe = c("view_mode") == "3D_GLOBE"
    projection = F.when(globe, "perspective-globe").when(scheme == "web-mercator", "web-mercator").otherwise("geographic")
    extent = F.when(c("extent").isNotNull(), F.struct(*(r(c(f"extent.{k}")).alias(k) for k in ("west", "south", "east", "north"))))
    camera = F.when(globe & c("camera").isNotNull(), F.struct(*(r(c(f"camera.{k}")).alias(k) for k in CAMERA), c("camera.orthographic").alias("orthographic")))
    size = F.struct(c("output.width").alias("width"), c("output.height").alias("height"), c("output.pixel_ratio").alias("pixelRatio"), c("output.width").alias("configuredCssWidth"), c("output.height").alias("configuredCssHeight"), c("output.pixel_ratio").alias("configuredPixelRatio"))
    custom = F.when(c("provider") == "custom-url-template", F.struct(c("custom_provider.url").alias("url"), c("custom_provider.scheme").alias("tilingSchemeKey"), c("custom_provider.min_level").alias("minimumLevel"), c("custom_provider.max_level").alias("maximumLevel")))
    sources = F.struct(
        c("feature_preset").alias("featurePresetKey"), c("feature_url").alias("featureUrl"), c("outline_color").alias("gplatesReferencePolygonColor"), c("outline_key").alias("gplatesReferencePolygonKey"), outline_url.alias("gplatesReferencePolygonUrl"),
        c("anchor_mode").alias("rotationAnchorMode"), c("anchor").alias("anchorPlateId"), c("rotation_preset").alias("rotationPresetKey"), c("rotation_urls").alias("rotUrls"), c("provider").alias("providerKey"), custom.alias("customProviderConfig"),
    )
    render = F.struct(c("level").alias("level"), c("render_intent").alias("polygonRenderIntent"), c("transform_mode").alias("primitiveTransformMode"), c("debug").alias("debugEnabled"))
    layers = F.struct(c("base_color").alias("backgroundColor"), (c("outline_key") != "off").alias("gplatesReferencePolygons"), F.lit(1).alias("opacity"))
    return F.to_json(
        F.struct(
            F.lit(1).alias("schemaVersion"), c("case_id").alias("caseId"), c("model_name").alias("modelName"), F.coalesce(F.get("rotation_urls", F.lit(0)), F.lit("")).alias("rotationFile"), c("rotation_urls").alias("rotationFiles"), c("feature_url").alias("platePolygonFile"),
            c("age").alias("timeMa"), c("view_mode").alias("viewMode"), projection.alias("projection"), F.coalesce(r((c("extent.west") + c("extent.east")) / 2), F.lit(0.0)).alias("centralMeridian"), extent.alias("extent"), camera.alias("camera3D"),
            F.when(c("output").isNotNull(), size).alias("output"), layers.alias("layers"), sources.alias("sources"), render.alias("render"),
        )
    )
