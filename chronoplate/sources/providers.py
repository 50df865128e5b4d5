"""Imagery providers as a dimension table, and checks of URL templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (key, kind, least level, largest level or null, tiling scheme, address). A custom provider brings its own levels, scheme and address.
PROVIDERS = [
    ("gplates-topography-4326", "template", 0, 4, "geographic", "/tiles/Gplates_Topography/{z}/{x}/{y}.png"),
    ("gplates-topography-3857", "template", 0, 4, "web-mercator", "/tiles/Gplates_Topography_3857/{z}/{x}/{y}.png"),
    ("arcgis-world-imagery", "wmts", 0, 18, "web-mercator", "https://services.arcgisonline.com/arcgis/rest/services/World_Imagery/MapServer/WMTS"),
    ("gmrt-topography-wms-3857", "wms", 0, None, "web-mercator", "https://www.gmrt.org/services/mapserver/wms_merc"),
    ("nasa-gibs-blue-marble-3857", "wms", 0, 8, "web-mercator", "https://gibs.earthdata.nasa.gov/wms/epsg3857/best/"),
    ("nasa-gibs-blue-marble-4326", "wms", 0, 7, "geographic", "https://gibs.earthdata.nasa.gov/wms/epsg4326/best/"),
    ("eox-terrain-4326", "wmts", 0, 17, "geographic", "https://tiles.maps.eox.at/wmts/1.0.0/terrain/default/{TileMatrixSet}/{TileMatrix}/{TileRow}/{TileCol}.jpg"),
    ("eox-terrain-light-4326", "wmts", 0, 17, "geographic", "https://tiles.maps.eox.at/wmts/1.0.0/terrain-light/default/{TileMatrixSet}/{TileMatrix}/{TileRow}/{TileCol}.jpg"),
    ("eox-s2-cloudless-2025-4326", "wmts", 0, 13, "geographic", "https://tiles.maps.eox.at/wmts/1.0.0/s2cloudless-2025/default/{TileMatrixSet}/{TileMatrix}/{TileRow}/{TileCol}.jpg"),
    ("eox-s2-cloudless-2025-3857", "wmts", 0, 14, "web-mercator", "https://tiles.maps.eox.at/wmts/1.0.0/s2cloudless-2025_3857/default/{TileMatrixSet}/{TileMatrix}/{TileRow}/{TileCol}.jpg"),
    ("macrostrat-carto", "template", 0, 12, "web-mercator", "https://tiles.macrostrat.org/carto/{z}/{x}/{y}.png"),
    ("custom-url-template", "template", None, None, None, None),
]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "key STRING, kind STRING, min_level INT, max_level INT, scheme STRING, url STRING")


def template_errors(template: Column, low: Column, high: Column) -> Column:
    """Messages on what is wrong with a URL template and its levels; an empty array if nothing is."""
    found = F.array(
        F.when(F.coalesce(F.trim(template), F.lit("")) == "", "the template is empty"),
        F.when((F.trim(template) != "") & ~template.rlike(r"^(https?://|/|\./)"), "the template is no http address or path"),
        F.when((F.trim(template) != "") & ~(template.contains("{z}") & template.contains("{x}") & (template.contains("{y}") | template.contains("{reverseY}"))), "the template lacks a placeholder"),
        F.when((low < 0) | (high < low), "the levels are no range"),
    )
    return F.filter(found, lambda e: e.isNotNull())


def tile_url(template: Column, x: Column, y: Column, level: Column) -> Column:
    """The address of a tile; {reverseY} counts rows from the south."""
    reverse = (F.pow(F.lit(2.0), level) - 1 - y).cast("bigint")
    out = template
    for name, value in (("z", level), ("x", x), ("y", y), ("reverseY", reverse)):
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def wmts_url(template: Column, matrix_set: Column, x: Column, y: Column, level: Column) -> Column:
    """The address of a tile of a tile-matrix service."""
    out = template
    for name, value in (("TileMatrixSet", matrix_set), ("TileMatrix", level.cast("string")), ("TileRow", y.cast("string")), ("TileCol", x.cast("string"))):
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out
