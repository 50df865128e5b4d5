"""Preset sources as dimension tables, and which sources a configuration or a set of options means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys and files of features, rotations and reference outlines.
FEATURES = [
    ("seton-2012-static-polygons-gpmlz", "/features/Seton_etal_ESR2012_StaticPolygons.1.gpmlz"),
    ("earthbyte-static-polygons-gpmlz", "/features/Global_EarthByte_GPlates_PresentDay_StaticPlatePolygons.gpmlz"),
    ("merdith-2021-static-polygons-gpml", "/features/shapes_static_polygons_Merdith_etal.gpml"),
]
ROTATIONS = [
    ("seton-2012-rot", "/rotations/Seton_etal_ESR2012_2012.1.rot"),
    ("zahirovic-2022-optimised-mantle-rot", "/rotations/Zahirovic_etal_2022_OptimisedMantleRef_and_NNRMantleRef.rot"),
    ("merdith-2021-rot", "/rotations/1000_0_rotfile_Merdith_etal.rot"),
]
OUTLINES = [
    ("off", None),
    ("reconstructed-0", "/gplates_ref/geojson/reconstructed_0.00Ma.geojson"),
    ("reconstructed-35", "/gplates_ref/geojson/reconstructed_35.00Ma.geojson"),
    ("reconstructed-50", "/gplates_ref/geojson/reconstructed_50.00Ma.geojson"),
    ("reconstructed-120", "/gplates_ref/geojson/reconstructed_120.00Ma.geojson"),
    ("reconstructed-200", "/gplates_ref/geojson/reconstructed_200.00Ma.geojson"),
    ("reconstructed-400", "/gplates_ref/geojson/reconstructed_400.00Ma.geojson"),
    ("seton-2012-120", "/gplates_ref/geojson/Seton2012_120.00Ma.geojson"),
    ("zahirovic-2022-300", "/gplates_ref/geojson/Zahirovic2022_300.00Ma.geojson"),
    ("merdith-2021-750", "/gplates_ref/geojson/Merdith2021_750.00Ma.geojson"),
]
DEFAULTS = {"feature": "earthbyte-static-polygons-gpmlz", "rotation": "zahirovic-2022-optimised-mantle-rot", "outline": "off"}


def table(spark: SparkSession) -> DataFrame:
    """(kind, key, url, is_default) of all presets."""
    rows = [(kind, key, url, DEFAULTS[kind] == key) for kind, some in (("feature", FEATURES), ("rotation", ROTATIONS), ("outline", OUTLINES)) for key, url in some]
    return spark.createDataFrame(rows, "kind STRING, key STRING, url STRING, is_default BOOLEAN")


def with_preset(configs: DataFrame, presets: DataFrame, key: str = "preset_key", url: str = "preset_url") -> DataFrame:
    """Configurations with `found_key` and `found_url`: the preset of their key, else that of their url, else their own url as a custom source. Presets are a few rows, and broadcast."""
    by_key = F.broadcast(presets.select(F.col("key").alias("_k"), F.col("url").alias("_ku")))
    by_url = F.broadcast(presets.filter("url is not null").select(F.col("key").alias("_u"), F.col("url").alias("_uu")))
    both = configs.join(by_key, F.col(key) == F.col("_k"), "left").join(by_url, F.col(url) == F.col("_uu"), "left")
    return both.withColumns({"found_key": F.coalesce("_k", "_u", F.lit("custom")), "found_url": F.when(F.col("_k").isNotNull(), F.col("_ku")).otherwise(F.col(url))}).drop("_k", "_ku", "_u", "_uu")


def resolved(source: Column, source_url: Column, source_intent: Column, old_polygon: Column, old_intent: Column, rotations: Column, old_rotations: Column) -> Column:
    """struct<polygon, rotations, intent, error>: newer options go before older ones, a source may be an address or a struct of one; a missing source or an empty list of rotations is an error."""
    polygon = F.coalesce(F.nullif(F.coalesce(source, source_url, old_polygon), F.lit("")), F.lit(None).cast("string"))
    rots = F.coalesce(rotations, old_rotations)
    error = F.when(polygon.isNull(), "no feature source").when(rots.isNull() | (F.size(rots) == 0), "no rotation source")
    return F.struct(F.when(error.isNull(), polygon).alias("polygon"), F.when(error.isNull(), rots).alias("rotations"), F.when(error.isNull(), F.coalesce(source_intent, old_intent)).alias("intent"), error.alias("error"))


def asset_url(url: Column, base: str) -> Column:
    """Addresses of bundled files under a base; any other address stays as it is."""
    path = F.when(F.startswith(url, F.lit("./")), F.substr(url, F.lit(3))).otherwise(F.regexp_replace(url, "^/+", ""))
    # Folders of bundled files.
    return F.when(path.rlike("^(features|geo|gplates_ref|icons|rotations|tiles)/"), F.concat(F.lit(base), path)).otherwise(url)


def rotation_preset(urls: Column) -> Column:
    """The preset with just these files, else "custom"."""
    return F.coalesce(*(F.when(urls == F.array(F.lit(url)), F.lit(key)) for key, url in ROTATIONS), F.lit("custom"))


def scene_mode(code: Column) -> Column:
    """Name of a scene's mode by its number."""
    return F.when(code == 2, "SCENE2D").when(code == 3, "SCENE3D").when(code == 1, "COLUMBUS_VIEW").otherwise("MORPHING")


def view_mode(code: Column) -> Column:
    return F.when(code == 2, "2D_RECTANGULAR").otherwise("3D_GLOBE")


def scheme_key(scheme: Column, x: Column, y: Column, z: Column) -> Column:
    """A tiling scheme's key with its ellipsoid's radii."""
    return F.concat_ws(":", scheme, F.concat_ws(",", x, y, z))
