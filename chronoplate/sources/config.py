"""Experiment configurations: tolerant import of JSON, checks, and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplate.functions.scalars import round_half_up

#: What enumerations of a configuration allow.
VIEW_MODES = ["3D", "2D", "2.5D"]
DEFAULT = {"level": 4, "time_ma": 0.0, "view_mode": "3D", "provider": "local-topography"}


def imported(rows: DataFrame, text: str = "config") -> DataFrame:
    """Typed fields of JSON configurations: a field of another type, or beyond its enumeration, takes its default; the anchor keeps an explicit null; older names are read where the new one is missing. `is_config` is false for what is no object."""
    v = F.try_parse_json(F.col(text))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
    is_text = lambda path: F.coalesce(F.schema_of_variant(get(path, "variant")), F.lit("")) == "STRING"
    is_number = lambda path: F.coalesce(F.schema_of_variant(get(path, "variant")), F.lit("")).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")
    text_at = lambda path: F.when(is_text(path), get(path, "string"))
    number_at = lambda path: F.when(is_number(path), get(path, "double"))
    mode = text_at("$.viewMode")
    anchor_given = F.coalesce(F.schema_of_variant(get("$.anchorPlateId", "variant")), F.lit(""))
    return rows.select(
        *[c for c in rows.columns if c != text],
        kind.startswith("OBJECT").alias("is_config"),
        F.coalesce(number_at("$.timeMa"), number_at("$.age"), F.lit(DEFAULT["time_ma"])).alias("time_ma"),
        F.coalesce(F.round(number_at("$.level")).cast("int"), F.lit(DEFAULT["level"])).alias("level"),
        F.when(mode.isin(VIEW_MODES), mode).otherwise(DEFAULT["view_mode"]).alias("view_mode"),
        F.coalesce(text_at("$.provider"), text_at("$.providerKey"), F.lit(DEFAULT["provider"])).alias("provider"),
        F.when(anchor_given == "VOID", F.lit(None)).otherwise(F.coalesce(text_at("$.anchorPlateId"), F.lit("0"))).alias("anchor"),
        F.filter(F.coalesce(get("$.rotationFiles", "array<string>"), F.array(text_at("$.rotationFile"))), lambda f: f.isNotNull() & (F.trim(f) != "")).alias("rotation_files"),
    )


def extent_errors(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Messages on a view's extent; an empty array if nothing is wrong."""
    bad = lambda v: v.isNull() | F.isnan(v)
    found = F.array(
        F.when(bad(west) | bad(south) | bad(east) | bad(north), "a bound is no number"),
        F.when((F.abs(west) > 180) | (F.abs(east) > 180), "a longitude is out of range"),
        F.when((F.abs(south) > 90) | (F.abs(north) > 90), "a latitude is out of range"),
        F.when(south >= north, "south is not below north"),
        F.when(west == east, "the extent has no width"),
    )
    return F.filter(found, lambda e: e.isNotNull())


def projection(view_mode: Column, scheme: Column) -> Column:
    return F.when(view_mode == "3D", "perspective-globe").when(scheme == "web-mercator", "web-mercator").otherwise("geographic")


def export_json(rows: DataFrame) -> Column:
    """One configuration as JSON, numbers rounded half up to six digits; a column over (case_id, time_ma, west, south, east, north, rotation_files)."""
    r = round_half_up
    extent = F.struct(*(r(F.col(c)).alias(c) for c in ("west", "south", "east", "north")))
    return F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col("case_id").alias("caseId"), r(F.col("time_ma")).alias("timeMa"), F.col("rotation_files").alias("rotationFiles"), extent.alias("extent")))
