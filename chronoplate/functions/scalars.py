"""Small scalar rules: number and time parsing, rounding, names of exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoplate.operators.domains import DISTANT_FUTURE, DISTANT_PAST


def first_number(text: Column) -> Column:
    """The first number in a text, or null."""
    return F.nullif(F.regexp_extract(text, r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0), F.lit("")).try_cast("double")


def geo_time(text: Column) -> Column:
    """An age in Ma; the words for the distant past and future are ages too."""
    return F.when(text.contains("distantPast"), DISTANT_PAST).when(text.contains("distantFuture"), DISTANT_FUTURE).otherwise(first_number(text))


def local_name(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


def attribute(attributes: Column, *keys: str) -> Column:
    """The first of several keys in a map, whatever their case; of keys that differ in case only, the first entry's."""
    named = lambda k: F.get(F.filter(F.map_entries(attributes), lambda e: F.upper(e["key"]) == k.upper()), F.lit(0))["value"]
    return F.coalesce(*map(named, keys))


def last_by_key(keys: Column, values: Column) -> Column:
    """A map of two arrays of one length; of equal keys the last holds."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(kept)


def round_half_up(value: Column, digits: int = 6) -> Column:
    """Halves go up, also below zero."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def is_power_of_two(value: Column) -> Column:
    return (value > 0) & (value.bitwiseAND(value - 1) == 0)


def numbers(text: Column) -> Column:
    """White-space separated numbers; what isn't one is dropped."""
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def is_lat_lon(values: Column, dimension: Column) -> Column:
    """Whether pairs are latitude first: each pair scores for the orders it allows, twice where an axis is beyond 90 degrees; a tie is latitude first."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(values) - 2, F.lit(0)), dimension), lambda i: i + 1 < F.size(values))

    def score(big, small) -> Column:
        return F.aggregate(starts, F.lit(0), lambda a, i: a + F.when((F.abs(F.get(values, i + small)) <= 90) & (F.abs(F.get(values, i + big)) <= 180), F.when(F.abs(F.get(values, i + big)) > 90, 2).otherwise(1)).otherwise(0))

    return score(0, 1) <= score(1, 0)


def positions(values: Column, dimension: Column, lat_lon: Column) -> Column:
    """Points (x longitude, y latitude) of a list of numbers."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(values) - 2, F.lit(0)), dimension), lambda i: i + 1 < F.size(values))
    a, b = (lambda i: F.get(values, i)), (lambda i: F.get(values, i + 1))
    return F.transform(starts, lambda i: F.struct(F.when(lat_lon, b(i)).otherwise(a(i)).alias("x"), F.when(lat_lon, a(i)).otherwise(b(i)).alias("y")))


def export_name(title: Column, age: Column, stamp: Column) -> Column:
    """`title_<age>Ma_<stamp>`: other characters become one underscore, the age's point a p, the stamp is compact."""
    clean = F.regexp_replace(title, r"[^a-zA-Z0-9._-]+", "_")
    plain = F.regexp_replace(age.cast("string"), r"\.0$", "")
    return F.concat(clean, F.lit("_"), F.replace(plain, F.lit("."), F.lit("p")), F.lit("Ma_"), F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'"))


def infer_intent(url: Column) -> Column:
    """Polygon files of static plates are areas; other names say nothing."""
    return F.when(F.lower(F.url_decode(url)).rlike("static[_ -]?(polygons|plate)"), "area")


def gpu_instance(name: Column) -> Column:
    """struct<pid, engine, adapter> of a counter's instance name; null without a pid."""
    pick = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    pid = pick(r"pid_(\d+)").cast("bigint")
    return F.when(pid.isNotNull(), F.struct(pid.alias("pid"), pick("engtype_([^_]+)").alias("engine"), F.coalesce(pick("luid_([^_]+_[^_]+)"), F.lit("unknown")).alias("adapter")))
