"""Plate domains: import filters, unique ids, classification, visibility and diagnostics of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ages of features without a valid time.
DISTANT_PAST, DISTANT_FUTURE = 999999.0, -999.0

#: Feature types that are filled, and that are drawn as lines.
AREA_TYPES = ["Basin", "ClosedContinentalBoundary", "ContinentalFragment", "Craton", "IslandArc"]
LINE_TYPES = ["Coastline", "TerraneBoundary", "InferredPaleoBoundary", "PassiveContinentalBoundary"]
AREA, LINE, UNKNOWN = "area", "line-like", "unknown"


def visible(age: Column, begin: str = "begin_age", end: str = "end_age") -> Column:
    """Valid at an age, both ends included."""
    return age.between(F.col(end), F.col(begin))


def importable(features: DataFrame) -> DataFrame:
    """Features with a plate id and at least one polygon; missing ages become the distant past and future."""
    kept = features.filter("plate_id is not null and polygon_count > 0")
    return kept.withColumns({"begin_age": F.coalesce("begin_age", F.lit(DISTANT_PAST)), "end_age": F.coalesce("end_age", F.lit(DISTANT_FUTURE))})


def with_unique_ids(features: DataFrame) -> DataFrame:
    """Ids that several features share get `:member:<member_index>`. Counted by an aggregation, as one id may be very frequent."""
    shared = features.groupBy("feature_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("feature_id", F.lit(True).alias("_shared"))
    marked = features.join(shared, "feature_id", "left")
    return marked.withColumn("unique_id", F.when(F.col("_shared"), F.concat_ws(":member:", "feature_id", F.col("member_index").cast("string"))).otherwise(F.col("feature_id"))).drop("_shared")


def duplicate_ids(features: DataFrame) -> DataFrame:
    """One row: ids that occur more than once, and the rows beyond their first."""
    counts = features.groupBy("feature_id").agg(F.count("*").alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def intent(property_name: Column, feature_type: Column, attribute_type: Column, polygons: Column, all_areas: bool = False) -> Column:
    """How a feature is drawn: a centre line first, then by its type (the attribute wins over the element), then an area if it has polygons. `all_areas` fills whatever has polygons."""
    kind = F.substring_index(F.coalesce(F.nullif(attribute_type, F.lit("")), feature_type), ":", -1)
    found = (
        F.when(property_name == "centerLineOf", LINE)
        .when(kind.isin(AREA_TYPES), AREA)
        .when(kind.isin(LINE_TYPES) | kind.contains("Boundary") | kind.contains("Coastline"), LINE)
        .when(polygons > 0, AREA)
        .otherwise(UNKNOWN)
    )
    return F.when(polygons > 0, AREA).otherwise(found) if all_areas else found


def import_diagnostics(features: DataFrame) -> DataFrame:
    """One row of counters over features (plate_id, intent, polygon_count, feature_id, begin_age, feature_type), with the skipped types as a sorted array of (type, n)."""
    ok = (F.col("plate_id").isNotNull() & (F.col("polygon_count") > 0)).alias("ok")
    counts = features.agg(
        F.count("*").alias("parsed"),
        F.count_if(F.col("plate_id").isNull()).alias("without_plate"),
        F.count_if(F.col("polygon_count") == 0).alias("without_polygons"),
        F.count_if(ok).alias("imported"),
        F.count_if(ok & (F.col("intent") == AREA)).alias("areas"),
        F.count_if(ok & (F.col("intent") == LINE)).alias("lines"),
        F.count_if(F.col("begin_age").isNull()).alias("without_begin"),
        F.coalesce(F.sum(F.when(ok, F.col("polygon_count"))), F.lit(0)).alias("polygons"),
        F.count_distinct(F.when(ok, F.col("feature_id"))).alias("distinct_ids"),
        F.count_distinct(F.when(ok, F.col("plate_id"))).alias("plates"),
    )
    skipped = features.filter(~(F.col("plate_id").isNotNull() & (F.col("polygon_count") > 0))).groupBy("feature_type").agg(F.count("*").alias("n"))
    return counts.crossJoin(skipped.agg(F.array_sort(F.collect_list(F.struct("feature_type", "n"))).alias("skipped")))  # one row each


def first_by_id(features: DataFrame) -> DataFrame:
    """The first member of each (plate, feature id), by partial aggregation: one id may be very frequent."""
    first = F.min_by(F.struct(*features.columns), "member_index").alias("_first")
    return features.groupBy(F.col("plate_id").alias("_p"), F.col("feature_id").alias("_f")).agg(first).select("_first.*")


def draw_order(plates: DataFrame, plate: str = "plate_id") -> DataFrame:
    """Adds `draw_order`: numeric ids by value, then the others by text. Ranks distinct ids, which are few."""
    number = F.when(F.col(plate).rlike(r"^[+-]?\d+(\.\d+)?$"), F.col(plate).try_cast("double"))
    ranked = plates.select(plate).distinct().withColumn("_n", number).withColumn("draw_order", F.row_number().over(Window.orderBy(F.col("_n").isNull(), "_n", plate)))
    return plates.join(ranked.drop("_n"), plate)
