"""Areas: arrays of polygons, each a closed exterior ring and interior rings of points; conversions, coverage, masks and triangles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from chronoplate.functions import geometry as G
from chronoplate.operators.triangulate import triangles

AREA = "array<struct<exterior: array<struct<x: double, y: double>>, interiors: array<array<struct<x: double, y: double>>>>>"
#: Triangles whose areas differ from their polygon's by more than this share are flagged.
HIGH_DEVIATION = 0.01


def to_flat(ring: Column) -> Column:
    """Points to x0, y0, x1, y1, ..."""
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))


def polygon(exterior: Column, interiors: Column) -> Column:
    return F.struct(exterior.alias("exterior"), interiors.alias("interiors"))


def from_flat_ring(flat: Column) -> Column:
    """The area of one flat ring, closed."""
    return F.array(polygon(G.closed(G.from_flat(flat)), F.array().cast("array<array<struct<x: double, y: double>>>")))


def to_rings(area: Column) -> Column:
    """An area as arrays of rings, exterior first. Polygons with an invalid exterior and invalid interiors are left out."""
    good = F.filter(area, lambda g: G.valid(g["exterior"]))
    return F.transform(good, lambda g: F.concat(F.array(G.closed(g["exterior"])), F.transform(F.filter(F.coalesce(g["interiors"], F.array().cast("array<array<struct<x: double, y: double>>>")), G.valid), G.closed)))


def from_rings(polygons: Column) -> Column:
    """The way back: rings are closed, and those under four points left out; so is a polygon whose exterior is."""
    rings = F.transform(polygons, lambda rs: F.transform(rs, G.closed))
    full = F.filter(rings, lambda rs: F.size(F.get(rs, F.lit(0))) >= 4)
    return F.transform(full, lambda rs: polygon(F.get(rs, F.lit(0)), F.filter(F.slice(rs, F.lit(2), F.size(rs)), lambda r: F.size(r) >= 4)))


def cut(area: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """An area's intersection with a rectangle; rings without area are left out."""
    part = lambda r: G.closed(G.clip(G.opened(r), west, south, east, north))
    cut_ = F.transform(area, lambda g: polygon(part(g["exterior"]), F.filter(F.transform(g["interiors"], part), G.valid)))
    return F.filter(cut_, lambda g: G.valid(g["exterior"]))


def size(area: Column) -> Column:
    """Summed size of polygons that don't overlap, without their holes."""
    return F.aggregate(F.transform(area, lambda g: G.polygon_area(g["exterior"], g["interiors"])), F.lit(0.0), lambda a, b: a + b)


def covers_unit(area: Column) -> Column:
    """Whether nothing of the unit tile is left beside an area whose polygons don't overlap."""
    return size(cut(area, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))) >= 1 - G.EPSILON


def clip_mode(ring: Column) -> Column:
    """NONE, FULL or CLIP of an open ring of tile shares: one along the tile's boundary goes round it, or back the way it came; any other cuts it. Fewer than three points enclose nothing."""
    on_edge = lambda p: (((p["x"] == 0) | (p["x"] == 1)) & p["y"].between(0, 1)) | (((p["y"] == 0) | (p["y"] == 1)) & p["x"].between(0, 1))
    held = F.abs(G.signed_area(ring))
    return F.when(F.size(ring) < 3, "NONE").when(~F.forall(ring, on_edge), "CLIP").when(held <= G.EPSILON, "NONE").when(held >= 1 - G.EPSILON, "FULL").otherwise("CLIP")


def crossing_x(p: Column, q: Column, x: Column) -> Column:
    """Where the line through two points of different x meets a vertical line."""
    return G.point(x, p["y"] + (q["y"] - p["y"]) / (q["x"] - p["x"]) * (x - p["x"]))


def crossing_y(p: Column, q: Column, y: Column) -> Column:
    """Where the line through two points of different y meets a horizontal line."""
    return G.point(p["x"] + (q["x"] - p["x"]) / (q["y"] - p["y"]) * (y - p["y"]), y)


def prepared(ring: Column, exterior: bool) -> Column:
    """A ring for triangulation: repeated points and the repeated end go; exteriors run clockwise and interiors counter-clockwise. Null without three points, an area, or with a point that is no number."""
    finite = F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) != float("inf")) & (F.abs(p["y"]) != float("inf")))
    bare = G.opened(G.without_repeats(ring))
    return F.when(finite, G.let(bare, lambda r: F.when((F.size(r) >= 3) & (F.abs(G.signed_area(r)) >= 1e-12), G.oriented(r, exterior))))


@F.pandas_udf(StructType([StructField("flat", ArrayType(DoubleType())), StructField("unbridged", IntegerType())]))
def _triangles(exterior: pd.Series, holes: pd.Series) -> pd.DataFrame:
    as_points = lambda flat: [(float(x), float(y)) for x, y in np.asarray(flat, float).reshape(-1, 2)]
    found = [None if e is None else triangles(as_points(e), [as_points(h) for h in hs]) for e, hs in zip(exterior, holes, strict=True)]
    return pd.DataFrame({"flat": [None if f is None else [v for t in f[0] for p in t for v in p] for f in found], "unbridged": [0 if f is None else f[1] for f in found]})


def triangulated(areas: DataFrame, area: str = "area") -> DataFrame:
    """A row for each polygon of each row's area, with `interiors` (how many), `triangles`, `unbridged` (holes that no triangles go round, as no edge lies east of them), `deviation` of the triangles' areas from the polygon's, and `skipped` where the exterior holds nothing. A polygon is one call of a Python helper, in Arrow batches."""
    rows = areas.withColumn("g", F.explode(area)).drop(area)
    holes = F.filter(F.transform(F.coalesce("g.interiors", F.array().cast("array<array<struct<x: double, y: double>>>")), lambda r: prepared(r, False)), lambda r: r.isNotNull())
    rows = rows.withColumns({"_e": prepared(F.col("g.exterior"), True), "_h": holes, "interiors": F.coalesce(F.size("g.interiors"), F.lit(0))})
    rows = rows.withColumn("_made", _triangles(to_flat(F.col("_e")), F.transform("_h", to_flat))).withColumn("_t", F.col("_made.flat"))
    corner = lambda t, i: G.point(F.get("_t", 6 * t + 2 * i), F.get("_t", 6 * t + 2 * i + 1))
    count = F.coalesce((F.size("_t") / 6).cast("int"), F.lit(0))
    sizes = F.transform(F.sequence(F.lit(0), count - 1), lambda t: F.abs(G.signed_area(F.array(*(corner(t, i) for i in range(3))))))
    whole = G.polygon_area(F.col("_e"), F.col("_h"))
    total = F.aggregate(sizes, F.lit(0.0), lambda a, b: a + b)
    deviation = F.when((count > 0) & (whole > 0), F.abs(total - whole) / whole).otherwise(F.lit(0.0))
    return rows.withColumns({"triangles": count, "deviation": deviation, "skipped": F.col("_e").isNull(), "unbridged": F.col("_made.unbridged")}).drop("_e", "_h", "_t", "_made", "g")


def mask_report(areas: DataFrame, by: list[str], area: str = "area") -> DataFrame:
    """Polygons, interior rings, skipped polygons, triangles, largest deviation, polygons beyond HIGH_DEVIATION and unbridged holes, by group."""
    t = triangulated(areas.select(*by, F.col(area).alias("area")))
    return t.groupBy(*by).agg(F.count("*").alias("polygons"), F.sum("interiors").alias("interiors"), F.count_if("skipped").alias("skipped"), F.sum("triangles").alias("triangles"), F.max("deviation").alias("deviation"), F.count_if(F.col("deviation") > HIGH_DEVIATION).alias("high"), F.sum("unbridged").alias("unbridged"))


def root_level(effective: Column) -> Column:
    """The level that root tiles are taken at."""
    return F.greatest(effective, F.lit(3))
