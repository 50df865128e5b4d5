"""Pixels of tiles: masks by polygons, and rows resampled from Web Mercator to geographic tiles.

Pixels are rows of small integers under a tile's (x, y, l), which the joins go by; masks are ranges of pixels, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplate.functions import geometry as G


def pixels(tiles: DataFrame, size: int) -> DataFrame:
    """A row for each pixel (px to the east, py to the south) of each tile, with its centre (u, v) in the tile, v to the north."""
    rows = tiles.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return rows.withColumns({"u": (F.col("px") + 0.5) / size, "v": 1 - (F.col("py") + 0.5) / size})


def mask_spans(tiles: DataFrame, size: int, clips: str = "clips") -> DataFrame:
    """(tile's other columns, py, first, last): ranges of pixels, apart from each other, whose centres lie inside any of the rings in `clips` by the even-odd rule. No clips means the whole tile; rings under three points hold nothing, null clips neither.

    Scan lines: each edge goes to the rows of pixels that it crosses; in a row, a ring's crossings in order bound its spans, and
    overlapping spans of rings become one. Work is that of edges and rows, not of pixels, and a row is all that a task needs together."""
    keys = [c for c in tiles.columns if c != clips]
    all_rows = F.sequence(F.lit(0), F.lit(size - 1))
    whole = tiles.filter(F.size(clips) == 0).select(*keys, F.explode(all_rows).alias("py"), F.lit(0).alias("first"), F.lit(size - 1).alias("last"))
    ring = tiles.select(*keys, F.posexplode(clips).alias("_n", "_ring")).filter(F.size("_ring") >= 3)
    edges = F.transform("_ring", lambda p, i: G.let(F.get("_ring", (i + 1) % F.size("_ring")), lambda q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))))
    edge = ring.select(*keys, "_n", F.inline(edges)).filter("y0 <> y1")
    # A row's centre is 1 - (py + 1/2) / size; one more on either side, then the exact test.
    row = lambda y: size * (1 - y) - 0.5
    north = F.greatest(F.lit(0.0), F.floor(row(F.greatest("y0", "y1"))))
    south = F.least(F.lit(size - 1.0), F.ceil(row(F.least("y0", "y1"))))
    met = edge.filter(south >= north).withColumn("py", F.explode(F.sequence(north.cast("int"), south.cast("int")))).withColumn("_v", 1 - (F.col("py") + 0.5) / size)
    met = met.filter((F.col("y0") > F.col("_v")) != (F.col("y1") > F.col("_v"))).withColumn("_x", (F.col("x1") - F.col("x0")) * (F.col("_v") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    east = Window.partitionBy(*keys, "_n", "py").orderBy("_x")
    pairs = met.select(*keys, "_n", "py", "_x", F.lead("_x").over(east).alias("_to"), F.row_number().over(east).alias("_i")).filter("_i % 2 = 1")

    def at_or_after(x: Column) -> Column:
        """The first pixel whose centre (px + 1/2) / size is x or more, up to size."""
        near = F.greatest(F.lit(0), F.least(F.lit(size), F.ceil(x * size - 0.5).cast("int")))
        centre = lambda px: (px + 0.5) / size
        return F.when((near > 0) & (centre(near - 1) >= x), near - 1).when((near < size) & (centre(near) < x), near + 1).otherwise(near)

    spans = pairs.select(*keys, "py", at_or_after(F.col("_x")).alias("first"), (at_or_after(F.col("_to")) - 1).alias("last")).filter("first <= last")
    order = Window.partitionBy(*keys, "py").orderBy("first", "last")
    fresh = F.coalesce(F.col("first") > F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    joined = spans.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*keys, "py", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run").unionByName(whole)


def masked(tiles: DataFrame, size: int, clips: str = "clips") -> DataFrame:
    """The pixels (px, py) of mask_spans(), a row each."""
    return mask_spans(tiles, size, clips).withColumn("px", F.explode(F.sequence("first", "last"))).drop("first", "last")


def mercator_row(v: Column, south: Column, north: Column) -> Column:
    """Where a geographic share v (0 in the south) of a tile lies in the tile's Web Mercator image."""
    y = lambda lat: F.log((1 + F.sin(F.radians(lat))) / (1 - F.sin(F.radians(lat)))) / 2
    return (y(south + v * (north - south)) - y(south)) / (y(north) - y(south))


def reproject(pixels: DataFrame, source: DataFrame, size: int, mercator: bool) -> DataFrame:
    """Geographic pixels (with south, north of their tile) and the values of the nearest source pixel of the same tile."""
    v = mercator_row(F.col("v"), F.col("south"), F.col("north")) if mercator else F.col("v")
    row = F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((1 - v) * size).cast("int")))
    picked = source.withColumnsRenamed({"px": "_sx", "py": "_sy"})
    at = pixels.withColumns({"_sx": F.col("px"), "_sy": row})
    return at.join(picked, ["x", "y", "l", "_sx", "_sy"], "left").withColumnRenamed("_sy", "source_row").drop("_sx")


def _lerp(values: Column, at: Column) -> Column:
    """A value between two of an array: `at` counts from its first one, and what lies beyond the ends is the end's."""
    near = F.greatest(F.lit(0.0), F.least(F.size(values) - F.lit(1.0), at))
    low = F.floor(near).cast("int")
    return F.get(values, low) * (1 - (near - low)) + F.get(values, F.least(F.size(values) - 1, low + 1)) * (near - low)


def reproject_linear(tiles: DataFrame, source: DataFrame, size: int, source_size: int, mercator: bool, value: str = "value") -> DataFrame:
    """(x, y, l, px, py, value): pixels of geographic tiles (x, y, l, south, north), each the mean of the four source pixels around its place, weighted by nearness.

    source: (x, y, l, px, py, value) of the same tiles, `source_size` pixels a side; the edge goes on beyond it. A source tile's rows
    are packed to arrays first, so that a row of pixels meets the two rows around it, and not each pixel four others. Missing rows give nulls; pixels of a source row that is short lie at its start."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("px", F.col(value).cast("double").alias("v")))), lambda p: p["v"])
    lines = source.groupBy("x", "y", "l", F.col("py").alias("_row")).agg(line.alias("_line"))
    v = 1 - (F.col("py") + 0.5) / size
    share = mercator_row(v, F.col("south"), F.col("north")) if mercator else v
    at = F.greatest(F.lit(0.0), F.least(F.lit(source_size - 1.0), (1 - share) * source_size - 0.5))
    rows = tiles.select("x", "y", "l", "south", "north", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("py")).withColumn("_at", at)
    rows = rows.withColumns({"_r0": F.floor("_at").cast("int"), "_r1": F.least(F.lit(source_size - 1), F.floor("_at").cast("int") + 1)})
    for n in "01":
        rows = rows.join(lines.withColumnsRenamed({"_row": f"_r{n}", "_line": f"_l{n}"}), ["x", "y", "l", f"_r{n}"], "left")
    weight = F.col("_at") - F.floor("_at")
    both = F.zip_with("_l0", "_l1", lambda a, b: a * (1 - weight) + b * weight)
    column = lambda line, px: _lerp(line, (px + 0.5) / size * source_size - 0.5)
    values = G.let(both, lambda line: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda px: column(line, px)))
    return rows.select("x", "y", "l", "py", F.posexplode(values).alias("px", value)).select("x", "y", "l", "px", "py", value)


def mask_statistics(masks: DataFrame, by: list[str], rings: str = "clips") -> DataFrame:
    """Polygons, points, triangles (points - 2 of each ring) and rings that are too small, by group."""
    ring = masks.select(*by, F.explode_outer(rings).alias("r")).select(*by, F.size(G.opened(G.without_repeats(F.col("r")))).alias("n"))
    ok = F.col("n") >= 3
    return ring.groupBy(*by).agg(F.count_if(ok).alias("polygons"), F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("points"), F.coalesce(F.sum(F.when(ok, F.col("n") - 2)), F.lit(0)).alias("triangles"), F.count_if(F.col("n") < 3).alias("skipped"))
