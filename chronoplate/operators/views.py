"""Views: the level of detail that fits a view, its raw tile count, its sphere, and the domains and tiles in it.

Views are DataFrames of (west, south, east, north, width, height, camera_height, ...), so that many are planned at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplate.functions import rotation as R
from chronoplate.functions import tiling as T

TARGET_PIXELS, MOST_RAW_TILES, MAX_LEVEL = 256.0, 128, 18
_EDGE = 1e-10


def span(west: Column, east: Column) -> Column:
    """Width in degrees; a view may cross the antimeridian."""
    return F.when(east < west, east - west + 360).otherwise(east - west)


def centre(west: Column, east: Column) -> Column:
    return F.degrees(R.wrap_longitude(F.radians(west + span(west, east) / 2)))


def level_bounds(least: Column, most: Column, provider_most: Column) -> Column:
    """struct<low, high>: integers, low not under 0 and high not under low."""
    low = F.greatest(F.lit(0), F.floor(F.coalesce(least, F.lit(0.0))).cast("int"))
    return F.struct(low.alias("low"), F.greatest(low, F.floor(F.coalesce(most, provider_most, F.lit(float(MAX_LEVEL)))).cast("int")).alias("high"))


def metres_per_pixel() -> Column:
    """Of a view, the larger of its two axes; by the camera's height where that is no positive number."""
    lat = (F.col("south") + F.col("north")) / 2
    w, h = F.greatest("width", F.lit(1.0)), F.greatest("height", F.lit(1.0))
    size = F.greatest(T.longitude_chord(lat, span(F.col("west"), F.col("east"))) / w, T.latitude_chord(F.col("south"), F.col("north")) / h)
    return F.when(size > 0, size).otherwise(F.greatest(F.lit(1.0), F.greatest("camera_height", F.lit(0.0)) / F.greatest(w, h)))


def tile_metres(level: Column, scheme: str) -> Column:
    """Longer side of the tile under the centre of a view."""
    _, south, _, north = T.limits(scheme)
    lat = F.least(F.greatest((F.col("south") + F.col("north")) / 2, F.lit(south + _EDGE)), F.lit(north - _EDGE))
    low, high = T.row_bounds(T.tile_y(lat, level, scheme), level, scheme)
    return F.greatest(T.longitude_chord((low + high) / 2, 360.0 / T.columns_at(level, scheme)), T.latitude_chord(low, high))


def raw_tiles(level: Column, scheme: str) -> Column:
    """Raw tiles that a view touches: one or two longitude segments times its rows."""
    west, south, east, north = T.limits(scheme)
    hold = lambda v, a, b: F.least(F.greatest(v, F.lit(a + _EDGE)), F.lit(b - _EDGE))
    nx, ny = T.columns_at(level, scheme), T.rows_at(level)
    top, bottom = hold(F.col("north"), south, north), hold(F.col("south"), south, north)
    rows = F.abs(T.tile_y(bottom, level, scheme) - T.tile_y(top, level, scheme)) + 1

    def columns(a: Column, b: Column) -> Column:
        left, right = hold(a + _EDGE, west, east), hold(b - _EDGE, west, east)
        return F.when(right < left, 0).otherwise(F.abs(T.tile_x(right, level, scheme) - T.tile_x(left, level, scheme)) + 1)

    whole = span(F.col("west"), F.col("east")) >= 360 - 1e-7
    parts = F.when(whole, columns(F.lit(west), F.lit(east))).when(F.col("west") <= F.col("east"), columns(F.col("west"), F.col("east"))).otherwise(columns(F.col("west"), F.lit(east)) + columns(F.lit(west), F.col("east")))
    width, height = F.least(span(F.col("west"), F.col("east")), F.lit(360.0)), F.least(F.col("north") - F.col("south"), F.lit(north - south))
    rough = F.greatest(F.lit(1), (F.ceil(width / (360.0 / nx)) * F.ceil(height / ((north - south) / ny))).cast("int"))
    found = F.when(parts * rows > 0, parts * rows).otherwise(rough)
    return F.when(top <= bottom, nx * ny).otherwise(F.least(nx * ny, found))


def choose_level(views: DataFrame, scheme: str = T.GEOGRAPHIC, target: float = TARGET_PIXELS, most_tiles: int = MOST_RAW_TILES, high: int = MAX_LEVEL) -> DataFrame:
    """Views with `level` and its `raw_tiles`: the level whose tile is nearest to `target` pixels (the lower of equals), then down until the view has `most_tiles` raw tiles at most. Levels are an array inside the row, not rows."""
    # One lambda over the levels, so that the plan doesn't grow with them.
    each = F.transform(F.sequence(F.lit(0), F.lit(high)), lambda i: F.struct(F.abs(F.log(tile_metres(i, scheme) / F.col("_mpp") / target)).alias("score"), i.alias("level"), raw_tiles(i, scheme).alias("raw")))
    scored = views.withColumn("_mpp", metres_per_pixel()).withColumn("_each", each).withColumn("_best", F.array_min(F.transform("_each", lambda x: F.struct(x["score"], x["level"])))["level"])
    fits = F.filter("_each", lambda x: (x["level"] <= F.col("_best")) & ((x["raw"] <= most_tiles) | (x["level"] == 0)))
    chosen = F.array_max(F.transform(fits, lambda x: F.struct(x["level"], x["raw"])))
    return scored.withColumn("_chosen", chosen).withColumns({"level": F.col("_chosen.level"), "raw_tiles": F.col("_chosen.raw")}).drop("_mpp", "_each", "_best", "_chosen")


def sphere(samples: int = 8) -> Column:
    """struct<x, y, z, r> about a rectangle: its centre, and the distance to the farthest of sampled edge points."""
    lon, lat = centre(F.col("west"), F.col("east")), (F.col("south") + F.col("north")) / 2
    c = R.position(lon, lat)
    width = span(F.col("west"), F.col("east"))
    points = [R.position(F.col("west") + width * i / samples, F.col(e)) for i in range(samples + 1) for e in ("south", "north")]
    points += [R.position(F.col(e), F.col("south") + (F.col("north") - F.col("south")) * i / samples) for i in range(1, samples) for e in ("west", "east")]
    # Lambdas over arrays: the centre and the points are computed once a row.
    about = lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"), F.array_max(F.transform(F.array(*points), lambda p: R.distance(c, p))).alias("r"))
    return F.get(F.transform(F.array(c), about), F.lit(0))


def touches(a: Column, b: Column) -> Column:
    """Whether two spheres meet; touching counts."""
    return R.distance(a, b) <= a["r"] + b["r"]


#: Edge of the smallest cells in metres, and how many times it is doubled at most: the largest cells hold any sphere that fits the globe.
CELL, LEVELS = R.EARTH / 8, 5


def _level(radius: Column) -> Column:
    """The level of cells whose edge is the radius or more."""
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(radius, F.lit(CELL)) / CELL)).cast("int")))


def _cells_in_reach(sphere: Column, levels: Column) -> Column:
    """array<struct<level, cx, cy, cz>>: for each level the cells with a point within the sphere's radius and the level's edge of its centre."""

    def at(level: Column) -> Column:
        edge = F.lit(CELL) * F.pow(F.lit(2.0), level)
        reach = sphere["r"] + edge
        span = lambda c: F.sequence(F.floor((sphere[c] - reach) / edge), F.floor((sphere[c] + reach) / edge))
        off = lambda i, c: F.greatest(i * edge - sphere[c], sphere[c] - (i + 1) * edge, F.lit(0.0))
        cell = lambda x, y, z: F.struct(level.alias("level"), x.alias("cx"), y.alias("cy"), z.alias("cz"))
        every = F.flatten(F.transform(span("x"), lambda x: F.flatten(F.transform(span("y"), lambda y: F.transform(span("z"), lambda z: cell(x, y, z))))))
        near = lambda c: F.pow(off(c["cx"], "x"), 2) + F.pow(off(c["cy"], "y"), 2) + F.pow(off(c["cz"], "z"), 2) <= reach * reach * (1 + 1e-9)
        return F.filter(every, near)

    return F.flatten(F.transform(levels, at))


def in_view(items: DataFrame, views: DataFrame, rotations: DataFrame) -> DataFrame:
    """Items (plate_id, sphere at the present) that meet a view's sphere at its age: (view_id, items' columns).

    The view is turned back to the present once for each plate. Space is cut into cells, larger ones for larger items: an item lies in
    the cell of its centre at the level of its radius, and a view goes to the cells in its reach, so that items meet a view by
    (plate, level, cell) and not by plate alone. Items larger than the largest cells, and what has no sphere, aren't seen."""
    q = rotations.select("plate_id", F.col("age").alias("_age"), "q")
    seen = views.join(q, views["age"] == q["_age"]).select("view_id", "plate_id", R.apply(R.transpose(R.matrix(F.coalesce("q", R.identity()))), F.col("sphere")).alias("_c"), F.col("sphere.r").alias("_r"))
    seen = seen.select("view_id", "plate_id", F.struct(F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), F.col("_c.z").alias("z"), F.col("_r").alias("r")).alias("_s"))
    keys = ["_level", "_cx", "_cy", "_cz"]
    level = _level(F.col("sphere.r"))
    edge = F.lit(CELL) * F.pow(F.lit(2.0), level)
    placed = items.withColumns({"_level": level, **{f"_c{c}": F.floor(F.col(f"sphere.{c}") / edge) for c in "xyz"}})
    # Which levels a plate's items have is a few rows a plate.
    levels = placed.groupBy("plate_id").agg(F.collect_set("_level").alias("_levels"))
    cells = seen.join(levels, "plate_id").select("view_id", "plate_id", "_s", F.inline(_cells_in_reach(F.col("_s"), F.col("_levels")))).withColumnsRenamed({"level": "_level", "cx": "_cx", "cy": "_cy", "cz": "_cz"})
    return placed.join(cells, ["plate_id", *keys]).filter(touches(F.col("sphere"), F.col("_s"))).select("view_id", *items.columns)
