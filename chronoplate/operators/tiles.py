"""Tiles of plate domains, composite tasks of tiles, and their counts.

A domain covers a range of tile columns and rows that follows from its bounds, so overlap with the grid is an explode of
two sequences: no spatial join and no shuffle. The only shuffle of a plan is the grouping to composite tasks, with partial
aggregation before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplate.functions import tiling as T
from chronoplate.operators.domains import visible

#: A tile counts as covered within this share of its area.
EPSILON = 1e-9
TILE = ["plate_id", "begin_age", "end_age", "x", "y", "l"]


def tiles_of_rectangles(domains: DataFrame, level: int, scheme: str = T.GEOGRAPHIC) -> DataFrame:
    """A row for each domain (west, south, east, north) and tile with an overlap of some area: x, y, l, `clip` in tile shares (u to the east, v to the north; null where the tile is full) and `status`."""
    lev = F.lit(level)
    edge = 1e-9
    _, low, _, high = T.limits(scheme)
    south, north = F.greatest("south", F.lit(low)), F.least("north", F.lit(high))
    ranged = domains.filter((F.col("east") > F.col("west")) & (north > south)).withColumns({"_s": south, "_n": north})
    xs = F.sequence(T.tile_x(F.col("west") + edge, lev, scheme), T.tile_x(F.col("east") - edge, lev, scheme))
    ys = F.sequence(T.tile_y(F.col("_n") - edge, lev, scheme), T.tile_y(F.col("_s") + edge, lev, scheme))
    tiles = ranged.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys)).withColumn("l", lev).withColumn("_r", T.rectangle(F.col("x"), F.col("y"), F.col("l"), scheme))
    share = lambda v, a, b: (v - a) / (b - a)
    clip = F.struct(
        share(F.greatest("west", F.col("_r.west")), F.col("_r.west"), F.col("_r.east")).alias("u0"),
        share(F.greatest("_s", F.col("_r.south")), F.col("_r.south"), F.col("_r.north")).alias("v0"),
        share(F.least("east", F.col("_r.east")), F.col("_r.west"), F.col("_r.east")).alias("u1"),
        share(F.least("_n", F.col("_r.north")), F.col("_r.south"), F.col("_r.north")).alias("v1"),
    )
    tiles = tiles.withColumn("_c", clip)
    full = (F.col("_c.u0") <= EPSILON) & (F.col("_c.v0") <= EPSILON) & (F.col("_c.u1") >= 1 - EPSILON) & (F.col("_c.v1") >= 1 - EPSILON)
    return tiles.withColumns({"clip": F.when(~full, F.col("_c")), "status": F.when(full, "FULL").otherwise("CLIP")}).drop("_s", "_n", "_r", "_c")


def composites(tiles: DataFrame) -> DataFrame:
    """Tasks: tiles of the same plate, validity and place merged. `covers_full` if any part is a whole tile; `clips` and `feature_ids` sorted."""
    return tiles.groupBy(*TILE).agg(
        F.bool_or(F.col("clip").isNull()).alias("covers_full"),
        F.array_sort(F.collect_list("clip")).alias("clips"),
        F.array_sort(F.collect_set("feature_id")).alias("feature_ids"),
        F.count("*").alias("sources"),
    )


def raw_tile_count(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.count_distinct("x", "y", "l").alias("raw_tiles"))


def task_statistics(tasks: DataFrame) -> DataFrame:
    """One row of sums, maxima and means over composite tasks."""
    features, clips = F.size("feature_ids"), F.size("clips")
    return tasks.agg(
        F.count("*").alias("tasks"),
        F.sum("sources").alias("sources"),
        F.count_if("covers_full").alias("full_tasks"),
        F.count_if(features > 1).alias("merged_tasks"),
        F.max(features).alias("max_features"),
        F.avg(features).alias("mean_features"),
        F.sum(clips).cast("bigint").alias("clip_parts"),
        F.max(clips).alias("max_clips"),
        F.avg(clips).alias("mean_clips"),
        F.count_distinct("x", "y", "l").alias("raw_tiles"),
    )


def phases(tasks: DataFrame, age: float) -> DataFrame:
    """Tasks with their phase: those visible at the age come first (0), the others are prepared after (1)."""
    return tasks.withColumn("phase", F.when(visible(F.lit(age)), 0).otherwise(1))


def visibility_counts(tasks: DataFrame, ages: list[float]) -> DataFrame:
    """(age, visible, hidden) in one pass over the tasks, whatever the number of ages."""
    counted = tasks.agg(*(F.count_if(visible(F.lit(float(a)))).alias(f"a{i}") for i, a in enumerate(ages)), F.count("*").alias("n"))
    rows = F.array(*(F.struct(F.lit(float(a)).alias("age"), F.col(f"a{i}").alias("visible"), (F.col("n") - F.col(f"a{i}")).alias("hidden")) for i, a in enumerate(ages)))
    return counted.select(F.inline(rows))


def not_loaded(tasks: DataFrame, loaded: DataFrame) -> DataFrame:
    """Tasks whose place isn't loaded or pending."""
    return tasks.join(loaded.select(*TILE), TILE, "left_anti")


def with_images(tasks: DataFrame, images: DataFrame) -> DataFrame:
    """Tasks with their raw tile's image columns. Each raw tile is read once: tasks and images meet by (x, y, l)."""
    return tasks.join(images, ["x", "y", "l"], "left")


def with_matrices(tasks: DataFrame, matrices: DataFrame) -> DataFrame:
    """Tasks with their plate's matrix `m`, the identity if the plate is unknown."""
    from chronoplate.functions.rotation import identity, matrix

    return tasks.join(matrices.select("plate_id", "m"), "plate_id", "left").withColumn("m", F.coalesce("m", matrix(identity())))


def subdivide(rectangles: DataFrame, most: float) -> DataFrame:
    """Parts of rectangles (west, south, east, north) of at most `most` degrees a side: row, col, bounds and texture shares u0..v1. `most` must be positive."""
    if most <= 0:
        raise ValueError("the largest span must be positive")
    parts = lambda span: F.greatest(F.lit(1), F.ceil(span / most - 1e-12).cast("int"))
    cut = rectangles.withColumns({"cols": parts(F.col("east") - F.col("west")), "rows": parts(F.col("north") - F.col("south"))})
    cut = cut.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    at = lambda a, b, i, n: F.col(a) + (F.col(b) - F.col(a)) * i / F.col(n)
    return cut.select(
        *[c for c in rectangles.columns if c not in ("west", "south", "east", "north")],
        "row",
        "col",
        at("west", "east", F.col("col"), "cols").alias("west"),
        at("south", "north", F.col("row"), "rows").alias("south"),
        at("west", "east", F.col("col") + 1, "cols").alias("east"),
        at("south", "north", F.col("row") + 1, "rows").alias("north"),
        (F.col("col") / F.col("cols")).alias("u0"),
        (F.col("row") / F.col("rows")).alias("v0"),
        ((F.col("col") + 1) / F.col("cols")).alias("u1"),
        ((F.col("row") + 1) / F.col("rows")).alias("v1"),
    )


def remap(u: Column, low: Column, high: Column) -> Column:
    """A texture coordinate of a part in the whole tile."""
    return low + u * (high - low)


def descend(tiles: DataFrame, levels: int) -> DataFrame:
    """Children of full tiles, `levels` further down: they are full too, so that they follow by arithmetic."""
    n = 1 << levels
    down = tiles.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return down.withColumns({"x": F.col("x") * n + F.col("_i"), "y": F.col("y") * n + F.col("_j"), "l": F.col("l") + levels}).drop("_i", "_j")


def grid(spark, level: int, scheme: str = T.GEOGRAPHIC) -> DataFrame:
    """All tiles (x, y, l) of a level."""
    nx, ny = (2 if scheme == T.GEOGRAPHIC else 1) << level, 1 << level
    return spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("x"), F.floor(F.col("id") / nx).cast("int").alias("y"), F.lit(level).alias("l"))


def tiles_of_rings(domains: DataFrame, level: int, scheme: str = T.GEOGRAPHIC) -> DataFrame:
    """A row for each domain (`ring` in degrees) and tile of a level that its ring meets: x, y, l, `clip` (open ring of tile shares, null where the tile is full) and `status`.

    Tiles follow level by level: the roots are cut, and only children of tiles that are cut are cut again; a full tile's
    descendants are full and follow by arithmetic at the end. Rings are not wrapped at the antimeridian."""
    from chronoplate.functions import geometry as G

    def cut(rows: DataFrame) -> DataFrame:
        rect = T.rectangle(F.col("x"), F.col("y"), F.col("l"), scheme)
        # A generator is where the planner stops to merge expressions: a ring is cut once for its filter, status and value.
        found = F.transform(F.array(G.to_tile_clip(F.col("ring"), rect)), lambda c: F.struct(c.alias("clip"), F.when(F.abs(G.signed_area(c)) >= 1 - EPSILON, "FULL").otherwise("CLIP").alias("status")))
        return rows.select("*", F.inline(F.filter(found, lambda f: F.size(f["clip"]) > 0)))

    roots = F.array(*(F.struct(F.lit(i).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("l")) for i in range(2 if scheme == T.GEOGRAPHIC else 1)))
    at = cut(domains.select("*", F.inline(roots)))
    full = at.filter("status = 'FULL'")
    part = at.filter("status = 'CLIP'")
    out = descend(full, level) if level else full
    for down in range(1, level + 1):
        four = F.array(*(F.struct((F.col("x") * 2 + i).alias("_x"), (F.col("y") * 2 + j).alias("_y")) for i in (0, 1) for j in (0, 1)))
        children = part.drop("clip", "status").select("*", F.inline(four)).withColumns({"x": F.col("_x"), "y": F.col("_y"), "l": F.col("l") + 1}).drop("_x", "_y")
        at = cut(children)
        full, part = at.filter("status = 'FULL'"), at.filter("status = 'CLIP'")
        out = out.unionByName(descend(full, level - down) if level > down else full)
    return out.withColumn("clip", F.lit(None).cast(part.schema["clip"].dataType)).unionByName(part)


def effective_level(tiles: DataFrame) -> DataFrame:
    """(feature_id, level): the first level at which a feature has more than one tile, or a full one; tiles of several levels."""
    by = tiles.groupBy("feature_id", "l").agg(F.count("*").alias("n"), F.bool_or(F.col("status") == "FULL").alias("full"))
    return by.groupBy("feature_id").agg(F.coalesce(F.min(F.when((F.col("n") > 1) | F.col("full"), F.col("l"))), F.max("l")).alias("level"))


def runtime_stats(tasks: DataFrame, pixels: int = 256) -> DataFrame:
    """One row: retained tasks, distinct images and the bytes of their RGBA pixels."""
    return tasks.agg(F.count("*").alias("retained"), F.count_distinct("x", "y", "l").alias("images"), (F.count("*") * (pixels * pixels * 4)).alias("rgba_bytes"))


def generation_report(outcomes: DataFrame) -> DataFrame:
    """(phase, completed, failed, cancelled) of task outcomes."""
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return outcomes.groupBy("phase").agg(count("completed"), count("failed"), count("cancelled"))


def visible_children(tiles: DataFrame, by: list[str]) -> DataFrame:
    """(keys, x, y, l, children): how many of a tile's four children are not hidden; tiles of one level are the children."""
    return tiles.filter("status <> 'NONE'").groupBy(*by, F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y"), (F.col("l") - 1).alias("l")).agg(F.count("*").alias("children"))
