"""Plate rotations at given ages: interpolation in a plate's series, and composition along related plates.

A rotation model is a dimension of some thousand records: its plates, each with its records in a row, meet what is asked for by an
equi-join on the plate. Points, domains and tiles are the large side, and are joined with the finished plate rotations by (plate, age).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplate.functions import rotation as R
from chronoplate.operators.tables import dropped, few, written
from chronoplate.sources import rot

#: Plates (with their records) that may be broadcast; more are joined by a shuffle.
BROADCAST_PLATES = 20_000
#: Ages that meet a plate at a time.
AGES_PER_BLOCK = 1_000
#: Up to so many rows, or so many for each asked pair, every plate of the model is taken at every asked age; beyond, only the plates that chains can reach.
ALL_PLATES_ROWS, ALL_PLATES_SHARE = 1_000_000, 20


def intervals(series: DataFrame) -> DataFrame:
    """Each record with its quaternion, the record after it (`next_*`), its number `i` and the number `n` of its plate's records."""
    order = Window.partitionBy("plate_id").orderBy("line_no")
    q = series.withColumn("q", R.from_pole(F.col("pole_lon"), F.col("pole_lat"), F.col("angle")))
    return q.select(
        "plate_id", "age", "q", "related_id",
        F.row_number().over(order).alias("i"),
        F.count("*").over(Window.partitionBy("plate_id")).alias("n"),
        F.lead("age").over(order).alias("next_age"),
        F.lead("q").over(order).alias("next_q"),
        F.lead("related_id").over(order).alias("next_related"),
        F.first("age").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first_age"),
        F.last("age").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last_age"),
    )


def spans_by_plate(series: DataFrame) -> DataFrame:
    """(plate_id, spans, tops): the records of intervals() of each plate in file order, and the greatest end of a span so far, which ascends even where ages don't."""
    names = ("i", "n", "age", "q", "related_id", "next_age", "next_q", "next_related", "first_age", "last_age")
    top = F.max("next_age").over(Window.partitionBy("plate_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = intervals(series).withColumn("_top", F.when(F.col("next_age").isNotNull(), top))
    packed = rows.groupBy("plate_id").agg(F.array_sort(F.collect_list(F.struct(*names, "_top"))).alias("spans"))
    return packed.withColumn("tops", F.col("spans._top"))


def _first_at_or_above(tops: Column, at: Column) -> Column:
    """Place of the first number of an ascending array that is `at` or more, by halving; the array's last place if none before it is. Nulls count as more."""
    state = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        enough = F.coalesce(F.get(tops, middle) >= at, F.lit(True))
        return F.when(s["low"] >= s["high"], s).when(enough, state(s["low"], middle)).otherwise(state(middle + 1, s["high"]))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(tops), F.lit(1)))).cast("int"))
    return F.aggregate(steps, state(F.lit(0), F.size(tops) - 1), halved)["low"]


def _own(spans: Column, tops: Column, age: Column) -> Column:
    """struct<q, related_id> of a plate's own rotation at an age, null without spans."""
    first = F.get(spans, F.lit(0))
    at = F.greatest(first["first_age"], F.least(first["last_age"], age))

    def turned(p: Column) -> Column:
        width = p["next_age"] - p["age"]
        share = F.when(width != 0, (at - p["age"]) / width).otherwise(F.lit(0.0))
        q = F.when(p["n"] > 1, R.slerp(p["q"], p["next_q"], share))
        related = F.when((p["n"] == 1) | (at <= p["age"]), p["related_id"]).otherwise(p["next_related"])
        return F.when(p.isNotNull() & ((p["n"] == 1) | p["next_age"].isNotNull()), F.struct(q.alias("q"), related.alias("related_id")))

    # The span whose end is the first record at or above the age: the ends before it are all below, so where ages of a series don't ascend the first of several in file order holds.
    return F.get(F.transform(F.array(F.get(spans, _first_at_or_above(tops, at))), turned), F.lit(0))


def _at_ages(plates: DataFrame, ages: DataFrame) -> DataFrame:
    """Every plate at every age of a written table: blocks of ages are joined by number, and a plate's row meets one at a time."""
    n = -(-max(ages.count(), 1) // AGES_PER_BLOCK)
    blocks = ages.groupBy(F.pmod(F.xxhash64("age"), F.lit(n)).cast("int").alias("_block")).agg(F.collect_list("age").alias("_ages"))
    each = plates.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, "_block")
    return each.withColumn("age", F.explode("_ages")).drop("_block", "_ages")


def _asked(plates: DataFrame, asked: DataFrame) -> DataFrame:
    """`plates` at the asked ages: pairs (plate_id, age) are joined by plate; ages alone are asked of every plate."""
    if "plate_id" in asked.columns:
        return asked.select("plate_id", "age").distinct().join(few(plates, BROADCAST_PLATES), "plate_id")
    return _at_ages(plates, written(asked.select("age").distinct().dropna(), "ages"))


def own_rotations(series: DataFrame, asked: DataFrame) -> DataFrame:
    """(plate_id, age, q, related_id): each plate's own rotation at each age of `asked` (age), or at the pairs of `asked` (plate_id, age).

    Ages are clamped to the plate's records. The related plate is that of the first record at or above the age. A
    plate of a single record has no rotation of its own (q is null) and passes its related plate on."""
    plates = written(spans_by_plate(series), "plates")
    own = _asked(plates, asked).select("plate_id", "age", F.inline(F.array(F.struct(_own(F.col("spans"), F.col("tops"), F.col("age")).alias("p")))))
    return own.filter("p is not null").select("plate_id", "age", "p.q", "p.related_id")


def plate_rotations(series: DataFrame, asked: DataFrame, anchor: str | None = "0") -> DataFrame:
    """(plate_id, age, q): total rotation of each plate, the product of own rotations from the root of its chain to the plate, at the ages or pairs of `asked`.

    The chain ends at the anchor (identity) or at a plate that the model lacks. A plate whose chain meets neither the anchor nor
    a plate with a rotation of its own has a null q. A cycle of related plates is an error.

    Own rotations are computed once for each plate and age that chains pass. Ways up then double: each step joins what a plate's way has
    reached with the way of the plate there, so that rounds grow with the logarithm of the longest chain. Each is written."""
    plates = written(spans_by_plate(series), "plates")
    n_plates = plates.count()
    wanted = written(_asked(plates.select("plate_id"), asked), "asked")
    ages = written(wanted.select("age").distinct(), "ages")
    if "plate_id" not in asked.columns or n_plates * ages.count() <= max(ALL_PLATES_ROWS, ALL_PLATES_SHARE * wanted.count()):
        passed = _at_ages(plates, ages)
    else:
        reached = wanted.join(_ancestors(series), "plate_id").select(F.col("_to").alias("plate_id"), "age")
        passed = _asked(plates, reached)
    ways = _ways_up(passed, n_plates, anchor)
    both = wanted.join(ways, ["plate_id", "age"], "left").withColumns({"at": F.coalesce("at", "plate_id"), "q": F.coalesce("q", R.identity())})
    return both.select("plate_id", "age", F.when(_is_root(F.col("at"), anchor) | F.coalesce("met", F.lit(False)), F.col("q")).alias("q"))


def _is_root(plate: Column, anchor: str | None) -> Column:
    return F.coalesce(R.is_anchor(plate, anchor), F.lit(False))


def _ancestors(series: DataFrame) -> DataFrame:
    """(plate_id, _to): the plates that a plate's chain can pass at any age, itself included."""
    known = series.select("plate_id").distinct()
    step = series.select("plate_id", F.col("related_id").alias("_to")).unionByName(known.withColumn("_to", F.col("plate_id")))
    found = written(step.distinct(), "ancestors")
    while True:
        further = found.join(found.select(F.col("plate_id").alias("_to"), F.col("_to").alias("_next")), "_to").select("plate_id", F.col("_next").alias("_to"))
        more = written(further.unionByName(found).distinct(), "ancestors")
        if more.count() == found.count():
            return more
        dropped(found)
        found = more


def _ways_up(passed: DataFrame, n_plates: int, anchor: str | None) -> DataFrame:
    """(plate_id, age, at, q, met): where the chain of each plate (with its spans) ends, the product of rotations on the way, and whether there is any. The anchor has no way, and plates without a span at an age neither."""
    own = passed.filter(~_is_root(F.col("plate_id"), anchor)).select("plate_id", "age", F.inline(F.array(F.struct(_own(F.col("spans"), F.col("tops"), F.col("age")).alias("own")))))
    ways = written(own.filter("own is not null").select("plate_id", "age", F.col("own.related_id").alias("at"), F.coalesce("own.q", R.identity()).alias("q"), F.col("own.q").isNotNull().alias("met"), F.lit(False).alias("done")), "ways")
    for _ in range(n_plates.bit_length() + 1):
        before = ways
        there = before.select(F.col("plate_id").alias("at"), "age", F.col("at").alias("_to"), F.col("q").alias("_q"), F.col("met").alias("_met"), F.col("done").alias("_done"))
        both = before.filter("not done").join(there, ["at", "age"], "left")
        end = F.col("_to").isNull()
        on = both.select(
            "plate_id",
            "age",
            F.coalesce("_to", "at").alias("at"),
            F.when(end, F.col("q")).otherwise(R.multiply(F.col("_q"), F.col("q"))).alias("q"),
            (F.col("met") | F.coalesce("_met", F.lit(False))).alias("met"),
            F.coalesce("_done", F.lit(True)).alias("done"),
        )
        ways = written(before.filter("done").unionByName(on), "ways")
        dropped(before)
        if ways.filter("not done").isEmpty():
            return ways.drop("done")
    raise ValueError("related plates form a cycle")


def plate_matrices(rotations: DataFrame) -> DataFrame:
    """Adds the matrix `m`; an unknown rotation is the identity."""
    return rotations.withColumn("m", R.matrix(F.coalesce("q", R.identity())))


def rotate_points(points: DataFrame, rotations: DataFrame, lon: str = "lon", lat: str = "lat", inverse: bool = False) -> DataFrame:
    """`points` (plate_id, age, lon, lat) with `new_lon`, `new_lat` at their age (null if the plate is unknown); `inverse` goes from the age to the present. The rotations are few and are broadcast behind the planner's size check."""
    q = rotations.select("plate_id", "age", "q")
    both = points.join(q, ["plate_id", "age"], "left")
    m = R.matrix(F.col("q"))
    moved = R.lon_lat(R.apply(R.transpose(m) if inverse else m, R.unit_vector(F.col(lon), F.col(lat))))
    moved = F.when(F.col("q").isNotNull(), moved)
    return both.withColumn("_to", moved).withColumns({"new_lon": F.col("_to.lon"), "new_lat": F.col("_to.lat")}).drop("_to", "q")


def interval_rotation(records: DataFrame, ages: DataFrame) -> DataFrame:
    """(plate_id, age, pole_lat, pole_lon, angle): the record used without interpolation or chain: the first one at or above the age whose predecessor (0 before the first) is at or below it; else the first."""
    order = Window.partitionBy("plate_id").orderBy("line_no")
    ranked = records.select("*", F.lag("age", 1, 0.0).over(order).alias("before"), F.row_number().over(order).alias("i"))
    plates = written(ranked.groupBy("plate_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("age").alias("to"), "before", "pole_lat", "pole_lon", "angle"))).alias("records")), "plates")
    both = _asked(plates, ages)
    fits = F.filter("records", lambda r: (r["to"] >= F.col("age")) & (r["before"] <= F.col("age")))
    return both.select("plate_id", "age", F.coalesce(F.get(fits, F.lit(0)), F.get("records", F.lit(0))).alias("p")).select("plate_id", "age", "p.pole_lat", "p.pole_lon", "p.angle")


class RotationModel:
    """Records of a model with an anchor, and what is asked of them. Tables go in and out; nothing is computed until they are used."""

    def __init__(self, records: DataFrame, anchor: str | None = "0"):
        self.records, self.anchor = records, anchor

    @classmethod
    def read(cls, spark: SparkSession, *paths: str, anchor: str | None = "0") -> RotationModel:
        return cls(rot.read(spark, *paths), anchor)

    def with_load(self, more: DataFrame) -> RotationModel:
        """The model after a later load: its plates replace the same ones."""
        return RotationModel(rot.replace_plates(self.records, more), self.anchor)

    def rotations(self, asked: DataFrame) -> DataFrame:
        """(plate_id, age, q) at ages, or at pairs of plate and age."""
        return plate_rotations(rot.series(self.records), asked, self.anchor)

    def matrices(self, asked: DataFrame, inverse: bool = False) -> DataFrame:
        """(plate_id, age, q, m): to the age, or from it to the present."""
        found = plate_matrices(self.rotations(asked))
        return found.withColumn("m", R.transpose(F.col("m"))) if inverse else found

    def at_age(self, points: DataFrame, lon: str = "lon", lat: str = "lat", rotations: DataFrame | None = None) -> DataFrame:
        """Points (plate_id, age, ...) with where they were at their age. `rotations` are those of their plates and ages, if they are known."""
        return rotate_points(points, self._known(points, rotations), lon, lat)

    def at_present(self, points: DataFrame, lon: str = "lon", lat: str = "lat", rotations: DataFrame | None = None) -> DataFrame:
        """Points of their age with where they are today."""
        return rotate_points(points, self._known(points, rotations), lon, lat, inverse=True)

    def _known(self, points: DataFrame, rotations: DataFrame | None) -> DataFrame:
        return self.rotations(points.select("plate_id", "age")) if rotations is None else rotations


def baked(records: DataFrame, rotations: DataFrame, age: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Records (plate_id, begin_age, end_age, lon, lat) that are visible at an age, with their points turned (`new_lon`, `new_lat`); one of an unknown plate stays where it is. What isn't visible is skipped, and not turned."""
    seen = records.filter((F.col("end_age") <= age) & (F.col("begin_age") >= age)).withColumn("age", F.lit(float(age)))
    moved = rotate_points(seen, rotations, lon, lat)
    return moved.withColumns({"new_lon": F.coalesce("new_lon", lon), "new_lat": F.coalesce("new_lat", lat)}).drop("age")
