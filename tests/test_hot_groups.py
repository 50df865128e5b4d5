"""Operators whose groups may hold most rows, against plain forms."""

import random
import statistics

from pyspark.sql import functions as F

from chronoplate.functions import rotation as R
from chronoplate.operators import measurements, views


def test_quartiles_of_a_hot_group_with_ties_nulls_and_no_values(spark):
    rng = random.Random(1)
    rows = [("hot", "a", float(rng.randint(0, 400))) for _ in range(20_000)] + [(None, "b", 1.5), (None, "b", 2.5), ("one", "c", -7.0), ("none", "d", None), ("none", "d", float("nan")), ("none", "d", float("inf"))]
    rows += [("few", "e", float(x)) for x in (3, 1, 2, 10)]
    df = spark.createDataFrame(rows, "k STRING, m STRING, value DOUBLE")
    got = {r.k: r for r in measurements.quartiles(df, ["k", "m"]).collect()}
    assert set(got) == {"hot", None, "one", "few"}
    for k in got:
        v = sorted(x for a, _, x in rows if a == k)
        at = lambda s, v=v: v[int((len(v) - 1) * s)] + (v[-(-int((len(v) - 1) * s * 4) // 4) if (len(v) - 1) * s % 1 == 0 else int((len(v) - 1) * s) + 1] - v[int((len(v) - 1) * s)]) * ((len(v) - 1) * s % 1)
        assert got[k].n == len(v) and got[k].median == statistics.median(v)
        assert abs(got[k].q1 - at(0.25)) < 1e-9 and abs(got[k].q3 - at(0.75)) < 1e-9
    assert measurements.quartiles(df.limit(0), ["k"]).count() == 0


def test_items_in_view_by_cells_equal_a_comparison_of_all(spark):
    rng = random.Random(2)
    import math

    def ball(r):
        lon, lat = rng.uniform(-math.pi, math.pi), math.asin(rng.uniform(-1, 1))
        return (R.EARTH * math.cos(lat) * math.cos(lon), R.EARTH * math.cos(lat) * math.sin(lon), R.EARTH * math.sin(lat), r)

    kind = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, r: DOUBLE>"
    items = [(i, str(i % 3), ball(rng.choice([0.0, 1e3, 4e5, 9e5, 3e6, 7e6]))) for i in range(300)]
    seen = [(i, 10.0, ball(rng.choice([0.0, 1e5, 2e6, 6e6]))) for i in range(12)]
    i_df = spark.createDataFrame(items, f"id INT, plate_id STRING, sphere {kind}")
    v_df = spark.createDataFrame(seen, f"view_id INT, age DOUBLE, sphere {kind}")
    still = spark.createDataFrame([("0", 10.0), ("1", 10.0), ("9", 10.0), ("2", 20.0)], "plate_id STRING, age DOUBLE").withColumn("q", F.when(F.col("plate_id") != "1", R.identity()))
    got = sorted((r.view_id, r.id) for r in views.in_view(i_df, v_df, still).collect())
    meets = lambda a, b: math.dist(a[:3], b[:3]) <= a[3] + b[3]
    assert got == sorted((v, i) for v, _, s in seen for i, p, t in items if p in "01" and meets(s, t))
    assert views.in_view(i_df.limit(0), v_df, still).count() == 0


def test_upper_median_of_a_long_series_with_ties(spark):
    rng = random.Random(3)
    rows = [("hot", float(t)) for t in (rng.randint(0, 30_000) for _ in range(15_000))] + [("two", 5.0), ("two", 9.0), ("one", 1.0), (None, 3.0), (None, 3.0), ("null", None)]
    got = {r.k: r.interval for r in measurements.upper_median_interval(spark.createDataFrame(rows, "k STRING, epoch_ms DOUBLE"), ["k"]).collect()}
    want = {}
    for k in ("hot", "two", None):
        times = sorted(t for a, t in rows if a == k)
        steps = sorted(b - a for a, b in zip(times, times[1:], strict=False))
        want[k] = steps[len(steps) // 2]
    assert got == want
