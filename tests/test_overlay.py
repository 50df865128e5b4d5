"""Overlays against sampled points, triangles of rings with holes, masks against a walk of all edges, and the linear filter's edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronoplate.operators import areas, overlay, raster
from chronoplate.operators.triangulate import area, triangles, turn

AREA = "ARRAY<STRUCT<exterior: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, interiors: ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>>"


def star(rng, x=0.0, y=0.0, least=0.4, most=2.0, n=None):
    n = n or rng.randint(3, 12)
    return [(x + (d := rng.uniform(least, most)) * math.cos(2 * math.pi * k / n + 0.1), y + d * math.sin(2 * math.pi * k / n + 0.1)) for k in range(n)]


def holds(ring, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) % 2 == 1


def within(polygons, x, y):
    return any(holds(e, x, y) and not any(holds(h, x, y) for h in hs) for e, hs in polygons)


OPS = {"union": lambda a, b: a or b, "intersection": lambda a, b: a and b, "difference": lambda a, b: a and not b, "xor": lambda a, b: a != b}


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    some = lambda: [(star(rng, rng.uniform(-1, 1), rng.uniform(-1, 1), 1.0), [star(rng, least=0.05, most=0.3)] if rng.random() < 0.4 else []) for _ in range(rng.randint(1, 3))]
    out = [(i, some(), some()) for i in range(12)]
    # A hole must lie in its own exterior.
    out = [(i, *([(e, [h for h in hs if all(holds(e, *p) for p in h)]) for e, hs in side] for side in (a, b))) for i, a, b in out]
    box = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    return [*out, (12, [(box(0.0), [])], [(box(0.0)[::-1], [])]), (13, [(box(0.0), [])], [(box(1.0), [])]), (14, [(box(0.0), [])], []), (15, [], []), (16, None, [(box(5.0), None)])]


@pytest.mark.parametrize("op", overlay.OPERATIONS)
def test_overlays_hold_the_points_that_they_should(spark, pairs, op):
    rows = [(i, *(None if side is None else [(e, hs) for e, hs in side] for side in (a, b))) for i, a, b in pairs]
    df = spark.createDataFrame(rows, f"id INT, a {AREA}, b {AREA}")
    got = {r.id: [([tuple(p) for p in g.exterior], g.interiors) for g in r.area] for r in overlay.overlay(df, op).collect()}
    sizes = {r.id: r.size for r in overlay.sizes(df, op).collect()}
    rng = random.Random(4)
    for i, a, b in pairs:
        parts = got.get(i, [])
        assert math.isclose(sum(abs(area(e)) for e, _ in parts), sizes.get(i, 0.0), abs_tol=1e-9)
        for _ in range(300):
            x, y = rng.uniform(-3.5, 6.5), rng.uniform(-3.5, 3.5)
            assert within([(e, []) for e, _ in parts], x, y) == OPS[op](within([(e, h or []) for e, h in a or []], x, y), within([(e, h or []) for e, h in b or []], x, y))
    assert sizes.get(12, 0) == pytest.approx({"union": 1, "intersection": 0, "difference": 0, "xor": 0}[op] + (op == "intersection"))
    assert sizes.get(13, 0) == pytest.approx({"union": 2, "intersection": 0, "difference": 1, "xor": 2}[op])
    assert 15 not in sizes


def test_overlay_of_a_large_pair_and_of_none(spark):
    rng = random.Random(5)
    a, b = star(rng, least=9.0, most=10.0, n=3000), star(rng, x=4.0, least=9.0, most=10.0, n=3000)
    df = spark.createDataFrame([(1, [(a, [])], [(b, [])])], f"id INT, a {AREA}, b {AREA}")
    size = {op: overlay.sizes(df, op).first().size for op in ("union", "intersection")}
    assert size["union"] + size["intersection"] == pytest.approx(abs(area(a)) + abs(area(b)))
    assert overlay.overlay(df.limit(0), "union").count() == 0
    with pytest.raises(ValueError):
        overlay.trapezoids(df, "sum")


def test_triangles_fill_large_rings_with_holes_and_tell_of_lost_ones():
    rng = random.Random(6)
    for n, holes in ((3, 0), (50, 3), (10_000, 40)):
        ring = star(rng, least=8.0, most=10.0, n=n)
        inner = [star(rng, (k % 7 - 3) * 1.2, (k // 7 - 3) * 1.2, 0.2, 0.5, 20) for k in range(holes)]
        made, lost = triangles(ring[:: rng.choice([1, -1])], [h[:: rng.choice([1, -1])] for h in inner])
        assert (len(made), lost) == (n + 22 * holes - 2, 0)
        assert sum(abs(turn(*t)) / 2 for t in made) == pytest.approx(abs(area(ring)) - sum(abs(area(h)) for h in inner))
    box = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert triangles(box, [[(9.0, 1.0), (9.5, 1.0), (9.2, 1.5)]])[1] == 1
    comb = [(0.0, 0.0), *((float(k), 9.0 if k % 2 else 1.0) for k in range(1, 200)), (200.0, 0.0)]
    made, _ = triangles(comb, [])
    assert sum(abs(turn(*t)) / 2 for t in made) == pytest.approx(abs(area(comb)))


def test_triangulated_reports_unbridged_holes(spark):
    box = lambda x, s: [(x, 0.0 + 1 / s), (x + s, 0.0 + 1 / s), (x + s, s), (x, s), (x, 1 / s)]
    df = spark.createDataFrame([(1, [(box(0.0, 8.0), [box(1.0, 2.0), box(20.0, 2.0)])]), (2, [(box(0.0, 8.0), None)]), (3, None), (4, [])], f"id INT, area {AREA}")
    got = {r.id: r for r in areas.triangulated(df).collect()}
    assert set(got) == {1, 2} and (got[1].unbridged, got[2].unbridged, got[2].triangles) == (1, 0, 2)


def test_masks_by_scan_lines_equal_a_walk_of_all_edges(spark):
    rng = random.Random(7)
    tiles = [(i, [star(rng, rng.random(), rng.random(), 0.05, 0.6) for _ in range(rng.randint(1, 4))]) for i in range(15)]
    exact = [[(0.125, 0.125), (0.625, 0.125), (0.625, 0.875), (0.125, 0.875)], [(0.5, 0.0), (0.5, 1.0)], []]
    tiles += [(15, exact), (16, []), (17, None), (18, [[(-5.0, -5.0), (6.0, -5.0), (6.0, 6.0), (-5.0, 6.0)]]), (19, [[(2.0, 2.0), (3.0, 2.0), (3.0, 3.0)]])]
    df = spark.createDataFrame(tiles, "id INT, clips ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>")
    for size in (1, 8, 20):
        got = sorted((r.id, r.px, r.py) for r in raster.masked(df, size).collect())
        inside = lambda clips, px, py: any(len(c) > 2 and holds(c, (px + 0.5) / size, 1 - (py + 0.5) / size) for c in clips)
        assert got == sorted((i, px, py) for i, clips in tiles if clips is not None for px in range(size) for py in range(size) if not clips or inside(clips, px, py))


def test_linear_filter_keeps_even_images_and_ends_at_the_edge(spark):
    tiles = spark.createDataFrame([(0, 0, 1, 0.0, 90.0), (1, 0, 1, 0.0, 80.0)], "x INT, y INT, l INT, south DOUBLE, north DOUBLE")
    pixels = raster.pixels(tiles.select("x", "y", "l").filter("x = 0"), 4)
    same = raster.reproject_linear(tiles, pixels.withColumn("value", F.lit(7)), 6, 4, False).collect()
    assert {r.value for r in same if r.x == 0} == {7.0} and len([r for r in same if r.x == 0]) == 36
    assert {r.value for r in same if r.x == 1} <= {None}
    ramp = raster.reproject_linear(tiles.filter("x = 0"), pixels.withColumn("value", F.col("px") * 10), 8, 4, False).filter("py = 0").orderBy("px").collect()
    assert [r.value for r in ramp] == [0.0, 2.5, 7.5, 12.5, 17.5, 22.5, 27.5, 30.0]
