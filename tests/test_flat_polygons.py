"""Flat polygons: cuts at the antimeridian vertex by vertex, bridges, odd crossings, and the descent of concave rings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronoplate.functions import geometry as G
from chronoplate.functions import tiling as T
from chronoplate.operators import flat_polygons as P

SCHEMA = "id INT, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, parts INT"


def frame(spark, rings):
    return spark.createDataFrame([(i, r, 1) for i, r in enumerate(rings)], SCHEMA).drop("parts")


def area(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]], strict=True)) / 2


def parts(spark, rings):
    return {r.id: r for r in P.cut_at_antimeridian(frame(spark, rings)).collect()}


def test_a_box_over_the_antimeridian_is_two_boxes(spark):
    box = [(170.0, 0.0), (-170.0, 0.0), (-170.0, 10.0), (170.0, 10.0), (170.0, 0.0)]
    got = parts(spark, [box, box[:-1], box[::-1]])
    east = [(170, 0), (180, 0), (180, 10), (170, 10), (170, 0)]
    west = [(-180, 0), (-170, 0), (-170, 10), (-180, 10), (-180, 0)]
    assert [[tuple(p) for p in r] for r in got[0].parts] == [east, west] == [[tuple(p) for p in r] for r in got[1].parts]
    assert [(c.i, c.east, c.y) for c in got[0].crossings] == [(0, True, 0.0), (2, False, 10.0)]
    assert sorted(abs(area([tuple(p) for p in r])) for r in got[2].parts) == [100, 100]
    assert (got[0].winding, got[0].bridged, got[0].west, got[0].east) == (0.0, False, True, True)


def test_a_ring_round_a_pole_is_bridged_at_the_crossing_nearest_to_it(spark):
    north = [(0.0, 60.0), (120.5, 70.0), (-120.5, 80.0), (0.0, 60.0)]
    south = [(x, -y) for x, y in north]
    got = parts(spark, [north, south, north[::-1]])
    y = 70 + 10 * 59.5 / 119
    assert [tuple(p) for p in got[0].parts[0]] == [north[0], north[1], (180, y), (180, 89.5), (-180, 89.5), (-180, y), north[2], north[3]]
    assert [tuple(p) for p in got[1].parts[0]][2:6] == [(180, -y), (180, -89.5), (-180, -89.5), (-180, -y)]
    assert [tuple(p) for p in got[2].parts[0]][2:6] == [(-180, y), (-180, 89.5), (180, 89.5), (180, y)]
    assert [r.bridged for _, r in sorted(got.items())] == [True] * 3 and math.isclose(got[2].winding, -360)


def test_nulls_points_lines_and_odd_crossings(spark):
    odd = [(x, y + k) for k in range(3) for x, y in ((170.0, 0.0), (-170.0, 0.5), (0.0, 0.7))]  # three turns eastward
    got = parts(spark, [None, [], [(1.0, 95.0)], [(170.0, 0.0), (-170.0, 1.0)], odd, [(-10.0, 0.0), (10.0, 0.0), (0.0, -95.0)]])
    assert got[0].parts is None and got[0].crossings is None and not got[0].bridged
    assert got[1].parts == [] and got[1].crossings == []
    assert [tuple(p) for p in got[2].parts[0]] == [(1.0, 89.5)]
    assert len(got[3].parts) == 2
    assert len(got[4].crossings) == 3 and got[4].winding == 1080 and [tuple(p) for p in got[4].parts[0]] == [*odd, odd[0]]
    assert min(p.y for p in got[5].parts[0]) == -89.5
    empty = P.cut_at_antimeridian(frame(spark, []))
    assert empty.count() == P.roots(empty).count() == P.extents(P.roots(empty)).count() == 0


def star(rng):
    x, y, n = rng.uniform(-100, 100), rng.uniform(-40, 40), rng.randint(5, 14)
    r = [(x + (d := rng.uniform(3, 30)) * math.cos(2 * math.pi * k / n), y + d * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*r, r[0]]


@pytest.mark.parametrize("scheme", [T.GEOGRAPHIC, T.MERCATOR])
def test_tiles_add_up_to_their_rings_at_every_level(spark, scheme):
    rng = random.Random(1)
    rings = [star(rng) for _ in range(20)]
    nodes = P.roots(P.cut_at_antimeridian(frame(spark, rings)), scheme)
    share = F.when(F.col("status") == "FULL", 1.0).otherwise(F.abs(G.signed_area(G.opened(F.col("clip")))))
    for level in (0, 2, 3):
        rect = T.rectangle(F.col("x"), F.col("y"), F.col("l"), scheme)
        # Rings are linear in the root's shares; each level cuts at the real rows, so shares weigh by these.
        whole = 180.0 * 180.0 if scheme == T.GEOGRAPHIC else 360.0 * 2 * T.MERCATOR_LAT
        rows = P.tiles_at(nodes, level, scheme).select("id", share.alias("share"), rect.alias("r"), "l")
        if scheme == T.GEOGRAPHIC:
            got = {r.id: r.a for r in rows.groupBy("id").agg(F.sum(F.col("share") * (F.col("r.east") - F.col("r.west")) * (F.col("r.north") - F.col("r.south"))).alias("a")).collect()}
            assert all(math.isclose(got[i], abs(area(r)), rel_tol=1e-9) for i, r in enumerate(rings))
        else:
            assert rows.filter("share > 1 + 1e-9 or share <= 0").count() == 0
            if not level:
                assert all(math.isclose(r.share * whole, abs(area(rings[r.id])), rel_tol=1e-9) for r in rows.collect())


def test_extents_hold_their_rings_and_say_when_nothing_branches(spark):
    rng = random.Random(2)
    small = [[(x + 50, y / 9 + 30) for x, y in star(rng)] for _ in range(10)]
    small = [[(max(-179, min(179, x)), y) for x, y in r] for r in small]
    for split_to in (0, 6):
        for r in P.extents(P.roots(P.cut_at_antimeridian(frame(spark, small))), split_to=split_to).collect():
            assert r.complete
            if not split_to:
                mine = [p for p in small[r.id] if r.west <= p[0] <= r.east]
                assert all(r.to_west - 1e-9 <= x <= r.to_east + 1e-9 and r.to_south - 1e-9 <= y <= r.to_north + 1e-9 for x, y in mine)
    corner = [(1e-13, 1e-13), (3e-13, 1e-13), (3e-13, 2e-13), (1e-13, 1e-13)]
    full = [(-180.0, -90.0), (0.0, -90.0), (0.0, 90.0), (-180.0, 90.0), (-180.0, -90.0)]
    got = P.extents(P.roots(P.cut_at_antimeridian(frame(spark, [corner, full])))).collect()
    assert [r.complete for r in got if r.id == 0] in ([False], [True]) and len(got) >= 2


@pytest.mark.parametrize("scheme", [T.GEOGRAPHIC, T.MERCATOR])
def test_extents_go_down_in_batches_as_children_do(spark, scheme):
    rng = random.Random(3)
    rings = [[(x / 3 ** (i % 4) + 20, y / 3 ** (i % 4) + 9) for x, y in star(rng)] for i in range(24)]
    rings += [[(22.5 + a, 11.25 + b) for a, b in ((0.0, 0.0), (0.3, 0.0), (0.3, 0.2), (0.0, 0.0))], [(None, 3.0), (30.0, 3.0), (33.0, 4.0), (31.0, 7.0), (None, 3.0)], [(float("nan"), 3.0), (30.0, 3.0), (33.0, 4.0), (31.0, 7.0)]]
    nodes = P.roots(P.cut_at_antimeridian(frame(spark, rings)), scheme).withColumn("root", F.col("x"))
    found = P.extents(nodes, scheme)
    assert "aggregate(sequence" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "MapInArrow" in plan
    got = {(r.id, r.root): (r.to_l, r.to_x, r.to_y) for r in found.collect()}
    kids = [r for level in range(3) for r in P.children(P.tiles_at(nodes, level, scheme), scheme).filter("status <> 'NONE'").select("id", "root", "x", "y", "l").collect()]
    below = {}
    for r in kids:
        below.setdefault((r.id, r.root, r.l - 1, r.x // 2, r.y // 2), []).append((r.l, r.x, r.y))
    ends = 0
    for (i, root), to in got.items():
        at = (0, root, 0)
        while at[0] < 3 and len(some := below.get((i, root, *at), [])) == 1:
            at = some[0]
        assert at == to or at[0] == 3 and to[0] >= 3
        ends += at == to
    assert len(got) > 20 and ends > 10


def test_specks_in_split_tiles_end_where_numbers_do(spark):
    at = [(i * 7.3 - 100, i * 3.1 - 45) for i in range(30)]
    specks = [[(x, y), (x + 2e-13, y), (x + 2e-13, y + 1e-13), (x, y)] for x, y in at]
    got = P.extents(P.roots(P.cut_at_antimeridian(frame(spark, specks))), split_to=6).collect()
    assert len(got) == 30 and {r.to_l for r in got} == {29, 30} and not any(r.complete for r in got)


def test_only_rings_that_cross_are_dealt_to_two_parts(spark):
    plan = P.cut_at_antimeridian(frame(spark, []))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (size(crossings" in plan
    inside, beyond = [(130.0, 0.0), (179.0, 0.0), (-119.0, 5.0), (130.0, 0.0)], [(130.0, 0.0), (500.0, 0.0), (150.0, 5.0), (130.0, 0.0)]
    got = parts(spark, [inside, beyond])
    assert got[0].crossings == [] and [[tuple(p) for p in r] for r in got[0].parts] == [inside]
    assert len(got[1].crossings) == 2 and len(got[1].parts) == 2
