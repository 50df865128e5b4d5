"""Small pairs are swept on their rows; large ones and repeated keys by slabs, with the same results."""

import random

import pytest
from test_overlay import AREA, pairs, star  # noqa: F401

from chronoplate.operators import overlay
from chronoplate.plans import overlay_queries


def framed(spark, pairs):  # noqa: F811
    return spark.createDataFrame([(i, a, b) for i, a, b in pairs], f"id INT, a {AREA}, b {AREA}")


def near(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_both_ways_give_the_same(spark, pairs, monkeypatch):  # noqa: F811
    df = framed(spark, pairs)
    by_rows = {(r.id, o): r.sizes[o] for r in overlay.with_sizes(df).collect() for o in overlay.OPERATIONS}
    pieces = {r.id: r.area for r in overlay.overlay(df, "difference", keep=("b",)).collect()}
    monkeypatch.setattr(overlay, "MOST_POINTS", -1)
    by_slabs = {(r.id, o): r.sizes[o] for r in overlay.with_sizes(df).collect() for o in overlay.OPERATIONS}
    near({k: v or 0.0 for k, v in by_rows.items()}, {k: v or 0.0 for k, v in by_slabs.items()})
    assert {k for k, v in by_rows.items() if v is None} == {k for k, v in by_slabs.items() if v is None}
    near({k: len(v) for k, v in pieces.items()}, {r.id: len(r.area) for r in overlay.overlay(df, "difference", keep=("b",)).collect()})


def test_rows_of_one_key_are_one_pair_and_steps_are_cut_between_pairs(spark):
    rng = random.Random(8)
    rows = [(i % 40, [(star(rng, x=4.0 * (i // 40), n=20), [])], [(star(rng, x=4.0 * (i // 40), n=20), [])]) for i in range(60)]
    got = {r.id: r.size for r in overlay.sizes(framed(spark, rows), "intersection").collect()}
    alone = {}
    for part in (rows[:40], rows[40:]):
        for r in overlay.sizes(framed(spark, part), "intersection").collect():
            alone[r.id] = alone.get(r.id, 0.0) + r.size
    near(got, alone)


def test_small_pairs_are_not_shuffled(spark):
    rows = overlay_queries.overlay_sizes(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Aggregate") == 0 and plan.count("Window") == 0


def test_differences_need_no_join_or_window(spark):
    rows = overlay_queries.difference_areas(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Aggregate") == 0 and plan.count("Window") == 0


def test_rings_that_hold_nothing(spark):
    box, nan = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], float("nan")
    hole = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0), (0.5, 0.5)]
    sides = [[(box, [hole])], [(box[::-1], [hole[::-1], None, [(0.0, 0.0)]])], [(box[:2], [hole])], [([*box, (nan, 1.0)], [hole])], [(None, [hole])], [([], [])], [(box, [[*hole, (None, 1.0)]])]]
    got = {r.id: r.sizes for r in overlay.with_sizes(framed(spark, [(i, s, None) for i, s in enumerate(sides)])).collect()}
    assert [got[i].union for i in range(7)] == [3.75, 3.75, None, None, None, None, 4.0] and all(g.intersection is None for g in got.values())
