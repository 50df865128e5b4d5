"""Blocks far on in the generator's run begin where it has got to."""

import time

from chronoplate.operators import measurements


def jumped(seed, n):
    """The generator's state after n numbers, by powers."""
    a, c, state = 1664525, 1013904223, seed
    while n:
        if n & 1:
            state = (a * state + c) % 2**32
        a, c, n = a * a % 2**32, (a + 1) * c % 2**32, n >> 1
    return state


def test_far_blocks(spark):
    items, blocks = ["a", "b", "c", "d"], [0, 1, 7, 10**7, 2**31 + 5, 2**40 + 3]
    rows = spark.createDataFrame([(b,) for b in blocks], "block BIGINT").repartition(2)
    began = time.monotonic()
    got = measurements.shuffled_blocks(rows, items, 42).collect()
    assert time.monotonic() - began < 60
    for b in blocks:
        state, row = jumped(42, 3 * b), list(items)
        for i in (3, 2, 1):
            state = (1664525 * state + 1013904223) % 2**32
            j = state * (i + 1) >> 32
            row[i], row[j] = row[j], row[i]
        assert [r["item"] for r in sorted((r for r in got if r["block"] == b), key=lambda r: r["position"])] == row
