"""As-of joins against a loop."""

import bisect
import random

import pytest

from tidewright.operators.timejoin import bracket, containing


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("steps", [0, 1, 7, 400])
def test_bracket_by_brute_force(spark, keyed, steps):
    rng = random.Random(steps)
    axis = sorted({(rng.randrange(3) if keyed else 0, rng.randrange(1000)) for _ in range(steps)})
    rows = [(i, rng.randrange(3) if keyed else 0, rng.randrange(-50, 1050)) for i in range(300)]
    left = spark.createDataFrame(rows, "id int, k int, at int")
    right = spark.createDataFrame([(k, t, float(t * 2)) for k, t in axis], "k int, t int, v double")
    got = {r.id: r for r in (bracket(left, right, "at", "t", ["v"], ["k"]) if keyed else bracket(left, right.drop("k"), "at", "t", ["v"])).collect()}
    assert len(got) == 300
    for i, k, at in rows:
        own = [t for q, t in axis if q == k or not keyed]
        if not own:
            assert got[i].t0 is None and got[i].v_1 is None
            continue
        a, b = bisect.bisect_right(own, at) - 1, bisect.bisect_left(own, at)
        t0, t1 = own[max(a, 0)], own[min(b, len(own) - 1)]
        assert (got[i].t0, got[i].t1, got[i].v_0, got[i].v_1) == (t0, t1, t0 * 2.0, t1 * 2.0)
        assert abs(got[i].weight - ((at - t0) / (t1 - t0) if t1 > t0 else 0.0)) < 1e-12


def test_grace_and_intervals(spark):
    left = spark.createDataFrame([(1, 0, 5), (2, 0, 12), (3, 0, 40)], "id int, k int, at int")
    right = spark.createDataFrame([(0, 10, 1.0, 4), (0, 20, 2.0, 10)], "k int, t int, v double, len int")
    got = {r.id: (r.v_0, r.v_1) for r in bracket(left, right, "at", "t", ["v"], ["k"], grace=6).collect()}
    assert got == {1: (1.0, 1.0), 2: (1.0, 2.0), 3: (None, None)}
    held = {r.id: r.v for r in containing(left, right, "at", "t", "len", ["v"], ["k"]).collect()}
    assert held == {1: None, 2: 2.0, 3: None}
