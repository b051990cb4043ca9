"""Groups of overlapping ranges against comparing all pairs."""

import random

import pytest

from gridloom.operators import overlaps

SCHEMA = "sheet string, r0 int, c0 int, r1 int, c1 int"


def brute(rows):
    rows, out = sorted(set(rows)), {}
    root = {r: r for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] == b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in rows:
        out[r] = find(r)[1:3]
    return out


@pytest.mark.parametrize(("seed", "size", "tall"), [(1, 4, 5), (2, 90, 200), (3, 20, 3)])
def test_groups_equal_comparing_all_pairs(spark, seed, size, tall):
    rng = random.Random(seed)
    rows = [(rng.choice("xy"), a, b, a + rng.randint(0, tall), b + rng.randint(0, size)) for a, b in ((rng.randint(1, 900), rng.randint(1, 300)) for _ in range(220))]
    rows += rows[:9] + [("x", 1, 700, 5_000, 700), ("x", 4_990, 690, 4_991, 710), ("x", 4_991, 1, 4_991, 690)]
    got = {tuple(r)[:5]: tuple(r)[5:] for r in overlaps.overlap_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows) and len(set(got.values())) > 3


def test_chains_and_empty_tables(spark):
    chain = [("s", i, i, i + 1, i + 1) for i in range(1, 300)]
    assert {tuple(r)[5:] for r in overlaps.overlap_groups(spark.createDataFrame(chain, SCHEMA)).collect()} == {(1, 1)}
    assert overlaps.overlap_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {tuple(r)[5:] for r in overlaps.overlap_groups(spark.createDataFrame([("s", 1, 1, 2, 2), ("s", 3, 1, 3, 3), ("t", 1, 1, 9, 9)], SCHEMA)).collect()} == {(1, 1), (3, 1)}
