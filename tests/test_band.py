"""Band joins against all pairs."""

import random

import pytest

from kinweave.operators.band import band_join


@pytest.mark.parametrize("width, bin_rows, by", [(10, 100_000, None), (10, 5, None), (0, 3, None), (2.5, 7, ("f", "g")), (-1, 10, None)])
def test_pairs_equal_brute_force(spark, width, bin_rows, by):
    rng = random.Random(3)
    year = lambda: 1900 if rng.random() < 0.4 else rng.choice([None, float("nan"), -3.5, *range(1880, 1960)])
    a = [(k, year(), rng.choice("xyz") if rng.random() < 0.9 else None) for k in range(120)] + [(7, 1900.0, "x")] * 2
    b = [(k, year(), rng.choice("xyz") if rng.random() < 0.9 else None) for k in range(90)]
    a, b = [(i, y if y is None else float(y), f) for i, y, f in a], [(i, y if y is None else float(y), f) for i, y, f in b]
    left, right = spark.createDataFrame(a, "i int, y double, f string"), spark.createDataFrame(b, "j int, z double, g string")
    got = sorted((r["i"], r["j"]) for r in band_join(left, right, ("y", "z"), width, by, bin_rows).collect())
    want = sorted((i, j) for i, y, f in a for j, z, g in b if y is not None and z is not None and abs(y - z) <= width and (by is None or (f is not None and f == g)))
    assert got == want and (width < 0 or want)


def test_empty_sides_and_clashes(spark):
    left, right = spark.createDataFrame([(1, 2)], "a int, y int"), spark.createDataFrame([(1, 2)], "b int, z int")
    assert band_join(left.limit(0), right, ("y", "z"), 1).count() == band_join(left, right.limit(0), ("y", "z"), 1).count() == 0
    with pytest.raises(ValueError):
        band_join(left, left, ("y", "y"), 1)
