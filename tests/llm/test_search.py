"""Exact top-k search and hard-negative mining against brute force, and their defined cases."""

import math

import numpy as np
import pytest

from kinweave.llm import hard_negatives, registry, topk_search, vector_blocks

NAN, INF = float("nan"), float("inf")
ODD = [(None, [1.0, 2.0], 1), (20, None, 1), (21, [], 1), (22, [], 1), (23, [NAN, 1.0], 1), (24, [1.0, None], 1), (25, [INF, 1.0], 1), (26, [3e38, 1.0], 1), (27, [1.0], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, score string, rank int")


def whole(rows, scale, dim=None):
    """id, label, integers of the rows that take part."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and sum((scale * x) ** 2 for x in v) < 2.0**62
    return [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if i is not None and ok(v)]


def nearest(rows, asked, k=10, scale=1024):
    out = []
    for q, _, v in whole(asked, scale):
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, _, w in whole(rows, scale) if i != q and len(w) == len(v))
        out += [(q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


def negatives(rows, asked, scale=256):
    out, all_ = [], [r for r in whole([r for r in rows if r[2] is not None], scale)]
    for q, label, v in whole([r for r in asked if r[2] is not None], scale):
        s = sorted((-sum(a * b for a, b in zip(v, w)), i, lb == label) for i, lb, w in all_ if i != q and len(w) == len(v))
        for p, i, _ in [x for x in s if x[2]][:5]:
            fit = [(-n, j) for n, j, same in s if not same and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(q, i, r, j, -p, n) for r, (n, j) in enumerate(fit[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("name", ["op11_topk_search", "op13_hard_negatives"])
def test_small_tables_give_the_oracle_rows(name, same_rows):
    same_rows(registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("dim, spread, share", [(16, 0.3, 0.4), (3, 1.0, 0.0), (64, 0.05, 1.0), (9, 0.0, 0.7)])
def test_search_and_mining_equal_brute_force(spark, monkeypatch, dim, spread, share):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vector_blocks, "PART_ROWS", 3)
    rng = np.random.default_rng(dim)
    centre = rng.standard_normal(dim)
    # One group of near or exact copies with a given share of all rows, the rest without a pattern.
    v = [centre + spread * rng.standard_normal(dim) if rng.random() < share else rng.standard_normal(dim) for _ in range(260)]
    rows = [(i, [*map(float, x)], int(rng.random() > 0.33) * int(rng.integers(0, 4))) for i, x in enumerate(v)]
    df, asked = frame(spark, rows), [r for r in rows if r[0] % 20 == 0]
    got = topk_search.search(df.repartition(5), df.filter("vec_id % 20 = 0"), k=4).collect()
    assert sorted(map(tuple, got)) == nearest(rows, asked, 4)
    got = hard_negatives.mine(df.repartition(5), df.filter("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == negatives(rows, asked)


def test_sums_beyond_doubles_are_exact(spark):
    big = 2.0**19 + 1
    rows = [(i, [big, big - i, float(i)], i % 2) for i in range(30)]  # integers near 2^29, products near 2^59
    df = frame(spark, rows)
    assert sorted(map(tuple, topk_search.search(df, df).collect())) == nearest(rows, rows)
    rows = [(i, [4 * big, 4 * big * (1 - i / 40), float(i)], i % 2) for i in range(30)]
    df = frame(spark, rows)
    assert sorted(map(tuple, hard_negatives.mine(df, df).collect())) == negatives(rows, rows)


def test_defined_cases(spark):
    rows = [*ODD, (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.9, 0.0], None), (4, [0.7, 0.1], 2), (5, [-1.0, 0.0], 2), (5, [-1.0, 0.0], 2), (6, [0.7, 0.1], 3)]
    df = frame(spark, rows)
    got = sorted(map(tuple, topk_search.search(df, df, k=3).collect()))
    assert got == nearest(rows, rows, 3)
    assert [x for x in got if x[0] == 21] == [(21, 1, 22, 0)] and not any(x[0] in (20, 23, 24, 25, 26, 27) for x in got)
    assert [x[2] for x in got if x[0] == 1] == [2, 3, 4]  # ties to the smaller id, 3 without a label takes part
    got = sorted(map(tuple, hard_negatives.mine(df, df).collect()))
    assert got == negatives(rows, rows) and (1, 2, 1, 4, 65536, 45824) in got
    none = df.limit(0)
    assert topk_search.search(none, none).count() == topk_search.search(df, none).count() == topk_search.search(none, df).count() == 0
    assert hard_negatives.mine(none, none).count() == hard_negatives.mine(df, none).count() == hard_negatives.mine(none, df).count() == 0


def test_few_candidates_reach_the_last_columns():
    """The bounds do away with most candidates early where some are near."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64)) * 1024
    x[:40] = x[0] + rng.standard_normal((40, 64)) * 100
    v = np.floor(x)
    cuts = topk_search._cuts(64)
    d = [v[:, a : a + n] for a, n in cuts]
    rest = np.stack([np.sqrt((v[:, a + n :] ** 2).sum(axis=1)) for a, n in cuts], axis=1)
    c = {"ids": np.arange(2000), "d": d, "rest": rest, "norm": np.sqrt((v**2).sum(axis=1))}
    at, sums = topk_search._survivors(c, 0, c, d[0][0] @ d[0].T, -np.inf, 10)
    want = v @ v[0]
    assert (sums == want[at]).all() and len(at) < 200
    assert set(np.lexsort((np.arange(1, 2000), -want[1:]))[:10] + 1) <= set(at)
