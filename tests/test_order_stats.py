"""Weighted medians against sorting."""

import math
import random

import pytest

from lodestrata.operators.order_stats import medians


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(x for k, x, n in rows if k == c for _ in range(n))
        out[c] = own[(len(own) - 1) // 2] * 0.5 + own[len(own) // 2] * 0.5
    return out


@pytest.mark.parametrize("few", [50_000, 3, 1])
def test_medians_of_many_shapes(spark, few):
    rng, rows = random.Random(4), []
    shapes = [
        lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300),
        lambda: 5.0 + rng.choice([0, math.ulp(5.0), 2 * math.ulp(5.0)]), lambda: 1e300 if rng.random() < 0.01 else rng.random(), lambda: -rng.expovariate(1e-6), lambda: 7.5,
    ]
    for c, shape in enumerate(shapes):
        rows += [(c, shape(), rng.choice([1, 1, 2, 9])) for _ in range(201 + c)]
    rows += [(50, 1.0, 1), (51, 1.0, 1), (51, 4.0, 1), (52, 1.0, 1), (52, 2.0, 10**6)]
    df = spark.createDataFrame(rows, "col int, x double, n long").repartition(4)
    bounds = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        bounds[c] = (min(x for _, x, _ in own), max(x for _, x, _ in own), sum(n for *_, n in own), len(own))
    bounds[99] = (0.0, 0.0, 0, 0)
    got = medians(df, bounds, few)
    want = plain([r for r in rows if r[0] != 52]) | {52: 2.0}
    assert got == want


def test_loose_bounds(spark):
    df = spark.createDataFrame([(0, float(k), 1) for k in range(500)], "col int, x double, n long")
    assert medians(df, {0: (-1e9, 1e9, 500, 500)}, few=4) == {0: 249.5}
