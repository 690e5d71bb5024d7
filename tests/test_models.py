"""Model-backed operators checked against brute force on small fixtures."""
import math

import numpy as np
import pytest

from kpiforge.operators import knn
from kpiforge.operators import ml as ML


def brute_knn(rows, k=5):
    """Row by row over all donors: features both have, scaled by all columns over the shared ones."""
    donors = [(r[0], r[1:]) for r in rows if r[0] is not None]
    mean, out = sum(y for y, _ in donors) / len(donors), []
    for y, *x in rows:
        if y is not None:
            out.append(y)
            continue
        near = []
        for v, z in donors:
            both = [(a - b) ** 2 for a, b in zip(x, z) if a is not None and b is not None]
            if both:
                near.append((math.sqrt(sum(both) * (len(x) + 1) / len(both)), v))
        near = sorted(near)[:k]
        same = [v for d, v in near if d == 0]
        out.append(mean if not near else sum(same) / len(same) if same else sum(v / d for d, v in near) / sum(1 / d for d, _ in near))
    return out


@pytest.mark.parametrize("seed,n,gaps", [(1, 3000, 0.0), (2, 1200, 0.2), (3, 40, 0.5)])
def test_knn_matches_brute_force(spark, seed, n, gaps):
    """Dense and sparse regions, missing features on both sides, far-away rows."""
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(n) < 0.7, rng.normal(0, 0.01, n), rng.normal(100, 50, n))
    b = rng.normal(5, 2, n) * np.where(rng.random(n) < 0.1, 100, 1)
    y = 3 * a + b
    gone = lambda: rng.random(n) < gaps
    ga, gb, gy = gone(), gone(), rng.random(n) < 0.1
    rows = [(None if gy[i] else float(y[i]), None if ga[i] else float(a[i]), None if gb[i] else float(b[i])) for i in range(n)]
    rows += [(None, None, None), (None, 1e6, -1e6), (None, *rows[0][1:]), (None, *rows[0][1:])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, y double, a double, b double").repartition(5)
    got = {r.id: r.y for r in knn.impute_knn(df, "y", ["a", "b"]).collect()}
    assert len(got) == len(rows)
    assert [got[i] for i in range(len(rows))] == pytest.approx(brute_knn(rows), rel=1e-7)


def test_knn_edges(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "y double, a double")
    assert [r.y for r in knn.impute_knn(df, "y", ["a"]).collect()] == [None, None]
    assert knn.impute_knn(df.limit(0), "y", ["a"]).collect() == []
    same = spark.createDataFrame([(2.0, 1.0)] * 30 + [(None, 1.0)] * 30 + [(8.0, 3.0)], "y double, a double")
    assert {r.y for r in knn.impute_knn(same, "y", ["a"]).collect()} == {2.0, 8.0}


def test_knn_visits_grow_with_the_rows():
    """A row looks into as many cells among many donors as among few."""
    rng = np.random.default_rng(5)
    seen = []
    for n in (4_000, 64_000):
        x = rng.normal(0, 1, (n, 2))
        cells = knn.Cells(x)
        y = x[:500]
        radius = np.array([np.sort(np.sqrt(((x - q) ** 2).sum(axis=1)))[5] for q in y])
        seen.append(len(cells.touched(y, radius)[0]) / len(y))
        assert max(np.bincount(cells.cells_of(x))) < 4 * knn.SAMPLE_PER_CELL
    assert seen[1] < 1.5 * seen[0] < 15


def test_isolation_steps_flag_extremes(spark):
    vals = [float(v) for v in range(1000)] + [5000.0, -4000.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    scored = {r.x: r.iforest_score for r in ML.iforest_scores(df, "x").collect()}
    assert scored[5000.0] > scored[500.0] and scored[-4000.0] > scored[500.0]
