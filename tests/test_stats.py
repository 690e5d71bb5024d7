"""Distributed exact quantiles and modes against numpy / brute force."""
import numpy as np

from kpiforge.functions.stats import exact_quantiles, modes


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 50, 3000).astype(float)
    b = rng.normal(10, 3, 3000)
    rows = [(float(x), float(y) if i % 7 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    q = exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0])
    bb = np.array([y for x, y in rows if y is not None])
    assert np.allclose(q["a"], np.percentile(a, [0, 25, 50, 90, 100]))
    assert np.allclose(q["b"], np.percentile(bb, [0, 25, 50, 90, 100]))


def test_quantiles_hot_value(spark):
    # one value holds a third of the rows: still exact, no group collected
    vals = [5.0] * 1000 + list(map(float, range(2000)))
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]
    assert np.allclose(q, np.percentile(vals, [25, 50, 75]))


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    assert modes(df, ["v"]) == {"v": "a"}


def test_quantiles_of_odd_values_and_many_rounds(spark):
    """Signed zeros, infinities, neighbouring doubles and a range over all sizes."""
    near = [1e6 + i * 1e-9 for i in range(5000)]
    wide = [s * 10.0 ** e for e in range(-300, 300, 7) for s in (-1, 1)] + [0.0, -0.0, float("inf")]
    rows = [(near[i], wide[i % len(wide)], None, float("nan")) for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    probs = [0.0, 0.1, 0.37, 0.5, 0.9]
    q = exact_quantiles(df, ["a", "b", "c", "d"], probs)
    assert np.allclose(q["a"], np.percentile(near, [100 * p for p in probs]), rtol=0, atol=1e-12)
    assert np.allclose(q["b"], np.percentile([r[1] for r in rows], [100 * p for p in probs]))
    assert all(np.isnan(q["c"])) and all(np.isnan(q["d"]))
    assert np.isnan(exact_quantiles(df.where("a < 0"), ["a"], [0.5])["a"][0])


def test_pair_correlations(spark, monkeypatch):
    """Missing values, constant columns, several blocks; large offsets lose no digits."""
    from kpiforge.functions import stats
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (500, 7))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 0.1, 500)
    x[:, 2] += 1e9
    x[:, 3] = 5.0
    x[rng.random((500, 7)) < 0.2] = np.nan
    x[:, 6] = np.nan
    cols = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in cols)).repartition(3)
    for block in (128, 3):
        monkeypatch.setattr(stats, "BLOCK", block)
        got = {(r.col1, r.col2): (r.n, r.correlation) for r in stats.pair_correlations(df, cols).collect()}
        assert len(got) == 21
        for (a, b), (n, r) in got.items():
            both = x[~np.isnan(x[:, int(a[1])]) & ~np.isnan(x[:, int(b[1])])][:, [int(a[1]), int(b[1])]]
            assert n == len(both)
            if {"c3", "c6"} & {a, b}:
                assert r is None
            else:
                assert abs(r - np.corrcoef(both.T)[0, 1]) < 1e-6, (a, b)


def test_pair_correlations_of_a_thousand_columns(spark):
    df = spark.range(60).selectExpr(*[f"rand({i}) AS c{i}" for i in range(1000)])
    from kpiforge.functions.stats import pair_correlations
    assert pair_correlations(df, df.columns).count() == 1000 * 999 // 2
