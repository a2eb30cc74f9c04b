"""Ridge from moment matrices against numpy on the rows themselves."""

import numpy as np
import pytest

from millrace.operators import linear


def test_each_fold_is_the_fit_on_the_others(spark):
    rng = np.random.default_rng(6)
    n = 400
    x = rng.normal(1e6, 3, (n, 3)) * [1, 1e-3, 5]
    y = 7e5 + x @ [2.0, -300.0, 0.4] + rng.normal(0, 1, n)
    x[rng.random((n, 3)) < 0.1] = np.nan
    x = np.column_stack([x, np.full(n, 3.0)])  # a constant column
    fold = rng.integers(0, 4, n)
    rows = [(i, *(None if np.isnan(v) and i % 2 else float(v) for v in r), float(t), int(f)) for i, (r, t, f) in enumerate(zip(x, y, fold))]
    rows.append((n, 1.0, 1.0, 1.0, 3.0, None, 0))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, fold int").repartition(5)
    models = linear.fold_models(df, ["a", "b", "c", "d"], "y", "fold", 4, penalty=2.0)
    got = {r.id: r.prediction for r in linear.out_of_fold(df, models, "fold").collect()}
    for f in range(4):
        train = fold != f
        fill = np.nanmedian(x[train], axis=0)
        full = np.where(np.isnan(x), fill, x)
        mean, spread = full[train].mean(0), full[train].std(0)
        spread[3] = 1.0
        z = (full - mean) / spread
        w = np.linalg.solve(z[train].T @ z[train] + 2.0 * np.eye(4), z[train].T @ (y[train] - y[train].mean()))
        expected = z @ w + y[train].mean()
        assert np.allclose([got[i] for i in np.flatnonzero(~train)], expected[~train], rtol=1e-7)
    with pytest.raises(ValueError):
        linear.fold_models(df, ["a"] * 501, "y", "fold", 4)
