"""Split algebra against fits made split by split."""

from hashlib import md5

import numpy as np

from astrolabe.operators import splits


def draws(keys, stream, n_splits, size=0.2, seed=42):
    return np.array([[int(md5(f"{seed}_{stream}{s}_{k}".encode()).hexdigest()[:8], 16) / 2 ** 32 < size for s in range(n_splits)] for k in keys])


def made(spark, n=160, d=2):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) + 5
    y = x @ np.arange(1, d + 1) + rng.normal(size=n)
    rows = [(i * 3, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k long, x0 double, x1 double, y double").repartition(3), np.arange(n) * 3, x, y


def fit(x, y):
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def mse(w, x, y):
    return float(np.mean((y - w[0] - x @ w[1:]) ** 2))


def test_shuffle_splits(spark):
    df, k, x, y = made(spark)
    t = draws(k, "ss", 25)
    got = {r.split_id: (r.train_mse, r.test_mse) for r in splits.shuffle_split_scores(df, "k", ["x0", "x1"], "y", 25).collect()}
    for s in range(25):
        w = fit(x[~t[:, s]], y[~t[:, s]])
        assert np.allclose(got[s], (mse(w, x[~t[:, s]], y[~t[:, s]]), mse(w, x[t[:, s]], y[t[:, s]])))


def test_importance_with_pieces_and_missing_rows(spark, monkeypatch):
    monkeypatch.setattr(splits, "CELLS", 400)
    df, k, x, y = made(spark)
    df = df.unionByName(spark.createDataFrame([(7000, 1.0, None, 2.0), (7001, 1.0, 1.0, None)], df.schema))
    t = draws(k, "di", 40)
    err = np.array([mse(fit(x[~t[:, s]], y[~t[:, s]]), x[t[:, s]], y[t[:, s]]) for s in range(40)])
    spread = np.where(t, 0.0, err).std(axis=1)
    got = {r.k: r.importance for r in splits.data_importance(df, "k", ["x0", "x1"], "y", 40).collect()}
    assert set(got) == set(k.tolist()) and np.allclose([got[i] for i in k], spread / spread.min())


def test_learning_curve_on_a_fixed_truth(spark):
    df, k, x, y = made(spark)
    truth = df.where("k >= 420")
    tx, ty = x[k >= 420], y[k >= 420]
    n = int((k < 420).sum())
    t = draws(k, "lc", 4)
    got = {(r.step, r.split_id): r.mse for r in splits.learning_curve(df.where("k < 420"), truth, "k", ["x0", "x1"], "y", [0.3, 0.55, 1.0], n_splits=4).collect()}
    assert {a for a, _ in got} == {int(n * f) for f in (0.3, 0.55, 1.0)}
    for (step, s), value in got.items():
        own = ~t[:step, s]
        assert abs(value - mse(fit(x[:step][own], y[:step][own]), tx, ty)) < 1e-6


def test_few_and_no_rows(spark):
    df, *_ = made(spark, 4)
    assert splits.shuffle_split_scores(df, "k", ["x0"], "y", 12).count() == 12
    none = splits.shuffle_split_scores(df.limit(0), "k", ["x0"], "y", 3).collect()
    assert [(r.split_id, r.train_mse) for r in none] == [(0, None), (1, None), (2, None)]
    assert splits.data_importance(df.limit(0), "k", ["x0"], "y", 3).count() == 0
    assert {r.mse for r in splits.learning_curve(df.limit(0), df, "k", ["x0"], "y", [1.0], n_splits=2).collect()} == {None}
