"""Forest grid against plain trees: truncated depths, fewer trees, leaf sizes, feature shares, layouts."""

import numpy as np

from astrolabe.operators import forest
from astrolabe.operators.forest import BINS, Setting, grid_scores, settings_grid


def made(n=180, d=5):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d))
    y = np.round(3 * (x[:, 1] > 0.3) + 2 * (x[:, 3] > 0) * (x[:, 0] > 0) + rng.integers(0, 2, n)).astype(float)
    return x, y, np.arange(n) * 7, np.arange(n) % 3


def frame(spark, x, y, key, fold, parts=3):
    rows = [(int(k), v.tolist(), float(t), int(f)) for k, v, t, f in zip(key, x, y, fold)]
    return spark.createDataFrame(rows, "k long, vec array<double>, y double, fold int").repartition(parts)


def plain_tree(b, y, w, depth, min_leaf, share, tree, node=0, level=0):
    """Nested ``(mean, feature, bin, left, right)``."""
    mean = (w * y).sum() / w.sum()
    d = b.shape[1]
    allowed = range(d)
    take = max(1, int(np.ceil(share * d)))
    if take < d:
        allowed = np.argsort(forest._hash(np.arange(d), tree, node, 42), kind="stable")[:take]
    best = None
    for f in sorted(allowed):
        for cut in range(BINS - 1):
            left = b[:, f] <= cut
            wl, wr = w[left].sum(), w[~left].sum()
            if level >= depth or min(wl, wr) < min_leaf or min(wl, wr) <= 0:
                continue
            base = (w * y).sum() ** 2 / w.sum()
            gain = (w * y)[left].sum() ** 2 / wl + (w * y)[~left].sum() ** 2 / wr - base
            if gain > 1e-10 * abs(base) and (best is None or np.round(gain / abs(base), 10) > best[0]):
                best = (np.round(gain / abs(base), 10), f, cut, left)
    if best is None:
        return mean, None, None, None, None
    _, f, cut, left = best
    return (mean, f, cut, plain_tree(b[left], y[left], w[left], depth, min_leaf, share, tree, 2 * node + 1, level + 1),
            plain_tree(b[~left], y[~left], w[~left], depth, min_leaf, share, tree, 2 * node + 2, level + 1))


def predict(tree, row):
    while tree[1] is not None:
        tree = tree[4] if row[tree[1]] > tree[2] else tree[3]
    return tree[0]


def plain_scores(x, y, key, fold, s: Setting, bootstrap=True):
    b = forest._binned(x, x.min(axis=0), x.max(axis=0))
    mse = []
    for f in sorted(set(fold)):
        inside, trees = fold != f, []
        for t in range(s.n_trees):
            w = forest._bootstrap(key, t, 42) if bootstrap else np.ones(len(y))
            use = inside & (w > 0)
            trees.append(plain_tree(b[use], y[use], w[use], s.max_depth, s.min_leaf, s.feature_share, t))
        p = np.mean([[predict(t, r) for r in b[~inside]] for t in trees], axis=0)
        mse.append(np.mean((y[~inside] - p) ** 2))
    return np.mean(mse), np.std(mse)


def test_grid_equals_plain_forests(spark):
    x, y, key, fold = made()
    grid = settings_grid([1, 3], [1, 4], [1, 9], [0.5, 1.0])
    got = {Setting(r.max_depth, r.n_trees, r.min_leaf, r.feature_share): (r.mean_mse, r.std_mse)
           for r in grid_scores(frame(spark, x, y, key, fold), "k", "vec", "y", "fold", grid).collect()}
    assert set(got) == set(grid)
    for s in grid:
        assert np.allclose(got[s], plain_scores(x, y, key, fold, s)), s


def test_layout_missing_rows_and_constant_features(spark):
    x, y, key, fold = made(90)
    x[:, 2] = 1.5
    grid = settings_grid([2], [3], [2], [1.0])
    odd = spark.createDataFrame([(1, None, 1.0, 0), (2, x[0].tolist(), None, 0)], "k long, vec array<double>, y double, fold int")
    scores = [tuple(grid_scores(frame(spark, x, y, key, fold, n).unionByName(odd), "k", "vec", "y", "fold", grid).first()) for n in (1, 6)]
    assert np.allclose(scores[0], scores[1], rtol=1e-12) and np.isclose(scores[0][4], plain_scores(x, y, key, fold, grid[0])[0])


def test_bootstrap_weights_are_poisson():
    w = forest._bootstrap(np.arange(20_000), 3, 1)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.02
    assert abs(np.corrcoef(w, forest._bootstrap(np.arange(20_000), 4, 1))[0, 1]) < 0.03
