"""Regression forests for a whole grid of settings at once.

Features are cut into ``BINS`` equal steps between their smallest and largest values.
Trees grow level by level, and one pass over the rows serves a level of *all* trees: of
every fold, every tree and every combination of leaf size and feature share.  A task sums,
per tree and node, weights and targets by feature and bin; the sums are added up in two
steps (no task takes more than about a ``FAN_IN``-th of the others' sums), and the best split of
every node is found where its sums meet.  Only splits reach the driver: their number
follows the grid, not the rows.

Settings that differ in depth or in the number of trees share trees: a shallower tree is the
top of a deeper one, a smaller forest the first trees of a larger.  So a grid costs its
leaf sizes times its feature shares, and one last pass scores every setting.

Draws (bootstrap weights, features of a node) are hashes of seed, tree and key or node, and
sums of equal gains go to the first feature and bin, so results don't depend on the layout.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 16
FAN_IN = 32


@dataclass(frozen=True)
class Setting:
    max_depth: int
    n_trees: int
    min_leaf: int
    feature_share: float


def settings_grid(max_depth, n_trees, min_leaf, feature_share) -> list[Setting]:
    return [Setting(*x) for x in product(max_depth, n_trees, min_leaf, feature_share)]


def _hash(*parts) -> np.ndarray:
    """A 64-bit scramble of integer arrays, broadcast against each other."""
    x = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
    return x


def _bootstrap(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weights: how often a draw with replacement takes each row."""
    u = _hash(key, tree, seed).astype(np.float64) / 2.0 ** 64
    steps = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))
    return np.searchsorted(steps, u, side="right").astype(np.float64)


class Forest:
    """Trees of all fits: ``fits`` are ``(fold, min_leaf, feature_share, tree)``; per fit and node a split and a mean."""

    def __init__(self, fits: list, depth: int, n_features: int):
        self.fits, self.depth, self.n_features = fits, depth, n_features
        nodes = (1 << (depth + 1)) - 1
        self.feature = np.full((len(fits), nodes), -1, dtype=np.int32)
        self.bin = np.zeros((len(fits), nodes), dtype=np.int32)
        self.value = np.full((len(fits), nodes), np.nan)

    def path(self, fit: int, binned: np.ndarray, levels: int) -> np.ndarray:
        """``rows x (levels + 1)``: the node of each row at each depth; it stays where its node has no split."""
        at = np.zeros(len(binned), dtype=np.int64)
        out = [at]
        rows = np.arange(len(binned))
        for _ in range(levels):
            f = self.feature[fit, at]
            right = binned[rows, np.maximum(f, 0)] > self.bin[fit, at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
            out.append(at)
        return np.stack(out, axis=1)


def _binned(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    step = np.where(high > low, high - low, 1.0)
    return np.clip(np.floor((x - low) / step * BINS), 0, BINS - 1).astype(np.int32)


def _level_sums(batches, forest: Forest, level: int, low, high, seed: int, bootstrap: bool):
    """Per fit and node of a level: weights and weighted targets by feature and bin."""
    d = forest.n_features
    first = (1 << level) - 1
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        if not len(pdf):
            continue
        b = _binned(np.vstack(pdf["vec"].to_numpy()), low, high)
        key, fold, y = pdf["key"].to_numpy(), pdf["fold"].to_numpy(), pdf["y"].to_numpy(dtype=float)
        cell = np.arange(d) * BINS + b
        weights: dict[int, np.ndarray] = {}
        for k, (out_fold, _, _, tree) in enumerate(forest.fits):
            at = forest.path(k, b, level)[:, -1] - first
            if tree not in weights:
                weights[tree] = _bootstrap(key, tree, seed) if bootstrap else np.ones(len(key))
            w = np.where(fold == out_fold, 0.0, weights[tree])
            use = (at >= 0) & (w > 0)
            if not use.any():
                continue
            index = (at[use, None] * d * BINS + cell[use]).ravel()
            size = (1 << level) * d * BINS
            part = np.stack([np.bincount(index, np.repeat(v, d), size) for v in (w[use], w[use] * y[use])])
            sums[k] = sums.get(k, 0.0) + part
    for k, part in sums.items():
        yield pd.DataFrame({"fit": [k], "sums": [part.astype("<f8").tobytes()]})


def _added(part: pd.DataFrame) -> np.ndarray:
    return np.sum([np.frombuffer(s, "<f8") for s in part["sums"]], axis=0)


def _best_splits(part: pd.DataFrame, forest: Forest, level: int, seed: int) -> pd.DataFrame:
    """One fit's nodes of a level: ``fit, node, value, feature, bin`` (feature -1: no split)."""
    k = int(part["fit"].iloc[0])
    _, min_leaf, share, tree = forest.fits[k]
    d = forest.n_features
    w, s = _added(part).reshape(2, 1 << level, d, BINS)
    rows = []
    take = max(1, int(np.ceil(share * d)))
    for node in range(1 << level):
        total, target = w[node, 0].sum(), s[node, 0].sum()
        if total <= 0:
            continue
        at = node + (1 << level) - 1
        left, left_s = np.cumsum(w[node], axis=1)[:, :-1], np.cumsum(s[node], axis=1)[:, :-1]
        right, right_s = total - left, target - left_s
        ok = (left >= min_leaf) & (right >= min_leaf) & (left > 0) & (right > 0)
        if take < d:
            chosen = np.argsort(_hash(np.arange(d), tree, at, seed), kind="stable")[:take]
            ok &= np.isin(np.arange(d), chosen)[:, None]
        gain = np.where(ok, left_s ** 2 / np.where(ok, left, 1) + right_s ** 2 / np.where(ok, right, 1), -np.inf) - target ** 2 / total
        scale = max(abs(target ** 2 / total), 1e-300)
        best = int(np.argmax(np.round(gain / scale, 10)))        # the first of equal ones
        f, cut = divmod(best, BINS - 1)
        splits = level < forest.depth and ok[f, cut] and gain[f, cut] > 1e-10 * scale
        rows.append((k, at, target / total, f if splits else -1, cut if splits else 0))
    return pd.DataFrame(rows, columns=["fit", "node", "value", "feature", "bin"])


def fit_grid(rows: DataFrame, settings: list[Setting], folds: list[int], low, high, seed: int, bootstrap: bool) -> Forest:
    """Trees of every fold for ``settings``; ``rows`` has ``key, vec, y, fold``."""
    kinds = sorted({(s.min_leaf, s.feature_share) for s in settings})
    trees = {kind: max(s.n_trees for s in settings if (s.min_leaf, s.feature_share) == kind) for kind in kinds}
    fits = [(fold, *kind, t) for fold in folds for kind in kinds for t in range(trees[kind])]
    forest = Forest(fits, max(s.max_depth for s in settings), len(low))
    for level in range(forest.depth + 1):
        def sums(batches):     # these run within this turn of the loop
            return _level_sums(batches, forest, level, low, high, seed, bootstrap)

        def add(part):
            return pd.DataFrame({"fit": part["fit"].iloc[:1], "sums": [_added(part).tobytes()]})

        def best(part):
            return _best_splits(part, forest, level, seed)

        made = rows.mapInPandas(sums, "fit int, sums binary").withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
        some = made.groupBy("fit", "lot").applyInPandas(add, "fit int, sums binary")
        for r in some.groupBy("fit").applyInPandas(best, "fit int, node int, value double, feature int, bin int").collect():
            forest.value[r.fit, r.node], forest.feature[r.fit, r.node], forest.bin[r.fit, r.node] = r.value, r.feature, r.bin
    return forest


def _score(batches, forest: Forest, settings: list[Setting], low, high):
    """Per fold and setting: rows, squared errors, targets and their squares of the rows that the fold holds out."""
    sums: dict[tuple, np.ndarray] = {}
    of = {f: k for k, f in enumerate(forest.fits)}
    for pdf in batches:
        for fold, own in pdf.groupby("fold"):
            b, y = _binned(np.vstack(own["vec"].to_numpy()), low, high), own["y"].to_numpy(dtype=float)
            paths: dict[int, np.ndarray] = {}
            for k, (out_fold, *_rest) in enumerate(forest.fits):
                if out_fold == fold:
                    paths[k] = forest.value[k][forest.path(k, b, forest.depth)]
            for i, s in enumerate(settings):
                own_trees = [paths[of[fold, s.min_leaf, s.feature_share, t]][:, s.max_depth] for t in range(s.n_trees)]
                p = np.nanmean(own_trees, axis=0) if own_trees else np.full(len(y), np.nan)
                known = ~np.isnan(p)
                part = np.array([known.sum(), ((y - p)[known] ** 2).sum(), y[known].sum(), (y[known] ** 2).sum()])
                sums[fold, i] = sums.get((fold, i), 0.0) + part
    if sums:
        yield pd.DataFrame([(int(f), i, *v) for (f, i), v in sums.items()], columns=["fold", "setting", "n", "sse", "sy", "syy"])


def grid_scores(df: DataFrame, key: str, vec: str, y: str, fold: str, settings: list[Setting], seed: int = 42,
                bootstrap: bool = True) -> DataFrame:
    """L10 for trees: every setting's cross-validated scores: ``max_depth, n_trees, min_leaf, feature_share, mean_mse, std_mse,
    mean_r2, rank``.

    ``key`` is an integer, ``fold`` the column of the fold that holds the row out.  Rows without vector or target take no part.
    """
    spark = df.sparkSession
    rows = (df.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec"),
                      F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
            .where("vec IS NOT NULL AND y IS NOT NULL AND fold IS NOT NULL"))
    # one pass for the ranges of the features (d rows) and one for the folds
    ends = (rows.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
            .orderBy("i").collect())
    folds = [r.fold for r in rows.select("fold").distinct().orderBy("fold").collect()]
    low, high = np.array([r.lo for r in ends]), np.array([r.hi for r in ends])
    forest = fit_grid(rows, settings, folds, low, high, seed, bootstrap)

    def score(batches):
        return _score(batches, forest, settings, low, high)

    parts = (rows.mapInPandas(score, "fold int, setting int, n double, sse double, sy double, syy double")
             .groupBy("fold", "setting").agg(*[F.sum(c).alias(c) for c in ("n", "sse", "sy", "syy")]))
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r2 = F.when(spread > 1e-12 * F.col("syy"), 1 - F.col("sse") / spread)
    from pyspark.sql import Window
    named = spark.createDataFrame([(i, s.max_depth, s.n_trees, s.min_leaf, s.feature_share) for i, s in enumerate(settings)],
                                  "setting int, max_depth int, n_trees int, min_leaf int, feature_share double")
    mean = (parts.groupBy("setting").agg(F.avg(F.col("sse") / F.col("n")).alias("mean_mse"), F.stddev_pop(F.col("sse") / F.col("n")).alias("std_mse"),
                                         F.avg(r2).alias("mean_r2")))
    place = F.rank().over(Window.orderBy(F.round("mean_mse", 9)))   # one row per setting
    return named.join(mean, "setting").withColumn("rank", place).drop("setting")
