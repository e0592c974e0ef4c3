"""Regression models applied to tables.

Training sides here are small (an observed inventory) or are reduced to
sufficient statistics in one distributed pass; predictions always run per
Arrow batch inside the tasks over the full candidate table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolabe.functions import schema as S
from astrolabe.functions import vectors as V
from astrolabe.operators import gram
from astrolabe.operators.gp import GPModel, fit_gp  # noqa: F401
from astrolabe.operators.search import _split
from astrolabe.session import ensure_checkpoint_dir

# ---- kernels --------------------------------------------------------------------------

@dataclass
class Kernel:
    """const * RBF(length) + rq_const * RationalQuadratic(rq_length, rq_alpha) + dot_const * (dot_sigma² + a·b) + bias;
    white noise on the diagonal."""
    const: float = 1.0
    length: float = 1.0
    rq_const: float = 0.0
    rq_length: float = 1.0
    rq_alpha: float = 1.0
    dot_const: float = 0.0
    dot_sigma: float = 1.0
    bias: float = 0.0
    noise: float = 1e-2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = V.squared_distances(a, b)
        k = np.exp(d2 * (-1 / (2 * self.length ** 2)))
        k *= self.const
        k += self.bias
        if self.rq_const:
            d2 *= 1 / (2 * self.rq_alpha * self.rq_length ** 2)
            d2 += 1
            k += self.rq_const * d2 ** (-self.rq_alpha)
        if self.dot_const:
            k = k + self.dot_const * (self.dot_sigma ** 2 + a @ b.T)
        return k

    def diag(self, a: np.ndarray) -> np.ndarray:
        same = np.full(len(a), self.const + self.bias + self.rq_const)
        return same + self.dot_const * (self.dot_sigma ** 2 + (a * a).sum(axis=1)) if self.dot_const else same


# ---- L8: covariance among a list of rows ----------------------------------------------

def gp_covariance_table(model: GPModel, rows: DataFrame, *, key: str, vec: str,
                        max_chunk_rows: int | None = None) -> DataFrame:
    """Posterior covariance among a set of rows as ``(i, j, cov)``; the result is the matrix.

    The rows are shipped to the tasks one chunk at a time; each task emits the
    covariance of its own rows against the chunk.
    """
    from astrolabe.operators import search
    key_type = rows.schema[key].dataType.simpleString()
    out, covariance = None, model.covariance
    for n, ids, x, _ in search._chunks(rows, key, vec, [], max_chunk_rows or search.MAX_CHUNK_ROWS):
        def kernel(it, ids=ids, x=x):
            for pdf in _split(it, len(ids)):
                if len(pdf) and len(ids):
                    cov = covariance(np.vstack(pdf[vec].to_numpy()), x)
                    yield pd.DataFrame({"i": np.repeat(pdf[key].to_numpy(), len(ids)), "j": np.tile(ids, len(pdf)), "cov": cov.ravel()})

        part = search._settled(rows.select(key, vec).mapInPandas(kernel, f"i {key_type}, j {key_type}, cov double"), n)
        out = part if out is None else out.unionByName(part)
    return out


# ---- L3: Bayesian ridge -------------------------------------------------------------------

@dataclass
class BayesRidgeModel:
    coef: np.ndarray
    intercept: float
    alpha: float            # noise precision
    lambda_: float          # weight precision
    sigma: np.ndarray       # posterior covariance of coef
    x_mean: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, df: DataFrame, vec: str, mean_col: str = "br_mean", std_col: str = "br_std") -> DataFrame:
        return _in_one_pass(df, vec, [((mean_col, std_col), self)])

    def arrays(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and std per row of ``x``."""
        xc = x - self.x_mean
        return x @ self.coef + self.intercept, np.sqrt(1.0 / self.alpha + np.einsum("bi,bi->b", xc @ self.sigma, xc))


def fit_bayes_ridge(df: DataFrame, vec: str, target: str, n_iter: int = 300, tol: float = 1e-3,
                    alpha_1: float = 1e-6, alpha_2: float = 1e-6, lambda_1: float = 1e-6,
                    lambda_2: float = 1e-6, stats=None) -> BayesRidgeModel:
    """L3: evidence-maximising Bayesian ridge on centred sufficient statistics.

    Gamma-prior updates of the noise precision (alpha) and weight precision
    (lambda) alternate with the posterior mean until the coefficients settle.
    ``stats``: the statistics' row, if it is there already.
    """
    st = gram.vector_stats(df, vec, target).collect()[0] if stats is None else stats
    n, sx, sy, syy = float(st["n"]), np.asarray(st["sx"]), float(st["sy"]), float(st["syy"])
    d = len(sx)
    xtx, xty = np.asarray(st["xtx"]).reshape(d, d), np.asarray(st["xty"])
    mx, my = sx / n, sy / n
    cxx = xtx - n * np.outer(mx, mx)
    cxy = xty - n * mx * my
    cyy = syy - n * my * my
    eig = np.clip(np.linalg.eigvalsh(cxx), 0, None)
    alpha, lam = 1.0 / (cyy / n + 1e-12), 1.0
    coef = np.zeros(d)
    for _ in range(n_iter):
        a = lam * np.eye(d) + alpha * cxx
        new = alpha * np.linalg.solve(a, cxy)
        sse = cyy - 2 * new @ cxy + new @ cxx @ new
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (gamma + 2 * lambda_1) / (float(new @ new) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (sse + 2 * alpha_2)
        done = np.sum(np.abs(coef - new)) < tol
        coef = new
        if done:
            break
    sigma = np.linalg.inv(lam * np.eye(d) + alpha * cxx)
    mx, my = mx + np.asarray(st["cx"]), my + float(st["cy"])  # back to the columns' own coordinates
    return BayesRidgeModel(coef, float(my - mx @ coef), float(alpha), float(lam), sigma, mx)


# ---- L5 / L6: trees with pyspark.ml ----------------------------------------------------

def fit_forest(df: DataFrame, vec: str, target: str, n_trees: int = 20, max_depth: int = 5, seed: int = 42):
    """``ml.RandomForestRegressor``; ``featureImportances`` on the model."""
    from pyspark.ml.regression import RandomForestRegressor
    feats = df.withColumn("__features", array_to_vector(F.col(vec)))
    return RandomForestRegressor(featuresCol="__features", labelCol=target, numTrees=n_trees,
                                 maxDepth=max_depth, seed=seed).fit(feats)


def fit_boosted(df: DataFrame, vec: str, target: str, learning_rate: float = 0.1, n_estimators: int = 20,
                subsample: float = 0.8, max_depth: int = 3, seed: int = 42):
    """``ml.GBTRegressor`` (stepSize, maxIter, subsamplingRate, maxDepth)."""
    from pyspark.ml.regression import GBTRegressor
    feats = df.withColumn("__features", array_to_vector(F.col(vec)))
    return GBTRegressor(featuresCol="__features", labelCol=target, stepSize=learning_rate,
                        maxIter=n_estimators, subsamplingRate=subsample, maxDepth=max_depth,
                        seed=seed).fit(feats)


def tree_predict(model, df: DataFrame, vec: str, out: str) -> DataFrame:
    return (model.setPredictionCol(out).transform(df.withColumn("__features", array_to_vector(F.col(vec))))
            .drop("__features"))


def importances(model, spark) -> DataFrame:
    imp = model.featureImportances.toArray()
    return spark.createDataFrame(pd.DataFrame({"feature": np.arange(len(imp)), "importance": imp}))


# ---- L2 on wide vectors + L27 ------------------------------------------------------------

@dataclass
class LinearModel:
    coef: np.ndarray
    intercept: float

    def predict(self, df: DataFrame, vec: str, out: str = "linear") -> DataFrame:
        return _in_one_pass(df, vec, [((out,), self)])

    def arrays(self, x: np.ndarray) -> tuple[np.ndarray]:
        """Prediction per row of ``x``."""
        return (x @ self.coef + self.intercept,)


def fit_ridge_vec(df: DataFrame, vec: str, target: str, alpha: float = 1.0, stats=None) -> LinearModel:
    """L1/L2 on an array feature column: one Gramian pass (``stats``: its row, if it is there already), a d x d solve."""
    st = gram.vector_stats(df, vec, target).collect()[0] if stats is None else stats
    b0, w = gram.solve_ridge(float(st["n"]), st["sx"], float(st["sy"]), st["xtx"], st["xty"], alpha)
    b0 = gram.original_intercept(b0, w, (np.asarray(st["cx"]), float(st["cy"])))
    return LinearModel(w, b0)


#: Rows of a task of :func:`spread`: the fewest that are worth one, and the most.
TASK_ROWS = 1024, 16384


def spread(df: DataFrame, key: str, vec: str) -> DataFrame:
    """The rows dealt evenly to all cores, in the order of their keys, and kept in the shared folder.

    For tables that many passes read: a file of few row groups otherwise gives each pass as few tasks, however many cores
    there are.  Which rows share a task comes from the rows, so models that draw by task don't depend on the files.
    """
    least, most = TASK_ROWS
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-n // least), cores * -(-n // (cores * most)))
    if tasks <= 1:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartition(tasks, F.xxhash64(key, vec)).sortWithinPartitions(key, vec).checkpoint()


def _in_one_pass(df: DataFrame, vec: str, models: list) -> DataFrame:
    """The columns of several ``(names, model with arrays())`` per Arrow slice: one Python pass, and one worker a task, for all."""
    cols = df.columns
    rows = max([len(m.x) for _, m in models if isinstance(m, GPModel)], default=1)
    given = [(names, m.in_tasks(df.sparkSession) if isinstance(m, GPModel) else m) for names, m in models]

    def kernel(it):
        for part in _split(it, rows):
            if len(part) == 0:
                continue
            x = np.vstack(part[vec].to_numpy())
            out = part[cols].copy()
            for names, mdl in given:
                for name, values in zip(names, mdl.arrays(x)):
                    out[name] = values
            yield out

    return df.mapInPandas(kernel, S.extend(df.schema, *[(name, "double") for names, _ in models for name in names]))


def score_all_models(df: DataFrame, vec: str, models: dict) -> DataFrame:
    """One prediction column per model; neighbouring models that score Arrow batches share a pass, trees are ml transforms."""
    out, together = df, []

    def flush():
        nonlocal out, together
        if together:
            out, together = _in_one_pass(out, vec, together), []

    for name, mdl in models.items():
        if hasattr(mdl, "featureImportances") or hasattr(mdl, "trees"):
            flush()
            out = tree_predict(mdl, out, vec, name)
        elif isinstance(mdl, GPModel) and len(mdl.factor.groups()) > 1:   # several passes of its own
            flush()
            out = mdl.predict(out, vec, f"{name}_mean", f"{name}_std")
        else:
            together.append(((f"{name}_mean", f"{name}_std") if isinstance(mdl, (GPModel, BayesRidgeModel)) else (name,), mdl))
    flush()
    return out
