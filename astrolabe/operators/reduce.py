"""Standardisation, PCA, k-means and cluster assignment.

Fits read the table once through distributed statistics (``Summarizer``,
per-task Gramians merged in a tree, or ``pyspark.ml`` estimators); the
d x d algebra (d <= a few hundred) runs on the driver; transforms run per
Arrow batch inside the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolabe.functions import schema as S
from astrolabe.operators import gram


# ---- M5 ---------------------------------------------------------------------------

def moments(df: DataFrame, vec: str) -> DataFrame:
    """Per-dimension mean and *population* std (one ``Summarizer`` pass)."""
    s = df.select(Summarizer.metrics("mean", "variance", "count")
                  .summary(array_to_vector(F.col(vec))).alias("s"))
    n = F.col("s.count").cast("double")
    return s.select(vector_to_array("s.mean").alias("mean"),
                    F.transform(vector_to_array("s.variance"),
                                lambda v: F.sqrt(v * (n - 1) / n)).alias("std"), n.alias("n"))


def standardise(df: DataFrame, vec: str, out: str = "z") -> DataFrame:
    """M5: (x - mean) / population std per dimension; zero std → scale 1."""
    from astrolabe.operators.stats import with_scalars
    m = moments(df, vec).select("mean", "std")
    j = with_scalars(df, m)  # one-row statistics as literals
    z = F.zip_with(F.zip_with(vec, "mean", lambda x, mu: x - mu), "std",
                   lambda c, s: c / F.when(s == 0, F.lit(1.0)).otherwise(s))
    return j.withColumn(out, z).drop("mean", "std")


# ---- M6 ---------------------------------------------------------------------------

def covariance(df: DataFrame, vec: str) -> DataFrame:
    """Population covariance as a long table ``(i, j, cov)`` from one Gramian pass."""
    st = gram.vector_stats(df, vec)

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        n, sx, xtx = float(r["n"]), np.asarray(r["sx"]), np.asarray(r["xtx"])
        d = len(sx)
        mean = sx / n
        cov = xtx.reshape(d, d) / n - np.outer(mean, mean)
        i, j = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
        return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "cov": cov.ravel()})

    return st.groupBy(F.lit(0).alias("__one")).applyInPandas(expand, "i long, j long, cov double")


@dataclass
class PCAModel:
    mean: np.ndarray
    components: np.ndarray          # [k, d], rows sorted by variance, sign-fixed
    explained_variance: np.ndarray  # [k]
    explained_variance_ratio: np.ndarray

    def transform(self, df: DataFrame, vec: str, out: str = "pca") -> DataFrame:
        """Centre and project, per Arrow batch inside the tasks."""
        mean, comp = self.mean, self.components
        cols = df.columns

        def kernel(it):
            for pdf in it:
                if len(pdf) == 0:
                    continue
                x = np.vstack(pdf[vec].to_numpy()) - mean
                res = pdf[cols].copy()
                res[out] = list(x @ comp.T)
                yield res

        return df.mapInPandas(kernel, S.extend(df.schema, (out, "array<double>")))


def fit_pca(df: DataFrame, vec: str, k: int | None = None) -> PCAModel:
    """M6: exact PCA of the mean-centred data (population covariance).

    Sign convention: each component's largest-magnitude loading is positive.
    """
    r = gram.vector_stats(df, vec).collect()[0]  # one row: n, sums, d x d Gramian
    n, sx, xtx = float(r["n"]), np.asarray(r["sx"]), np.asarray(r["xtx"])
    d = len(sx)
    shift = sx / n  # from the centre of the statistics
    cov = xtx.reshape(d, d) / n - np.outer(shift, shift)
    mean = np.asarray(r["cx"]) + shift
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0, None), vecs[:, order].T
    signs = np.sign(vecs[np.arange(d), np.argmax(np.abs(vecs), axis=1)])
    vecs = vecs * signs[:, None]
    k = k or d
    total = vals.sum()
    return PCAModel(mean, vecs[:k], vals[:k], vals[:k] / total if total > 0 else vals[:k])


def variance_table(model: PCAModel, spark) -> DataFrame:
    """Explained variance per component with the running total (for W3 thresholds)."""
    ratio = model.explained_variance_ratio
    pdf = pd.DataFrame({"component": np.arange(len(ratio)), "variance": model.explained_variance,
                        "ratio": ratio, "cumulative": np.cumsum(ratio)})
    return spark.createDataFrame(pdf)


# ---- M7 / M8 -------------------------------------------------------------------------

def fit_kmeans(df: DataFrame, vec: str, k: int = 20, seed: int = 42, max_iter: int = 20):
    """M7: ``pyspark.ml`` k-means (k-means|| init), on the array column as a vector."""
    from pyspark.ml.clustering import KMeans
    feats = df.withColumn("__features", array_to_vector(F.col(vec)))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__features",
                   predictionCol="cluster_id", initMode="k-means||").fit(feats)
    return model


def kmeans_assign(model, df: DataFrame, vec: str) -> DataFrame:
    return (model.transform(df.withColumn("__features", array_to_vector(F.col(vec))))
            .drop("__features"))


def assign_to_centres(df: DataFrame, centres: DataFrame, *, key: str, vec: str = "vec",
                      centre_id: str = "cluster_id", centre_vec: str = "centre") -> DataFrame:
    """M8: nearest centre per row (ties → lowest centre id) with the bounded
    centre table shipped to the tasks."""
    from astrolabe.operators import search
    nb = search.knn_neighbours(df, centres.withColumn("__y", F.lit(0.0)), 1, query_id=key,
                               train_id=centre_id, target="__y", vec=vec, train_vec=centre_vec)
    return nb.select(F.col("qid").alias(key), F.col("tid").alias(centre_id), "distance")


def label_centres(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Centre of each label = mean vector of its rows (Summarizer per group)."""
    return (df.groupBy(label)
            .agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("__m"))
            .select(F.col(label).cast("long").alias("cluster_id"), vector_to_array("__m").alias("centre")))


# ---- M9 / M13 ---------------------------------------------------------------------------

def fit_embedder(df: DataFrame, vec: str, k_pca: int, k_clusters: int, seed: int = 42):
    """Scaler → PCA → k-means as one ``pyspark.ml`` Pipeline.

    ``ml.StandardScaler`` divides by the *sample* std; ``ml.PCA`` does not
    centre, so the scaler centres first (withMean=True).  The embedder is the
    pipeline minus its last stage.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler
    feats = df.withColumn("__features", array_to_vector(F.col(vec)))
    pipe = Pipeline(stages=[
        StandardScaler(withMean=True, withStd=True, inputCol="__features", outputCol="__scaled"),
        PCA(k=k_pca, inputCol="__scaled", outputCol="__pca"),
        KMeans(k=k_clusters, seed=seed, featuresCol="__pca", predictionCol="cluster_id"),
    ])
    model = pipe.fit(feats)
    embedder = PipelineModel(stages=model.stages[:-1])
    return model, embedder


def project_2d(model: PCAModel, df: DataFrame, vec: str) -> DataFrame:
    """M13 (re-aimed): first two principal components as plot coordinates."""
    two = PCAModel(model.mean, model.components[:2], model.explained_variance[:2],
                   model.explained_variance_ratio[:2])
    p = two.transform(df, vec, "__p2")
    return p.withColumn("x", F.get("__p2", 0)).withColumn("y", F.get("__p2", 1)).drop("__p2")
