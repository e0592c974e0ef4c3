"""Building the vector store as one Spark job (the reference's pooling →
vectorising → standardise → PCA → k-means chain), written partitioned by
cluster, and serving recommendations from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolabe.operators import pooling, reduce
from astrolabe.operators import text as X


def build_vector_store(items: DataFrame, key: str, text_col: str, path: str, *, dim: int = 16,
                       k_pca: int = 8, k_clusters: int = 5, seed: int = 42,
                       token_vectors: DataFrame | None = None) -> DataFrame:
    """Item strings → token sentences (M1) → summed token vectors (M3/M4) →
    population standardisation (M5) → PCA (M6) → k-means (M7) → Parquet
    partitioned by ``cluster_id`` (S11).

    ``token_vectors`` is a table of trained vectors (``token, tvec``); by default
    tokens are hashed, where the items lie.  The reduced vectors are checkpointed by the
    write itself: everything downstream reads the store, not the lineage.
    """
    spark: SparkSession = items.sparkSession
    # hashed tokens are summed where the items lie, and their sentences' trigrams are hashed as they are made
    hashed = token_vectors is None
    toks = items.select(key, X.token_sentence(text_col, radius=0 if hashed else 1).alias("tokens"))
    from astrolabe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    # The text work (tokenising, hashing, pooling) is read by the moments, the
    # PCA statistics and the transform: materialise it once in the shared
    # checkpoint folder instead of re-deriving it from the raw text each time.
    pooled = (pooling.pool_hashed(toks, key, "tokens", dim, seed, draws=False, radius=1) if hashed
              else pooling.pool_trained(toks, key, "tokens", token_vectors, "token", "tvec", dim)).checkpoint(eager=True)
    z = reduce.standardise(pooled, "vec", "z")
    pca = reduce.fit_pca(z, "z", k=k_pca)
    # k-means iterates over the reduced vectors, then they are labelled and written
    reduced = pca.transform(z.select(key, "z"), "z", "pca").select(key, "pca").checkpoint(eager=True)
    km = reduce.fit_kmeans(reduced, "pca", k=k_clusters, seed=seed)
    labelled = reduce.kmeans_assign(km, reduced, "pca").select(key, "pca", F.col("cluster_id").cast("int"))
    labelled.write.mode("overwrite").partitionBy("cluster_id").parquet(path)
    return spark.read.parquet(path)
