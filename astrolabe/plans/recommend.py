"""Composite queries R1-R12 built from the operator modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe.constants import DIST_THRES
from astrolabe.operators import search


def recommend(vectors: DataFrame, anchors: DataFrame, *, top: int = 10,
              dist_thres: float = DIST_THRES, cluster: bool = True, n_neighbors: int = 4,
              metric: str = "euclidean", cluster_col: str = "label",
              target_col: str = "label", key: str = "vec_id",
              max_chunk_rows: int = search.MAX_CHUNK_ROWS) -> DataFrame:
    """Recommend unseen items for an observed inventory.

    inventory vectors → cluster semi-join (J4) → near-duplicate anti-join (J5)
    → top-k per anchor (J3/W1) → unique candidates with how often they were
    chosen (A5) → kNN prediction over the inventory (L4) → sort (T1).

    ``vectors`` and ``anchors`` carry ``key``, ``vec array<double>``, the
    cluster column and the target.  Output: ``entry, counts, prediction``.
    """
    cands = search.cluster_semi_join(vectors, anchors, cluster_col) if cluster else vectors
    topk = search.knn_topk(
        cands, anchors.withColumnRenamed(key, "anchor_id"), top, cand_id=key,
        anchor_id="anchor_id", metric=metric, exclude_within=dist_thres,
        anchor_target=target_col, predict_k=n_neighbors, max_chunk_rows=max_chunk_rows)
    agg = topk.groupBy("entry").agg(F.count(F.lit(1)).alias("counts"),
                                    F.first("prediction").alias("prediction"))
    return (agg.select(F.col("entry"), F.col("counts"),
                       round6("prediction").alias("prediction"))
            .orderBy(F.desc("prediction"), F.asc("entry")))
