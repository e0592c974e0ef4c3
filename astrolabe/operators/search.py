"""Vector search operators: J3-J6, J9, W1, A5-A7, L4.

Shape of the work at scale: a *large* candidate table (millions to billions
of vectors, partitioned across the cluster) against a *small* anchor table
(an observed inventory, ~10^2-10^5 rows).  The anchor side is shipped to the
tasks in chunks, one at a time: a chunk is collected, its pass runs, its
partial result is checkpointed, and it is dropped before the next.  Each task
runs a NumPy block kernel over its Arrow batches (re-sliced to a fixed cell
budget) and emits only per-anchor partial top-k rows, never the ``m x n``
pairs.  Partial lists are merged in a tree of fan-in 64 when there are many
candidate partitions, and Spark finishes the exact top-k with a
``row_number`` window, which Catalyst plans as ``WindowGroupLimit`` (partial +
final).  Keys keep their type; results don't depend on the number of chunks.

A distance that is not a number (cosine of a zero vector, NaN components)
makes no neighbour: such pairs are left out everywhere.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe.functions import vectors as V

# Anchors / training rows shipped to every task per chunk (at d=300 about
# 120 MB); larger sides are split into several chunks, each its own pass.
MAX_CHUNK_ROWS = 50_000
# Distance cells materialised at once inside a task (x 8 bytes = 32 MB).
CELL_BUDGET = 4_000_000


def _chunks(df: DataFrame, id_col: str, vec_col: str, extra: list[str], max_rows: int):
    """The small side as ``(number of chunks, ids, matrix, extras)``, collected one chunk at a time."""
    n_chunks = max(1, -(-df.count() // max_rows))
    bucket = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_chunks))
    for i in range(n_chunks):
        part = (df if n_chunks == 1 else df.where(bucket == i)).select(id_col, vec_col, *extra).toPandas()
        part = part[part[vec_col].notna()]
        yield (n_chunks, part[id_col].to_numpy(), V.stack(part[vec_col]),
               {c: part[c].to_numpy() for c in extra})


def _settled(df: DataFrame, n_chunks: int) -> DataFrame:
    """With several chunks: run the pass now, so that its chunk can be dropped."""
    if n_chunks == 1:
        return df
    from astrolabe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _split(it: Iterator[pd.DataFrame], other_rows: int) -> Iterator[pd.DataFrame]:
    """Re-slice Arrow batches so a batch x other-side distance block stays
    within ``CELL_BUDGET`` cells, whatever the batch size and side size."""
    step = max(1, CELL_BUDGET // max(1, other_rows))
    for pdf in it:
        for s in range(0, len(pdf), step):
            yield pdf.iloc[s:s + step]


def _codes(ids: np.ndarray) -> np.ndarray:
    """Order codes of keys of any type, for tie-breaking."""
    return ids if ids.dtype.kind in "iu" else np.unique(ids.astype(str), return_inverse=True)[1]


def _nearest(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``d`` the positions of the ``k`` smallest by (distance, key); NaN last.

    ``ids`` has one key per column.  Only the columns at or below a row's k-th
    distance are sorted.
    """
    d = np.where(np.isnan(d), np.inf, d)
    codes, k = _codes(ids), min(k, d.shape[1])
    if k == 0:
        return np.empty((len(d), 0), dtype=np.int64)
    limit = np.partition(d, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(d), k), dtype=np.int64)
    for r in range(len(d)):
        near = np.flatnonzero(d[r] <= limit[r])
        out[r] = near[np.lexsort((codes[near], d[r][near]))][:k]
    return out


def _nearest_of(q: np.ndarray, refs: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``q`` the positions of its ``k`` nearest ``refs`` by (distance, key), and those distances; NaN last.

    Euclidean distances come from explicit differences, but only for pairs that a product leaves in question: its
    squared distances are off by at most ``slack``, so a pair above the row's k-th by more than twice that is not among
    the ``k``.  Other metrics, and sides with components that aren't finite or are huge, take every pair.
    """
    k = min(k, len(refs))
    if metric != "euclidean" or k == 0 or not len(q) or not (np.abs(q).max(initial=0) < 1e100 and np.abs(refs).max(initial=0) < 1e100):
        d = V.pair_distances(q, refs, metric)
        near = _nearest(d, ids, k)
        return near, np.take_along_axis(d, near, axis=1)
    codes, out, dist = _codes(ids), np.empty((len(q), k), dtype=np.int64), np.empty((len(q), k))
    norms, d, eps = (refs * refs).sum(axis=1), q.shape[1], np.finfo(float).eps
    step = max(1, CELL_BUDGET // 8 // len(refs))   # a piece of the product stays near the core
    for s in range(0, len(q), step):
        part = q[s:s + step]
        own = (part * part).sum(axis=1)
        about = part @ refs.T
        about *= -2.0
        about += own[:, None]
        about += norms
        slack = 4 * (d + 8) * eps * (own + norms.max()) + np.finfo(float).tiny
        limit = np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * slack
        row, col = np.nonzero(about <= limit[:, None])
        exact = np.empty(len(row))
        for c in range(0, len(row), max(1, CELL_BUDGET // d)):
            at = slice(c, c + max(1, CELL_BUDGET // d))
            diff = part[row[at]] - refs[col[at]]
            np.sqrt(np.einsum("ij,ij->i", diff, diff), out=exact[at])
        order = np.lexsort((codes[col], exact, row))
        heads = np.searchsorted(row, np.arange(len(part)))   # at least k pairs a row
        first = order[heads[:, None] + np.arange(k)]
        out[s:s + step], dist[s:s + step] = col[first], exact[first]
    return out, dist


# --------------------------------------------------------------------------
# Exact top-k per anchor, optional near-duplicate exclusion
# --------------------------------------------------------------------------

def _far_from(a_mat: np.ndarray, metric: str, within: float):
    """Column function of a vector: no row of ``a_mat`` is within ``within``."""
    @F.pandas_udf("boolean")
    def far(vec: pd.Series) -> pd.Series:
        out = np.ones(len(vec), dtype=bool)
        step = max(1, CELL_BUDGET // max(1, len(a_mat)))
        for s in range(0, len(vec), step):
            part = vec.iloc[s:s + step]
            known = part.notna().to_numpy()
            if known.any() and len(a_mat):
                d = V.pair_distances(a_mat, V.stack(part[known]), metric)
                out[np.arange(s, s + len(part))[known]] = ~(np.abs(d) <= within).any(axis=0)
        return pd.Series(out)

    return far.asNondeterministic()


def distance_anti_join(candidates: DataFrame, anchors: DataFrame, within: float, *,
                       cand_id: str = "vec_id", anchor_id: str = "anchor_id",
                       vec: str = "vec", anchor_vec: str = "vec", metric: str = "euclidean",
                       max_chunk_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    """Drop candidates within ``within`` of any anchor; a filter on the vector, no shuffle."""
    out = candidates
    for n, _, a_mat, _ in _chunks(anchors, anchor_id, anchor_vec, [], max_chunk_rows):
        out = _settled(out.where(_far_from(a_mat, metric, within)(F.col(vec))), n)
    return out


def knn_topk(candidates: DataFrame, anchors: DataFrame, k: int, *,
             cand_id: str = "vec_id", anchor_id: str = "anchor_id",
             vec: str = "vec", anchor_vec: str = "vec", metric: str = "euclidean",
             exclude_within: float | None = None, anchor_target: str | None = None,
             predict_k: int = 4, max_chunk_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    """J3 + W1 (+ J5): for every anchor the k nearest candidates.

    Returns ``(anchor_id, entry, distance, rank)``; ties are broken by the
    candidate key.  With ``exclude_within`` every candidate whose distance to
    *any* anchor is ``<= exclude_within`` is removed first (this also removes
    the anchors themselves when they are part of the candidate table).

    With ``anchor_target`` a ``prediction`` column is added: the uniform kNN
    regression (L4) of each emitted candidate over the anchors.  In a single
    chunk it comes from the distances already computed for the top-k, for the
    surviving rows only; with several chunks the chosen candidates (anchors x k
    at most) are predicted in a second pass.
    """
    tcol = F.col(anchor_target).cast("double") if anchor_target else F.lit(None).cast("double")
    anchors = anchors.select(F.col(anchor_id).alias("__aid"), F.col(anchor_vec).alias("__avec"),
                             tcol.alias("__ay"))
    cands = candidates.select(F.col(cand_id).alias("__cid"), F.col(vec).alias("__cvec")).where("__cvec IS NOT NULL")
    several = anchors.count() > max_chunk_rows
    if exclude_within is not None and several:
        cands = distance_anti_join(cands, anchors, exclude_within, anchor_id="__aid", vec="__cvec", anchor_vec="__avec",
                                   metric=metric, max_chunk_rows=max_chunk_rows)
    aid_type, cid_type = anchors.schema["__aid"].dataType.simpleString(), cands.schema["__cid"].dataType.simpleString()
    out_schema = f"anchor_id {aid_type}, entry {cid_type}, distance double, prediction double"
    with_pred = anchor_target is not None
    partials = None
    for n_chunks, a_ids, a_mat, ex in _chunks(anchors, "__aid", "__avec", ["__ay"], max_chunk_rows):
        a_y = ex["__ay"].astype(np.float64)
        thr = None if several else exclude_within

        def kernel(it: Iterator[pd.DataFrame], a_ids=a_ids, a_mat=a_mat, a_y=a_y, thr=thr):
            m = len(a_ids)
            best = None
            for pdf in _split(it, m):
                if len(pdf) == 0 or m == 0:
                    continue
                ids = pdf["__cid"].to_numpy()
                d = V.pair_distances(a_mat, V.stack(pdf["__cvec"]), metric)
                if thr is not None:
                    keep = ~(np.abs(d) <= thr).any(axis=0)
                    d, ids = d[:, keep], ids[keep]
                near = _nearest(d, ids, k)
                if near.shape[1] == 0:
                    continue
                rows = np.repeat(np.arange(m), near.shape[1])
                cols = near.ravel()
                pred = np.full(d.shape[1], np.nan)
                if with_pred and not several:
                    used = np.unique(cols)
                    pred[used] = _mean_target(d[:, used].T, a_ids, a_y, predict_k)
                cur = pd.DataFrame({"__row": rows, "entry": ids[cols], "distance": d[rows, cols], "prediction": pred[cols]})
                cur = cur[cur["distance"].notna()]
                cur = cur if best is None else pd.concat([best, cur], ignore_index=True)
                best = cur.sort_values(["__row", "distance", "entry"], kind="mergesort").groupby("__row", sort=False).head(k)
            if best is not None and len(best):
                yield pd.DataFrame({"anchor_id": a_ids[best["__row"].to_numpy()], "entry": best["entry"].to_numpy(),
                                    "distance": best["distance"].to_numpy(), "prediction": best["prediction"].to_numpy()})

        part = _settled(cands.mapInPandas(kernel, out_schema), n_chunks)
        partials = part if partials is None else partials.unionByName(part)

    partials = _tree_topk(partials, k, "anchor_id", ["distance", "entry"])
    w = Window.partitionBy("anchor_id").orderBy("distance", "entry")
    out = partials.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if with_pred and several:
        out = out.drop("prediction")
        chosen = cands.join(out.select(F.col("entry").alias("__cid")).distinct(), "__cid", "left_semi")
        pred = knn_regress(chosen, anchors, predict_k, query_id="__cid", train_id="__aid", target="__ay", vec="__cvec",
                           train_vec="__avec", metric=metric, max_chunk_rows=max_chunk_rows)
        out = (out.join(pred.withColumnRenamed("__cid", "entry"), "entry", "left")
               .select("anchor_id", "entry", "distance", "prediction", "rank"))
    return out if with_pred else out.drop("prediction")


def _tree_topk(partials: DataFrame, k: int, group: str, order: list[str], fan_in: int = 64) -> DataFrame:
    """Merge per-task top-k lists in a tree before the final per-group window.

    Every candidate partition contributes ``k`` rows per anchor, so the final
    window would see ``k x partitions`` rows per anchor in a single task.
    Round-robin the partial rows into ``partitions / fan_in`` tasks that each
    keep only the k best per anchor (streaming, memory ``anchors x k``),
    repeated until at most ``fan_in`` partitions remain.
    """
    try:
        n = partials.rdd.getNumPartitions()
    except Exception:  # Spark Connect: no RDD view; rely on the window's partial limit
        return partials
    schema = partials.schema

    def merge(it):
        best = None
        for pdf in it:
            if len(pdf) == 0:
                continue
            cur = pdf if best is None else pd.concat([best, pdf], ignore_index=True)
            best = cur.sort_values([group] + order, kind="mergesort").groupby(group, sort=False).head(k)
        if best is not None:
            yield best

    while n > fan_in:
        n = -(-n // fan_in)
        partials = partials.repartition(n).mapInPandas(merge, schema)
    return partials


# --------------------------------------------------------------------------
# L4: k-nearest-neighbour regression (training side small, queries large)
# --------------------------------------------------------------------------

def _mean_target(d: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int, weights: str = "uniform") -> np.ndarray:
    """Per row of ``d`` the (weighted) mean target of its ``k`` nearest columns; NaN without any."""
    near = _nearest(d, ids, k)
    return _mean_of(np.take_along_axis(d, near, axis=1), y[near], weights)


def _mean_of(dist: np.ndarray, y: np.ndarray, weights: str = "uniform") -> np.ndarray:
    """Per row the (weighted) mean of ``y`` at distances ``dist``; NaN without any."""
    known = ~np.isnan(dist)
    if weights == "uniform":
        w = known.astype(float)
    else:  # neighbours at distance zero take all the weight
        zero = (dist == 0) & known
        with np.errstate(divide="ignore"):
            w = np.where(zero.any(axis=1, keepdims=True), zero, np.where(known, 1.0 / np.where(known, dist, 1.0), 0.0))
    total = w.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, (w * y).sum(axis=1) / total, np.nan)


def knn_neighbours(queries: DataFrame, train: DataFrame, k: int, *, query_id: str,
                   train_id: str, target: str, vec: str = "vec", train_vec: str = "vec",
                   metric: str = "euclidean", max_chunk_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    """For each query row its k nearest training rows: ``(qid, tid, distance, y, rank)``.

    With one chunk the kernel's lists are final; several chunks' lists are merged per query.
    """
    tr = train.select(F.col(train_id).alias("__tid"), F.col(train_vec).alias("__tvec"),
                      F.col(target).cast("double").alias("__y"))
    qs = queries.select(F.col(query_id).alias("__qid"), F.col(vec).alias("__qvec")).where("__qvec IS NOT NULL")
    schema = (f"qid {qs.schema['__qid'].dataType.simpleString()}, tid {tr.schema['__tid'].dataType.simpleString()}, "
              "distance double, y double, rank int")
    partials, n = None, 1
    for n, t_ids, t_mat, ex in _chunks(tr, "__tid", "__tvec", ["__y"], max_chunk_rows):
        t_y = ex["__y"].astype(np.float64)

        def kernel(it, t_ids=t_ids, t_mat=t_mat, t_y=t_y):
            for pdf in _split(it, len(t_ids)):
                if len(pdf) == 0 or len(t_ids) == 0:
                    continue
                near, dist = _nearest_of(V.stack(pdf["__qvec"]), t_mat, t_ids, k, metric)
                kk, cols = near.shape[1], near.ravel()
                rows = np.repeat(np.arange(len(pdf)), kk)
                out = pd.DataFrame({"qid": pdf["__qid"].to_numpy()[rows], "tid": t_ids[cols], "distance": dist.ravel(),
                                    "y": t_y[cols], "rank": np.tile(np.arange(1, kk + 1, dtype=np.int32), len(pdf))})
                yield out[out["distance"].notna()]

        part = _settled(qs.mapInPandas(kernel, schema), n)
        partials = part if partials is None else partials.unionByName(part)
    if n == 1:
        return partials
    w = Window.partitionBy("qid").orderBy("distance", "tid")
    return partials.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_regress(queries: DataFrame, train: DataFrame, k: int, *, query_id: str,
                train_id: str, target: str, weights: str = "uniform", vec: str = "vec", train_vec: str = "vec",
                metric: str = "euclidean", max_chunk_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    """L4: prediction = mean (uniform) or 1/d-weighted mean of the k nearest targets.

    With distance weights, neighbours at distance zero take all the weight
    (their plain mean), as in the common kNN regressor definition.  A query
    without a neighbour (a zero vector under cosine) has a NULL prediction.
    """
    if train.count() <= max_chunk_rows:  # the kernel sees all neighbours: no shuffle
        tr = train.select(F.col(train_id).alias("__tid"), F.col(train_vec).alias("__tvec"),
                          F.col(target).cast("double").alias("__y"))
        _, t_ids, t_mat, ex = next(_chunks(tr, "__tid", "__tvec", ["__y"], max_chunk_rows))
        t_y = ex["__y"].astype(np.float64)

        @F.pandas_udf("double")
        def predict(v: pd.Series) -> pd.Series:
            out = np.full(len(v), np.nan)
            step = max(1, CELL_BUDGET // max(1, len(t_ids)))
            for s in range(0, len(v), step):
                part = v.iloc[s:s + step]
                known = part.notna().to_numpy()
                if known.any() and len(t_ids):
                    near, dist = _nearest_of(V.stack(part[known]), t_mat, t_ids, k, metric)
                    out[np.arange(s, s + len(part))[known]] = _mean_of(dist, t_y[near], weights)
            return pd.Series(out)

        p = predict(F.col(vec))
        return queries.select(query_id, p.alias("prediction")).withColumn(
            "prediction", F.when(F.isnan("prediction"), None).otherwise(F.col("prediction")))
    nb = knn_neighbours(queries, train, k, query_id=query_id, train_id=train_id, target=target, vec=vec,
                        train_vec=train_vec, metric=metric, max_chunk_rows=max_chunk_rows)
    if weights == "uniform":
        pred = F.avg("y")
    else:
        zero = F.col("distance") == 0
        pred = F.coalesce(
            F.avg(F.when(zero, F.col("y"))),
            F.sum(F.try_divide(F.col("y"), F.col("distance"))) / F.sum(F.try_divide(F.lit(1.0), F.col("distance"))))
    return nb.groupBy(F.col("qid").alias(query_id)).agg(pred.alias("prediction"))


# --------------------------------------------------------------------------
# J4 / J5 / J6 / A5 / A6 / A7
# --------------------------------------------------------------------------

def cluster_semi_join(candidates: DataFrame, anchors: DataFrame, cluster_col: str = "label",
                      anchor_cluster_col: str | None = None) -> DataFrame:
    """Keep candidates whose cluster id occurs among the anchors' clusters.

    The right side is the distinct cluster ids; Spark broadcasts it when its
    size allows.  If the candidate table is partitioned by the cluster column,
    dynamic partition pruning skips whole directories.
    """
    keys = anchors.select(F.col(anchor_cluster_col or cluster_col).alias(cluster_col)).distinct()
    return candidates.join(keys, cluster_col, "left_semi")


def _profile_kernel(it, vec, metric, a_mat, per_batch):
    """Feed ``per_batch`` with the distances of each slice of candidates, without pairs that have none."""
    for pdf in _split(it, len(a_mat)):
        pdf = pdf[pdf[vec].notna()]
        if len(pdf) and len(a_mat):
            per_batch(pdf, V.pair_distances(a_mat, V.stack(pdf[vec]), metric))


def profile_pairs(candidates: DataFrame, anchors: DataFrame, probs: list[float], *, anchor_id: str = "anchor_id",
                  vec: str = "vec", anchor_vec: str = "vec", metric: str = "euclidean",
                  max_chunk_rows: int = MAX_CHUNK_ROWS) -> tuple[dict, list]:
    """Moments (``n, min, max, mean, m2``) and exact percentiles of all anchor x candidate distances.

    No pair leaves its task: the kernel keeps per-task moments and bin counts,
    and a few refining passes (see ``stats.select_ranks``) find the values at
    the wanted ranks.  The driver sees one row per pass and bin.
    """
    from astrolabe.operators import stats

    fields = "iv long, bin long, n long, lo double, hi double, mean double, m2 double"

    def passes(make):
        """Frames of one pass, one per chunk of anchors; ``make(rows)`` returns the per-batch function that fills ``rows``."""
        for _, _, a_mat, _ in _chunks(anchors, anchor_id, anchor_vec, [], max_chunk_rows):
            def kernel(it, a_mat=a_mat):
                rows = {}
                _profile_kernel(it, vec, metric, a_mat, make(rows))
                if rows:
                    yield pd.DataFrame([(*key, *values) for key, values in rows.items()],
                                       columns=["iv", "bin", "n", "lo", "hi", "mean", "m2"])
            yield candidates.select(vec).mapInPandas(kernel, fields)

    def count(rows, iv, at, d):
        """Adds the counts of one batch: ``at`` is the bin of each distance."""
        order = np.argsort(at, kind="stable")
        used, first, size = np.unique(at[order], return_index=True, return_counts=True)
        if not len(used):
            return
        low, high = np.minimum.reduceat(d[order], first), np.maximum.reduceat(d[order], first)
        for u, c, lo, hi in zip(used.tolist(), size.tolist(), low.tolist(), high.tolist()):
            old = rows.get((iv, u), (0, lo, hi, 0.0, 0.0))
            rows[(iv, u)] = (old[0] + c, min(old[1], lo), max(old[2], hi), 0.0, 0.0)

    def merged(frames) -> dict:
        found = {}
        for part in frames:
            for r in part.groupBy("iv", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
                old = found.get((r.iv, r.bin), (0, r.lo, r.hi))
                found[(r.iv, r.bin)] = (old[0] + r.n, min(old[1], r.lo), max(old[2], r.hi))
        return found

    def moments(rows):
        def add(pdf, d):
            d = d[np.isfinite(d)]
            if not len(d):
                return
            n, mean = len(d), float(d.mean())
            m2 = float(((d - mean) ** 2).sum())
            if (-1, 0) in rows:
                n0, lo, hi, mean0, m20 = rows[(-1, 0)]
                total = n0 + n
                rows[(-1, 0)] = (total, min(lo, d.min()), max(hi, d.max()), mean0 + (mean - mean0) * n / total,
                                 m20 + m2 + (mean - mean0) ** 2 * n0 * n / total)
            else:
                rows[(-1, 0)] = (n, d.min(), d.max(), mean, m2)
            count(rows, 0, stats.octave_bin(d), d)
        return add

    # one pass for the moments and the first counts; moments of tasks merge around the mean of their means, which keeps the digits
    whole, first = {"n": 0, "min": None, "max": None, "mean": None, "m2": 0.0}, {}
    for part in passes(moments):
        middle = F.avg(F.when(F.col("iv") == -1, F.col("mean"))).over(Window.partitionBy("iv", "bin"))
        off = F.col("mean") - F.col("mid")
        got = (part.withColumn("mid", middle).groupBy("iv", "bin").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("mid").alias("mid"),
            (F.sum(F.col("n") * off) / F.sum("n")).alias("shift"), F.sum("m2").alias("m2"), F.sum(F.col("n") * off * off).alias("between")).collect())
        for r in got:
            if r.iv == 0:
                old = first.get(r.bin, (0, r.lo, r.hi))
                first[r.bin] = (old[0] + r.n, min(old[1], r.lo), max(old[2], r.hi))
                continue
            mean, m2 = r.mid + r["shift"], r.m2 + r.between - r.n * r["shift"] ** 2
            n0, total = whole["n"], whole["n"] + r.n
            mean0 = whole["mean"] if n0 else mean
            whole = {"n": total, "min": r.lo if not n0 else min(whole["min"], r.lo), "max": r.hi if not n0 else max(whole["max"], r.hi),
                     "mean": mean0 + (mean - mean0) * r.n / total, "m2": whole["m2"] + m2 + (mean - mean0) ** 2 * n0 * r.n / total}

    def histogram(intervals, bins):
        def counts(rows):
            def add(pdf, d):
                d = d[np.isfinite(d)]
                for i, (a, b) in enumerate(intervals):
                    part = d[(d >= a) & (d <= b)]
                    count(rows, i, np.minimum(((part - a) / (b - a) * bins).astype(np.int64), bins - 1), part)
            return add
        return merged(passes(counts))

    return whole, stats.percentiles_by_rank(first, probs, histogram)


def pair_distances(candidates: DataFrame, anchors: DataFrame, *, cand_id: str = "vec_id",
                   anchor_id: str = "anchor_id", vec: str = "vec", anchor_vec: str = "vec",
                   metric: str = "euclidean", max_chunk_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    """All anchor x candidate distances as rows ``(anchor_id, entry, distance)``.

    For matrices whose pairs are the result (F2, A16); profiles over pairs use
    :func:`profile_pairs`.  The anchor side is chunked; output grows as anchors x candidates.
    """
    a = anchors.select(F.col(anchor_id).alias("__aid"), F.col(anchor_vec).alias("__avec"))
    c = candidates.select(F.col(cand_id).alias("__cid"), F.col(vec).alias("__cvec")).where("__cvec IS NOT NULL")
    schema = (f"anchor_id {a.schema['__aid'].dataType.simpleString()}, entry {c.schema['__cid'].dataType.simpleString()}, "
              "distance double")
    out = None
    for n, a_ids, a_mat, _ in _chunks(a, "__aid", "__avec", [], max_chunk_rows):
        def kernel(it, a_ids=a_ids, a_mat=a_mat):
            for pdf in _split(it, len(a_ids)):
                if len(pdf) == 0 or len(a_ids) == 0:
                    continue
                ids = pdf["__cid"].to_numpy()
                d = V.pair_distances(a_mat, V.stack(pdf["__cvec"]), metric)
                rows = pd.DataFrame({"anchor_id": np.repeat(a_ids, len(ids)),
                                     "entry": np.tile(ids, len(a_ids)), "distance": d.ravel()})
                yield rows[rows["distance"].notna()]

        part = _settled(c.mapInPandas(kernel, schema), n)
        out = part if out is None else out.unionByName(part)
    return out


def mean_distances(candidates: DataFrame, anchors: DataFrame, *, cand_id: str = "vec_id", anchor_id: str = "anchor_id",
                   vec: str = "vec", anchor_vec: str = "vec", metric: str = "euclidean",
                   max_chunk_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    """``(entry, mean_d)``: mean distance of each candidate to all anchors, made in the kernel."""
    c = candidates.select(F.col(cand_id).alias("entry"), F.col(vec).alias("__cvec")).where("__cvec IS NOT NULL")
    schema = f"entry {c.schema['entry'].dataType.simpleString()}, s double, n long"
    out, n = None, 1
    for n, _, a_mat, _ in _chunks(anchors, anchor_id, anchor_vec, [], max_chunk_rows):
        def kernel(it, a_mat=a_mat):
            for pdf in _split(it, len(a_mat)):
                if len(pdf) == 0 or len(a_mat) == 0:
                    continue
                d = V.pair_distances(a_mat, V.stack(pdf["__cvec"]), metric)
                yield pd.DataFrame({"entry": pdf["entry"].to_numpy(), "s": np.nansum(d, axis=0), "n": (~np.isnan(d)).sum(axis=0)})

        part = _settled(c.mapInPandas(kernel, schema), n)
        out = part if out is None else out.unionByName(part)
    if n > 1:
        out = out.groupBy("entry").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return out.where("n > 0").select("entry", (F.col("s") / F.col("n")).alias("mean_d"))


def rec_counts(topk: DataFrame) -> DataFrame:
    """A5: how many anchors recommended each candidate."""
    return topk.groupBy("entry").agg(F.count(F.lit(1)).alias("counts"))


def greedy_assignment(candidates: DataFrame, queries: DataFrame, *, cand_id: str = "vec_id",
                      query_id: str = "anchor_id", query_order: str | None = None,
                      vec: str = "vec", query_vec: str = "vec", metric: str = "euclidean",
                      first_k: int = 8) -> DataFrame:
    """Walk queries in order; each takes its nearest not-yet-taken candidate.

    Queries with one vector share one list of nearest rows, as long as there are such queries and ``first_k`` at
    least.  Lists that have a row in common form a component, and the components are walked side by side, each in
    order in its own task.  A list that is used up is made twice as long, and the components are formed and walked
    again: the number of rounds is the logarithm of the longest list, not the number of contested queries.
    Output ``anchor_id, entry, distance, step``.
    """
    from astrolabe.operators import stats
    from astrolabe.operators.components import connected
    from astrolabe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(candidates.sparkSession)
    asked = queries.where(F.col(query_vec).isNotNull()).select(
        F.col(query_id).alias("anchor_id"), F.col(query_vec).alias("__qv"), F.col(query_order or query_id).alias("__ord"))
    total = candidates.count()
    size = lambda n: F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(first_k))))).cast("long")
    groups = (asked.groupBy("__qv").agg(F.min("anchor_id").alias("grp"), F.count(F.lit(1)).alias("n"))
              .select("grp", "__qv", size(F.col("n")).alias("k")).checkpoint(eager=True))
    walkers = (asked.join(groups.select("__qv", "grp"), "__qv").select("anchor_id", "__ord", "grp")).checkpoint(eager=True)
    entry_type = candidates.schema[cand_id].dataType.simpleString()
    id_type, ord_type = (walkers.schema[c].dataType.simpleString() for c in ("anchor_id", "__ord"))

    def lists_of(some: DataFrame) -> DataFrame | None:
        made = None
        for k in sorted(r.k for r in some.select("k").distinct().collect()):      # powers of two
            part = knn_topk(candidates, some.where(F.col("k") == k), min(k, total), cand_id=cand_id, anchor_id="grp", vec=vec,
                            anchor_vec="__qv", metric=metric)
            part = part.select(F.col(part.columns[0]).alias("grp"), "entry", "distance", "rank")
            made = part if made is None else made.unionByName(part)
        return made

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One component: its queries in order take the first free row of their list."""
        lists = {g: list(zip(part["entry"], part["distance"])) for g, part in right.sort_values("rank").groupby("grp")}
        at, taken, out = dict.fromkeys(lists, 0), set(), []
        for r in left.sort_values(["__ord", "anchor_id"]).itertuples(index=False, name=None):
            anchor, order, g = r[:3]
            own = lists.get(g, [])
            while at.get(g, 0) < len(own) and own[at[g]][0] in taken:
                at[g] += 1
            if at.get(g, 0) < len(own):
                entry, distance = own[at[g]]
                taken.add(entry)
                out.append((anchor, order, g, entry, distance))
            else:
                out.append((anchor, order, g, None, None))
        return pd.DataFrame(out, columns=["anchor_id", "__ord", "grp", "entry", "distance"])

    none = candidates.sparkSession.createDataFrame([], f"grp {id_type}, entry {entry_type}, distance double, rank int")
    lists = (lists_of(groups) if total else None) or none
    while True:
        lists = lists.checkpoint(eager=True)
        node = lambda side, c: F.xxhash64(F.lit(side), F.col(c).cast("string"))
        parts = connected(lists.select(node("q", "grp").alias("a"), node("r", "entry").alias("b")))
        placed = lists.join(parts, node("q", "grp") == F.col("node")).select("grp", "entry", "distance", "rank", "root")
        # a query without any list walks alone
        owners = walkers.join(placed.select("grp", "root").distinct(), "grp", "left").select(
            "anchor_id", "__ord", "grp", F.coalesce("root", node("q", "grp")).alias("root"))
        state = (owners.groupBy("root").cogroup(placed.groupBy("root")).applyInPandas(
            walk, f"anchor_id {id_type}, __ord {ord_type}, grp {id_type}, entry {entry_type}, distance double")).checkpoint(eager=True)
        short = groups.where(F.col("k") < total).join(state.where("entry IS NULL").select("grp").distinct(), "grp", "left_semi").checkpoint(eager=True)
        if short.isEmpty():
            break
        groups = (groups.join(short.select("grp", F.lit(2).alias("more")), "grp", "left")
                  .select("grp", "__qv", (F.col("k") * F.coalesce("more", F.lit(1))).alias("k"))).checkpoint(eager=True)
        longer = lists_of(groups.join(short.select("grp"), "grp", "left_semi"))
        lists = lists.join(short.select("grp"), "grp", "left_anti").select("grp", "entry", "distance", "rank").unionByName(longer)
    pos = stats.global_position(state.where("entry IS NOT NULL").select("anchor_id", "entry", "distance", "__ord"), ["__ord", "anchor_id"], "step")
    return pos.select("anchor_id", "entry", "distance", F.col("step").cast("long").alias("step"))


def distance_profile(candidates: DataFrame, anchors: DataFrame, probs: list[float], names: list[str],
                     digits: int = 6, **options) -> DataFrame:
    """Min / max / mean / population std and percentiles over all pairs, as one row."""
    m, values = profile_pairs(candidates, anchors, probs, **options)
    std = float(np.sqrt(max(0.0, m["m2"] / m["n"]))) if m["n"] else None
    row = [m["min"], m["max"], m["mean"], std, *values]
    names = ["d_min", "d_max", "d_mean", "d_std", *names]
    out = candidates.sparkSession.createDataFrame([tuple(None if x is None else float(x) for x in row)],
                                                  ", ".join(f"{n} double" for n in names))
    return out.select(*[round6(c, digits).alias(c) for c in out.columns])


def distant_flag(candidates: DataFrame, anchors: DataFrame, upper_percentile: float, const: float, **options) -> DataFrame:
    """Per candidate mean distance to all anchors; flag above the global
    percentile of all pair distances, and above a constant."""
    chosen = {k: v for k, v in options.items() if k != "cand_id"}
    _, (upper,) = profile_pairs(candidates, anchors, [upper_percentile], **chosen)
    m = mean_distances(candidates, anchors, **options)
    return m.select("entry", round6("mean_d").alias("mean_d"), (F.col("mean_d") > F.lit(upper).cast("double")).alias("above_pct"),
                    (F.col("mean_d") > const).alias("above_const"))
