"""Sufficient statistics for linear models (L1-L3, L10, L14-L21) and metrics.

One distributed pass computes, per group (fold, split, setting, ...), the
Gramian ``XᵀX``, ``Xᵀy``, ``yᵀy`` and ``n`` as ordinary aggregates; Spark
combines them map-side (partial aggregation), so a hot group costs one
partial row per task, not a shuffle of its rows.  Every linear fit, alpha
sweep, fold score and learning-curve point is then a d×d solve on rows of a
tiny table (d ≤ a few hundred), done with NumPy inside ``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe.functions import schema as S
from astrolabe.operators import stats


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- A14 / A15 ---------------------------------------------------------------

def regression_metrics(df: DataFrame, y: str, yhat: str, group: list[str] | None = None,
                       digits: int | None = 6) -> DataFrame:
    """MSE, MSE over rows with y != 0, and R² (1 - SSres / SStot)."""
    res2 = (_c(y) - _c(yhat)) * (_c(y) - _c(yhat))
    aggs = [F.avg(res2).alias("mse"),
            F.avg(F.when(_c(y) != 0, res2)).alias("masked_mse"),
            (1 - F.try_divide(F.sum(res2), F.var_pop(y) * F.count(y))).alias("r2")]
    out = df.groupBy(*(group or [])).agg(*aggs)
    if digits is not None:
        out = out.select(*(group or []), *[round6(c, digits).alias(c) for c in ("mse", "masked_mse", "r2")])
    return out


def fit_gap(train, test) -> Column:
    """|train - test| / (train + test)."""
    return F.try_divide(F.abs(_c(train) - _c(test)), _c(train) + _c(test))


# ---- W4: ordered prefixes ----------------------------------------------------------

def prefix_totals(df: DataFrame, order: list, value: str, fractions: list[float]) -> DataFrame:
    """For each fraction f, count and sum of the first floor(f * n) rows in ``order``."""
    pos = stats.global_position(df, order, "__rn")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    j = stats.with_scalars(pos, n)
    aggs = []
    for i, f in enumerate(fractions):
        inside = F.col("__rn") <= F.floor(F.lit(f) * F.col("__n"))
        aggs += [F.count(F.when(inside, 1)).alias(f"c{i}"), F.sum(F.when(inside, F.col(value))).alias(f"s{i}")]
    wide = j.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.col(f"c{i}").alias("n_rows"),
                                        round6(F.col(f"s{i}")).alias("total"))
                               for i, f in enumerate(fractions)]))
    return wide.select(rows.alias("r")).select("r.*")


# ---- Gramian statistics -------------------------------------------------------------

def _xcols(x) -> list[Column]:
    return [_c(c).cast("double") for c in x]


def column_means(df: DataFrame, x: list, y) -> list[float]:
    """Means of the columns ``x`` and ``y`` (0 where there is none): the centre of the statistics."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate([*_xcols(x), _c(y).cast("double")])]).first()
    return [float(m) if m is not None and np.isfinite(m) else 0.0 for m in row]


def sufficient_stats(df: DataFrame, x: list, y, group: list | None = None, means: list[float] | None = None) -> DataFrame:
    """Per group: ``n, sy, syy, sx_i, sxy_i, sxx_i_j (i <= j)`` as one hash aggregate.

    The sums are taken around the column means of a first pass (``cx_i``, ``cy``,
    literals on every row), so columns with a large offset lose no digits; give
    ``means`` where statistics of several tables meet.  For a
    handful of features (the fold / split / sweep queries) the sums are plain
    aggregate columns; Spark combines them map-side, so the shuffle carries one
    partial row per task and group.  Wide feature vectors use :func:`vector_stats`.
    """
    raw = [*_xcols(x), _c(y).cast("double")]
    d = len(x)
    center = [F.lit(m) for m in (column_means(df, x, y) if means is None else means)]
    xs, yy = [c - m for c, m in zip(raw[:d], center)], raw[d] - center[d]
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(yy).alias("sy"), F.sum(yy * yy).alias("syy")]
    aggs += [F.sum(xs[i]).alias(f"sx_{i}") for i in range(d)]
    aggs += [F.sum(xs[i] * yy).alias(f"sxy_{i}") for i in range(d)]
    aggs += [F.sum(xs[i] * xs[j]).alias(f"sxx_{i}_{j}") for i in range(d) for j in range(i, d)]
    out = df.groupBy(*(group or [])).agg(*aggs)
    return out.select("*", *[center[i].alias(f"cx_{i}") for i in range(d)], center[d].alias("cy"))


def center_of(row, d: int):
    """The point that a statistics row is centred on: ``(cx, cy)``."""
    return np.array([row[f"cx_{i}"] for i in range(d)], float), float(row["cy"])


def original_intercept(b0, w, center) -> float:
    """Intercept in the columns' own coordinates, from one around ``center``."""
    cx, cy = center
    return float(b0 + cy - np.asarray(w) @ cx)


def stats_to_arrays(row, d: int):
    """One stats row (mapping) → (n, sx, sy, syy, xtx, xty) NumPy values, around its centre."""
    n = float(row["n"])
    sx = np.array([row[f"sx_{i}"] for i in range(d)], float)
    xty = np.array([row[f"sxy_{i}"] for i in range(d)], float)
    xtx = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            xtx[i, j] = xtx[j, i] = row[f"sxx_{i}_{j}"]
    return n, sx, float(row["sy"]), float(row["syy"]), xtx, xty


_STAT_SCALARS = ["n", "sy", "syy"]
_STAT_ARRAYS = ["sx", "xty", "xtx"]


def _stream_sum(frame: DataFrame, g: list[str]) -> DataFrame:
    """Sum statistic rows per group inside each task, streaming over Arrow batches
    (memory: one accumulator of size d² per group present in the task)."""
    import pandas as pd

    def kernel(it):
        acc = {}
        for pdf in it:
            for r in pdf.to_dict("records"):
                key = tuple(r[c] for c in g)
                a = acc.get(key)
                if a is None:
                    acc[key] = {c: r[c] for c in _STAT_SCALARS} | {c: np.asarray(r[c], float).copy()
                                                                    for c in _STAT_ARRAYS}
                else:
                    for c in _STAT_SCALARS:
                        a[c] += r[c]
                    for c in _STAT_ARRAYS:
                        a[c] += np.asarray(r[c], float)
        if acc:
            rows = [list(k) + [a["n"], list(a["sx"]), a["sy"], a["syy"], list(a["xty"]), list(a["xtx"])]
                    for k, a in acc.items()]
            yield pd.DataFrame(rows, columns=g + ["n", "sx", "sy", "syy", "xty", "xtx"])

    return frame.mapInPandas(kernel, frame.schema)


def vector_stats(df: DataFrame, vec: str, y: str | None = None, group: list[str] | None = None,
                 fan_in: int = 64, centered: bool = True) -> DataFrame:
    """Gramian of a wide ``array<double>`` column: per group ``n, sx, sy, syy, xty, xtx``,
    around the means ``cx, cy`` of a first pass (around zero with ``centered=False``).

    Each task folds its rows into NumPy partial sums (one output row per task
    and group).  The partial rows are then reduced as a tree: round-robin into
    ``ceil(P / fan_in)`` partitions, streaming sums per task, repeated until one
    partition is left — the DataFrame form of a tree aggregate.  No task ever
    holds more than one d x d accumulator per group.
    """
    import pandas as pd

    g = list(group or [])
    cols = g + [vec] + ([y] if y else [])
    cx, cy = _vector_means(df, vec, y) if centered else (None, 0.0)
    gschema = df.select(*g).schema

    def kernel(it):
        acc = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            keys = list(pdf[g].itertuples(index=False, name=None)) if g else [()] * len(pdf)
            x = np.vstack(pdf[vec].to_numpy())
            x = x if cx is None else x - cx
            yy = (pdf[y].to_numpy(dtype=float) if y else np.zeros(len(pdf))) - cy
            frame = pd.DataFrame({"__k": keys})
            for key, idx in frame.groupby("__k").indices.items():
                xi, yi = x[idx], yy[idx]
                a = acc.setdefault(key, [0, 0.0, 0.0, 0.0, 0.0, 0.0])
                a[0] += len(idx)
                a[1] = a[1] + xi.sum(axis=0)
                a[2] += float(yi.sum())
                a[3] += float(yi @ yi)
                a[4] = a[4] + xi.T @ yi
                a[5] = a[5] + (xi.T @ xi).ravel()
        rows = []
        for key, (n, sx, sy, syy, xty, xtx) in acc.items():
            rows.append(tuple(key) + (n, list(np.atleast_1d(sx)), sy, syy,
                                      list(np.atleast_1d(xty)), list(np.atleast_1d(xtx))))
        if rows:
            yield pd.DataFrame(rows, columns=g + ["n", "sx", "sy", "syy", "xty", "xtx"])

    schema = S.extend(gschema, ("n", "long"), ("sx", "array<double>"), ("sy", "double"),
                      ("syy", "double"), ("xty", "array<double>"), ("xtx", "array<double>"))
    level = df.select(*cols).mapInPandas(kernel, schema)
    try:
        n = level.rdd.getNumPartitions()
    except Exception:  # Spark Connect: assume a wide input
        n = fan_in * fan_in
    while True:
        n = max(1, -(-n // fan_in))
        level = _stream_sum(level.repartition(n), g)
        if n == 1:
            break
    at = F.array(*[F.lit(float(c)) for c in cx]) if cx is not None else F.transform("sx", lambda _: F.lit(0.0))
    return level.withColumn("cx", at).withColumn("cy", F.lit(float(cy)))


def _vector_means(df: DataFrame, vec: str, y: str | None):
    """Means of the components and of ``y``: d + 1 numbers (None for an empty table)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    row = df.select(vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("m"),
                    (F.avg(_c(y).cast("double")) if y else F.lit(0.0)).alias("y")).first()
    return (np.array(row.m, float), float(row.y or 0.0)) if row and row.m else (None, 0.0)


def solve_ridge(n, sx, sy, xtx, xty, alpha: float = 0.0, intercept: bool = True, center=None, normalize: bool = False):
    """Intercept and coefficients from sufficient statistics; the intercept is unpenalised.

    The intercept is in the statistics' own coordinates (see :func:`original_intercept`).
    Without one, the fit goes through the columns' zero, which lies at ``-center``.
    With ``normalize`` each centred column counts as divided by its length, so
    its penalty is ``alpha`` times its sum of squares.
    """
    d = len(sx)
    sx, xty = np.asarray(sx, float), np.asarray(xty, float)
    xtx = np.asarray(xtx, float).reshape(d, d)
    if intercept:
        mx, my = sx / n, sy / n
        a = xtx - n * np.outer(mx, mx)
        b = xty - n * mx * my
    else:
        cx, cy = center if center is not None else (np.zeros(d), 0.0)
        a = xtx + np.outer(sx, cx) + np.outer(cx, sx) + n * np.outer(cx, cx)
        b = xty + sx * cy + cx * sy + n * cx * cy
    a = a + alpha * (np.diag(np.diag(a)) if normalize and intercept else np.eye(d))
    w = np.linalg.lstsq(a, b, rcond=None)[0] if alpha == 0 else np.linalg.solve(a, b)
    if intercept:
        return float(sy / n - sx @ w / n), w
    return float(w @ cx - cy), w


def sse_from_stats(n, sx, sy, syy, xtx, xty, b0, w):
    """Σ(y - b0 - x·w)² from sufficient statistics (evaluation set)."""
    d = len(w)
    xtx = np.asarray(xtx, float).reshape(d, d)
    sx, xty = np.asarray(sx, float), np.asarray(xty, float)
    return float(syy - 2 * b0 * sy - 2 * w @ xty + n * b0 * b0 + 2 * b0 * (sx @ w) + w @ xtx @ w)


def sst_from_stats(n, sy, syy):
    return float(syy - sy * sy / n)


def r2_from_stats(sse, n, sy, syy):
    """1 - SSE / SST; None for a constant target."""
    sst = sst_from_stats(n, sy, syy)
    return 1 - sse / sst if sst > 1e-12 * max(1.0, abs(syy)) else None


# ---- fold algebra: every fit is "all minus one fold" of the same statistics ---------------

def fold_scores(stats: DataFrame, d: int, fold_col: str, alphas: list[float],
                intercept: bool = True, digits: int | None = 6, normalize: bool = False) -> DataFrame:
    """Ridge (alpha=0: OLS) k-fold scores from per-fold statistics.

    Output ``alpha, fold, train_mse, test_mse, test_r2``.  The algebra runs in
    one pandas group over the (folds x d²)-sized statistics table.
    """
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        per = {r[fold_col]: stats_to_arrays(r, d) for _, r in pdf.iterrows()}
        center = center_of(pdf.iloc[0], d)
        tot = [sum(v[i] for v in per.values()) for i in range(6)]
        for alpha in alphas:
            for f, (n_t, sx_t, sy_t, syy_t, xtx_t, xty_t) in sorted(per.items()):
                n_r, sx_r, sy_r, syy_r = tot[0] - n_t, tot[1] - sx_t, tot[2] - sy_t, tot[3] - syy_t
                xtx_r, xty_r = tot[4] - xtx_t, tot[5] - xty_t
                b0, w = solve_ridge(n_r, sx_r, sy_r, xtx_r, xty_r, alpha, intercept, center, normalize)
                tr = sse_from_stats(n_r, sx_r, sy_r, syy_r, xtx_r, xty_r, b0, w) / n_r
                te_sse = sse_from_stats(n_t, sx_t, sy_t, syy_t, xtx_t, xty_t, b0, w)
                rows.append((float(alpha), int(f), tr, te_sse / n_t, r2_from_stats(te_sse, n_t, sy_t, syy_t)))
        return pd.DataFrame(rows, columns=["alpha", "fold", "train_mse", "test_mse", "test_r2"]).astype({"test_r2": object})

    out = stats.groupBy(F.lit(0).alias("__one")).applyInPandas(
        solve, "alpha double, fold long, train_mse double, test_mse double, test_r2 double")
    if digits is not None:
        out = out.select("alpha", "fold", *[round6(c, digits).alias(c) for c in ("train_mse", "test_mse", "test_r2")])
    return out


def summarize_scores(scores: DataFrame, by: list[str], col: str = "test_mse", digits: int = 6) -> DataFrame:
    """Mean and population std of per-split scores per setting, plus rank."""
    agg = scores.groupBy(*by).agg(F.avg(col).alias("mean_score"), F.stddev_pop(col).alias("std_score"))
    from pyspark.sql import Window
    # one row per setting; scores that print the same share a rank
    w = Window.orderBy(round6("mean_score", digits).asc())
    return agg.select(*by, round6("mean_score", digits).alias("mean_score"),
                      round6("std_score", digits).alias("std_score"),
                      F.rank().over(w).alias("rank"))


def grid_search(stats: DataFrame, d: int, fold_col: str, alphas: list[float], normalize: tuple[bool, ...] = (False,),
                scoring: str = "mse") -> DataFrame:
    """Every setting's cross-validated score, best first: ``alpha, normalize, mean_score, std_score, rank``.

    ``scoring`` is ``mse`` (least is best) or ``r2`` (most is best; folds with a
    constant target have none).  The folds are a column of the rows, so shuffled
    and grouped folds come from how that column is made.
    """
    from pyspark.sql import Window
    col = "test_mse" if scoring == "mse" else "test_r2"
    parts = [fold_scores(stats, d, fold_col, alphas, digits=None, normalize=z).withColumn("normalize", F.lit(z)) for z in normalize]
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    agg = scores.groupBy("alpha", "normalize").agg(F.avg(col).alias("mean_score"), F.stddev_pop(col).alias("std_score"))
    best = F.col("mean_score").asc_nulls_last() if scoring == "mse" else F.col("mean_score").desc_nulls_last()
    return agg.withColumn("rank", F.rank().over(Window.orderBy(best)))  # one row per setting


def refit_best(stats: DataFrame, d: int, settings: DataFrame) -> DataFrame:
    """The best setting's fit on all folds: ``alpha, normalize, intercept, w0..`` (first of equal ones)."""
    best = settings.orderBy("rank", "alpha", "normalize").first()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        center = center_of(pdf.iloc[0], d)
        n, sx, sy, _, xtx, xty = [sum(v) for v in zip(*(stats_to_arrays(r, d) for _, r in pdf.iterrows()))]
        b0, w = solve_ridge(n, sx, sy, xtx, xty, best.alpha, normalize=best.normalize)
        return pd.DataFrame([[best.alpha, best.normalize, original_intercept(b0, w, center), *w]],
                            columns=["alpha", "normalize", "intercept"] + [f"w{i}" for i in range(d)])

    schema = "alpha double, normalize boolean, intercept double, " + ", ".join(f"w{i} double" for i in range(d))
    return stats.groupBy(F.lit(0).alias("__one")).applyInPandas(solve, schema)


def dimension_sweep(df: DataFrame, vec: str, y: str, fold_col: str, dims: list[int], alpha: float = 0.0) -> DataFrame:
    """Cross-validated ridge error of the leading ``dims`` components: ``n_dims, mean_score, std_score``."""
    st = vector_stats(df, vec, y, [fold_col])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d = len(pdf["sx"].iloc[0])
        per = [(float(r["n"]), np.asarray(r["sx"]), float(r["sy"]), float(r["syy"]), np.asarray(r["xtx"]).reshape(d, d),
                np.asarray(r["xty"])) for _, r in pdf.iterrows()]
        rows = []
        for k in dims:
            part = [(n, sx[:k], sy, syy, xtx[:k, :k], xty[:k]) for n, sx, sy, syy, xtx, xty in per]
            errors = []
            for i, test in enumerate(part):
                n, sx, sy, _, xtx, xty = [sum(v) for v in zip(*(p for j, p in enumerate(part) if j != i))]
                b0, w = solve_ridge(n, sx, sy, xtx, xty, alpha)
                errors.append(sse_from_stats(*test, b0, w) / test[0])
            rows.append((k, float(np.mean(errors)), float(np.std(errors))))
        return pd.DataFrame(rows, columns=["n_dims", "mean_score", "std_score"])

    out = st.groupBy(F.lit(0).alias("__one")).applyInPandas(solve, "n_dims int, mean_score double, std_score double")
    return out.select("n_dims", round6("mean_score").alias("mean_score"), round6("std_score").alias("std_score"))


def split_scores(stats: DataFrame, d: int, split_col: str, test_col: str,
                 alpha: float = 0.0, intercept: bool = True) -> DataFrame:
    """Per split: fit on the train side's statistics, score both sides."""
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = {bool(r[test_col]): stats_to_arrays(r, d) for _, r in pdf.iterrows()}
        tr = sides.get(False)
        te = sides.get(True)
        if tr is None:
            return pd.DataFrame(columns=[split_col, "train_mse", "test_mse"])
        b0, w = solve_ridge(tr[0], tr[1], tr[2], tr[4], tr[5], alpha, intercept, center_of(pdf.iloc[0], d))
        tr_mse = sse_from_stats(tr[0], tr[1], tr[2], tr[3], tr[4], tr[5], b0, w) / tr[0]
        te_mse = (sse_from_stats(te[0], te[1], te[2], te[3], te[4], te[5], b0, w) / te[0]) if te else np.nan
        return pd.DataFrame([[pdf[split_col].iloc[0], tr_mse, te_mse]], columns=[split_col, "train_mse", "test_mse"])

    schema = S.extend(stats.select(split_col).schema, ("train_mse", "double"), ("test_mse", "double"))
    return stats.groupBy(split_col).applyInPandas(solve, schema)


def best_fold_refit(stats: DataFrame, d: int, fold_col: str, alpha: float = 0.0) -> DataFrame:
    """The fold whose held-out R² is highest (ties → lowest fold), refit on its
    training side (all other folds)."""
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        per = {int(r[fold_col]): stats_to_arrays(r, d) for _, r in pdf.iterrows()}
        center = center_of(pdf.iloc[0], d)
        tot = [sum(v[i] for v in per.values()) for i in range(6)]
        best = None
        for f in sorted(per):
            n_t, sx_t, sy_t, syy_t, xtx_t, xty_t = per[f]
            args = [tot[i] - per[f][i] for i in range(6)]
            b0, w = solve_ridge(args[0], args[1], args[2], args[4], args[5], alpha)
            r2 = r2_from_stats(sse_from_stats(n_t, sx_t, sy_t, syy_t, xtx_t, xty_t, b0, w), n_t, sy_t, syy_t)
            r2 = -np.inf if r2 is None else r2  # a fold with a constant target is never the best
            if best is None or r2 > best[0]:
                best = (r2, f, original_intercept(b0, w, center), w)
        _, f, b0, w = best
        return pd.DataFrame([[f, round(b0, 6), *[round(x, 6) for x in w]]],
                            columns=["best_fold", "intercept"] + [f"w{i}" for i in range(d)])

    schema = "best_fold long, intercept double, " + ", ".join(f"w{i} double" for i in range(d))
    return stats.groupBy(F.lit(0).alias("__one")).applyInPandas(solve, schema)


def unpivot_codes(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Wide settings → long ``(param, value)`` → ordinal code per parameter
    (dense rank of the value, NULL → 0)."""
    from pyspark.sql import Window
    long = df.unpivot(id_col, cols, "param", "value")
    w = Window.partitionBy("param").orderBy("value")  # one partition per parameter: settings-sized
    return long.select(id_col, "param", F.when(F.col("value").isNull(), F.lit(0))
                       .otherwise(F.dense_rank().over(w)).alias("code"))
