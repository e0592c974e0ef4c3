"""Registered queries: linear models, resampling and cross-validation (L1-L24, L26),
and table-scale reduction / clustering (M2-M13)."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe import tables
from astrolabe.operators import gram, pooling, reduce, search, splits, stats
from astrolabe.operators import resample as R
from astrolabe.operators import text as X
from astrolabe.functions.schema import seq_long
from astrolabe.constants import DISTANT_CONST, OBSERVED_SQL
from astrolabe.plans.registry import register


def T(spark, sf, name):
    return tables.load(spark, sf, name)


_LI_KEY = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"


def _li_key():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in tables.ROW_KEYS["lineitem"]])


def _li_xy(spark, sf, more=()):
    return T(spark, sf, "lineitem").select(
        *more, _li_key().alias("k"), F.col("l_quantity").alias("x1"),
        (F.col("l_discount") * 100).alias("x2"), (F.col("l_extendedprice") / 1000.0).alias("y"))


# ---- L1 / L2 ---------------------------------------------------------------------------

def fit_table(stats_df, d, alpha=0.0, intercept=True):
    """Solve a one-row statistics table into ``intercept, w0..`` (one pandas group)."""
    def solve(pdf):
        n, sx, sy, syy, xtx, xty = gram.stats_to_arrays(pdf.iloc[0], d)
        center = gram.center_of(pdf.iloc[0], d)
        b0, w = gram.solve_ridge(n, sx, sy, xtx, xty, alpha, intercept, center)
        return pd.DataFrame([[gram.original_intercept(b0, w, center), *w]], columns=["intercept"] + [f"w{i}" for i in range(d)])
    schema = "intercept double, " + ", ".join(f"w{i} double" for i in range(d))
    out = stats_df.groupBy(F.lit(0).alias("__one")).applyInPandas(solve, schema)
    return out.select(*[round6(c).alias(c) for c in out.columns])


@register("linear_fit", """
SELECT round(regr_intercept(l_extendedprice / 1000.0, l_quantity), 6) AS intercept,
       round(regr_slope(l_extendedprice / 1000.0, l_quantity), 6) AS w0 FROM lineitem
""")
def q_linear_fit(spark, sf):
    d = _li_xy(spark, sf)
    return fit_table(gram.sufficient_stats(d, ["x1"], "y"), 1)


_RIDGE2 = """
WITH b AS (SELECT l_quantity AS x1, l_discount * 100 AS x2, l_extendedprice / 1000.0 AS y FROM lineitem),
c AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
             var_pop(x1) * count(*) AS c11, var_pop(x2) * count(*) AS c22, covar_pop(x1, x2) * count(*) AS c12,
             covar_pop(x1, y) * count(*) AS c1y, covar_pop(x2, y) * count(*) AS c2y FROM b),
w AS (SELECT *, ((c22 + {a}) * c1y - c12 * c2y) / ((c11 + {a}) * (c22 + {a}) - c12 * c12) AS w0,
                ((c11 + {a}) * c2y - c12 * c1y) / ((c11 + {a}) * (c22 + {a}) - c12 * c12) AS w1 FROM c)
SELECT round(my - w0 * m1 - w1 * m2, 6) AS intercept, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM w
"""


@register("ridge_fit", _RIDGE2.format(a="10.0"))
def q_ridge_fit(spark, sf):
    d = _li_xy(spark, sf)
    return fit_table(gram.sufficient_stats(d, ["x1", "x2"], "y"), 2, alpha=10.0)


# ---- L10 / L11 / L20: fold algebra ---------------------------------------------------------

ALPHAS = [0.0, 1.0, 10.0, 100.0, 1000.0]


def _cv_sql(alphas_sql: str, intercept_sql: str = "true", extra_cols: str = "", settings: str | None = None):
    """Each fold's fit from the moments of its training rows, its error from its own rows."""
    src = settings or f"SELECT unnest({alphas_sql}) AS alpha, {intercept_sql} AS icpt"
    return f"""
WITH b AS (SELECT {R.fold_sql(_LI_KEY, 5)} AS fold, l_quantity AS x, l_extendedprice / 1000.0 AS y FROM lineitem),
f AS (SELECT DISTINCT fold FROM b),
m AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS cxx, covar_pop(y, x) * count(*) AS cxy,
             sum(x * x) AS sxx, sum(x * y) AS sxy FROM f JOIN b ON b.fold <> f.fold GROUP BY f.fold),
a AS ({src}),
w AS (SELECT a.*, m.*, CASE WHEN icpt THEN cxy / (cxx + alpha) ELSE sxy / (sxx + alpha) END AS w1 FROM m, a),
wb AS (SELECT *, CASE WHEN icpt THEN my - w1 * mx ELSE 0.0 END AS b0 FROM w),
e AS (SELECT wb.* EXCLUDE (mx, my, cxx, cxy, sxx, sxy), avg((y - b0 - w1 * x) ^ 2) AS test_mse, var_pop(y) AS var_y
      FROM wb JOIN b USING (fold) GROUP BY ALL)
"""


@register("grid_search", _cv_sql("[0.0, 1.0, 10.0, 100.0, 1000.0]::DOUBLE[]") + """
SELECT alpha, round(avg(test_mse), 6) AS mean_score, round(stddev_pop(test_mse), 6) AS std_score,
       CAST(rank() OVER (ORDER BY round(avg(test_mse), 6)) AS INTEGER) AS rank FROM e GROUP BY alpha
""")
def q_grid_search(spark, sf):
    d = _li_xy(spark, sf).withColumn("fold", R.fold_of(F.col("k"), 5))
    st = gram.sufficient_stats(d, ["x1"], "y", ["fold"])
    sc = gram.fold_scores(st, 1, "fold", ALPHAS, digits=None)
    return gram.summarize_scores(sc, ["alpha"])


_CV2_SQL = """
WITH b AS (SELECT {fold} AS fold, l_quantity AS x, l_extendedprice / 1000.0 AS y FROM lineitem),
f AS (SELECT DISTINCT fold FROM b),
m AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS cxx, covar_pop(y, x) * count(*) AS cxy
      FROM f JOIN b ON b.fold <> f.fold GROUP BY f.fold),
a AS (SELECT unnest([0.0, 0.01, 1.0, 1000.0]::DOUBLE[]) AS alpha),
z AS (SELECT unnest([false, true]) AS normalize),
w AS (SELECT alpha, normalize, m.*, cxy / (cxx + alpha * CASE WHEN normalize THEN cxx ELSE 1 END) AS w1 FROM m, a, z),
e AS (SELECT alpha, normalize, fold, avg((y - my - w1 * (x - mx)) ^ 2) AS mse, var_pop(y) AS var_y
      FROM w JOIN b USING (fold) GROUP BY alpha, normalize, fold)
"""
_CV2_ALPHAS = [0.0, 0.01, 1.0, 1000.0]


@register("grid_search_r2", _CV2_SQL.format(fold=R.fold_sql("CAST(l_suppkey AS VARCHAR)", 5)) + """
SELECT alpha, normalize, round(avg(1 - mse / var_y), 6) AS mean_score, round(stddev_pop(1 - mse / var_y), 6) AS std_score
FROM e GROUP BY alpha, normalize
""")
def q_grid_search_r2(spark, sf):
    """R² over folds that keep a supplier's rows together, with and without normalised columns."""
    d = (_li_xy(spark, sf, ("l_suppkey",)).withColumn("fold", R.fold_of(F.col("l_suppkey").cast("string"), 5)))
    sc = gram.grid_search(gram.sufficient_stats(d, ["x1"], "y", ["fold"]), 1, "fold", _CV2_ALPHAS, (False, True), "r2")
    return sc.select("alpha", "normalize", round6("mean_score").alias("mean_score"), round6("std_score").alias("std_score"))


@register("grid_search_refit", _CV2_SQL.format(fold=R.fold_sql(_LI_KEY, 5)) + """,
s AS (SELECT alpha, normalize, avg(mse) AS score FROM e GROUP BY alpha, normalize),
best AS (SELECT * FROM s ORDER BY score, alpha, normalize LIMIT 1),
t AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS cxx, covar_pop(y, x) * count(*) AS cxy FROM b),
g AS (SELECT cxy / (cxx + alpha * CASE WHEN normalize THEN cxx ELSE 1 END) AS w0, mx, my FROM t, best)
SELECT round(my - w0 * mx, 6) AS intercept, round(w0, 6) AS w0 FROM g
""")
def q_grid_search_refit(spark, sf):
    """The best setting over shuffled folds, fitted again on all rows."""
    d = _li_xy(spark, sf).withColumn("fold", R.fold_of(F.col("k"), 5))
    st = gram.sufficient_stats(d, ["x1"], "y", ["fold"])
    fit = gram.refit_best(st, 1, gram.grid_search(st, 1, "fold", _CV2_ALPHAS, (False, True)))
    return fit.select(round6("intercept").alias("intercept"), round6("w0").alias("w0"))


@register("scaled_ridge", """
WITH r AS (SELECT l_quantity AS x1, l_discount * 100 AS x2, l_extendedprice / 1000.0 AS y FROM lineitem),
q AS (SELECT avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM r),
b AS (SELECT (x1 - m1) / s1 AS x1, (x2 - m2) / s2 AS x2, y FROM r, q),
c AS (SELECT avg(y) AS my, var_pop(x1) * count(*) AS c11, var_pop(x2) * count(*) AS c22, covar_pop(x1, x2) * count(*) AS c12,
             covar_pop(x1, y) * count(*) AS c1y, covar_pop(x2, y) * count(*) AS c2y FROM b),
w AS (SELECT my, ((c22 + 100) * c1y - c12 * c2y) / ((c11 + 100) * (c22 + 100) - c12 * c12) AS w0,
             ((c11 + 100) * c2y - c12 * c1y) / ((c11 + 100) * (c22 + 100) - c12 * c12) AS w1 FROM c)
SELECT round(my, 6) AS intercept, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM w
""")
def q_scaled_ridge(spark, sf):
    """Scaler, then regressor: ridge on columns of mean 0 and deviation 1."""
    d = _li_xy(spark, sf)
    scale = d.agg(*[f(c).alias(f"{n}_{c}") for c in ("x1", "x2") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    s = stats.with_scalars(d, scale)
    s = s.select("y", *[((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))).alias(c)
                        for c in ("x1", "x2")])
    return fit_table(gram.sufficient_stats(s, ["x1", "x2"], "y"), 2, alpha=100.0)


#: The reference's default number of random settings.
N_SETTINGS = 500


def _settings(spark, n):
    """Random settings: alpha log-uniform in [1e-2, 1e3], intercept flag categorical."""
    ids = spark.range(n).select(F.col("id").alias("setting_id"))
    return ids.select("setting_id",
                      F.pow(F.lit(10.0), F.lit(-2.0) + 5.0 * R.uniform(42, "alpha", F.col("setting_id"))).alias("alpha"),
                      (R.uniform(42, "icpt", F.col("setting_id")) < 0.5).alias("icpt"))


_SETTINGS_SQL = f"""SELECT range AS setting_id, pow(10.0, -2.0 + 5.0 * {R.uniform_sql(42, 'alpha', 'range')}) AS alpha,
       {R.uniform_sql(42, 'icpt', 'range')} < 0.5 AS icpt FROM range({N_SETTINGS})"""


@register("random_search", _cv_sql("", settings=_SETTINGS_SQL) + """
SELECT setting_id, round(alpha, 6) AS alpha, icpt AS fit_intercept, round(avg(test_mse), 6) AS mean_score,
       round(stddev_pop(test_mse), 6) AS std_score,
       CAST(rank() OVER (ORDER BY round(avg(test_mse), 6)) AS INTEGER) AS rank
FROM e GROUP BY setting_id, alpha, icpt
""")
def q_random_search(spark, sf):
    d = _li_xy(spark, sf).withColumn("fold", R.fold_of(F.col("k"), 5))
    st = gram.sufficient_stats(d, ["x1"], "y", ["fold"])
    settings = _settings(spark, N_SETTINGS).toPandas()  # N_SETTINGS rows: parameters, not data
    parts = []
    for icpt in (True, False):
        sub = settings[settings.icpt == icpt]
        if len(sub) == 0:
            continue
        # each penalty once: settings that share one meet its scores in the join below
        sc = gram.fold_scores(st, 1, "fold", sorted(set(sub.alpha)), intercept=icpt, digits=None)
        parts.append(sc.withColumn("icpt", F.lit(icpt)))
    sc = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sdf = _settings(spark, N_SETTINGS)
    j = sc.join(sdf, ["alpha", "icpt"])
    out = gram.summarize_scores(j, ["setting_id", "alpha", "icpt"])
    return out.select("setting_id", round6("alpha").alias("alpha"), F.col("icpt").alias("fit_intercept"),
                      "mean_score", "std_score", "rank")


_SWEEP2 = f"""
WITH b AS (SELECT {R.fold_sql(_LI_KEY, 5)} AS fold, l_quantity AS x1, l_discount * 100 AS x2,
                  l_extendedprice / 1000.0 AS y FROM lineitem),
f AS (SELECT DISTINCT fold FROM b),
m AS (SELECT f.fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * count(*) AS c11, var_pop(x2) * count(*) AS c22,
             covar_pop(x1, x2) * count(*) AS c12, covar_pop(y, x1) * count(*) AS c1y, covar_pop(y, x2) * count(*) AS c2y
      FROM f JOIN b ON b.fold <> f.fold GROUP BY f.fold),
a AS (SELECT unnest([0.0, 10.0, 1000.0]::DOUBLE[]) AS alpha),
u AS (SELECT alpha, m.*, 1 AS n_features, c1y / (c11 + alpha) AS w1, 0.0 AS w2 FROM m, a
      UNION ALL
      SELECT alpha, m.*, 2, ((c22 + alpha) * c1y - c12 * c2y) / ((c11 + alpha) * (c22 + alpha) - c12 * c12),
             ((c11 + alpha) * c2y - c12 * c1y) / ((c11 + alpha) * (c22 + alpha) - c12 * c12) FROM m, a),
e AS (SELECT alpha, n_features, fold, avg((y - (my - w1 * m1 - w2 * m2) - w1 * x1 - w2 * x2) ^ 2) AS test_mse
      FROM u JOIN b USING (fold) GROUP BY alpha, n_features, fold)
SELECT alpha, n_features, round(avg(test_mse), 6) AS mean_score, round(stddev_pop(test_mse), 6) AS std_score
FROM e GROUP BY alpha, n_features
"""


@register("alpha_sweep", _SWEEP2)
def q_alpha_sweep(spark, sf):
    """Alpha sweep x feature-count sweep, all from one pass of fold statistics."""
    d = _li_xy(spark, sf).withColumn("fold", R.fold_of(F.col("k"), 5))
    st = gram.sufficient_stats(d, ["x1", "x2"], "y", ["fold"])
    alphas = [0.0, 10.0, 1000.0]

    def sweep(pdf):
        rows = []
        per = {r["fold"]: gram.stats_to_arrays(r, 2) for _, r in pdf.iterrows()}
        tot = [sum(v[i] for v in per.values()) for i in range(6)]
        for k in (1, 2):
            sl = slice(0, k)
            for alpha in alphas:
                for f, (n_t, sx_t, sy_t, syy_t, xtx_t, xty_t) in per.items():
                    n_r, sx_r, sy_r = tot[0] - n_t, (tot[1] - sx_t)[sl], tot[2] - sy_t
                    xtx_r, xty_r = (tot[4] - xtx_t)[sl, sl], (tot[5] - xty_t)[sl]
                    b0, w = gram.solve_ridge(n_r, sx_r, sy_r, xtx_r, xty_r, alpha)
                    sse = gram.sse_from_stats(n_t, sx_t[sl], sy_t, syy_t, xtx_t[sl, sl], xty_t[sl], b0, w)
                    rows.append((alpha, k, sse / n_t))
        return pd.DataFrame(rows, columns=["alpha", "n_features", "test_mse"])

    sc = st.groupBy(F.lit(0).alias("__one")).applyInPandas(sweep, "alpha double, n_features int, test_mse double")
    return sc.groupBy("alpha", "n_features").agg(round6(F.avg("test_mse")).alias("mean_score"),
                                                 round6(F.stddev_pop("test_mse")).alias("std_score"))


@register("pca_sweep")
def q_pca_sweep(spark, sf):
    """Ridge error over folds by the number of principal components (y = label).

    One PCA, one pass of fold statistics on the projected columns; every
    dimension is a leading block of those.
    """
    v = tables.vectors(spark, sf).withColumn("fold", R.fold_of(F.col("vec_id"), 5))
    return gram.dimension_sweep(reduce.fit_pca(v, "vec", k=32).transform(v, "vec", "pc"), "pc", "label", "fold", [2, 4, 8, 16, 32], 1.0)


# ---- L12-L16: bootstrap and shuffle splits -------------------------------------------------

_PART_POS = "r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS pos FROM part), n AS (SELECT count(*) AS n FROM part)"


@register("bootstrap_sample", f"""
WITH {_PART_POS},
d AS (SELECT pos - 1 AS draw_id, CAST(floor({R.uniform_sql(42, 'boot', 'pos - 1')} * n) + 1 AS BIGINT) AS pick FROM r, n)
SELECT d.draw_id, r.p_partkey,
       round(r.p_retailprice + 0.5 * {R.gaussian_sql(42, 'noise', 'd.draw_id')}, 6) AS y_noisy
FROM d JOIN r ON r.pos = d.pick
""")
def q_bootstrap_sample(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("y_noisy"))
    b = R.bootstrap(p, ["p_partkey"], noise_col="y_noisy")
    return b.select("draw_id", "p_partkey", round6("y_noisy").alias("y_noisy"))


@register("group_bootstrap", f"""
WITH g AS (SELECT p_name, row_number() OVER (ORDER BY {R.uniform_sql(42, 'grp', 'p_name')}, p_name) AS gpos
           FROM (SELECT DISTINCT p_name FROM part)),
ng AS (SELECT count(*) AS ng FROM g),
s AS (SELECT p.p_partkey, p.p_name, g.gpos <= ceil(0.2 * ng) AS is_test FROM part p JOIN g USING (p_name), ng),
r AS (SELECT *, row_number() OVER (PARTITION BY is_test ORDER BY p_partkey) AS pos,
             count(*) OVER (PARTITION BY is_test) AS n_side FROM s),
d AS (SELECT is_test, pos - 1 AS draw_id,
             CAST(floor(CASE WHEN is_test THEN {R.uniform_sql(42, 'boot_test', 'pos - 1')}
                             ELSE {R.uniform_sql(42, 'boot_train', 'pos - 1')} END * n_side) + 1 AS BIGINT) AS pick
      FROM r)
SELECT d.draw_id, NOT d.is_test AS is_train, r.p_partkey, r.p_name AS group_id
FROM d JOIN r ON r.is_test = d.is_test AND r.pos = d.pick
""")
def q_group_bootstrap(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", "p_name")
    return R.group_bootstrap(p, key="p_partkey", group="p_name", test_size=0.2, seed=42)


@register("bootstrap_fit", f"""
WITH {_PART_POS},
d AS (SELECT pos - 1 AS draw_id, CAST(floor({R.uniform_sql(42, 'boot', 'pos - 1')} * n) + 1 AS BIGINT) AS pick FROM r, n),
b AS (SELECT d.draw_id, r.p_size AS x, r.p_retailprice AS y,
             r.p_retailprice + 0.5 * {R.gaussian_sql(42, 'noise', 'd.draw_id')} AS y_noisy,
             {R.uniform_sql(42, 'bfit', 'd.draw_id')} < 0.2 AS is_test
      FROM d JOIN r ON r.pos = d.pick),
f AS (SELECT regr_intercept(y_noisy, x) AS b0, regr_slope(y_noisy, x) AS b1 FROM b WHERE NOT is_test),
e AS (SELECT is_test, y, b0 + b1 * x AS yhat FROM b, f)
SELECT round(avg(CASE WHEN NOT is_test THEN (y - yhat) ^ 2 END), 6) AS train_mse,
       round(avg(CASE WHEN is_test THEN (y - yhat) ^ 2 END), 6) AS test_mse,
       round(1 - sum(CASE WHEN is_test THEN (y - yhat) ^ 2 END)
                 / (var_pop(CASE WHEN is_test THEN y END) * count(CASE WHEN is_test THEN y END)), 6) AS test_r2
FROM e
""")
def q_bootstrap_fit(spark, sf):
    """Bootstrap → 80/20 → fit on noisy targets → errors on the original targets."""
    p = T(spark, sf, "part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    b = R.bootstrap(p.withColumn("y_noisy", F.col("y")), ["p_partkey"], noise_col="y_noisy")
    b = b.withColumn("is_test", R.uniform(42, "bfit", F.col("draw_id")) < 0.2)
    fit = b.where(~F.col("is_test")).agg(F.regr_intercept("y_noisy", "x").alias("b0"),
                                         F.regr_slope("y_noisy", "x").alias("b1"))
    e = stats.with_scalars(b, fit).withColumn("yhat", F.col("b0") + F.col("b1") * F.col("x"))
    r2 = (F.col("y") - F.col("yhat")) ** 2
    t = F.col("is_test")
    return e.agg(round6(F.avg(F.when(~t, r2))).alias("train_mse"),
                 round6(F.avg(F.when(t, r2))).alias("test_mse"),
                 round6(1 - F.sum(F.when(t, r2)) / (F.var_pop(F.when(t, F.col("y"))) * F.count(F.when(t, F.col("y")))))
                 .alias("test_r2"))


N_SHUFFLE = 100


@register("shuffle_split_fit", f"""
WITH sp AS (SELECT range AS split_id FROM range({N_SHUFFLE})),
b AS (SELECT sp.split_id, p.p_size AS x, p.p_retailprice AS y,
             (('0x' || substr(md5(concat_ws('_', '42', 'ss' || sp.split_id, CAST(p.p_partkey AS VARCHAR))), 1, 8))::BIGINT
              / 4294967296.0) < 0.2 AS is_test
      FROM part p, sp),
f AS (SELECT split_id, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM b WHERE NOT is_test GROUP BY split_id),
e AS (SELECT b.split_id, avg(CASE WHEN NOT is_test THEN (y - b0 - b1 * x) ^ 2 END) AS train_mse,
             avg(CASE WHEN is_test THEN (y - b0 - b1 * x) ^ 2 END) AS test_mse FROM b JOIN f USING (split_id)
      GROUP BY b.split_id)
SELECT split_id, round(train_mse, 6) AS train_mse, round(test_mse, 6) AS test_mse,
       split_id = (SELECT arg_min(split_id, (test_mse, split_id)) FROM e) AS is_best FROM e
""")
def q_shuffle_split_fit(spark, sf):
    """Repeated shuffle splits from one product of masks and moments; best = lowest test error."""
    p = T(spark, sf, "part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    sc = splits.shuffle_split_scores(p, "p_partkey", ["x"], "y", N_SHUFFLE, 0.2, seed=42, stream="ss")
    best = sc.agg(F.min_by("split_id", F.struct("test_mse", "split_id")).alias("best"))
    return stats.with_scalars(sc, best).select(
        "split_id", round6("train_mse").alias("train_mse"), round6("test_mse").alias("test_mse"),
        (F.col("split_id") == F.col("best")).alias("is_best"))


@register("best_fold", _cv_sql("[0.0]::DOUBLE[]") + """,
best AS (SELECT arg_max(fold, (1 - test_mse / var_y, -fold)) AS fold FROM e)
SELECT e.fold AS best_fold, round(e.b0, 6) AS intercept, round(e.w1, 6) AS w0 FROM e JOIN best USING (fold)
""")
def q_best_fold(spark, sf):
    """Highest-R² fold of the given folds, refit on its training side."""
    d = _li_xy(spark, sf).withColumn("fold", R.fold_of(F.col("k"), 5))
    st = gram.sufficient_stats(d, ["x1"], "y", ["fold"])
    return gram.best_fold_refit(st, 1, "fold")


# ---- L17 / L18 / L19 / L21: group splits, masked resampling, curves, importance -------------------

N_GSS = 20


@register("group_split", f"""
WITH g AS (SELECT DISTINCT o_custkey FROM orders), ng AS (SELECT count(*) AS ng FROM g),
sp AS (SELECT range AS split_id FROM range({N_GSS})),
r AS (SELECT sp.split_id, g.o_custkey,
             row_number() OVER (PARTITION BY sp.split_id ORDER BY
               (('0x' || substr(md5(concat_ws('_', '42', 'gss' || sp.split_id, CAST(g.o_custkey AS VARCHAR))), 1, 8))::BIGINT
                / 4294967296.0), g.o_custkey) AS rk FROM g, sp),
t AS (SELECT split_id, o_custkey, rk <= ceil(0.2 * ng) AS is_test FROM r, ng)
SELECT t.split_id, CAST(count(DISTINCT CASE WHEN is_test THEN t.o_custkey END) AS BIGINT) AS n_test_groups,
       CAST(count_if(is_test) AS BIGINT) AS n_test_rows, CAST(count_if(NOT is_test) AS BIGINT) AS n_train_rows
FROM t JOIN orders o ON o.o_custkey = t.o_custkey GROUP BY t.split_id
""")
def q_group_split(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey")
    membership = R.group_shuffle_split(o.select("o_custkey").distinct(), "o_custkey", N_GSS, 0.2, seed=42)
    j = o.join(membership, "o_custkey")
    return j.groupBy("split_id").agg(
        F.countDistinct(F.when(F.col("is_test"), F.col("o_custkey"))).alias("n_test_groups"),
        F.count_if("is_test").alias("n_test_rows"), F.count_if(~F.col("is_test")).alias("n_train_rows"))


@register("masked_resample", """
WITH sp AS (SELECT range AS split_id FROM range(5)),
r AS (SELECT sp.split_id, l.doc_id, l.quality = 1 AS is_train,
             row_number() OVER (PARTITION BY sp.split_id, l.quality = 1 ORDER BY
               (('0x' || substr(md5(concat_ws('_', '42', 'mr' || sp.split_id, CAST(l.doc_id AS VARCHAR))), 1, 8))::BIGINT
                / 4294967296.0), l.doc_id) AS rk,
             count(*) OVER (PARTITION BY sp.split_id, l.quality = 1) AS n_side FROM labels l, sp)
SELECT split_id, is_train, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS checksum
FROM r WHERE rk <= floor(0.5 * n_side) GROUP BY split_id, is_train
""")
def q_masked_resample(spark, sf):
    lab = T(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("is_train"))
    s = R.masked_resample(lab, "doc_id", "is_train", n_splits=5, fraction=0.5, seed=42)
    return s.groupBy("split_id", "is_train").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("checksum"))


@register("masked_resample_count", """
WITH sp AS (SELECT range AS split_id FROM range(5)),
r AS (SELECT sp.split_id, l.doc_id, l.quality = 1 AS is_train,
             row_number() OVER (PARTITION BY sp.split_id, l.quality = 1 ORDER BY
               (('0x' || substr(md5(concat_ws('_', '42', 'mr' || sp.split_id, CAST(l.doc_id AS VARCHAR))), 1, 8))::BIGINT
                / 4294967296.0), l.doc_id) AS rk FROM labels l, sp)
SELECT split_id, is_train, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS checksum
FROM r WHERE rk <= 25 GROUP BY split_id, is_train
""")
def q_masked_resample_count(spark, sf):
    lab = T(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("is_train"))
    s = R.masked_resample(lab, "doc_id", "is_train", n_splits=5, n_rows=25, seed=42)
    return s.groupBy("split_id", "is_train").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("checksum"))


@register("learning_curve", """
WITH sp AS (SELECT range AS split_id FROM range(20)),
d AS (SELECT p_partkey, p_size AS x, p_retailprice AS y, row_number() OVER (ORDER BY p_partkey) AS rn, count(*) OVER () AS n
      FROM part WHERE p_partkey % 10 <> 0),
st AS (SELECT DISTINCT CAST(floor(f * n) AS BIGINT) AS step FROM d, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS f)),
f AS (SELECT step, split_id, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM d, st, sp
      WHERE rn <= step AND (('0x' || substr(md5(concat_ws('_', '42', 'lc' || split_id, CAST(p_partkey AS VARCHAR))), 1, 8))::BIGINT
                            / 4294967296.0) >= 0.2 GROUP BY step, split_id),
t AS (SELECT p_size AS x, p_retailprice AS y FROM part WHERE p_partkey % 10 = 0)
SELECT step, split_id, round(avg((t.y - b0 - b1 * t.x) ^ 2), 6) AS mse FROM f, t GROUP BY step, split_id
""")
def q_learning_curve(spark, sf):
    """Fits on 20 splits of every prefix, scored on one fixed truth (every tenth part)."""
    p = T(spark, sf, "part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    held = F.col("p_partkey") % 10 == 0
    return splits.learning_curve(p.where(~held), p.where(held), "p_partkey", ["x"], "y", [0.1, 0.25, 0.5, 0.75, 1.0],
                                 n_splits=20, test_size=0.2, seed=42)


#: The reference's default number of splits.
N_IMPORTANCE = 500


@register("data_importance", f"""
WITH sp AS (SELECT range AS split_id FROM range({N_IMPORTANCE})),
b AS (SELECT sp.split_id, p.p_partkey, p.p_size AS x, p.p_retailprice AS y,
             (('0x' || substr(md5(concat_ws('_', '42', 'di' || sp.split_id, CAST(p.p_partkey AS VARCHAR))), 1, 8))::BIGINT
              / 4294967296.0) < 0.2 AS is_test FROM part p, sp),
f AS (SELECT split_id, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM b WHERE NOT is_test GROUP BY split_id),
e AS (SELECT b.split_id, avg((y - b0 - b1 * x) ^ 2) AS err FROM b JOIN f USING (split_id) WHERE is_test GROUP BY b.split_id),
v AS (SELECT b.p_partkey, stddev_pop(CASE WHEN b.is_test THEN 0.0 ELSE e.err END) AS s FROM b JOIN e USING (split_id)
      GROUP BY b.p_partkey)
SELECT p_partkey, round(s / (SELECT min(s) FROM v), 6) AS importance FROM v
""")
def q_data_importance(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    imp = splits.data_importance(p, "p_partkey", ["x"], "y", N_IMPORTANCE, 0.2, seed=42, stream="di")
    return imp.select("p_partkey", round6("importance").alias("importance"))


# ---- L22-L24, L26 ----------------------------------------------------------------------------

_RANDOM_SEARCH_SELECT = """
SELECT setting_id, round(alpha, 6) AS alpha, icpt AS fit_intercept, round(avg(test_mse), 6) AS mean_score,
       round(stddev_pop(test_mse), 6) AS std_score,
       CAST(rank() OVER (ORDER BY round(avg(test_mse), 6)) AS INTEGER) AS rank
FROM e GROUP BY setting_id, alpha, icpt
"""


@register("cv_unpivot", _cv_sql("", settings=_SETTINGS_SQL) + """,
res AS (""" + _RANDOM_SEARCH_SELECT + """),
wide AS (SELECT setting_id, CAST(alpha AS VARCHAR) AS alpha, CAST(fit_intercept AS VARCHAR) AS fit_intercept FROM res),
l AS (UNPIVOT wide ON alpha, fit_intercept INTO NAME param VALUE value)
SELECT setting_id, param, CAST(dense_rank() OVER (PARTITION BY param ORDER BY value) AS INTEGER) AS code FROM l
""")
def q_cv_unpivot(spark, sf):
    """The wide CV results table (one row per setting, scored on lineitem folds)
    → long (param, value) → ordinal code per parameter."""
    res = q_random_search(spark, sf)
    w = res.select("setting_id", F.col("alpha").cast("string").alias("alpha"),
                   F.lower(F.col("fit_intercept").cast("string")).alias("fit_intercept"))
    return gram.unpivot_codes(w, "setting_id", ["alpha", "fit_intercept"])


@register("negative_augment", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
a AS (SELECT vec_id AS anchor_id, vec AS avec, label FROM v WHERE {OBSERVED_SQL}),
d AS (SELECT a.anchor_id, v.vec_id AS entry, 1 - list_cosine_similarity(a.avec, v.vec) AS distance FROM a, v),
p AS (SELECT quantile_cont(distance, 0.97) AS upper FROM d),
m AS (SELECT entry, avg(distance) AS mean_d FROM d GROUP BY entry)
SELECT anchor_id AS vec_id, CAST(label AS DOUBLE) AS y, false AS is_negative FROM a
UNION ALL SELECT entry, 0.0, true FROM m, p WHERE mean_d > upper
""")
def q_negative_augment(spark, sf):
    v = tables.vectors(spark, sf)
    anchors = tables.inventory(v)
    flags = search.distant_flag(v, anchors.withColumnRenamed("vec_id", "anchor_id"), 0.97, DISTANT_CONST,
                                metric="cosine").where("above_pct")
    neg = flags.select(F.col("entry").alias("vec_id"), F.lit(0.0).alias("y"), F.lit(True).alias("is_negative"))
    pos = anchors.select("vec_id", F.col("label").cast("double").alias("y"), F.lit(False).alias("is_negative"))
    return pos.unionByName(neg)


HOLDOUT = ["red widget", "blue bolt"]


@register("holdout_fit", """
WITH f AS (SELECT regr_intercept(p_retailprice, p_size) AS b0, regr_slope(p_retailprice, p_size) AS b1
           FROM part WHERE p_name NOT IN ('red widget', 'blue bolt'))
SELECT p_partkey, round(b0 + b1 * p_size, 6) AS prediction, round(p_retailprice - b0 - b1 * p_size, 6) AS error
FROM part, f WHERE p_name IN ('red widget', 'blue bolt')
""")
def q_holdout_fit(spark, sf):
    p = T(spark, sf, "part")
    held = F.col("p_name").isin(*HOLDOUT)
    fit = p.where(~held).agg(F.regr_intercept("p_retailprice", "p_size").alias("b0"),
                             F.regr_slope("p_retailprice", "p_size").alias("b1"))
    pred = F.col("b0") + F.col("b1") * F.col("p_size")
    return stats.with_scalars(p.where(held), fit).select(
        "p_partkey", round6(pred).alias("prediction"), round6(F.col("p_retailprice") - pred).alias("error"))


@register("trend_line", """
WITH v AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
f AS (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1.0) AS b1, avg(x) AS mx, avg(y) AS my,
             min(x) - 0.5 AS lo, max(x) + 0.5 AS hi FROM v),
g AS (SELECT range AS i FROM range(1000))
SELECT CAST(i AS BIGINT) AS i, round(lo + i * (hi - lo) / 999.0, 6) + 0.0 AS x,
       round(my + b1 * (lo + i * (hi - lo) / 999.0 - mx), 6) + 0.0 AS y FROM g, f
""")
def q_trend_line(spark, sf):
    """Ridge (alpha=1) line through the first two coordinates, on a padded 1000-point grid."""
    v = tables.vectors(spark, sf).select(F.get("vec", 0).alias("x"), F.get("vec", 1).alias("y"))
    f = v.agg((F.covar_pop("x", "y") * F.count(F.lit(1)) / (F.var_pop("x") * F.count(F.lit(1)) + 1.0)).alias("b1"),
              F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.min("x") - 0.5).alias("lo"),
              (F.max("x") + 0.5).alias("hi"))
    g = stats.with_scalars(spark.range(1000).withColumnRenamed("id", "i"), f)
    gx = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / 999.0
    # "+ 0.0": a value that rounds to zero is +0.0 in every engine
    return g.select("i", (round6(gx) + 0.0).alias("x"),
                    (round6(F.col("my") + F.col("b1") * (gx - F.col("mx"))) + 0.0).alias("y"))


# ---- M3 / M5 / M6 / M8 / M11 / M12 ---------------------------------------------------------------

HASH_DIM = 4


_WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


@register("sum_pool_vectors", f"""
WITH t AS (SELECT doc_id, unnest({_WORDS_SQL}) AS token FROM documents)
SELECT doc_id, {", ".join(f"round(sum({R.uniform_sql(7, f'dim{c}', 'token')} - 0.5), 6) AS v{c}" for c in range(HASH_DIM))}
FROM t GROUP BY doc_id
""")
def q_sum_pool_vectors(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", X.token_sentence("text", radius=0).alias("tokens"))
    pooled = pooling.pool_hashed(d, "doc_id", "tokens", HASH_DIM)
    return pooled.select("doc_id", *[round6(F.get("vec", c)).alias(f"v{c}") for c in range(HASH_DIM)])


_UNNEST_V = """u AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x,
                    generate_subscripts(embedding, 1) AS i FROM embeddings)"""


@register("standardise", f"""
WITH {_UNNEST_V},
m AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM u GROUP BY i)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS z FROM u JOIN m USING (i)
""")
def q_standardise(spark, sf):
    """M5: every component of every vector."""
    z = reduce.standardise(tables.vectors(spark, sf), "vec")
    return z.select("vec_id", F.posexplode("z").alias("i", "v")).select("vec_id", "i", (round6("v") + F.lit(0.0)).alias("z"))


@register("covariance_matrix", f"""
WITH {_UNNEST_V}
SELECT CAST(a.i - 1 AS BIGINT) AS i, CAST(b.i - 1 AS BIGINT) AS j, round(covar_pop(a.x, b.x), 6) + 0.0 AS cov
FROM u a JOIN u b ON a.vec_id = b.vec_id GROUP BY a.i, b.i
""")
def q_covariance_matrix(spark, sf):
    c = reduce.covariance(tables.vectors(spark, sf), "vec")
    # "+ 0.0" turns a rounded -0.0 into 0.0 (entries near zero carry either sign)
    return c.select("i", "j", (round6("cov") + F.lit(0.0)).alias("cov"))


@register("assign_cluster", f"""
WITH {_UNNEST_V},
c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i) GROUP BY label),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)
SELECT vec_id, arg_min(CAST(label AS BIGINT), (list_distance(vec, centre), label)) AS cluster_id FROM v, c GROUP BY vec_id
""")
def q_assign_cluster(spark, sf):
    v = tables.vectors(spark, sf)
    centres = reduce.label_centres(v, "vec", "label")
    return reduce.assign_to_centres(v, centres, key="vec_id").select("vec_id", "cluster_id")


@register("sample_with", f"""
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings),
n AS (SELECT count(*) AS n FROM embeddings),
d AS (SELECT pos - 1 AS draw_id, CAST(floor({R.uniform_sql(42, 'boot', 'pos - 1')} * n) + 1 AS BIGINT) AS pick FROM r, n)
SELECT d.draw_id, r.vec_id, row_number() OVER (ORDER BY r.vec_id, d.draw_id) AS position FROM d JOIN r ON r.pos = d.pick
""")
def q_sample_with(spark, sf):
    e = T(spark, sf, "embeddings").select("vec_id")
    return R.in_row_order(R.bootstrap(e, ["vec_id"]), ["vec_id", "draw_id"]).select("draw_id", "vec_id", "position")


@register("sample_without", f"""
SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS position FROM
 (SELECT vec_id FROM embeddings ORDER BY {R.uniform_sql(42, 'sample', 'vec_id')}, vec_id LIMIT 100)
""")
def q_sample_without(spark, sf):
    return R.in_row_order(R.sample_without(T(spark, sf, "embeddings").select("vec_id"), "vec_id", 100), ["vec_id"])


@register("batched_apply", f"""
WITH {_UNNEST_V},
c AS (SELECT list(m ORDER BY i) AS coef FROM (SELECT i, avg(x) AS m FROM u WHERE {OBSERVED_SQL} GROUP BY i)),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)
SELECT vec_id, round(list_dot_product(vec, coef), 6) AS score FROM v, c
""")
def q_batched_apply(spark, sf):
    """A fitted linear scorer (here: the inventory centroid) applied per Arrow batch."""
    from astrolabe.operators.models import LinearModel
    v = tables.vectors(spark, sf)
    cen = reduce.moments(tables.inventory(v), "vec").collect()[0]["mean"]  # d numbers
    scored = LinearModel(np.asarray(cen), 0.0).predict(v.select("vec_id", "vec"), "vec", "score")
    return scored.select("vec_id", round6("score").alias("score"))
