"""Scoring with several models: one Python pass for all, and exact neighbours without all explicit differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolabe import tables
from astrolabe.functions import vectors as V
from astrolabe.operators import gp, models as MD
from astrolabe.operators import search
from astrolabe.plans import q_models

KERNEL = MD.Kernel(const=1.0, length=0.8, rq_const=0.5, bias=0.1, noise=0.05)


@pytest.mark.parametrize("scale,offset,copies", [(1, 0, False), (1, 1000, False), (1e-3, 1e5, True), (0, 0, True), (1e40, 0, True)])
def test_neighbours_are_those_of_all_explicit_differences(scale, offset, copies, monkeypatch):
    rng = np.random.default_rng(3)
    refs, q = rng.normal(size=(300, 16)) * scale + offset, rng.normal(size=(80, 16)) * scale + offset
    if copies:
        refs = refs[rng.integers(0, 30, 300)]
        q[:40] = refs[rng.integers(0, 300, 40)]
    ids, d = rng.permutation(300), V.pair_distances(q, refs)
    want = search._nearest(d, ids, 4)
    monkeypatch.setattr(V, "pair_distances", None)   # every pair's differences are not made any more
    near, dist = search._nearest_of(q, refs, ids, 4, "euclidean")
    assert (near == want).all() and (dist == np.take_along_axis(d, want, axis=1)).all()


def test_neighbours_of_odd_sides():
    refs, q = np.array([[0.0, 1.0], [np.nan, 0.0], [3.0, 1.0]]), np.array([[0.0, 0.0], [np.inf, 0.0]])
    near, dist = search._nearest_of(q, refs, np.array([7, 8, 9]), 2, "euclidean")
    assert near[0].tolist() == [0, 2] and dist[0, 0] == 1.0
    assert search._nearest_of(q, refs[:0], np.array([]), 2, "euclidean")[0].shape == (2, 0)
    near, dist = search._nearest_of(q[:1], refs[[0, 2]], np.array([7, 9]), 5, "euclidean")
    assert near.tolist() == [[0, 1]]


def rows(spark, n=90, d=5):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, [float(v) for v in rng.normal(size=d)], float(i % 7)) for i in range(n)],
                                 "vec_id long, vec array<double>, label double").repartition(3)


@pytest.mark.parametrize("cells", [gp.FACTOR_CELLS, 700])
def test_models_share_a_pass_and_score_as_alone(spark, cells, monkeypatch):
    v = rows(spark)
    mods = {"ridge": MD.fit_ridge_vec(v, "vec", "label"), "bayes": MD.fit_bayes_ridge(v, "vec", "label"),
            "gp": MD.fit_gp(v.where("vec_id % 2 = 0"), key="vec_id", vec="vec", target="label", kernel=KERNEL)}
    monkeypatch.setattr(gp, "FACTOR_CELLS", cells)   # 700: the factor takes several passes
    out = MD.score_all_models(v.select("vec_id", "vec"), "vec", mods)
    assert out.columns == ["vec_id", "vec", "ridge", "bayes_mean", "bayes_std", "gp_mean", "gp_std"]
    if cells > 700:
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = {r.vec_id: r for r in out.collect()}
    x = np.array([got[i].vec for i in range(90)])
    mean, std = mods["gp"].predict_arrays(x)
    assert np.allclose([got[i].gp_mean for i in range(90)], mean) and np.allclose([got[i].gp_std for i in range(90)], std)
    xc = x - mods["bayes"].x_mean
    assert np.allclose([got[i].bayes_std for i in range(90)], np.sqrt(1 / mods["bayes"].alpha + ((xc @ mods["bayes"].sigma) * xc).sum(axis=1)))
    assert np.allclose([got[i].ridge for i in range(90)], x @ mods["ridge"].coef + mods["ridge"].intercept)
    full = mods["gp"].x[::2]
    k = KERNEL(mods["gp"].x, mods["gp"].x) + KERNEL.noise * np.eye(45)
    cross = KERNEL(mods["gp"].x, full)
    want = KERNEL.diag(full) - (cross * np.linalg.solve(k, cross)).sum(axis=0)
    assert np.allclose(mods["gp"].predict_arrays(full)[1], np.sqrt(want))


def test_stripes_of_the_factor_give_the_whole_sum(monkeypatch):
    rng = np.random.default_rng(2)
    w, ks = np.tril(rng.normal(size=(23, 23))), rng.normal(size=(23, 6))
    monkeypatch.setattr(gp, "STRIPE", 3)
    for cut in (0, 4, 11):
        segments = [(s[1], w[s[0]:s[2], :s[1]]) for s in ((cut, 10, 10), (max(cut, 10), 20, 20), (max(cut, 20), 23, 23)) if s[0] < s[2]]
        assert np.allclose(gp._explained(segments, ks, cut), ((w[cut:] @ ks) ** 2).sum(axis=0))


def test_regression_by_neighbours(spark):
    v = rows(spark)
    got = {r.vec_id: r.prediction for r in search.knn_regress(v, v.where("vec_id % 3 = 0"), 4, query_id="vec_id", train_id="vec_id", target="label").collect()}
    split = {r.vec_id: r.prediction for r in search.knn_regress(v, v.where(F.col("vec_id") % 3 == 0), 4, query_id="vec_id", train_id="vec_id",
                                                                 target="label", max_chunk_rows=7).collect()}
    assert len(got) == 90 and all(abs(got[i] - split[i]) < 1e-9 for i in got)


def test_spread_uses_all_cores_and_does_not_depend_on_the_files(spark, monkeypatch):
    monkeypatch.setattr(MD, "TASK_ROWS", (20, 200))
    v = rows(spark, n=900).unionByName(spark.createDataFrame([(None, [float(i)] * 5, 1.0) for i in range(300)], "vec_id long, vec array<double>, label double"))
    one, many = MD.spread(v.coalesce(1), "vec_id", "vec"), MD.spread(v.repartition(7), "vec_id", "vec")
    held = [sorted(map(repr, part)) for part in one.rdd.glom().collect()]
    assert len(held) == 8 and max(map(len, held)) < 2 * 1200 / 8      # four cores; keys that are null are dealt as well
    assert sorted(sum(held, [])) == sorted(map(repr, v.collect()))
    assert held == [sorted(map(repr, part)) for part in many.rdd.glom().collect()]
    fitted = [MD.fit_forest(x.where("vec_id IS NOT NULL"), "vec", "label", n_trees=3).toDebugString.split("\n", 1)[1] for x in (one, many)]
    assert fitted[0] == fitted[1]
    few = v.limit(15)
    assert MD.spread(few, "vec_id", "vec") is few


def test_query_sums_the_statistics_once_and_scores_one_file_with_all_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(MD, "TASK_ROWS", (20, 200))
    passes, vector_stats = [], MD.gram.vector_stats
    monkeypatch.setattr(MD.gram, "vector_stats", lambda df, *a, **k: passes.append(df.rdd.getNumPartitions()) or vector_stats(df, *a, **k))
    own = rows(spark, n=300).select("vec_id", F.col("vec").cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label"))
    own.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {r.vec_id: r for r in q_models.q_score_all_models(spark, str(tmp_path)).collect()}
    assert passes == [4] and len(out) == 300
    v = tables.vectors(spark, str(tmp_path))
    x = np.array([r.vec for r in v.orderBy("vec_id").collect()])
    bayes, ridge = MD.fit_bayes_ridge(v, "vec", "label").arrays(x), MD.fit_ridge_vec(v, "vec", "label").arrays(x)
    mean, std = MD.fit_gp(tables.learning_rows(v), key="vec_id", vec="vec", target="label", kernel=q_models.GP_KERNEL).predict_arrays(x)
    for name, want in (("ridge", ridge[0]), ("bayes_mean", bayes[0]), ("bayes_std", bayes[1]), ("gp_mean", mean), ("gp_std", std)):
        assert np.allclose([out[i][name] for i in range(300)], want)
    knn = search.knn_regress(v, tables.learning_rows(v), 4, query_id="vec_id", train_id="vec_id", target="label")
    assert all(out[r.vec_id].knn == r.prediction for r in knn.collect())


@pytest.mark.parametrize("n,jobs", [(24, False), (25, True), (70, True)])
def test_first_blocks_of_the_factor_take_no_job(spark, monkeypatch, n, jobs):
    monkeypatch.setattr(gp, "BLOCK", 8)
    monkeypatch.setattr(gp, "TILE", 10)
    monkeypatch.setattr(gp, "STRIPE", 5)
    v = rows(spark, n=n)
    model = MD.fit_gp(v, key="vec_id", vec="vec", target="label", kernel=KERNEL)
    assert (model.factor.table is not None) == jobs and model.residual < 1e-9
    x, y = model.x, np.arange(n) % 7
    dense, z = KERNEL(x, x) + KERNEL.noise * np.eye(n), x[::3] + 0.1
    cross = KERNEL(x, z)
    monkeypatch.setattr(gp, "FACTOR_CELLS", 500)
    cells = [sum(w.size for _, w in model.factor.rows(s, e)) for s, e in model.factor.groups()]
    assert len(cells) > 1 and max(cells) <= 500
    mean, std = model.predict_arrays(z)
    assert np.allclose(mean, cross.T @ np.linalg.solve(dense, y))
    assert np.allclose(std, np.sqrt(KERNEL.diag(z) - (cross * np.linalg.solve(dense, cross)).sum(axis=0)))


@pytest.mark.parametrize("n,on_driver", [(5, [5]), (24, []), (70, [])])
def test_driver_inverts_only_a_few_rows(spark, monkeypatch, n, on_driver):
    for name, value in (("BLOCK", 8), ("TILE", 10), ("STRIPE", 5)):
        monkeypatch.setattr(gp, name, value)
    sizes, inverse = [], gp._inverse_of_factor
    monkeypatch.setattr(gp, "_inverse_of_factor", lambda block: sizes.append(len(block)) or inverse(block))
    monkeypatch.setattr(gp.KernelSystem, "product", None)   # and solves nothing of that size either
    v = rows(spark, n=n)
    model = MD.fit_gp(v, key="vec_id", vec="vec", target="label", kernel=KERNEL)
    assert sizes == on_driver and model.keys.tolist() == list(range(n)) and model.residual < 1e-9
    x = np.array([r.vec for r in v.orderBy("vec_id").collect()])
    dense = KERNEL(x, x) + KERNEL.noise * np.eye(n)
    assert (model.x == x).all() and np.allclose(model.alpha, np.linalg.solve(dense, np.arange(n) % 7))
    whole = [w for s, e in model.factor.groups() for _, w in model.factor.rows(s, e)]
    low = np.vstack([np.pad(w, ((0, 0), (0, n - w.shape[1]))) for w in whole])
    assert np.allclose(low.T @ low, np.linalg.inv(dense))
