"""Inputs that fixtures lack: offsets, NaN, zero vectors, string keys, several chunks, messy white space."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from astrolabe.operators import gram, models, reduce, search, splits, stats
from astrolabe.operators import text as X
from astrolabe.plans.q_ml import fit_table
from astrolabe.plans.recommend import recommend
from astrolabe.sources import io


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


# ---- moments ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def offset(spark):
    rng = np.random.default_rng(1)
    k = np.arange(400.0)
    x = np.c_[1e9 + k, 1e9 + rng.normal(size=400)]
    y = 3 * k + 1 + 0.5 * (x[:, 1] - 1e9) + rng.normal(scale=0.01, size=400)
    rows = [(float(a), float(b), [float(a), float(b)], float(t), i % 4) for i, ((a, b), t) in enumerate(zip(x, y))]
    return frame(spark, rows, "x1 double, x2 double, v array<double>, y double, fold long"), x, y


def direct(x, y):
    xc = x - x.mean(axis=0)
    w = np.linalg.lstsq(xc, y - y.mean(), rcond=None)[0]
    return y.mean() - x.mean(axis=0) @ w, w


def test_linear_fit_near_1e9(spark, offset):
    df, x, y = offset
    b0, w = direct(x[:, :1], y)
    got = fit_table(gram.sufficient_stats(df, ["x1"], "y"), 1).first()
    assert abs(got.w0 - w[0]) < 1e-6 and got.intercept == pytest.approx(b0, rel=1e-9)
    assert abs(df.selectExpr("regr_slope(y, x1) s").first().s - got.w0) < 1e-6


def test_folds_and_ridge_near_1e9(spark, offset):
    df, x, y = offset
    fold = np.arange(400) % 4
    st = gram.sufficient_stats(df, ["x1", "x2"], "y", ["fold"])
    for r in gram.fold_scores(st, 2, "fold", [0.0], digits=None).collect():
        b0, w = direct(x[fold != r.fold], y[fold != r.fold])
        res = y[fold == r.fold] - b0 - x[fold == r.fold] @ w
        assert r.test_mse == pytest.approx(np.mean(res ** 2), rel=1e-4)
    model = models.fit_ridge_vec(df, "v", "y", alpha=0.0)
    assert np.allclose(model.coef, direct(x, y)[1], atol=1e-6)
    bayes = models.fit_bayes_ridge(df, "v", "y")
    assert np.allclose(bayes.coef, direct(x, y)[1], atol=1e-2)


def test_no_intercept_fit_goes_through_zero(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(5, 1, (100, 1)), rng.normal(7, 1, 100)
    df = frame(spark, [(float(a), float(b), 0) for (a,), b in zip(x, y)], "x double, y double, fold long")
    got = fit_table(gram.sufficient_stats(df, ["x"], "y"), 1, alpha=2.0, intercept=False).first()
    assert got.intercept == 0 and abs(got.w0 - (x[:, 0] @ y) / (x[:, 0] @ x[:, 0] + 2.0)) < 1e-6


def test_learning_curve_near_1e9(spark, offset):
    df, x, y = offset
    rows = df.selectExpr("CAST(x1 - 1e9 AS LONG) AS k", "x1", "y")
    curve = lambda df: {(r.step, r.split_id): r.mse for r in splits.learning_curve(
        df.where("k % 7 <> 0"), df.where("k % 7 = 0"), "k", ["x1"], "y", [0.5, 1.0], n_splits=3).collect()}
    assert curve(rows) == pytest.approx(curve(rows.selectExpr("k", "x1 - 1e9 AS x1", "y")), rel=1e-4)


def test_covariance_and_pca_near_1e9(spark, offset):
    df, x, _ = offset
    cov = {(r.i, r.j): r.cov for r in reduce.covariance(df, "v").collect()}
    want = np.cov(x.T, bias=True)
    assert all(cov[i, j] == pytest.approx(want[i, j], rel=1e-6, abs=1e-6) for i in range(2) for j in range(2))
    assert np.allclose(reduce.fit_pca(df, "v").mean, x.mean(axis=0))


def test_constant_fold_has_no_r2(spark):
    df = frame(spark, [(float(i), 1.0 if i % 2 else float(i), i % 2) for i in range(20)], "x double, y double, fold long")
    st = gram.sufficient_stats(df, ["x"], "y", ["fold"])
    got = {r.fold: r.test_r2 for r in gram.fold_scores(st, 1, "fold", [0.0, 1.0]).collect()}
    assert got[1] is None and got[0] is not None
    assert gram.best_fold_refit(st, 1, "fold").first().best_fold == 0


def test_dimension_sweep_is_the_direct_one(spark):
    rng = np.random.default_rng(8)
    x, fold = rng.normal(size=(120, 6)) + 1e6, np.arange(120) % 3
    y = x[:, 0] - 2 * x[:, 4] + rng.normal(size=120)
    df = frame(spark, [(v.tolist(), float(t), int(f)) for v, t, f in zip(x, y, fold)], "v array<double>, y double, fold long")
    got = {r.n_dims: r.mean_score for r in gram.dimension_sweep(df, "v", "y", "fold", [1, 5]).collect()}
    for k, score in got.items():
        errors = []
        for f in range(3):
            b0, w = direct(x[fold != f][:, :k], y[fold != f])
            errors.append(np.mean((y[fold == f] - b0 - x[fold == f][:, :k] @ w) ** 2))
        assert score == pytest.approx(np.mean(errors), rel=1e-5)


def test_dot_product_kernel_and_variance_root(spark):
    rng = np.random.default_rng(9)
    x, y, z = rng.normal(size=(15, 3)), rng.normal(size=15), rng.normal(size=(6, 3))
    kernel = models.Kernel(const=0.0, rq_const=1.0, rq_length=1.5, rq_alpha=0.7, dot_const=1.0, dot_sigma=0.8, noise=0.1)
    train = frame(spark, [(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "k long, v array<double>, y double")
    gp = models.fit_gp(train, key="k", vec="v", target="y", kernel=kernel)
    inv = np.linalg.inv(kernel(x, x) + 0.1 * np.eye(15))
    mean, std = gp.predict_arrays(z)
    assert np.allclose(mean, kernel(z, x) @ inv @ y, atol=1e-5)
    assert np.allclose(std ** 2, np.diag(kernel(z, z) - kernel(z, x) @ inv @ kernel(x, z)), atol=1e-5)
    assert np.allclose(np.diag(kernel(z, z)), kernel.diag(z))


def test_signed_reaction_numbers(spark):
    from astrolabe.operators import graph
    lines = spark.createDataFrame([("H2 CN  1.000e-10 2.500e+00 -3.1000e-01 1 logn 4 10 280",)], "value string")
    assert graph.parse_reactions(lines).first().gamma == 0.31 and graph.parse_reactions(lines, signed=True).first().gamma == -0.31


# ---- percentiles and profiles ------------------------------------------------------

def test_percentiles_skip_nan_and_infinite(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=3000), np.full(2000, 0.25), rng.normal(1e6, 1, 500)]
    rows = [(float(v),) for v in x] + [(float("nan"),), (None,), (float("inf"),), (float("-inf"),)] * 5
    got = stats.exact_percentiles(frame(spark, rows, "v double"), "v", [0.0, 0.03, 0.5, 0.97, 1.0]).first()
    assert np.allclose(list(got), np.quantile(x, [0, 0.03, 0.5, 0.97, 1]), rtol=1e-12, atol=0)
    empty = stats.exact_percentiles(frame(spark, [(None,), (float("nan"),)], "v double"), "v", [0.5]).first()
    assert empty[0] is None


def vectors_frame(spark, ids, x, schema="vec_id long, vec array<double>, label int"):
    return frame(spark, [(i, v.tolist(), k % 5) for k, (i, v) in enumerate(zip(ids, x))], schema)


@pytest.mark.parametrize("chunk", [50_000, 3])
def test_profile_and_flags_equal_all_pairs(spark, chunk):
    rng = np.random.default_rng(4)
    a, c = rng.normal(size=(7, 5)), rng.normal(size=(60, 5))
    c[11] = 0.0  # no cosine: its pairs take no part
    d = 1 - (a @ c.T) / np.linalg.norm(a, axis=1)[:, None] / np.where(np.arange(60) == 11, np.nan, np.linalg.norm(c, axis=1))
    anchors = vectors_frame(spark, range(7), a).withColumnRenamed("vec_id", "anchor_id")
    cands = vectors_frame(spark, range(60), c)
    got = search.distance_profile(cands, anchors, [0.1, 0.97], ["p10", "p97"], digits=9, metric="cosine", max_chunk_rows=chunk).first()
    flat = d[~np.isnan(d)]
    want = [flat.min(), flat.max(), flat.mean(), flat.std(), *np.quantile(flat, [0.1, 0.97])]
    assert np.allclose(list(got), want, atol=1e-8)
    flags = {r.entry: r for r in search.distant_flag(cands, anchors, 0.6, 1.0, metric="cosine", max_chunk_rows=chunk).collect()}
    assert set(flags) == set(range(60)) - {11}
    upper = np.quantile(flat, 0.6)
    for i, r in flags.items():
        assert r.mean_d == pytest.approx(d[:, i].mean(), abs=1e-6) and r.above_pct == (d[:, i].mean() > upper)


# ---- neighbours ---------------------------------------------------------------------

@pytest.mark.parametrize("chunk", [50_000, 4])
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_one_answer_for_any_key_and_chunks(spark, chunk, metric, kind):
    rng = np.random.default_rng(5)
    a, c = rng.normal(size=(9, 4)), rng.normal(size=(80, 4))
    c[5] = 0.0
    c[6] = c[7]  # a tie
    key = (lambda i: i) if kind == "long" else (lambda i: f"k{i:03d}")
    schema = f"vec_id {kind}, vec array<double>, label int"
    cands = vectors_frame(spark, [key(i) for i in range(80)], c, schema)
    anchors = vectors_frame(spark, [key(900 + i) for i in range(9)], a, schema).withColumnRenamed("vec_id", "anchor_id")
    d = np.linalg.norm(a[:, None] - c[None], axis=2)
    if metric == "cosine":
        with np.errstate(invalid="ignore"):
            d = 1 - (a @ c.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(c, axis=1)
    got = search.knn_topk(cands, anchors, 6, metric=metric, anchor_target="label", predict_k=3, max_chunk_rows=chunk)
    assert got.columns == ["anchor_id", "entry", "distance", "prediction", "rank"]
    y = np.arange(9) % 5
    rows = got.collect()
    assert len(rows) == 54
    for r in rows:
        i = [key(900 + k) for k in range(9)].index(r.anchor_id)
        order = [key(j) for j in sorted(range(80), key=lambda j: (np.inf if np.isnan(d[i, j]) else d[i, j], j))]
        assert order[r["rank"] - 1] == r.entry and not np.isnan(r.distance)
        j = [key(k) for k in range(80)].index(r.entry)
        assert r.prediction == pytest.approx(y[sorted(range(9), key=lambda q: (d[q, j], q))[:3]].mean())
    far = {r.vec_id for r in search.distance_anti_join(cands, anchors, 0.9, metric=metric, max_chunk_rows=chunk).collect()}
    assert far == {key(j) for j in range(80) if not (np.abs(d[:, j]) <= 0.9).any()}
    for weights in ("uniform", "distance"):
        pred = {r.vec_id: r.prediction for r in search.knn_regress(cands, anchors, 3, query_id="vec_id", train_id="anchor_id", target="label",
                                                                   weights=weights, metric=metric, max_chunk_rows=chunk).collect()}
        for j in (0, 6, 33):
            near = sorted(range(9), key=lambda q: (d[q, j], q))[:3]
            w = np.ones(3) if weights == "uniform" else 1 / d[near, j]
            assert pred[key(j)] == pytest.approx((w * y[near]).sum() / w.sum())
        if metric == "cosine":
            assert pred.get(key(5)) is None


def test_recommend_is_the_same_in_chunks(spark):
    rng = np.random.default_rng(6)
    v = vectors_frame(spark, range(120), rng.normal(size=(120, 4)))
    inv = v.where("vec_id < 9")
    one = recommend(v, inv, top=4, dist_thres=0.5).collect()
    many = recommend(v, inv, top=4, dist_thres=0.5, max_chunk_rows=2).collect()
    assert one == many and len(one)


def test_greedy_assignment_in_rounds(spark):
    rng = np.random.default_rng(7)
    c, q = rng.normal(size=(40, 2)), rng.normal(scale=0.05, size=(25, 2))  # all want the same few rows
    got = search.greedy_assignment(vectors_frame(spark, range(40), c), vectors_frame(spark, range(25), q).withColumnRenamed("vec_id", "anchor_id"),
                                   first_k=2).collect()
    taken, want = set(), {}
    for i in range(25):
        d = np.linalg.norm(c - q[i], axis=1)
        j = next(j for j in sorted(range(40), key=lambda j: (d[j], j)) if j not in taken)
        taken.add(j)
        want[i] = j
    assert {r.anchor_id: r.entry for r in got} == want and [r.step for r in sorted(got, key=lambda r: r.anchor_id)] == list(range(1, 26))
    few = search.greedy_assignment(vectors_frame(spark, range(3), c[:3]), vectors_frame(spark, range(5), q[:5]).withColumnRenamed("vec_id", "anchor_id"),
                                   first_k=2).collect()
    assert {r.anchor_id for r in few} == {0, 1, 2} and len({r.entry for r in few}) == 3


# ---- readers and logs -----------------------------------------------------------------

def test_series_with_messy_white_space(spark, tmp_path):
    (tmp_path / "s.txt").write_text("t x\n1.0   2.0\n\t3.5\t\t-4e1  \n\n 5 6\n7 oops\n")
    got = [tuple(r) for r in io.read_series(spark, str(tmp_path)).collect()]
    assert got == [(1.0, 2.0), (3.5, -40.0), (5.0, 6.0), (7.0, None)]


def test_one_value_per_line(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a b c \n\n \t\n\tlast one")
    assert [r.value for r in io.read_values(spark, str(tmp_path)).collect()] == ["a b c", "last one"]


def test_capped_scan_keeps_all_unless_asked(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("".join(f"{i}\tab{i}\n" for i in range(30)) + "99\t!!\n")
    assert io.read_capped_valid(spark, str(tmp_path), "^ab").count() == 30
    got = {r.value for r in io.read_capped_valid(spark, str(tmp_path), "^ab", n_max=4).collect()}
    assert got == {"ab0", "ab1", "ab2", "ab3"}


def test_following_lines_cross_rows(spark):
    rows = [("f", 1, "mark a\nx: 1\nmark b"), ("f", 2, "one"), ("f", 3, "two\nmark c"), ("g", 1, "mark d"), ("h", 5, None), ("h", 6, "mark e\n"), ("h", 7, "z")]
    df = spark.createDataFrame(rows, "file string, n int, text string")
    got = {(r.file, r.n, r.pos): r["__toks"] for r in X.next_line_tokens(df, ["file"], ["n"], "text", "mark", [], n_following=2).collect()}
    assert got == {("f", 1, 0): ["x:", "1", "mark", "b"], ("f", 1, 2): ["one", "two"], ("f", 3, 1): None, ("g", 1, 0): None,
                   ("h", 6, 0): ["z"]}


def test_ignore_list(spark):
    rows = [("d/10.log", "bad END"), ("d/9.log", "x BAD"), ("9.log", "BAD"), ("run_8.log", "BAD"), ("d/x.log", "BAD"), ("7.log", "fine"), ("6.log", None)]
    df = spark.createDataFrame(rows, "name string, text string")
    assert [tuple(r) for r in X.ignore_list(df, "name", "text", ["BAD", "END"]).orderBy("place").collect()] == [(9, 1), (10, 2)]


def test_long_counts_and_unknown_symbols(spark):
    from astrolabe.functions import scalar as S
    df = spark.createDataFrame([("C120H4",), ("C2Xx",), ("",)], "f string")
    got = df.select(S.element_count("f", "C").alias("c"), X.formula_mass("f", S.ATOMIC_MASS).alias("m")).collect()
    assert [r.c for r in got] == [120, 2, 0]
    assert got[0].m == pytest.approx(120 * 12.0107 + 4 * 1.00794) and got[1].m is None and got[2].m == 0.0


@pytest.mark.parametrize("case", ["decades", "extremes", "denormals", "one value", "two neighbours"])
def test_percentiles_take_few_passes_over_any_values(spark, monkeypatch, case):
    rng = np.random.default_rng(6)
    x = {"decades": np.concatenate([s * 10.0 ** rng.uniform(-20, 20, 4000) for s in (1, -1)]),
         "extremes": np.array([-1.5e308, 0, 1, 2, 1.5e308, -0.0, 1.7e308, -1.7e308]),
         "denormals": np.r_[rng.integers(0, 5000, 3000) * 5e-324, -5e-324, 1e-310],
         "one value": np.full(500, 0.1), "two neighbours": np.r_[np.full(300, 1.0), np.full(300, np.nextafter(1.0, 2))]}[case]
    passes, real = [], stats.select_ranks
    monkeypatch.setattr(stats, "select_ranks", lambda first, ranks, histogram: real(first, ranks, lambda *a: passes.append(1) or histogram(*a)))
    probs = [0.0, 0.03, 0.25, 0.5, 0.97, 1.0]
    got = stats.exact_percentiles(frame(spark, [(float(v),) for v in x], "v double"), "v", probs).first()
    ordered = np.sort(x)
    for p, g in zip(probs, got):
        at = p * (len(x) - 1)
        a, b, w = ordered[int(np.floor(at))], ordered[int(np.ceil(at))], at - np.floor(at)
        want = a * (1 - w) + b * w if a != b else a
        assert g == want or abs(g - want) <= 1e-12 * abs(want)
    assert 1 + len(passes) <= 6


def test_octave_bins_order_as_the_values(spark):
    x = np.sort(np.r_[0.0, [s * m * 2.0 ** e for s in (1, -1) for e in (-1074, -1022, -300, -1, 0, 1, 52, 1023) for m in (1, 1.0001, 1.5)]])
    x = np.unique(x[np.isfinite(x)])
    assert (np.diff(stats.octave_bin(x)) >= 0).all()
    got = [r.b for r in frame(spark, [(float(v),) for v in x], "v double").select("v", stats.octave_bin(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and max(got) < 70_000 and np.abs(np.array(got) - stats.octave_bin(x)).max() <= 1
