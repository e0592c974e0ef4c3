"""Invariants for learned / random operators (no SQL oracle)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolabe import tables
from astrolabe.operators import gram, models, reduce, search
from astrolabe.operators import resample as R
from tests.conftest import SF_SMALL

import __spark_entry__ as entry_mod

Q = entry_mod.queries()


def _vecs(spark):
    return tables.vectors(spark, SF_SMALL)


def test_pca_orthonormal_and_sorted(spark):
    m = reduce.fit_pca(_vecs(spark), "vec", k=10)
    comp = m.components
    assert np.allclose(comp @ comp.T, np.eye(10), atol=1e-8)
    assert np.all(np.diff(m.explained_variance) <= 1e-12)
    x = np.vstack([r.vec for r in _vecs(spark).collect()])
    ref = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:10]
    assert m.explained_variance == pytest.approx(ref, rel=1e-6)


def test_covariance_matches_numpy(spark):
    x = np.vstack([r.vec for r in _vecs(spark).orderBy("vec_id").collect()])
    c = {(r.i, r.j): r.cov for r in reduce.covariance(_vecs(spark), "vec").collect()}
    ref = np.cov(x.T, bias=True)
    assert c[(0, 0)] == pytest.approx(ref[0, 0]) and c[(3, 7)] == pytest.approx(ref[3, 7])


def test_kmeans_beats_random_centres(spark):
    v = _vecs(spark)
    model = reduce.fit_kmeans(v, "vec", k=10, seed=42)
    x = np.vstack([r.vec for r in v.collect()])
    cost = ((x[:, None, :] - np.array(model.clusterCenters())[None]) ** 2).sum(-1).min(1).sum()
    rnd = x[np.random.default_rng(0).choice(len(x), 10, replace=False)]
    cost_rnd = ((x[:, None, :] - rnd[None]) ** 2).sum(-1).min(1).sum()
    assert cost <= cost_rnd


def test_gp_equals_the_dense_gp(spark):
    v = _vecs(spark)
    train = v.where("vec_id < 20")
    k = models.Kernel(const=1.0, length=0.8, noise=0.05)
    gp = models.fit_gp(train, key="vec_id", vec="vec", target="label", kernel=k)
    tr = train.orderBy("vec_id").collect()
    xt = np.vstack([r.vec for r in tr])
    yt = np.array([r.label for r in tr], float)
    xq = np.vstack([r.vec for r in v.where("vec_id between 100 and 110").orderBy("vec_id").collect()])
    kk = k(xt, xt) + k.noise * np.eye(len(xt))
    ks = k(xt, xq)
    mean = ks.T @ np.linalg.solve(kk, yt)
    var = k.diag(xq) - np.einsum("ib,ib->b", ks, np.linalg.solve(kk, ks))
    m, s = gp.predict_arrays(xq)
    assert m == pytest.approx(mean, rel=1e-6, abs=1e-8)
    assert s == pytest.approx(np.sqrt(np.clip(var, 0, None)), rel=1e-5, abs=1e-6)


def test_bayes_ridge_close_to_ridge(spark):
    v = _vecs(spark)
    m = models.fit_bayes_ridge(v, "vec", "label")
    assert m.alpha > 0 and m.lambda_ > 0
    out = m.predict(v.select("vec_id", "vec"), "vec").collect()
    assert all(r.br_std > 0 for r in out)


def test_recommend_never_returns_an_anchor(spark):
    rows = Q["recommend"](spark, SF_SMALL).collect()
    assert all(r.entry >= 20 for r in rows)


def test_greedy_assignment_unique_and_nearest_first(spark):
    rows = Q["greedy_assignment"](spark, SF_SMALL).collect()
    assert len(rows) == 20
    assert len({r.entry for r in rows}) == 20
    first = min(rows, key=lambda r: r.step)
    v = _vecs(spark)
    a = np.array(v.where(f"vec_id = {first.anchor_id}").collect()[0].vec)
    others = [(np.linalg.norm(np.array(r.vec) - a), r.vec_id) for r in v.where("vec_id >= 20").collect()]
    assert min(others)[1] == first.entry


def test_group_split_is_disjoint(spark):
    o = tables.load(spark, SF_SMALL, "orders").select("o_custkey").distinct()
    m = R.group_shuffle_split(o, "o_custkey", 4, 0.2, seed=42)
    per = m.groupBy("split_id", "o_custkey").agg(F.countDistinct("is_test").alias("c"))
    assert per.where("c > 1").count() == 0
    n_groups = o.count()
    counts = {r.split_id: r.n for r in m.where("is_test").groupBy("split_id").agg(F.count("*").alias("n")).collect()}
    assert set(counts.values()) == {int(np.ceil(0.2 * n_groups))}


def test_bootstrap_is_deterministic(spark):
    p = tables.load(spark, SF_SMALL, "part").select("p_partkey")
    a = sorted(tuple(r) for r in R.bootstrap(p, ["p_partkey"]).collect())
    b = sorted(tuple(r) for r in R.bootstrap(p, ["p_partkey"]).collect())
    assert a == b and len(a) == p.count()


def test_masked_resample_sizes(spark):
    lab = tables.load(spark, SF_SMALL, "labels").select("doc_id", (F.col("quality") == 1).alias("side"))
    s = R.masked_resample(lab, "doc_id", "side", n_splits=3, fraction=0.5)
    sizes = {(r.split_id, r.side): r.n for r in s.groupBy("split_id", "side").agg(F.count("*").alias("n")).collect()}
    n_side = {r.side: r.n for r in lab.groupBy("side").agg(F.count("*").alias("n")).collect()}
    assert all(v == int(np.floor(0.5 * n_side[side])) for (_, side), v in sizes.items())


def test_fold_scores_match_direct_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 1.0 + x @ np.array([2.0, -1.0]) + rng.normal(scale=0.1, size=200)
    fold = np.arange(200) % 4
    df = spark.createDataFrame([(int(f), float(a), float(b), float(t)) for f, (a, b), t in zip(fold, x, y)],
                               "fold long, x1 double, x2 double, y double")
    st = gram.sufficient_stats(df, ["x1", "x2"], "y", ["fold"])
    sc = {r.fold: r.test_mse for r in gram.fold_scores(st, 2, "fold", [0.0], digits=None).collect()}
    for f in range(4):
        tr, te = fold != f, fold == f
        a = np.c_[np.ones(tr.sum()), x[tr]]
        w = np.linalg.lstsq(a, y[tr], rcond=None)[0]
        mse = np.mean((y[te] - np.c_[np.ones(te.sum()), x[te]] @ w) ** 2)
        assert sc[f] == pytest.approx(mse, rel=1e-6)


def test_vector_stats_tree_merge(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i % 3, x[i].tolist(), float(i)) for i in range(300)],
                               "g long, v array<double>, y double").repartition(7)
    st = {r.g: r for r in gram.vector_stats(df, "v", "y", ["g"], fan_in=2, centered=False).collect()}
    for g in range(3):
        xs = x[np.arange(300) % 3 == g]
        assert np.allclose(np.array(st[g].xtx).reshape(4, 4), xs.T @ xs)
        assert st[g].n == len(xs)


def test_model_roundtrip_same_predictions(spark):
    a = sorted(tuple(r) for r in Q["model_roundtrip"](spark, SF_SMALL).collect())
    assert len(a) == _vecs(spark).count()


@pytest.mark.parametrize("name", ["train_word_vectors", "pca_variance", "kmeans_fit", "embedder_transform",
                                  "project_2d", "forest_fit", "boosted_fit", "gp_score", "gp_covariance",
                                  "score_all_models", "predict_list", "demo_set", "recommend_batch_scored",
                                  "hyperparam_importance", "forest_importance", "bayes_ridge",
                                  "tree_grid_search", "build_store", "store_recommend"])
def test_rows_only_queries_run(spark, name):
    assert Q[name](spark, SF_SMALL).count() > 0


def test_recommend_chunked_anchors_exact(spark):
    from astrolabe.plans.recommend import recommend
    v = _vecs(spark)
    one = sorted(tuple(r) for r in recommend(v, v.where("vec_id < 20")).collect())
    many = sorted(tuple(r) for r in recommend(v, v.where("vec_id < 20"), max_chunk_rows=7).collect())
    assert one == many and len(one) == 156


def test_greedy_assignment_matches_brute_force(spark):
    v = _vecs(spark)
    rows = Q["greedy_assignment"](spark, SF_SMALL).collect()
    got = {r.anchor_id: r.entry for r in rows}
    anchors = sorted(v.where("vec_id < 20").collect(), key=lambda r: r.vec_id)
    cands = sorted(v.where("vec_id >= 20").collect(), key=lambda r: r.vec_id)
    cm = np.array([r.vec for r in cands])
    ids = np.array([r.vec_id for r in cands])
    taken, expect = set(), {}
    for a in anchors:  # walk queries in order; each takes its nearest free candidate
        d = np.sqrt(((cm - np.array(a.vec)) ** 2).sum(1))
        for j in np.lexsort((ids, d)):
            if ids[j] not in taken:
                taken.add(ids[j])
                expect[a.vec_id] = ids[j]
                break
    assert got == expect


def test_bayes_ridge_matches_rowwise_evidence(spark):
    v = _vecs(spark)
    m = models.fit_bayes_ridge(v, "vec", "label")
    rows = v.collect()
    x = np.array([r.vec for r in rows])
    y = np.array([r.label for r in rows], float)
    xc, yc = x - x.mean(0), y - y.mean()
    eig = np.clip(np.linalg.eigvalsh(xc.T @ xc), 0, None)
    alpha, lam, coef = 1.0 / (yc.var() + 1e-12), 1.0, np.zeros(x.shape[1])
    for _ in range(300):
        new = alpha * np.linalg.solve(lam * np.eye(x.shape[1]) + alpha * xc.T @ xc, xc.T @ yc)
        sse = ((yc - xc @ new) ** 2).sum()
        gamma = np.sum(alpha * eig / (lam + alpha * eig))
        lam = (gamma + 2e-6) / (new @ new + 2e-6)
        alpha = (len(y) - gamma + 2e-6) / (sse + 2e-6)
        done = np.sum(np.abs(coef - new)) < 1e-3
        coef = new
        if done:
            break
    assert m.coef == pytest.approx(coef, rel=1e-5, abs=1e-7)
    assert m.alpha == pytest.approx(alpha, rel=1e-5)


def test_sum_pool_equals_word2vec_mean_times_count(spark):
    # M3: item vector = sum of token vectors; Spark's Word2Vec.transform averages,
    # so the sum equals transform x number of tokens (all tokens are in the vocabulary)
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    from astrolabe.operators import pooling
    from astrolabe.operators import text as X
    docs = spark.createDataFrame([(1, "a b c a"), (2, "b c"), (3, "c c c d")], "doc_id long, text string")
    toks = docs.select("doc_id", X.token_sentence("text", radius=0).alias("tokens"))
    model = Word2Vec(vectorSize=5, minCount=1, seed=1, inputCol="tokens", outputCol="m").fit(toks)
    vocab = model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("tvec"))
    pooled = {r.doc_id: np.array(r.vec) for r in pooling.pool_trained(toks, "doc_id", "tokens", vocab, "token", "tvec", 5, heavy_bytes=80).collect()}
    assert len(pooled) == 3
    via_mean = {r.doc_id: np.array(r.m) * len(r.tokens)
                for r in model.transform(toks).select("doc_id", "tokens", vector_to_array("m").alias("m")).collect()}
    for d in pooled:
        assert np.allclose(pooled[d], via_mean[d], atol=1e-6)


def test_models_have_the_references_sizes(spark):
    # 300 dimensions a word; as many components as the vectors allow, up to 70
    assert {len(r.vector) for r in Q["train_word_vectors"](spark, SF_SMALL).limit(20).collect()} == {300}
    assert {len(r.pca) for r in Q["embedder_transform"](spark, SF_SMALL).collect()} == {64}
    from astrolabe.plans.q_models import _store
    assert {len(r.pca) for r in _store(spark, SF_SMALL).select("pca").collect()} == {70}
