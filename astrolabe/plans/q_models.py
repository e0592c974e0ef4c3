"""Registered queries whose result is learned or random by construction (checked by
row counts here and by invariants in ``tests/``): M2, M6, M7, M9, M13, L3, L5-L8,
L22 importances, L27, S15, R3, R5, J9 composites."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from astrolabe import tables
from astrolabe.functions.scalar import round6
from astrolabe.functions import vectors as V
from astrolabe.operators import models as MD
from astrolabe.operators import forest, gram, pairs, reduce, search, stats, wordvec
from astrolabe.operators.resample import fold_sql
from astrolabe.operators import text as X
from astrolabe.plans.registry import register
from astrolabe.session import scratch_path

# The reference's sizes: dimensions and passes of the word vectors, most principal components, clusters.
WORD_DIM, WORD_PASSES, MOST_COMPONENTS, CLUSTERS = 300, 5, 70, 20

# Fixed kernel parameters of the GP scorer (inputs, not tuned here).
GP_KERNEL = MD.Kernel(const=1.0, length=0.8, rq_const=0.5, rq_length=1.0, rq_alpha=1.0, bias=0.1, noise=0.05)


def _components(v):
    """As many components as the vectors allow, up to the reference's."""
    return min(MOST_COMPONENTS, v.select(F.size("vec")).first()[0])


def _inventory(v):
    return tables.learning_rows(v)


@register("train_word_vectors")
def q_train_word_vectors(spark, sf):
    """M2: CBOW word vectors with negative sampling over the whole corpus, at the reference's dimensions and passes."""
    docs = tables.load(spark, sf, "documents").select("doc_id", X.token_sentence("text", radius=0).alias("tokens"))
    return wordvec.train_cbow(docs, "doc_id", "tokens", dim=WORD_DIM, passes=WORD_PASSES)


@register("pca_moments", """
WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT a.i, b.i AS j, covar_pop(a.x, b.x) AS cov FROM u a JOIN u b ON a.vec_id = b.vec_id GROUP BY a.i, b.i)
SELECT round(sum(CASE WHEN i = j THEN cov END), 6) AS total_variance, round(sum(cov * cov), 9) AS sum_of_squares,
       CAST(count(DISTINCT i) AS BIGINT) AS n_components FROM c
""")
def q_pca_moments(spark, sf):
    """M6: the components' variances sum to the covariance's trace, their squares to its squared norm."""
    model = reduce.fit_pca(tables.vectors(spark, sf), "vec")
    t = reduce.variance_table(model, spark)
    return t.agg(round6(F.sum("variance")).alias("total_variance"),
                 round6(F.sum(F.col("variance") * F.col("variance")), 9).alias("sum_of_squares"),
                 F.count(F.lit(1)).alias("n_components"))


@register("pca_variance")
def q_pca_variance(spark, sf):
    """M6: explained variance per component (exact, centred, population covariance)."""
    model = reduce.fit_pca(tables.vectors(spark, sf), "vec", k=10)
    return reduce.variance_table(model, spark)


@register("kmeans_fit")
def q_kmeans_fit(spark, sf):
    """M7: k-means (k=20, seed 42) labels for every vector."""
    v = tables.vectors(spark, sf)
    model = reduce.fit_kmeans(v, "vec", k=20, seed=42)
    return reduce.kmeans_assign(model, v, "vec").select("vec_id", "cluster_id")


@register("embedder_transform")
def q_embedder_transform(spark, sf):
    """M9: scaler → PCA → k-means; the embedder applies all but the last stage."""
    v = tables.vectors(spark, sf)
    from pyspark.ml.functions import array_to_vector
    _, embedder = reduce.fit_embedder(v, "vec", k_pca=_components(v), k_clusters=CLUSTERS)
    out = embedder.transform(v.withColumn("__features", array_to_vector("vec")))
    return out.select("vec_id", vector_to_array("__pca").alias("pca"))


@register("project_2d")
def q_project_2d(spark, sf):
    """M13 (re-aimed): first two principal components as plot coordinates."""
    v = tables.vectors(spark, sf)
    model = reduce.fit_pca(v, "vec", k=2)
    return reduce.project_2d(model, v.select("vec_id", "vec"), "vec").select("vec_id", "x", "y")


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """Fit, save to the shared folder, load, and score with the loaded model."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import array_to_vector
    v = tables.vectors(spark, sf)
    model, _ = reduce.fit_embedder(v, "vec", k_pca=_components(v), k_clusters=CLUSTERS)
    path = scratch_path(spark, "embedder-model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    return loaded.transform(v.withColumn("__features", array_to_vector("vec"))).select("vec_id", "cluster_id")


@register("bayes_ridge")
def q_bayes_ridge(spark, sf):
    """L3: Bayesian ridge mean and predictive std for every vector (y = label)."""
    v = tables.vectors(spark, sf)
    m = MD.fit_bayes_ridge(v, "vec", "label")
    return m.predict(v.select("vec_id", "vec"), "vec").select("vec_id", "br_mean", "br_std")


@register("forest_fit")
def q_forest_fit(spark, sf):
    """Random forest predictions (y = label)."""
    v = tables.vectors(spark, sf)
    m = MD.fit_forest(v, "vec", "label")
    return MD.tree_predict(m, v.select("vec_id", "vec"), "vec", "prediction").select("vec_id", "prediction")


@register("forest_importance")
def q_forest_importance(spark, sf):
    """Feature importances of the forest."""
    v = tables.vectors(spark, sf)
    return MD.importances(MD.fit_forest(v, "vec", "label"), spark)


@register("boosted_fit")
def q_boosted_fit(spark, sf):
    """Gradient-boosted trees predictions (y = label)."""
    v = tables.vectors(spark, sf)
    m = MD.fit_boosted(v, "vec", "label")
    return MD.tree_predict(m, v.select("vec_id", "vec"), "vec", "prediction").select("vec_id", "prediction")


def _gp(spark, sf):
    v = tables.vectors(spark, sf)
    return v, MD.fit_gp(_inventory(v), key="vec_id", vec="vec", target="label", kernel=GP_KERNEL)


@register("gp_score")
def q_gp_score(spark, sf):
    """GP mean and std over the whole store, trained on the inventory."""
    v, gp = _gp(spark, sf)
    return gp.predict(v.select("vec_id", "vec"), "vec").select("vec_id", "gp_mean", "gp_std")


@register("gp_residual", """
SELECT vec_id, CAST(label AS DOUBLE) AS target FROM embeddings WHERE vec_id % 50 = 0
""")
def q_gp_residual(spark, sf):
    """At a training row the mean and the noise times its weight add up to the target, if the system is solved."""
    v, gp = _gp(spark, sf)
    at = gp.predict(_inventory(v).select("vec_id", "vec"), "vec").join(gp.weights(spark, "vec_id"), "vec_id")
    return at.select("vec_id", round6(F.col("gp_mean") + gp.kernel.noise * F.col("alpha")).alias("target"))


@register("gp_covariance")
def q_gp_covariance(spark, sf):
    """Posterior covariance among all rows, each row by its mean and its largest partner."""
    v, gp = _gp(spark, sf)
    rows = pairs.row_summaries(v, metric=gp.covariance, diagonal=0.0)
    return rows.select("i", (F.col("total") / F.col("n")).alias("mean_cov"), "top_j", F.col("top_value").alias("top_cov"))


@register("score_all_models")
def q_score_all_models(spark, sf):
    """Every candidate scored by every model, one column each."""
    v = MD.spread(tables.vectors(spark, sf), "vec_id", "vec")
    inv = _inventory(v)

    def linear():
        stats = gram.vector_stats(v, "vec", "label").collect()[0]
        return MD.fit_ridge_vec(v, "vec", "label", alpha=1.0, stats=stats), MD.fit_bayes_ridge(v, "vec", "label", stats=stats)

    with ThreadPoolExecutor() as pool:   # none needs another's result, and each leaves cores idle between its jobs
        trees = pool.submit(MD.fit_forest, v, "vec", "label")   # the longest row of jobs first
        gp = pool.submit(MD.fit_gp, inv, key="vec_id", vec="vec", target="label", kernel=GP_KERNEL)
        both = pool.submit(linear)
        near = pool.submit(search.knn_regress, v, inv, 4, query_id="vec_id", train_id="vec_id", target="label")
    mods = {"ridge": both.result()[0], "bayes": both.result()[1], "gp": gp.result(), "forest": trees.result()}
    out = MD.score_all_models(v.select("vec_id", "vec"), "vec", mods)
    return out.drop("vec").join(near.result().withColumnRenamed("prediction", "knn"), "vec_id")


@register("predict_list")
def q_predict_list(spark, sf):
    """Predictions for a list of keys (here: the inventory's keys)."""
    v, gp = _gp(spark, sf)
    keys = _inventory(v).select("vec_id")
    return predict_list(gp, v, keys=keys)


def predict_list(model, store, keys=None, vectors=None):
    """Predict for keys (looked up in the store) or for given vectors; one is required."""
    if keys is None and vectors is None:
        raise ValueError("predict_list needs keys or vectors")
    rows = vectors if vectors is not None else store.join(keys, "vec_id", "left_semi")
    return model.predict(rows.select("vec_id", "vec"), "vec").select("vec_id", "gp_mean", "gp_std")


@register("demo_rows", """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
p AS (SELECT s AS anchor_id, list_transform(list_zip(a.vec, b.vec), lambda z: z[1] + (z[2] - z[1]) * (s / 7.0)) AS pvec
      FROM (SELECT unnest(range(8)) AS s), (SELECT vec FROM v WHERE vec_id = 0) a, (SELECT vec FROM v WHERE vec_id = 1) b),
d AS (SELECT anchor_id, vec_id, list_distance(pvec, vec) AS distance FROM p, v),
g AS (SELECT -1::BIGINT AS anchor_id, NULL::BIGINT AS vec_id, []::BIGINT[] AS taken
      UNION ALL
      SELECT g.anchor_id + 1, n.vec_id, list_append(g.taken, n.vec_id)
      FROM g, LATERAL (SELECT arg_min(d.vec_id, (d.distance, d.vec_id)) AS vec_id FROM d
                       WHERE d.anchor_id = g.anchor_id + 1 AND NOT list_contains(g.taken, d.vec_id)) n
      WHERE g.anchor_id < 7)
SELECT g.anchor_id, g.vec_id, round(list_distance(v.vec, z.vec), 6) AS distance, CAST(v.label AS BIGINT) AS truth
FROM g JOIN v USING (vec_id), (SELECT vec FROM v WHERE vec_id = 0) z WHERE g.anchor_id >= 0
""")
def q_demo_rows(spark, sf):
    """R5 up to scoring: the rows of the demo set, with distance to the start item and truth."""
    return demo_rows(tables.vectors(spark, sf)).select(
        "anchor_id", "vec_id", round6("distance").alias("distance"), F.col("label").cast("long").alias("truth"))


def demo_rows(v):
    """8 points between two items, their greedy one-to-one nearest rows, and the distance to the start item."""
    a = v.where("vec_id = 0").select(F.col("vec").alias("va"))
    b = v.where("vec_id = 1").select(F.col("vec").alias("vb"))
    ends = stats.with_scalars(a, b)  # both ends in one row
    pts = (ends.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step"), "va", "vb")
           .select(F.col("step").cast("long").alias("anchor_id"), V.lerp("va", "vb", F.col("step") / 7.0).alias("vec")))
    assigned = search.greedy_assignment(v, pts)
    rows = v.join(assigned.select(F.col("entry").alias("vec_id"), "anchor_id"), "vec_id")
    start = v.where("vec_id = 0").select(F.col("vec").alias("v0"))
    return stats.with_scalars(rows, start).withColumn("distance", V.euclidean("vec", "v0")).drop("v0")


@register("demo_set")
def q_demo_set(spark, sf):
    """The demo rows with model predictions and truth, sorted by distance."""
    v = tables.vectors(spark, sf)
    rows = demo_rows(v)
    gp = MD.fit_gp(_inventory(v), key="vec_id", vec="vec", target="label", kernel=GP_KERNEL)
    ridge = MD.fit_ridge_vec(v, "vec", "label", alpha=1.0)
    scored = ridge.predict(gp.predict(rows, "vec"), "vec", "ridge")
    from astrolabe.functions.scalar import log10_pos
    return scored.select("anchor_id", "vec_id", "distance", "gp_mean", "gp_std", "ridge",
                         F.col("label").alias("truth"), log10_pos("label").alias("log_truth")).orderBy("distance")


@register("recommend_batch_scored")
def q_recommend_batch_scored(spark, sf):
    """R2 with scoring: the filtered batch, then GP mean and std per recommendation."""
    from astrolabe.plans.q_composite import recommend_batch_rows
    v, gp = _gp(spark, sf)
    from astrolabe.sources import io
    recs = recommend_batch_rows(spark, sf)
    with_vec = recs.join(v.select(F.col("vec_id").alias("entry"), "vec"), "entry")
    # scored once, as a table that the batch's outputs are written from
    store = scratch_path(spark, "recommendations")
    gp.predict(with_vec, "vec").drop("vec").write.parquet(store)
    scored = spark.read.parquet(store)
    # the two outputs: a CSV table (S13) and a one-per-line target list (S14); the result is what they hold
    table, lines = scratch_path(spark, "recommendations-csv"), scratch_path(spark, "targets")
    io.write_csv(scored, table)
    io.write_lines(scored, "entry", lines)
    back = spark.read.schema(scored.schema).option("header", True).csv(table)
    targets = spark.read.text(lines).select(F.col("value").cast("long").alias("entry"))
    return back.join(targets, "entry", "left_semi")


@register("hyperparam_importance")
def q_hyperparam_importance(spark, sf):
    """Forest importances of the ordinal-coded settings for the CV score."""
    from pyspark.sql.functions import array
    from astrolabe.plans import q_ml
    scores = q_ml.q_random_search(spark, sf)
    feats = scores.select(array(F.log10("alpha"), F.col("fit_intercept").cast("double")).alias("vec"),
                          F.col("mean_score").alias("y"))
    m = MD.fit_forest(feats, "vec", "y", n_trees=10, max_depth=3)
    return MD.importances(m, spark)


@register("tree_grid_search")
def q_tree_grid_search(spark, sf):
    """L10 for trees: 72 settings of a forest over five hash folds, one pass over the rows per level of all of them."""
    from astrolabe.operators.resample import fold_of
    v = tables.vectors(spark, sf).withColumn("fold", fold_of(F.col("vec_id"), 5))
    grid = forest.settings_grid([1, 2, 3, 4], [1, 5, 10], [1, 5, 20], [0.33, 1.0])
    out = forest.grid_scores(v, "vec_id", "vec", "label", "fold", grid)
    return out.select("max_depth", "n_trees", "min_leaf", "feature_share", *[round6(c).alias(c) for c in ("mean_mse", "std_mse", "mean_r2")], "rank")


@register("stump_grid", f"""
WITH b AS (SELECT {fold_sql('vec_id', 5)} AS fold, vec_id, CAST(label AS DOUBLE) AS y, generate_subscripts(embedding, 1) AS f,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
e AS (SELECT f, min(x) AS lo, max(x) AS hi FROM b GROUP BY f),
c AS (SELECT b.fold, vec_id, y, b.f, CAST(greatest(0, least(15, floor((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END * 16))) AS INTEGER) AS bin
      FROM b JOIN e ON b.f = e.f),
o AS (SELECT DISTINCT fold AS out_fold FROM b),
h AS (SELECT out_fold, f, bin, count(*) AS w, sum(y) AS s FROM c JOIN o ON c.fold <> o.out_fold GROUP BY out_fold, f, bin),
k AS (SELECT unnest(range(15)) AS cut),
l AS (SELECT out_fold, f, cut, sum(CASE WHEN bin <= cut THEN w ELSE 0 END) AS wl, sum(CASE WHEN bin <= cut THEN s ELSE 0 END) AS sl,
             sum(w) AS w, sum(s) AS s FROM h, k GROUP BY out_fold, f, cut),
m AS (SELECT unnest([1, 5, 20]) AS min_leaf),
g AS (SELECT *, round((sl * sl / wl + (s - sl) * (s - sl) / (w - wl) - s * s / w) / (s * s / w), 10) AS gain FROM l, m
      WHERE wl >= min_leaf AND w - wl >= min_leaf AND wl > 0 AND w > wl),
t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY out_fold, min_leaf ORDER BY gain DESC, f, cut) = 1),
p AS (SELECT min_leaf, c.fold, (c.y - CASE WHEN c.bin <= t.cut THEN t.sl / t.wl ELSE (t.s - t.sl) / (t.w - t.wl) END) ^ 2 AS err
      FROM c JOIN t ON c.fold = t.out_fold AND c.f = t.f),
x AS (SELECT min_leaf, fold, avg(err) AS mse FROM p GROUP BY min_leaf, fold)
SELECT CAST(min_leaf AS INTEGER) AS min_leaf, round(avg(mse), 6) AS mean_mse, round(stddev_pop(mse), 6) AS std_mse FROM x GROUP BY min_leaf
""")
def q_stump_grid(spark, sf):
    """The smallest trees of the forest grid (one split, no bootstrap), for three leaf sizes at once."""
    from astrolabe.operators.resample import fold_of
    v = tables.vectors(spark, sf).withColumn("fold", fold_of(F.col("vec_id"), 5))
    out = forest.grid_scores(v, "vec_id", "vec", "label", "fold", forest.settings_grid([1], [1], [1, 5, 20], [1.0]), bootstrap=False)
    return out.select("min_leaf", round6("mean_mse").alias("mean_mse"), round6("std_mse").alias("std_mse"))


def _store(spark, sf):
    from astrolabe.plans.store import build_vector_store
    docs = tables.load(spark, sf, "documents").select("doc_id", "text")
    return build_vector_store(docs, "doc_id", "text", scratch_path(spark, "vector-store"), dim=WORD_DIM,
                              k_pca=MOST_COMPONENTS, k_clusters=CLUSTERS)


@register("build_store")
def q_build_store(spark, sf):
    """§3.1 as one job: documents → sentences → summed vectors → standardise → PCA →
    k-means → Parquet partitioned by cluster; reported as rows per cluster."""
    return _store(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@register("store_recommend")
def q_store_recommend(spark, sf):
    """R1 served from the cluster-partitioned store: the cluster semi-join prunes
    whole partition directories (dynamic partition pruning)."""
    from astrolabe.plans.recommend import recommend
    store = _store(spark, sf).select(F.col("doc_id").alias("vec_id"), F.col("pca").alias("vec"), "cluster_id")
    docs = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"),
                                                      F.log10("n_chars").alias("y"))
    items = store.join(docs, "vec_id")
    anchors = tables.inventory(items)
    return recommend(items, anchors, top=10, cluster_col="cluster_id", target_col="y")


# ---- properties of learned results that SQL can state -------------------------------------------

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_CENTRED = """WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT i, avg(x) AS mu, stddev_samp(x) AS sd FROM u GROUP BY i)"""


@register("word_vector_words", f"""
SELECT DISTINCT unnest({_WORDS}) AS word, 8 AS n_dims FROM documents
""")
def q_word_vector_words(spark, sf):
    """M2: every word of the corpus has one vector of the wanted length."""
    docs = tables.load(spark, sf, "documents").select("doc_id", X.token_sentence("text", radius=0).alias("tokens"))
    return wordvec.train_cbow(docs, "doc_id", "tokens", dim=8, passes=1).select("word", F.size("vector").alias("n_dims"))


@register("kmeans_nearest", """
SELECT vec_id, true AS at_nearest FROM embeddings
""")
def q_kmeans_nearest(spark, sf):
    """M7 / M8: the label of every row is its nearest centre, found by the distance kernel."""
    v = tables.vectors(spark, sf)
    model = reduce.fit_kmeans(v, "vec", k=CLUSTERS, seed=42)
    labelled = reduce.kmeans_assign(model, v, "vec").select("vec_id", F.col("cluster_id").cast("long").alias("label"), "vec")
    centres = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "cluster_id long, centre array<double>")
    near = reduce.assign_to_centres(v.select("vec_id", "vec"), centres, key="vec_id").withColumnRenamed("distance", "nearest")
    own = labelled.join(centres, F.col("label") == F.col("cluster_id")).select("vec_id", V.euclidean("vec", "centre").alias("own"))
    return own.join(near, "vec_id").select("vec_id", (F.col("own") <= F.col("nearest") + 1e-6).alias("at_nearest"))


@register("roundtrip_same", """
SELECT vec_id, true AS same FROM embeddings
""")
def q_roundtrip_same(spark, sf):
    """The loaded pipeline labels every row as the fitted one does."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import array_to_vector
    v = tables.vectors(spark, sf)
    model, _ = reduce.fit_embedder(v, "vec", k_pca=_components(v), k_clusters=CLUSTERS)
    path = scratch_path(spark, "embedder-model")
    model.write().overwrite().save(path)
    rows = v.select("vec_id", array_to_vector("vec").alias("__features"))
    a, b = (m.transform(rows).select("vec_id", F.col("cluster_id").alias(c)) for m, c in ((model, "a"), (PipelineModel.load(path), "b")))
    return a.join(b, "vec_id").select("vec_id", (F.col("a") == F.col("b")).alias("same"))


@register("pca_lengths", _CENTRED + """
SELECT vec_id, round(sum((x - mu) * (x - mu)), 6) AS sq_length FROM u JOIN m USING (i) GROUP BY vec_id
""")
def q_pca_lengths(spark, sf):
    """All components together keep a row's distance to the mean, so they are orthonormal and complete."""
    v = tables.vectors(spark, sf)
    made = reduce.fit_pca(v, "vec").transform(v.select("vec_id", "vec"), "vec", "p")
    return made.select("vec_id", round6(V.dot("p", "p")).alias("sq_length"))


@register("projection_moments", """
SELECT count(*) AS n, 0.0::DOUBLE AS mean_x, 0.0::DOUBLE AS mean_y, 0.0::DOUBLE AS cov_xy, true AS x_is_wider FROM embeddings
""")
def q_projection_moments(spark, sf):
    """Plot coordinates are centred, uncorrelated, and the first spreads at least as far."""
    p = q_project_2d(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
                                    F.covar_pop("x", "y").alias("c"), (F.var_pop("x") >= F.var_pop("y")).alias("x_is_wider"))
    return p.select("n", (F.abs(round6("mx"))).alias("mean_x"), F.abs(round6("my")).alias("mean_y"), F.abs(round6("c")).alias("cov_xy"), "x_is_wider")


@register("embedder_lengths", _CENTRED + """
SELECT vec_id, round(sum(((x - mu) / sd) * ((x - mu) / sd)), 4) AS sq_length FROM u JOIN m USING (i) GROUP BY vec_id
""")
def q_embedder_lengths(spark, sf):
    """With as many components as dimensions the embedder keeps a scaled row's length."""
    made = q_embedder_transform(spark, sf)
    return made.select("vec_id", round6(V.dot("pca", "pca"), 4).alias("sq_length"))


@register("bayes_ridge_mean", """
SELECT round(avg(label), 6) AS mean_label, 0 AS n_without_spread FROM embeddings
""")
def q_bayes_ridge_mean(spark, sf):
    """L3: the intercept is not penalised, so predictions of the learned rows average to their targets; every row has a spread."""
    p = q_bayes_ridge(spark, sf)
    return p.agg(round6(F.avg("br_mean")).alias("mean_label"), F.count_if(~(F.col("br_std") > 0)).cast("int").alias("n_without_spread"))


@register("predict_list_residual", """
SELECT vec_id, CAST(label AS DOUBLE) AS target FROM embeddings WHERE vec_id % 50 = 0
""")
def q_predict_list_residual(spark, sf):
    """Predictions for a list of learned keys, held against the solved system as in ``gp_residual``."""
    v, gp = _gp(spark, sf)
    made = predict_list(gp, v, keys=_inventory(v).select("vec_id")).join(gp.weights(spark, "vec_id"), "vec_id")
    return made.select("vec_id", round6(F.col("gp_mean") + gp.kernel.noise * F.col("alpha")).alias("target"))


@register("importance_sums", """
SELECT len(embedding)::BIGINT AS n_features, 1.0::DOUBLE AS total, 0::BIGINT AS n_negative FROM embeddings LIMIT 1
""")
def q_importance_sums(spark, sf):
    """Importances are shares of the whole."""
    return q_forest_importance(spark, sf).agg(F.count(F.lit(1)).alias("n_features"), round6(F.sum("importance")).alias("total"),
                                              F.count_if(F.col("importance") < 0).alias("n_negative"))


@register("store_rows", f"""
SELECT count(*) AS n FROM documents WHERE len({_WORDS}) > 0
""")
def q_store_rows(spark, sf):
    """The store holds every document with a token once."""
    return q_build_store(spark, sf).agg(F.sum("n").alias("n"))
