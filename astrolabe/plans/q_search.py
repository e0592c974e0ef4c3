"""Registered queries: vector search and recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe import tables
from astrolabe.plans.recommend import recommend
from astrolabe.constants import DIST_THRES, DISTANT_CONST, OBSERVED_SQL
from astrolabe.plans.registry import register

def anchors_of(vecs):
    return tables.inventory(vecs)


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
_A = f"a AS (SELECT vec_id AS anchor_id, vec AS avec, label AS alabel FROM v WHERE {OBSERVED_SQL})"


@register("recommend", f"""
WITH {_V}, {_A},
c AS (SELECT * FROM v WHERE label IN (SELECT alabel FROM a)),
d AS (SELECT a.anchor_id, a.alabel, c.vec_id AS entry, list_distance(a.avec, c.vec) AS distance
      FROM a, c),
keep AS (SELECT entry FROM d GROUP BY entry HAVING min(distance) > {DIST_THRES}),
dk AS (SELECT d.* FROM d JOIN keep USING (entry)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY distance, entry) AS rn
                       FROM dk) WHERE rn <= 10),
cnt AS (SELECT entry, count(*) AS counts FROM top GROUP BY entry),
pa AS (SELECT entry, alabel,
              row_number() OVER (PARTITION BY entry ORDER BY distance, anchor_id) AS rn
       FROM d WHERE entry IN (SELECT entry FROM cnt)),
pred AS (SELECT entry, avg(alabel) AS prediction FROM pa WHERE rn <= 4 GROUP BY entry)
SELECT cnt.entry, cnt.counts, round(pred.prediction, 6) AS prediction
FROM cnt JOIN pred USING (entry) ORDER BY prediction DESC, entry
""")
def q_recommend(spark, sf_dir):
    vecs = tables.vectors(spark, sf_dir)
    return recommend(vecs, anchors_of(vecs), top=10, dist_thres=DIST_THRES, cluster=True,
                     n_neighbors=4)


from astrolabe.operators import pairs, search, stats  # noqa: E402


def _anchor_frame(vecs):
    return anchors_of(vecs).withColumnRenamed("vec_id", "anchor_id")


_D = """d AS (SELECT a.anchor_id, v.vec_id AS entry, {dist} AS distance FROM a, v)"""
_EUC = "list_distance(a.avec, v.vec)"
_COS = "1 - list_cosine_similarity(a.avec, v.vec)"


@register("knn_join_euclid", f"""
WITH {_V}, {_A}, {_D.format(dist=_EUC)}
SELECT anchor_id, entry, round(distance, 6) AS distance, rank FROM
 (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY distance, entry) AS rank FROM d) WHERE rank <= 5
""")
def q_knn_join_euclid(spark, sf):
    v = tables.vectors(spark, sf)
    t = search.knn_topk(v, _anchor_frame(v), 5)
    return t.select("anchor_id", "entry", round6("distance").alias("distance"), F.col("rank").cast("long"))


@register("knn_join_cosine", f"""
WITH {_V}, {_A}, {_D.format(dist=_COS)}
SELECT anchor_id, entry, round(distance, 6) AS distance, rank FROM
 (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY distance, entry) AS rank FROM d) WHERE rank <= 5
""")
def q_knn_join_cosine(spark, sf):
    v = tables.vectors(spark, sf)
    t = search.knn_topk(v, _anchor_frame(v), 5, metric="cosine")
    return t.select("anchor_id", "entry", round6("distance").alias("distance"), F.col("rank").cast("long"))


@register("cluster_semi_join", f"""
WITH {_V}, {_A} SELECT vec_id, label FROM v WHERE label IN (SELECT alabel FROM a)
""")
def q_cluster_semi_join(spark, sf):
    v = tables.vectors(spark, sf)
    return search.cluster_semi_join(v, anchors_of(v), "label").select("vec_id", "label")


@register("distance_anti_join", f"""
WITH {_V}, {_A}, {_D.format(dist=_EUC)}
SELECT entry AS vec_id FROM d GROUP BY entry HAVING min(distance) > 1.2
""")
def q_distance_anti_join(spark, sf):
    v = tables.vectors(spark, sf)
    return search.distance_anti_join(v, _anchor_frame(v), 1.2).select("vec_id")


@register("rec_counts", f"""
WITH {_V}, {_A}, {_D.format(dist=_EUC)},
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY distance, entry) AS rn FROM d)
      WHERE rn <= 10)
SELECT entry, count(*) AS counts FROM t GROUP BY entry
""")
def q_rec_counts(spark, sf):
    v = tables.vectors(spark, sf)
    return search.rec_counts(search.knn_topk(v, _anchor_frame(v), 10))


@register("distance_profile", f"""
WITH {_V}, {_A}, {_D.format(dist=_COS)}
SELECT round(min(distance), 6) AS d_min, round(max(distance), 6) AS d_max, round(avg(distance), 6) AS d_mean,
       round(stddev_pop(distance), 6) AS d_std, round(quantile_cont(distance, 0.03), 6) AS p3,
       round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.97), 6) AS p97
FROM d
""")
def q_distance_profile(spark, sf):
    v = tables.vectors(spark, sf)
    return search.distance_profile(v, _anchor_frame(v), [0.03, 0.5, 0.97], ["p3", "p50", "p97"], metric="cosine")


@register("distant_flag", f"""
WITH {_V}, {_A}, {_D.format(dist=_COS)},
p AS (SELECT quantile_cont(distance, 0.97) AS upper FROM d),
m AS (SELECT entry, avg(distance) AS mean_d FROM d GROUP BY entry)
SELECT entry, round(mean_d, 6) AS mean_d, mean_d > upper AS above_pct, mean_d > {DISTANT_CONST} AS above_const FROM m, p
""")
def q_distant_flag(spark, sf):
    v = tables.vectors(spark, sf)
    return search.distant_flag(v, _anchor_frame(v), 0.97, DISTANT_CONST, metric="cosine")


@register("covariance_rows", f"""
WITH {_V},
c AS (SELECT x.vec_id AS i, y.vec_id AS j, CASE WHEN x.vec_id = y.vec_id THEN 0.0 ELSE list_dot_product(x.vec, y.vec) END AS cov FROM v x, v y)
SELECT i, round(avg(cov), 6) AS mean_cov, arg_max(j, (cov, -j)) AS top_j FROM c GROUP BY i
""")
def q_covariance_rows(spark, sf):
    """Mean of every row of the whole table's covariance matrix, its diagonal zeroed, and the largest entry's column."""
    rows = pairs.row_summaries(tables.vectors(spark, sf), diagonal=0.0)
    return rows.select("i", round6(F.col("total") / F.col("n")).alias("mean_cov"), "top_j")


@register("covariance_order", f"""
WITH {_V},
c AS (SELECT x.vec_id AS i, y.vec_id AS j, CASE WHEN x.vec_id = y.vec_id THEN 0.0 ELSE list_dot_product(x.vec, y.vec) END AS cov FROM v x, v y)
SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY cov DESC, j) AS place FROM c QUALIFY place <= 20
""")
def q_covariance_order(spark, sf):
    """The head of every row's ordering of all others by covariance."""
    return pairs.top_partners(tables.vectors(spark, sf), 20, diagonal=0.0).select("i", "j", F.col("place").cast("long").alias("place"))


@register("covariance_blocks", f"""
WITH {_V}
SELECT x.label AS label_i, y.label AS label_j, round(avg(list_dot_product(x.vec, y.vec)), 6) AS mean_cov, count(*) AS n
FROM v x, v y WHERE x.vec_id <> y.vec_id GROUP BY x.label, y.label
""")
def q_covariance_blocks(spark, sf):
    """Mean covariance of each block of two groups of the whole table, without the diagonal."""
    return pairs.group_products(tables.vectors(spark, sf), "label").withColumn("mean_cov", round6("mean_cov"))


@register("pairwise_similarity", f"""
WITH {_V},
c AS (SELECT x.vec_id AS i, y.vec_id AS j, list_cosine_similarity(x.vec, y.vec) AS sim FROM v x, v y WHERE x.vec_id <> y.vec_id)
SELECT i, count(*) AS n, round(avg(sim), 6) AS mean_sim, round(min(sim), 6) AS low_sim, round(max(sim), 6) AS top_sim,
       arg_max(j, (sim, -j)) AS top_j FROM c GROUP BY i
""")
def q_pairwise_similarity(spark, sf):
    """the whole table's cosine matrix, each row by mean, least and largest entry and the largest one's column."""
    rows = pairs.row_summaries(tables.vectors(spark, sf), metric="cosine")
    return rows.select("i", "n", round6(F.col("total") / F.col("n")).alias("mean_sim"), round6("low").alias("low_sim"),
                       round6("top_value").alias("top_sim"), "top_j")


@register("greedy_assignment", f"""
WITH RECURSIVE {_V}, {_A},
d AS (SELECT a.anchor_id, v.vec_id AS entry, list_distance(a.avec, v.vec) AS distance
      FROM a, v WHERE v.vec_id NOT IN (SELECT anchor_id FROM a)),
o AS (SELECT anchor_id, row_number() OVER (ORDER BY anchor_id) AS step FROM a),
g AS (SELECT 0::BIGINT AS step, NULL::BIGINT AS anchor_id, NULL::BIGINT AS entry, NULL::DOUBLE AS distance, []::BIGINT[] AS taken
      UNION ALL
      SELECT o.step, o.anchor_id, p.entry, p.distance, list_append(g.taken, p.entry)
      FROM g JOIN o ON o.step = g.step + 1,
           LATERAL (SELECT arg_min(d.entry, (d.distance, d.entry)) AS entry, min(d.distance) AS distance FROM d
                    WHERE d.anchor_id = o.anchor_id AND NOT list_contains(g.taken, d.entry)) p)
SELECT anchor_id, entry, round(distance, 6) AS distance, step FROM g WHERE step > 0
""")
def q_greedy_assignment(spark, sf):
    # queries: the inventory; candidates: every other vector of the store
    v = tables.vectors(spark, sf)
    anchors = _anchor_frame(v)
    cands = v.join(anchors.select(F.col("anchor_id").alias("vec_id")), "vec_id", "left_anti")
    return search.greedy_assignment(cands, anchors).withColumn("distance", round6("distance"))


@register("knn_regress", f"""
WITH {_V}, {_A}, {_D.format(dist=_EUC)},
t AS (SELECT d.entry, a.alabel, row_number() OVER (PARTITION BY d.entry ORDER BY d.distance, d.anchor_id) AS rn
      FROM d JOIN a USING (anchor_id))
SELECT entry AS vec_id, round(avg(alabel), 6) AS prediction FROM t WHERE rn <= 3 GROUP BY entry
""")
def q_knn_regress(spark, sf):
    v = tables.vectors(spark, sf)
    p = search.knn_regress(v, anchors_of(v), 3, query_id="vec_id", train_id="vec_id", target="label")
    return p.select("vec_id", round6("prediction").alias("prediction"))
