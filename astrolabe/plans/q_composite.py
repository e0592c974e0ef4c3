"""Registered composite queries with SQL oracles: R2 (up to scoring), R4, R6-R12."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe import tables
from astrolabe.functions import scalar as S
from astrolabe.functions import vectors as V
from astrolabe.operators import curate as C
from astrolabe.operators import pooling, search, stats
from astrolabe.operators import text as X
from astrolabe.operators.resample import uniform_sql
from astrolabe.constants import OBSERVED_SQL
from astrolabe.plans.registry import register
from astrolabe.session import scratch_path
from astrolabe.sources import io


def T(spark, sf, name):
    return tables.load(spark, sf, name)


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
_A = f"a AS (SELECT vec_id AS anchor_id, vec AS avec FROM v WHERE {OBSERVED_SQL})"
_TOPK = """t AS (SELECT * FROM (SELECT a.anchor_id, v.vec_id AS entry, list_distance(a.avec, v.vec) AS distance,
                       row_number() OVER (PARTITION BY a.anchor_id ORDER BY list_distance(a.avec, v.vec), v.vec_id) AS rank
                FROM a, v) WHERE rank <= {k})"""

# Content filters applied to a recommendation's whole text: substrings it may not
# contain (P6), a forbidden character (P8) and a single-letter test.
BATCH_NEEDLES = ["ß", "ñ", "@"]
FORBIDDEN_CHAR = "$"


def _content_ok(text):
    return (~C.contains_any(text, BATCH_NEEDLES) & ~F.contains(text, F.lit(FORBIDDEN_CHAR))
            & ~C.only_letter(text, "e"))


_CONTENT_SQL = """NOT (contains(text, 'ß') OR contains(text, 'ñ') OR contains(text, '@'))
  AND NOT contains(text, '$')
  AND NOT (len(list_distinct(list_filter(string_split(text, ''), lambda x: regexp_matches(x, '^[A-Za-z]$')))) = 1
           AND list_distinct(list_filter(string_split(text, ''), lambda x: regexp_matches(x, '^[A-Za-z]$')))[1] = 'e')"""


def recommend_batch_rows(spark, sf):
    """R2 up to scoring: top-100 per inventory item → drop self → first occurrence per
    entry (anchor order, then rank) → content filters on the entry's whole text."""
    v = tables.vectors(spark, sf)
    anchors = tables.inventory(v).withColumnRenamed("vec_id", "anchor_id")
    top = search.knn_topk(v, anchors, 100).where(F.col("entry") != F.col("anchor_id"))
    first = C.dedupe_first(top, "entry", ["anchor_id", "rank"])
    docs = T(spark, sf, "documents").select(F.col("doc_id").alias("entry"), "text", "n_chars")
    j = first.join(docs, "entry").where(_content_ok(F.col("text")))
    return j.select("entry", F.col("anchor_id").alias("anchor"), round6("distance").alias("distance"),
                    "n_chars")


@register("recommend_batch", f"""
WITH {_V}, {_A}, {_TOPK.format(k=100)},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY anchor_id, rank) AS rn
                     FROM t WHERE entry <> anchor_id) WHERE rn = 1)
SELECT f.entry, f.anchor_id AS anchor, round(f.distance, 6) AS distance, d.n_chars
FROM f JOIN documents d ON d.doc_id = f.entry
WHERE {_CONTENT_SQL.replace('text', 'd.text')}
""")
def q_recommend_batch(spark, sf):
    return recommend_batch_rows(spark, sf)


@register("target_list", f"""
WITH {_V}, {_A}, {_TOPK.format(k=50)},
u AS (SELECT DISTINCT entry FROM t)
SELECT u.entry, d.n_chars FROM u JOIN documents d ON d.doc_id = u.entry
WHERE d.n_chars > 200 AND len(regexp_extract_all(d.text, '[0-9]')) * 100 < length(d.text)
  AND NOT (contains(d.text, 'ß') OR contains(d.text, 'ñ') OR contains(d.text, '@'))
  AND u.entry NOT IN (SELECT anchor_id FROM a) AND length(d.text) > 3
""")
def q_target_list(spark, sf):
    """Union of every anchor's top 50 → distinct → numeric descriptors (more than
    200 characters, under 1 % digits) → substring exclusion → not in the inventory →
    length > 3."""
    v = tables.vectors(spark, sf)
    anchors = tables.inventory(v).withColumnRenamed("vec_id", "anchor_id")
    u = search.knn_topk(v, anchors, 50).select("entry").distinct()
    docs = T(spark, sf, "documents").select(F.col("doc_id").alias("entry"), "n_chars", "text")
    j = u.join(docs, "entry").where(
        (F.col("n_chars") > 200) & (F.regexp_count("text", F.lit("[0-9]")) * 100 < F.length("text")))
    j = C.exclude_substrings(j, "text", BATCH_NEEDLES)
    j = j.join(anchors.select(F.col("anchor_id").alias("entry")), "entry", "left_anti")
    return j.where(F.length("text") > 3).select("entry", "n_chars")


# Element symbols excluded from the pool (same list as the P5 query).
from astrolabe.plans.q_relational import EXCLUDED_ELEMENTS, _EXCL_SQL  # noqa: E402


#: Letters whose counts are a key's composition.
POOL_SYMBOLS = "chnos"


@register("curate_pool", f"""
WITH p AS (SELECT text AS raw, 0 AS source, doc_id AS o1, 0 AS o2 FROM documents
           UNION ALL SELECT text, 1, item_id, 0 FROM benchmark
           UNION ALL SELECT text, 2, conv_id, turn FROM conversations),
k AS (SELECT nullif(lower(trim(regexp_replace(raw, '[ \t\r\n]+', ' ', 'g'))), '') AS key, raw, source, o1, o2 FROM p),
d AS (SELECT key, arg_min(source, (source, o1, o2)) AS source, arg_min(raw, (source, o1, o2)) AS raw
      FROM k WHERE key IS NOT NULL GROUP BY key)
SELECT md5(key) AS key_md5, source, round({" + ".join(f"{S.ATOMIC_MASS[x.upper()]}::DOUBLE * (length(key) - length(replace(key, '{x}', '')))" for x in POOL_SYMBOLS)}, 6) AS weight FROM d
WHERE NOT regexp_matches(raw, '{_EXCL_SQL}')
""")
def q_curate_pool(spark, sf):
    """Pool sources (U1) → normalised key (F24) → drop empty (P3) → keep the first
    occurrence of each key in source order (A4, partial-aggregate form, so a hot key is
    reduced map-side) → word exclusion (P5) → mass of the key's composition (F15) → table and list of lines (S12, S14).

    A key's composition counts the letters of ``POOL_SYMBOLS``.  The result is what the table holds afterwards."""
    docs = T(spark, sf, "documents").select(F.col("text").alias("raw"), F.lit(0).alias("source"),
                                            F.col("doc_id").alias("o1"), F.lit(0).cast("long").alias("o2"))
    bench = T(spark, sf, "benchmark").select(F.col("text").alias("raw"), F.lit(1).alias("source"),
                                             F.col("item_id").alias("o1"), F.lit(0).cast("long").alias("o2"))
    conv = T(spark, sf, "conversations").select(F.col("text").alias("raw"), F.lit(2).alias("source"),
                                                F.col("conv_id").alias("o1"), F.col("turn").alias("o2"))
    pool = C.compute_once(docs.unionByName(bench).unionByName(conv), key=S.normalise_key("raw"))
    pool = C.drop_empty(pool, "key")
    # Shuffle a 128-bit digest of the key (plus its length) instead of whole texts;
    # the case-sensitive element test runs on the original text before the shuffle
    # and only its boolean travels with the row.
    formula = F.concat(*[F.concat(F.lit(x.upper()), F.length("key") - F.length(F.replace("key", F.lit(x), F.lit("")))) for x in POOL_SYMBOLS])
    slim = pool.select(F.md5("key").alias("key_md5"), F.length("key").alias("size"), formula.alias("formula"), "source", "o1", "o2",
                       C.contains_word("raw", EXCLUDED_ELEMENTS).alias("excluded"))
    first = slim.groupBy("key_md5", "size").agg(
        F.min_by(F.struct("source", "excluded", "formula"), F.struct("source", "o1", "o2")).alias("f"))
    weight = round6(X.formula_mass("f.formula", S.ATOMIC_MASS)).alias("weight")
    table, lines = scratch_path(spark, "pool"), scratch_path(spark, "pool-lines")
    first.where(~F.col("f.excluded")).select("key_md5", F.col("f.source").alias("source"), weight).write.parquet(table)
    kept = spark.read.parquet(table)
    io.write_lines(kept, "key_md5", lines)
    return kept


HASH_DIM = 4


@register("prepare_inventory", f"""
WITH p AS (SELECT p_partkey, nullif(lower(trim(regexp_replace(p_name, '[ \t\r\n]+', ' ', 'g'))), '') AS key
           FROM part WHERE p_type IS DISTINCT FROM 'PROMO'),
t AS (SELECT p_partkey, key, unnest(list_filter(regexp_split_to_array(lower(key), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS token FROM p)
SELECT p_partkey, key, {", ".join(f"round(sum({uniform_sql(7, f'dim{c}', 'token')} - 0.5), 6) AS v{c}" for c in range(HASH_DIM))}
FROM t GROUP BY p_partkey, key
""")
def q_prepare_inventory(spark, sf):
    """Scan → exclude one class (P2) → normalised key (F24) → summed token vectors (M3) → table; the result is what it holds."""
    p = C.filter_eq(T(spark, sf, "part"), "p_type", "PROMO", keep=False)
    p = p.select("p_partkey", S.normalise_key("p_name").alias("key"))
    pooled = pooling.pool_hashed(p.select("p_partkey", X.token_sentence("key", radius=0).alias("tokens")), "p_partkey", "tokens", HASH_DIM)
    table = scratch_path(spark, "inventory")
    p.join(pooled, "p_partkey").select(
        "p_partkey", "key", *[round6(F.get("vec", c)).alias(f"v{c}") for c in range(HASH_DIM)]).write.parquet(table)
    return spark.read.parquet(table)


@register("model_comparison", """
WITH o AS (SELECT p_name, arg_min(p_retailprice, p_partkey) AS obs, arg_min(p_size, p_partkey) AS size FROM part GROUP BY p_name),
e AS (SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
      WHERE rn = 6),
f AS (SELECT regr_intercept(p_retailprice, p_size) AS b0, regr_slope(p_retailprice, p_size) AS b1 FROM part)
SELECT o.p_name, round(o.obs, 6) AS obs,
       round(pow(10, abs(log10(e.value * 10 / o.obs))), 6) AS factor_a,
       round(pow(10, abs(log10((f.b0 + f.b1 * o.size) / o.obs))), 6) AS factor_b
FROM o JOIN e ON e.user_id = o.size, f
""")
def q_model_comparison(spark, sf):
    """Observations deduped by name (first by key) vs two models — the n-th time slice
    of a series (T4) and a linear fit — each as a symmetric error factor (F13)."""
    p = T(spark, sf, "part")
    o = C.dedupe_first_agg(p.select("p_name", "p_partkey", F.col("p_retailprice").alias("obs"),
                                    F.col("p_size").alias("size")), "p_name", "p_partkey")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = (T(spark, sf, "events").withColumn("rn", F.row_number().over(w)).where("rn = 6")
         .select("user_id", "value"))
    fit = p.agg(F.regr_intercept("p_retailprice", "p_size").alias("b0"), F.regr_slope("p_retailprice", "p_size").alias("b1"))
    j = stats.with_scalars(o.join(e, o.size == e.user_id), fit)
    out = j.select("p_name", round6("obs").alias("obs"),
                   round6(S.error_factor(F.col("value") * 10, F.col("obs"))).alias("factor_a"),
                   round6(S.error_factor(F.col("b0") + F.col("b1") * F.col("size"), F.col("obs"))).alias("factor_b"))
    return out.orderBy(F.desc("factor_a"), "p_name")


@register("ratio_curve", """
WITH m AS (SELECT user_id, avg(value) AS mean_v FROM events GROUP BY user_id)
SELECT e.event_id, e.user_id, round(e.value / m.mean_v, 6) AS ratio
FROM events e JOIN m USING (user_id) WHERE e.ts >= TIMESTAMP '2024-01-15 00:00:00'
""")
def q_ratio_curve(spark, sf):
    """Series points after a start time (P9), joined to the series mean, as ratios."""
    e = T(spark, sf, "events")
    m = e.groupBy("user_id").agg(F.avg("value").alias("mean_v"))
    after = e.where(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return after.join(m, "user_id").select("event_id", "user_id",
                                           round6(F.try_divide(F.col("value"), F.col("mean_v"))).alias("ratio"))


@register("series_validation", """
WITH f AS (SELECT regr_intercept(p_retailprice, p_size) AS b0, regr_slope(p_retailprice, p_size) AS b1 FROM part),
p AS (SELECT p_partkey, b0 + b1 * p_size AS pred FROM part, f)
SELECT o.p_type, round(avg((o.p_retailprice - p.pred) ^ 2), 6) AS mse, count(*) AS n
FROM part o JOIN p USING (p_partkey) GROUP BY o.p_type
""")
def q_series_validation(spark, sf):
    """Predictions joined to observations on the key (J1), residual MSE per class."""
    part = T(spark, sf, "part")
    fit = part.agg(F.regr_intercept("p_retailprice", "p_size").alias("b0"),
                   F.regr_slope("p_retailprice", "p_size").alias("b1"))
    pred = stats.with_scalars(part.select("p_partkey", "p_size"), fit).select(
        "p_partkey", (F.col("b0") + F.col("b1") * F.col("p_size")).alias("pred"))
    j = part.select("p_partkey", "p_type", "p_retailprice").join(pred, "p_partkey")
    r2 = (F.col("p_retailprice") - F.col("pred")) ** 2
    return j.groupBy("p_type").agg(round6(F.avg(r2)).alias("mse"), F.count(F.lit(1)).alias("n"))


@register("similarity_ranking", f"""
WITH {_V}, l AS (SELECT vec_id, vec FROM v), f AS (SELECT arg_min(vec, vec_id) AS v0 FROM v)
SELECT vec_id, round(list_cosine_similarity(vec, v0), 6) AS cos,
       round(list_distance(vec, v0) * list_distance(vec, v0), 6) AS sqdist,
       row_number() OVER (ORDER BY list_cosine_similarity(vec, v0) DESC, vec_id) AS rank
FROM l, f
""")
def q_similarity_ranking(spark, sf):
    """The whole table ranked by cosine similarity to its first member."""
    lst = tables.vectors(spark, sf)
    first = lst.groupBy().agg(F.min_by("vec", "vec_id").alias("v0"))
    j = stats.with_scalars(lst, first).withColumn("c", V.cosine_similarity("vec", "v0"))
    r = stats.global_position(j.select("vec_id", "c", "vec", "v0"), [F.desc("c"), "vec_id"], "rank")
    return r.select("vec_id", round6("c").alias("cos"), round6(V.sq_euclidean("vec", "v0")).alias("sqdist"),
                    "rank")


@register("rec_report", f"""
WITH {_V}, {_A}, {_TOPK.format(k=10)},
r AS (SELECT DISTINCT entry FROM t),
d AS (SELECT r.entry, doc.lang, doc.n_chars, contains(doc.text, 'License') AS lic,
             regexp_matches(doc.text, '[0-9]') AS dig FROM r JOIN documents doc ON doc.doc_id = r.entry)
SELECT lang, count(*) AS n, CAST(count_if(lic) AS BIGINT) AS n_license, CAST(count_if(dig) AS BIGINT) AS n_digit,
       CAST(count_if(NOT lic AND NOT dig) AS BIGINT) AS n_plain, round(avg(n_chars), 6) AS mean_chars
FROM d GROUP BY lang
""")
def q_rec_report(spark, sf):
    """Descriptive report over the recommended items: flags (P17), group counts (A2), means (A10)."""
    v = tables.vectors(spark, sf)
    anchors = tables.inventory(v).withColumnRenamed("vec_id", "anchor_id")
    r = search.knn_topk(v, anchors, 10).select("entry").distinct()
    d = T(spark, sf, "documents").select(F.col("doc_id").alias("entry"), "lang", "n_chars",
                                         F.col("text").contains("License").alias("lic"),
                                         F.col("text").rlike("[0-9]").alias("dig"))
    j = r.join(d, "entry")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("lic").alias("n_license"),
                                 F.count_if("dig").alias("n_digit"),
                                 F.count_if(~F.col("lic") & ~F.col("dig")).alias("n_plain"),
                                 round6(F.avg("n_chars")).alias("mean_chars"))


@register("rec_report_anchors", f"""
WITH {_V}, {_A}, {_TOPK.format(k=10)}
SELECT anchor_id AS anchor, count(*) AS n, round(avg(distance), 6) AS mean_distance FROM t GROUP BY anchor_id
""")
def q_rec_report_anchors(spark, sf):
    """How many items each anchor brought in, and how near they are."""
    v = tables.vectors(spark, sf)
    anchors = tables.inventory(v).withColumnRenamed("vec_id", "anchor_id")
    return (search.knn_topk(v, anchors, 10).groupBy(F.col("anchor_id").alias("anchor"))
            .agg(F.count(F.lit(1)).alias("n"), round6(F.avg("distance")).alias("mean_distance")))


@register("curation_funnel", f"""
WITH k AS (SELECT doc_id, text, nullif(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))), '') AS key FROM documents),
f AS (SELECT *, key IS NOT NULL AS nonempty,
             key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1 AS first FROM k),
c AS (SELECT count(*) AS n0, count_if(nonempty) AS n1, count_if(first) AS n2,
             count_if(first AND NOT regexp_matches(text, '{_EXCL_SQL}')) AS n3 FROM f)
SELECT 0 AS step_no, 'pooled' AS step, CAST(n0 AS BIGINT) AS n_rows FROM c
UNION ALL SELECT 1, 'non-empty key', CAST(n1 AS BIGINT) FROM c
UNION ALL SELECT 2, 'first per key', CAST(n2 AS BIGINT) FROM c
UNION ALL SELECT 3, 'element exclusion', CAST(n3 AS BIGINT) FROM c
""")
def q_curation_funnel(spark, sf):
    """Rows left after each curation step.  Row-level steps are conditional
    counts; "first per key" is a group-by on the key digest with ``min_by`` of the
    exclusion flag (partial aggregation, so a hot key is reduced map-side)."""
    d = C.compute_once(T(spark, sf, "documents").select("doc_id", "text"), key=S.normalise_key("text"))
    base = d.select("doc_id", F.md5("key").alias("h"), F.length("key").alias("l"),
                    C.contains_word("text", EXCLUDED_ELEMENTS).alias("excluded"))
    rows = base.agg(F.count(F.lit(1)).alias("n0"), F.count(F.col("h")).alias("n1"))
    keys = (base.where(F.col("h").isNotNull()).groupBy("h", "l")
            .agg(F.min_by("excluded", "doc_id").alias("ex"))
            .agg(F.count(F.lit(1)).alias("n2"), F.count_if(~F.col("ex")).alias("n3")))
    c = stats.with_scalars(rows, keys)
    steps = ["pooled", "non-empty key", "first per key", "element exclusion"]
    return c.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"),
                                                 F.col(f"n{i}").alias("n_rows"))
                                        for i, s in enumerate(steps)])).alias("r")).select("r.*")
