"""Registered queries: projections, predicates, joins, aggregates, windows,
sorts and set operators (P1-P19, J1-J8, A1-A21, W2-W4, T1-T4, U1-U5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe import tables
from astrolabe.functions import scalar as S
from astrolabe.functions import vectors as V
from astrolabe.operators import curate as C
from astrolabe.operators import stats
from astrolabe.operators.resample import uniform, uniform_sql
from astrolabe.constants import CUMULATIVE_TARGET, ROW_SCALE, OBSERVED_SQL
from astrolabe.plans.registry import register


def T(spark, sf, name):
    return tables.load(spark, sf, name)


# Element symbols excluded from the string pool (whole-token match).
EXCLUDED_ELEMENTS = [
    "P", "Ho", "As", "Zr", "Sn", "V", "Au", "Br", "F", "Re", "U", "Al", "In", "Cl", "Ag",
    "Ce", "Hg", "Ta", "Te", "Ni", "Be", "Li", "Sb", "Bi", "Mn", "Co", "Tm", "Si", "Mo", "Se",
]
_EXCL_SQL = "(^|[^A-Za-z0-9_])(?:" + "|".join(EXCLUDED_ELEMENTS) + ")($|[^A-Za-z0-9_])"

# Substring list applied to part names (P6); short needles over-match on purpose.
NAME_NEEDLES = ["ring", "bolt", "ol"]


# ---- P1-P19 ------------------------------------------------------------------

@register("project", """
SELECT p_partkey, upper(p_name) AS name_uc, round(p_retailprice / 1000.0, 6) AS price_k FROM part
""")
def q_project(spark, sf):
    return (T(spark, sf, "part")
            .withColumn("name_uc", F.upper("p_name"))
            .withColumn("price_k", round6(F.col("p_retailprice") / 1000.0))
            .drop("p_name", "p_brand", "p_type", "p_size", "p_retailprice"))


@register("filter_eq", """
SELECT p_partkey, p_type FROM part WHERE p_type IS DISTINCT FROM 'PROMO'
""")
def q_filter_eq(spark, sf):
    # default behaviour of the loader: exclude one key (here the PROMO class)
    return C.filter_eq(T(spark, sf, "part"), "p_type", "PROMO", keep=False).select("p_partkey", "p_type")


@register("drop_empty", r"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents
WHERE text IS NOT NULL AND length(regexp_replace(text, '[ \t\r\n]', '', 'g')) > 0
""")
def q_drop_empty(spark, sf):
    d = T(spark, sf, "documents").withColumn("__t", F.regexp_replace("text", r"[ \t\r\n]", ""))
    return C.drop_empty(d, "__t").select("doc_id", F.length("text").alias("n_chars"))


@register("filter_in", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('SMALL', 'LARGE')")
def q_filter_in(spark, sf):
    return T(spark, sf, "part").where(F.col("p_type").isin("SMALL", "LARGE")).select("p_partkey", "p_type")


@register("filter_not_in", "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('SMALL', 'LARGE')")
def q_filter_not_in(spark, sf):
    return T(spark, sf, "part").where(~F.col("p_type").isin("SMALL", "LARGE")).select("p_partkey", "p_type")


@register("exclude_words", f"""
SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '{_EXCL_SQL}')
""")
def q_exclude_words(spark, sf):
    return C.exclude_words(T(spark, sf, "documents"), "text", EXCLUDED_ELEMENTS).select("doc_id")


@register("exclude_substrings", """
SELECT p_partkey, p_name FROM part
WHERE NOT (contains(p_name, 'ring') OR contains(p_name, 'bolt') OR contains(p_name, 'ol'))
""")
def q_exclude_substrings(spark, sf):
    return C.exclude_substrings(T(spark, sf, "part"), "p_name", NAME_NEEDLES).select("p_partkey", "p_name")


@register("letter_set_filter", """
WITH l AS (SELECT doc_id, list_distinct(list_filter(string_split(text, ''), lambda x: regexp_matches(x, '^[A-Za-z]$'))) AS s
           FROM documents)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_letters, (len(s) = 1 AND s[1] = 'H') AS only_h,
       (len(s) = 1 AND s[1] = 'C') AS only_c
FROM l
""")
def q_letter_set_filter(spark, sf):
    """P7 over whole texts: size of the distinct-letter set and the "only H" / "only C" tests."""
    d = T(spark, sf, "documents")
    return d.select("doc_id", F.size(C.letter_set("text")).alias("n_letters"),
                    C.only_letter("text", "H").alias("only_h"), C.only_letter("text", "C").alias("only_c"))


@register("exclude_char", "SELECT doc_id FROM documents WHERE NOT contains(text, '.')")
def q_exclude_char(spark, sf):
    return C.exclude_char(T(spark, sf, "documents"), "text", ".").select("doc_id")


@register("range_filter", """
SELECT p_partkey FROM part
WHERE p_retailprice BETWEEN 920 AND 950 AND p_size > 10 AND abs(p_size - 25) <= 10
""")
def q_range_filter(spark, sf):
    return (T(spark, sf, "part")
            .where(F.col("p_retailprice").between(920, 950) & (F.col("p_size") > 10)
                   & (F.abs(F.col("p_size") - 25) <= 10))
            .select("p_partkey"))


@register("box_filter", """
SELECT vec_id FROM embeddings
WHERE list_bool_and(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x > -0.3 AND x < 0.3))
""")
def q_box_filter(spark, sf):
    v = tables.vectors(spark, sf)
    return v.where(C.in_open_box("vec", -0.3, 0.3)).select("vec_id")


@register("length_filter", "SELECT p_partkey, p_name FROM part WHERE length(p_name) > 9")
def q_length_filter(spark, sf):
    return T(spark, sf, "part").where(F.length("p_name") > 9).select("p_partkey", "p_name")


@register("ordered_category", """
SELECT p_partkey,
       CASE WHEN contains(p_name, 's') THEN 3 WHEN contains(p_name, 'r') THEN 2
            WHEN contains(p_name, 'o') THEN 1 ELSE 0 END AS category
FROM part
""")
def q_ordered_category(spark, sf):
    n = F.col("p_name")
    cat = C.ordered_category([(n.contains("o"), 1), (n.contains("r"), 2), (n.contains("s"), 3)])
    return T(spark, sf, "part").select("p_partkey", cat.alias("category"))


@register("dict_map", """
SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN '#336699' WHEN 'PROMO' THEN '#993333'
                               WHEN 'SMALL' THEN '#339966' WHEN 'LARGE' THEN '#996633' END AS colour
FROM part
""")
def q_dict_map(spark, sf):
    colours = {"STANDARD": "#336699", "PROMO": "#993333", "SMALL": "#339966", "LARGE": "#996633"}
    return T(spark, sf, "part").select("p_partkey", C.dict_map("p_type", colours).alias("colour"))


_LKEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@register("clean_nonfinite", f"""
SELECT {_LKEY}, round(CASE WHEN l_tax > 0 THEN log10(l_tax) ELSE 0.0 END, 6) AS log_tax FROM lineitem
""")
def q_clean_nonfinite(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.select(*tables.ROW_KEYS["lineitem"],
                     round6(C.clean_nonfinite(S.log10_pos("l_tax"))).alias("log_tax"))


@register("clamp", "SELECT event_id, least(greatest(value, 1.0), 100.0) AS clamped FROM events")
def q_clamp(spark, sf):
    return T(spark, sf, "events").select("event_id", C.clamp("value", 1.0, 100.0).alias("clamped"))


@register("percentile_floor", f"""
WITH p AS (SELECT quantile_cont(l_extendedprice, 0.05) AS q FROM lineitem)
SELECT {_LKEY}, CASE WHEN l_extendedprice < q THEN 0.0 ELSE l_extendedprice END AS price
FROM lineitem, p
""")
def q_percentile_floor(spark, sf):
    li = T(spark, sf, "lineitem").select(*tables.ROW_KEYS["lineitem"],
                                         F.col("l_extendedprice").alias("price"))
    return C.percentile_floor(li, "price", 0.05)


@register("fail_soft", r"""
SELECT event_id, TRY_CAST(regexp_extract(props, '"k":\s*([^,}]*)', 1) AS INTEGER) AS k
FROM events WHERE TRY_CAST(regexp_extract(props, '"k":\s*([^,}]*)', 1) AS INTEGER) IS NOT NULL
""")
def q_fail_soft(spark, sf):
    k = F.regexp_extract("props", r'"k":\s*([^,}]*)', 1).try_cast("int")
    return T(spark, sf, "events").select("event_id", k.alias("k")).where(F.col("k").isNotNull())


@register("pattern_flags", r"""
WITH f AS (SELECT contains(text, 'License') AS lic,
                  regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+') AS email,
                  regexp_matches(text, '[0-9]{3}-[0-9]{3}-[0-9]{4}') AS phone FROM documents)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(lic) AS BIGINT) AS n_license,
       CAST(count_if(email) AS BIGINT) AS n_email, CAST(count_if(phone) AS BIGINT) AS n_phone,
       CAST(count_if(NOT lic AND NOT email AND NOT phone) AS BIGINT) AS n_none
FROM f
""")
def q_pattern_flags(spark, sf):
    d = T(spark, sf, "documents").select(
        F.col("text").contains("License").alias("lic"),
        F.col("text").rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+").alias("email"),
        F.col("text").rlike(r"[0-9]{3}-[0-9]{3}-[0-9]{4}").alias("phone"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if("lic").alias("n_license"),
                 F.count_if("email").alias("n_email"), F.count_if("phone").alias("n_phone"),
                 F.count_if(~F.col("lic") & ~F.col("email") & ~F.col("phone")).alias("n_none"))


@register("row_template", rf"""
SELECT p_partkey,
       p_name || ' & ' || CASE WHEN p_size > 45 THEN '$\infty$' WHEN p_size > 25
                 THEN CAST(CAST(round(CAST(p_retailprice AS DECIMAL(12,2)) * CAST({ROW_SCALE} AS DECIMAL(6,4)), 4)
                                AS DECIMAL(18,4)) AS VARCHAR)
                               ELSE ' - ' END
              || ' & ' || CAST(abs(p_size - 30) AS VARCHAR) AS row_text
FROM part
""")
def q_row_template(spark, sf):
    # exact decimal arithmetic: binary doubles round ties differently per engine
    scaled = F.round(F.col("p_retailprice").cast("decimal(12,2)") * F.lit(ROW_SCALE).cast("decimal(6,4)"), 4)
    scaled = scaled.cast("decimal(18,4)").cast("string")
    # a value that is missing prints as infinity; F21: absolute value of a column
    value = F.when(F.col("p_size") <= 45, scaled)
    txt = F.concat_ws(" & ", "p_name",
                      F.when(F.col("p_size") > 25, F.coalesce(value, F.lit("$\\infty$"))).otherwise(F.lit(" - ")),
                      F.abs(F.col("p_size") - 30).cast("string"))
    return T(spark, sf, "part").select("p_partkey", txt.alias("row_text"))


@register("numeric_id_sort", """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders
""")
def q_numeric_id_sort(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return C.numeric_id_sort(o, "id")


# ---- J1-J8 ---------------------------------------------------------------------

@register("inner_join", """
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, p.p_name
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size > 40
""")
def q_inner_join(spark, sf):
    p = T(spark, sf, "part").where(F.col("p_size") > 40).select("p_partkey", "p_name")
    li = T(spark, sf, "lineitem").select(*tables.ROW_KEYS["lineitem"])
    return li.join(p, li.l_partkey == p.p_partkey).drop("p_partkey")


@register("aligned_join", """
WITH a AS (SELECT vec_id, label FROM embeddings),
b AS (SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm
      FROM embeddings)
SELECT a.vec_id, a.label, b.norm FROM a JOIN b USING (vec_id)
""")
def q_aligned_join(spark, sf):
    v = tables.vectors(spark, sf)
    a = v.select("vec_id", "label")
    b = v.select("vec_id", round6(V.l2norm("vec")).alias("norm"))
    return a.join(b, "vec_id")


@register("anti_join", "SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def q_anti_join(spark, sf):
    return T(spark, sf, "documents").select("doc_id").join(
        T(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@register("semi_join", """
SELECT d.doc_id FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)
""")
def q_semi_join(spark, sf):
    good = T(spark, sf, "labels").where("quality = 1").select("doc_id")
    return T(spark, sf, "documents").select("doc_id").join(good, "doc_id", "left_semi")


@register("enrich_coalesce", """
SELECT c.c_custkey, coalesce(nullif(n.n_name, ''), c.c_name) AS place, c.c_acctbal
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def q_enrich_coalesce(spark, sf):
    c = T(spark, sf, "customer")
    n = T(spark, sf, "nation")  # 25-row dimension
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
    return j.select("c_custkey", F.coalesce(F.nullif("n_name", F.lit("")), "c_name").alias("place"),
                    "c_acctbal")


# ---- A1-A21 --------------------------------------------------------------------

@register("group_count", """
SELECT source, count(*) AS n, count(text) AS n_text, count(lang) AS n_lang FROM documents GROUP BY source
""")
def q_group_count(spark, sf):
    return T(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("text").alias("n_text"), F.count("lang").alias("n_lang"))


@register("group_count2", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def q_group_count2(spark, sf):
    return T(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@register("distinct_values", "SELECT DISTINCT md5(text) AS text_md5 FROM documents")
def q_distinct_values(spark, sf):
    return T(spark, sf, "documents").select(F.md5("text").alias("text_md5")).distinct()


@register("dedupe_first", """
SELECT doc_id, md5(text) AS text_md5 FROM
  (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def q_dedupe_first(spark, sf):
    # keyed on the 128-bit digest: the shuffle carries 32 characters per row, not whole texts
    d = T(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return C.dedupe_first(d, "text_md5", "doc_id").select("doc_id", "text_md5")


@register("arg_max", """
SELECT user_id, max_by(event_id, (value, -event_id)) AS max_event, min_by(event_id, (value, event_id)) AS min_event
FROM events GROUP BY user_id
""")
def q_arg_max(spark, sf):
    e = T(spark, sf, "events")
    return e.groupBy("user_id").agg(
        F.max_by("event_id", F.struct("value", (-F.col("event_id")).alias("neg"))).alias("max_event"),
        F.min_by("event_id", F.struct("value", "event_id")).alias("min_event"))


@register("column_means", """
SELECT round(avg(p_size), 6) AS mean_size, round(avg(p_retailprice), 6) AS mean_price FROM part
""")
def q_column_means(spark, sf):
    return T(spark, sf, "part").agg(round6(F.avg("p_size")).alias("mean_size"),
                                    round6(F.avg("p_retailprice")).alias("mean_price"))


@register("score_summary", """
SELECT l_returnflag, round(avg(l_discount), 6) AS mean_score, round(stddev_pop(l_discount), 6) AS std_score,
       count(*) AS n FROM lineitem GROUP BY l_returnflag
""")
def q_score_summary(spark, sf):
    return T(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        round6(F.avg("l_discount")).alias("mean_score"),
        round6(F.stddev_pop("l_discount")).alias("std_score"), F.count(F.lit(1)).alias("n"))


@register("cluster_histogram", """
WITH k AS (SELECT CAST(unnest(range(least(0, min(label)), max(label) + 1)) AS INTEGER) AS label FROM embeddings),
c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT k.label, coalesce(c.n, 0) AS n FROM k LEFT JOIN c USING (label)
""")
def q_cluster_histogram(spark, sf):
    counts = T(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = counts.agg(F.min("label"), F.max("label")).first()  # two scalars: labels without rows count 0
    bins = spark.range(min(0, lo or 0), (hi if hi is not None else -1) + 1).select(F.col("id").cast("int").alias("label"))
    return bins.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("raster_count", """
WITH v AS (SELECT CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)
SELECT CAST(floor((e[1] + 0.5) / 0.05) AS BIGINT) AS bx, CAST(floor((e[2] + 0.5) / 0.05) AS BIGINT) AS "by",
       label, count(*) AS n FROM v GROUP BY ALL
""")
def q_raster_count(spark, sf):
    v = tables.vectors(spark, sf)
    bx = F.floor((F.get("vec", 0) + 0.5) / 0.05).cast("long")
    by = F.floor((F.get("vec", 1) + 0.5) / 0.05).cast("long")
    return v.groupBy(bx.alias("bx"), by.alias("by"), "label").agg(F.count(F.lit(1)).alias("n"))


_FIT = "(SELECT regr_intercept(p_retailprice, p_size) AS b0, regr_slope(p_retailprice, p_size) AS b1 FROM part)"


@register("regression_metrics", f"""
WITH f AS {_FIT},
p AS (SELECT p_retailprice AS y, b0 + b1 * p_size AS yhat FROM part, f)
SELECT round(avg((y - yhat) * (y - yhat)), 6) AS mse,
       round(avg(CASE WHEN y <> 0 THEN (y - yhat) * (y - yhat) END), 6) AS masked_mse,
       round(1 - sum((y - yhat) * (y - yhat)) / (SELECT sum((p_retailprice - m) * (p_retailprice - m))
             FROM part, (SELECT avg(p_retailprice) AS m FROM part)), 6) AS r2
FROM p
""")
def q_regression_metrics(spark, sf):
    from astrolabe.operators import gram
    part = T(spark, sf, "part")
    fit = part.agg(F.regr_intercept("p_retailprice", "p_size").alias("b0"),
                   F.regr_slope("p_retailprice", "p_size").alias("b1"))
    pred = stats.with_scalars(part, fit).select(
        F.col("p_retailprice").alias("y"), (F.col("b0") + F.col("b1") * F.col("p_size")).alias("yhat"))
    return gram.regression_metrics(pred, "y", "yhat")


@register("fit_gap", f"""
WITH s AS (SELECT *, {uniform_sql(42, 'split', 'p_partkey')} < 0.2 AS is_test FROM part),
f AS (SELECT regr_intercept(p_retailprice, p_size) AS b0, regr_slope(p_retailprice, p_size) AS b1 FROM s WHERE NOT is_test),
e AS (SELECT avg(CASE WHEN NOT is_test THEN (p_retailprice - b0 - b1 * p_size) ^ 2 END) AS train_mse,
             avg(CASE WHEN is_test THEN (p_retailprice - b0 - b1 * p_size) ^ 2 END) AS test_mse FROM s, f)
SELECT round(train_mse, 6) AS train_mse, round(test_mse, 6) AS test_mse,
       round(abs(train_mse - test_mse) / (train_mse + test_mse), 6) AS gap FROM e
""")
def q_fit_gap(spark, sf):
    from astrolabe.operators import gram
    s = T(spark, sf, "part").withColumn("is_test", uniform(42, "split", F.col("p_partkey")) < 0.2)
    fit = s.where(~F.col("is_test")).agg(F.regr_intercept("p_retailprice", "p_size").alias("b0"),
                                         F.regr_slope("p_retailprice", "p_size").alias("b1"))
    r2 = (F.col("p_retailprice") - F.col("b0") - F.col("b1") * F.col("p_size")) ** 2
    e = stats.with_scalars(s, fit).agg(F.avg(F.when(~F.col("is_test"), r2)).alias("train_mse"),
                                       F.avg(F.when(F.col("is_test"), r2)).alias("test_mse"))
    return e.select(round6("train_mse").alias("train_mse"), round6("test_mse").alias("test_mse"),
                    round6(gram.fit_gap("train_mse", "test_mse")).alias("gap"))


@register("list_fingerprint", """
WITH r AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part),
a AS (SELECT p_brand, pos // 1000 AS up, md5(string_agg(p_name, chr(10) ORDER BY pos)) AS d FROM r GROUP BY p_brand, pos // 1000),
b AS (SELECT p_brand, up // 1000 AS up, md5(string_agg(d, chr(10) ORDER BY up)) AS d, count(*) AS n FROM a GROUP BY p_brand, up // 1000)
SELECT p_brand, md5(string_agg(d, chr(10) ORDER BY up)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_blocks FROM b GROUP BY p_brand
""")
def q_list_fingerprint(spark, sf):
    from astrolabe.operators import text
    return text.list_fingerprint(T(spark, sf, "part"), "p_brand", "p_partkey", "p_name", block=1000)


@register("minmax_scale", f"""
WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT {_LKEY}, round((l_extendedprice - lo) / (hi - lo), 6) AS scaled FROM lineitem, m
""")
def q_minmax_scale(spark, sf):
    li = T(spark, sf, "lineitem")
    m = li.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return stats.with_scalars(li, m).select(
        *tables.ROW_KEYS["lineitem"],
        round6(F.try_divide(F.col("l_extendedprice") - F.col("lo"), F.col("hi") - F.col("lo")))
        .alias("scaled"))


@register("max_norm", """
SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 6) AS rel FROM part
""")
def q_max_norm(spark, sf):
    p = T(spark, sf, "part")
    m = p.agg(F.max("p_retailprice").alias("mx"))
    return stats.with_scalars(p, m).select("p_partkey", round6(F.col("p_retailprice") / F.col("mx")).alias("rel"))


@register("composition_string", """
WITH c AS (SELECT p_partkey, unnest(string_split(regexp_replace(p_name, '[^A-Za-z]', '', 'g'), '')) AS ch,
                  generate_subscripts(string_split(regexp_replace(p_name, '[^A-Za-z]', '', 'g'), ''), 1) AS pos
           FROM part),
g AS (SELECT p_partkey, ch, count(*) AS n, min(pos) AS first FROM c GROUP BY p_partkey, ch)
SELECT p_partkey, string_agg(ch || CAST(n AS VARCHAR), '' ORDER BY first) AS composition FROM g GROUP BY p_partkey
""")
def q_composition_string(spark, sf):
    from astrolabe.operators import text
    p = T(spark, sf, "part")
    return p.select("p_partkey", text.composition(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("composition"))


# ---- W2-W4, T1-T4 -----------------------------------------------------------------

@register("rank_settings", """
SELECT o_orderkey, rank() OVER (ORDER BY round(o_totalprice, -3) DESC) AS rnk FROM orders
""")
def q_rank_settings(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", -3).alias("score"))
    r = stats.global_position(o, [F.desc("score")], "rnk", method="rank", value_cols=["score"])
    return r.select("o_orderkey", "rnk")


@register("cumulative_threshold", f"""
WITH c AS (SELECT p_partkey, sum(p_retailprice) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)
                             / sum(p_retailprice) OVER () AS frac FROM part)
SELECT min_by(p_partkey, (abs(frac - 0.5), p_partkey)) AS k_at_half,
       min_by(p_partkey, (abs(frac - {CUMULATIVE_TARGET}), p_partkey)) AS k_at_target FROM c
""")
def q_cumulative_threshold(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", "p_retailprice")
    c = stats.running_sum(p, ["p_partkey"], "p_retailprice", "run")
    tot = p.agg(F.sum("p_retailprice").alias("tot"))
    c = stats.with_scalars(c, tot).withColumn("frac", F.col("run") / F.col("tot"))
    return c.agg(
        F.min_by("p_partkey", F.struct(F.abs(F.col("frac") - 0.5), F.col("p_partkey"))).alias("k_at_half"),
        F.min_by("p_partkey", F.struct(F.abs(F.col("frac") - CUMULATIVE_TARGET), F.col("p_partkey"))).alias("k_at_target"))


@register("prefix_sets", """
WITH r AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_partkey) AS rn FROM part),
n AS (SELECT count(*) AS n FROM part),
f AS (SELECT unnest([0.1, 0.25, 0.5, 1.0]::DOUBLE[]) AS fraction)
SELECT f.fraction, CAST(count(r.rn) AS BIGINT) AS n_rows, round(sum(r.p_retailprice), 6) AS total
FROM f, n, r WHERE r.rn <= floor(f.fraction * n.n) GROUP BY f.fraction
""")
def q_prefix_sets(spark, sf):
    from astrolabe.operators import gram
    p = T(spark, sf, "part").select("p_partkey", "p_retailprice")
    return gram.prefix_totals(p, ["p_partkey"], "p_retailprice", [0.1, 0.25, 0.5, 1.0])


@register("multi_sort", """
SELECT p_partkey, row_number() OVER (ORDER BY p_type ASC, p_retailprice DESC, p_partkey) AS ord FROM part
""")
def q_multi_sort(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    r = stats.global_position(p, [F.asc("p_type"), F.desc("p_retailprice"), F.asc("p_partkey")], "ord")
    return r.select("p_partkey", "ord")


@register("sort_limit", """
SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30
""")
def q_sort_limit(spark, sf):
    return (T(spark, sf, "part").select("p_partkey", "p_retailprice")
            .orderBy(F.desc("p_retailprice"), "p_partkey").limit(30))


@register("top_weight", """
SELECT p_partkey, round(p_retailprice * p_size, 6) AS weight FROM part
ORDER BY p_retailprice * p_size DESC, p_partkey LIMIT 20
""")
def q_top_weight(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", round6(F.col("p_retailprice") * F.col("p_size")).alias("weight"),
                                    (F.col("p_retailprice") * F.col("p_size")).alias("w"))
    return p.orderBy(F.desc("w"), "p_partkey").limit(20).select("p_partkey", "weight")


@register("nth_row", """
SELECT user_id, event_id, value FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 6
""")
def q_nth_row(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = T(spark, sf, "events").select("user_id", "event_id", "value", "ts")
    return e.withColumn("rn", F.row_number().over(w)).where("rn = 6").select("user_id", "event_id", "value")


# ---- U1-U5 -----------------------------------------------------------------------

@register("pool_sources", """
SELECT md5(text) AS raw_md5, 0 AS source FROM documents
UNION ALL SELECT md5(text), 1 FROM benchmark
UNION ALL SELECT md5(text), 2 FROM conversations
""")
def q_pool_sources(spark, sf):
    pooled = C.pool_sources([(T(spark, sf, "documents"), 0), (T(spark, sf, "benchmark"), 1),
                             (T(spark, sf, "conversations"), 2)], col="text")
    return pooled.select(F.md5("raw").alias("raw_md5"), "source")


@register("stack_with_mask", f"""
SELECT vec_id, true AS is_anchor FROM embeddings WHERE {OBSERVED_SQL}
UNION ALL SELECT vec_id, false FROM embeddings WHERE vec_id >= 20
""")
def q_stack_with_mask(spark, sf):
    e = T(spark, sf, "embeddings").select("vec_id")
    return (tables.inventory(e).withColumn("is_anchor", F.lit(True))
            .unionByName(e.where("vec_id >= 20").withColumn("is_anchor", F.lit(False))))


@register("node_union", """
SELECT s_nationkey AS nationkey FROM supplier UNION SELECT c_nationkey FROM customer
""")
def q_node_union(spark, sf):
    s = T(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    c = T(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return s.union(c).distinct()


@register("set_difference", """
SELECT md5(text) AS text_md5 FROM documents EXCEPT SELECT md5(text) FROM benchmark
""")
def q_set_difference(spark, sf):
    d = T(spark, sf, "documents").select(F.md5("text").alias("text_md5"))
    b = T(spark, sf, "benchmark").select(F.md5("text").alias("text_md5"))
    return d.subtract(b)


@register("set_intersection", """
SELECT doc_id AS item_id FROM labels INTERSECT SELECT vec_id FROM embeddings
""")
def q_set_intersection(spark, sf):
    """Labelled items that the vector store holds."""
    return T(spark, sf, "labels").select(F.col("doc_id").alias("item_id")).intersect(T(spark, sf, "embeddings").select("vec_id"))


@register("drop_zero_vectors", """
SELECT vec_id FROM embeddings WHERE list_sum(CAST(embedding AS DOUBLE[])) <> 0
""")
def q_drop_zero_vectors(spark, sf):
    """P16 (second half): vectors whose components sum to zero are dropped."""
    v = tables.vectors(spark, sf)
    return v.where(V.vsum("vec") != 0).select("vec_id")
