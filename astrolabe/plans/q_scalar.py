"""Registered queries: scalar functions F1-F24 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe import tables
from astrolabe.functions import scalar as S
from astrolabe.functions import vectors as V
from astrolabe.operators import stats
from astrolabe.plans.registry import register


def T(spark, sf, name):
    return tables.load(spark, sf, name)


def _ref(vecs, vec_id: int, name: str):
    """One reference vector as a one-row frame (exactly one row: keyed lookup)."""
    return vecs.where(F.col("vec_id") == vec_id).select(F.col("vec").alias(name))


_DV = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


@register("cosine_pairs", f"""
WITH {_DV}
SELECT a.vec_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS cos
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1
""")
def q_cosine_pairs(spark, sf):
    v = tables.vectors(spark, sf).select("vec_id", "vec")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("vec_b"))
    return v.join(nxt, "vec_id").select("vec_id", round6(V.cosine_similarity("vec", "vec_b")).alias("cos"))


@register("euclid_to_ref", f"""
WITH {_DV}, r AS (SELECT vec AS ref FROM v WHERE vec_id = 0)
SELECT vec_id, round(list_distance(vec, ref), 6) AS dist,
       round(list_distance(vec, ref) * list_distance(vec, ref), 6) AS dist2 FROM v, r
""")
def q_euclid_to_ref(spark, sf):
    v = tables.vectors(spark, sf)
    j = stats.with_scalars(v, _ref(v, 0, "ref"))
    return j.select("vec_id", round6(V.euclidean("vec", "ref")).alias("dist"),
                    round6(V.sq_euclidean("vec", "ref")).alias("dist2"))


@register("vector_analogy", f"""
WITH {_DV}, b AS (SELECT vec AS b FROM v WHERE vec_id = 0), c AS (SELECT vec AS c FROM v WHERE vec_id = 1)
SELECT vec_id,
  round(list_cosine_similarity(list_transform(range(1, len(vec) + 1), lambda i: vec[i] + b[i]), c), 6) AS sim_plus,
  round(CASE WHEN list_sum(list_transform(range(1, len(vec) + 1), lambda i: abs(vec[i] - b[i]))) = 0 THEN NULL
             ELSE list_cosine_similarity(list_transform(range(1, len(vec) + 1), lambda i: vec[i] - b[i]), c)
        END, 6) AS sim_minus
FROM v, b, c
""")
def q_vector_analogy(spark, sf):
    v = tables.vectors(spark, sf)
    j = stats.with_scalars(stats.with_scalars(v, _ref(v, 0, "b")), _ref(v, 1, "c"))
    return j.select("vec_id",
                    round6(V.cosine_similarity(V.vadd("vec", "b"), "c")).alias("sim_plus"),
                    round6(V.cosine_similarity(V.vsub("vec", "b"), "c")).alias("sim_minus"))


@register("interpolate_vectors", f"""
WITH {_DV}, p AS (SELECT a.vec_id, a.vec AS va, b.vec AS vb FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, step, list_transform(range(1, len(va) + 1),
             lambda i: va[i] + (vb[i] - va[i]) * (step / 7.0)) AS pt
      FROM p, (SELECT unnest(range(8)) AS step))
SELECT vec_id, CAST(step AS INTEGER) AS step, round(pt[1], 6) AS x0,
       round(sqrt(list_sum(list_transform(pt, lambda x: x * x))), 6) AS norm FROM s
""")
def q_interpolate_vectors(spark, sf):
    v = tables.vectors(spark, sf).select("vec_id", "vec")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("vec_b"))
    p = v.join(nxt, "vec_id").select("vec_id", "vec", "vec_b",
                                     F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step"))
    pt = V.lerp("vec", "vec_b", F.col("step") / 7.0)
    return p.select("vec_id", "step", round6(F.get(pt, 0)).alias("x0"),
                    round6(V.l2norm(pt)).alias("norm"))


_RATE_SQL = """
CASE WHEN l_linenumber = 3 THEN l_quantity * pow({T} / 300.0, l_discount) * exp(-l_tax / {T})
     WHEN l_linenumber = 4 THEN l_quantity * l_discount * (0.62 + 0.4767 * l_tax * sqrt(300.0 / {T}))
     WHEN l_linenumber = 5 THEN l_quantity * l_discount * (1.0 + 0.0967 * l_tax * sqrt(300.0 / {T})
                                + (l_tax * l_tax / 10.526) * (300.0 / {T})) END"""


def _rate(T_col):
    return S.compute_rate("l_linenumber", T_col, "l_quantity", "l_discount", "l_tax", lenient=True)


@register("rate_law", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round({_RATE_SQL.format(T='10.0')}, 6) AS rate
FROM lineitem
""")
def q_rate_law(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.select(*tables.ROW_KEYS["lineitem"], round6(_rate(F.lit(10.0))).alias("rate"))


@register("rate_grid", f"""
WITH g AS (SELECT i, 2.0 + i * (CAST(298 AS DOUBLE) / 99) AS temp FROM (SELECT unnest(range(100)) AS i)),
r AS (SELECT l_linenumber AS react_class, i, temp, {_RATE_SQL.format(T='temp')} AS rate
      FROM lineitem, g WHERE l_linenumber IN (3, 4, 5))
SELECT react_class, CAST(i AS INTEGER) AS t_idx, round(temp, 6) AS temp, round(avg(rate), 6) AS mean_rate
FROM r GROUP BY react_class, i, temp
""")
def q_rate_grid(spark, sf):
    li = T(spark, sf, "lineitem").where(F.col("l_linenumber").isin(3, 4, 5))
    step = 298.0 / 99
    g = li.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("t_idx"))
    g = g.withColumn("temp", F.lit(2.0) + F.col("t_idx") * F.lit(step))
    return (g.groupBy(F.col("l_linenumber").alias("react_class"), "t_idx", "temp")
            .agg(F.avg(_rate(F.col("temp"))).alias("mean_rate"))
            .select("react_class", "t_idx", round6("temp").alias("temp"),
                    round6("mean_rate").alias("mean_rate")))


@register("log_target", """
SELECT p_partkey, round(log10(p_retailprice), 6) AS log_y, round(pow(10, log10(p_retailprice)), 6) AS y_back
FROM part
""")
def q_log_target(spark, sf):
    p = T(spark, sf, "part")
    ly = S.log10_pos("p_retailprice")
    return p.select("p_partkey", round6(ly).alias("log_y"), round6(S.exp10(ly)).alias("y_back"))


@register("abundance_ratio", """
WITH m AS (SELECT user_id, avg(value) AS mean_v FROM events GROUP BY user_id)
SELECT e.event_id, round(e.value / m.mean_v, 6) AS ratio,
       round(CASE WHEN e.value > 0 THEN log10(e.value / 1e11) END, 6) AS log_abundance
FROM events e JOIN m USING (user_id)
""")
def q_abundance_ratio(spark, sf):
    e = T(spark, sf, "events")
    m = e.groupBy("user_id").agg(F.avg("value").alias("mean_v"))
    return e.join(m, "user_id").select(
        "event_id", round6(F.try_divide(F.col("value"), F.col("mean_v"))).alias("ratio"),
        round6(S.log10_pos(F.col("value") / 1e11)).alias("log_abundance"))


@register("error_factor", """
SELECT p_partkey, round(pow(10, abs(log10((900.0 + 2 * p_size) / p_retailprice))), 6) AS factor FROM part
""")
def q_error_factor(spark, sf):
    p = T(spark, sf, "part")
    return p.select("p_partkey", round6(S.error_factor(F.lit(900.0) + 2 * F.col("p_size"),
                                                        F.col("p_retailprice"))).alias("factor"))


def part_formula(p):
    """A formula-like string derived from each part row (stand-in for inventory formulas)."""
    suffix = (F.when(F.col("p_type") == "PROMO", "N").when(F.col("p_type") == "SMALL", "O2")
              .when(F.col("p_type") == "LARGE", "S").when(F.col("p_type") == "MEDIUM", "Si")
              .when(F.col("p_type") == "ECONOMY", "NO").otherwise("P"))
    return F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("H"),
                    F.length("p_name").cast("string"), suffix)


_FORMULA_SQL = """('C' || CAST(p_size AS VARCHAR) || 'H' || CAST(length(p_name) AS VARCHAR) ||
  CASE p_type WHEN 'PROMO' THEN 'N' WHEN 'SMALL' THEN 'O2' WHEN 'LARGE' THEN 'S' WHEN 'MEDIUM' THEN 'Si'
              WHEN 'ECONOMY' THEN 'NO' ELSE 'P' END)"""


def _count_sql(el):
    toks = f"regexp_extract_all(formula, '{el}[0-9]*')"
    return (f"CASE WHEN len({toks}) = 0 THEN 0 WHEN replace({toks}[-1], '{el}', '') = '' THEN 1 "
            f"ELSE CAST(replace({toks}[-1], '{el}', '') AS INTEGER) END")


@register("formula_counts", f"""
WITH f AS (SELECT p_partkey, {_FORMULA_SQL} AS formula FROM part)
SELECT p_partkey, formula, {_count_sql('N')} AS n_n, {_count_sql('O')} AS n_o, {_count_sql('S')} AS n_s,
       {_count_sql('N')} + {_count_sql('O')} + {_count_sql('Si')} + {_count_sql('P')} + {_count_sql('S')} AS heavy
FROM f
""")
def q_formula_counts(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", part_formula(T(spark, sf, "part")).alias("formula"))
    return p.select("p_partkey", "formula", S.element_count("formula", "N").alias("n_n"),
                    S.element_count("formula", "O").alias("n_o"), S.element_count("formula", "S").alias("n_s"),
                    S.heavy_atom_count("formula").alias("heavy"))


_MASS_VALUES = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in S.ATOMIC_MASS.items())


@register("formula_mass", f"""
WITH f AS (SELECT p_partkey, {_FORMULA_SQL} AS formula FROM part),
t AS (SELECT p_partkey, unnest(regexp_extract_all(formula, '[A-Z][a-z]?[0-9]*')) AS tok FROM f),
m(sym, mass) AS (VALUES {_MASS_VALUES})
SELECT p_partkey, round(CASE WHEN count(m.mass) = count(*) THEN sum(m.mass * CASE WHEN regexp_extract(tok, '[0-9]+') = '' THEN 1
                                          ELSE CAST(regexp_extract(tok, '[0-9]+') AS INTEGER) END) END, 6) AS mass
FROM t LEFT JOIN m ON regexp_extract(tok, '^[A-Z][a-z]?') = m.sym GROUP BY p_partkey
""")
def q_formula_mass(spark, sf):
    from astrolabe.operators import text
    p = T(spark, sf, "part")
    return p.select("p_partkey", round6(text.formula_mass(part_formula(p), S.ATOMIC_MASS)).alias("mass"))


@register("strip_chars", "SELECT o_orderkey, translate(o_orderpriority, '+-', '') AS priority FROM orders")
def q_strip_chars(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey", S.strip_charges("o_orderpriority").alias("priority"))


@register("markup_rewrite", r"""
SELECT p_partkey, regexp_replace(regexp_replace(p_brand, '([0-9]+)', '$_{\1}$', 'g'), '([+-])', '$^\1$', 'g') AS markup
FROM part
""")
def q_markup_rewrite(spark, sf):
    return T(spark, sf, "part").select("p_partkey", S.formula_markup("p_brand").alias("markup"))


@register("escape_wrap", r"""
SELECT p_partkey, '\ce{' || replace(p_brand, '#', '\#') || '}' AS wrapped FROM part
""")
def q_escape_wrap(spark, sf):
    return T(spark, sf, "part").select("p_partkey", S.escape_wrap("p_brand").alias("wrapped"))


@register("multiplicity", """
WITH m AS (SELECT 2 * ((l_linenumber - 1) / 2.0) + 1 AS multi FROM lineitem)
SELECT multi, CASE WHEN multi = 1 THEN 'rhf' ELSE 'uhf' END AS reference, count(*) AS n FROM m GROUP BY ALL
""")
def q_multiplicity(spark, sf):
    li = T(spark, sf, "lineitem").select(S.multiplicity(F.col("l_linenumber") - 1).alias("multi"))
    return li.groupBy("multi", S.scf_reference("multi").alias("reference")).agg(F.count(F.lit(1)).alias("n"))


@register("acquisition", """
WITH s AS (SELECT user_id, avg(value / 100) AS m, stddev_pop(value / 100) AS s FROM events GROUP BY user_id)
SELECT user_id, round(m * s, 6) AS weight, round(pow(10, m) / pow(10, s), 6) AS ratio FROM s
""")
def q_acquisition(spark, sf):
    s = T(spark, sf, "events").groupBy("user_id").agg(F.avg(F.col("value") / 100).alias("m"),
                                                      F.stddev_pop(F.col("value") / 100).alias("s"))
    return s.select("user_id", round6(S.acquisition_product("m", "s")).alias("weight"),
                    round6(S.acquisition_ratio("m", "s")).alias("ratio"))


_FEATURE_COUNTS = {k: f"CAST(len(regexp_extract_all(text, '{v}')) AS DOUBLE)" for k, v in S.FEATURE_CLASSES.items()}


@register("string_features", f"""
SELECT doc_id, CAST(length(text) AS DOUBLE) AS f_len, {", ".join(f"{v} AS f_{k}" for k, v in _FEATURE_COUNTS.items())},
  {", ".join(f"round(CASE WHEN length(text) > 0 THEN {v} / length(text) ELSE 0.0 END, 6) AS r_{k}" for k, v in _FEATURE_COUNTS.items())}
FROM documents
""")
def q_string_features(spark, sf):
    f = T(spark, sf, "documents").select("doc_id", S.string_features("text").alias("f"))
    names = [*S.FEATURE_CLASSES]
    return f.select("doc_id", F.get("f", F.lit(0)).alias("f_len"), *[F.get("f", F.lit(i + 1)).alias(f"f_{n}") for i, n in enumerate(names)],
                    *[round6(F.get("f", F.lit(i + 1 + len(names)))).alias(f"r_{n}") for i, n in enumerate(names)])


@register("normalise_key", r"""
SELECT doc_id, md5(nullif(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))), '')) AS key_md5 FROM documents
""")
def q_normalise_key(spark, sf):
    return T(spark, sf, "documents").select("doc_id", F.md5(S.normalise_key("text")).alias("key_md5"))
