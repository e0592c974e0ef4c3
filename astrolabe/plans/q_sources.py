"""Registered queries: sources and sinks round-tripped through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe import tables
from astrolabe.functions import scalar as S
from astrolabe.functions import vectors as V
from astrolabe.plans.registry import register
from astrolabe.session import scratch_path
from astrolabe.sources import io


def T(spark, sf, name):
    return tables.load(spark, sf, name)


PART_SCHEMA = ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
               "p_retailprice double")


@register("csv_scan", "SELECT p_name FROM part WHERE p_name IS NOT NULL")
def q_csv_scan(spark, sf):
    path = scratch_path(spark, "part-csv")
    io.write_csv(T(spark, sf, "part"), path, compression="gzip")
    return io.read_csv_column(spark, path, PART_SCHEMA, "p_name")


_KEY_SQL = r"nullif(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))), '')"


@register("multi_file_scan", f"""
SELECT md5({_KEY_SQL}) AS smiles_md5 FROM documents WHERE {_KEY_SQL} IS NOT NULL
""")
def q_multi_file_scan(spark, sf):
    """A tree of files (one directory per language, several files each, each
    file starting with its own header line); read back recursively, skipping the
    first line of every file and keeping the first field (the whole normalised text)."""
    d = T(spark, sf, "documents").select(S.normalise_key("text").alias("smiles"), "doc_id", "lang")
    d = d.where(F.col("smiles").isNotNull())
    path = scratch_path(spark, "pool-files")
    (d.write.mode("overwrite").partitionBy("lang")
     .option("header", True).option("sep", " ").option("escape", '"').csv(path))
    return io.read_first_field(spark, path, " ").select(F.md5("smiles").alias("smiles_md5"))


@register("token_file_scan", r"""
WITH t AS (SELECT unnest(regexp_split_to_array(text, '[ \t\r\n\f]+')) AS token FROM documents)
SELECT count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM t WHERE token <> ''
""")
def q_token_file_scan(spark, sf):
    path = scratch_path(spark, "token-files")
    T(spark, sf, "documents").select(F.col("text").alias("value")).write.mode("overwrite").text(path)
    toks = io.read_tokens(spark, path)
    return toks.agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("token").alias("n_distinct"))


@register("capped_valid_scan", f"""
SELECT DISTINCT md5(value) AS value_md5 FROM (
  SELECT doc_id, {_KEY_SQL} AS value FROM documents
  WHERE regexp_matches({_KEY_SQL}, '^[a-z]{{3}}') ORDER BY doc_id LIMIT 300)
""")
def q_capped_valid_scan(spark, sf):
    """``id<TAB>value`` file; the first 300 *valid* rows in id order (the cap is
    the feature), distinct values."""
    path = scratch_path(spark, "id-value")
    d = T(spark, sf, "documents").select("doc_id", S.normalise_key("text").alias("value"))
    d.write.mode("overwrite").option("sep", "\t").option("escape", '"').csv(path)
    out = io.read_capped_valid(spark, path, r"^[a-z]{3}", n_max=300, id_col="doc_id")
    return out.select(F.md5("value").alias("value_md5"))


@register("series_scan", """
SELECT user_id, CAST(event_id AS DOUBLE) AS t, value AS x FROM events
""")
def q_series_scan(spark, sf):
    path = scratch_path(spark, "series")
    # one file per task, each with a header line that the reader skips, and columns
    # set apart by runs of blanks and tabs; the series' key is a column, not a folder
    line = F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit("   "), F.coalesce(F.col("value").cast("string"), F.lit("nan")),
                    F.lit("\t "), F.col("user_id").cast("string"))
    (T(spark, sf, "events").select(line.alias("t x user")).write.option("header", True)
     .option("sep", "\u0001").option("quote", "").csv(path))
    s = io.read_series(spark, path, ("t", "x", "user_id"))
    return s.select(F.col("user_id").cast("long").alias("user_id"), "t", "x")


@register("value_list_scan", f"""
SELECT md5({_KEY_SQL}) AS value_md5 FROM documents WHERE {_KEY_SQL} IS NOT NULL
""")
def q_value_list_scan(spark, sf):
    """A list with one value per line (values hold blanks), read back."""
    path = scratch_path(spark, "value-list")
    keys = T(spark, sf, "documents").select(S.normalise_key("text").alias("k")).where("k IS NOT NULL")
    keys.select(F.concat(F.lit(" "), "k", F.lit("\t")).alias("value")).write.text(path)
    return io.read_values(spark, path).select(F.md5("value").alias("value_md5"))


@register("vector_scan", """
SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm
FROM embeddings
""")
def q_vector_scan(spark, sf):
    e = T(spark, sf, "embeddings")
    c = io.vector_column(e)
    return e.select("vec_id", round6(V.l2norm(F.col(c).cast("array<double>"))).alias("norm"))


@register("overwrite_sink", """
SELECT vec_id, label, round(CASE WHEN label = 3 THEN 2 * CAST(embedding[1] AS DOUBLE)
                                 ELSE CAST(embedding[1] AS DOUBLE) END, 6) AS x0 FROM embeddings
""")
def q_overwrite_sink(spark, sf):
    path = scratch_path(spark, "store")
    v = tables.vectors(spark, sf).select("vec_id", F.get("vec", 0).alias("x0"), "label")
    io.overwrite_partitions(v, path, "label")
    # replace one partition's array with new values; the others stay untouched
    io.overwrite_partitions(v.where("label = 3").withColumn("x0", F.col("x0") * 2), path, "label")
    back = spark.read.parquet(path)
    return back.select("vec_id", F.col("label").cast("int").alias("label"), round6("x0").alias("x0"))


@register("csv_sink", "SELECT p_partkey, p_name, p_retailprice FROM part")
def q_csv_sink(spark, sf):
    path = scratch_path(spark, "csv-sink")
    io.write_csv(T(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return spark.read.schema("p_partkey long, p_name string, p_retailprice double") \
        .option("header", True).option("escape", '"').csv(path)


@register("text_sink", r"""
SELECT md5(k) AS value_md5 FROM (SELECT nullif(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))), '') AS k
                                 FROM documents) WHERE k IS NOT NULL
""")
def q_text_sink(spark, sf):
    path = scratch_path(spark, "text-sink")
    keys = T(spark, sf, "documents").select(S.normalise_key("text").alias("k"))
    io.write_lines(keys, "k", path)
    return spark.read.text(path).select(F.md5("value").alias("value_md5"))


@register("metrics_sink", """
WITH f AS (SELECT regr_intercept(p_retailprice, p_size) AS b0, regr_slope(p_retailprice, p_size) AS b1 FROM part),
p AS (SELECT p_retailprice AS y, b0 + b1 * p_size AS yhat FROM part, f)
SELECT 'linear' AS model, round(avg((y - yhat) * (y - yhat)), 6) AS mse,
       round(avg(CASE WHEN y <> 0 THEN (y - yhat) * (y - yhat) END), 6) AS masked_mse,
       round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)), 6) AS r2
FROM p
""")
def q_metrics_sink(spark, sf):
    """One metrics record per model family, written as JSON and read back."""
    from astrolabe.operators import gram
    part = T(spark, sf, "part")
    fit = part.agg(F.regr_intercept("p_retailprice", "p_size").alias("b0"),
                   F.regr_slope("p_retailprice", "p_size").alias("b1"))
    from astrolabe.operators.stats import with_scalars
    pred = with_scalars(part, fit).select(F.col("p_retailprice").alias("y"),
                                          (F.col("b0") + F.col("b1") * F.col("p_size")).alias("yhat"),
                                          F.lit("linear").alias("model"))
    m = gram.regression_metrics(pred, "y", "yhat", ["model"])
    path = scratch_path(spark, "metrics")
    io.write_metrics(m, path)
    return spark.read.schema("model string, mse double, masked_mse double, r2 double").json(path)
