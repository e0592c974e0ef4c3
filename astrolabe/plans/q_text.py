"""Registered queries: log/text extraction and job-status tables
(S8, S9, W5-W7, D1-D7, M1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe import tables
from astrolabe.functions import scalar as S
from astrolabe.operators import search, stats
from astrolabe.operators import text as X
from astrolabe.constants import OBSERVED_SQL
from astrolabe.plans.registry import register


def T(spark, sf, name):
    return tables.load(spark, sf, name)


def doc_lines(spark, sf):
    """documents as log files: file = doc_id, line order = pos."""
    return X.lines_of(T(spark, sf, "documents"), ["doc_id"], "text")


def conv_lines(spark, sf):
    """conversations as log files: file = conv_id, line order = (turn, pos)."""
    return X.lines_of(T(spark, sf, "conversations"), ["conv_id"], "text", ["turn"])


_DOC_LINES = """l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
                      unnest(string_split(text, chr(10))) AS line FROM documents)"""
_CONV_LINES = """l AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
                       unnest(string_split(text, chr(10))) AS line FROM conversations)"""
_TOKS = r"list_filter(regexp_split_to_array(trim({x}), '[ \t\r\n\f]+'), lambda t: t <> '')"


@register("log_extract", f"""
WITH {_DOC_LINES}, t AS (SELECT doc_id, pos, line, {_TOKS.format(x='line')} AS k FROM l)
SELECT doc_id,
  arg_max(TRY_CAST(k[5] AS DOUBLE), pos) FILTER (WHERE contains(line, ' de ') AND TRY_CAST(k[5] AS DOUBLE) IS NOT NULL) AS a,
  arg_max(k[5], pos) FILTER (WHERE contains(line, ' de ')) AS a_tok,
  arg_max(k[-1], pos) FILTER (WHERE contains(line, '###')) AS e_tok,
  arg_max(TRY_CAST(k[-1] AS DOUBLE), pos) FILTER (WHERE contains(line, '###') AND TRY_CAST(k[-1] AS DOUBLE) IS NOT NULL) AS e,
  arg_max(TRY_CAST(k[8] AS DOUBLE), pos) FILTER (WHERE contains(line, ' de ') AND TRY_CAST(k[8] AS DOUBLE) IS NOT NULL) AS b,
  arg_max(k[8], pos) FILTER (WHERE contains(line, ' de ')) AS b_tok,
  arg_max(k[11], pos) FILTER (WHERE contains(line, ' de ')) AS c_tok,
  arg_max(k[-4], pos) FILTER (WHERE contains(line, 'License')) AS zpe_tok,
  arg_max(k[-2], pos) FILTER (WHERE contains(line, 'License')) AS h_tok
FROM t WHERE contains(line, ' de ') OR contains(line, '###') OR contains(line, 'License') GROUP BY doc_id
""")
def q_log_extract(spark, sf):
    lines = doc_lines(spark, sf)
    fields = {  # name: (marker, value column); unparsable numbers keep the earlier match
        "a": (" de ", X.tok("line", 4).try_cast("double")),
        "a_tok": (" de ", X.tok("line", 4)),
        "e_tok": ("###", X.tok("line", -1)),
        "e": ("###", X.tok("line", -1).try_cast("double")),
        "b": (" de ", X.tok("line", 7).try_cast("double")),
        "b_tok": (" de ", X.tok("line", 7)),
        "c_tok": (" de ", X.tok("line", 10)),
        "zpe_tok": ("License", X.tok("line", -4)),
        "h_tok": ("License", X.tok("line", -2)),
    }
    any_marker = F.lit(False)
    aggs = []
    for name, (marker, val) in fields.items():
        # a marker line without that token (or with an unparsable number) keeps the earlier match
        cond = F.col("line").contains(marker) & val.isNotNull()
        any_marker = any_marker | F.col("line").contains(marker)
        aggs.append(F.max_by(F.when(cond, val), F.when(cond, F.col("pos"))).alias(name))
    return lines.where(any_marker).groupBy("doc_id").agg(*aggs)


@register("log_array_harvest", f"""
WITH {_DOC_LINES},
t AS (SELECT doc_id, pos, {_TOKS.format(x='line')} AS k FROM l WHERE contains(line, 'de')),
v AS (SELECT doc_id, pos, list_filter(k[greatest(len(k) - 2, 1):], lambda x: regexp_matches(x, '^[0-9]+$')) AS vals FROM t)
SELECT doc_id, array_to_string(flatten(list(vals ORDER BY pos)), ',') AS harvested,
       CAST(len(flatten(list(vals ORDER BY pos))) AS INTEGER) AS n_values
FROM v GROUP BY doc_id
""")
def q_log_array_harvest(spark, sf):
    h = X.harvest_digits(doc_lines(spark, sf), ["doc_id"], ["pos"], "de")
    return h.select("doc_id", F.array_join("values", ",").alias("harvested"), F.size("values").alias("n_values"))


@register("next_line_value", f"""
WITH {_CONV_LINES},
n AS (SELECT *, lead(line) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS nxt FROM l),
k AS (SELECT conv_id, turn, pos, {_TOKS.format(x='nxt')} AS k FROM n WHERE contains(line, 'the'))
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, k[6] AS t5, k[4] AS t3, k[2] AS t1 FROM k
""")
def q_next_line_value(spark, sf):
    out = X.next_line_tokens(T(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", "the", [5, 3, 1])
    return out.select("conv_id", "turn", "pos", "t5", "t3", "t1")


@register("following_pairs", f"""
WITH {_CONV_LINES},
n AS (SELECT *, concat_ws(chr(9), lead(line, 1) OVER w, lead(line, 2) OVER w) AS nxt FROM l
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, pos)),
k AS (SELECT conv_id, turn, pos, {_TOKS.format(x='nxt')} AS k FROM n WHERE contains(line, 'the'))
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, CAST(len(k) // 2 AS INTEGER) AS n_pairs,
       array_to_string(list_transform(range(1, len(k) // 2 + 1),
                                      lambda i: lower(replace(k[2 * i - 1], ':', '')) || '=' || k[2 * i]), ';') AS pairs FROM k
""")
def q_following_pairs(spark, sf):
    out = X.next_line_tokens(T(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", "the", [], n_following=2)
    n = F.floor(F.size(F.coalesce("__toks", F.array().cast("array<string>"))) / 2).cast("int")
    key = lambda i: F.lower(F.replace(F.get("__toks", 2 * i), F.lit(":"), F.lit("")))
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(key(i), F.lit("="), F.get("__toks", 2 * i + 1)))
    return out.select("conv_id", "turn", "pos", n.alias("n_pairs"),
                      F.array_join(F.when(n > 0, pairs).otherwise(F.array().cast("array<string>")), ";").alias("pairs"))


@register("last_block", f"""
WITH {_CONV_LINES},
m AS (SELECT conv_id, arg_max(turn, (turn, pos)) AS lt, arg_max(pos, (turn, pos)) AS lp
      FROM l WHERE contains(line, 'the') GROUP BY conv_id)
SELECT l.conv_id, l.turn, CAST(l.pos AS INTEGER) AS pos, md5(l.line) AS line_md5 FROM l JOIN m USING (conv_id)
WHERE l.turn > m.lt OR (l.turn = m.lt AND l.pos > m.lp)
""")
def q_last_block(spark, sf):
    lines = conv_lines(spark, sf).withColumn("ord", F.struct("turn", "pos"))
    out = X.last_block(lines, ["conv_id"], "ord", "the")
    return out.select("conv_id", "turn", "pos", F.md5("line").alias("line_md5"))


@register("job_done", f"""
WITH {_CONV_LINES}
SELECT conv_id, bool_or(contains(line, 'of the') OR contains(line, 'de la')) AS done FROM l GROUP BY conv_id
""")
def q_job_done(spark, sf):
    return X.any_marker(conv_lines(spark, sf), ["conv_id"], ["of the", "de la"], "done")


@register("job_failed", """
SELECT l.doc_id, coalesce(bool_or(contains(d.text, 'License')), false) AS failed
FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY l.doc_id
""")
def q_job_failed(spark, sf):
    docs = T(spark, sf, "documents").select("doc_id", F.col("text").contains("License").alias("bad"))
    j = T(spark, sf, "labels").select("doc_id").join(docs, "doc_id", "left")
    return j.groupBy("doc_id").agg(F.coalesce(F.bool_or("bad"), F.lit(False)).alias("failed"))


@register("work_state", """
WITH u AS (SELECT user_id, bool_or(event_type = 'purchase') AS done, bool_or(event_type = 'error') AS failed
           FROM events GROUP BY user_id)
SELECT o.o_orderkey,
  CASE WHEN o.o_orderstatus = 'P' THEN 'skip-ignored' WHEN coalesce(u.done, false) THEN 'skip-done'
       WHEN coalesce(u.failed, false) THEN 'restart' ELSE 'run' END AS state,
  CASE WHEN o.o_orderstatus = 'P' THEN 'skip-ignored' WHEN coalesce(u.done, false) THEN 'skip-done'
       WHEN coalesce(u.failed, false) THEN 'skip-failed' ELSE 'run' END AS state_no_restart
FROM orders o LEFT JOIN u ON o.o_custkey = u.user_id
""")
def q_work_state(spark, sf):
    u = T(spark, sf, "events").groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "purchase").alias("done"),
        F.bool_or(F.col("event_type") == "error").alias("failed"))
    o = T(spark, sf, "orders")
    j = o.join(u, o.o_custkey == u.user_id, "left")
    def state(failed: str):
        return (F.when(F.col("o_orderstatus") == "P", "skip-ignored")
                .when(F.coalesce("done", F.lit(False)), "skip-done")
                .when(F.coalesce("failed", F.lit(False)), failed).otherwise("run"))
    # with and without the option to start failed jobs again
    return j.select("o_orderkey", state("restart").alias("state"), state("skip-failed").alias("state_no_restart"))


@register("ignore_list", """
WITH f AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'jobs/run_' ELSE 'jobs/' END || (doc_id // 2) || '.log' AS name, text FROM documents),
i AS (SELECT DISTINCT CAST(regexp_extract(name, '([0-9]+)\\.log$', 1) AS BIGINT) AS id FROM f
      WHERE NOT contains(name, '_') AND (contains(text, 'License') OR contains(text, ' de la ')))
SELECT id, row_number() OVER (ORDER BY id) AS place FROM i
""")
def q_ignore_list(spark, sf):
    """D3: logs named after a number, two rows a log and some names with ``_``."""
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "jobs/run_").otherwise("jobs/"),
                    F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".log"))
    files = T(spark, sf, "documents").select(name.alias("name"), "text")
    return X.ignore_list(files, "name", "text", ["License", " de la "])


@register("log_mask", f"""
WITH {_CONV_LINES}
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, contains(line, 'the') AS is_marker, contains(line, 'der') AS has_der
FROM l
""")
def q_log_mask(spark, sf):
    lines = conv_lines(spark, sf)
    return lines.select("conv_id", "turn", "pos", F.col("line").contains("the").alias("is_marker"),
                        F.col("line").contains("der").alias("has_der"))


@register("target_table", """
WITH t AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS idx,
                  CAST(len(regexp_extract_all(p_brand, '1')) - len(regexp_extract_all(p_brand, '2')) AS INTEGER) AS charge,
                  2 * (len(regexp_extract_all(p_name, 'o')) / 2.0) + 1 AS multi FROM part)
SELECT p_partkey, idx, charge, multi, CASE WHEN multi = 1 THEN 'rhf' ELSE 'uhf' END AS method FROM t
""")
def q_target_table(spark, sf):
    p = T(spark, sf, "part").select(
        "p_partkey",
        (F.regexp_count("p_brand", F.lit("1")) - F.regexp_count("p_brand", F.lit("2"))).alias("charge"),
        S.multiplicity(F.regexp_count("p_name", F.lit("o"))).alias("multi"))
    p = stats.global_position(p, ["p_partkey"], "idx")
    return p.select("p_partkey", "idx", "charge", "multi", S.scf_reference("multi").alias("method"))


@register("result_summary", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
a AS (SELECT vec_id AS anchor_id, vec AS avec FROM v WHERE {OBSERVED_SQL}),
d AS (SELECT a.anchor_id, v.vec_id AS entry, list_distance(a.avec, v.vec) AS distance FROM a, v),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY distance, entry) AS rn FROM d) WHERE rn <= 10)
SELECT t.entry AS recommendation, t.anchor_id AS anchor, round(t.distance, 6) AS distance,
       coalesce(nullif(doc.lang, ''), 'unknown') AS lang, doc.n_chars
FROM t JOIN documents doc ON doc.doc_id = t.entry WHERE t.distance >= 1e-3
""")
def q_result_summary(spark, sf):
    v = tables.vectors(spark, sf)
    recs = search.knn_topk(v, tables.inventory(v).withColumnRenamed("vec_id", "anchor_id"), 10)
    docs = T(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    j = recs.where(F.col("distance") >= 1e-3).join(docs, recs.entry == docs.doc_id)
    return j.select(F.col("entry").alias("recommendation"), F.col("anchor_id").alias("anchor"),
                    round6("distance").alias("distance"),
                    F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("lang"), "n_chars")


@register("token_corpus", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w
           FROM documents),
s AS (SELECT doc_id, flatten(list_transform(range(1, len(w) + 1),
             lambda i: [w[i], concat_ws('_', CASE WHEN i > 1 THEN w[i - 1] END, w[i], w[i + 1])])) AS s FROM w)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_tokens, md5(array_to_string(s, ' ')) AS sentence_md5 FROM s
""")
def q_token_corpus(spark, sf):
    s = X.token_sentence("text", radius=1)
    return T(spark, sf, "documents").select("doc_id", F.size(s).alias("n_tokens"),
                                            F.md5(F.array_join(s, " ")).alias("sentence_md5"))
