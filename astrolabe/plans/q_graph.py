"""Registered queries: reaction records and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe import tables
from astrolabe.operators import graph as G
from astrolabe.plans.registry import register
from astrolabe.sources import io


def T(spark, sf, name):
    return tables.load(spark, sf, name)


IGNORE_SPECIES = ["S1", "S2", "P10"]


def reaction_text(spark, sf):
    """Reaction records written as text from lineitem, then scanned back.

    alpha = l_quantity, beta = l_discount, gamma = l_tax, class = l_linenumber;
    rows with l_linenumber = 7 are written as ``!`` comment lines.
    """
    li = T(spark, sf, "lineitem")
    rec = F.format_string("%s %s  %.3e %.3e %.3e 1 logn %d 10 280",
                          F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
                          F.concat(F.lit("P"), F.col("l_partkey").cast("string")),
                          "l_quantity", "l_discount", "l_tax", "l_linenumber")
    line = F.when(F.col("l_linenumber") == 7,
                  F.concat(F.lit("! comment for order "), F.col("l_orderkey").cast("string"))).otherwise(rec)
    return io.roundtrip_text(li.select(line.alias("value")), "reactions")


_PARSED = """r AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS A, 'P' || CAST(l_partkey AS VARCHAR) AS B,
                  l_quantity AS alpha, l_discount AS beta, abs(l_tax) AS gamma, l_linenumber AS react_class
           FROM lineitem WHERE l_linenumber <> 7)"""
_BOUND = "(^|[^A-Za-z0-9_])(?:S1|S2|P10)($|[^A-Za-z0-9_])"
_FILTERED = f"""fr AS (SELECT * FROM r WHERE NOT regexp_matches(A, '{_BOUND}') AND NOT regexp_matches(B, '{_BOUND}')
                     AND react_class IN (3, 4, 5))"""


@register("reaction_parse", f"WITH {_PARSED} SELECT * FROM r")
def q_reaction_parse(spark, sf):
    return G.parse_reactions(reaction_text(spark, sf))


@register("reaction_filter", f"WITH {_PARSED}, {_FILTERED} SELECT A, B, react_class FROM fr")
def q_reaction_filter(spark, sf):
    r = G.reaction_filter(G.parse_reactions(reaction_text(spark, sf)), IGNORE_SPECIES, [3, 4, 5])
    return r.select("A", "B", "react_class")


_RATE5 = """CASE WHEN react_class = 3 THEN alpha * pow(5.0 / 300.0, beta) * exp(-gamma / 5.0)
     WHEN react_class = 4 THEN alpha * beta * (0.62 + 0.4767 * gamma * sqrt(300.0 / 5.0))
     WHEN react_class = 5 THEN alpha * beta * (1.0 + 0.0967 * gamma * sqrt(300.0 / 5.0)
                                + (gamma * gamma / 10.526) * (300.0 / 5.0)) END"""


@register("weighted_edges", f"""
WITH {_PARSED}, {_FILTERED},
k AS (SELECT *, CASE WHEN ({_RATE5}) > 0 THEN log10({_RATE5}) ELSE 0.0 END AS rate0 FROM fr),
p AS (SELECT quantile_cont(rate0, 0.05) AS q FROM k),
f AS (SELECT k.*, CASE WHEN rate0 < q THEN 0.0 ELSE rate0 END AS rate1 FROM k, p),
m AS (SELECT min(rate1) AS lo, max(rate1) AS hi FROM f)
SELECT A, B, react_class, round(rate1, 6) AS rate,
       round(coalesce((rate1 - lo) / nullif(hi - lo, 0), 0.0), 6) AS norm_rate,
       CASE react_class WHEN 3 THEN '#e41a1c' WHEN 4 THEN '#377eb8' WHEN 5 THEN '#4daf4a' WHEN 6 THEN '#984ea3' END AS colour
FROM f, m
""")
def q_weighted_edges(spark, sf):
    r = G.reaction_filter(G.parse_reactions(reaction_text(spark, sf)), IGNORE_SPECIES, [3, 4, 5])
    e = G.weighted_edges(r, temperature=5.0)
    return e.select("A", "B", "react_class", round6("rate").alias("rate"),
                    round6("norm_rate").alias("norm_rate"), "colour")


def _trade_rows(spark, sf):
    """lineitem rows with the supplier's and the customer's nation names."""
    li = T(spark, sf, "lineitem")
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = T(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    c = T(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = T(spark, sf, "nation")  # 25-row dimension table (fixed by the schema): broadcast
    ns = F.broadcast(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nat")))
    nc = F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_nat")))
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
         .join(c, o.o_custkey == c.c_custkey).join(ns, "s_nationkey").join(nc, "c_nationkey"))
    return j.select("s_nat", "c_nat", "l_quantity", *tables.ROW_KEYS["lineitem"])


_TRADE = """e AS (SELECT ns.n_name AS s_nat, nc.n_name AS c_nat, l.l_quantity, l.l_orderkey, l.l_partkey,
                 l.l_suppkey, l.l_linenumber
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
          JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation ns ON s.s_nationkey = ns.n_nationkey
          JOIN nation nc ON c.c_nationkey = nc.n_nationkey)"""
_EDGES = """SELECT least(s_nat, c_nat) AS a, greatest(s_nat, c_nat) AS b,
       arg_max(l_quantity, (l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS weight, count(*) AS n_rows
FROM e {where} GROUP BY 1, 2"""


@register("undirected_edges", f"WITH {_TRADE} {_EDGES.format(where='')}")
def q_undirected_edges(spark, sf):
    rows = _trade_rows(spark, sf)
    return G.undirected_edges(rows, "s_nat", "c_nat", [F.col("l_quantity").alias("weight")],
                              tables.ROW_KEYS["lineitem"])


@register("subnetwork", f"""WITH {_TRADE} {_EDGES.format(where="WHERE contains(s_nat, '_1') OR contains(c_nat, '_1')")}""")
def q_subnetwork(spark, sf):
    rows = _trade_rows(spark, sf).where(G.touches("s_nat", "c_nat", "_1"))
    return G.undirected_edges(rows, "s_nat", "c_nat", [F.col("l_quantity").alias("weight")],
                              tables.ROW_KEYS["lineitem"])


@register("node_properties", """
SELECT vec_id AS node, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y,
       CAST(0.0 AS DOUBLE) AS logncol, CASE WHEN label = 3 THEN 3 ELSE 0 END AS source FROM embeddings
""")
def q_node_properties(spark, sf):
    v = tables.vectors(spark, sf)
    return v.select(F.col("vec_id").alias("node"), round6(F.get("vec", 0)).alias("x"),
                    round6(F.get("vec", 1)).alias("y"), F.lit(0.0).alias("logncol"),
                    F.when(F.col("label") == 3, F.lit(3)).otherwise(F.lit(0)).alias("source"))
