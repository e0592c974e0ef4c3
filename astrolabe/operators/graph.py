"""Reaction-network operators.

A network is two DataFrames: edges ``(a, b, attrs...)`` and nodes.  Building
the undirected simple graph is a group-by on the ordered endpoint pair with
"last row wins" attributes (``max_by`` over the row order), which Spark
partially aggregates before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolabe.functions import scalar as S
from astrolabe.operators import curate as C

# A float with 3-4 decimals and a 1-2 digit exponent; a 1-2 digit
# integer between whitespace.
FLOAT_PATTERN = r"\d.\d{3,4}[eE][\+\-]\d{1,2}"
INT_PATTERN = r"\s+\d{1,2}\s+"


def parse_reactions(lines: DataFrame, col: str = "value", signed: bool = False) -> DataFrame:
    """``!`` lines are comments; tokens 1-2 are the reactants; the first
    three float matches are alpha, beta, gamma; the *second* whitespace-
    delimited 1-2 digit integer is the reaction class.

    The number pattern has no sign: a negative number is read as positive,
    unless ``signed`` is set."""
    body = lines.where(~F.col(col).startswith("!"))
    toks = F.split(F.trim(F.col(col)), r"\s+")
    floats = F.regexp_extract_all(F.col(col), F.lit(("[+-]?" if signed else "") + FLOAT_PATTERN), 0)
    ints = F.regexp_extract_all(F.col(col), F.lit(INT_PATTERN), 0)
    return body.select(
        F.get(toks, 0).alias("A"), F.get(toks, 1).alias("B"),
        F.get(floats, 0).cast("double").alias("alpha"), F.get(floats, 1).cast("double").alias("beta"),
        F.get(floats, 2).cast("double").alias("gamma"),
        F.trim(F.get(ints, 1)).cast("int").alias("react_class"))


def reaction_filter(df: DataFrame, ignore: list[str], classes: list[int]) -> DataFrame:
    """G1: drop reactions with an ignored species on either side (whole token);
    keep listed classes."""
    return df.where(~C.contains_word("A", ignore) & ~C.contains_word("B", ignore)
                    & F.col("react_class").isin(*classes))


# Reaction class → colour.
CLASS_COLOURS = {3: "#e41a1c", 4: "#377eb8", 5: "#4daf4a", 6: "#984ea3"}


def weighted_edges(df: DataFrame, temperature: float = 5.0, floor_pct: float = 0.05) -> DataFrame:
    """Rate at T → log10 (non-finite → 0) → values under the global p5 → 0
    → min-max weight → class colour."""
    rate = S.compute_rate("react_class", F.lit(temperature), "alpha", "beta", "gamma")
    # the raw rate gets its own column: the clean-up below references its
    # input several times and would otherwise inline the whole rate law each time
    e = (df.withColumn("__raw", rate)
         .withColumn("rate", C.clean_nonfinite(S.log10_pos("__raw"))).drop("__raw"))
    # The percentile, the bounds and the output each read the edge table: parse
    # the records and evaluate the rate law once, into the shared checkpoint
    # folder (this also cuts the lineage back to the text scan).
    from astrolabe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    e = e.checkpoint(eager=True)
    e = C.percentile_floor(e, "rate", floor_pct)
    lo, hi = e.agg(F.min("rate"), F.max("rate")).collect()[0]  # two scalars
    span = (hi - lo) if lo is not None and hi is not None else None
    norm = (F.col("rate") - F.lit(lo)) / F.lit(span) if span else F.lit(0.0)
    return e.withColumn("norm_rate", norm).withColumn("colour", C.dict_map("react_class", CLASS_COLOURS))


def undirected_edges(df: DataFrame, a: str, b: str, attrs: list[str], order: list[str]) -> DataFrame:
    """One edge per unordered pair; repeated pairs keep the *last* row's attributes."""
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    g = df.groupBy(lo.alias("a"), hi.alias("b")).agg(
        F.max_by(F.struct(*attrs), F.struct(*order)).alias("__last"), F.count(F.lit(1)).alias("n_rows"))
    return g.select("a", "b", "__last.*", "n_rows")


def nodes(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct endpoint set."""
    return edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()


def touches(a: str, b: str, needle: str) -> Column:
    """Either end contains ``needle``."""
    return F.col(a).contains(needle) | F.col(b).contains(needle)
