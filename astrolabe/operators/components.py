"""Connected components of a table of edges, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (longs ``a, b``, which differ); the root is the smallest node it is connected with.

    In turn every node hands its larger neighbours, then its smaller ones, to the smallest node around it, until nothing
    moves.  Each turn is a reliable checkpoint; only the number of edges and a checksum reach the driver.
    """
    from astrolabe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(edges.sparkSession)

    def handed(pairs: DataFrame, larger: bool) -> DataFrame:
        """``pairs`` has a row ``n, u`` for every neighbour ``u`` that node ``n`` looks at."""
        least = pairs.groupBy("n").agg(F.least(F.min("u"), F.first("n")).alias("m"))
        met = pairs.join(least, "n")
        rows = met.where("u > n").select("m", "u") if larger else met.select("m", "u").union(least.select("m", "n"))
        return rows.toDF("a", "b").where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint(eager=True)
    last = state(now)
    while last[0]:
        both = now.select(F.col("a").alias("n"), F.col("b").alias("u"))
        both = both.union(now.select("b", "a"))
        stars = handed(both, True)
        now = handed(stars.select(F.col("b").alias("n"), F.col("a").alias("u")), False).checkpoint(eager=True)
        new = state(now)
        if new == last:
            break
        last = new
    leaves = now.where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.union(now.select(F.col("a"), F.col("a")).distinct())
