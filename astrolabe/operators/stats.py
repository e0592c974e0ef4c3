"""Distributed scalar statistics that must not funnel a column into one task.

Spark's exact ``percentile`` aggregate merges every distinct value into one
buffer in the final task.  ``exact_percentiles`` instead counts values in bins
and narrows the bins around the two ranks of each requested position.  The
result is the same linear-interpolation percentile as NumPy / DuckDB
``quantile_cont``.  Global row numbers, ranks and running sums range-partition
and add per-partition offsets instead of a window without partition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sort_partitions(df: DataFrame) -> int:
    """Range partitions for a global sort: at least the shuffle setting, and at
    least as many as the input has splits, so a partition holds about one
    input split's worth of rows however large the table is."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        n = max(n, df.rdd.getNumPartitions())
    except Exception:  # Spark Connect: no RDD view
        pass
    return n


def _range_sorted(df: DataFrame, order: list, n_parts: int | None) -> DataFrame:
    n_parts = n_parts or _sort_partitions(df)
    # An explicit partition count: AQE never coalesces these partitions, so the
    # layout (and every partition id) is the same in each pass over the plan.
    return df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)


#: Bins of one refining pass, and bins per factor of two in the first.
BINS = 1 << 16
OCTAVE_BINS = 16


def octave_bin(v):
    """Bin of a finite double on a logarithmic scale: of one sign, ``OCTAVE_BINS`` per factor of two, smallest denormals included.

    Orders as the values do, whatever their range: about 67,000 bins hold every double.  A Column or a NumPy array.
    """
    if isinstance(v, np.ndarray):
        size = np.abs(v)
        with np.errstate(divide="ignore"):
            at = np.floor((np.log2(size) + 1075) * OCTAVE_BINS)
        return np.where(size > 0, np.sign(v) * (np.where(size > 0, at, 0) + 1), 0).astype(np.int64)
    at = F.floor((F.log2(F.abs(v)) + 1075) * OCTAVE_BINS) + 1
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * at).cast("long")


def select_ranks(first: dict, ranks: list[int], histogram) -> dict[int, float]:
    """Values at 0-based ``ranks`` of a set of finite doubles, by counting.

    ``first`` has the counts by :func:`octave_bin`: ``{bin: (count, min, max)}``.  ``histogram(intervals, bins)``
    counts the values of each closed interval in equal-width bins: ``{(interval, bin): (count, min, max)}``.  A
    rank is narrowed to the bin that holds it, to that bin's own smallest and largest value.  An octave bin is
    4.4 % wide, so three passes over 65,536 bins come down to neighbouring doubles, whatever the values.
    """
    def locate(bins: list, inside: int):
        """The value at a rank if it is an end of its bin, or the bin and the rank inside it."""
        for _, (n, low, high) in bins:
            if inside < n:
                if low == high or inside in (0, n - 1):
                    return (low if inside == 0 else high), None
                return None, (low, high, inside)
            inside -= n
        raise ValueError("a rank beyond the values")

    found: dict[int, float] = {}
    place: dict[int, tuple] = {}
    ordered = sorted(first.items())
    for r in set(ranks):
        found[r], place[r] = locate(ordered, r)
    while any(place.values()):
        intervals = sorted({x[:2] for x in place.values() if x})
        counts = histogram(intervals, BINS)
        per = {iv: sorted((k, v) for k, v in counts.items() if k[0] == i) for i, iv in enumerate(intervals)}
        for r, x in place.items():
            if x:
                found[r], place[r] = locate(per[x[:2]], x[2])
    return found


def percentiles_by_rank(first: dict, probs: list[float], histogram) -> list:
    """Linear-interpolated percentiles from the counts ``first`` (None without values); see :func:`select_ranks`."""
    n = sum(v[0] for v in first.values())
    if not n:
        return [None] * len(probs)
    spots = [(int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1))), p * (n - 1)) for p in probs]
    got = select_ranks(first, [r for a, b, _ in spots for r in (a, b)], histogram)
    # weights on both sides: the difference of two large values may be beyond the largest double
    return [got[a] if a == b else got[a] * (1 - (at - a)) + got[b] * (at - a) if abs(got[a]) > 1e300 or abs(got[b]) > 1e300
            else got[a] + (got[b] - got[a]) * (at - a) for a, b, at in spots]


def exact_percentiles(df: DataFrame, col: str, probs: list[float], names: list[str] | None = None) -> DataFrame:
    """One-row DataFrame with the exact linear-interpolated percentiles of ``col``.

    Counting passes instead of a sort: nothing is shuffled but bin counts, and a
    value shared by many rows is one count.  NULL, NaN and infinite values take
    no part.  Each pass reads ``df`` once, five at most for any values, so derive
    an expensive one first.
    """
    names = names or [f"p{i}" for i in range(len(probs))]
    v = F.col("v")
    values = df.select(F.col(col).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def counts(cell) -> dict:
        rows = (values.select("v", cell.alias("cell")).where("cell IS NOT NULL").groupBy("cell")
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        return {r.cell: (r.n, r.lo, r.hi) for r in rows.collect()}

    def histogram(intervals, bins):
        cell = None
        for i, (a, b) in enumerate(intervals):
            at = F.least(F.floor((v - a) / (b - a) * bins), F.lit(bins - 1)).cast("long") + i * bins
            inside = (v >= a) & (v <= b)
            cell = F.when(inside, at) if cell is None else cell.when(inside, at)
        return {divmod(k, bins): x for k, x in counts(cell).items()}

    got = percentiles_by_rank(counts(octave_bin(v)), probs, histogram)
    return df.sparkSession.createDataFrame([tuple(got)], ", ".join(f"{nm} double" for nm in names))


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the values of a one-row DataFrame (a global aggregate, a keyed
    lookup) to every row as typed literals.

    The row is fetched once (at most two rows are read, to prove there is
    exactly one); the result plan has no join at all.
    """
    rows = scalars.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"with_scalars expects exactly one row, got {len(rows)}")
    row = rows[0]
    lits = [F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in scalars.schema.fields]
    return df.select("*", *lits)


# --------------------------------------------------------------------------
# Global order without a single-partition window
# --------------------------------------------------------------------------

def _local_positions(df: DataFrame, order: list, n_parts: int | None) -> DataFrame:
    """Range-partition by the order key and number the rows inside each partition.

    ``monotonically_increasing_id`` is the partition id and the row's place in
    it, so the rows are numbered in the JVM.
    """
    numbered = _range_sorted(df, order, n_parts).withColumn("__id", F.monotonically_increasing_id())
    return (numbered.withColumn("__pid", F.shiftright("__id", 33))
            .withColumn("__local", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"))


def global_position(df: DataFrame, order: list, out: str = "pos", method: str = "row_number",
                    value_cols: list[str] | None = None, n_parts: int | None = None) -> DataFrame:
    """1-based global ``row_number`` (or competition ``rank``) over ``order``.

    A seeded random tiebreak is appended to the order, so a value shared by a
    third of the rows is still spread over many range partitions.  One range
    shuffle, one checkpoint (the positions are pinned: range boundaries are
    sampled per job), one count per partition read by the driver and joined back
    as a table of 16 bytes a partition.  For ``rank`` (``value_cols`` = the plain
    columns the order is made of) every tie group takes its smallest row number:
    a partial ``min`` aggregate joined back on the key.
    """
    from astrolabe.session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = df.withColumn("__tb", F.rand(42))
    loc = _local_positions(base, list(order) + [F.col("__tb")], n_parts).checkpoint(eager=True)
    counts = dict(loc.groupBy("__pid").agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, acc = [], 0
    for pid in sorted(counts):
        offsets.append((pid, acc))
        acc += counts[pid]
    rn = "__rn" if method == "rank" else out
    offs = spark.createDataFrame(offsets, "__pid long, __off long")
    res = (loc.join(F.broadcast(offs), "__pid").withColumn(rn, F.col("__off") + F.col("__local") + 1)
           .drop("__pid", "__local", "__tb", "__off"))
    if method != "rank":
        return res
    keys = list(value_cols or [])
    first = res.groupBy(*keys).agg(F.min("__rn").alias(out))
    first = first.select(*[F.col(k).alias(f"__k_{k}") for k in keys], out)
    cond = [res[k].eqNullSafe(first[f"__k_{k}"]) for k in keys]
    return res.join(first, cond).drop("__rn", *[f"__k_{k}" for k in keys])


def running_sum(df: DataFrame, order: list, value: str, out: str = "running",
                n_parts: int | None = None) -> DataFrame:
    """Cumulative sum over a global order (rows unbounded preceding .. current).

    Two passes instead of one unpartitioned window: per-range-partition sums
    give each partition its starting offset; inside a partition the running
    sum is a window over that partition's rows only.
    """
    pos = global_position(df, order, "__pos", n_parts=n_parts)
    # blocks of contiguous positions: bounded rows per window partition
    block = F.floor((F.col("__pos") - 1) / F.lit(1 << 20))
    pos = pos.withColumn("__blk", block)
    totals = pos.groupBy("__blk").agg(F.sum(value).alias("__t"))
    offs = totals.select("__blk", (F.sum("__t").over(Window.orderBy("__blk")) - F.col("__t"))
                         .alias("__o"))
    w = Window.partitionBy("__blk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    # one row per 2^20-row block: small, but it grows with the data, so AQE decides
    return (pos.join(offs, "__blk")
            .withColumn(out, F.col("__o") + F.sum(value).over(w))
            .drop("__blk", "__o"))
