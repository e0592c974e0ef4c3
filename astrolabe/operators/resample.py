"""Deterministic random draws and resampling tables.

Every draw is a pure function of ``(seed, stream, key)``:

    u = int(first 8 hex digits of md5("seed_stream_key"), 16) / 2**32

so the same rows come out on any cluster size, after any executor loss and
recomputation, and in SQL (the oracle computes the same expression).  Nothing
is sampled on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolabe.functions.schema import seq_long


def uniform(seed, stream, key) -> Column:
    """u in [0, 1) from md5(seed_stream_key)."""
    def s(x):
        return x.cast("string") if isinstance(x, Column) else F.lit(str(x))
    h = F.substring(F.md5(F.concat_ws("_", s(seed), s(stream), s(key))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed, stream, key_sql: str) -> str:
    """The same draw in DuckDB SQL."""
    return (f"(('0x' || substr(md5(concat_ws('_', '{seed}', '{stream}', CAST({key_sql} AS VARCHAR))),"
            f" 1, 8))::BIGINT / 4294967296.0)")


def gaussian(seed, stream, key) -> Column:
    """Box-Muller standard normal from two independent draws."""
    u1 = uniform(seed, F.concat(F.lit(f"{stream}a")), key)
    u2 = uniform(seed, F.concat(F.lit(f"{stream}b")), key)
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2.0 * math.pi * u2)


def gaussian_sql(seed, stream, key_sql: str) -> str:
    u1 = uniform_sql(seed, f"{stream}a", key_sql)
    u2 = uniform_sql(seed, f"{stream}b", key_sql)
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos(2.0 * pi() * {u2}))"


def split_flag(key, seed: int = 42, test_size: float = 0.2, stream: str = "split") -> Column:
    """True for the test side of a hash-ordered train/test split."""
    return uniform(seed, stream, key) < test_size


def fold_of(key, k: int, seed: int = 42, stream: str = "fold") -> Column:
    """Fold id in [0, k) from the hash draw (k-fold assignment)."""
    return F.floor(uniform(seed, stream, key) * k).cast("long")


def fold_sql(key_sql: str, k: int, seed: int = 42, stream: str = "fold") -> str:
    return f"CAST(floor({uniform_sql(seed, stream, key_sql)} * {k}) AS BIGINT)"


def bootstrap(df: DataFrame, order: list, n_draws: int | None = None, seed: int = 42,
              stream: str = "boot", noise_col: str | None = None, noise_scale: float = 0.5) -> DataFrame:
    """Draws with replacement.  Draw j takes row ``floor(u(seed, stream, j) * n)``
    of the table in ``order``; optional Gaussian noise on ``noise_col``.

    Rows are addressed by a dense global position (distributed), the draws
    table is a ``range`` of the table's own size, and the two meet in an
    equi-join on the position — no driver involvement, no cross join.
    """
    from astrolabe.operators import stats

    spark = df.sparkSession
    pos = stats.global_position(df, order, "__pos")  # 1-based
    total = df.count()
    n = total if n_draws is None else n_draws
    draws = spark.range(n).select(F.col("id").alias("draw_id"),
                                  (F.floor(uniform(seed, stream, F.col("id")) * total) + 1).cast("long").alias("__pos"))
    out = draws.join(pos, "__pos").drop("__pos")
    if noise_col:
        out = out.withColumn(noise_col, F.col(noise_col) + noise_scale * gaussian(seed, "noise", F.col("draw_id")))
    return out


def sample_without(df: DataFrame, key: str, n: int, seed: int = 42, stream: str = "sample") -> DataFrame:
    """N rows without replacement = the n smallest hash draws (a top-n, so
    each task keeps only its own n best before the final merge)."""
    return (df.withColumn("__u", uniform(seed, stream, F.col(key)))
            .orderBy("__u", key).limit(n).drop("__u"))


def in_row_order(sample: DataFrame, order: list, position: str = "position") -> DataFrame:
    """The rows of a sample numbered from 1 in the order of the table they come from."""
    from astrolabe.operators import stats
    return stats.global_position(sample, order, position)


def group_shuffle_split(groups: DataFrame, group: str, n_splits: int, test_size: float,
                        seed: int = 42, stream: str = "gss") -> DataFrame:
    """Per split, groups ordered by their hash draw; the first ceil(test_size * G)
    are the test side.  No group is ever on both sides of a split.

    Ranks come from one distributed global order over ``(split, u, group)``;
    each split holds exactly G groups, so the rank inside a split is the
    global position minus ``split * G``.
    """
    from astrolabe.operators import stats

    g = groups.select(group).distinct()
    n_groups = g.count()
    n_test = math.ceil(test_size * n_groups)
    rows = g.select(group, seq_long(n_splits).alias("split_id"))
    rows = rows.withColumn("__u", uniform(seed, F.concat(F.lit(stream), F.col("split_id").cast("string")),
                                          F.col(group)))
    pos = stats.global_position(rows, ["split_id", "__u", group], "__pos")
    return pos.select("split_id", group,
                      ((F.col("__pos") - F.col("split_id") * n_groups) <= n_test).alias("is_test"))


def group_bootstrap(df: DataFrame, key: str, group: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Split *groups* first (hash order, first ceil(test_size * G) groups are test),
    then draw with replacement inside each side; the group id travels along."""
    from astrolabe.operators import stats

    g = df.select(group).distinct()
    n_groups = g.count()
    n_test = math.ceil(test_size * n_groups)
    gp = stats.global_position(g.withColumn("__u", uniform(seed, "grp", F.col(group))), ["__u", group], "__gpos")
    sides = df.join(gp.select(group, (F.col("__gpos") <= n_test).alias("is_test")), group)
    # per-side dense positions: order by (side, key); the train side comes first
    pos = stats.global_position(sides, ["is_test", key], "__pos")
    counts = {r["is_test"]: r["c"] for r in sides.groupBy("is_test").agg(F.count(F.lit(1)).alias("c")).collect()}
    n_train, n_te = counts.get(False, 0), counts.get(True, 0)
    pos = pos.withColumn("__side_pos", F.when(F.col("is_test"), F.col("__pos") - n_train).otherwise(F.col("__pos")))
    spark = df.sparkSession
    draws = []
    for is_test, n_side, tag in ((False, n_train, "boot_train"), (True, n_te, "boot_test")):
        if n_side == 0:
            continue
        draws.append(spark.range(n_side).select(
            F.col("id").alias("draw_id"), F.lit(is_test).alias("is_test"),
            (F.floor(uniform(seed, tag, F.col("id")) * n_side) + 1).cast("long").alias("__side_pos")))
    d = draws[0] if len(draws) == 1 else draws[0].unionByName(draws[1])
    out = d.join(pos, ["is_test", "__side_pos"])
    return out.select("draw_id", (~F.col("is_test")).alias("is_train"), key, F.col(group).alias("group_id"))


def masked_resample(df: DataFrame, key: str, side: str, n_splits: int, fraction: float | None = None,
                    seed: int = 42, stream: str = "mr", n_rows: int | None = None) -> DataFrame:
    """Per split and side of a given mask, sample ``floor(fraction * n_side)``
    rows, or ``n_rows`` of them (all, if fewer), without replacement (smallest hash draws)."""
    if (fraction is None) == (n_rows is None):
        raise ValueError("give a fraction or a number of rows")
    from astrolabe.operators import stats

    rows = df.select(key, side, seq_long(n_splits).alias("split_id"))
    rows = rows.withColumn("__u", uniform(seed, F.concat(F.lit(stream), F.col("split_id").cast("string")),
                                          F.col(key)))
    pos = stats.global_position(rows, ["split_id", side, "__u", key], "__pos")
    first = pos.groupBy("split_id", side).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    pos = pos.join(F.broadcast(first), ["split_id", side])  # splits x 2 rows
    most = F.lit(n_rows) if fraction is None else F.floor(F.lit(fraction) * F.col("__n"))
    keep = (F.col("__pos") - F.col("__first") + 1) <= most
    return pos.where(keep).select("split_id", side, key)
