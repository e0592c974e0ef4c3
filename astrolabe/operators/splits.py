"""Split algebra for linear models: L15, L19, L21.

Whether a row is on the test side of split ``s`` is a draw from the row's key, so a batch
of rows makes its own ``rows x splits`` mask, uses it and drops it.  Sums over the test
side of every split are one matrix product, masks times the rows' moments (``1, z_i,
z_i z_j`` with ``z`` the features and the target); the train side is the difference from
the sum over all rows.  What leaves a task is one row of moments per split.  Every fit
and every error is then algebra on a table of ``splits`` rows, whatever the input.

A row costs ``splits`` draws, far more than moving it, so the narrow rows are dealt evenly
first; no draw is stored.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolabe.functions.scalar import round6
from astrolabe.operators import gram, stats

#: Mask entries that a task holds at a time.
CELLS = 4_000_000


def side_mask(keys, seed: int, stream: str, n_splits: int, test_size: float) -> np.ndarray:
    """``rows x splits``: the draws of :func:`resample.uniform` for streams ``<stream><split>`` below ``test_size``."""
    heads = [f"{seed}_{stream}{s}_".encode() for s in range(n_splits)]
    limit = test_size * 4294967296.0
    out = np.empty((len(keys), n_splits), dtype=bool)
    for r, key in enumerate(keys):
        tail = str(key).encode()
        draws = b"".join([md5(h + tail).digest()[:4] for h in heads])
        out[r] = np.frombuffer(draws, dtype=">u4") < limit
    return out


def _products(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d + 1) for j in range(i, d + 1)]


def _moments(z: np.ndarray) -> np.ndarray:
    """Rows of ``1, z_i, z_i z_j (i <= j)``."""
    return np.column_stack([np.ones(len(z)), z, *[z[:, i] * z[:, j] for i, j in _products(z.shape[1] - 1)]])


def _arrays(m: np.ndarray, d: int):
    """One row of moments to ``n, sx, sy, syy, xtx, xty`` (the target is the last column)."""
    full = np.empty((d + 1, d + 1))
    for (i, j), v in zip(_products(d), m[d + 2:]):
        full[i, j] = full[j, i] = v
    return m[0], m[1:d + 1], m[d + 1], full[d, d], full[:d, :d], full[:d, d]


def _rows(df: DataFrame, key: str, x: list, y, center: list[float], extra: list[Column]) -> DataFrame:
    """``key`` as text, centred ``z`` as columns, evenly dealt."""
    z = [(F.col(c) if isinstance(c, str) else c).cast("double") - F.lit(m) for c, m in zip([*x, y], center)]
    narrow = df.select(F.col(key).alias("row_key"), F.col(key).cast("string").alias("key"), *[c.alias(f"z{i}") for i, c in enumerate(z)], *extra)
    known = narrow.where(" AND ".join(f"z{i} IS NOT NULL" for i in range(len(z))))
    return known.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def _pieces(batches, n_splits: int):
    step = max(1, CELLS // n_splits)
    for pdf in batches:
        for s in range(0, len(pdf), step):
            yield pdf.iloc[s:s + step]


def split_moments(rows: DataFrame, d: int, n_splits: int, test_size: float, seed: int, stream: str) -> dict[int, np.ndarray]:
    """``block -> (splits + 1) x moments``: sums over the test side of each split, and over all rows of the block."""
    q = 1 + (d + 1) + (d + 1) * (d + 2) // 2

    def kernel(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in _pieces(batches, n_splits):
            mask = side_mask(pdf["key"], seed, stream, n_splits, test_size).astype(np.float64)
            m, block = _moments(pdf[[f"z{i}" for i in range(d + 1)]].to_numpy(dtype=float)), pdf["block"].to_numpy()
            for b in np.unique(block):
                own = block == b
                part = np.vstack([mask[own].T @ m[own], m[own].sum(axis=0)])
                sums[b] = sums.get(b, 0.0) + part
        for b, part in sums.items():
            out = pd.DataFrame(part, columns=[f"m{i}" for i in range(q)])
            out.insert(0, "split", np.arange(n_splits + 1))
            out.insert(0, "block", int(b))
            yield out

    made = rows.mapInPandas(kernel, "block int, split int, " + ", ".join(f"m{i} double" for i in range(q)))
    found: dict[int, np.ndarray] = {}
    for r in made.groupBy("block", "split").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(q)]).collect():  # splits + 1 rows a block
        found.setdefault(r.block, np.zeros((n_splits + 1, q)))[r.split] = r[2:]
    return found


def _mse(part: np.ndarray, d: int, fit) -> float:
    return gram.sse_from_stats(*_arrays(part, d), *fit) / part[0] if part[0] else float("nan")


def _fit(part: np.ndarray, d: int, alpha: float):
    n, sx, sy, _, xtx, xty = _arrays(part, d)
    return gram.solve_ridge(n, sx, sy, xtx, xty, alpha)


def _errors(m: np.ndarray, d: int, alpha: float) -> np.ndarray:
    """``splits x (train, test)`` mean squared errors; NaN where a side has no row."""
    out = np.full((len(m) - 1, 2), np.nan)
    for s, test in enumerate(m[:-1]):
        train = m[-1] - test
        if train[0] > 0.5:
            fit = _fit(train, d, alpha)
            out[s] = _mse(train, d, fit), _mse(test, d, fit)
    return out


def shuffle_split_scores(df: DataFrame, key: str, x: list, y, n_splits: int = 100, test_size: float = 0.2,
                         seed: int = 42, stream: str = "ss", alpha: float = 0.0) -> DataFrame:
    """``split_id, train_mse, test_mse`` of a fit on each split's train side."""
    center = gram.column_means(df, x, y)
    rows = _rows(df, key, x, y, center, [F.lit(0).alias("block")])
    errors = _errors(split_moments(rows, len(x), n_splits, test_size, seed, stream).get(0, np.zeros((n_splits + 1, 1))), len(x), alpha)
    table = [(s, *(None if np.isnan(e) else float(e) for e in pair)) for s, pair in enumerate(errors)]
    return df.sparkSession.createDataFrame(table, "split_id long, train_mse double, test_mse double")


def data_importance(df: DataFrame, key: str, x: list, y, n_splits: int = 500, test_size: float = 0.2, seed: int = 42,
                    stream: str = "di", alpha: float = 0.0) -> DataFrame:
    """Per row, std over splits of (the split's test error where the row trained, else 0), divided by the least such std."""
    center = gram.column_means(df, x, y)
    rows = _rows(df, key, x, y, center, [F.lit(0).alias("block")])
    errors = _errors(split_moments(rows, len(x), n_splits, test_size, seed, stream).get(0, np.zeros((n_splits + 1, 1))), len(x), alpha)[:, 1]
    counted = ~np.isnan(errors)

    def kernel(batches):
        for pdf in _pieces(batches, n_splits):
            trained = ~side_mask(pdf["key"], seed, stream, n_splits, test_size)[:, counted]
            yield pd.DataFrame({"row_key": pdf["row_key"], "s": np.where(trained, errors[counted], 0.0).std(axis=1)})

    kind = df.schema[key].dataType.simpleString()
    spread = rows.mapInPandas(kernel, f"row_key {kind}, s double").checkpoint(eager=True)   # two numbers a row
    least = spread.agg(F.min("s").alias("least"))
    return stats.with_scalars(spread, least).select(F.col("row_key").alias(key), (F.col("s") / F.col("least")).alias("importance"))


def learning_curve(df: DataFrame, truth: DataFrame, key: str, x: list, y, fractions: list[float], n_splits: int = 5,
                   test_size: float = 0.2, seed: int = 42, stream: str = "lc", alpha: float = 0.0) -> DataFrame:
    """``step, split_id, mse``: fits on the train side of every split of the first ``floor(fraction * n)`` rows (in key
    order), scored on ``truth``.

    The rows between two steps are a block; a prefix's sums are those of its blocks, so one pass serves all steps.
    """
    center = gram.column_means(df, x, y)
    n = df.count()
    steps = sorted({int(np.floor(f * n)) for f in fractions})
    place = stats.global_position(df, [key], "place")
    block = F.lit(len(steps))
    for k in reversed(range(len(steps))):
        block = F.when(F.col("place") <= steps[k], k).otherwise(block)
    rows = _rows(place.where(F.col("place") <= (steps[-1] if steps else 0)), key, x, y, center, [block.cast("int").alias("block")])
    found = split_moments(rows, len(x), n_splits, test_size, seed, stream)
    true = gram.sufficient_stats(truth, x, y, means=center).first()
    out, total = [], 0.0
    for k, step in enumerate(steps):
        total = total + found.get(k, 0.0)
        for s in range(n_splits):
            train = total[-1] - total[s] if np.ndim(total) else np.zeros(1)
            mse = None
            if train[0] > 0.5 and true is not None and true["n"]:
                sse = gram.sse_from_stats(*gram.stats_to_arrays(true, len(x)), *_fit(train, len(x), alpha))
                mse = sse / true["n"]
            out.append((step, s, mse))
    made = df.sparkSession.createDataFrame(out, "step long, split_id long, mse double")
    return made.select("step", "split_id", round6("mse").alias("mse"))
