"""Vector Column builders (F1-F5) and NumPy block kernels used inside tasks.

Column builders are JVM-side expressions (``zip_with`` / ``aggregate``); they
suit per-row work against one reference vector.  Pair work between many rows
goes through the Arrow block kernels in :mod:`astrolabe.operators.search`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(x) -> Column:
    return _c(x).cast("array<double>")


def vsum(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def l2norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a, b) -> Column:
    """dot(a,b) / (|a||b|); NULL when a norm is zero (ANSI-safe)."""
    return F.try_divide(dot(a, b), l2norm(a) * l2norm(b))


def sq_euclidean(a, b) -> Column:
    """F3 squared form: sum((a-b)^2)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, v: acc + v)


def euclidean(a, b) -> Column:
    """sqrt(sum((a-b)^2))."""
    return F.sqrt(sq_euclidean(a, b))


def vadd(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vsub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def vscale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(s)
    return F.transform(_c(a), lambda x: x * s)


def lerp(a, b, t) -> Column:
    """F5 single point: a + (b - a) * t."""
    t = t if isinstance(t, Column) else F.lit(t)
    return F.zip_with(_c(a), _c(b), lambda x, y: x + (y - x) * t)


def is_zero_vector(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + F.abs(v)) == 0


# --------------------------------------------------------------------------
# NumPy kernels (run inside Spark tasks on Arrow batches)
# --------------------------------------------------------------------------

def stack(values) -> np.ndarray:
    """pandas Series of arrays -> 2-D float64 matrix."""
    if len(values) == 0:
        return np.zeros((0, 0), dtype=np.float64)
    return np.vstack([np.asarray(v, dtype=np.float64) for v in values])


def pair_distances(queries: np.ndarray, refs: np.ndarray, metric: str = "euclidean",
                   max_cells: int = 4_000_000) -> np.ndarray:
    """Distance matrix [len(queries), len(refs)] in float64.

    Euclidean is computed from explicit differences (not the |a|²+|b|²-2ab
    shortcut) so results agree with a straight SQL sum of squares and no
    cancellation error turns a true zero into a small positive number.
    """
    nq, nr = len(queries), len(refs)
    out = np.empty((nq, nr), dtype=np.float64)
    if nq == 0 or nr == 0:
        return out
    if metric == "dot":
        return queries @ refs.T
    if metric == "cosine":
        qn = np.linalg.norm(queries, axis=1)
        rn = np.linalg.norm(refs, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = (queries @ refs.T) / np.outer(qn, rn)
        return 1.0 - sim
    # bound the temporary [nq, block, d] difference tensor (~32 MB)
    block = max(1, max_cells // max(1, nq * queries.shape[1]))
    for s in range(0, nr, block):
        r = refs[s:s + block]
        diff = queries[:, None, :] - r[None, :, :]
        np.sqrt(np.einsum("ijk,ijk->ij", diff, diff), out=out[:, s:s + len(r)])
    return out


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by one product, around a common centre so that an offset costs no digits.

    For smooth functions of them (kernels); a true zero may come out as some 1e-16 of the squared spread.
    """
    if len(b):
        centre = b.mean(axis=0)
        a, b = a - centre, b - centre
    out = a @ b.T
    out *= -2.0
    out += (a * a).sum(axis=1)[:, None]
    out += (b * b).sum(axis=1)
    return np.maximum(out, 0.0, out=out)
