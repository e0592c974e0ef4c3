"""Property checks with seeded random vectors against NumPy (one Spark job per example)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from astrolabe.functions import vectors as V

DIM = st.integers(min_value=1, max_value=8)


def _vectors(draw, n, d):
    elems = st.floats(min_value=-10, max_value=10, allow_nan=False, allow_infinity=False, width=64)
    return [draw(st.lists(elems, min_size=d, max_size=d)) for _ in range(n)]


@st.composite
def pairs(draw):
    d = draw(DIM)
    n = draw(st.integers(min_value=1, max_value=12))
    return _vectors(draw, n, d), _vectors(draw, n, d)


@settings(max_examples=15, deadline=None)
@given(pairs())
def test_vector_columns_match_numpy(spark, ab):
    a, b = ab
    df = spark.createDataFrame(list(zip(a, b)), "a array<double>, b array<double>")
    rows = df.select(V.cosine_similarity("a", "b").alias("c"), V.euclidean("a", "b").alias("e"),
                     V.euclidean("b", "a").alias("e2"), V.dot("a", "b").alias("d"),
                     V.cosine_similarity("a", "a").alias("self")).collect()
    for (x, y), r in zip(zip(a, b), rows):
        x, y = np.array(x), np.array(y)
        nx, ny = np.linalg.norm(x), np.linalg.norm(y)
        assert np.isclose(r.e, np.linalg.norm(x - y), rtol=1e-9, atol=1e-9)
        assert r.e == r.e2                                    # symmetric
        assert np.isclose(r.d, x @ y, rtol=1e-9, atol=1e-9)
        if nx > 0 and ny > 0:
            assert -1 - 1e-9 <= r.c <= 1 + 1e-9                # range
            assert np.isclose(r.c, x @ y / (nx * ny), rtol=1e-9, atol=1e-9)
            assert np.isclose(r.self, 1.0)
        if nx == 0 or ny == 0:
            assert r.c is None                                 # undefined → NULL


@settings(max_examples=10, deadline=None)
@given(pairs())
def test_kernel_distances_match_columns(spark, ab):
    a, b = ab
    d = V.pair_distances(np.array(a), np.array(b))
    ref = np.sqrt(((np.array(a)[:, None, :] - np.array(b)[None, :, :]) ** 2).sum(-1))
    assert np.allclose(d, ref, rtol=1e-12, atol=1e-12)
